"""Removal of long repeated byte strings by counted buckets of anchors.

This stands in for bucket-pointer refinement, in which the members of a bucket
are sorted by the bucket identifiers that the positions some bytes on have.
That takes an exchange of all positions a level. Here a bucket's identifier is
a 64-bit name of the bytes that its members share, so the identifier at a later
offset need not be looked up: it is computed from the text's prefix hashes, for
depths of 100, 200 and 400 in turn. A level groups and counts names; what is alone
in its bucket is done and drops out.

Not every suffix goes in. Of the 301 places where a 100-byte gram can start in
a 400-byte string, the one with the least gram hash (first of equals) is its
anchor, so equal strings have their anchors at the same offset, and buckets of
anchors stand for all strings around them. What a level leaves open is refined
by the next one:

1. members of a gram bucket whose buckets from 300 bytes before to 400 after
   the anchor are equal too repeat in every string that the anchor stands for;
2. of the rest, 16 neighbouring strings at a time are looked at: if the bytes
   common to all of them are alone in their bucket, none repeats; if their
   union is not, all do;
3. of the rest, every 400-byte string gets its identifier from those at its
   offsets 0, 100, 200 and 300.

Grouping needs no pairs: a bucket is counted, and members of buckets of two or
more go on. Counts are aggregated before the exchange and met by a join whose
skewed side Spark can split, so a gram that a third of all anchors share is
dealt out; the plan is the same at every size. Texts are read again for
each level (their hashes are cheap) and meet the open nodes in a join.

Defined results: null and short texts keep all bytes; equal rows (same id and
text) repeat each other; rows of equal id and different texts are judged each
for itself; an empty table gives no rows; a very long text is hashed in one
piece of its task's memory; only the id and text columns are read, whatever
the others' names. In the kept text, bytes of characters that a span cuts in
two are left out; hash and counts are those of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlake.functions.staging import materialize
from ledgerlake.llm import bytegrams as bg

LENGTH, GRAM, STEP = 400, 100, 16
#: Texts that are cut before they are handed back.
ROWS_AT_ONCE = 500
#: Open nodes or spans (16 bytes each) that are broadcast at most; beyond it, texts are shuffled to them.
MAX_BROADCAST = 2_000_000
_POS = np.uint64((1 << 28) - 1)


_K = np.uint64(0x9E3779B97F4A7C15)


def _bucket(prefix: np.ndarray, at: np.ndarray, depth: int, gram: int) -> np.ndarray:
    """Identifiers of the buckets of a depth (the gram's length times a power of two) at these places."""
    if depth == gram:
        return bg.span_hash(prefix, at, at + gram)
    half = depth // 2
    return bg.mix(_bucket(prefix, at, half, gram) * _K + _bucket(prefix, at + half, half, gram))


def _refined(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram: int, salt: np.ndarray | int = 0) -> np.ndarray:
    """Identifiers of the buckets of [lo, hi), from those of the largest depth below, at the start and at the end."""
    size = np.asarray(hi - lo)
    out = np.zeros(len(size), np.uint64)
    depth = gram
    while True:
        last = 2 * depth >= size.max(initial=0)
        at = np.flatnonzero((size > depth) & ((size <= 2 * depth) | last) if depth > gram else (size <= 2 * depth))
        if len(at):
            out[at] = _bucket(prefix, lo[at], depth, gram) * _K + _bucket(prefix, hi[at] - depth, depth, gram)
        if last:
            break
        depth *= 2
    return bg.mix(out + (size.astype(np.uint64) << np.uint64(20)) + np.asarray(salt).astype(np.uint64)).view(np.int64)


def _context(prefix, x, lo, hi, before: int, after: int, gram: int, salt) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifier of the bytes [x - before, x + after), cut at the ends of the text, and the cut span."""
    a, b = np.maximum(x - before, lo), np.minimum(x + after, hi)
    return _refined(prefix, a, b, gram, (x - a).astype(np.uint64) * np.uint64(1 << 40) + np.asarray(salt).astype(np.uint64)), a, b


def _anchors(length: int, gram: int):
    w = length - gram + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("k").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in bg.text_chunks(batch.column("text")):
                if len(buf) < length:
                    continue
                prefix = bg.prefix_hash(buf, False)
                at = np.arange(len(buf) - gram + 1)
                grams = bg.span_hash(prefix, at, at + gram)
                least = bg.sliding_min(grams & ~_POS | at.astype(np.uint64), w)  # one per string of `length` bytes
                text = np.repeat(np.arange(hi - lo), np.diff(offsets))[: len(least)]
                ok = np.flatnonzero(np.arange(len(least)) + length <= offsets[1:][text])
                if not len(ok):
                    continue
                x = (least[ok] & _POS).astype(np.int64)
                first = np.concatenate([[True], (x[1:] != x[:-1]) | (ok[1:] != ok[:-1] + 1)])
                start = np.flatnonzero(first)
                x, p_lo, p_hi = x[start], ok[start], ok[np.concatenate([start[1:], [len(ok)]]) - 1]
                t = text[p_lo]
                base = offsets[t]
                whole, _, _ = _context(prefix, x, base, offsets[t + 1], length - gram, length, gram, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo:hi][t]), pa.array((x - base).astype(np.int32)), pa.array((x - p_hi).astype(np.int16)), pa.array((x - p_lo).astype(np.int16)), pa.array(grams[x].view(np.int64)), pa.array(whole), pa.array((offsets[t + 1] - base).astype(np.int32))],
                    names=["k", "x", "d_lo", "d_hi", "h", "whole", "n"],
                )

    return rows


def _level(length: int, gram: int, step: int, leaves: bool):
    """Identifiers of the open nodes: of groups of `step` strings (their common bytes and their union), or of single strings."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = batch.column("k").to_numpy(zero_copy_only=False), batch.column("nodes")
            for lo, hi, buf, offsets in bg.text_chunks(batch.column("text")):
                own = [np.array(n.as_py(), np.int64).reshape(-1, 3) for n in nodes.slice(lo, hi - lo)]
                t = np.repeat(np.arange(hi - lo), [len(o) for o in own])
                x, d_lo, d_hi = np.concatenate(own).T
                if not leaves:
                    lo_c, hi_c = d_lo // step, d_hi // step
                else:
                    lo_c, hi_c = d_lo, d_hi
                counts = hi_c - lo_c + 1
                i = np.repeat(np.arange(len(x)), counts)
                c = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + lo_c[i]
                t, x, d_lo, d_hi = t[i], x[i], d_lo[i], d_hi[i]
                prefix = bg.prefix_hash(buf, False)
                base = offsets[t]
                at = base + x
                if leaves:
                    columns = [keys[lo:hi][t], (x - c).astype(np.int32), _refined(prefix, at - c, at - c + length, gram)]
                    names = ["k", "p", "h"]
                else:
                    common = _refined(prefix, at - step * c, at - step * c - step + 1 + length, gram, c)
                    union, a, b = _context(prefix, at - step * c, base, offsets[t + 1], step - 1, length, gram, c)
                    columns = [keys[lo:hi][t], x.astype(np.int32), np.maximum(d_lo, step * c).astype(np.int16), np.minimum(d_hi, step * c + step - 1).astype(np.int16), common, union, (a - base).astype(np.int32), (b - base).astype(np.int32)]
                    names = ["k", "x", "d_lo", "d_hi", "h", "whole", "lo", "hi"]
                yield pa.RecordBatch.from_arrays([pa.array(col) for col in columns], names=names)

    return rows


def _cut(id_col: str):
    def part_rows(part: pa.RecordBatch) -> pa.RecordBatch:
        n_bytes, removed, spans, hashes, cuts, kept = [], [], [], [], [], []
        for text, nodes in zip(part.column("text").cast(pa.large_binary()), part.column("nodes"), strict=True):
            data = text.as_py() if text.is_valid else b""
            runs: list[list[int]] = []
            if nodes.is_valid:
                for a, b in sorted(set(map(tuple, np.array(nodes.as_py(), np.int64).reshape(-1, 2).tolist()))):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
            rest = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(data)], strict=True))
            n_bytes.append(len(data))
            removed.append(len(data) - len(rest))
            spans.append(len(runs))
            hashes.append(hashlib.sha256(rest).hexdigest())
            cuts.append([x for r in runs for x in r])
            kept.append((rest.decode("utf-8", "ignore").encode() if runs else rest) if text.is_valid else None)
        columns = [part.column("id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string()), pa.array(cuts, pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield part_rows(batch.slice(lo, ROWS_AT_ONCE))

    return rows


def _met(rows: DataFrame, side: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined with a side of one row per key. The side is written first, so rows are dealt by key as they are, and a crowded key can be split."""
    return rows.join(materialize(side, "side"), key, how)


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose bucket holds two or more."""
    return _met(rows, rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key), key, "left_semi")


def _united(spans: DataFrame) -> DataFrame:
    """Spans of a text that overlap or touch as one."""
    by_start = W.partitionBy("k").orderBy("lo", "hi")
    rows = spans.withColumn("reach", F.max("hi").over(by_start.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1)).over(by_start))
    return rows.groupBy("k", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("k", "lo", "hi")


def _settled(rows: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose whole bytes repeat, and the rows to refine.

    Of each settled group, the first member goes on with the unsettled members
    of its bucket: it stands for the group when they look for strings like theirs.
    """
    groups = rows.groupBy("whole").agg(F.count("*").alias("_n"), F.min(F.struct(*place)).alias("_head")).filter("_n > 1").select("whole", "_head")
    rows = _met(rows, groups, "whole", "left")
    settled, open_ = rows.filter("_head is not null"), rows.filter("_head is null").drop("_head")
    heads = _met(settled.filter(F.struct(*place) == F.col("_head")).drop("_head"), open_.select("h").distinct(), "h", "left_semi")
    return settled, open_.unionByName(heads)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """Per row of docs: its id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end of each removed run, flat) and text (what is left)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"))
    lean = texts.select("k", "text")

    def with_text(rows: DataFrame, fields: list[str], base: DataFrame, how: str) -> DataFrame:
        by_doc = rows.groupBy("k").agg(F.flatten(F.collect_list(F.array(*[F.col(f).cast("int") for f in fields]))).alias("nodes"))
        if rows.count() <= MAX_BROADCAST:
            by_doc = F.broadcast(by_doc)
        return base.join(by_doc, "k", how)

    anchors = lean.filter(F.octet_length("text") >= length).mapInArrow(_anchors(length, gram), "k bigint, x int, d_lo smallint, d_hi smallint, h bigint, whole bigint, n int")
    met = materialize(_repeated(materialize(anchors, "anchors"), "h"), "anchors-met")
    settled, open_ = _settled(met, ["k", "x"])
    done = settled.select("k", F.greatest(F.col("x") - (length - gram), F.lit(0)).alias("lo"), F.least(F.col("x") + length, F.col("n")).alias("hi"))
    open_ = materialize(open_.select("k", "x", "d_lo", "d_hi"), "anchors-open")

    groups = with_text(open_, ["x", "d_lo", "d_hi"], lean, "inner").mapInArrow(_level(length, gram, step, False), "k bigint, x int, d_lo smallint, d_hi smallint, h bigint, whole bigint, lo int, hi int")
    groups = materialize(_repeated(materialize(groups, "groups"), "h"), "groups-met")
    settled, open2 = _settled(groups, ["k", "x", "d_lo"])
    done2 = settled.select("k", "lo", "hi")
    open2 = materialize(open2.select("k", "x", "d_lo", "d_hi"), "groups-open")

    leaves = with_text(open2, ["x", "d_lo", "d_hi"], lean, "inner").mapInArrow(_level(length, gram, step, True), "k bigint, p int, h bigint")
    done3 = _repeated(materialize(leaves, "leaves"), "h").select("k", F.col("p").alias("lo"), (F.col("p") + length).alias("hi"))
    spans = materialize(_united(done.union(done2).union(done3)), "repeats")
    return with_text(spans, ["lo", "hi"], texts, "left").select("id", "text", "nodes").mapInArrow(_cut(id_col), f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>, text string")
