"""Benchmark decontamination by winnowing.

A text and a benchmark item that share a run of `window` words also share at
least one winnowed fingerprint: both keep the least hash of every
`window - gram + 1` neighbouring word `gram`-grams, and a shared run holds one
such neighbourhood whole. Each fingerprint travels with the hashes of the
words around it, so a join on fingerprints and a comparison of the two
neighbourhoods extends every hit to the whole shared run, with no second look
at the texts. Items of fewer words than `window` are one run each: they are
looked up by the hash of all their words at every position.

Defined results: null and empty texts have no words and are clean; an item
without words is ignored; items with equal ids and repeated rows each count,
an item id is listed once; rows with a null doc_id are judged each for itself;
extra columns of the inputs are ignored, whatever their names; items with a null
id mark words as hit but are not listed; of equal gram hashes in a window the
first is kept; a very long text is hashed in one piece of its task's memory;
empty documents give no rows, an empty benchmark leaves all clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import bytegrams as bg

GRAM = 6
#: Benchmark fingerprints that are collected as a filter and broadcast at most (16 MB); beyond it, the join is a shuffle.
MAX_FINGERPRINTS = 2_000_000


def _lists(values: list[np.ndarray]) -> pa.Array:
    """Arrays of words as one list column."""
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def _winnow(grams: np.ndarray, before: np.ndarray, gram: int, w: int) -> np.ndarray:
    """Positions of the least gram hash (first of equals) in each w neighbouring grams of one text; texts with fewer grams keep their least."""
    m = len(grams)
    if not m:
        return np.empty(0, np.int64)
    ok = bg.inside_text(before, gram, m)
    key = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(m, dtype=np.uint64)
    key[~ok] = np.uint64(0xFFFFFFFFFFFFFFFF)
    padded = np.concatenate([np.full(w - 1, 0xFFFFFFFFFFFFFFFF, np.uint64), key, np.full(w - 1, 0xFFFFFFFFFFFFFFFF, np.uint64)])
    least = bg.sliding_min(padded, w)
    # Windows that reach over a text's edge only add fingerprints: a whole window inside the text still gives its own least.
    at = np.unique(least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[at < m]
    return at[ok[at]]


def _context(words: np.ndarray, before: np.ndarray, at: np.ndarray, back: int, size: int, fill: int) -> np.ndarray:
    """Rows of `size` word hashes from `back` words before each position; words of other texts become `fill`."""
    text = np.searchsorted(before, at, "right") - 1
    lo, hi = before[text], before[text + 1]
    index = at[:, None] - back + np.arange(size)[None, :]
    inside = (index >= lo[:, None]) & (index < hi[:, None])
    return np.where(inside, words[np.clip(index, 0, len(words) - 1)], np.uint64(fill))


def _benchmark_rows(item_col: str, text_col: str, window: int, gram: int):
    back, size = window - gram, 2 * window - gram

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(item_col)
            for lo, hi, buf, offsets in bg.text_chunks(batch.column(text_col)):
                words, before = bg.word_hashes(buf, offsets, bg.LETTERS_DIGITS)
                counts = np.diff(before)
                long_ = np.repeat(counts >= window, counts)
                at = _winnow(bg.gram_hashes(words, gram), before, gram, window - gram + 1)
                at = at[long_[at]]
                grams = bg.gram_hashes(words, gram)
                out = [(np.searchsorted(before, at, "right") - 1, grams[at], np.zeros(len(at), np.int32), list(_context(words, before, at, back, size, 1).view(np.int64)))]
                for i in np.flatnonzero((counts > 0) & (counts < window)):
                    own = words[before[i] : before[i + 1]]
                    out.append((np.array([i]), bg.gram_hashes(own, len(own)), np.array([len(own)], np.int32), [own.view(np.int64)]))
                which = np.concatenate([o[0] for o in out])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array(which)).cast(pa.string()), pa.array(np.concatenate([o[1] for o in out]).view(np.int64)), pa.array(np.concatenate([o[2] for o in out])), _lists([c for o in out for c in o[3]])],
                    names=["item_id", "fp", "kind", "item_ctx"],
                )

    return rows


class _Filter:
    """Says which hashes may be in a set: a bit table of a fixed number of bytes, then exact search."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)
        self.shift = np.uint64(64 - max(16, min(24, int(16 * max(1, len(values))).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(values >> self.shift).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Indexes of the values of h in the set."""
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0]
        found = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        return at[self.values[found] == h[at]]


def _document_rows(id_col: str, text_col: str, window: int, gram: int, short: list[int], known: dict[int, _Filter] | None):
    back, size = window - gram, 2 * window - gram

    def pick(kind: int, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        if known is None:
            return at
        return at[known[kind].hits(grams[at])] if kind in known else at[:0]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 40
        for batch in batches:
            ids = batch.column(id_col)
            for lo, hi, buf, offsets in bg.text_chunks(batch.column(text_col)):
                words, before = bg.word_hashes(buf, offsets, bg.LETTERS_DIGITS)
                n = hi - lo
                # A row of kind -1 for each text meets no item; its own key keeps these rows apart in a join by shuffle.
                which, fps, kinds, poss = [np.arange(n)], [bg.mix(np.arange(serial, serial + n).astype(np.uint64))], [np.full(n, -1, np.int32)], [np.zeros(n, np.int64)]
                ctx: list[np.ndarray] = [np.empty(0, np.int64)] * n
                if known is None or 0 in known:
                    grams = bg.gram_hashes(words, gram)
                    at = pick(0, grams, _winnow(grams, before, gram, window - gram + 1))
                    if len(at):
                        text = np.searchsorted(before, at, "right") - 1
                        which.append(text), fps.append(grams[at]), kinds.append(np.zeros(len(at), np.int32)), poss.append(at - before[text])
                        ctx += list(_context(words, before, at, back, size, 0).view(np.int64))
                for k in short:
                    grams = bg.gram_hashes(words, k)
                    at = pick(k, grams, np.flatnonzero(bg.inside_text(before, k, len(grams))))
                    if len(at):
                        text = np.searchsorted(before, at, "right") - 1
                        which.append(text), fps.append(grams[at]), kinds.append(np.full(len(at), k, np.int32)), poss.append(at - before[text])
                        ctx += list(words[at[:, None] + np.arange(k)[None, :]].view(np.int64))
                row = np.concatenate(which)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).take(pa.array(row)),
                        pa.array(serial + row),
                        pa.array(np.diff(before)[row]),
                        pa.array(np.concatenate(fps).view(np.int64)),
                        pa.array(np.concatenate(kinds)),
                        pa.array(np.concatenate(poss)),
                        _lists(ctx),
                    ],
                    names=["_doc", "_row", "n_words", "fp", "kind", "pos", "ctx"],
                )
                serial += n

    return rows


def _extended(window: int, gram: int) -> Column:
    """struct<lo, hi>: the whole run of words that both sides share around a fingerprint, if it holds a window; else null.

    Both neighbourhoods are arrays of word hashes with the fingerprint's gram at the same place.
    """
    back = window - gram
    same = F.zip_with("ctx", "item_ctx", lambda a, b: a == b)

    def run(flags: Column, size: int) -> Column:
        """How many of the first flags hold."""
        stop = F.array_position(flags, False)
        return F.when(stop == 0, F.lit(size)).otherwise(stop - 1).cast("bigint")

    def found(v: Column) -> Column:
        left, right = run(F.reverse(F.slice(v, 1, back)), back), run(F.slice(v, window + 1, back), back)
        whole = ~F.array_contains(F.slice(v, back + 1, gram), False) & (left + right + gram >= window)
        return F.when(whole, F.struct((F.col("pos") - left).alias("lo"), (F.col("pos") + gram + right).alias("hi")))

    long_ = F.element_at(F.transform(F.array(same), found), 1)
    short = F.when(F.col("ctx") == F.col("item_ctx"), F.struct(F.col("pos").alias("lo"), (F.col("pos") + F.col("kind")).alias("hi")))
    return F.when(F.col("kind") == 0, long_).when(F.col("kind") > 0, short)


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, gram: int = GRAM, min_share: int = 20) -> DataFrame:
    """One row per document: its words, those inside a benchmark window, the items met, and the verdict (1/min_share of the words hit)."""
    spark = docs.sparkSession
    bench = items.select(item_col, item_text).mapInArrow(_benchmark_rows(item_col, item_text, window, gram), "item_id string, fp bigint, kind int, item_ctx array<bigint>")
    bench = bench.distinct()
    count = bench.limit(MAX_FINGERPRINTS + 1).count()
    known, short = None, sorted(r["kind"] for r in bench.filter("kind > 0").select("kind").distinct().collect())
    if count <= MAX_FINGERPRINTS:
        found = bench.select("fp", "kind").distinct().toPandas()
        known = {int(k): _Filter(g["fp"].to_numpy(np.int64).view(np.uint64)) for k, g in found.groupby("kind")}
    shared = spark.sparkContext.broadcast(known)

    def document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _document_rows(id_col, text_col, window, gram, short, shared.value)(batches)

    id_type = docs.schema[id_col].dataType.simpleString()
    hits = docs.select(id_col, text_col).mapInArrow(document_rows, f"_doc {id_type}, _row bigint, n_words bigint, fp bigint, kind int, pos bigint, ctx array<bigint>")
    right = bench.withColumnRenamed("fp", "_fp").withColumnRenamed("kind", "_kind")
    if count <= MAX_FINGERPRINTS // 20:
        right = F.broadcast(right)
    pairs = hits.join(right, (F.col("fp") == F.col("_fp")) & (F.col("kind") == F.col("_kind")), "left").drop("_fp", "_kind")
    runs = pairs.select("_doc", "_row", "n_words", "item_id", _extended(window, gram).alias("run"))
    by_doc = runs.groupBy("_doc", "_row").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("run").isNotNull(), F.col("item_id")))).alias("items"),
        F.sort_array(F.collect_set("run")).alias("runs"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    union = F.aggregate("runs", start, lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0).cast("bigint"), r["hi"] - F.greatest(r["lo"], acc["end"]))).alias("n"), F.greatest(acc["end"], r["hi"]).alias("end")))
    return by_doc.select(
        F.col("_doc").alias(id_col),
        "n_words",
        union["n"].alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((union["n"] > 0) & (min_share * union["n"] >= F.col("n_words"))).alias("contaminated"),
    )
