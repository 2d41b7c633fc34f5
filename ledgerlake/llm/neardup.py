"""Near-duplicate groups by min-max hashing.

A document is the set of its distinct 5-word shingles. Each of 80 permutations
gives two signature values, the least and the greatest, so 160 values cost 80
hash evaluations. Bands of four values from different permutations are the
bucket keys: at the threshold 0.75 a pair shares no band of 40 with
probability (1 - 0.75**4)**40 = 2.5e-7.

Documents with one and the same set are one class and go on as its least id.
In every bucket the document with the least id, likely the one that others were
copied from, is the leader. Pairs (leader, member) whose
signatures agree in half their values (7 deviations below the threshold) are
compared on full sets. Then links between members of different components are
looked for, so none is left out, while members of one component are never
paired with each other: buckets of up to 32 members pair them directly; members
of larger buckets meet on rare shingles instead. With the shingles of a set in
order of their frequency, sets of similarity t must share one among the first
n - ceil(t n) + 1 of the larger and the first n - ceil(2 t n / (1 + t)) + 1 of the
smaller set, so a passage or template that thousands share brings no pairs.

Inside, a document is known by a 64-bit hash of its id and text, so rows with
one id and different texts are different documents.

Defined results: null, empty and wordless texts have no shingles and are
linked with nothing; fewer than five words are one shingle; rows with equal
ids and equal texts are one document, and each is returned; rows with equal ids
and different texts are judged each for itself; a row with a null id is linked
like others, but never names a component that has another id (without one the
component is null); an empty table
gives no rows; a very long text is hashed in one piece of its task's memory;
only the id and text columns are read, whatever the others' names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.staging import join_small, materialize
from ledgerlake.llm import bytegrams as bg
from ledgerlake.llm.graph import components

SHINGLE, PERMUTATIONS, BANDS, ROWS = 5, 80, 40, 4
#: Ids that are broadcast at most (8 MB) to pick texts; beyond it, a shuffle join does.
MAX_IDS = 1_000_000
#: Members of a bucket whose components are paired directly at most.
SMALL_BUCKET = 32
#: Cells of the table of shingle frequencies (16 MB), and of a block of it; groups of tasks whose tables are added first.
CELLS, BLOCK_CELLS, SALTS = 1 << 22, 1 << 14, 32
_LOW52 = np.uint64((1 << 52) - 1)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = bg.mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32), (seeds[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles as text << 52 | hash, and their number per text."""
    words, before = bg.word_hashes(buf, offsets, bg.NOT_SPACE)
    counts = np.diff(before)
    grams = bg.gram_hashes(words, n)
    at = np.flatnonzero(bg.inside_text(before, n, len(grams)))
    text = np.searchsorted(before, at, "right") - 1
    keys = [text.astype(np.uint64) << np.uint64(52) | grams[at] >> np.uint64(12)]
    for k in range(1, n):
        few = np.flatnonzero(counts == k)
        if len(few):
            keys.append(few.astype(np.uint64) << np.uint64(52) | bg.gram_hashes(words, k)[before[few]] >> np.uint64(12))
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key, np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=len(counts))


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, width * (len(rows) + 1), width, dtype=np.int32)[: len(rows) + 1].tobytes()), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(column), -1)


def _signatures(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, mul = _permutations()
        for batch in batches:
            for lo, hi, buf, offsets in bg.text_chunks(batch.column("text")):
                key, counts = _sets(buf, offsets, n)
                full = np.flatnonzero(counts)
                sig = np.zeros((hi - lo, 2 * PERMUTATIONS), np.uint32)
                sums = np.zeros((2, hi - lo), np.uint64)
                if len(full):
                    starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                    h = key & _LOW52
                    sums[0, full] = np.add.reduceat(bg.mix(h), starts)
                    sums[1, full] = np.add.reduceat(bg.mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    x = (h >> np.uint64(20)).astype(np.uint32)
                    y = np.empty_like(x)
                    for j in range(PERMUTATIONS):
                        np.multiply(np.bitwise_xor(x, xor[j], out=y), mul[j], out=y)
                        sig[full, j] = np.minimum.reduceat(y, starts)
                        sig[full, PERMUTATIONS + j] = np.maximum.reduceat(y, starts)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("doc"), pa.array(counts.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), _binary(sig), _binary(sig.astype(np.uint8))], names=["id", "doc", "n", "s1", "s2", "sig", "low"])

    return rows


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    j = np.arange(BANDS)
    cols = np.stack([2 * j, 2 * j + 1, PERMUTATIONS + (2 * j + 2) % PERMUTATIONS, PERMUTATIONS + (2 * j + 3) % PERMUTATIONS])
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _matrix(batch.column("sig"), np.uint32).astype(np.uint64)
        a = sig[:, cols[0]] << np.uint64(32) | sig[:, cols[1]]
        b = sig[:, cols[2]] << np.uint64(32) | sig[:, cols[3]]
        band = bg.mix(bg.mix(a) * np.uint64(0x9E3779B97F4A7C15) + b + bg.mix(j.astype(np.uint64) + np.uint64(1))[None, :])
        row = pa.array(np.repeat(np.arange(len(sig)), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(band.ravel().view(np.int64)), batch.column("id").take(row), batch.column("rank").take(row)], names=["band", "id", "rank"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes allow the threshold and whose signatures agree in half their values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        same = (_matrix(batch.column("low_a"), np.uint8) == _matrix(batch.column("low_b"), np.uint8)).sum(axis=1)
        yield batch.select(["a", "b"]).filter(pa.array(same >= PERMUTATIONS))


def _set_rows(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for lo, hi, buf, offsets in bg.text_chunks(batch.column("text")):
                key, counts = _sets(buf, offsets, n)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 8
                values = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer((key & _LOW52).tobytes())])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), values], names=["id", "shingles"])

    return rows


def _packed(cells: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes]]:
    """Counts by cell, sorted, as one binary value of (cell, count) pairs for every block of cells that has any."""
    if not len(cells):
        return []
    block = cells // BLOCK_CELLS
    at = np.flatnonzero(np.diff(block, prepend=-1))
    pairs = np.stack([cells, counts], axis=1).astype(np.int32)
    return [(int(block[i]), pairs[i:j].tobytes()) for i, j in zip(at, [*at[1:], len(cells)], strict=True)]


def _shingle_counts(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        often = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, buf, offsets in bg.text_chunks(batch.column("text")):
                cell, times = np.unique((_sets(buf, offsets, n)[0] & _LOW52) & np.uint64(CELLS - 1), return_counts=True)
                often[cell.astype(np.int64)] += times
        cell = np.flatnonzero(often)
        blocks = _packed(cell, np.minimum(often[cell], 2**31 - 1))
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([salt] * len(blocks), pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names=["block", "salt", "counts"])

    return rows


def _sum_counts(table: pa.Table) -> pa.Table:
    """The counts of one block's cells, added up."""
    block = table.column("block")[0].as_py()
    often = np.zeros(BLOCK_CELLS, np.int64)
    for value in table.column("counts"):
        cell, times = np.frombuffer(value.as_buffer(), np.int32).reshape(-1, 2).T
        often[cell - block * BLOCK_CELLS] += times
    cell = np.flatnonzero(often)
    packed = _packed(cell + block * BLOCK_CELLS, np.minimum(often[cell], 2**31 - 1))
    return pa.table({"block": pa.array([b for b, _ in packed], pa.int32()), "counts": pa.array([c for _, c in packed], pa.binary())})


def _rare_rows(n: int, percent: int, shared):
    """The first shingles of every set in order of frequency, with their places, as far as the similarity needs them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for lo, hi, buf, offsets in bg.text_chunks(batch.column("text")):
                key, counts = _sets(buf, offsets, n)
                shingle, text = key & _LOW52, (key >> np.uint64(52)).astype(np.int64)
                times = often[(shingle & np.uint64(CELLS - 1)).astype(np.int64)]
                order = np.lexsort((shingle, times, text))
                place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
                size = np.repeat(counts, counts)
                keep = (place <= size - (percent * size + 99) // 100 + 1) & (times[order] > 1)
                which = pa.array(text[order][keep])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("id").take(which), part.column("comp").take(which), pa.array(size[keep]), pa.array(shingle[order][keep].view(np.int64)), pa.array(place[keep])], names=["id", "comp", "n", "shingle", "place"])

    return rows


def _confirmed(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return rows


def _rare_pairs(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a rare enough shingle for the similarity.

    texts: id, comp and text. Any common order of shingles finds every pair; frequencies
    are therefore counted in a table of fixed size, whose cells may be shared. It is the
    one thing that is collected.
    """
    counts = texts.mapInArrow(_shingle_counts(shingle), "block int, salt int, counts binary")
    counts = counts.groupBy("block", "salt").applyInArrow(_sum_counts, "block int, counts binary").groupBy("block").applyInArrow(_sum_counts, "block int, counts binary")
    often = np.zeros(CELLS, np.int32)
    for row in counts.collect():
        cell, times = np.frombuffer(row["counts"], np.int32).reshape(-1, 2).T
        often[cell] = times
    shared = texts.sparkSession.sparkContext.broadcast(often)
    head = texts.mapInArrow(_rare_rows(shingle, percent, shared), "id bigint, comp bigint, n bigint, shingle bigint, place bigint")
    head = materialize(head, "minmax-rare")
    less = head.filter(F.col("place") <= F.expr(f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")).select("shingle", F.col("id").alias("_id"), F.col("n").alias("_n"), F.col("comp").alias("_comp"), F.col("place").alias("_place"))
    near = (F.col("comp") != F.col("_comp")) & ((F.col("_n") < F.col("n")) | ((F.col("_n") == F.col("n")) & (F.col("_id") < F.col("id")))) & (100 * F.col("_n") >= percent * F.col("n"))
    # From the first shared shingle on, enough shingles must be left in both sets.
    near = near & ((100 + percent) * (F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place")) + 1) >= percent * (F.col("n") + F.col("_n")))
    return head.join(less, "shingle").filter(near).select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b"))


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 75) -> DataFrame:
    """Per row of docs: id (the hash of its id and text), doc (its id), n (shingles), comp (null without shingles), least (the
    component's least doc), and first: the hash of the one document that stands for the component."""
    given = docs.select(F.xxhash64(id_col, text_col).alias("id"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    doc_type = docs.schema[id_col].dataType.simpleString()
    every = materialize(given.mapInArrow(_signatures(shingle), f"id bigint, doc {doc_type}, n bigint, s1 bigint, s2 bigint, sig binary, low binary"), "minmax")
    # Ids that are no whole numbers have no order that would tell originals from copies.
    rank = F.col("doc").cast("bigint") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.xxhash64("doc")
    linked = every.filter("n > 0").withColumn("rank", rank)
    lead = F.coalesce(F.min_by("id", "rank"), F.min("id"))
    same_set = ["n", "s1", "s2"]
    classes = linked.groupBy(*same_set).agg(lead.alias("rep"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    copies = materialize(join_small(linked.select("id", *same_set), classes, same_set, "inner").groupBy("id", "rep").agg(F.count("*").alias("rows")), "minmax-classes")
    again = copies.filter("id = rep and rows > 1").select("id")
    repeats = not copies.filter("rows > 1").isEmpty()
    heads = join_small(linked, copies.filter("id <> rep or rows > 1").select("id"), "id", "left_anti").select("id", "rank", "n", "sig", "low")
    if repeats:
        heads = heads.union(join_small(linked, again, "id", "left_semi").dropDuplicates(["id"]).select("id", "rank", "n", "sig", "low"))
    heads = materialize(heads, "minmax-heads")

    bands = heads.select("id", "rank", "sig").mapInArrow(_bands, "band bigint, id bigint, rank bigint")
    leaders = bands.groupBy("band").agg(lead.alias("leader"), F.count("*").alias("members")).filter("members > 1").select(F.col("band").alias("_band"), "leader", "members")
    met = materialize(bands.join(leaders, F.col("band") == F.col("_band")).filter("id <> leader").select("band", "leader", "members", "id"), "minmax-buckets")

    def alike(pairs: DataFrame) -> DataFrame:
        left = heads.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("low").alias("low_a"))
        right = heads.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("low").alias("low_b"))
        rows = pairs.join(left, "a").join(right, "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        return materialize(rows.select("a", "b", "low_a", "low_b").mapInArrow(_alike, "a bigint, b bigint"), "minmax-alike")

    def pick_texts(ids: DataFrame) -> DataFrame:
        side = F.broadcast(ids) if ids.count() <= MAX_IDS else ids
        found = given.select("id", "text").join(side, "id")
        return found.dropDuplicates(["id"]) if repeats else found

    def confirm(pairs: DataFrame) -> DataFrame:
        wanted = materialize(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("id")), "minmax-wanted")
        sets = pick_texts(wanted).mapInArrow(_set_rows(shingle), "id bigint, shingles binary")
        first = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
        both = first.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
        return materialize(both.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a bigint, b bigint").distinct(), "minmax-links")

    stars = met.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = confirm(alike(stars))
    comps = materialize(components(links), "minmax-components")
    own = lambda df, c: df.join(comps.select(F.col("id").alias("_c"), "comp"), F.col(c) == F.col("_c"), "left").withColumn(f"comp_{c}", F.coalesce("comp", c)).drop("_c", "comp")
    apart = own(own(met.join(links.select(F.col("a").alias("leader"), F.col("b").alias("id")), ["leader", "id"], "left_anti"), "id"), "leader").filter("comp_id <> comp_leader")
    apart = materialize(apart.select("band", "members", "id", "comp_id"), "minmax-apart")
    few = apart.filter(F.col("members") <= SMALL_BUCKET)
    others = own(met.join(few.select("band").distinct(), "band", "left_semi").select("band", "id"), "id")
    direct = few.join(others.select(F.col("band").alias("_b"), F.col("id").alias("other"), F.col("comp_id").alias("comp_other")), (F.col("band") == F.col("_b")) & (F.col("comp_id") != F.col("comp_other")))
    direct = direct.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    crowded = met.join(apart.filter(F.col("members") > SMALL_BUCKET).select("band").distinct(), "band", "left_semi")
    crowded = materialize(own(crowded.select("id").union(crowded.select("leader")).distinct(), "id").select("id", F.col("comp_id").alias("comp")), "minmax-crowded")
    cross = direct.union(_rare_pairs(pick_texts(crowded).select("id", "comp", "text"), shingle, percent)).distinct()
    links = links.union(confirm(alike(cross)))
    comps = materialize(components(links), "minmax-components")

    rows = every.select("id", "doc", "n").join(copies.filter("id <> rep").select("id", "rep"), "id", "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "id")))
    rows = rows.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    rows = materialize(rows.select("id", "doc", "n", "comp"), "minmax-rows")
    # Components of one row name themselves; so only those of more rows are looked up.
    names = rows.filter("comp is not null").groupBy("comp").agg(F.min("doc").alias("least"), F.min(F.struct(F.col("doc").isNull().alias("u"), "doc", "id")).alias("first"), F.count("*").alias("_c")).filter("_c > 1")
    named = join_small(rows, names.select("comp", "least", F.col("first.id").alias("first"), F.lit(True).alias("_many")), "comp", "left")
    return named.select("id", "doc", "n", "comp", F.when(F.col("_many"), F.col("least")).otherwise(F.col("doc")).alias("least"), F.coalesce("first", "id").alias("first"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 75) -> DataFrame:
    """Per row of docs: its id, n_shingles, component_id (the least id that it reaches) and kept (it is that id)."""
    rows = grouped(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent)
    return rows.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("least").eqNullSafe(F.col("doc")).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns kept, less all but one of each near-duplicate group.

    The document with the least id stays (a null id comes last; of equal ids with
    different texts, the one with the least hash); of rows alike in id and text,
    the one whose columns have the least hash. Texts without shingles all stay.
    """
    found = materialize(grouped(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent), "minmax-grouped")
    rows = docs.select(F.xxhash64(id_col, text_col).alias("id"), F.struct("*").alias("row"))
    rest = join_small(rows, found.filter("n > 0 and id <> first").select("id").distinct(), "id", "left_anti")
    again = materialize(found.filter("n > 0 and id = first").groupBy("id").agg(F.count("*").alias("_c")).filter("_c > 1").select("id"), "minmax-again")
    if not again.isEmpty():
        one = join_small(rest, again, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        rest = join_small(rest, again, "id", "left_anti").unionByName(one)
    return rest.select("row.*")
