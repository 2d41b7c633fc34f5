"""Near-duplicate groups by SimHash fingerprints and pigeonring filtering.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half the
XXH64 hashes of the text's 3-word shingles, repeats included. Two fingerprints
link at 3 or fewer differing bits.

The bits are a ring of four segments of 16. If two fingerprints differ in 3 bits
or fewer, then by the pigeonring principle some segment begins a chain whose
cumulative differences stay within the proportional budget all the way round:
at most 3/4, 6/4, 9/4 and 3, that is 0, 1, 2 and 3 bits after one, two, three and
four segments. The first two steps are the cells in which candidates meet: a
fingerprint enters, for each start, the cell of its two segments and the 16
cells in which one bit of the second is flipped, 68 in all. Cells in which
nobody stands unflipped are dropped. The third step prunes what met; only then
comes the full Hamming check.

Exact copies share a fingerprint and go on as one. In each cell the least and
the greatest unflipped fingerprint are compared with every member, which joins
clouds of near copies. Then only members of different components are compared:
in cells of up to 32 members directly, in others after they have been split by
the third segment, again with up to one flipped bit on either side. So no group
of near copies is paired among itself, and no link between components is lost.

Defined results: null, empty and wordless texts have fingerprint zero and are
linked like others; fewer than three words are one shingle; each row is
returned, repeated ids and texts too; a null id never names a component that has
another id; an empty table gives no rows; a text is hashed whole, a block of
shingles at a time; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.staging import materialize
from ledgerlake.llm.graph import components
from ledgerlake.llm.skew import HOT_SHARE, hot_keys, spread_join

SHINGLE, SEED, SEGMENT, DISTANCE = 3, 42, 16, 3
#: Differing bits that a chain of 1, 2, 3 and 4 segments may have.
BUDGET = [length * DISTANCE * SEGMENT // 64 for length in range(1, 5)]
#: Members of a cell that are compared directly at most.
SMALL_CELL = 32
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \\x20\\x09-\\x0d only
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first[lo : lo + BLOCK], last[lo : lo + BLOCK], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return rows


def _turned(fp: str, i: str) -> str:
    """SQL of the fingerprint turned so that segment i is the lowest."""
    return f"(shiftrightunsigned({fp}, {SEGMENT} * {i}) | shiftleft({fp}, 64 - {SEGMENT} * {i}))"


def cells(fps: DataFrame) -> DataFrame:
    """(fp) -> (cell, start, fp, own): the cells of the first two steps of each chain; own where nothing is flipped."""
    flips = ", ".join(["0L", *(f"{1 << b}L" for b in range(SEGMENT, 2 * SEGMENT))])
    every = fps.selectExpr("fp", "explode(sequence(0, 3)) as start").selectExpr("fp", "start", f"{_turned('fp', 'start')} & 4294967295L as two", f"explode(array({flips})) as flip")
    return every.selectExpr("shiftleft(cast(start as bigint), 32) | (two ^ flip) as cell", "start", "fp", "flip = 0 as own")


def within_budget(a: str, b: str, start: str) -> str:
    """SQL: the chain from `start` stays within its budget for every length, and so does the whole ring."""
    differ = _turned(f"({a} ^ {b})", start)
    return " and ".join(f"bit_count({differ} & {(1 << SEGMENT * length) - 1}L) <= {BUDGET[length - 1]}" for length in (1, 2, 3)) + f" and bit_count({a} ^ {b}) <= {BUDGET[3]}"


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b): links that connect exactly what links of 3 or fewer differing bits connect."""
    every = cells(fps)
    lead = every.groupBy("cell").agg(F.min(F.when(F.col("own"), F.col("fp"))).alias("low"), F.max(F.when(F.col("own"), F.col("fp"))).alias("high"), F.count("*").alias("members"))
    met = materialize(every.join(lead.filter("low is not null and members > 1"), "cell"), "ring-cells")
    near = met.withColumn("lead", F.explode(F.array_distinct(F.array("low", "high")))).filter("fp <> lead").filter(within_budget("fp", "lead", "start"))
    stars = materialize(near.select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b")).distinct(), "ring-stars")
    comps = materialize(components(stars), "ring-components")

    open_ = met.filter("members > 2").join(comps.select(F.col("id").alias("fp"), "comp"), "fp", "left").select("cell", "start", "fp", "own", "members", F.coalesce("comp", "fp").alias("comp"))
    mixed = open_.groupBy("cell").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo <> _hi").select("cell")
    open_ = materialize(open_.join(mixed, "cell", "left_semi"), "ring-open")

    def across(side: DataFrame, keys: list[str]) -> DataFrame:
        """Pairs of different components that share the keys and pass the chain; one of them stands in the cell unflipped."""
        other = side.select(*keys, F.col("fp").alias("_fp"), F.col("comp").alias("_comp"), F.col("own").alias("_own"))
        pairs = side.filter("own").join(other, keys).filter("comp <> _comp and (not _own or fp < _fp)").filter(within_budget("fp", "_fp", "start"))
        return pairs.select(F.least("fp", "_fp").alias("a"), F.greatest("fp", "_fp").alias("b"))

    third = ", ".join(["0L", *(f"{1 << b}L" for b in range(2 * SEGMENT, 3 * SEGMENT))])
    split = open_.filter(F.col("members") > SMALL_CELL).withColumn("flip", F.explode(F.expr(f"array({third})"))).withColumn("sub", F.expr(f"({_turned('fp', 'start')} & {(1 << 48) - 1}L) >> 32 ^ (flip >> 32)"))
    found = across(open_.filter(F.col("members") <= SMALL_CELL), ["cell"]).union(across(split, ["cell", "sub"]))
    return materialize(stars.union(found.distinct()), "ring-links")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs: its id, the fingerprint in hexadecimal, and component_id (the least id that it reaches)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(id_col, text_col).mapInArrow(_fingerprints(shingle), f"id {id_type}, fp bigint")
    given = materialize(given, "ring-fingerprints")
    classes = materialize(given.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "ring-classes")
    comps = components(links(classes.select("fp"))).withColumnRenamed("id", "fp")
    # Classes without a link and a copy need no name but their own id.
    named = classes.join(comps, "fp", "left").withColumn("many", F.col("comp").isNotNull()).withColumn("comp", F.coalesce("comp", "fp")).filter("many or rows > 1")
    named = materialize(named.select("fp", "comp", "least"), "ring-named")
    least = named.groupBy("comp").agg(F.min("least").alias("component"))
    total = classes.agg(F.sum("rows")).first()[0] or 0
    hot = classes.filter(F.col("rows") > total / HOT_SHARE).select("fp")
    giant = materialize(hot_keys(named, ["comp"], max(1, named.count())), "ring-giant")
    names = spread_join(named.select("fp", "comp"), least, ["comp"], giant, F.col("fp"), "inner").select("fp", "component")
    rows = spread_join(given, names, ["fp"], hot, F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "id").alias("component_id"))
