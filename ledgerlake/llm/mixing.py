"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix draws the golden-ratio point frac(i * phi) and takes the
source whose share of the cumulated targets holds that point, so each source's
slots are spread evenly and their number stays within a few of its share. The
slots of a source are ranked; its documents, shuffled by a hash of their id,
lie end to end on a line of words that repeats up to `max_repeat` times; the
line is cut into blocks of equal word counts; slot rank k takes block k.

Defined results: null text has size 0 and is never taken; a null source is a
source of its own, last in order; rows with equal ids are separate documents;
an empty table gives no rows; if all sizes are 0, targets and takings are 0;
documents of equal hashes lie in order of id, size and text; a very long text is
one document of its size; only the id, text and source columns are read, so
clashing names don't matter. One row per source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlake.functions.staging import join_small, materialize, running_total

#: 2**32 / golden ratio, odd: i * PHI mod 2**32 is the i-th point, in exact integers.
PHI = 2654435769
#: Words in a block at most, unless the mix would need over MAX_SLOTS; and slots at least, so that small sources get near their targets too.
BLOCK, LEAST_SLOTS, MAX_SLOTS = 256, 1 << 17, 1 << 30
ROWS_PER_BUCKET = 1024
#: The points are joined to sources by equal parts of their range.
PARTS = 4096


def words(text: str) -> Column:
    """How many runs of bytes other than white space a text has."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def block_words(total: int) -> int:
    return max(min(BLOCK, total // LEAST_SLOTS), -(-total // MAX_SLOTS), 1)


def targets(sizes: DataFrame, max_repeat: int = 3) -> DataFrame:
    """src, source_size -> sid (its place in code-point order, null last), weight 1, 2, 3, 1, ... and target.

    The fixed point of capping and resharing is target = min(cap, level * weight):
    in order of cap / weight, sources are capped until one fits under the level
    that the rest would get. One row per source meets in these windows.
    """
    rows = sizes.withColumn("sid", F.row_number().over(W.orderBy(F.col("src").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", (F.col("sid") % 3 + 1).cast("bigint")).withColumn("cap", max_repeat * F.col("source_size"))
    by_level, whole = W.orderBy(F.col("cap") / F.col("weight"), "sid"), W.partitionBy()
    rows = rows.withColumn("left_words", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("left_weight", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    fits = F.col("left_words") * F.col("weight") <= F.col("cap") * F.col("left_weight")
    first = F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("r"), "sid", (F.col("left_words") / F.col("left_weight")).alias("level")))).over(whole)
    rows = rows.withColumn("level", first["level"])
    return rows.select("src", "sid", "source_size", "weight", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def schedule(spark, aims: DataFrame, total: int, block: int) -> DataFrame:
    """slot, sid and rank of the slot among its source's slots, for ceil(total / block) slots."""
    n = -(-total // block)
    cum = F.sum("goal").over(W.orderBy("sid"))
    goals = aims.select("sid", F.round("target").cast("bigint").alias("goal"))
    edges = goals.select("sid", "goal", cum.alias("upto"), F.sum("goal").over(W.partitionBy()).alias("all"))
    edge = lambda c: F.floor(c / F.col("all") * float(1 << 32)).cast("bigint")
    shares = edges.filter("goal > 0").select("sid", edge(F.col("upto") - F.col("goal")).alias("lo"), edge(F.col("upto")).alias("hi"))
    width = (1 << 32) // PARTS
    shares = shares.filter("hi > lo").withColumn("part", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    points = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") * PHI) % (1 << 32)).alias("point")).withColumn("part", F.floor(F.col("point") / width))
    dealt = points.join(shares, "part").filter("point >= lo and point < hi").select("slot", "sid", F.floor(F.col("slot") / ROWS_PER_BUCKET).alias("bucket"), F.lit(1).cast("bigint").alias("one"))
    return running_total(dealt, ["sid"], "bucket", [F.col("slot")], F.col("one"), "rank").select("slot", "sid", "rank")


def _key(id_col: str, text_col: str, source_col: str) -> Column:
    """Tells rows apart whose ids are equal, null or read alike."""
    return F.xxhash64(id_col, text_col, source_col)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeat: int = 3) -> DataFrame:
    """Per row of docs: its id, size, source_size, target and taken (the words that the mix takes of it, repeats counted)."""
    return _taken(docs, id_col, text_col, source_col, max_repeat).select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, max_repeat: int) -> DataFrame:
    """The rows of mix, with the rows' keys."""
    spark = docs.sparkSession
    sized = docs.select(_key(id_col, text_col, source_col).alias("k"), F.col(id_col).alias("_id"), F.col(source_col).alias("src"), words(text_col).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("hash"))
    sized = materialize(sized, "mix-sizes")
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = block_words(total)
    aims = materialize(targets(sized.groupBy("src").agg(F.sum("size").cast("bigint").alias("source_size")), max_repeat), "mix-targets")
    slots = materialize(schedule(spark, aims, total, block), "mix-slots")
    drawn = slots.groupBy("sid").agg(F.count("*").alias("slots"))
    known = aims.join(drawn, "sid", "left").select(F.col("src").alias("_src"), "sid", "source_size", "target", (F.coalesce("slots", F.lit(0)) * block).alias("drawn"))
    rows = sized.join(known, F.col("src").eqNullSafe(F.col("_src"))).drop("src", "_src")
    buckets = max(1, n // ROWS_PER_BUCKET)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32)))
    line = running_total(rows, ["sid"], "bucket", [F.col("hash"), F.col("_id"), F.col("size"), F.col("k")], F.col("size"), "start")
    # Each pass over the source's line, as far as its slots reach; then the blocks that the document touches on it.
    passes = F.explode_outer(F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeat - 1)), lambda r: F.col("start") + r.cast("bigint") * F.col("source_size")), lambda at: (at < F.col("drawn")) & (F.col("size") > 0)))
    laid = line.withColumn("at", passes)
    touched = F.explode_outer(F.when(F.col("at").isNotNull(), F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    pieces = laid.withColumn("block", touched)
    taken = pieces.join(slots.select(F.col("sid").alias("_sid"), F.col("rank").alias("_rank")), (F.col("sid") == F.col("_sid")) & (F.col("block") == F.col("_rank")), "left")
    share = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)
    by_row = taken.groupBy("sid", "start", "_id", "k", "hash", "size", "source_size", "target").agg(F.coalesce(F.sum(F.when(F.col("_rank").isNotNull(), share)), F.lit(0)).alias("taken"), F.countDistinct("at", "block").alias("_n"), F.count("*").alias("_rows"))
    # Rows alike in id and place are only those of size 0: they count one for one.
    copies = F.explode(F.when(F.col("size") == 0, F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))).otherwise(F.array(F.lit(1).cast("bigint"))))
    return by_row.withColumn("_copy", copies).select("k", "_id", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeat: int = 3) -> DataFrame:
    """docs repeated as often as the mix takes them whole; a last pass counts if it takes at least half of the words.

    Rows are known by a hash of id, text and source, so null, repeated and like-reading ids are told apart.
    """
    took = _taken(docs, id_col, text_col, source_col, max_repeat)
    times = took.groupBy("k").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("times")).filter("times >= 0.5")
    rows = join_small(docs.select(_key(id_col, text_col, source_col).alias("k"), F.struct("*").alias("row")), times, "k", "inner")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.floor(F.col("times") + 0.5).cast("int")))).select("row.*")


#: The same rows in SQL: `taken` follows from the number of slots that each source draws.
ORACLE = """
with d as (select doc_id, source, md5(cast(doc_id as varchar)) as hash, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as sid from d group by source),
w as (select *, sid % 3 + 1 as weight, 3 * source_size as cap from s),
o as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0) as left_words,
      sum(weight) over (order by cap / weight, sid rows between current row and unbounded following) as left_weight from w),
l as (select cast(left_words as double) / cast(left_weight as double) as level from o where left_words * weight <= cap * left_weight order by cap / weight, sid limit 1),
t as (select o.source, o.sid, o.source_size, least(cast(cap as double), level * weight) as target from o cross join l),
g as (select *, sum(cast(round(target) as bigint)) over (order by sid) as upto, cast(round(target) as bigint) as goal, sum(cast(round(target) as bigint)) over () as whole from t),
e as (select *, cast(floor(cast(upto - goal as double) / cast(whole as double) * 4294967296.0) as bigint) as lo, cast(floor(cast(upto as double) / cast(whole as double) * 4294967296.0) as bigint) as hi from g),
z as (select sum(size) as total, greatest(least(256, sum(size) // 131072), 1) as block from d),
p as (select (i * 2654435769) % 4294967296 as point from (select unnest(range(cast((total + block - 1) // block as bigint))) as i from z)),
n as (select e.sid, count(p.point) as slots from e left join p on p.point >= e.lo and p.point < e.hi group by e.sid),
a as (select d.doc_id, d.size, e.source_size, e.target, n.slots * z.block as drawn,
      coalesce(sum(d.size) over (partition by e.sid order by d.hash, d.doc_id rows between unbounded preceding and 1 preceding), 0) as start
      from d join e on d.source is not distinct from e.source join n on n.sid = e.sid cross join z)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(greatest(0, least(size, drawn - start)) + greatest(0, least(size, drawn - start - source_size)) + greatest(0, least(size, drawn - start - 2 * source_size)) as bigint) as taken
from a
"""
