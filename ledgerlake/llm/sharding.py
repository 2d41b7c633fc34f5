"""Sharding by histogram sort.

Rows are ordered by (key of the text, key of the id), so equal texts stand
together. For every boundary between shards, exact bytes below candidate keys
are counted over all partitions; the interval that holds the wanted byte
position is probed again at finer keys, until the bytes in it are within the
tolerance. Probing goes through the bits of the text key first: a group of
equal texts stays whole unless it alone outweighs the tolerance, and then the
bits of the id key split it. Rows move once, after the splitters are known.

The exchanges that give slots come after that: rows are numbered inside
buckets of keys, and the buckets' counts are summed.

Law `bytes`: a splitter misses its byte position by the tolerance (1 % of a
shard) or the largest row there, whichever is more, so a shard's size differs
from the mean by twice that at most: on small tables, where one text is
several per cent of a shard, by several per cent. Null text has size 1 and the crc of the empty
text. A null doc_id shares the key of the text "null", which only decides its place
among equal texts. Rows alike in text and id can't be told apart and stay
together. A very long text is one row of its size. An empty table gives no
rows. Only the id and text columns are read, so clashing names don't matter.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.staging import MAX_BROADCAST_ROWS, materialize, running_total

BITS, STEP = 60, 10
ROWS_PER_BUCKET = 4096


def _key(c: Column) -> Column:
    """The first 60 bits of a hash."""
    return F.conv(F.substring(F.md5(c), 1, BITS // 4), 16, 10).cast("bigint")


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*more, F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), _key(text).alias("k1"), _key(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("k2"))


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The keys (k1, k2) from which shards 1, 2, ... begin. At most shards * 2**STEP counts reach the driver at once."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slack = tolerance * total / shards
    found: list[tuple[int, int] | None] = [None] * (shards - 1)
    # An open boundary: the prefix of 2 * BITS bits that holds it, and the bytes below that prefix.
    open_: dict[int, tuple[int, int]] = {k: (0, 0) for k in range(1, shards)} if total else {}
    depth = 0
    while open_ and depth < 2 * BITS:
        depth += STEP
        key, used = ("k1", depth) if depth <= BITS else ("k2", depth - BITS)
        inside = sorted({p for p, _ in open_.values()})
        part = F.shiftright(key, BITS - used)
        if depth == STEP:
            near = rows
        elif depth <= BITS:
            near = rows.filter(F.shiftright("k1", BITS - used + STEP).isin(inside))
        else:
            whole = F.struct(F.col("k1"), F.shiftright("k2", BITS - used + STEP).alias("k2"))
            near = rows.filter(F.col("k1").isin(sorted({p >> (used - STEP) for p in inside}))).filter(whole.isin(*[F.struct(F.lit(p >> (used - STEP)).cast("bigint"), F.lit(p & ((1 << (used - STEP)) - 1)).cast("bigint")) for p in inside]))
        by = near.groupBy("k1", part.alias("p")) if depth > BITS else near.groupBy(part.alias("p"))
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in by.agg(F.sum("size").alias("bytes")).collect():
            prefix = (r["k1"] << used | r["p"]) if depth > BITS else r["p"]
            counts.setdefault(prefix >> STEP, []).append((prefix, r["bytes"]))
        still = {}
        for k, (prefix, below) in open_.items():
            want = k * total / shards
            cells = sorted(counts[prefix])
            ends = list(accumulate((b for _, b in cells), initial=below))
            i = next((i for i in range(len(cells)) if ends[i + 1] >= want), len(cells) - 1)
            if cells[i][1] <= slack or depth == 2 * BITS:
                first = cells[i][0] if want - ends[i] <= ends[i + 1] - want else cells[i][0] + 1
                found[k - 1] = (first << (BITS - used), 0) if depth <= BITS else (first >> used, (first & ((1 << used) - 1)) << (BITS - used))
            else:
                still[k] = (cells[i][0], ends[i])
        open_ = still
    return [f if f else (1 << BITS, 0) for f in found]


def shard_of(cuts: list[tuple[int, int]]) -> Column:
    """How many splitters are not above the row's key."""
    if not cuts:
        return F.lit(0)
    at = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in cuts])
    return F.size(F.filter(at, lambda s: (s["a"] < F.col("k1")) | ((s["a"] == F.col("k1")) & (s["b"] <= F.col("k2")))))


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, tolerance: float = 0.01, carry: list[str] | None = None) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot (place in the shard) and grown_shard (null under this law).

    `carry` names columns of docs that move with their rows and follow; a name
    that one of the columns above has gets an underscore.
    """
    keys = materialize(keyed(docs, id_col, text_col), "shard-keys")
    n = keys.count()
    cuts = splitters(keys, shards, tolerance)
    bits = max(0, (n // ROWS_PER_BUCKET).bit_length())
    b1 = F.shiftright("k1", BITS - bits) if bits else F.lit(0).cast("bigint")
    # A bucket that a large group of copies fills is cut up by the id key too.
    heavy = materialize(keys.groupBy(b1.alias("_b1")).agg(F.count("*").alias("_n")).filter(F.col("_n") > 4 * ROWS_PER_BUCKET).select("_b1"), "shard-heavy")
    if heavy.count() <= MAX_BROADCAST_ROWS:
        heavy = F.broadcast(heavy)

    def placed(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("shard", shard_of(cuts)).withColumn("b1", b1).join(heavy, F.col("b1") == F.col("_b1"), "left")
        fine = F.when(F.col("_b1").isNull(), F.struct(F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("b2"))).otherwise(F.struct(F.col("k1"), (F.shiftright("k2", BITS - bits) if bits else F.lit(0)).cast("bigint").alias("b2")))
        return found.withColumn("bucket", F.struct("b1", fine.alias("fine"))).withColumn("one", F.lit(1).cast("bigint"))

    order = [F.col("k1"), F.col("k2"), F.col("_id")]
    if carry is None:
        slots, more = running_total(placed(keys), ["shard"], "bucket", order, F.col("one"), "slot"), []
    else:  # the rows themselves move once, by bucket; their number below each bucket is counted on the keys
        whole = docs.select(F.struct("*").alias("row")).select(F.col(f"row.`{id_col}`").alias("_own"), F.col(f"row.`{text_col}`").alias("_text"), F.struct(*[F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried"))
        rows = keyed(whole, "_own", "_text", "carried")
        slots = running_total(placed(rows), ["shard"], "bucket", order, F.col("one"), "slot", sums_of=placed(keys))
        taken = {id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
        more = [F.col(f"carried.c{i}").alias(f"{c}_" if c in taken else c) for i, c in enumerate(carry)]
    return slots.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *more)
