"""Joins on hot keys, places in groups of any size, and hashes of byte streams that are too long for one row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlake.functions.staging import materialize

#: A key is hot with more than 1 / HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys; their rows go to SALTS places.
HOT_SHARE, SALTS = 4096, 64


def hot_keys(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The keys with more than a 4096th of `rows` rows: fewer than 4096."""
    return df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > rows / HOT_SHARE).select(*keys)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: Column, how: str = "left") -> DataFrame:
    """Joins left with right, which has one row a key at most; rows of left with a hot key are dealt to 64 places by the hash of `spread`.

    Only hot keys are broadcast, and only their rows of right are repeated.
    """
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    marked = lambda df: df.join(mark, keys, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    return salted_join(marked(left), marked(right), keys, spread, how)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """The same where both sides know by a column _hot which of their keys are hot."""
    dealt = left.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


#: Rows of few columns (8 MB at most) that are broadcast instead of dealt out by a join.
MAX_SIDE = 100_000


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds pos, the place of a row among those of its key, nulls first, from 0; rows are sorted over all tasks, so a key of any size is dealt out."""
    sorted_ = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    kept = materialize(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), name)
    runs = kept.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = runs.select(key, "_part", "_first", (F.sum("_n").over(W.partitionBy(key).orderBy("_part")) - F.col("_n")).alias("_before"))
    return kept.join(before, [key, "_part"]).withColumn("pos", F.col("_before") + F.col("_seq") - F.col("_first")).drop("_part", "_seq", "_first", "_before")


def streamed_sha256(parts: DataFrame, key: str, order: str, part: str, separator: bytes, out: str) -> DataFrame:
    """Per key, the lowercase SHA-256 of its parts in order with a separator between them.

    A digest is one chain, so the parts of a key pass through one task, but
    one batch at a time. Give it parts of many rows each, of keys that have
    more than one part; the rest is cheaper in SQL.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest is None or k != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = k, hashlib.sha256()
                else:
                    digest.update(separator)
                digest.update(text.as_py().encode())
            if done:
                yield pa.RecordBatch.from_pylist([{key: k, out: v} for k, v in done], schema=schema(batch))
            last = batch
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{key: now, out: digest.hexdigest()}], schema=schema(last))

    def schema(batch: pa.RecordBatch) -> pa.Schema:
        return pa.schema([(key, batch.schema.field(0).type), (out, pa.string())])

    rows = parts.repartition(F.col(key)).sortWithinPartitions(key, order).select(key, part)
    return rows.mapInArrow(digests, f"{key} {parts.schema[key].dataType.simpleString()}, {out} string")
