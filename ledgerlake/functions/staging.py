"""Written intermediate tables and prefix sums that several operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Where the session names none, a local master works in the driver's own
    temporary folder; on a cluster that would be each machine's own disk, so
    there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the cluster's own clean-up takes the folder
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and a lost executor costs only a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str, sums_of: DataFrame | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the group that come before this row.

    `bucket` must be a column that rises with `order` inside a group; only one
    bucket's rows meet in a task, and only one row per bucket meets in the
    window over a group, so a group that holds most rows is still dealt out.
    `sums_of` has the same rows in a form that is cheaper to sum up.
    """
    # One struct of the keys serves grouping, window and join, nulls included, so the rows are exchanged once.
    key = F.struct(*[F.col(k) for k in [*group, bucket]])
    sums = (df if sums_of is None else sums_of).withColumn("_key", key).groupBy("_key").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*[F.col("_key")[k] for k in group]).orderBy(F.col("_key")[bucket]).rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(F.col("_key").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_key").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_key", key).withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(base, F.col("_key") == F.col("_of")).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in", "_key", "_of")


#: Rows of (id, small value) that are broadcast at most; a larger side is joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000


def join_small(df: DataFrame, side: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """Joins df with a side of few columns on its column or columns `key`, broadcast only if its counted rows are within the bound."""
    side = materialize(side, "side")
    if side.count() <= MAX_BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, key, how)

