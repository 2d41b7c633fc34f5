"""The scan over newly arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ledgerlake.operators.privacy import MAX_TEXT_BYTES, scan, scan_bytes
from ledgerlake.sources.readers import MAX_READ, arriving_files


def scan_stream(files: DataFrame, globs: list[str] | None = None) -> DataStreamWriter:
    """A stream of (path, text), or of (path, length, content), as a stream of findings: each arriving file is scanned once.

    The scan keeps no state, so no watermark is needed.
    """
    found = scan_bytes(files, globs) if "content" in files.columns else scan(files, globs)
    return found.writeStream.outputMode("append").trigger(availableNow=True)


def scan_arrivals(spark: SparkSession, folder: str, target: str, checkpoint: str, globs: list[str] | None = None, max_bytes: int = MAX_TEXT_BYTES, max_read: int = MAX_READ) -> StreamingQuery:
    """Scans the files that came into a folder since the last run with this checkpoint, and appends their findings to a table of Parquet files.

    The checkpoint knows the files of every batch, and the table's manifest the batches
    that it holds: a batch that broke before it was committed runs again with the
    same files, and adds nothing twice.
    """
    found = scan_bytes(arriving_files(spark, folder, max_read), globs, max_bytes)
    return found.writeStream.outputMode("append").trigger(availableNow=True).format("parquet").option("path", target).option("checkpointLocation", checkpoint).start()
