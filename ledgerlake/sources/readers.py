"""Readers and writers: text lines, rate records, attested balances, ledgers, and CSV that spreadsheets open safely."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

SCHEMA_VERSION = "1.3"
#: The status of a ledger that is done, and all that may be used.
READY, USABLE = "ready", ("ready", "accepted-after-review")
#: Texts with fewer characters hold too little to read.
LEAST_CHARS = 40

LEDGER_SCHEMA = T.StructType([
    T.StructField("filer_id", T.LongType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("tax_year", T.IntegerType()),
    T.StructField("date", T.DateType()),
    T.StructField("native_balance", T.DecimalType(24, 6)),
    T.StructField("balance_source", T.StringType()),
    T.StructField("evidence_class", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("source_ref", T.StringType()),
    T.StructField("review_flags", T.ArrayType(T.StringType())),
    T.StructField("schema_version", T.StringType()),
    T.StructField("status", T.StringType()),
])


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", number_blanks: bool = True) -> DataFrame:
    """Numbered lines with white space collapsed and empty ones left out; blank lines take a number or don't."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\r\n|\n|\r")).alias("pos", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("raw", r"\s+", " "))).filter("line <> ''")
    if number_blanks:
        return lines.select(id_col, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    return lines.select(id_col, F.row_number().over(W.partitionBy(id_col).orderBy("pos")).cast("bigint").alias("line_no"), "line")


def file_profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: lines, characters, bytes, SHA-256, and whether it has too little text to read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    filled = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""))
    chars = F.length(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return docs.select(id_col, filled.cast("bigint").alias("lines"), F.length(text).cast("bigint").alias("chars"), F.octet_length(text).cast("bigint").alias("bytes"), F.sha2(text, 256).alias("content_sha256"), (chars < LEAST_CHARS).alias("low_text"))


#: Folders of tools, whose files are never read.
SKIPPED_DIRS = (".git", ".git-rewrite", ".hg", ".svn", ".mypy_cache", ".pytest_cache", ".ruff_cache", "__pycache__", ".venv", "venv", "env", "node_modules", "coverage", "htmlcov")
#: Files of more bytes are listed but not read.
MAX_READ = 64 << 20


def _as_files(listed, folder: str, spark: SparkSession, max_read: int) -> DataFrame:
    """(path below folder, length, content) of what `listed()` finds; two scans, so that the length prunes files before their content is read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    shown = F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path")).alias("path")
    short = listed().filter(F.col("length") <= max_read).select(shown, "length", "content")
    long_ = listed().filter(F.col("length") > max_read).select(shown, "length", F.lit(None).cast("binary").alias("content"))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return short.union(long_).filter(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_DIRS))))


def read_files(spark: SparkSession, folder: str, max_read: int = MAX_READ) -> DataFrame:
    """The files of a folder and its folders, as bytes: (path, length, content), content null beyond max_read bytes.

    Spark's file sources don't list empty files, nor names that begin with a dot or an underscore.
    """
    return _as_files(lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder), folder, spark, max_read)


def arriving_files(spark: SparkSession, folder: str, max_read: int = MAX_READ) -> DataFrame:
    """The same as a stream of files that are new to its checkpoint."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _as_files(lambda: spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder), folder, spark, max_read)


def profile_files(files: DataFrame) -> DataFrame:
    """Per file of (path, length, content): bytes, SHA-256, and lines, characters and low_text of its text, bytes that are not UTF-8 replaced."""
    text = F.expr("make_valid_utf8(cast(content as string))")
    rows = file_profile(files.select("path", text.alias("text")), "path").drop("bytes", "content_sha256")
    own = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_sha256"))
    return own.join(rows, "path")


def read_rate_records(spark: SparkSession, path: str) -> DataFrame:
    """Rate rows of JSON payloads {"data": [...]}; entries that are not objects come without fields and are dropped."""
    row = "record_date date, country string, currency string, exchange_rate decimal(14,6), effective_date date"
    payload = spark.read.schema("data array<string>").option("multiLine", True).json(path)
    entries = payload.select(F.explode("data").alias("entry")).filter(F.col("entry").startswith("{"))
    return entries.select(F.from_json("entry", row).alias("r")).select("r.*").filter("country is not null and exchange_rate is not null")


def read_spot_rates(spark: SparkSession, path: str, currency: str | None = None, direction: str = "foreign_per_usd") -> tuple[DataFrame, DataFrame]:
    """Daily rates from JSON: {"currency", "direction", "rates": {date: rate}} or {"records": [{date, rate, currency, direction}]}.

    Fields that a record lacks come from the header. Bad dates, rates that are not
    positive, unknown directions and dates given twice are violations.
    """
    schema = "currency string, direction string, rates map<string,string>, records array<struct<date: string, rate: string, currency: string, direction: string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    nothing = F.lit(None).cast("string")
    listed = raw.select("currency", "direction", F.explode("records").alias("r")).select(F.col("r.date").alias("date"), F.col("r.rate").alias("rate"), F.coalesce("r.currency", "currency").alias("currency"), F.coalesce("r.direction", "direction").alias("direction"))
    mapped = raw.select("currency", "direction", F.explode("rates").alias("date", "rate")).select("date", "rate", "currency", "direction")
    rows = listed.unionByName(mapped).withColumn("currency", F.coalesce("currency", F.lit(currency) if currency else nothing)).withColumn("direction", F.coalesce("direction", F.lit(direction)))
    rows = rows.withColumn("rate_date", F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date"))).withColumn("value", F.col("rate").try_cast("decimal(14,6)"))
    twice = F.count("*").over(W.partitionBy("currency", "date")) > 1
    code = F.when(F.col("rate_date").isNull(), "bad-date").when(F.col("value").isNull() | (F.col("value") <= 0), "rate-not-positive").when(~F.col("direction").isin("foreign_per_usd", "usd_per_foreign"), "unknown-direction").when(twice, "duplicate-date")
    checked = rows.withColumn("code", code)
    return checked.filter("code is null").select("currency", "rate_date", F.col("value").alias("rate"), "direction"), checked.filter("code is not null").select(F.col("date").alias("entity"), "code", F.col("rate").alias("detail"))


def read_attested_daily(spark: SparkSession, path: str, year: int) -> tuple[DataFrame, DataFrame]:
    """(date, native_balance) rows of a CSV that must hold every day of the year once."""
    raw = spark.read.schema("date string, native_balance string").option("header", True).csv(path)
    rows = raw.select(F.try_to_date("date").alias("date"), F.col("native_balance").try_cast("decimal(24,6)").alias("native_balance"), F.col("date").alias("shown"))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))).alias("date"))
    bad = rows.filter("date is null or native_balance is null").select(F.col("shown").alias("entity"), F.lit("unreadable-row").alias("code"))
    other = rows.filter(F.year("date") != year).select(F.col("date").cast("string").alias("entity"), F.lit("outside-year").alias("code"))
    twice = rows.groupBy("date").count().filter("count > 1 and date is not null").select(F.col("date").cast("string").alias("entity"), F.lit("duplicate-date").alias("code"))
    absent = days.join(rows.select("date"), "date", "left_anti").select(F.col("date").cast("string").alias("entity"), F.lit("missing-date").alias("code"))
    return rows.filter(F.year("date") == year).select("date", "native_balance"), bad.union(other).union(twice).union(absent)


def write_ledger(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A ledger as Parquet, partitioned by tax year, with the schema's version in every row.

    `overwrite` replaces the tax years that df holds and leaves the files of all others alone.
    """
    rows = df.withColumn("schema_version", F.lit(SCHEMA_VERSION))
    if "status" not in df.columns:
        rows = rows.withColumn("status", F.lit(READY))
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER_SCHEMA])
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("tax_year").parquet(path)


def read_ledger(spark: SparkSession, path: str, least: str = SCHEMA_VERSION, statuses: tuple[str, ...] = USABLE) -> tuple[DataFrame, DataFrame]:
    """The rows of a written ledger, and a violation for each account and year that may not be used.

    Such are years of an older or unreadable schema version, years of another status than the accepted ones, and years
    without a day. Files of older schemas are read by column name; what they lack is null, and a missing status counts as ready.
    """
    rows = spark.read.schema(LEDGER_SCHEMA).option("mergeSchema", True).parquet(path).withColumn("status", F.coalesce("status", F.lit(READY)))
    number = lambda c: F.transform(F.split(c, r"\."), lambda p: p.try_cast("int"))
    version = F.when(F.col("schema_version").rlike(r"^\d+(\.\d+)*$"), number(F.col("schema_version")) >= number(F.lit(least)))
    if re.fullmatch(r"\d+(\.\d+)*", least, re.ASCII):
        version = (F.col("schema_version") == least) | version  # the plain case, in which a row's version is compared but not taken apart
    new = F.coalesce(version, F.lit(False))
    kept = rows.withColumn("_code", F.when(~new, "schema-too-old").when(~F.col("status").isin(*statuses), "status-not-usable").when(F.col("date").isNull(), "no-daily-ledger"))
    detail = F.when(F.col("_code") == "schema-too-old", F.col("schema_version")).when(F.col("_code") == "status-not-usable", F.col("status")).otherwise(F.col("tax_year").cast("string"))
    bad = kept.filter("_code is not null").select(F.col("account_id").alias("entity"), F.col("_code").alias("code"), detail.alias("detail")).distinct()
    return kept.filter("_code is null").drop("_code", "status"), bad


def csv_safe(c: Column) -> Column:
    """A cell that no spreadsheet reads as a formula."""
    return F.when(c.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_cells(df: DataFrame) -> DataFrame:
    """All columns as safe text cells: lists joined by "; "."""
    cells = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        text = F.array_join(c.cast("array<string>"), "; ") if isinstance(f.dataType, T.ArrayType) else c.cast("string")
        cells.append((csv_safe(text) if isinstance(f.dataType, (T.ArrayType, T.StringType)) else text).alias(f.name))
    return df.select(*cells)


def csv_safe_export(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    csv_cells(df).write.mode(mode).option("header", True).csv(path)
