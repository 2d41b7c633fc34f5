"""Cases that the third round of review found."""

import datetime as dt
import random
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import fx, intake, interest, ledger, privacy, text, threshold
from ledgerlake.plans import catalog
from ledgerlake.sources import readers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("line,plain,stated", [
    ("2024-05-01 Interest credited $0.00 $0.00", None, D(0)), ("Interest credited $0.00 $3.10", D("3.1"), D("3.1")), ("Interest credited", None, None), ("Interest credited -$4.00", None, None),
])
def test_interest_of_a_stated_zero(spark, line, plain, stated):
    assert one(spark, interest.interest_amount(F.col("v")), v=line) == plain and one(spark, interest.interest_amount(F.col("v"), stated_zero=True), v=line) == stated
    rows = spark.createDataFrame([(1, "2024-05-01 Interest credited $0.00")], "id int, line string")
    assert interest.interest_rows(rows, 2024, stated_zero=True)[0].first()["amount"] == 0 and interest.interest_rows(rows, 2024)[1].first()["reason"] == "no-positive-amount"


def test_addresses_by_ascii_word_ends(spark):
    rows = spark.createDataFrame([(1, "Tel. 3280 zuch stöbe"), (2, "12 Old Mill Road, Town"), (3, "3280 zuch streu")], "id int, line string")
    found = lambda **how: {r["id"] for r in privacy.line_findings(rows, ("account",), **how).collect()}
    assert found() == {2} and found(ascii_words=True) == {1, 2}


def test_no_card_inside_a_digest(spark):
    digest = "ab4111111111111111cd" + "0e" * 22
    rows = spark.createDataFrame([(1, f"password = {digest}"), (2, "card 4111111111111111"), (3, f"{digest} 4111 1111 1111 1111"), (4, "ab4111111111111111cd")], "id int, line string")
    assert {r["id"] for r in privacy.line_findings(rows, ("card",)).collect()} == {2, 3, 4}
    left = {r["id"]: r["line"] for r in rows.select("id", privacy.redacted(F.col("line")).alias("line")).collect()}
    assert left[1] == f"password = {digest}" and left[3] == f"{digest} <REDACTED_CARD_NUMBER>"


def test_account_labels_of_a_large_set(spark):
    rows = spark.createDataFrame([(f, f"A {n}" if n % 3 else "A", n) for f in (1, 2, None) for n in range(60)] + [(1, f"a-{k}", 100 + k) for k in (2, 3, 7, 21)] + [(1, "a-02", 200), (1, "a-2", 201), (1, "!", 300), (1, "?", 301)], "filer_id bigint, account_id string, n int")
    got = {(r["filer_id"], r["n"]): r["label"] for r in threshold.account_labels(rows, order="n").collect()}
    want = {}
    for filer in (1, 2, None):
        own = [(r["n"], re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", r["account_id"].lower())) or "account") for r in sorted(rows.collect(), key=lambda r: r["n"]) if r["filer_id"] == filer]
        slugs, used = {s for _, s in own}, set()
        for n, slug in own:
            label, k = slug, 1
            while label in used or (k > 1 and label in slugs):
                k += 1
                label = f"{slug}-{k}"
            used.add(label)
            want[filer, n] = label
    assert got == want


@pytest.mark.parametrize("scan", ["text", "bytes"])
def test_lines_do_not_carry_their_file(spark, scan):
    files = spark.createDataFrame([("a.txt", "mail a@b.io\n" * 9)], "path string, text string").selectExpr("path", "text", "length(text) as length", "encode(text, 'utf-8') as content")
    made = privacy.scan(files.select("path", "text")) if scan == "text" else privacy.scan_bytes(files.drop("text"))
    assert "Generate posexplode(_lines" in made._jdf.queryExecution().optimizedPlan().toString()  # not of anything made of text or content
    assert made.count() == 9 and {r["line_no"] for r in made.collect()} == set(range(1, 10))


def test_years_in_place_as_by_windows(spark, monkeypatch):
    parts = ["©", "(c)", "copyright", "since", "est.", "Member FDIC", "May", "Sept.", "2019", "1999", "2024", "/", "-04-01", "01.02.", " ", "   ", " " * 6, " " * 9, ",", "and"]
    rng = random.Random(3)
    lines = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(2, 12))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id int, line string")
    found = lambda: {(r["doc_id"], r["year"]) for r in text.detect_years(rows).collect()}
    here = found()
    monkeypatch.setattr(text, "MAX_SPANS_IN_PLACE", 0)
    assert here == found() and len(here) > 300


def test_few_spans_are_not_dealt_out(spark):
    rows = spark.createDataFrame([(1, "© 2019 Bank"), (2, "© " + "2019 " * 99 + " " * 9 + "2020")], "doc_id int, line string")
    assert {(r["doc_id"], r["year"]) for r in text.detect_years(rows).collect()} == {(2, 2020)}
    assert text.detect_years(rows.filter("doc_id = 1")).count() == 0 and text.MAX_SPANS_IN_PLACE == 64


def test_headers_of_many_accounts_go_to_python_in_batches(spark):
    day = dt.date(2024, 2, 1)
    periods = spark.createDataFrame([(a, dt.date(2024, 1, 1), dt.date(2024, 1, 31)) for a in (1, 2, None)], "account_id bigint, start_date date, end_date date")
    heads = spark.createDataFrame([(10, 1, 2, 1, 2, 29), (20, 2, 2, 1, 2, 9), (21, 2, 2, 10, 2, 29), (30, None, 2, 1, 2, 2), (40, 4, 2, 1, 2, 29)], "header_id bigint, account_id bigint, start_month int, start_day int, end_month int, end_day int")
    made = intake.chain_header_years(heads, periods, 2024)
    assert {r["header_id"]: r["start_date"] for r in made.collect()} == {10: day, 20: day, 21: dt.date(2024, 2, 10), 30: day}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan


def test_redaction_reads_each_step_once(spark):
    plan = spark.createDataFrame([("a@b.io",)], "t string").select(privacy.redacted(F.col("t")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all(") < 12


def observations(spark, seed, accounts):
    """Random candidates of 2024 with repeated days and end-of-day amounts, accounts without any, and one that no account names."""
    rng = random.Random(seed)
    kinds = ["transaction-row", "period-end-summary", "reconstructed-from-movements"]
    rows = [(f, a, n, dt.date(2023, 12, 20) + dt.timedelta(rng.choice([rng.randrange(380), 40])), D(rng.randrange(-900, 90000)) / 100, rng.choice(kinds), rng.choice(["high", "medium", "low"]), f"r{n}") for n, (f, a) in enumerate(x for x in accounts for _ in range(rng.randrange(9)))]
    return spark.createDataFrame(rows, "filer_id bigint, account_id string, seq bigint, balance_date date, amount decimal(24,6), candidate_type string, confidence string, source_ref string")


def test_coverage_of_stretches_as_of_days(spark):
    keys = [(f, f"{f}-{a}") for f in range(9) for a in "ab"]
    found = observations(spark, 1, keys + [(9, "9-a")])
    accounts = spark.createDataFrame([(f, a, "USD") for f, a in keys + [(8, "8-c")]], "filer_id bigint, account_id string, currency string")
    zero = spark.createDataFrame([(f, a, dt.date(2024, 3, 1)) for f, a in keys[::3]], "filer_id bigint, account_id string, zero_until date")
    parts, days = (make(found, accounts, 2024, leading_zero=zero) for make in (ledger.ledger_stretches, ledger.daily_ledger))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert days.groupBy("filer_id", "account_id").agg(F.count("*").alias("n"), F.countDistinct("date").alias("m"), F.min("date").alias("a")).filter("n <> m or n <> datediff('2024-12-31', a) + 1 or (filer_id < 9 and n <> 366)").count() == 0
    assert parts.count() < days.count() / 10 and parts.agg(F.sum("days")).first()[0] == days.count()
    assert rows(ledger.coverage(parts, 2024)) == rows(ledger.coverage(days, 2024)) and rows(ledger.carry_gaps(parts)) == rows(ledger.carry_gaps(days)) and rows(ledger.review_summary(parts)) == rows(ledger.review_summary(days))
    assert {r["user_attested_zero_days"] > 0 for r in ledger.coverage(parts, 2024).collect()} == {True, False}


@pytest.mark.parametrize("name", ["l06_carry_gaps", "l08_coverage", "l09_data_sufficiency", "l11_review_summary", "t01_confirm_accounts"])
def test_no_account_days_are_made(spark, sf, name):
    assert "sequence(" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_verification_converts_once_a_row(spark):
    rates = spark.createDataFrame([("EUR", 2024, D("0.96"), None), ("COP", 2024, None, D("0.000227272727"))], "currency string, rate_year int, foreign_per_usd decimal(14,6), usd_per_foreign decimal(20,12)")
    rows = spark.createDataFrame([(1, "a", dt.date(2024, 1, d), 2024, c, v) for d, (c, v) in enumerate([("EUR", D("9.6")), ("EUR", D("-9.6")), ("COP", D(4400)), ("USD", D(3)), ("KWD", D(3)), ("EUR", None)], 1)], "filer_id bigint, account_id string, date date, tax_year int, currency string, native_balance decimal(24,6)")
    stored = fx.to_usd(rows, rates).drop("usd_micro", "negative")
    assert threshold.verify_conversion(stored, rates).count() == 0
    wrong = stored.select(*[(F.col(c) + F.when(F.dayofmonth("date") == 2, D("0.01")).otherwise(0)).cast(stored.schema[c].dataType).alias(c) if c in ("usd_balance", "threshold_usd_value") else c for c in stored.columns])
    assert [(r["date"].day, r["stored_usd"], r["usd_balance"]) for r in threshold.verify_conversion(wrong, rates).collect()] == [(2, D("-9.99"), D("-10.00"))]
    table = stored.sparkSession.createDataFrame(stored.collect(), stored.schema)
    assert threshold.verify_conversion(table, rates)._jdf.queryExecution().optimizedPlan().toString().count(" div ") == 1


@pytest.mark.parametrize("by", ["stretches", "days", "days with gaps"])
def test_wide_totals_by_changes_as_by_pivot(spark, by):
    keys = [(f, f"{f}-{a}") for f in range(8) for a in ("a1", "a2", "b1")]
    accounts = spark.createDataFrame([(f, a, c) for (f, a), c in zip(keys, ["USD", "EUR", "XXX"] * 8)], "filer_id bigint, account_id string, currency string")
    rates = spark.createDataFrame([("EUR", 2024, D("0.96"), None)], "currency string, rate_year int, foreign_per_usd decimal(14,6), usd_per_foreign decimal(20,12)")
    named = lambda df: df.withColumn("label", F.substring(F.split_part("account_id", F.lit("-"), F.lit(2)), 1, 1))
    tops = [(0, "0-m", D(5), dt.date(2024, 1, 1)), (1, "1-m", D(6), dt.date(2024, 12, 31)), (2, "2-b", D(7), dt.date(2024, 5, 5)), (2, "2-m", D(8), None), (3, "3-m", D(9), dt.date(2023, 5, 5)), (20, "20-m", None, dt.date(2024, 6, 1)), (21, "21-m", D(1), dt.date(2024, 6, 1))]
    models = named(spark.createDataFrame(tops, "filer_id bigint, account_id string, maximum_usd decimal(24,6), maximum_date date"))
    found = observations(spark, 2, keys + [(9, "9-b1")])
    parts, days = (named(make(found, accounts, 2024, rates=rates)) for make in (ledger.ledger_stretches, ledger.daily_ledger))
    if by == "days with gaps":
        days = days.filter("(filer_id * 31 + dayofyear(date)) % 10 > 2")
    every = models.withColumn("date", F.explode(F.expr("sequence(date'2024-01-01', date'2024-12-31')")))
    long = days.selectExpr("filer_id", "date", "label", "threshold_usd_value as v", "threshold_usd_value as u").union(every.selectExpr("filer_id", "date", "label", "if(maximum_date = date, maximum_usd, 0)", "maximum_usd"))
    want = long.groupBy("filer_id", "date").pivot("label", ["a", "b", "m"]).agg(F.sum("v").alias("v"), F.sum("u").alias("u"))
    totals = [F.expr(" + ".join(f"coalesce({x}_{c}, 0)" for x in "abm")).alias(c) for c in "vu"]
    want = want.select("*", *totals)
    got = threshold.combined_wide(parts if by == "stretches" else days, models, 2024, accounts=named(accounts) if by == "stretches" else None)
    plain = lambda df: sorted(tuple(str(v + 0 if not isinstance(v, D) else v.normalize() + 0) if isinstance(v, (D, int)) else str(v) for v in r) for r in df.collect())
    assert plain(got) == plain(want) and got.columns[2:4] == ["a", "a__upper_bound"]


@pytest.mark.parametrize("name", ["t05_account_maxima", "t07_combined_wide", "t09_rounding_dependency"])
def test_filers_days_come_last(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan[plan.find("Aggregate ["):]


def test_versions_of_a_ledger(spark, tmp_path):
    versions = ["1.3", "1.10", "1.2", "1.3.0", "2", "x", "", None]
    rows = spark.createDataFrame([(i, f"a{i}", dt.date(2024, 1, 1), v) for i, v in enumerate(versions)], "filer_id bigint, account_id string, date date, v string")
    readers.write_ledger(rows.select("*", F.lit(2024).alias("tax_year"), F.lit(D(1)).alias("native_balance"), *[F.lit("x").alias(c) for c in ("balance_source", "evidence_class", "confidence", "source_ref")], F.array(F.lit("f")).alias("review_flags")), str(tmp_path / "now"))
    now = spark.read.parquet(str(tmp_path / "now")).drop("schema_version").join(rows.select("account_id", F.col("v").alias("schema_version")), "account_id")
    now.write.partitionBy("tax_year").parquet(str(tmp_path / "mixed"))
    kept, bad = readers.read_ledger(spark, str(tmp_path / "mixed"))
    assert {r["filer_id"] for r in kept.collect()} == {0, 1, 3, 4} and {r["entity"] for r in bad.collect()} == {"a2", "a5", "a6", "a7"}
    assert {r["filer_id"] for r in readers.read_ledger(spark, str(tmp_path / "mixed"), least="x")[0].collect()} == {0, 1, 2, 3, 4}  # not its equal, which is no version
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.find("= 1.3)") < plan.find("RLIKE")  # rows of the plain case are compared only
