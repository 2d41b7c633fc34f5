"""Yearly threshold answers per filer, with lower and upper bounds where the evidence has no date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlake.operators.fx import to_usd
from ledgerlake.operators.ledger import KEYS, same_day_values

THRESHOLD = 10_000
FORMAL = ("formal-extracted", "legacy-formal-extracted")
KNOWN = (*FORMAL, "formal-with-attested-opening", "reconstructed-from-movements", "user-attested-zero", "user-attested-daily", "user-attested-maximum")


def confirm_accounts(cover: DataFrame, accounts: DataFrame, rates: DataFrame, tax_year: int, accepted: DataFrame | None = None, defects: DataFrame | None = None) -> DataFrame:
    """Every reason that keeps an account from confirmation; confirmed if there is none."""
    fx = rates.filter(F.col("rate_year") == tax_year).select("currency").distinct().withColumn("has_rate", F.lit(True))
    rows = accounts.select(*KEYS, "currency").join(cover, KEYS, "left").join(fx, "currency", "left")
    for side, name in ((accepted, "accepted"), (defects, "defect")):
        rows = rows.withColumn(name, F.lit(False)) if side is None else rows.join(side.select(*KEYS).distinct().withColumn(name, F.lit(True)), KEYS, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    known = F.coalesce(~F.col("currency").isin("UNKNOWN", "MIXED"), F.lit(False))
    has = F.coalesce("has_rate", F.lit(False))
    zero = F.lit(0)
    reasons = F.filter(
        F.array(
            F.when(F.col("defect"), F.lit("parser-coverage-defect")),
            F.when(F.coalesce("observed_days", zero) == 0, F.lit("no-observations")),
            F.when(F.coalesce("missing_days", zero) > 0, F.lit("missing-days")),
            F.when(F.coalesce("low_confidence_days", zero) > 0, F.lit("low-confidence-days")),
            F.when((F.coalesce("carry_gaps", zero) > 0) & ~F.col("accepted"), F.lit("carry-forward-gaps")),
            F.when(~known, F.lit("currency-not-confirmed")),
            F.when(known & (F.col("currency") != "USD") & ~has, F.lit("missing-fx-rate")),
            F.when((F.col("currency") == "USD") & has, F.lit("fx-rate-for-usd")),
        ),
        lambda r: r.isNotNull(),
    )
    return rows.withColumn("reasons", reasons).select(*KEYS, "currency", "reasons", (F.size("reasons") == 0).alias("confirmed"))


def eligible_accounts(accounts: DataFrame, least_version: tuple[int, int] = (1, 3)) -> DataFrame:
    """Which accounts may enter a yearly total, with every reason against."""
    parts = F.split("schema_version", r"\.")
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0))
    old = (at(1) < least_version[0]) | ((at(1) == least_version[0]) & (at(2) < least_version[1]))
    only_max = F.col("evidence_class") == "user-attested-maximum"
    formal = F.col("evidence_class").isin(*FORMAL)
    reasons = F.filter(
        F.array(
            F.when(old, F.lit("schema-too-old")),
            F.when(~F.coalesce(F.col("evidence_class").isin(*KNOWN), F.lit(False)), F.lit("unknown-evidence-class")),
            F.when(~F.coalesce("confirmed", F.lit(False)), F.lit("not-confirmed")),
            F.when(~formal & F.coalesce("formal_eligibility", F.lit(False)), F.lit("non-formal-marked-eligible")),
            F.when(~only_max & (F.coalesce("missing_days", F.lit(0)) > 0), F.lit("incomplete-year")),
            F.when(F.coalesce("unconverted_rows", F.lit(0)) > 0, F.lit("unconverted-rows")),
        ),
        lambda r: r.isNotNull(),
    )
    return accounts.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def duplicate_accounts(accounts: DataFrame, group: str = "filer_id", identity: tuple[str, ...] = ("account_id", "institution", "hint")) -> DataFrame:
    """The same account twice in one filer's set, and sets of more than one tax year, as violations."""
    twice = accounts.groupBy(group, *identity).count().filter("count > 1").select(F.col(group).alias("entity"), F.lit("duplicate-account").alias("code"), F.col("count").cast("string").alias("detail"))
    mixed = accounts.groupBy(group).agg(F.countDistinct("tax_year").alias("years")).filter("years > 1").select(F.col(group).alias("entity"), F.lit("mixed-tax-years").alias("code"), F.col("years").cast("string").alias("detail"))
    return twice.union(mixed)


def account_labels(accounts: DataFrame, group: str = "filer_id", name: str = "account_id", order: str = "account_id") -> DataFrame:
    """Slug labels, unique in a filer's set: the second of a slug gets -2, the next free number where that is some account's own slug.

    A slug's n-th account gets the (n - 1)-th number from 2 on that no own slug takes. Numbers that are taken
    stand among the places of the slug's accounts, where counting them gives the numbers to step over; so a set
    of any size is sorted, not searched.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    rows = accounts.withColumn("slug", F.when(plain == "", "account").otherwise(plain))
    by_slug = W.partitionBy(group, "slug")
    placed = rows.withColumn("_place", F.row_number().over(by_slug.orderBy(F.asc_nulls_last(order))).cast("bigint")).withColumn("_row", F.lit(True))
    # An own slug that reads as another one with a number, as f"{slug}-{number}" would write it.
    own = rows.select(group, "slug").distinct().select(group, F.regexp_extract("slug", r"^(.*)-([1-9]\d{0,17})$", 1).alias("slug"), F.regexp_extract("slug", r"^(.*)-([1-9]\d{0,17})$", 2).try_cast("bigint").alias("_n"))
    taken = own.filter("slug <> '' and _n > 1").withColumn("_place", F.col("_n") - F.row_number().over(by_slug.orderBy("_n"))).drop("_n").withColumn("_row", F.lit(False))
    both = placed.unionByName(taken, allowMissingColumns=True)
    before = F.count_if(~F.col("_row")).over(by_slug.orderBy("_place", F.desc("_row")).rowsBetween(W.unboundedPreceding, 0))
    number = F.col("_place") + before
    label = F.when(F.col("_place") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", number.cast("string")))
    return both.withColumn("label", label).filter("_row").select(*accounts.columns, "label")


def account_maxima(ledger: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Per account: the largest threshold value, its earliest date, and its ceiling; accounts known by a maximum take that."""
    best = ledger.filter("threshold_usd_value is not null").groupBy(*KEYS).agg(F.max(F.struct(F.col("threshold_usd_value").alias("v"), (-F.unix_date("date")).alias("d"))).alias("m"))
    rows = best.select(*KEYS, F.col("m.v").alias("max_usd_value"), F.date_from_unix_date(-F.col("m.d")).alias("max_date"), F.lit("exact-daily").alias("value_model"))
    if models is not None:
        rows = rows.unionByName(models.select(*KEYS, F.col("maximum_usd").cast("decimal(24,6)").alias("max_usd_value"), F.col("maximum_date").alias("max_date"), F.lit("annual-maximum").alias("value_model")))
    return rows.withColumn("max_usd_whole_dollars", F.ceil("max_usd_value").cast("bigint"))


def combined_daily(ledger: DataFrame, models: DataFrame | None, tax_year: int, threshold: int = THRESHOLD) -> DataFrame:
    """Per filer and day: what is known, and the most that it can have been.

    Dated values count in both totals. An account known by its maximum adds it
    to the upper total of every day, to the known total on its date only. Days
    are summed before the maxima join, one row per filer.
    """
    zero = F.lit(0).cast("decimal(24,6)")
    rows = ledger.select("filer_id", "date", F.col("threshold_usd_value").cast("decimal(24,6)").alias("v"))
    if models is not None:  # their filers have all days, with dated accounts or without
        start, end = F.lit(f"{tax_year}-01-01").cast("date"), F.lit(f"{tax_year}-12-31").cast("date")
        rows = rows.unionByName(models.select("filer_id").distinct().select("filer_id", F.explode(F.sequence(start, end)).alias("date"), zero.alias("v")))
    days = rows.groupBy("filer_id", "date").agg(F.coalesce(F.sum("v"), zero).cast("decimal(34,6)").alias("dated"))
    if models is None:
        totals = days.select("filer_id", "date", F.col("dated").alias("known_total_usd"), F.col("dated").alias("upper_bound_total_usd"))
    else:
        tops = models.groupBy("filer_id").agg(F.sum("maximum_usd").alias("top"))
        dated = models.filter(F.col("maximum_date").between(start, end)).groupBy("filer_id", F.col("maximum_date").alias("date")).agg(F.sum("maximum_usd").alias("dated_top"))
        every = days.join(tops, "filer_id", "left").join(dated, ["filer_id", "date"], "left")
        totals = every.select("filer_id", "date", (F.col("dated") + F.coalesce("dated_top", zero)).cast("decimal(34,6)").alias("known_total_usd"), (F.col("dated") + F.coalesce("top", zero)).cast("decimal(34,6)").alias("upper_bound_total_usd"))
    return totals.withColumn("over", F.col("known_total_usd") > threshold).withColumn("possibly_over", F.col("upper_bound_total_usd") > threshold)


def combined_from_days(candidates: DataFrame, accounts: DataFrame, rates: DataFrame, models: DataFrame | None, tax_year: int, threshold: int = THRESHOLD) -> DataFrame:
    """What `combined_daily` says of the daily ledger in USD, from its observations, without making the ledger.

    A filer's total moves only where an observation begins to count, where an
    end of day that differs is carried, and around the date of a maximum. These
    changes are summed per filer and day, totalled up in order, and spread over
    the days up to the next change; so account-days are neither made nor
    exchanged. Days ahead of an account's first observation add nothing, be
    they missing or attested zeros. Filers with accounts or maxima have all days
    of the year, others those from their first observation on. Observations
    without a rate count as zero, maxima of null too.
    """
    start, end = F.lit(f"{tax_year}-01-01").cast("date"), F.lit(f"{tax_year}-12-31").cast("date")
    zero, none = F.lit(0).cast("decimal(25,6)"), F.lit(0).cast("decimal(24,6)")
    days = same_day_values(candidates.filter(F.col("balance_date").between(start, end)))
    days = days.join(accounts.select(*KEYS, "currency").distinct(), KEYS, "left").withColumn("tax_year", F.lit(tax_year))
    for c in ("amount", "carry_amount"):
        days = to_usd(days, rates, c).withColumn(f"{c}_usd", F.coalesce("threshold_usd_value", none)).drop("usd_micro", "usd_balance", "threshold_usd_value", "negative")
    days = days.withColumn("_before", F.coalesce(F.lag("carry_amount_usd").over(W.partitionBy(*KEYS).orderBy("balance_date")), none))
    change = lambda day, known, upper, stays=True: F.struct(day.alias("date"), known.cast("decimal(25,6)").alias("known"), upper.cast("decimal(25,6)").alias("upper"), F.lit(stays).alias("stays"))
    observed, carried = F.col("amount_usd") - F.col("_before"), F.col("carry_amount_usd") - F.col("amount_usd")
    moved = days.select("filer_id", F.inline(F.array(change(F.col("balance_date"), observed, observed), change(F.date_add("balance_date", 1), carried, carried, False))))
    parts = [moved, accounts.select("filer_id").distinct().select("filer_id", start.alias("date"), zero.alias("known"), zero.alias("upper"), F.lit(True).alias("stays"))]
    if models is not None:
        top = F.coalesce(F.col("maximum_usd").cast("decimal(24,6)"), none)
        dated = F.when(F.col("maximum_date").between(start, end), top).otherwise(none)
        day = F.coalesce("maximum_date", start)
        parts.append(models.select("filer_id", F.inline(F.array(change(start, zero, top), change(day, dated, zero, False), change(F.date_add(day, 1), -dated, zero, False)))))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # A change of nothing goes, unless it may be the filer's first day.
    sums = rows.filter(F.col("date").between(start, end) & (F.col("stays") | (F.col("known") != 0))).groupBy("filer_id", "date").agg(F.sum("known").alias("known"), F.sum("upper").alias("upper"))
    by_day = W.partitionBy("filer_id").orderBy("date")
    so_far = by_day.rowsBetween(W.unboundedPreceding, 0)
    total = lambda c: F.sum(c).over(so_far).cast("decimal(34,6)")
    runs = sums.select("filer_id", "date", total("known").alias("known_total_usd"), total("upper").alias("upper_bound_total_usd"), F.coalesce(F.date_sub(F.lead("date").over(by_day), 1), end).alias("_until"))
    runs = runs.withColumn("over", F.col("known_total_usd") > threshold).withColumn("possibly_over", F.col("upper_bound_total_usd") > threshold)
    return runs.select("filer_id", F.explode(F.sequence("date", "_until")).alias("date"), "known_total_usd", "upper_bound_total_usd", "over", "possibly_over")


def combined_wide(ledger: DataFrame, models: DataFrame | None, tax_year: int, label: str = "label", accounts: DataFrame | None = None) -> DataFrame:
    """One row per filer and day: for every label its value and its upper bound, and both totals.

    The ledger is a daily one or `ledger_stretches`. Labels come from the data: from the accounts of the ledger, if given
    with the same column, so the ledger is not made twice. Their number is bounded by
    spark.sql.pivotMaxValues, as that of any pivot's columns. A dated account has one value in both columns; an
    account known by its maximum has that as upper bound of every day, and as value
    on its date only (else 0). A label that a filer lacks is null.

    A row of the ledger begins to count on its first day and ends after its last. These changes are summed per filer,
    label and day, totalled up in order, and spread over the days up to the next change; so account-days are neither made
    nor exchanged, and a filer's rows in the window are as many as its labels have days of change.
    """
    start, end = F.lit(f"{tax_year}-01-01").cast("date"), F.lit(f"{tax_year}-12-31").cast("date")
    money = lambda c: c.cast("decimal(24,6)")
    days = F.col("days") if "days" in ledger.columns else F.lit(1)
    value = money(F.col("threshold_usd_value"))
    rows = ledger.select("filer_id", F.col(label).alias("_label"), "date", F.date_add("date", days.cast("int")).alias("_end"), value.alias("v"), value.alias("u"))
    if models is not None:
        top, day, none = money(F.col("maximum_usd")), F.col("maximum_date"), F.lit(0).cast("decimal(24,6)")
        part = lambda first, last, v: F.struct(first.alias("date"), last.alias("_end"), v.alias("v"), top.alias("u"))
        after = F.date_add(end, 1)
        parts = F.when(day.between(start, end), F.array(part(start, day, none), part(day, F.date_add(day, 1), top), part(F.date_add(day, 1), after, none))).otherwise(F.array(part(start, after, none)))
        rows = rows.unionByName(models.select("filer_id", F.col(label).alias("_label"), F.inline(parts)).filter(F.col("date") < F.col("_end")))
    named = ledger.select(label) if accounts is None else accounts.select(label)
    if models is not None:
        named = named.union(models.select(label))
    most = int(ledger.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    labels = [r[0] for r in named.distinct().orderBy(named.columns[0]).limit(most + 1).collect()]
    if len(labels) > most:
        raise ValueError(f"over {most} labels: raise spark.sql.pivotMaxValues")
    wide = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(25,6)")
    one = lambda c: F.when(F.col(c).isNotNull(), 1).otherwise(0)
    change = lambda day, sign: F.struct(F.col(day).alias("date"), F.lit(sign).alias("n"), (wide("v") * sign).cast("decimal(25,6)").alias("v"), (wide("u") * sign).cast("decimal(25,6)").alias("u"), (one("v") * sign).alias("n_v"), (one("u") * sign).alias("n_u"))
    changes = rows.select("filer_id", "_label", F.inline(F.array(change("date", 1), change("_end", -1))))
    sums = changes.groupBy("filer_id", "_label", "date").agg(*[F.sum(c).alias(c) for c in ("n", "v", "u", "n_v", "n_u")])
    by_day = W.partitionBy("filer_id").orderBy("date")  # all rows of a day are peers
    of = lambda name, c: F.sum(F.when(F.col("_label") == name, F.col(c))).over(by_day)
    totals = sums.select("filer_id", "date", F.sum("n").over(by_day).alias("_n"), *[of(name, c).alias(f"_{c}{i}") for i, name in enumerate(labels) for c in ("v", "u", "n_v", "n_u")])
    shown = lambda i, c: F.when(F.col(f"_n_{c}{i}") > 0, F.col(f"_{c}{i}").cast("decimal(34,6)"))
    total = lambda c: money(sum((F.coalesce(shown(i, c), F.lit(0)) for i in range(len(labels))), F.lit(0)))
    each = [shown(i, c).alias(name + tail) for i, name in enumerate(labels) for c, tail in (("v", ""), ("u", "__upper_bound"))]
    runs = totals.select("filer_id", "date", "_n", *each, total("v").alias("known_total_usd"), total("u").alias("upper_bound_total_usd"))
    runs = runs.withColumn("_next", F.lead("date").over(by_day)).filter((F.col("_n") > 0) & (F.col("_next") > F.col("date")))
    return runs.select("filer_id", F.explode(F.sequence("date", F.date_sub("_next", 1))).alias("date"), *[F.col(f"`{c}`") for c in runs.columns[3:-1]])


#: Evidence that leaves nothing open.
COMPLETE = ("formal-extracted", "legacy-formal-extracted")


def records_complete(evidence: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Per filer: whether the evidence of all accounts is formal and extracted, and none is known by its annual maximum only.

    evidence: filer_id, account_id, evidence_class, one row per account (a missing class counts as legacy-formal-extracted); models: such accounts.
    """
    rows = evidence.select("filer_id", F.coalesce("evidence_class", F.lit(COMPLETE[1])).isin(*COMPLETE).alias("whole"))
    if models is not None:
        rows = rows.union(models.select("filer_id", F.lit(False)))
    return rows.groupBy("filer_id").agg(F.bool_and("whole").alias("records_complete"))


def threshold_answer(combined: DataFrame, alignment: DataFrame | None = None, evidence: DataFrame | None = None, models: DataFrame | None = None) -> DataFrame:
    """Per filer: yes if a known total is over, no if no upper total is, else review; days over, and the first day of each maximum.

    With the evidence of accounts, also whether the records are complete; a filer without accounts there has complete ones.
    """
    if evidence is not None:
        known = records_complete(evidence, models)
        return threshold_answer(combined, alignment).join(known, "filer_id", "left").withColumn("records_complete", F.coalesce("records_complete", F.lit(True)))
    first = lambda v: F.max(F.struct(F.col(v).alias("v"), (-F.unix_date("date")).alias("d")))
    found = combined.groupBy("filer_id").agg(
        F.count_if("over").alias("over_days"),
        F.count_if("possibly_over").alias("possibly_over_days"),
        F.sort_array(F.collect_list(F.when(F.col("over"), F.col("date")))).alias("over_dates"),
        first("known_total_usd").alias("known"),
        first("upper_bound_total_usd").alias("upper"),
    )
    answer = F.when(F.col("over_days") > 0, "yes").when(F.col("possibly_over_days") == 0, "no").otherwise("review-required")
    same = (F.col("over_days") > 0) == (F.col("possibly_over_days") > 0)
    day = lambda m: F.when(F.col(f"{m}.v") > 0, F.date_from_unix_date(-F.col(f"{m}.d")))
    out = found.select(
        "filer_id",
        answer.alias("answer"),
        F.when(same, "not-sensitive").otherwise("sensitive-to-undated-evidence").alias("answer_sensitivity"),
        "over_days",
        "possibly_over_days",
        "over_dates",
        F.col("known.v").alias("max_combined_usd"),
        day("known").alias("max_combined_date"),
        F.col("upper.v").alias("max_upper_bound_usd"),
        day("upper").alias("max_upper_bound_date"),
    )
    if alignment is None:
        return out.withColumn("time_alignment", F.lit("date-only-upper-bound"))
    kinds = alignment.groupBy("filer_id").agg(F.countDistinct("time_alignment").alias("_kinds"), F.min("time_alignment").alias("_kind"))
    one = (F.col("_kinds") == 1) & F.col("_kind").isin("synchronized", "end-of-day")
    return out.join(kinds, "filer_id", "left").withColumn("time_alignment", F.when(one, F.col("_kind")).otherwise("date-only-upper-bound")).drop("_kinds", "_kind")


def rounding_dependency(maxima: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per filer: the sum of the accounts' ceilings, the ceiling of their exact sum, and whether these disagree about the threshold."""
    sums = maxima.groupBy("filer_id").agg(F.sum("max_usd_whole_dollars").alias("sum_of_ceilings"), F.ceil(F.sum("max_usd_value")).cast("bigint").alias("ceiling_of_sum"))
    return sums.withColumn("depends", (F.col("sum_of_ceilings") > threshold) != (F.col("ceiling_of_sum") > threshold))


def verify_conversion(stored: DataFrame, rates: DataFrame) -> DataFrame:
    """Ledger rows whose stored USD values differ from native amount and rate."""
    kept = stored.withColumnRenamed("usd_balance", "stored_usd").withColumnRenamed("threshold_usd_value", "stored_threshold")
    again = to_usd(kept, rates, filtered=True)
    same = F.col("usd_balance").eqNullSafe(F.col("stored_usd")) & F.col("threshold_usd_value").eqNullSafe(F.col("stored_threshold"))
    return again.filter(~same).select(*KEYS, "date", "stored_usd", "usd_balance", "stored_threshold", "threshold_usd_value")


def verify_summary(stored: DataFrame, computed: DataFrame, fields: list[str]) -> DataFrame:
    """Every decision field in which a stored summary and the recomputed one differ, missing filers included."""
    both = stored.select("filer_id", *[F.col(f).cast("string").alias(f"s_{f}") for f in fields], F.lit(True).alias("s_")).join(computed.select("filer_id", *[F.col(f).cast("string").alias(f"c_{f}") for f in fields], F.lit(True).alias("c_")), "filer_id", "full")
    differs = [F.when(~F.col(f"s_{f}").eqNullSafe(F.col(f"c_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"s_{f}").alias("stored"), F.col(f"c_{f}").alias("computed"))) for f in fields]
    absent = F.when(F.col("s_").isNull(), F.lit("not-stored")).when(F.col("c_").isNull(), F.lit("not-computed"))
    first = F.when(absent.isNotNull(), F.struct(absent.alias("field"), F.lit(None).cast("string").alias("stored"), F.lit(None).cast("string").alias("computed")))
    found = F.filter(F.array(first, *[F.when(absent.isNull(), d) for d in differs]), lambda d: d.isNotNull())
    return both.select("filer_id", F.inline(found))


def verify_bindings(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """A manifest of (path, bytes, sha256) against the files there: missing, changed, extra and doubly listed paths.

    A path is changed if the contents listed for it and those found there differ as sets, in whatever order they come.
    """
    content = F.sort_array(F.collect_set(F.struct(F.col("content_bytes").cast("bigint").alias("b"), F.col("content_sha256").alias("s"))))
    m = manifest.groupBy("path").agg(F.count("*").alias("listed"), content.alias("m_content"))
    f = files.groupBy("path").agg(F.count("*").alias("there"), content.alias("f_content"))
    both = m.join(f, "path", "full")
    changed = F.col("there").isNotNull() & F.col("listed").isNotNull() & (F.col("m_content") != F.col("f_content"))
    codes = F.filter(F.array(F.when(F.col("there").isNull(), F.lit("missing")), F.when(F.col("listed").isNull(), F.lit("extra")), F.when(changed, F.lit("changed")), F.when(F.col("listed") > 1, F.lit("duplicate-path"))), lambda c: c.isNotNull())
    return both.select("path", F.explode(codes).alias("code"))
