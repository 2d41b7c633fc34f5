"""Daily balance ledgers: one row per account and calendar day, from sparse balance observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlake.functions.staging import materialize, running_total
from ledgerlake.operators.fx import to_usd

KEYS = ["filer_id", "account_id"]
#: A balance may be carried so many days before the gap needs review.
ROUTINE_CARRY_DAYS = 40
RECONSTRUCTED, PERIOD_END = "reconstructed-from-movements", "period-end-summary"
#: Currencies with three decimal places (fixed values).
THREE_DECIMALS = ("BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND")


def _year(year: int) -> tuple[Column, Column]:
    return F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")


def union_candidates(*lanes: DataFrame, page: str = "page_key") -> DataFrame:
    """Extraction lanes in order of priority; a page that an earlier lane handled is left out of later ones."""
    out, handled = lanes[0], lanes[0].select(page).distinct()
    for lane in lanes[1:]:
        own = lane.join(handled, page, "left_anti")
        out, handled = out.unionByName(own, allowMissingColumns=True), handled.union(own.select(page)).distinct()
    return out


def same_day_pick(candidates: DataFrame) -> DataFrame:
    """Per account and day: the largest amount (first seen on ties) and the amount that later days carry."""
    item = F.struct("amount", "seq", "source_ref", "candidate_type", "confidence")
    picked = candidates.groupBy(*KEYS, "balance_date").agg(
        F.max_by(item, F.struct(F.col("amount"), -F.col("seq"))).alias("picked"),
        F.max_by(F.struct("amount", "source_ref"), "seq").alias("final"),
        F.bool_and(F.col("candidate_type") == RECONSTRUCTED).alias("all_reconstructed"),
        F.count("*").alias("candidate_count"),
        F.min("amount").alias("low"),
    )
    carry = F.when(F.col("all_reconstructed"), F.col("final")).otherwise(F.struct(F.col("picked.amount").alias("amount"), F.col("picked.source_ref").alias("source_ref")))
    variance = (F.col("picked.amount") > F.col("low")) & (F.col("picked.amount") - F.col("low") > F.abs("picked.amount") * F.expr("0.5bd"))
    return picked.select(*KEYS, "balance_date", F.col("picked.amount").alias("amount"), carry["amount"].alias("carry_amount"), carry["source_ref"].alias("carry_ref"), F.col("picked.source_ref").alias("source_ref"), F.col("picked.candidate_type").alias("candidate_type"), F.col("picked.confidence").alias("picked_confidence"), "candidate_count", F.col("low").alias("low_amount"), variance.alias("material_variance"))


def same_day_values(candidates: DataFrame) -> DataFrame:
    """The amount and the carried amount of `same_day_pick` alone: of fixed width, so they are summed up by hash instead of by sorting."""
    days = candidates.groupBy(*KEYS, "balance_date").agg(F.max("amount").alias("amount"), F.max_by("amount", "seq").alias("_final"), F.bool_and(F.col("candidate_type") == RECONSTRUCTED).alias("_rebuilt"))
    return days.select(*KEYS, "balance_date", "amount", F.when(F.col("_rebuilt"), F.col("_final")).otherwise(F.col("amount")).alias("carry_amount"))


def same_day_variance(candidates: DataFrame) -> DataFrame:
    """Days whose candidates differ by over half of the largest, with the candidates in order of amount and source."""
    days = candidates.groupBy(*KEYS, "balance_date").agg(F.min("amount").alias("low_amount"), F.max("amount").alias("high_amount"), F.count("*").alias("candidate_count"), F.array_sort(F.collect_list(F.struct("amount", "source_ref", "candidate_type"))).alias("candidates"))
    return days.filter((F.col("high_amount") > F.col("low_amount")) & (F.col("high_amount") - F.col("low_amount") > F.abs("high_amount") * F.expr("0.5bd")))


def ledger_stretches(candidates: DataFrame, accounts: DataFrame, tax_year: int, leading_zero: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """`daily_ledger` with one row for days that are alike: `date` is the first and `days` the number of them.

    An observed day is a row, as are the days that carry it, the attested zeros
    and the missing days ahead of the first; so rows grow with the observations, and
    what holds for a stretch is worked out once. Each observation lasts up
    to the next one, so only observed days are sorted; every account stands before
    its observations with a row of its own for the days ahead.
    """
    start, end = _year(tax_year)
    days = same_day_pick(candidates.filter(F.col("balance_date").between(start, end)))
    ahead = accounts.select(*KEYS).distinct()
    if leading_zero is None:
        ahead = ahead.withColumn("zero_until", F.lit(None).cast("date"))
    else:
        ahead = ahead.join(leading_zero.select(*KEYS, "zero_until"), KEYS, "left")
    money = ["native_balance"]
    if rates is not None:
        money += ["usd_micro", "usd_balance", "threshold_usd_value", "negative"]
        days = days.join(accounts.select(*KEYS, "currency").distinct(), KEYS, "left").withColumn("tax_year", F.lit(tax_year))
        for c in ("amount", "carry_amount"):
            days = to_usd(days, rates, c).select("*", F.struct(F.col(c).alias("native_balance"), *money[1:]).alias(f"{c}_money")).drop(*money[1:])
        # An attested zero is zero in any currency that has a rate or is USD.
        zeros = to_usd(accounts.select(*KEYS, "currency").distinct().withColumn("tax_year", F.lit(tax_year)).withColumn("native_balance", F.lit(0).cast("decimal(24,6)")), rates, "native_balance")
        ahead = ahead.join(zeros.select(*KEYS, "currency", F.struct(*money).alias("zero_money")), KEYS, "left")
        days = days.drop("tax_year")
    else:
        days = days.withColumn("amount_money", F.struct(F.col("amount").alias("native_balance"))).withColumn("carry_amount_money", F.struct(F.col("carry_amount").alias("native_balance")))
        ahead = ahead.withColumn("zero_money", F.struct(F.lit(0).cast("decimal(24,6)").alias("native_balance")))
    rows = days.withColumn("first", F.col("balance_date")).unionByName(ahead.withColumn("first", F.date_sub(start, 1)), allowMissingColumns=True)
    following = F.lead("first").over(W.partitionBy(*KEYS).orderBy("first"))
    rows = rows.withColumn("until", F.coalesce(F.date_sub(following, 1), end)).filter((F.col("until") >= F.col("first")) & (F.col("until") >= start))
    confidence = F.when(F.col("material_variance") & (F.col("picked_confidence") == "high"), "medium").otherwise(F.col("picked_confidence"))
    kind = F.when(F.col("candidate_type").isin(RECONSTRUCTED, PERIOD_END), F.col("candidate_type")).otherwise("transaction")
    flags = F.filter(
        F.array(
            F.when(F.col("material_variance"), F.lit("material-same-day-balance-candidates")),
            F.when(F.col("carry_amount") != F.col("amount"), F.lit("reconstructed-end-of-day-carry")),
        ),
        lambda f: f.isNotNull(),
    )
    none, no_flags = F.lit(None), F.array().cast("array<string>")
    ahead_from = F.greatest(start, F.coalesce("zero_until", start))

    def stretch(first, until, value, source, evidence, confidence, ref, flags=no_flags):
        fields = {"date": first, "days": F.datediff(until, first) + 1, "value": value, "balance_source": source, "evidence_class": evidence, "confidence": confidence, "source_ref": ref.cast("string"), "review_flags": flags}
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    observed = stretch(F.col("first"), F.col("first"), F.col("amount_money"), F.when(F.col("candidate_type") == PERIOD_END, PERIOD_END).otherwise("observed"), kind, confidence, F.col("source_ref"), flags)
    carried = stretch(F.date_add("first", 1), F.col("until"), F.col("carry_amount_money"), F.lit("carried-forward"), F.lit("carried-forward"), F.lit("medium"), F.col("carry_ref"))
    zero = stretch(start, F.least(F.date_sub(ahead_from, 1), "until"), F.col("zero_money"), F.lit("user-attested-pre-opening-zero"), F.lit("user-attested-zero"), F.lit("user-attested"), none)
    missing = stretch(ahead_from, F.col("until"), F.when(F.lit(False), F.col("zero_money")), F.lit("missing-opening-coverage"), F.lit("missing-opening"), F.lit("missing"), none)
    extra = ["currency"] if rates is not None else []
    parts = rows.select(*KEYS, *extra, F.inline(F.when(F.col("balance_date").isNotNull(), F.array(observed, carried)).otherwise(F.array(zero, missing)))).filter("days > 0")
    if rates is not None:
        extra.append(F.lit(tax_year).alias("tax_year"))
    return parts.select(*KEYS, "date", F.col("days").cast("bigint").alias("days"), *extra, *[F.col("value")[c].alias(c) for c in money], "balance_source", "evidence_class", "confidence", "source_ref", "review_flags")


def daily_ledger(candidates: DataFrame, accounts: DataFrame, tax_year: int, leading_zero: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """The account's calendar year: observed days, carried days, attested zeros and missing days before the first.

    The rows of `ledger_stretches`, spread over their days. leading_zero has
    (filer_id, account_id, zero_until): days before it and before the first
    observation are zero. With rates (and a currency per account), observations
    are converted before they are spread, as `fx.to_usd` does, so a carried value
    is not converted again every day.
    """
    rows = ledger_stretches(candidates, accounts, tax_year, leading_zero, rates)
    day = F.explode(F.sequence("date", F.expr("date_add(date, cast(days - 1 as int))"))).alias("date")
    return rows.select(*[day if c == "date" else c for c in rows.columns if c != "days"])


def _days(ledger: DataFrame) -> tuple[Column, Column]:
    """How many days a row stands for, and the last of them: more than one in `ledger_stretches`."""
    if "days" not in ledger.columns:
        return F.lit(1).cast("bigint"), F.col("date")
    return F.col("days"), F.expr("date_add(date, cast(days - 1 as int))")


def _runs(ledger: DataFrame) -> DataFrame:
    """A daily ledger with its carried days in runs, known by the observation that they carry."""
    return ledger.withColumn("run", F.sum(F.when(F.col("balance_source") == "carried-forward", 0).otherwise(1)).over(W.partitionBy(*KEYS).orderBy("date")))


def carry_gaps(ledger: DataFrame, limit: int = ROUTINE_CARRY_DAYS) -> DataFrame:
    """Runs of carried days longer than the limit, of a daily ledger or of `ledger_stretches`."""
    days, last = _days(ledger)
    carried = F.col("balance_source") == "carried-forward"
    if "days" in ledger.columns:
        return ledger.filter(carried & (days > limit)).select(*KEYS, F.col("date").alias("start"), last.alias("end"), "days")
    return _runs(ledger).filter(carried).groupBy(*KEYS, "run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days")).filter(F.col("days") > limit).drop("run")


def coverage(ledger: DataFrame, tax_year: int, limit: int = ROUTINE_CARRY_DAYS) -> DataFrame:
    """Day counts of each account, first and last observation, and carried runs, in one pass over a daily ledger or over `ledger_stretches`.

    Stretches are summed up as they are; days are put in order first, for their runs.
    """
    _, end = _year(tax_year)
    days, last = _days(ledger)
    carried = F.col("balance_source") == "carried-forward"
    observed = F.col("balance_source").isin("observed", PERIOD_END)
    flagged = F.array_contains("review_flags", "material-same-day-balance-candidates")
    counts = {
        "observed_days": observed,
        "transaction_observed_days": observed & (F.col("evidence_class") == "transaction"),
        "reconstructed_observed_days": F.col("evidence_class") == RECONSTRUCTED,
        "period_end_summary_days": F.col("evidence_class") == PERIOD_END,
        "user_attested_zero_days": F.col("evidence_class") == "user-attested-zero",
        "carried_forward_days": carried,
        "missing_days": F.col("evidence_class") == "missing-opening",
        "low_confidence_days": observed & (F.col("confidence") == "low"),
        "material_same_day_variance_days": flagged,
    }
    counted = {name: F.when(c, days).otherwise(0) for name, c in counts.items()}
    first_seen, last_seen = F.when(observed, F.col("date")), F.when(observed, last)
    if "days" in ledger.columns:
        per_run = ledger.select(*KEYS, days.alias("rows"), *[c.alias(name) for name, c in counted.items()], first_seen.alias("first_observed_date"), last_seen.alias("last_observed_date"))
    else:
        per_run = _runs(ledger).groupBy(*KEYS, "run").agg(F.sum(days).alias("rows"), *[F.sum(c).alias(name) for name, c in counted.items()], F.min(first_seen).alias("first_observed_date"), F.max(last_seen).alias("last_observed_date"))
    found = per_run.groupBy(*KEYS).agg(
        F.sum("rows").alias("calendar_days"),
        *[F.sum(c).alias(c) for c in counts],
        F.min("first_observed_date").alias("first_observed_date"),
        F.max("last_observed_date").alias("last_observed_date"),
        F.max("carried_forward_days").alias("longest_carry_run_days"),
        F.count_if(F.col("carried_forward_days") > limit).alias("carry_gaps"),
    )
    return found.withColumn("complete_year", F.col("missing_days") == 0).withColumn("trailing_carry_days", F.coalesce(F.datediff(end, "last_observed_date"), F.lit(0)).cast("bigint"))


def data_sufficiency(cover: DataFrame) -> DataFrame:
    """Which kind of evidence an account has, and whether it can carry a threshold review."""
    formal = (F.col("transaction_observed_days") > 0) | (F.col("period_end_summary_days") > 0)
    profile = (
        F.when((F.col("reconstructed_observed_days") > 0) & formal, "mixed-formal-and-reconstructed")
        .when(F.col("reconstructed_observed_days") > 0, RECONSTRUCTED)
        .when((F.col("transaction_observed_days") > 0) & (F.col("period_end_summary_days") > 0), "mixed-transaction-and-period-end")
        .when(F.col("transaction_observed_days") > 0, "transaction-rows")
        .when(F.col("period_end_summary_days") > 0, "period-end-only")
        .otherwise("no-balance-observations")
    )
    reasons = F.filter(
        F.array(
            F.when(F.col("evidence_profile") == "period-end-only", F.lit("period-end-only")),
            F.when(F.col("observed_days") == 0, F.lit("no-balance-observations")),
            F.when(F.col("missing_days") > 0, F.lit("missing-opening-coverage")),
            F.when(F.col("carry_gaps") > 0, F.lit("long-carry-forward-gap")),
        ),
        lambda c: c.isNotNull(),
    )
    short = (F.col("missing_days") > 0) | (F.col("carry_gaps") > 0) | (F.col("observed_days") == 0)
    return cover.withColumn("evidence_profile", profile).select(
        *KEYS,
        "evidence_profile",
        F.when(short, "insufficient-records").otherwise("review-required").alias("daily_threshold_answer"),
        F.when(short, "not-determinable").otherwise("review-required").alias("maximum_value_answer"),
        reasons.alias("reason_codes"),
    )


def review_summary(ledger: DataFrame) -> DataFrame:
    """Flagged days by account and kind of flag, of a daily ledger or of `ledger_stretches`."""
    days, last = _days(ledger)
    flagged = ledger.select(*KEYS, "date", last.alias("last"), days.alias("days"), F.explode("review_flags").alias("code"))
    return flagged.groupBy(*KEYS, "code").agg(F.sum("days").alias("days"), F.min("date").alias("first_date"), F.max("last").alias("last_date"))


def evidence_class(candidates: DataFrame, accounts: DataFrame, failed: DataFrame | None = None, opening_attested: DataFrame | None = None) -> DataFrame:
    """Per account: reconstructed before attested opening with formal rows before formal before none, and its status.

    failed has accounts with a page that did not reconcile or had rows but no
    extracted balances; opening_attested those with an attested opening.
    """
    seen = candidates.groupBy(*KEYS).agg(F.count("*").alias("observations"), F.bool_or(F.col("candidate_type") == RECONSTRUCTED).alias("reconstructed"))
    rows = accounts.select(*KEYS).join(seen, KEYS, "left")
    for side, name in ((failed, "defect"), (opening_attested, "opening")):
        rows = rows.withColumn(name, F.lit(False)) if side is None else rows.join(side.select(*KEYS).distinct().withColumn(name, F.lit(True)), KEYS, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    known = F.coalesce("observations", F.lit(0)) > 0
    cls = F.when(~known, "unresolved-no-observations").when(F.col("reconstructed"), RECONSTRUCTED).when(F.col("opening"), "formal-with-attested-opening").otherwise("formal-extracted")
    return rows.select(*KEYS, F.coalesce("observations", F.lit(0)).cast("bigint").alias("observations"), cls.alias("evidence_class"), F.when(F.col("defect"), "parser-coverage-defect").otherwise("extracted").alias("status"))


#: Rows of a page that one window takes; rows of a longer one that are summed up together.
MAX_PAGE, RUN = 100_000, 4096


def reconcile_movements(movements: DataFrame, checkpoints: DataFrame, currency: str = "USD", max_page: int = MAX_PAGE) -> tuple[DataFrame, DataFrame]:
    """Running balances of pages whose movements lead from opening to closing, and a report row for every page.

    The sums come first, so pages that fail never reach the running window. A page of over
    MAX_PAGE rows is summed up by day and run of rows before, so no task has to hold it.
    """
    slack = "0.0005" if currency in THREE_DECIMALS else "0.005"
    sums = movements.groupBy("page_key").agg(F.sum("credit").alias("credits"), F.sum("debit").alias("debits"), F.count("*").alias("rows"))
    pages = checkpoints.join(sums, "page_key", "left").withColumn("computed", F.col("opening") + F.coalesce("credits", F.lit(0)) - F.coalesce("debits", F.lit(0)))
    report = pages.select("page_key", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), "opening", "closing", "computed", (F.abs(F.col("computed") - F.col("closing")) <= F.expr(f"{slack}bd")).alias("passed"))
    report = materialize(report, "reconcile-report")
    change = F.col("credit") - F.col("debit")
    order = W.partitionBy("page_key").orderBy("movement_date", "row_number").rowsBetween(W.unboundedPreceding, 0)
    good = movements.join(report.filter("passed").select("page_key", "opening", F.col("rows").alias("_rows")), "page_key")
    rows = good.filter(F.col("_rows") <= max_page).select("page_key", "movement_date", "row_number", (F.col("opening") + F.sum(change).over(order)).alias("balance"))
    if not report.filter(F.col("passed") & (F.col("rows") > max_page)).isEmpty():
        large = good.filter(F.col("_rows") > max_page).withColumn("_run", F.struct("movement_date", F.expr(f"row_number div {RUN}")))
        large = running_total(large, ["page_key"], "_run", [F.col("movement_date"), F.col("row_number")], change, "_before")
        rows = rows.unionByName(large.select("page_key", "movement_date", "row_number", (F.col("opening") + F.col("_before") + change).alias("balance")))
    return rows.withColumn("candidate_type", F.lit(RECONSTRUCTED)), report


def signed_movements(rows: DataFrame, amount: str = "amount") -> DataFrame:
    """A signed amount column as debit and credit."""
    zero = F.lit(0).cast(rows.schema[amount].dataType)
    return rows.withColumn("debit", F.when(F.col(amount) < 0, -F.col(amount)).otherwise(zero)).withColumn("credit", F.when(F.col(amount) > 0, F.col(amount)).otherwise(zero))


def attested_ledger(attestations: DataFrame, tax_year: int, daily: DataFrame | None = None) -> DataFrame:
    """Ledger rows from attestations: zero for every day of the year, or the rows of a full daily table; an annual maximum has none."""
    start, end = _year(tax_year)
    zero = attestations.filter("evidence_class = 'user-attested-zero'").withColumn("date", F.explode(F.sequence(start, end)))
    rows = zero.select(*KEYS, "date", F.lit(0).cast("decimal(24,6)").alias("native_balance"), F.lit("user-attested-zero").alias("evidence_class"))
    if daily is not None:
        rows = rows.unionByName(daily.select(*KEYS, "date", "native_balance", F.lit("user-attested-daily").alias("evidence_class")))
    return rows


def value_models(attestations: DataFrame) -> DataFrame:
    """Accounts known by their annual maximum only."""
    model = F.struct(F.lit("annual-maximum").alias("type"), F.col("maximum_native"), F.col("maximum_date"))
    return attestations.filter("evidence_class = 'user-attested-maximum'").select(*KEYS, model.alias("value_model"))


def account_id(rows: DataFrame, institution: str = "institution", hint: str = "hint", year: str = "tax_year") -> DataFrame:
    """A stable slug: institution or hint, and the hint's last four characters or the year."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    has_hint = F.coalesce(F.length(F.trim(hint)), F.lit(0)) > 0
    named = F.when(F.coalesce(F.length(F.trim(institution)), F.lit(0)) > 0, F.col(institution)).when(has_hint, F.col(hint)).otherwise("account")
    return rows.withColumn("account_id", F.concat_ws("-", plain(named), F.when(has_hint, plain(F.substring(hint, -4, 4))).otherwise(F.col(year).cast("string"))))
