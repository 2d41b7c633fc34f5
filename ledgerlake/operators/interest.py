"""Interest income from statement lines: classification, amounts, totals, review states and USD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import fx, text

# Terms that speak for and against interest income; matching is by substring.
POSITIVE = (
    "interest credited", "interest credit", "interest earned", "credit interest", "deposit interest", "savings interest", "interest income",
    "interest paid to you", "intereses acreditados", "interes acreditado", "intereses abonados", "intereses ganados", "rendimientos", "rendimento",
    "juros creditados", "juros recebidos", "zinsen", "zinsertrag", "interet credite", "interets credites", "interet gagne", "renteinntekt",
    "rente indtaegt", "faiz geliri", "bunga diterima",
)
GENERIC = ("interest", "interes", "intereses", "interesse", "interet", "interets", "juros", "zins", "zinsen", "rente", "faiz", "bunga")
EXCLUDED = (
    "interest charged", "debit interest", "overdraft interest", "loan interest", "margin interest", "credit card interest", "interest expense",
    "interest fee", "fee", "charge", "charged", "commission", "comision", "comissao", "cargo", "cobro", "debito", "debit", "impuesto", "tax",
    "withholding", "withheld", "retencion", "retencao", "iva", "vat",
)


def _any(terms: tuple[str, ...]) -> str:
    return "|".join(sorted(terms, key=len, reverse=True))


def classify_interest(line: Column) -> Column:
    """interest-positive, interest-generic, excluded or none; a term against wins. Matching is by substring, so coffee holds fee."""
    return text._let(text.normalize_text(line, "ascii_fold"), _kind)


def _kind(folded: Column) -> Column:
    named = folded.rlike(_any(POSITIVE + GENERIC))
    return F.when(folded.rlike(_any(EXCLUDED)), F.when(named, "excluded").otherwise("none")).when(folded.rlike(_any(POSITIVE)), "interest-positive").when(named, "interest-generic").otherwise("none")


def interest_amount(line: Column, stated_zero: bool = False) -> Column:
    """The first positive amount from the end of the earliest interest term on, else the first positive one; null if there is none.

    With stated_zero, a line that shows an amount of zero, and none above it, has that amount.
    """
    folded = F.translate(F.lower(line), text.ACCENTED, text.PLAIN)
    end = F.length(F.regexp_extract(folded, f"^(.*?(?:{_any(POSITIVE + GENERIC)}))", 1))
    shown = F.filter(text.money_tokens(line, "interest"), lambda t: t["amount"] >= 0)

    def pick(v: Column) -> Column:
        good = F.filter(v["shown"], lambda t: t["amount"] > 0)
        picked = F.coalesce(F.try_element_at(F.filter(good, lambda t: t["position"] > v["end"]), F.lit(1)), F.try_element_at(good, F.lit(1)))
        return (F.coalesce(picked, F.try_element_at(v["shown"], F.lit(1))) if stated_zero else picked)["amount"]

    return text._let(F.struct(shown.alias("shown"), end.alias("end")), pick)


def interest_rows(lines: DataFrame, tax_year: int, currency: str = "currency", line: str = "line", day_first: Column | None = None, stated_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """Interest rows of the tax year, and lines with an interest term that are left out: clearly other, without amount, or of another year.

    stated_zero: an amount of zero, if it is all that a line shows, is its amount (`interest_amount`).
    """
    day = F.try_element_at(text.date_tokens(F.col(line), "interest", day_first), F.lit(1))["date"]
    parsed = F.struct(classify_interest(F.col(line)).alias("kind"), day.alias("event_date"), interest_amount(F.col(line), stated_zero).alias("amount"))
    # A generator keeps filters on the parsed columns from parsing the line a second time.
    rows = lines.filter(text.normalize_text(F.col(line), "ascii_fold").rlike(_any(POSITIVE + GENERIC))).select("*", F.inline(F.array(parsed))).filter("kind <> 'none'")
    reason = F.when(F.col("kind") == "excluded", "clear-non-interest").when(F.col("amount").isNull(), "no-positive-amount").when(F.year("event_date") != tax_year, "date-outside-year")
    rows = rows.withColumn("reason", reason)
    keep = [c for c in lines.columns if c != line]
    good = rows.filter("reason is null").select(*keep, "event_date", "amount", F.when(F.col("kind") == "interest-positive", "high").otherwise("medium").alias("confidence"))
    bad = rows.filter("reason is not null").select(*keep, "reason", (F.col("reason") != "clear-non-interest").alias("requires_review"), F.col(line).alias("line"))
    return good, bad


def interest_scope_check(files: DataFrame, rows: DataFrame, tax_year: int, key: str = "file_id") -> DataFrame:
    """Files with a statement or row year other than the tax year, or whose text and path lack the institution's label, as violations."""
    others = rows.filter(F.year("event_date") != tax_year).select(key).distinct().withColumn("_row", F.lit(True))
    both = files.join(others, key, "left")
    years = F.size(F.array_except("statement_years", F.array(F.lit(tax_year)))) > 0
    absent = ~F.coalesce(F.lower("text").contains(F.lower("institution")), F.lit(False)) & ~F.coalesce(F.lower("path").contains(F.lower("institution")), F.lit(False)) & ~F.coalesce("reviewed", F.lit(False))
    codes = F.filter(F.array(F.when(F.coalesce(years, F.lit(False)), F.lit("statement-year-differs")), F.when(F.col("_row"), F.lit("row-year-differs")), F.when(absent, F.lit("institution-not-found"))), lambda c: c.isNotNull())
    return both.select(F.col(key).alias("entity"), F.explode(codes).alias("code"))


def interest_totals(rows: DataFrame, key: str = "filer_id") -> DataFrame:
    """Totals by currency at two places, and what blocks a report: an unknown currency with money, or more than one currency."""
    sums = rows.groupBy(key, F.coalesce("currency", F.lit("UNKNOWN")).alias("currency")).agg(F.round(F.sum("amount"), 2).alias("total"), F.count("*").alias("rows"))
    kinds = sums.groupBy(key).agg(F.count("*").alias("_k"), F.bool_or((F.col("currency") == "UNKNOWN") & (F.col("total") != 0)).alias("_u"))
    return sums.join(kinds, key).select(key, "currency", "total", "rows", F.when(F.col("_u"), "unknown-currency").when(F.col("_k") > 1, "mixed-currencies").alias("blocked"))


def interest_review_state(entities: DataFrame, rows: DataFrame, excluded: DataFrame, key: str = "filer_id") -> DataFrame:
    """review-required with an unresolved ambiguous line, else ready with rows, else zero-confirmation-required."""
    n = rows.groupBy(key).agg(F.count("*").alias("rows"))
    open_ = excluded.filter("requires_review").groupBy(key).agg(F.count("*").alias("open"))
    both = entities.select(key).distinct().join(n, key, "left").join(open_, key, "left").na.fill(0, ["rows", "open"])
    return both.select(key, "rows", "open", F.when(F.col("open") > 0, "review-required").when(F.col("rows") > 0, "ready").otherwise("zero-confirmation-required").alias("state"))


def interest_usd(rows: DataFrame, rates: DataFrame, method: str, tax_year: int, key: str = "filer_id") -> DataFrame:
    """Totals in USD: each row at its day's rate (spot), or the total at the year's rate (yearly); rounded last."""
    if method == "spot":
        good, _ = fx.spot_usd(rows, rates)
        return good.groupBy(key, "currency").agg(F.round(F.sum("usd"), 2).alias("usd"))
    if method != "yearly":
        raise ValueError(f"unknown method {method}")
    sums = rows.groupBy(key, "currency").agg(F.sum("amount").cast("decimal(24,6)").alias("native_balance")).withColumn("tax_year", F.lit(tax_year))
    return fx.to_usd(sums, rates).select(key, "currency", F.col("usd_balance").alias("usd"))


def _digest(excluded: DataFrame, key: str) -> DataFrame:
    fields = [c for c in sorted(excluded.columns) if c != key]
    return excluded.groupBy(key).agg(F.count("*").alias("count"), F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))), 256).alias("digest"))


def bind_resolution(excluded: DataFrame, resolutions: DataFrame, key: str = "filer_id") -> DataFrame:
    """Whether a reviewer's decision is about exactly the excluded lines: their number and the SHA-256 of their canonical JSON."""
    both = _digest(excluded, key).join(resolutions.select(key, F.col("count").alias("_n"), F.col("digest").alias("_d")), key, "full")
    reason = F.when(F.col("_n").isNull(), "not-resolved").when(F.col("count").isNull(), "nothing-excluded").when(F.col("count") != F.col("_n"), "count-differs").when(F.col("digest") != F.col("_d"), "digest-differs")
    return both.select(key, reason.isNull().alias("valid"), reason.alias("reason"))
