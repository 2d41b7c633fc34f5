"""Exchange rates: matching source rows to codes, rate pairs, and exact conversion to USD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Label words that are read as one (fixed values).
SAME_WORDS = {"rep": "republic", "dem": "democratic", "st": "saint", "is": "islands", "fed": "federal", "n": "north"}
MAX_DRIFT = "0.000001"


def _tokens(label: Column, policy: str) -> Column:
    """Lower-case words of a label; year_end drops brackets and the word new, and reads short forms."""
    plain = F.lower(F.coalesce(label, F.lit("")))
    if policy == "year_end":
        plain = F.regexp_replace(plain, r"\([^)]*\)", " ")
    words = F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    if policy != "year_end":
        return words
    short = F.create_map(*[F.lit(x) for pair in SAME_WORDS.items() for x in pair])
    return F.filter(F.transform(words, lambda w: F.coalesce(short[w], w)), lambda w: w != "new")


def label_match(a: Column, b: Column, policy: str) -> Column:
    """Whether the words of two labels pair up one to one, a word of three letters or more also with one that it begins.

    year_end: both have equally many words. yearly: all words of the shorter one find a partner.
    """
    x, y = _tokens(a, policy), _tokens(b, policy)
    few, many = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    alike = lambda p, q: (p == q) | ((F.least(F.length(p), F.length(q)) >= 3) & (p.startswith(q) | q.startswith(p)))
    step = lambda acc, w: F.when(acc["ok"] & (F.size(F.filter(acc["left"], lambda v: alike(w, v))) > 0), F.struct(F.lit(True).alias("ok"), _without(acc["left"], w, alike).alias("left"))).otherwise(F.struct(F.lit(False).alias("ok"), acc["left"].alias("left")))
    paired = F.aggregate(few, F.struct(F.lit(True).alias("ok"), many.alias("left")), step, lambda acc: acc["ok"]) & (F.size(few) > 0)
    return paired & (F.size(x) == F.size(y)) if policy == "year_end" else paired


def _without(words: Column, w: Column, alike) -> Column:
    """The words without the first that pairs with w; an equal word goes first."""
    equal = F.array_position(words, w)
    at = F.when(equal > 0, equal).otherwise(F.array_position(F.transform(words, lambda v: alike(w, v)), True))
    return F.filter(words, lambda v, i: i + 1 != at)


def _label_pairs(rows: DataFrame, rate_map: DataFrame, policy: str) -> DataFrame:
    """(country, currency, code) of every distinct label pair of the rows and the codes that it matches.

    Words that pair up begin with the same three letters (or are one short word),
    so labels meet on those of their countries' words, never all with all.
    """
    beginnings = lambda c: F.explode(F.array_distinct(F.transform(_tokens(F.col(c), policy), lambda w: F.substring(w, 1, 3))))
    labels = rows.select("country", "currency").distinct().select("*", beginnings("country").alias("_k"))
    known = rate_map.select("code", F.col("country").alias("map_country"), F.col("currency").alias("map_currency")).distinct().select("*", beginnings("map_country").alias("_k"))
    met = labels.join(known, "_k").drop("_k").distinct()
    return met.filter(label_match(F.col("country"), F.col("map_country"), policy) & label_match(F.col("currency"), F.col("map_currency"), policy)).select("country", "currency", "code").distinct()


def year_end_rate(rates: DataFrame, rate_map: DataFrame, year: int, today=None) -> tuple[DataFrame, DataFrame]:
    """The rate of each code on 31 December: one row per code whose matching rows agree; other codes as violations.

    rate_map has code, country, currency, one row per accepted label pair.
    """
    close = rates.filter(F.col("record_date") == F.lit(f"{year}-12-31").cast("date"))
    hits = close.join(_label_pairs(close, rate_map, "year_end"), ["country", "currency"])
    by_code = hits.groupBy("code").agg(F.countDistinct("exchange_rate").alias("rates"), F.count("*").alias("rows"), F.min_by("exchange_rate", F.struct("country", "currency")).alias("foreign_per_usd"))
    over = F.lit(f"{year}-12-31").cast("date") < F.coalesce(F.lit(today), F.current_date())
    found = by_code.filter((F.col("rates") == 1) & over).select("code", "foreign_per_usd", (F.col("rows") - 1).alias("duplicates"))
    bad = rate_map.select("code").distinct().join(by_code, "code", "left").withColumn("over", over)
    reason = F.when(~F.col("over"), "year-not-over").when(F.col("rows").isNull(), "map-has-no-matching-row").when(F.col("rates") > 1, "conflicting-rates")
    return found, bad.select(F.col("code").alias("entity"), reason.alias("code")).filter("code is not null")


def rate_map_check(rates: DataFrame, rate_map: DataFrame, exceptions: DataFrame, year: int) -> DataFrame:
    """Every rate row of 31 December as mapped, a listed exception, or unexplained."""
    close = rates.filter(F.col("record_date") == F.lit(f"{year}-12-31").cast("date"))
    mapped = close.join(_label_pairs(close, rate_map, "year_end"), ["country", "currency"], "left")
    codes = mapped.groupBy("country", "currency", "exchange_rate").agg(F.min("code").alias("code"))
    listed = exceptions.select("country", "currency").distinct().withColumn("listed", F.lit(True))
    found = codes.join(listed, ["country", "currency"], "left")
    kind = F.when(F.col("code").isNotNull(), "mapped").when(F.col("listed"), "exception").otherwise("unexplained")
    return found.select("country", "currency", "exchange_rate", "code", kind.alias("class"))


def rate_code_presence(rates: DataFrame, rate_map: DataFrame, year: int, codes: DataFrame | None = None) -> DataFrame:
    """For every code of the map, or of `codes`: whether one of its label pairs matches a row of 31 December, how many do, and the first of them by label.

    A code that the map lacks is unknown; one that it has without a matching row asks for maintenance of the map.
    """
    close = rates.filter(F.col("record_date") == F.lit(f"{year}-12-31").cast("date"))
    hits = close.join(_label_pairs(close, rate_map, "year_end"), ["country", "currency"]).groupBy("code").agg(F.count("*").alias("rows"), F.min(F.struct("country", "currency")).alias("_first"))
    mapped = rate_map.select("code").distinct().withColumn("_mapped", F.lit(True))
    wanted = mapped.select("code") if codes is None else codes.select("code").distinct()
    found = wanted.join(mapped, "code", "left").join(hits, "code", "left")
    status = F.when(F.col("_mapped").isNull(), "no-mapping-known").when(F.col("rows").isNull(), "map-maintenance-required").otherwise("mapped-row-found")
    return found.select("code", status.alias("status"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), F.concat_ws("-", "_first.country", "_first.currency").alias("row_label"))


#: Decimal places of stored rates.
RATE_PLACES = 12


def rate_pair(rates: DataFrame, rate: str = "rate", direction: str = "rate_direction") -> DataFrame:
    """Both directions of a rate at 12 places; the reciprocal is taken of the whole rate and rounded once.

    A rate that is null, not positive, or whose reciprocal takes over 14 digits before the point has none.
    """
    whole = F.col(rate).try_cast("decimal(26,12)")
    back = F.expr(f"try_cast(round(if({rate} > 0, try_divide(cast(1 as decimal(2,0)), try_cast({rate} as decimal(24,12))), null), {RATE_PLACES}) as decimal(26,12))")
    forward = F.col(direction) == "foreign_per_usd"
    return rates.withColumn("foreign_per_usd", F.when(forward, whole).otherwise(back)).withColumn("usd_per_foreign", F.when(forward, back).otherwise(whole))


def check_rate_pair(rows: DataFrame, currency: Column | None = None, year: Column | None = None) -> DataFrame:
    """One row per failed check of a rate record: positive, reciprocal, declared side, currency and year."""
    drift = F.abs(F.col("foreign_per_usd").cast("double") * F.col("usd_per_foreign").cast("double") - 1)
    reasons = [
        F.when(~(F.coalesce(F.col("foreign_per_usd") > 0, F.lit(False)) & F.coalesce(F.col("usd_per_foreign") > 0, F.lit(False))), F.lit("rate-not-positive")),
        F.when(drift > float(MAX_DRIFT), F.lit("rates-not-reciprocal")),
    ]
    if "rate" in rows.columns:
        side = F.when(F.col("rate_direction") == "foreign_per_usd", F.col("foreign_per_usd")).otherwise(F.col("usd_per_foreign"))
        reasons.append(F.when(F.col("rate") != side, F.lit("declared-rate-differs")))
    if currency is not None:
        reasons.append(F.when(F.col("currency") != currency, F.lit("currency-differs")))
    if year is not None:
        reasons.append(F.when(F.col("rate_year") != year, F.lit("year-differs")))
    return rows.withColumn("code", F.explode(F.filter(F.array(*reasons), lambda r: r.isNotNull()))).select("currency", "rate_year", "code")


def _divided(native: str, foreign_per_usd: str) -> str:
    """USD at six places, half up: by whole numbers, of which none is rounded before, up to 10**12 on both sides; by wide decimals beyond, null over 18 digits."""
    a, r = f"cast(abs({native}) * 1000000 as decimal(18,0))", f"cast({foreign_per_usd} * 1000000000000bd as decimal(26,0))"
    whole = f"cast(sign({native}) as bigint) * ((2000000000000bd * {a} + {r}) div (2 * {r}))"
    small = f"abs({native}) < 1000000000000bd and abs({native}) < 1000000000000bd * {foreign_per_usd}"
    wide = f"try_cast(round(try_divide(cast({native} as decimal(24,6)), {foreign_per_usd}), 6) as decimal(24,6))"
    return f"if({small}, cast(({whole}) * 0.000001bd as decimal(24,6)), {wide})"


def _multiplied(native: str, usd_per_foreign: str) -> str:
    """USD at six places, half up; null beyond 18 digits before the point."""
    return f"try_cast(round(try_multiply(cast({native} as decimal(24,6)), {usd_per_foreign}), 6) as decimal(24,6))"


def to_usd(rows: DataFrame, rates: DataFrame, native: str = "native_balance", filtered: bool = False) -> DataFrame:
    """Adds usd_micro (whole millionths), usd_balance (two places), threshold_usd_value (six, 0 at least) and negative.

    USD passes through; others divide by foreign_per_usd of their year, or multiply by usd_per_foreign
    where only that is given. Rows without a rate keep null, as do values beyond 18 digits before the
    point; `unconverted` lists both. If the result is to be filtered by its USD columns, say so: a filter is moved ahead
    of the columns that it names, with their expressions in it, so the division would be made for each mention. Behind a
    generator of one element it is made once a row.
    """
    side = rates.select(F.col("currency").alias("_cur"), F.col("rate_year").alias("_year"), F.col("foreign_per_usd").try_cast("decimal(26,12)").alias("_div"), F.col("usd_per_foreign").try_cast("decimal(26,12)").alias("_mul"))
    joined = rows.join(side, (F.col("currency") == F.col("_cur")) & (F.col("tax_year") == F.col("_year")), "left")
    exact = F.expr(f"cast({native} as decimal(24,6))")
    unit = F.when(F.col("currency") == "USD", exact).when(F.col("_div") > 0, F.expr(_divided(native, "_div"))).when(F.col("_mul") > 0, F.expr(_multiplied(native, "_mul")))
    out = joined.select("*", (F.explode(F.array(unit)) if filtered else unit).alias("_usd")).drop("_cur", "_year", "_div", "_mul")
    out = out.withColumn("usd_micro", F.expr("cast(_usd * 1000000 as decimal(30,0))"))
    zero = F.lit(0).cast("decimal(24,6)")
    return out.withColumn("usd_balance", F.round("_usd", 2)).withColumn("threshold_usd_value", F.when(F.col("_usd").isNotNull(), F.greatest("_usd", zero))).withColumn("negative", F.coalesce(F.col(native) < 0, F.lit(False))).drop("_usd")


def unconverted(rows: DataFrame, key: str, native: str = "native_balance") -> DataFrame:
    """Converted rows that have an amount but no USD, as violations."""
    lost = rows.filter(F.col(native).isNotNull() & F.col("threshold_usd_value").isNull())
    return lost.select(F.col(key).alias("entity"), F.lit("not-converted").alias("code"), F.concat_ws(" ", F.col(native).cast("string"), "currency").alias("detail"))


def spot_usd(rows: DataFrame, spot: DataFrame, direction: str = "foreign_per_usd") -> tuple[DataFrame, DataFrame]:
    """Dated amounts at the rate posted for their day, and a violation for each row without date or rate; no other day's rate is taken."""
    side = spot.select(F.col("currency").alias("_cur"), F.col("rate_date").alias("_day"), F.col("rate").alias("spot_rate"))
    joined = rows.join(side, (F.col("currency") == F.col("_cur")) & (F.col("event_date") == F.col("_day")), "left").drop("_cur", "_day")
    usd = F.expr(_divided("amount", "spot_rate") if direction == "foreign_per_usd" else _multiplied("amount", "spot_rate"))
    good = joined.filter(F.col("spot_rate").isNotNull()).withColumn("usd", usd)
    bad = joined.filter(F.col("spot_rate").isNull()).select("event_id", F.when(F.col("event_date").isNull(), "missing-date").otherwise("missing-spot-rate").alias("code"))
    return good, bad


def yearly_rate(rates: DataFrame, rate_map: DataFrame, year: int, today=None) -> tuple[DataFrame, DataFrame]:
    """The yearly average of each code by its first matching row of a completed year; other codes as violations."""
    of_year = rates.filter((F.col("year") == year) & F.col("rate").isNotNull())
    hits = of_year.join(_label_pairs(of_year, rate_map, "yearly"), ["country", "currency"])
    over = F.lit(year) < F.year(F.coalesce(F.lit(today), F.current_date()))
    found = hits.filter(over).groupBy("code").agg(F.min_by("rate", F.struct("country", "currency")).alias("foreign_per_usd"))
    missing = rate_map.select("code").distinct().join(found.select("code"), "code", "left_anti")
    return found, missing.select(F.col("code").alias("entity"), F.when(over, "no-rate-for-year").otherwise("year-not-completed").alias("code"))


def check_rate_source(rows: DataFrame, kind: str, title: str = "title") -> DataFrame:
    """Rate records whose source wording contradicts their kind: averages as year-end rates, own averages, year-end rates as averages."""
    t = F.lower(title)
    own = t.rlike(r"self[- ]?(calculated|computed)|own average|calculated average")
    code = F.when(own, "self-calculated-average")
    code = code.when(t.rlike(r"\baverage\b|\bmean\b"), "average-as-year-end") if kind == "year_end" else code.when(t.rlike(r"year[- ]end|december 31|31 december"), "year-end-as-average")
    return rows.withColumn("code", code).filter("code is not null")


def unpivot_year_rates(wide: DataFrame, year_columns: list[str]) -> DataFrame:
    """(country, currency, y2022, y2023, ...) -> (country, currency, year, rate); commas as decimal signs are read."""
    text = wide.select("country", "currency", *[F.col(c).cast("string").alias(c) for c in year_columns])
    long = text.unpivot(["country", "currency"], year_columns, "column", "value")
    number = F.regexp_replace(F.regexp_replace("value", r"\.(?=\d{3}(?:\D|$).*,)", ""), ",", ".")
    return long.select("country", "currency", F.regexp_extract("column", r"(\d{4})", 1).cast("int").alias("year"), number.try_cast("decimal(14,6)").alias("rate")).filter("rate is not null")


def newest(rates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key."""
    return rates.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).filter("_r = 1").drop("_r")
