"""Typed columns from statement text lines: amounts, dates, currencies, account numbers, years, periods and balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Accented letters and what they fold to; month names in English and Spanish; terms.
ACCENTED, PLAIN = "áàâäãéèêëíïóôöõúüñçø", "aaaaaeeeeiioooouunco"
MONTHS = {
    "jan": 1, "january": 1, "ene": 1, "enero": 1, "feb": 2, "february": 2, "febrero": 2, "mar": 3, "march": 3, "marzo": 3,
    "apr": 4, "april": 4, "abr": 4, "abril": 4, "may": 5, "mayo": 5, "jun": 6, "june": 6, "junio": 6, "jul": 7, "july": 7, "julio": 7,
    "aug": 8, "august": 8, "ago": 8, "agosto": 8, "sep": 9, "sept": 9, "september": 9, "septiembre": 9, "oct": 10, "october": 10, "octubre": 10,
    "nov": 11, "november": 11, "noviembre": 11, "dec": 12, "december": 12, "dic": 12, "diciembre": 12,
}
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
BALANCE_TERMS = ("balance", "saldo")
FEE_TERMS = ("fee", "interest", "tax", "interes", "impuesto", "comision")
CODES = ("AED", "ARS", "AUD", "BRL", "CAD", "CHF", "CLP", "CNY", "COP", "CZK", "DKK", "EUR", "GBP", "HKD", "ILS", "INR", "JPY", "KRW", "KWD", "MXN", "NOK", "NZD", "PEN", "PLN", "SEK", "SGD", "THB", "TRY", "USD", "ZAR")
SYMBOLS = {"US$": "USD", "R$": "BRL", "S/": "PEN", "€": "EUR", "£": "GBP", "¥": "JPY"}

#: A number: digits in threes behind one and the same mark throughout, digits in the lakh manner (twos, then three), or
#: digits alone; then a decimal tail. A group or tail that more digits follow is none, so the shorter reading is tried.
_GROUPS = r"\d{1,3}(?<mark>[.,'’ \u00a0])\d{3}(?:\k<mark>\d{3})*+(?!\d)|\d{1,2}(?:,\d{2})++,\d{3}(?!\d)"
_TAIL = r"[.,]\d{1,6}(?!\d)"
_NUMBER = rf"(?:(?:{_GROUPS}|\d++)(?:{_TAIL})?|{_TAIL})"
#: What may stand around it: a bracket or a sign, then a currency sign; after it a bracket or a sign.
_BEFORE, _AFTER = r"\(?\s?[-−]?(?:[$€£¥]\s*+)?", r"(?:\s?\))?[-−]?"
MONEY = rf"(?<![A-Za-z0-9#]){_BEFORE}{_NUMBER}{_AFTER}(?![A-Za-z0-9#])"
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
ISO = r"(?<!\d)(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?!\d)"
NUMERIC = r"(?<![\d/.-])(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?![\d/])"
NAMED = rf"(?i)(?<![a-z0-9])(\d{{1,2}})(?: de)?[ -]({_MONTH})\.?(?: de| del)?[ ,-]+(\d{{4}})(?!\d)"
NAMED_US = rf"(?i)(?<![a-z])({_MONTH})\.? (\d{{1,2}}),? (\d{{4}})(?!\d)"


@F.pandas_udf(T.StringType())
def _nfkc(s):
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_text(c: Column, mode: str) -> Column:
    """collapse: white space; ascii_fold: lower case without accents; nfkc: footnote digits go first, then compatibility forms."""
    tidy = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    if mode == "collapse":
        return tidy(c)
    if mode == "ascii_fold":
        return tidy(F.translate(F.lower(c), ACCENTED, PLAIN))
    if mode == "nfkc":
        return tidy(_nfkc(F.translate(c, SUPERSCRIPTS, "")))
    raise ValueError(f"unknown mode {mode}")


def _number(text: Column) -> Column:
    return text.try_cast("decimal(24,6)")


def parse_amount(token: Column, policy: str) -> Column:
    """struct<amount, ambiguous> of one money token; amount is null if there is none.

    balance: of two kinds of separators the last is the decimal sign; a repeated one groups; a
    single one with a tail of three digits groups (ambiguous) unless the head is empty, 0 or
    longer than three digits (then a decimal sign, ambiguous if longer). interest: a comma with a
    tail of two or three digits is a decimal sign, as is a point; DR is negative; 20xx alone and
    amounts from 10**12 are none.
    """
    if policy not in ("balance", "interest"):
        raise ValueError(f"unknown policy {policy}")
    raw = F.trim(token)
    digits = F.regexp_replace(raw, r"(?U)[A-Za-z$€£¥()\s'’+]", "")
    return _let(F.struct(raw.alias("raw"), digits.alias("digits")), lambda v: _let(_parts(v["raw"], v["digits"]), _BALANCE if policy == "balance" else _INTEREST))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(raw: Column, digits: Column) -> Column:
    bare = F.regexp_replace(digits, "[-−]", "")
    one = F.translate(bare, ",", ".")
    return F.struct(
        raw.alias("raw"),
        bare.alias("bare"),
        (digits.rlike(r"^[-−]|[-−]$") | raw.rlike(r"^\(.*\)$")).alias("minus"),
        F.length(F.translate(bare, "0123456789.", "")).alias("commas"),
        F.length(F.translate(bare, "0123456789,", "")).alias("dots"),
        one.alias("one"),
        F.substring_index(one, ".", 1).alias("head"),
        F.substring_index(one, ".", -1).alias("tail"),
        F.substring_index(bare, ",", -1).contains(".").alias("dot_last"),
    )


def _mixed(v: Column) -> Column:
    """Both separators: the last one is the decimal sign."""
    return F.when(v["dot_last"], F.translate(v["bare"], ",", "")).otherwise(F.translate(F.translate(v["bare"], ".", ""), ",", "."))


def _BALANCE(v: Column) -> Column:  # noqa: N802
    both, some, tail, head = (v["commas"] > 0) & (v["dots"] > 0), v["commas"] + v["dots"], v["tail"], v["head"]
    as_decimal = F.concat(F.when(head == "", "0").otherwise(head), F.lit("."), tail)
    single = F.when(some > 1, F.translate(v["one"], ".", "")).when((F.length(tail) != 3) | head.isin("", "0") | (F.length(head) > 3), as_decimal).otherwise(F.concat(head, tail))
    value = _number(F.when(both, _mixed(v)).when(some > 0, single).otherwise(v["bare"]))
    unclear = ~both & (some == 1) & (F.length(tail) == 3) & ~head.isin("", "0")
    spaced = v["raw"].rlike("\\d[ \u00a0]\\d") & ~v["raw"].rlike("[.,]")
    return F.struct(F.when(v["minus"], -value).otherwise(value).alias("amount"), (unclear | spaced).alias("ambiguous"))


def _INTEREST(v: Column) -> Column:  # noqa: N802
    tail = F.length(v["tail"])
    single = F.when(v["commas"] > 0, F.when(tail.isin(2, 3), v["one"]).otherwise(F.translate(v["bare"], ",", ""))).when((v["dots"] > 0) & ~tail.isin(2, 3), F.translate(v["bare"], ".", "")).otherwise(v["bare"])
    text = F.regexp_replace(F.when((v["commas"] > 0) & (v["dots"] > 0), _mixed(v)).otherwise(single), r"\.(?=.*\.)", "")
    value = _number(text)
    value = F.when(v["raw"].rlike(r"^20\d\d$") | (value >= F.lit(10**12)), F.lit(None)).otherwise(value)
    return F.struct(F.when(v["minus"] | v["raw"].rlike(r"(?i)\bDR\b"), -value).otherwise(value).cast("decimal(24,6)").alias("amount"), F.lit(False).alias("ambiguous"))


def mask_dates(line: Column) -> Column:
    """The line with dates and times as # signs, so that no part of them reads as money; ISO and numeric dates keep their places."""
    out = F.regexp_replace(line, r"(?<!\d)\d{4}[-/]\d{2}[-/]\d{2}(?!\d)|(?<![\d/.-])\d{2}[/.-]\d{2}[/.-]\d{4}(?![\d/])", "##########")
    for p in (NAMED, NAMED_US, NUMERIC, ISO, r"\b\d{1,2}:\d{2}(?::\d{2})?\b"):
        out = F.regexp_replace(out, p, "#")
    return out


#: Fixed value: how an amount may stand on an interest line, with a code or CR and DR on either side. Digits may go on over spaces.
INTEREST_MONEY = r"(?U)(?<![\w/])(?:[A-Z]{3}\s*)?[+\-]?\(?\s*[$€£¥]?\s*\d[\d\s,.]*\)?(?:\s*(?:CR|DR|Cr|Dr))?(?:\s*[A-Z]{3}\b)?"
#: Dates and times, in any notation.
_WHEN = rf"(?iU)\b20\d\d[-/.]\d{{1,2}}[-/.]\d{{1,2}}\b|\b\d{{1,2}}[-/.]\d{{1,2}}[-/.]20\d\d\b|\b(?:{_MONTH})\.?\s+\d{{1,2}},?\s+20\d\d\b|\b\d{{1,2}}\s+(?:de\s+)?(?:{_MONTH})\.?(?:\s+de)?\s+20\d\d\b|\b\d{{1,2}}:\d{{2}}(?::\d{{2}})?\b"
#: Digits that make a number without currency and cents look like a reference, not like money.
REFERENCE_DIGITS = 6


def money_tokens(line: Column, policy: str) -> Column:
    """array<struct<position, token, amount, ambiguous>> of a line, in order.

    balance: dates are masked first; years 20xx and runs of over 16 digits are none. interest: a token that overlaps a date
    or time is none, as is a plain number of six digits or more, which is a reference or the tail of a card; of amounts
    with a currency mark, with cents, and plain ones, the first kind that occurs is taken.
    """
    if policy == "balance":
        return _let(mask_dates(line), lambda masked: _tokens(masked, policy))
    return _let(F.struct(_spans(line, INTEREST_MONEY).alias("tokens"), _spans(line, _WHEN).alias("dates")), _interest_tokens)


def _spans(line: Column, pattern: str) -> Column:
    """array<struct<start, end, token>> of the matches on a line, counted from 0: the texts between matches give the offsets."""
    pieces = F.arrays_zip(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("token"), F.split(line, pattern, -1).alias("gap"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,token:string>>").alias("out"))

    def step(acc, z):
        start = acc["at"] + F.length(z["gap"])
        end = start + F.length(z["token"])
        return F.when(z["token"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), z["token"].alias("token"))).alias("out")))

    return F.coalesce(F.aggregate(pieces, none, step, lambda acc: acc["out"]), F.array().cast("array<struct<start:int,end:int,token:string>>"))


def _interest_tokens(v: Column) -> Column:
    words = rf"(?i)\b(?:CR|DR|{'|'.join(CODES)})\b"
    apart = F.filter(v["tokens"], lambda t: ~F.exists(v["dates"], lambda d: (d["start"] < t["end"]) & (d["end"] > t["start"])))

    def known(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(t["token"], words, ""), r"[$€£¥()+\-\s]", "")
        kind = F.when(t["token"].rlike(rf"[$€£¥]|{words}"), 0).when(bare.rlike(r"\d[0-9,.]*[,.]\d{2}$"), 1).otherwise(2)
        return F.struct((t["start"] + 1).alias("position"), t["token"].alias("token"), kind.alias("kind"), F.length(F.regexp_replace(t["token"], r"\D", "")).alias("digits"))

    money = F.filter(F.transform(apart, known), lambda t: (t["kind"] < 2) | (t["digits"] < REFERENCE_DIGITS))
    parsed = F.transform(money, lambda t: F.struct(t["position"], t["token"], parse_amount(t["token"], "interest").alias("p"), t["kind"]))
    parsed = F.filter(parsed, lambda t: t["p"]["amount"].isNotNull())
    best = lambda all_: F.filter(all_, lambda t: t["kind"] == F.array_min(F.transform(all_, lambda x: x["kind"])))
    return F.transform(_let(parsed, best), lambda t: F.struct(t["position"].alias("position"), F.trim(t["token"]).alias("token"), t["p"]["amount"].alias("amount"), t["p"]["ambiguous"].alias("ambiguous")))


def _tokens(masked: Column, policy: str) -> Column:
    found = F.regexp_extract_all(masked, F.lit(MONEY), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<position:int,token:string>>").alias("out"))

    def step(acc, t):
        return _let(F.call_function("locate", t, masked, acc["at"]), lambda at: F.struct((at + F.length(t)).alias("at"), F.array_append(acc["out"], F.struct(at.alias("position"), F.trim(t).alias("token"))).alias("out")))

    placed = F.aggregate(found, start, step, lambda acc: acc["out"])
    kept = F.filter(placed, lambda t: ~t["token"].rlike(r"^20\d\d$") & (F.length(F.regexp_replace(t["token"], r"\D", "")) <= 16))
    parsed = F.transform(kept, lambda t: _let(parse_amount(t["token"], policy), lambda p: F.struct(t["position"].alias("position"), t["token"].alias("token"), p["amount"].alias("amount"), p["ambiguous"].alias("ambiguous"))))
    return F.filter(parsed, lambda t: t["amount"].isNotNull())


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def date_tokens(line: Column, policy: str, day_first: Column | None = None) -> Column:
    """array<struct<date, confidence>> of a line; dates that the calendar lacks are left out.

    Of a/b/yyyy with both parts up to 12, `balance` reads month/day (low), `intake` day/month
    (medium), and `interest` as day_first says.
    """
    groups = lambda p, *g: [F.regexp_extract_all(line, F.lit(p), F.lit(i)) for i in g]
    three = lambda p, order: F.arrays_zip(*[x.alias(n) for x, n in zip(groups(p, *order), "yma", strict=True)])
    month = F.create_map(*[F.lit(x) for k, v in MONTHS.items() for x in (k, str(v))])
    high = lambda d: F.struct(d.alias("date"), F.lit("high").alias("confidence"))
    iso = F.transform(three(ISO, (1, 2, 3)), lambda t: high(_day(t["y"], t["m"], t["a"])))
    named = F.transform(three(NAMED, (3, 2, 1)), lambda t: high(_day(t["y"], month[F.lower(t["m"])], t["a"])))
    named_us = F.transform(three(NAMED_US, (3, 1, 2)), lambda t: high(_day(t["y"], month[F.lower(t["m"])], t["a"])))

    def numeric(t):
        a, b = t["m"].try_cast("int"), t["a"].try_cast("int")
        dm, md = _day(t["y"], t["a"], t["m"]), _day(t["y"], t["m"], t["a"])  # m is the first part, a the second
        unclear = (a <= 12) & (b <= 12)
        first = {"balance": F.lit(False), "intake": F.lit(True), "interest": F.coalesce(day_first if day_first is not None else F.lit(True), F.lit(True))}[policy]
        mark = {"balance": "low", "intake": "medium", "interest": "medium"}[policy]
        date = F.when(unclear, F.when(first, dm).otherwise(md)).when(a > 12, dm).otherwise(md)
        return F.struct(date.alias("date"), F.when(unclear & (a != b), mark).otherwise("high").alias("confidence"))

    plain = F.transform(three(NUMERIC, (3, 1, 2)), numeric)
    return F.filter(F.concat(iso, plain, named, named_us), lambda t: t["date"].isNotNull())


def infer_day_first(lines: DataFrame, key: str = "doc_id", line: str = "line") -> DataFrame:
    """Per document: whether numeric dates put the day first, by dates with a part above 12; Spanish words decide if there are none or both."""
    a = F.transform(F.regexp_extract_all(line, F.lit(NUMERIC), F.lit(1)), lambda x: x.try_cast("int"))
    b = F.transform(F.regexp_extract_all(line, F.lit(NUMERIC), F.lit(2)), lambda x: x.try_cast("int"))
    rows = lines.select(key, F.exists(a, lambda x: x > 12).alias("day"), F.exists(b, lambda x: x > 12).alias("month"), F.lower(line).rlike(r"\b(desde|hasta|saldo|fecha|cuenta)\b").alias("es"))
    votes = rows.groupBy(key).agg(F.bool_or("day").alias("day"), F.bool_or("month").alias("month"), F.bool_or("es").alias("es"))
    return votes.select(key, F.when(F.col("day") & ~F.col("month"), True).when(F.col("month") & ~F.col("day"), False).otherwise(F.col("es")).alias("day_first"))


def detect_currency(lines: DataFrame, key: str = "doc_id", line: str = "line") -> DataFrame:
    """Per document: its one confirmed code, MIXED, or UNKNOWN; and whether a bare $ occurs.

    A code is confirmed next to an amount or after a currency label, a symbol by itself.
    """
    codes = "|".join(CODES)
    near = F.regexp_extract_all(line, F.lit(rf"\b({codes})\s?[$€£¥]?\s?\d|(?<=\d)\s?({codes})\b|(?i:currency|moneda|divisa)[^A-Za-z]{{0,16}}({codes})\b"), F.lit(0))
    found = F.transform(near, lambda t: F.regexp_extract(t, rf"({codes})", 1))
    for symbol, code in SYMBOLS.items():
        found = F.when(F.col(line).contains(symbol), F.array_append(found, F.lit(code))).otherwise(found)
    rows = lines.select(key, F.explode_outer(F.array_distinct(found)).alias("code"), F.col(line).rlike(r"(?<![A-Za-z])\$").alias("dollar"))
    by = rows.groupBy(key).agg(F.countDistinct("code").alias("n"), F.min("code").alias("one"), F.bool_or("dollar").alias("ambiguous_dollar"))
    return by.select(key, F.when(F.col("n") == 1, F.col("one")).when(F.col("n") > 1, "MIXED").otherwise("UNKNOWN").alias("currency"), "ambiguous_dollar")


_ACCOUNT_CURRENCY = rf"(?i)\b(?:account currency|currency of (?:the )?account|moneda de (?:la )?cuenta|divisa de (?:la )?cuenta|account in)\b\W{{0,4}}({'|'.join(CODES)})\b"


def account_currency(lines: DataFrame, key: str = "doc_id", line: str = "line") -> DataFrame:
    """Per document: the code that its account-currency labels name, and whether they name one, several or none."""
    code = F.upper(F.regexp_extract(line, _ACCOUNT_CURRENCY, 1))
    by = lines.groupBy(key).agg(F.countDistinct(F.when(code != "", code)).alias("n"), F.min(F.when(code != "", code)).alias("code"))
    return by.select(key, F.when(F.col("n") == 1, F.col("code")).alias("currency"), F.when(F.col("n") == 1, "statement-text").when(F.col("n") > 1, "mixed-statement-text").otherwise("not-detected").alias("source"))


def line_currency(line: Column, account: Column) -> Column:
    """The currency of an interest line: a code on it (the account's if among them, else the first by name), the account's for a mere symbol, else the symbol's own."""
    codes = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(rf"(?i)\b({'|'.join(CODES)})\b"), F.lit(1)), F.upper)))
    own = F.lit(None).cast("string")
    for symbol, code in reversed(SYMBOLS.items()):
        own = F.when(line.contains(symbol), code).otherwise(own)
    symbol = own.isNotNull() | line.contains("$")
    return F.when(F.array_contains(codes, account), account).when(F.size(codes) > 0, F.try_element_at(codes, F.lit(1))).when(symbol & account.isNotNull(), account).otherwise(own)


_LABEL = r"(?i)\b(?:account|acct|cuenta|konto|iban)\b\s*(?:number|no\.?|nr\.?|n[uú]mero|#)?"
_IDENT = r"[A-Za-z]{0,4}[*Xx0-9](?:[*Xx0-9]|[ .\-](?=[*Xx0-9]))*"


def account_tokens(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """Identifiers after an account label (also one that ends the line before) or after "ending in"; four digits or masks at least."""
    before = F.lag(line).over(W.partitionBy(key).orderBy(order))
    own = F.regexp_extract(line, _LABEL + r"\s*[:.]?\s*(" + _IDENT + ")", 1)
    split = F.when(before.rlike(_LABEL + r"\s*[:.]?\s*$"), F.regexp_extract(line, r"^\s*(" + _IDENT + ")", 1)).otherwise("")
    tail = F.regexp_extract(line, r"(?i)(?:ending in|terminada en)\s+(\d{3,})", 1)
    rows = lines.withColumn("_split", split).withColumn("token", F.when(own != "", own).when(F.col("_split") != "", F.col("_split")).otherwise(tail)).withColumn("suffix", (own == "") & (F.col("_split") == "") & (tail != ""))
    rows = rows.withColumn("token", F.trim(F.regexp_replace("token", r"[ .\-]+$", "")))
    long = F.length(F.regexp_replace("token", r"[^0-9*Xx]", "")) >= 4
    other = F.lower(F.col(line)).rlike(r"\b(transfer|beneficiary|payee|counterparty)\b")
    return rows.filter(long & ~other).select(key, order, "token", (F.col("suffix") | F.col("token").rlike("[*Xx]")).alias("is_partial"))


_YEAR = r"\b(?:19|20)\d\d\b"
#: What decides which years speak of the bank, not of a period: marks of copyright, words of heritage, months, years. None holds another.
_COPYRIGHT, _HERITAGE = r"©|\(c\)|copyright|all rights reserved", r"\bsince\b|\bestablished\b|\best\.|\bfounded\b|member\s+(?:fdic|sipc)"
_YEAR_SPANS = rf"(?iU)(?:{_COPYRIGHT}|{_HERITAGE}|\b(?:{_MONTH})\b\.?(?!\w)|{_YEAR})"
#: Signs between a mark and a year, or two years of a list, at most; and between a month and its year.
NEAR, NEAR_MONTH = 8, 5


def _year_spans(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, at, pos, start, end, kind, token, dated): marks, months and years of each line with their offsets; `at` names the line.

    The text between two spans has a length, so the offsets are running sums of lengths.
    """
    tokens, gaps = F.regexp_extract_all(line, F.lit(_YEAR_SPANS), F.lit(0)), F.split(line, _YEAR_SPANS, -1)
    rows = lines.select(key, F.xxhash64(line).alias("at"), F.arrays_zip(tokens.alias("token"), gaps.alias("before")).alias("s")).dropDuplicates([key, "at"])
    rows = rows.select(key, "at", F.posexplode("s").alias("pos", "s")).select(key, "at", "pos", "s.*")
    by = W.partitionBy(key, "at").orderBy("pos")
    end = F.sum(F.length("before") + F.length("token")).over(by)
    kind = F.when(F.col("token").rlike(r"^\d"), "year").when(F.col("token").rlike(f"(?i)^(?:{_COPYRIGHT})$"), "copyright").when(F.col("token").rlike(f"(?iU)^(?:{_HERITAGE})$"), "heritage").otherwise("month")
    # The sign before a year, if only of the span before it; and what follows, as far as a date goes.
    sign = F.substring(F.when(F.col("before") != "", F.col("before")).otherwise(F.lag("token").over(by)), -1, 1)
    after = F.substring(F.concat(F.lead("before").over(by), F.coalesce(F.lead("token").over(by), F.lit(""))), 1, 6)
    dated = sign.isin(".", "/", "-") | after.rlike(r"^[-/.]\d{1,2}[-/.]\d{1,2}")
    return rows.select(key, "at", "pos", (end - F.length("token")).alias("start"), end.alias("end"), kind.alias("kind"), "token", F.coalesce(dated, F.lit(False)).alias("dated")).filter("token is not null")


def _nearest(which: Column, group: list[str]) -> Column:
    """Signs between a span and the nearest one of its line for which `which` holds; null without one."""
    # A frame that reaches to the end would be summed up anew for each row; the same frame in reverse order runs along.
    earlier = lambda order: W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("start") - F.max(F.when(which, F.col("end"))).over(earlier(F.asc("pos")))
    after = F.min(F.when(which, F.col("start"))).over(earlier(F.desc("pos"))) - F.col("end")
    return F.least(before, after)


#: Spans of a line that are compared with one another in place, at most.
MAX_SPANS_IN_PLACE = 64


def _kept_years(line: Column, spans: Column) -> Column:
    """The years of a line of few spans that no clause and no heritage word takes, as array<string>; the rules are those of `detect_years`."""
    marks = {"copyright": rf"(?i)^(?:{_COPYRIGHT})$", "heritage": rf"(?iU)^(?:{_HERITAGE})$"}

    def near(s: Column, others: Column, which, most: int) -> Column:
        reach = lambda m: which(m) & ((m["end"] <= s["start"]) & (s["start"] - m["end"] <= most) | (m["start"] >= s["end"]) & (m["start"] - s["end"] <= most))
        return F.exists(others, reach)

    kind = lambda t: F.when(t.rlike(r"^\d"), "year").when(t.rlike(marks["copyright"]), "copyright").when(t.rlike(marks["heritage"]), "heritage").otherwise("month")
    named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), kind(s["token"]).alias("kind")))

    def months(all_: Column) -> Column:
        """The months, and by which kinds of marks each is reached."""
        of = F.filter(all_, lambda s: s["kind"] == "month")
        return F.transform(of, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *[near(s, all_, lambda m, k=k: m["kind"] == k, NEAR).alias(k) for k in marks]))

    def years(v: Column) -> Column:
        def flagged(s: Column) -> Column:
            by = [(near(s, v["all"], lambda m, k=k: m["kind"] == k, NEAR) | near(s, v["months"], lambda m, k=k: m[k], NEAR_MONTH)).alias(k) for k in marks]
            before, after = line.substr(s["start"], F.lit(1)), line.substr(s["end"] + 1, F.lit(6))
            dated = (s["start"] > 0) & before.isin(".", "/", "-") | after.rlike(r"^[-/.]\d{1,2}[-/.]\d{1,2}")
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), dated.alias("dated"), *by)

        return F.transform(F.filter(v["all"], lambda s: s["kind"] == "year"), flagged)

    def kept(v: Column) -> Column:
        """Years without those of a list that copyright reaches; a list is known by where it begins."""
        of = lambda y: F.array_max(F.filter(v["begins"], lambda b: b <= y["start"]))
        taken = F.array_distinct(F.transform(F.filter(v["years"], lambda y: y["copyright"]), of))
        return F.transform(F.filter(v["years"], lambda y: (y["dated"] | ~y["heritage"]) & ~F.array_contains(taken, of(y))), lambda y: y["token"])

    begins = lambda ys: F.transform(F.filter(ys, lambda y, i: (i == 0) | (y["start"] - F.try_element_at(ys, i)["end"] > NEAR)), lambda y: y["start"])
    found = _let(named, lambda all_: _let(F.struct(all_.alias("all"), months(all_).alias("months")), years))
    return _let(found, lambda ys: _let(F.struct(ys.alias("years"), begins(ys).alias("begins")), kept))


def detect_years(lines: DataFrame, key: str = "doc_id", line: str = "line") -> DataFrame:
    """Distinct years of a document's lines, without those that belong to a copyright clause or a word of heritage.

    A mark reaches a year at most 8 signs away, before or behind it, or through one month name
    that is as near to the mark and at most 5 signs from the year. From a year that
    copyright reaches, the clause goes on to each next year at most 8 signs away,
    both ways. A heritage word ("since", "established", "est.", "founded", "Member
    FDIC") reaches alike, but one year at a time, and never a year inside a numeric date.
    Lines of few spans are judged in place, each by itself; only longer ones are dealt out and sorted.
    """
    marked = F.col(line).rlike(rf"(?iU){_COPYRIGHT}|{_HERITAGE}")
    rows = lines.filter(F.col(line).rlike(rf"(?U){_YEAR}"))
    plain = rows.filter(~marked).select(key, F.explode(F.regexp_extract_all(line, F.lit(rf"(?U)({_YEAR})"), F.lit(1))).alias("year"))
    group = [key, "at"]
    few = F.regexp_count(line, F.lit(_YEAR_SPANS)) <= MAX_SPANS_IN_PLACE
    short = rows.filter(marked & few).select(key, F.explode(_let(_spans(F.col(line), _YEAR_SPANS), lambda s: _kept_years(F.col(line), s))).alias("year"))
    spans = _year_spans(rows.filter(marked & ~few), key, line)
    for mark in ("copyright", "heritage"):
        spans = spans.withColumn(mark, _nearest(F.col("kind") == mark, group) <= NEAR)
    for mark in ("copyright", "heritage"):
        spans = spans.withColumn(f"by_{mark}", F.coalesce(F.col(mark), F.lit(False)) | F.coalesce(_nearest((F.col("kind") == "month") & F.col(mark), group) <= NEAR_MONTH, F.lit(False)))
    years = spans.filter("kind = 'year'")
    by = W.partitionBy(*group).orderBy("pos")
    apart = F.coalesce(F.col("start") - F.lag("end").over(by) > NEAR, F.lit(False)).cast("int")
    years = years.withColumn("list", F.sum(apart).over(by)).withColumn("clause", F.max("by_copyright").over(W.partitionBy(*group, "list")))
    kept = years.filter("not clause and (dated or not by_heritage)").select(key, F.col("token").alias("year"))
    return plain.union(short).union(kept).select(key, F.col("year").cast("int").alias("year")).distinct()


def period_intervals(lines: DataFrame, key: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """Statement periods: two dates joined on one line, or a from-date line followed within two lines by a to-date line. Inverted ones are dropped."""
    dates = date_tokens(F.col(line), "intake")
    at = W.partitionBy(*key).orderBy(order)
    rows = lines.withColumn("_d", dates).withColumn("_joined", F.col(line).rlike(r"(?i)(?:\d\s*(?:-|–|to|through|until|al?|hasta)\s*(?:el )?(?:\d|[A-Za-z]))|desde.*hasta|from.*to"))
    rows = rows.withColumn("_from", F.col(line).rlike(r"(?i)^\W*(?:from|desde|period start)\b") & (F.size("_d") == 1)).withColumn("_to", F.col(line).rlike(r"(?i)^\W*(?:to|hasta|period end)\b") & (F.size("_d") == 1))
    start = F.last(F.when(F.col("_from"), F.struct(F.col(order).alias("line"), F.col("_d")[0].alias("d"))), ignorenulls=True).over(at.rowsBetween(-2, -1))
    rows = rows.withColumn("_start", start)
    low = lambda a, b: F.when((a == "low") | (b == "low"), "low").when((a == "medium") | (b == "medium"), "medium").otherwise("high")
    one = rows.filter(F.col("_joined") & (F.size("_d") == 2)).select(*key, F.col("_d")[0]["date"].alias("start_date"), F.col("_d")[1]["date"].alias("end_date"), low(F.col("_d")[0]["confidence"], F.col("_d")[1]["confidence"]).alias("confidence"), F.col(order).alias("line_no"), F.col(order).alias("end_line_no"))
    two = rows.filter(F.col("_to") & F.col("_start").isNotNull()).select(*key, F.col("_start.d.date").alias("start_date"), F.col("_d")[0]["date"].alias("end_date"), low(F.col("_start.d.confidence"), F.col("_d")[0]["confidence"]).alias("confidence"), F.col("_start.line").alias("line_no"), F.col(order).alias("end_line_no"))
    return one.unionByName(two).filter("end_date >= start_date")


def metadata_dates(lines: DataFrame, tax_year: int, key: list[str], line: str = "line") -> DataFrame:
    """Dates after "generated on" and "issued": evidence of the file's making, never of coverage; flagged outside the year."""
    kind = F.when(F.lower(line).rlike(r"\b(?:generated|printed) on\b|\bgenerado el\b"), "generated-on").when(F.lower(line).rlike(r"\b(?:issued|expedido|emitido)\b"), "certificate-issued")
    after = F.regexp_replace(line, r"(?i)^.*?(?:generated on|printed on|generado el|issued|expedido|emitido)", "")
    rows = lines.withColumn("role", kind).filter("role is not null").withColumn("date", F.try_element_at(date_tokens(after, "intake"), F.lit(1))["date"])
    return rows.filter("date is not null").select(*key, "date", "role", (F.year("date") != tax_year).alias("outside_year"))


def year_anchors(lines: DataFrame, key: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """Dates in the first 24 characters of lines below a date-table header of their page."""
    header = F.lower(line).rlike(_TABLE_HEADER)
    below = F.max(header.cast("int")).over(W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)) == 1
    rows = lines.withColumn("_below", below).filter("_below").withColumn("t", F.try_element_at(date_tokens(F.substring(line, 1, 24), "intake"), F.lit(1)))
    return rows.filter("t is not null").select(*key, F.col(order), F.col("t.date").alias("anchor_date"), F.col("t.confidence").alias("confidence"))


_TABLE_HEADER = r"\b(date|fecha|datum)\b.*\b(description|amount|balance|detalle|descripcion|valor|saldo|betrag)\b"
_OPENING = r"(?i)\b(?:opening|previous|prior|brought forward|saldo (?:anterior|inicial))\b"


def date_tables(lines: DataFrame, key: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """Per page with a date-table header: its header lines, and how many of its lines have a date and money."""
    header = F.lower(line).rlike(_TABLE_HEADER)
    money = (F.size(date_tokens(F.col(line), "intake")) > 0) & F.col(line).rlike(r"[$€£¥]|(?:\d[.,])?\d{2,}")
    by = lines.groupBy(*key).agg(F.sort_array(F.collect_set(F.when(header, F.col(order)))).alias("header_lines"), F.count_if(money).alias("dated_money_rows"))
    return by.filter(F.size("header_lines") > 0)


def contextual_dates(lines: DataFrame, periods: DataFrame, key: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """Dates, or bare years, of lines about an opening or prior balance: context, never coverage. Lines that give a period are none."""
    given = periods.select(*key, F.explode(F.array("line_no", "end_line_no")).alias(order)).distinct()
    rows = lines.filter(F.col(line).rlike(_OPENING)).join(given, [*key, order], "left_anti")
    dated = F.transform(date_tokens(F.col(line), "intake"), lambda t: F.struct(F.year(t["date"]).alias("year"), t["date"].alias("date")))
    bare = F.transform(F.regexp_extract_all(line, F.lit(f"({_YEAR})"), F.lit(1)), lambda y: F.struct(y.cast("int").alias("year"), F.lit(None).cast("date").alias("date")))
    return rows.select(*key, order, F.inline(F.array_distinct(F.when(F.size(dated) > 0, dated).otherwise(bare))))


#: A row's date without a year, at its start; a line that sums up the end of a period.
_SHORT = r"^\s*(\d{1,2})[/.-](\d{1,2})(?![\d/.-])"
_PERIOD_END = r"(?i)\b(?:closing|ending|final|period[- ]end) balance\b|\bsaldo (?:final|al corte)\b"


def balance_lines(lines: DataFrame, key: list[str], order: str = "line_no", line: str = "line", periods: DataFrame | None = None) -> DataFrame:
    """Balance observations: a dated line with money that names a balance (fee, interest and tax lines need to), or a line of three amounts on a page that does.

    The amount is the last one after the last balance term, else the last of the
    line. With verified periods (key, start_date, end_date), pages that have
    exactly one give two kinds more: rows whose date lacks the year (day and
    month, two amounts suffice) take it from the period, if it has one place for
    the date; and a closing line without a date and with one amount stands for
    the period's end, to be reviewed.
    """
    low = F.lower(line)
    term = low.rlike("|".join(BALANCE_TERMS))
    fee = low.rlike("|".join(FEE_TERMS))
    rows = lines.withColumn("_full", F.try_element_at(date_tokens(F.col(line), "balance"), F.lit(1)))
    if periods is None:
        rows = rows.withColumn("_start", F.lit(None).cast("date")).withColumn("_stop", F.lit(None).cast("date"))
    else:
        one = periods.groupBy(*key).agg(F.count("*").alias("_n"), F.min("start_date").alias("_start"), F.min("end_date").alias("_stop")).filter("_n = 1").drop("_n")
        rows = rows.join(one, key, "left")
    day, month = (F.lpad(F.regexp_extract(line, _SHORT, i), 2, "0") for i in (1, 2))
    places = F.transform(F.sequence(F.year("_start"), F.year("_stop")), lambda y: _day(y.cast("string"), month, day))
    inside = F.filter(places, lambda d: (d >= F.col("_start")) & (d <= F.col("_stop")))
    short = F.when(F.col("_full").isNull() & F.col("_start").isNotNull() & F.col(line).rlike(_SHORT) & (F.size(inside) == 1), F.try_element_at(inside, F.lit(1)))
    rows = rows.withColumn("_short", short).withColumn("_date", F.coalesce("_full", F.when(F.col("_short").isNotNull(), F.struct(F.col("_short").alias("date"), F.lit("high").alias("confidence")))))
    rows = rows.withColumn("_term", term).withColumn("_page", F.max(term.cast("int")).over(W.partitionBy(*key)) == 1)
    rows = rows.withColumn("_summary", F.col("_date").isNull() & F.col("_stop").isNotNull() & F.col(line).rlike(_PERIOD_END))
    rows = rows.filter((F.col("_term") | F.col("_page") & ~fee) & F.col("_date").isNotNull() | F.col("_summary"))
    rows = rows.withColumn("_money", money_tokens(F.when(F.col("_short").isNotNull(), F.regexp_replace(line, _SHORT, "#")).otherwise(F.col(line)), "balance"))
    enough = F.when(F.col("_short").isNotNull(), 2).otherwise(3)
    rows = rows.filter(F.when(F.col("_summary"), F.size("_money") == 1).otherwise((F.size("_money") > 0) & (F.col("_term") | (F.size("_money") >= enough))))
    end = F.length(F.regexp_extract(low, rf"^(.*(?:{'|'.join(BALANCE_TERMS)}))", 1))
    after = F.filter("_money", lambda t: t["position"] > F.col("_end"))
    rows = rows.withColumn("_end", end).withColumn("_pick", F.when(F.size(after) > 0, F.element_at(after, -1)).otherwise(F.element_at("_money", -1)))
    bare = F.col("_pick.token").rlike(r"^\d{1,2}$")
    confidence = F.when(F.col("_summary"), "medium").when(bare | (F.col("_date.confidence") == "low"), "low").when(F.col("_pick.ambiguous") | ~F.col("_term"), "medium").otherwise("high")
    kind = F.when(F.col("_summary"), "period-end-summary").otherwise("transaction-row")
    return rows.select(*key, F.col(order), F.coalesce("_date.date", "_stop").alias("balance_date"), F.col("_pick.amount").alias("amount"), confidence.alias("confidence"), kind.alias("candidate_type"))


# Words of institution names, and legal suffixes that a signature leaves out.
INSTITUTION_WORDS, LEGAL = ("bank", "banco", "bancolombia", "credit union", "trust", "sparkasse", "caixa", "banque"), ("sa", "inc", "ltd", "llc", "plc", "ag", "na", "corp", "sas", "limited")


def institution_signature(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line", header: int = 24) -> DataFrame:
    """Per document: the signature of its first header line that names an institution, without accents, legal suffixes and single letters' gaps."""
    folded = normalize_text(F.col(line), "ascii_fold")
    named = folded.rlike(rf"\b(?:{'|'.join(INSTITUTION_WORDS)})\b") & ~folded.rlike(r"\d{3,}|@|www\.|\b(transfer|payment|street|avenue|page)\b")
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(folded, r"\b([a-z])[. ](?=[a-z]\b)", "$1"), "[^a-z0-9]+", " "), " "), lambda w: ~w.isin("", *LEGAL))
    rows = lines.filter((F.col(order) <= header) & named).withColumn("signature", F.array_join(words, " "))
    return rows.groupBy(key).agg(F.min_by("signature", order).alias("signature"), F.min_by(line, order).alias("shown"))


def institution_disagreements(signatures: DataFrame, group: str, file: str = "doc_id") -> DataFrame:
    """Groups of files whose signatures are not one and the same, with the signatures."""
    by = signatures.groupBy(group).agg(F.countDistinct("signature").alias("n"), F.sort_array(F.collect_set("signature")).alias("signatures"), F.countDistinct(file).alias("files"))
    return by.filter("n > 1").select(F.col(group).alias("entity"), F.lit("institution-differs").alias("code"), "files", "signatures")


_ENDPOINT = rf"(?:({_MONTH})\.? (\d{{1,2}})|(\d{{1,2}})(?: de)? ({_MONTH})\.?)(?:,?(?: de| del)? (\d{{4}}))?"
HEADER = rf"(?i)\b(?:statement period|period|per[ií]odo|billing cycle)\b\W{{0,3}}(?:from |del? )?{_ENDPOINT}\s*(?:-|–|to|through|al?|hasta)\s*(?:el )?{_ENDPOINT}"


#: The same range with no label, alone on a short line but for a count of its days.
BARE_HEADER = rf"(?i)^\W{{0,2}}{_ENDPOINT}\s*(?:-|–|to|through|al?|hasta)\s*(?:el )?{_ENDPOINT}\s*(?:\((\d{{1,3}})\s*(?:days?|d[ií]as?)\)\s*)?$"


def period_headers(lines: DataFrame, key: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """Month and day ranges, labelled or alone on a line of up to 100 signs, their years null where the header shows none; days that no month has are left out."""
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def found(pattern: str, rows: DataFrame) -> DataFrame:
        part = lambda i: F.regexp_extract(line, pattern, i)
        number = lambda i: part(i).try_cast("int")

        def endpoint(base: int) -> list[Column]:
            return [month[F.lower(F.when(part(base) != "", part(base)).otherwise(part(base + 3)))], F.coalesce(number(base + 1), number(base + 2)), number(base + 4)]

        names = ["start_month", "start_day", "start_year", "end_month", "end_day", "end_year"]
        return rows.filter(F.col(line).rlike(pattern)).select(*key, F.col(order), *[c.alias(n) for c, n in zip([*endpoint(1), *endpoint(6)], names, strict=True)])

    count = F.coalesce(F.regexp_extract(line, BARE_HEADER, 11).try_cast("int"), F.lit(1))
    bare = lines.filter(~F.col(line).rlike(HEADER) & (F.length(line) <= 100) & ~F.col(line).rlike(r"[$€£¥]|\d[.,]\d{2}") & count.between(1, 366))
    rows = found(HEADER, lines).unionByName(found(BARE_HEADER, bare))
    return rows.filter("start_day between 1 and 31 and end_day between 1 and 31")
