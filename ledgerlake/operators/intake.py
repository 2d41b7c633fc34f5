"""Statement intake: duplicate files, years, periods and their gaps, account hints, and review gates."""

from __future__ import annotations

import calendar
import datetime as dt
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Currency names, and words that name several currencies.
CURRENCY_ALIASES = {
    "argentine peso": "ARS", "brazilian real": "BRL", "british pound": "GBP", "canadian dollar": "CAD", "chilean peso": "CLP",
    "chinese yuan": "CNY", "colombia peso": "COP", "colombian peso": "COP", "euro": "EUR", "japanese yen": "JPY", "mexican peso": "MXN",
    "peruvian sol": "PEN", "pound sterling": "GBP", "south african rand": "ZAR", "swiss franc": "CHF",
}
AMBIGUOUS_CURRENCIES = ("dollar", "franc", "krona", "krone", "peso", "pound", "ruble")
#: Gates that no reviewer can accept, and one that no acceptance resolves.
STOP_GATES, UNRESOLVABLE = ("low-text-statements", "missing-statements", "non-pdf-statements", "unreadable-statements"), ("mixed-years",)


def _year(year: int) -> tuple[Column, Column]:
    return F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")


def stable_unique(rows: DataFrame, group: list[str], value: str, order: list[str], n: int | None = None) -> DataFrame:
    """The first row of each value (case folded) of a group, in order, n at most; `place` counts from 1."""
    at = [F.col(c) for c in order]
    first = rows.withColumn("_k", F.lower(F.trim(value))).filter("_k <> ''").withColumn("_r", F.row_number().over(W.partitionBy(*group, "_k").orderBy(*at))).filter("_r = 1")
    placed = first.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*at))).drop("_k", "_r")
    return placed if n is None else placed.filter(F.col("place") <= n)


def most_common_label(rows: DataFrame, group: list[str], label: str, order: str) -> DataFrame:
    """The most frequent label of each group; the one seen first on ties."""
    counts = rows.filter(F.trim(label) != "").groupBy(*group, F.lower(F.trim(label)).alias("_l")).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(F.trim(label), order).alias("shown"))
    return counts.groupBy(*group).agg(F.max_by(F.struct("shown", "n"), F.struct(F.col("n"), -F.col("first"))).alias("m")).select(*group, F.col("m.shown").alias("label"), F.col("m.n").alias("times"))


def duplicate_inputs(files: DataFrame) -> DataFrame:
    """Paths given twice, and contents under more than one path, as violations."""
    twice = files.groupBy("path").count().filter("count > 1").select(F.col("path").alias("entity"), F.lit("duplicate-path").alias("code"), F.col("count").alias("n"))
    copies = files.groupBy("content_sha256").agg(F.countDistinct("path").alias("n")).filter("n > 1").select(F.col("content_sha256").alias("entity"), F.lit("duplicate-content").alias("code"), "n")
    return twice.union(copies)


def currency_code(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds `code`: an ISO code, that of an alias, AMBIGUOUS for a bare name of several currencies, else UNKNOWN."""
    key = F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))
    aliases = F.create_map(*[F.lit(x) for pair in CURRENCY_ALIASES.items() for x in pair])
    code = F.when(F.upper(F.trim(label)).rlike("^[A-Z]{3}$"), F.upper(F.trim(label))).when(key.isin(*AMBIGUOUS_CURRENCIES), "AMBIGUOUS").otherwise(F.coalesce(aliases[key], F.lit("UNKNOWN")))
    return rows.withColumn("code", F.when(F.coalesce(key, F.lit("")) == "", "UNKNOWN").otherwise(code))


def iban_valid(value: Column) -> Column:
    """Whether a compact IBAN of 15 to 34 characters has the remainder 1 modulo 97."""
    moved = F.concat(F.substring(value, 5, 34), F.substring(value, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    step = lambda t, c: F.when(c.rlike("[0-9]"), (t * 10 + c.try_cast("int")) % 97).otherwise((t * 100 + F.ascii(c) - 55) % 97)
    return F.coalesce(value.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (F.aggregate(chars, F.lit(0), step) == 1), F.lit(False))


def iban_prefix(value: Column) -> Column:
    """The longest valid IBAN that a captured text begins with, or null."""
    compact = F.upper(F.regexp_replace(value, r"\s+", ""))
    longest = F.least(F.length(compact), F.lit(34))
    tries = F.when(longest >= 15, F.transform(F.sequence(longest, F.lit(15), F.lit(-1)), lambda n: F.substring(compact, F.lit(1), n)))
    return F.try_element_at(F.filter(tries, lambda c: iban_valid(c)), F.lit(1))


def _compact(hint: Column) -> Column:
    return F.upper(F.regexp_replace(hint, r"[ .\-]", ""))


def dedupe_accounts(hints: DataFrame, group: str = "group_id", hint: str = "hint", partial: str = "is_partial", seq: str = "seq") -> DataFrame:
    """One row per account of a group: full numbers by their compact form, partial ones with no full partner by theirs.

    A partial hint belongs to the full number of lowest seq whose trailing
    digits end in its own (three at least). The join is on the last three
    digits, so a group's hints are not all compared with each other.
    """
    rows = hints.withColumn("compact", _compact(F.col(hint))).filter("compact <> ''").withColumn("tail", F.regexp_extract("compact", r"(\d+)$", 1))
    one = rows.groupBy(group, "compact").agg(F.min(seq).alias("seq"), F.min_by(hint, seq).alias("shown"), F.bool_and(partial).alias("part"), F.first("tail").alias("tail"), F.count("*").alias("hints"))
    full = one.filter("not part").select(F.col(group).alias("_g"), F.col("compact").alias("owner"), F.col("seq").alias("owner_seq"), F.col("tail").alias("owner_tail"), F.when(F.length("tail") >= 3, F.substring("tail", -3, 3)).alias("_t"))
    parts = one.filter("part").withColumn("_p", F.when(F.length("tail") >= 3, F.substring("tail", -3, 3)))
    met = parts.join(full, (F.col(group) == F.col("_g")) & (F.col("_p") == F.col("_t")) & (F.col("owner_tail").endswith(F.col("tail")) | F.col("tail").endswith(F.col("owner_tail"))), "left")
    owned = met.groupBy(group, "compact", "shown", "seq", "hints").agg(F.min_by("owner", "owner_seq").alias("owner"))
    every = one.filter("not part").select(group, F.col("compact").alias("account"), "shown", "seq", "hints", F.lit(True).alias("is_full")).unionByName(owned.select(group, F.coalesce("owner", "compact").alias("account"), "shown", "seq", "hints", F.lit(False).alias("is_full")))
    return every.groupBy(group, "account").agg(F.max_by("shown", F.struct(F.col("is_full"), -F.col("seq"))).alias("shown"), F.min("seq").alias("seq"), F.sum("hints").alias("hints"), F.bool_or("is_full").alias("has_full"))


def account_linkage(files: DataFrame, hints: DataFrame, group: str = "group_id", file: str = "file_id", hint: str = "hint", partial: str = "is_partial") -> DataFrame:
    """Where a group has one canonical account: its files with no equivalent hint."""
    rows = hints.withColumn("compact", _compact(F.col(hint))).withColumn("tail", F.regexp_extract("compact", r"(\d+)$", 1))
    one = rows.filter(~F.col(partial)).groupBy(group).agg(F.countDistinct("compact").alias("n"), F.min("compact").alias("account"), F.min("tail").alias("account_tail")).filter("n = 1")
    same = (F.col("compact") == F.col("account")) | (F.col(partial) & (F.length("tail") >= 3) & (F.length("account_tail") >= 3) & (F.col("account_tail").endswith(F.col("tail")) | F.col("tail").endswith(F.col("account_tail"))))
    linked = rows.join(one.select(group, "account", "account_tail"), group).filter(same).select(group, file).distinct()
    return files.select(group, file).distinct().join(one.select(group, "account"), group).join(linked, [group, file], "left_anti")


def coverage_gaps(periods: DataFrame, tax_year: int, key: str = "account_id") -> DataFrame:
    """Days of the year outside an account's periods, as leading, inner and trailing gaps; accounts with one period in the year have none."""
    start, end = _year(tax_year)
    inside = periods.filter((F.col("end_date") >= start) & (F.col("start_date") <= end)).select(key, F.greatest("start_date", start).alias("s"), F.least("end_date", end).alias("e"))
    by_start = W.partitionBy(key).orderBy("s", "e")
    rows = inside.withColumn("reach", F.max("e").over(by_start.rowsBetween(W.unboundedPreceding, -1))).withColumn("n", F.count("*").over(W.partitionBy(key)))
    rows = rows.filter("n > 1")
    before = rows.filter(F.col("reach").isNull() & (F.col("s") > start) | (F.col("s") > F.date_add("reach", 1))).select(key, F.when(F.col("reach").isNull(), start).otherwise(F.date_add("reach", 1)).alias("gap_start"), F.date_sub("s", 1).alias("gap_end"), F.when(F.col("reach").isNull(), "leading").otherwise("inner").alias("kind"))
    after = rows.groupBy(key).agg(F.max("e").alias("last")).filter(F.col("last") < end).select(key, F.date_add("last", 1).alias("gap_start"), end.alias("gap_end"), F.lit("trailing").alias("kind"))
    return before.unionByName(after)


def opening_evidence(periods: DataFrame, tax_year: int, key: str = "account_id") -> DataFrame:
    """Accounts whose only gap is the leading one before their first period: a user may attest the opening."""
    gaps = coverage_gaps(periods, tax_year, key)
    return gaps.groupBy(key).agg(F.count("*").alias("gaps"), F.bool_and(F.col("kind") == "leading").alias("leading"), F.min("gap_start").alias("gap_start"), F.max("gap_end").alias("gap_end")).filter("gaps = 1 and leading").select(key, "gap_start", "gap_end", F.date_add("gap_end", 1).alias("first_period_start"))


def classify_years(files: DataFrame, years: DataFrame, periods: DataFrame, context: DataFrame, tax_year: int, file: str = "file_id", unheaded: DataFrame | None = None) -> DataFrame:
    """Per file: years of its periods, years seen as context only, years left unexplained, and years that it covers.

    A period that opens on 31 December before the tax year counts from the tax year: that
    boundary year is context. Without periods, detected less contextual years are covered,
    unless the file has table dates without a header.
    """
    boundary = (F.month("start_date") == 12) & (F.dayofmonth("start_date") == 31) & (F.year("start_date") == tax_year - 1)
    of_period = periods.select(file, F.explode(F.sequence(F.year("start_date") + F.when(boundary, 1).otherwise(0), F.year("end_date"))).alias("y")).groupBy(file).agg(F.sort_array(F.collect_set("y")).alias("period_years"))
    edge = periods.filter(boundary).select(file, F.lit(tax_year - 1).alias("y"))
    ctx = context.select(file, F.col("year").alias("y")).union(edge).groupBy(file).agg(F.collect_set("y").alias("ctx"))
    seen = years.groupBy(file).agg(F.sort_array(F.collect_set("year")).alias("detected"))
    rows = files.select(file).join(seen, file, "left").join(of_period, file, "left").join(ctx, file, "left")
    none = F.array().cast("array<int>")
    rows = rows.select(file, *[F.coalesce(F.col(c).cast("array<int>"), none).alias(c) for c in ("detected", "period_years", "ctx")])
    if unheaded is not None:
        rows = rows.join(unheaded.select(file).distinct().withColumn("_u", F.lit(True)), file, "left")
    else:
        rows = rows.withColumn("_u", F.lit(None).cast("boolean"))
    contextual = F.sort_array(F.array_except("ctx", "period_years"))
    rest = F.array_except("detected", "contextual_years")
    return rows.withColumn("contextual_years", contextual).select(
        file,
        "period_years",
        "contextual_years",
        F.sort_array(F.array_except(rest, "period_years")).alias("unresolved_years"),
        F.when(F.size("period_years") > 0, F.col("period_years")).when(F.coalesce("_u", F.lit(False)), none).otherwise(F.sort_array(rest)).alias("coverage_years"),
    )


def verify_periods(periods: DataFrame, line_dates: DataFrame) -> DataFrame:
    """Periods whose source line still has both ends, or whose start and end lines each have theirs.

    line_dates: (file_id, page, line_no, dates ARRAY<DATE>); a period has line_no and end_line_no.
    """
    a = line_dates.select("file_id", "page", "line_no", F.col("dates").alias("_start"))
    b = line_dates.select("file_id", "page", F.col("line_no").alias("end_line_no"), F.col("dates").alias("_end"))
    both = periods.join(a, ["file_id", "page", "line_no"], "left").join(b, ["file_id", "page", "end_line_no"], "left")
    good = F.array_contains("_start", F.col("start_date")) & F.array_contains("_end", F.col("end_date"))
    return both.filter(F.coalesce(good, F.lit(False))).select(*periods.columns)


def _placed(headers: DataFrame, years: Column) -> DataFrame:
    """Every valid placement of a header's month and day ends; an end before its start lies in the next year."""
    text = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(F.col(m).cast("string"), 2, "0"), F.lpad(F.col(d).cast("string"), 2, "0")))
    later = (F.col("end_month") < F.col("start_month")) | ((F.col("end_month") == F.col("start_month")) & (F.col("end_day") < F.col("start_day")))
    rows = headers.withColumn("_y", F.explode(F.array_distinct(years)))
    rows = rows.withColumn("start_date", text(F.col("_y"), "start_month", "start_day")).withColumn("end_date", text(F.col("_y") + F.when(later, 1).otherwise(0), "end_month", "end_day"))
    if "start_year" in headers.columns:
        rows = rows.filter((F.col("start_year").isNull() | (F.col("start_year") == F.year("start_date"))) & (F.col("end_year").isNull() | (F.col("end_year") == F.year("end_date"))))
    return rows.filter("start_date is not null and end_date >= start_date").drop("_y")


def place_header_year(headers: DataFrame, anchors: DataFrame, tax_year: int, key: list[str] | None = None) -> DataFrame:
    """Headers without a year that have exactly one placement holding all dated anchors of their file."""
    key = key or ["file_id"]
    dates = anchors.groupBy(*key).agg(F.min("anchor_date").alias("_lo"), F.max("anchor_date").alias("_hi"), F.collect_set(F.year("anchor_date")).alias("_ys"))
    near = lambda y: F.array(y - 1, y, y + 1)
    years = F.concat(F.sequence(F.lit(tax_year - 1), F.lit(tax_year + 1)), F.flatten(F.transform("_ys", near)))
    found = _placed(headers.join(dates, key), years).filter("start_date <= _lo and _hi <= end_date").drop("_lo", "_hi", "_ys")
    return found.withColumn("_n", F.count("*").over(W.partitionBy(*key))).filter("_n = 1").drop("_n").withColumn("confidence", F.lit("high")).withColumn("provenance", F.lit("direct-anchor"))


#: A header as far as its place depends on it.
_SHAPE = ["start_month", "start_day", "end_month", "end_day", "start_year", "end_year"]


def _chained(shapes: list[tuple], single: list[int], periods: list[tuple[dt.date, dt.date]], tax_year: int) -> list[tuple[int, dt.date, dt.date]]:
    """(place in shapes, start, end) of one account's distinct headers, placed next to its periods; single: headers of each shape.

    Rounds are semi-naive: the first looks at all periods, each later one only at those of the
    round before. A place is looked up by the day on which it would have to
    begin or end, and counts while nothing known overlaps it and its year is within one of a known year.
    """
    day = dt.timedelta(days=1)
    begins, finishes, spots = defaultdict(set), defaultdict(set), {}

    def date(year: int, month: int, dom: int) -> dt.date | None:
        return dt.date(year, month, dom) if 0 < year < 9999 and 0 < dom <= calendar.monthrange(year, month)[1] else None

    def add(i: int, year: int) -> None:
        """The place of a header that starts in a year, if it has one."""
        a, b, c, d, first, last = shapes[i]
        over = (c, d) < (a, b)
        if (first or year) != year or (first is None and last is not None and year != last - over):
            return
        start, end = date(year, a, b), date(year + over if last is None else last, c, d)
        if start and end and start <= end:
            spots[i, year] = (start, end)
            begins[start].add((i, year))
            finishes[end].add((i, year))

    starts, ends, years, placed, out = [], [], set(), set(), []
    touched: set[tuple[int, int]] = set()
    fresh = sorted(set(periods))
    longest = max((b - a for a, b in fresh), default=day)
    for i, shape in enumerate(shapes):
        for y in {x for v in (tax_year, *shape[4:]) if v for x in (v - 1, v, v + 1)}:
            add(i, y)
    years |= {tax_year - 1, tax_year, tax_year + 1}

    def free(start: dt.date, end: dt.date) -> bool:
        """Whether no known period overlaps: those that start in time are looked at, as far back as the longest goes."""
        at = bisect_right(starts, end)
        low = bisect_left(starts, start - longest)
        return all(e < start for e in ends[low:at])

    while fresh:
        for start, end in fresh:
            at = bisect_right(starts, start)
            starts.insert(at, start)
            ends.insert(at, end)
            longest = max(longest, end - start)
        later = {x for a, b in fresh for v in (a.year, b.year) for x in (v - 1, v, v + 1)} - years
        for i, y in ((i, y) for y in later for i in range(len(shapes))):
            add(i, y)
        if later:  # places of a year that is new may touch a period that is not
            years |= later
            begun, over = set(starts), set(ends)
            touched |= {k for k in spots if k[1] in later and (spots[k][0] - day in over or spots[k][1] + day in begun)}
        for start, end in fresh:
            touched |= begins.get(end + day, set()) | finishes.get(start - day, set())
        touched = {k for k in touched if k[0] not in placed and free(*spots[k])}
        per = Counter(i for i, _ in touched)
        offers = sorted((spots[k], k[0]) for k in touched if per[k[0]] == 1)
        alone, reach = [], dt.date.min
        for n, ((start, end), i) in enumerate(offers):
            ahead = offers[n + 1][0][0] if n + 1 < len(offers) else dt.date.max
            if reach < start and end < ahead and single[i] == 1:
                alone.append((start, end, i))
            reach = max(reach, end)
        fresh = [(start, end) for start, end, _ in alone]
        placed |= {i for _, _, i in alone}
        out += [(i, start, end) for start, end, i in alone]
    return out


def _fields(lists: pa.ListArray) -> tuple[list[list], list[int]]:
    """The fields of all structs in the lists, each as one list, and where in them each of the lists begins and ends."""
    structs, ends = lists.flatten(), [0]
    for n in lists.value_lengths().to_pylist():
        ends.append(ends[-1] + n)
    return [column.to_pylist() for column in structs.flatten()], ends


def chain_header_years(headers: DataFrame, periods: DataFrame, tax_year: int, key: str = "account_id") -> DataFrame:
    """Places the remaining headers of an account next to its periods, round by round, until nothing new fits.

    headers: header_id, account, ends by month and day (start_year and end_year if shown); periods: account, start and
    end. A header is placed where exactly one placement touches a period (next day)
    and overlaps none; rivals that overlap each other are both left, so headers that look alike are never placed. That
    allows to reduce an account to its distinct headers and periods before they meet: there are some
    hundred thousand calendar shapes at most, however many rows an account has. Their rounds run in one task per account.
    """
    shown = headers
    for c in ("start_year", "end_year"):
        if c not in headers.columns:
            shown = shown.withColumn(c, F.lit(None).cast("int"))
    shapes = shown.groupBy(key, *_SHAPE).agg(F.min("header_id").alias("header_id"), F.count("*").alias("headers"))
    known = periods.filter("start_date is not null and end_date >= start_date").select(F.col(key).alias("_account"), "start_date", "end_date").distinct()
    # One row per account on either side, so that a batch of accounts goes to Python at once.
    lists = shapes.groupBy(key).agg(F.collect_list(F.struct("header_id", "headers", *_SHAPE)).alias("_heads"))
    lists = lists.join(known.groupBy("_account").agg(F.collect_list(F.struct("start_date", "end_date")).alias("_known")), F.col(key).eqNullSafe(F.col("_account"))).select("_heads", "_known")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ids, single, *parts), heads = _fields(batch.column("_heads"))
            spans, at = _fields(batch.column("_known"))
            forms, days, out = list(zip(*parts, strict=True)), list(zip(*spans, strict=True)), []
            for a, b, c, e in zip(heads, heads[1:], at, at[1:], strict=False):
                out += [(ids[a + i], start, end) for i, start, end in _chained(forms[a:b], single[a:b], days[c:e], tax_year)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (batch.column("_heads").type.value_type.field("header_id").type, pa.date32(), pa.date32()), strict=True)], names=["header_id", "start_date", "end_date"])

    types = f"header_id {headers.schema['header_id'].dataType.simpleString()}, start_date date, end_date date"
    placed = lists.mapInArrow(chain, types)
    return headers.join(placed, "header_id").withColumn("confidence", F.lit("medium")).withColumn("provenance", F.lit("inferred-chain"))


def unresolved_periods(headers: DataFrame, placed: DataFrame, key: str = "header_id") -> DataFrame:
    """Headers without a placement, each with a stable id: the first 16 hex digits of the SHA-256 of their canonical JSON."""
    rest = headers.join(placed.select(key), key, "left_anti")
    fields = [c for c in ("content_sha256", "end_day", "end_month", "line_no", "page", "start_day", "start_month") if c in headers.columns]
    canonical = F.to_json(F.struct(*[F.col(c) for c in sorted(fields)]))
    return rest.withColumn("period_id", F.substring(F.sha2(canonical, 256), 1, 16)).dropDuplicates(["period_id"])


def confirm_period_years(unresolved: DataFrame, confirmations: DataFrame, tax_year: int, key: str = "account_id") -> DataFrame:
    """Accounts whose confirmation names every unresolved period and the tax year; others with the reason."""
    need = unresolved.groupBy(key).agg(F.sort_array(F.collect_set("period_id")).alias("need"))
    have = confirmations.groupBy(key).agg(F.sort_array(F.collect_set("period_id")).alias("have"), F.bool_and(F.col("tax_year") == tax_year).alias("year_ok"))
    both = need.join(have, key, "full")
    reason = F.when(F.col("need").isNull(), "nothing-to-confirm").when(F.col("have").isNull(), "not-confirmed").when(~F.col("year_ok"), "other-tax-year").when(F.col("need") != F.col("have"), "set-differs")
    return both.select(key, reason.isNull().alias("confirmed"), reason.alias("reason"))


def gate_table(checks: list[tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """(rows, entity column, code, severity, message) -> one gate per entity and code."""
    out = None
    for rows, entity, code, severity, message in checks:
        part = rows.select(F.col(entity).cast("string").alias("entity_id")).distinct().select("entity_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))
        out = part if out is None else out.unionByName(part)
    return out


def resolve_gates(entities: DataFrame, gates: DataFrame, acceptances: DataFrame) -> DataFrame:
    """Status of every entity: ready without gates, accepted if a reviewer named exactly its gates and none is a stop, else review-required."""
    own = gates.groupBy("entity_id").agg(F.sort_array(F.collect_set("code")).alias("codes"), F.bool_or(F.col("severity") == "stop").alias("stopped"))
    said = acceptances.groupBy("entity_id").agg(F.sort_array(F.collect_set("code")).alias("accepted"))
    rows = entities.select(F.col("entity_id").cast("string").alias("entity_id")).distinct().join(own, "entity_id", "left").join(said, "entity_id", "left")
    fixed = F.arrays_overlap("codes", F.array(*map(F.lit, UNRESOLVABLE)))
    status = F.when(F.col("codes").isNull(), "ready").when(F.col("stopped") | fixed, "review-required").when(F.col("codes") == F.col("accepted"), "accepted-after-review").otherwise("review-required")
    return rows.select("entity_id", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), status.alias("status"))


def date_evidence(**kinds: DataFrame) -> DataFrame:
    """Dated evidence of all kinds in one table: (file_id, date, role); the keyword's underscores become dashes."""
    out = None
    for role, rows in kinds.items():
        part = rows.select("file_id", "date").withColumn("role", F.lit(role.replace("_", "-")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def short_date(rows: DataFrame, periods: DataFrame, key: str = "account_id") -> DataFrame:
    """Dates without a year (month, day) that have exactly one place inside the one period they belong to.

    rows: row_id, the key, month, day; a row whose page has several periods has no place.
    """
    one = periods.withColumn("_n", F.count("*").over(W.partitionBy(key))).filter("_n = 1").drop("_n")
    spots = rows.join(one.select(key, "start_date", "end_date"), key).withColumn("_y", F.explode(F.sequence(F.year("start_date"), F.year("end_date"))))
    spots = spots.withColumn("date", F.try_to_date(F.concat_ws("-", F.col("_y").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"), F.lpad(F.col("day").cast("string"), 2, "0")))).filter("date between start_date and end_date")
    return spots.withColumn("_n", F.count("*").over(W.partitionBy("row_id"))).filter("_n = 1").select("row_id", key, "date")
