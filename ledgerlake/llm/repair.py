"""Damaged conversations put back into order at the least cost, by Hirschberg's divide and conquer.

A conversation's rows become a string of symbols: what a row's role begins
with, whether it must go (blank or duplicate) and whether it is truncated. An
automaton of four states (nothing yet, after the system turn, after a user, after
an assistant turn) accepts `(s?(ua)+)?`. Forward cost vectors of the first
half and backward ones of the second half meet in the middle of the
conversation; the crossing state of least cost, and among those the one whose
audit is the ASCII-least, splits the problem in two, and each half is solved
alike. Only vectors of four costs are held.

Ties need no strings: the audits of the four states after a row end with an
edit that consumes that row, so none is another's beginning, and four ranks order
them from row to row. Because of that, a piece of a conversation can be summed
up by 4 x 4 costs and ranks, and such tables take the place of rows: conversations
of more than MAX_ROWS rows or MAX_BYTES bytes are dealt out in pieces, crossed
over in one small table per piece, and then solved piece by piece. Short ones are one row each;
texts never leave the JVM.

Defined results: null conversation ids, turns, roles and texts count as one
space in the checksum that decides the damage, and null roles and texts are one
space from then on; the rows with a null id are one conversation, with a null
id; rows of one turn follow each other by role and text; an empty role
has no initial and can't be kept, only reroled or deleted; conversations of which
no row is left return zeros; an empty table gives no rows; other columns are
ignored. The digest and the audit are one value per conversation, so the pieces
of a giant one end in one task as a stream of 64 rows a piece.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.staging import join_small, materialize
from ledgerlake.llm.skew import numbered, streamed_sha256

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A conversation of more rows or bytes is dealt out; rows of a piece; rows whose texts are joined into one.
MAX_ROWS, MAX_BYTES, PIECE, LINES = 256, 1 << 20, 4096, 64
_FAR = 1 << 60
_STATES = range(4)
#: The state after a user or assistant turn, by state; and its role.
_NEXT, _ROLE = (2, 2, 3, 2), ("u", "u", "a", "u")
#: Best entries of a table from one state to another: (cost, what orders ties from the same state, code). None: no way.
Table = list[list[tuple | None]]


def _edits(symbol: str) -> Table:
    """One row: codes are the roles of inserted turns, then K, D, U or A (reroled to user or assistant)."""
    table: Table = [[None] * 4 for _ in _STATES]
    kept, extra = symbol.lower(), TRUNCATED * symbol.isupper()
    for start in _STATES:
        state, code, cost = start, "", 0
        for _ in range(3):
            ways = [(state, DELETE, "D")]
            if kept != "d":
                ways.append((_NEXT[state], REROLE + extra, _ROLE[state].upper()))
                if kept == _ROLE[state]:
                    ways.append((_NEXT[state], extra, "K"))
                if kept == "s" and state == 0:
                    ways.append((1, extra, "K"))
            for to, price, edit in ways:
                way = (cost + price, audit(code + edit), code + edit)
                if table[start][to] is None or way < table[start][to]:
                    table[start][to] = way
            state, code, cost = _NEXT[state], code + _ROLE[state], cost + INSERT
    return table


def audit(code: str) -> str:
    return code.translate(_INITIALS)


_INITIALS = str.maketrans("uaUA", "IIRR")
_ROWS = {s: _edits(s) for s in "suaxSUAXd"}
#: Costs and inserted turns that end a conversation from each state.
_ENDS, _TAILS = [0, 2 * INSERT, INSERT, 0], ["", "ua", "a", ""]


def _forward(tables: list[Table], start: int) -> tuple[list[int], list[int]]:
    """Least costs of the states after the tables, and the order of their audits."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[start] = 0
    for table in tables:
        best = [min(((cost[p] + w[0], rank[p], w[1]) for p in _STATES if cost[p] < _FAR and (w := table[p][q])), default=None) for q in _STATES]
        order = sorted({b[1:] for b in best if b})
        cost = [b[0] if b else _FAR for b in best]
        rank = [order.index(b[1:]) if b else 0 for b in best]
    return cost, rank


def _backward(tables: list[Table], ends: list[int]) -> list[int]:
    for table in reversed(tables):
        ends = [min((w[0] + ends[q] for q in _STATES if (w := table[p][q])), default=_FAR) for p in _STATES]
    return ends


def crossings(tables: list[Table], start: int, ends: list[int]) -> list[int]:
    """The states after each table on the cheapest way with the ASCII-least audit; `ends` are the costs from each last state on."""
    if len(tables) < 2:
        return [min((w[0] + ends[q], w[1], q) for q in _STATES if (w := table[start][q]))[2] for table in tables]
    middle = len(tables) // 2
    ahead, rank = _forward(tables[:middle], start)
    back = _backward(tables[middle:], ends)
    state = min((ahead[q] + back[q], rank[q], q) for q in _STATES if ahead[q] < _FAR)[2]
    return crossings(tables[:middle], start, [0 if q == state else _FAR for q in _STATES]) + crossings(tables[middle:], state, ends)


def _codes(symbols: str, start: int, ends: list[int]) -> tuple[int, list[str], int]:
    """Cost, a code per row and the last state."""
    tables = [_ROWS[s] for s in symbols]
    cost, codes = 0, []
    for table, state in zip(tables, crossings(tables, start, ends), strict=True):
        price, _, code = table[start][state]
        cost, start = cost + price, state
        codes.append(code)
    return cost, codes, start


@lru_cache(maxsize=1 << 16)
def solve(symbols: str) -> tuple[str, ...]:
    """(cost, code of turns inserted at the end, code of each row ...) of a whole conversation."""
    cost, codes, state = _codes(symbols, 0, _ENDS)
    return (str(cost + _ENDS[state]), _TAILS[state], *codes)


def summary(symbols: str) -> list[int]:
    """A piece as one table, flat: cost and rank by first and last state; cost -1 where there is no way."""
    flat = []
    for start in _STATES:
        cost, rank = _forward([_ROWS[s] for s in symbols], start)
        flat += [v for q in _STATES for v in (cost[q] if cost[q] < _FAR else -1, rank[q])]
    return flat


@F.pandas_udf(T.ArrayType(T.StringType()))
def _solved(symbols: pd.Series) -> pd.Series:
    return symbols.map(lambda s: list(solve(s)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _summaries(symbols: pd.Series) -> pd.Series:
    return symbols.map(summary)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _piece_codes(symbols: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([_codes(s, a, [0 if q == b else _FAR for q in _STATES])[1] for s, a, b in zip(symbols, start, end, strict=True)], dtype=object)


def _cross_pieces(rows: pa.Table) -> pa.Table:
    """All pieces of a conversation, as tables: the states at which each begins and ends, the cost, and the code of turns inserted at the end."""
    rows = rows.sort_by("piece")
    tables = [[[(f[8 * p + 2 * q], f[8 * p + 2 * q + 1]) if f[8 * p + 2 * q] >= 0 else None for q in _STATES] for p in _STATES] for f in rows.column("flat").to_pylist()]
    states = [0, *crossings(tables, 0, _ENDS)]
    cost = sum(t[a][b][0] for t, a, b in zip(tables, states, states[1:], strict=False)) + _ENDS[states[-1]]
    n = len(tables)
    return pa.table({"ck": rows.column("ck"), "piece": rows.column("piece"), "start": pa.array(states[:-1], pa.int32()), "end": pa.array(states[1:], pa.int32()), "cost": pa.array([cost] * n, pa.int64()), "tail": pa.array([_TAILS[states[-1]]] * n)})


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> ck (a key that is never null), conv_id, turn, role, text, times (0: dropped, 2: repeated)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = conversations.select(F.coalesce(F.concat(F.lit("#"), F.col("conv_id").cast("string")), F.lit("")).alias("ck"), "conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("ck", "conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"))


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _closed(text: Column) -> Column:
    return text.rlike(r"[.!?][\x20\x09-\x0D]*+\z")


def _fault(blank: Column, repeated: Column, closed: Column) -> Column:
    return F.when(blank, "blank").when(repeated, "duplicate").when(~closed, "truncated").otherwise("")


def _symbol(fault: Column, role: Column) -> Column:
    initial = F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("x")
    return F.when(fault.isin("blank", "duplicate"), "d").when(fault == "truncated", F.upper(initial)).otherwise(initial)


def _lines(code: Column, role: Column, text: Column) -> Column:
    """The repaired lines of one row: those of inserted turns, then its own."""
    said = lambda who: F.concat(who, F.lit(":"), text)
    last = F.substring(code, -1, 1)
    own = F.when(last == "K", F.array(said(role))).when(last == "U", F.array(said(F.lit("user")))).when(last == "A", F.array(said(F.lit("assistant")))).otherwise(F.array().cast("array<string>"))
    return F.concat(_inserted(code), own)


def _inserted(code: Column) -> Column:
    return F.transform(F.filter(F.split(code, ""), lambda c: c.isin("u", "a")), lambda c: F.when(c == "u", "user:").otherwise("assistant:"))


def _audit(code: Column) -> Column:
    return F.translate(code, "uaUA", "IIRR")


_LEGAL = ("su", "ua", "au")
_COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _short(rows: DataFrame) -> DataFrame:
    """One row a conversation, whose turns are gathered in an array."""
    turns = F.flatten(F.transform(F.collect_list(F.when(F.col("times") > 0, F.struct(F.struct("turn", "role", "text").alias("r"), "times"))), lambda x: F.array_repeat(x["r"], x["times"])))
    one = rows.groupBy("ck", "conv_id").agg(F.sort_array(turns).alias("t"))
    said = one.withColumn("said", F.transform("t", lambda x: F.struct(x["role"], x["text"])))
    faults = F.transform("t", lambda x, i: _fault(_blank(x["text"]), F.array_position("said", F.struct(x["role"], x["text"])) <= i, _closed(x["text"])))
    solved = said.withColumn("faults", faults).withColumn("symbols", F.array_join(F.zip_with("t", "faults", lambda x, f: _symbol(f, x["role"])), "")).withColumn("found", _solved("symbols"))
    codes = F.slice("found", 3, F.size("found"))
    lines = F.concat(F.flatten(F.zip_with("t", codes, lambda x, c: _lines(c, x["role"], x["text"]))), _inserted(F.element_at("found", 2)))
    number = lambda fault: F.size(F.filter("faults", lambda f: f == fault)).cast("bigint").alias(fault)
    initials = F.transform("t", lambda x: F.substring(x["role"], 1, 1))
    pairs = F.zip_with(initials, F.slice(initials, 2, F.greatest(F.size("t"), F.lit(1))), lambda a, b: ~F.concat(a, b).isin(*_LEGAL))
    seen = F.filter(F.transform("t", lambda x: x["turn"]), lambda v: v.isNotNull())
    gaps = F.coalesce(F.array_max(seen) - F.array_min(seen) + 1 - F.size(F.array_distinct(seen)), F.lit(0)).cast("bigint")
    return solved.select(
        "conv_id",
        gaps.alias("gaps"),
        number("blank"),
        number("duplicate"),
        number("truncated"),
        F.size(F.filter(pairs, lambda p: p)).cast("bigint").alias("illegal"),
        F.element_at("found", 1).cast("bigint").alias("cost"),
        _audit(F.concat(F.array_join(codes, ""), F.element_at("found", 2))).alias("audit"),
        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )


def _long(rows: DataFrame, piece: int) -> DataFrame:
    """Conversations of any length, dealt out by place."""
    spread = rows.filter("times > 0").withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")
    every = materialize(numbered(spread, "ck", ["turn", "role", "text"], "repair-sorted").withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64("text", "role")), "repair-rows")
    firsts = every.groupBy("ck", "h1", "h2").agg(F.min("pos").alias("pos")).select("ck", "pos", F.lit(True).alias("first"))
    after = every.select("ck", (F.col("pos") - 1).alias("pos"), F.substring("role", 1, 1).alias("after"))
    marks = every.join(firsts, ["ck", "pos"], "left").join(after, ["ck", "pos"], "left")
    marks = marks.withColumn("fault", _fault(_blank(F.col("text")), F.col("first").isNull(), _closed(F.col("text"))))
    illegal = (~F.concat(F.substring("role", 1, 1), "after").isin(*_LEGAL)).cast("bigint")
    marks = materialize(marks.select("ck", "conv_id", "pos", "turn", "fault", _symbol(F.col("fault"), F.col("role")).alias("symbol"), illegal.alias("illegal")), "repair-marks")
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "")
    pieces = materialize(marks.groupBy("ck", F.floor(F.col("pos") / piece).alias("piece")).agg(ordered.alias("symbols")), "repair-pieces")
    crossed = pieces.select("ck", "piece", _summaries("symbols").alias("flat")).groupBy("ck").applyInArrow(_cross_pieces, "ck string, piece bigint, start int, end int, cost bigint, tail string")
    crossed = materialize(crossed, "repair-crossings")
    codes = materialize(pieces.join(crossed, ["ck", "piece"]).withColumn("codes", _piece_codes("symbols", "start", "end")).select("ck", "piece", "tail", "cost", "codes"), "repair-codes")
    per_row = codes.select("ck", "piece", F.posexplode("codes").alias("at", "code")).select("ck", (F.col("piece") * piece + F.col("at")).alias("pos"), "code")
    lines = every.select("ck", "pos", "role", "text").join(per_row, ["ck", "pos"]).select("ck", "pos", _lines(F.col("code"), F.col("role"), F.col("text")).alias("lines"))
    ends = crossed.groupBy("ck").agg(F.max("cost").alias("cost"), F.max("tail").alias("tail"))
    lines = lines.union(ends.select("ck", F.lit(2**62).cast("bigint"), _inserted(F.col("tail")))).filter(F.size("lines") > 0)
    joined = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "lines"))), lambda x: x["lines"])), "\n")
    parts = lines.groupBy("ck", F.floor(F.col("pos") / LINES).alias("at")).agg(joined.alias("part"))
    digests = streamed_sha256(parts, "ck", "at", "part", b"\n", "repaired_sha256")
    written = codes.groupBy("ck").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", _audit(F.array_join("codes", "")).alias("a")))), lambda x: x["a"]), "").alias("codes"))
    number = lambda fault: F.sum((F.col("fault") == fault).cast("bigint")).alias(fault)
    counts = marks.groupBy("ck", "conv_id").agg(number("blank"), number("duplicate"), number("truncated"), F.coalesce(F.sum("illegal"), F.lit(0)).alias("illegal"), F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"))
    turns = marks.groupBy("ck", "turn").agg(F.lit(1).alias("one")).groupBy("ck").agg(F.count("turn").alias("turns"))
    whole = counts.join(turns, "ck").join(ends, "ck").join(written, "ck").join(digests, "ck", "left")
    whole = whole.withColumn("gaps", F.col("span") - F.col("turns")).withColumn("audit", F.concat("codes", _audit(F.col("tail"))))
    return whole.select(*_COLUMNS[:-1], F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair(conversations: DataFrame, *, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, piece: int = PIECE) -> DataFrame:
    """One row per conversation: the faults of its damaged rows, and the cost, audit and digest of its cheapest repair."""
    rows = damaged(conversations)
    size = rows.groupBy("ck").agg(F.sum("times").alias("n"), F.sum(F.octet_length("text") * F.col("times")).alias("b"))
    long_ = materialize(size.filter((F.col("n") > max_rows) | ((F.col("b") > max_bytes) & (F.col("n") > 1))).select("ck"), "repair-long")
    if long_.isEmpty():
        return _short(rows)
    return _short(join_small(rows, long_, "ck", "left_anti")).union(_long(join_small(rows, long_, "ck", "left_semi"), piece))
