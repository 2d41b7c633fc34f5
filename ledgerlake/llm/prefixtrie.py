"""A trie of conversations, built as a distributed z-fast trie.

Two conversations share a node for every run of first turns, role and text, that
they have in common. Texts are read once, for a 128-bit hash of each turn; the
hash of a prefix is the exclusive or of its turns' hashes, each mixed with its
depth, so prefix hashes are two-level running values even in a conversation
that holds a third of all rows.

The compacted trie has nodes only where conversations end or part. Node (s, e]
spans the depths after its parent's e; its handle is the prefix at the
2-fattest number of (s, e], the one divisible by the largest power of two, and
the dictionary finds nodes by the hashes of their handles. A
conversation is located by fat binary search: it asks at the 2-fattest depth of
what is left of (0, length], goes on behind the node found or before the depth
asked. Numbers divisible by 2**k are asked in step k of a batch, so
a step joins only the handles of those depths. Keys of up to BLOCK turns
carry the hashes of their prefixes along; longer ones look them up in a table. The exit edge then follows from the node found, or from
its child by the next turn; and the depth at which the conversation leaves it,
from the prefixes on the edge.

Insertion goes in batches. All that leave an edge at one depth with the same next
turn send one of them, by hash, whose whole rest becomes a new path; edges are
split where paths leave or conversations end; the others are located again in the
next batch, below that path. Counted tables of up to 100,000 rows are broadcast, so small batches need no shuffles. As the senders are random, a conversation
waits for a number of batches logarithmic in the conversations. Sums over
subtrees run from the last batch's paths to the first's: along a path from its
end, then to the node it hangs from. At last edges are expanded to one
row per depth.

Defined results: rows with a null conv_id belong to no conversation; null
roles and texts are empty; turns with one number follow each other by hash;
repeated rows are repeated turns; negative ids take the sign of their
remainder, as SQL does; an empty table gives no rows, not even the root; other
columns are ignored. Prefixes common to many conversations are joined with
salts, and conversations with equal turns go on as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlake.functions.staging import materialize
from ledgerlake.llm.skew import MAX_SIDE, hot_keys, numbered, salted_join, spread_join, streamed_sha256

#: Donors are the ids divisible by GROUP; up to SHARED - 1 of their turns come first.
GROUP, SHARED = 100, 6
#: Depths that one window row run or one array covers; 2 ** ID_BITS ids are joined into one piece of a digest.
BLOCK, ID_BITS = 1024, 14
#: Steps of the search between two written tables.
STEPS = 3


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(c) of every conversation, (c, d, x1, x2, chars) of its rebuilt turns, d from 1, and the few conversations that hold many rows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("c"), "turn", F.xxhash64(role, text).alias("x1"), F.xxhash64(text, role).alias("x2"), F.char_length(text).cast("bigint").alias("chars"))
    own = materialize(numbered(turns, "c", ["turn", "x1", "x2"], "trie-sorted").select("c", "pos", "x1", "x2", "chars"), "trie-turns")
    sizes = materialize(own.groupBy("c").agg(F.count("*").alias("n")), "trie-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    long_ = materialize(sizes.filter(F.col("n") > max(total / 4096, BLOCK)).select("c"), "trie-long")
    borrowed = lambda c: F.crc32(c.cast("string")) % SHARED
    donor = lambda c: c - c % GROUP
    c = F.col("c")
    convs = sizes.select("c", borrowed(c).alias("h"), donor(c).alias("p"))
    first = convs.join(own.filter(F.col("pos") < SHARED - 1).withColumnRenamed("c", "p"), "p").filter("pos < h").select("c", (F.col("pos") + 1).alias("d"), "x1", "x2", "chars")
    n_convs = sizes.count()
    had = convs.join(sizes.select(F.col("c").alias("p"), "n"), "p", "left").select("c", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("had"))
    rest = own.join(F.broadcast(had), "c") if n_convs <= MAX_SIDE else spread_join(own, had, ["c"], long_, F.col("pos"), "inner")
    rest = rest.filter("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("had") + 1).alias("d"), "x1", "x2", "chars")
    return sizes.select("c"), first.union(rest), long_


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, h1, h2, chars, upto): hash and code points of the first d turns."""
    mixed = turns.select("c", "d", F.floor((F.col("d") - 1) / BLOCK).alias("block"), F.xxhash64("d", "x1", "x2").alias("g1"), F.xxhash64("x2", "x1", "d").alias("g2"), "chars")
    mixed = materialize(mixed, "trie-rebuilt")
    inside = W.partitionBy("c", "block").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("c").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = mixed.groupBy("c", "block").agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2"), F.sum("chars").alias("chars"))
    base = sums.select("c", "block", F.bit_xor("g1").over(before).alias("b1"), F.bit_xor("g2").over(before).alias("b2"), F.sum("chars").over(before).alias("bc")).filter("block > 0")
    local = mixed.select("c", "d", "block", "chars", F.bit_xor("g1").over(inside).alias("g1"), F.bit_xor("g2").over(inside).alias("g2"), F.sum("chars").over(inside).alias("upto"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return local.join(base, ["c", "block"], "left").select("c", "d", F.col("g1").bitwiseXOR(zero("b1")).alias("h1"), F.col("g2").bitwiseXOR(zero("b2")).alias("h2"), "chars", (F.col("upto") + zero("bc")).alias("upto"))


def _fattest(a: str, b: str) -> Column:
    """The number in (a, b] that the largest power of two divides."""
    return F.expr(f"{b} & shiftleft(-1L, length(bin({a} ^ {b})) - 1)")


def _at(level: int, depth: str) -> str:
    """SQL: 2**level divides the depth and 2**(level + 1) doesn't."""
    return f"{depth} & {(2 << level) - 1}L = {1 << level}L"


def _exploded(df: DataFrame, lo: str, hi: str, out: str) -> DataFrame:
    """A row for each number of (lo, hi], first by blocks, so no array is long."""
    blocks = df.withColumn("_block", F.explode(F.expr(f"sequence({lo} + 1, {hi}, {BLOCK}L)")))
    return blocks.withColumn(out, F.explode(F.expr(f"sequence(_block, least({hi}, _block + {BLOCK - 1}))"))).drop("_block")


class _Trie:
    """The tables of a trie that grows: prefixes of the keys, paths, nodes by (path, e), and where keys end."""

    def __init__(self, prefix: DataFrame, long_: DataFrame, longest: int):
        self.prefix, self.long, self.longest = prefix, long_, longest
        self.at = prefix.select(F.col("c").alias("key"), F.col("d").alias("_d"), "h1", "h2", "_hot")
        self.paths: list[DataFrame] = []
        self.nodes: DataFrame | None = None
        self.ends: list[DataFrame] = []
        self.known: list[DataFrame] = []
        self.n_paths = self.n_nodes = self.n_known = 0

    def looked_up(self, state: DataFrame, level: int | None = None) -> DataFrame:
        """Adds h1, h2 and _hot: the key's prefix at depth _d, if there is one, from its array `ph` or, for long keys, from the table of prefixes."""
        if "ph" in state.columns:
            found = state.withColumn("_p", F.get("ph", F.col("_d").cast("int") - 1)).select("*", F.col("_p.h1").alias("h1"), F.col("_p.h2").alias("h2"), F.col("_p._hot").alias("_hot")).drop("_p")
        else:
            found = state.join(self.at if level is None else self.at.filter(_at(level, "_d")), ["key", "_d"], "left")
        # Keys that ask for nothing are spread by their own number, not gathered as nulls.
        return found.withColumn("h1", F.coalesce("h1", "key")).withColumn("h2", F.coalesce("h2", F.lit(0))).withColumn("_hot", F.coalesce("_hot", F.lit(False)))

    def met(self, left: DataFrame, right: DataFrame, rows: int, how: str = "left") -> DataFrame:
        """left with the one row of right that has the same prefix; broadcast if right's counted rows allow it."""
        if rows <= MAX_SIDE:
            return left.drop("_hot").join(F.broadcast(right.drop("_hot")), ["h1", "h2"], how)
        return salted_join(left, right, ["h1", "h2"], F.col("key"), how)

    def edges(self, *depths: tuple[str, str]) -> DataFrame:
        """Nodes (path, e) with s, the depth of the parent, and for each (name, SQL of a depth) the prefix there: name1, name2, name_hot, name_upto."""
        paths = reduce(DataFrame.union, self.paths).select("path", "l")
        rows = self.nodes.join(_small(paths, self.n_paths), "path").select("path", "e", F.coalesce(F.lag("e").over(W.partitionBy("path").orderBy("e")), "l").alias("s"))
        rows = rows.withColumn("f", _fattest("s", "e"))
        wanted = rows.withColumn("_w", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.expr(sql).alias("depth")) for name, sql in depths]))).select("path", "e", "s", "f", F.col("_w.name").alias("name"), F.col("_w.depth").alias("depth"))
        # A depth of 0 has no prefix, but every node has one at its end.
        found = self.prefix.select(F.col("c").alias("path"), F.col("d").alias("depth"), "h1", "h2", "_hot", "upto").join(_small(wanted, self.n_nodes * len(depths)), ["path", "depth"])
        pick = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
        return found.groupBy("path", "e", "s", "f").agg(*[pick(name, c).alias(f"{name}{end}") for name, _ in depths for c, end in (("h1", "1"), ("h2", "2"), ("_hot", "_hot"), ("upto", "_upto"))])

    def locate(self, pending: DataFrame, nodes: DataFrame | None) -> DataFrame:
        """Adds path and l: the depth at which the key leaves the trie, and a path through that place (null: the root)."""
        if nodes is None:
            return pending.withColumn("path", F.lit(None).cast("bigint")).withColumn("l", F.lit(0).cast("bigint"))
        state = pending.select("*", F.lit(0).cast("bigint").alias("a"), F.col("len").alias("b"), *[F.lit(None).cast("bigint").alias(n) for n in ("path", "e", "f", "e1", "e2")])
        narrow = "ph" in pending.columns and self.n_nodes <= MAX_SIDE  # then all steps are one pass over the keys
        longest = min(self.longest, BLOCK) if "ph" in pending.columns else self.longest
        for step, level in enumerate(range(longest.bit_length() - 1, -1, -1), 1):
            state = self._asked(state, nodes, level)
            if step % STEPS == 0 and not narrow:
                state = materialize(state, "trie-search")
        return self._left(state if narrow else materialize(state, "trie-search"), nodes, narrow)

    def _asked(self, state: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
        """One step of the fat binary search, for the keys that ask at a depth of this level."""
        asks = state.withColumn("_f", F.when(F.col("a") < F.col("b"), _fattest("a", "b"))).withColumn("_d", F.when(F.expr(_at(level, "_f")), F.col("_f"))).drop("_f")
        handles = nodes.filter(_at(level, "f")).select(F.col("f1").alias("h1"), F.col("f2").alias("h2"), F.col("f_hot").alias("_hot"), F.col("path").alias("_path"), F.col("e").alias("_e"), F.col("f").alias("_f"), F.col("e1").alias("_e1"), F.col("e2").alias("_e2"))
        met = self.met(self.looked_up(asks, level), handles, self.n_nodes)
        found = F.col("_d").isNotNull() & F.col("_path").isNotNull()
        news = {n: F.when(found, F.col(f"_{n}")).otherwise(F.col(n)) for n in ("path", "e", "f", "e1", "e2")}
        low = F.when(found, F.col("_e")).otherwise(F.col("a"))
        high = F.when(F.col("_d").isNotNull() & F.col("_path").isNull(), F.col("_d") - 1).otherwise(F.col("b"))
        kept = [c for c in ("key", "len", "ph") if c in state.columns]
        return met.select(*kept, low.alias("a"), high.alias("b"), *[c.alias(n) for n, c in news.items()])

    def _left(self, state: DataFrame, nodes: DataFrame, narrow: bool) -> DataFrame:
        """From the last node whose handle is a prefix of the key: the exit edge, and the depth at which the key leaves it."""
        kept = [c for c in ("key", "len", "ph") if c in state.columns]
        end = self.looked_up(state.withColumn("_d", F.coalesce("e", F.lit(0))))
        passes = F.col("e").isNull() | ((F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")))
        end = end.select(*kept, "path", "e", "f", passes.alias("passes")).withColumn("_d", F.when(F.col("passes"), F.coalesce("e", F.lit(0)) + 1))
        children = nodes.select(F.col("s1").alias("h1"), F.col("s2").alias("h2"), F.col("s_hot").alias("_hot"), F.col("path").alias("_path"), F.col("s").alias("_s"), F.col("f").alias("_f"))
        exits = self.met(self.looked_up(end), children, self.n_nodes)
        child = F.col("passes") & F.col("_path").isNotNull()
        depth = F.coalesce("e", F.lit(0))
        low = F.when(child, F.col("_s") + 1).when(F.col("passes"), depth).otherwise(F.col("f"))
        high = F.when(child, F.least("len", F.col("_f") - 1)).when(F.col("passes"), depth).otherwise(F.least("len", F.col("e") - 1))
        exits = materialize(exits.select(*kept, F.when(child, F.col("_path")).otherwise(F.col("path")).alias("path"), low.alias("low"), high.alias("high")), "trie-exits")
        asked = self.looked_up(_exploded(exits.filter("low < high"), "low", "high", "_d"))
        shared = self.met(asked.select("key", "_d", "h1", "h2", "_hot"), reduce(DataFrame.union, self.known), self.n_known, "inner").groupBy("key").agg(F.max("_d").alias("_l"))
        return exits.join(F.broadcast(shared) if narrow and exits.count() <= MAX_SIDE else shared, "key", "left").select(*kept, "path", F.coalesce("_l", "low").alias("l"))

    def insert(self, pending: DataFrame, long_keys: bool) -> tuple[DataFrame, int]:
        """One batch; returns the keys that have to be located again, and their number."""
        nodes = materialize(self.edges(("f", "f"), ("e", "e"), ("s", "s + 1")), "trie-nodes") if self.paths else None
        given = [pending.filter("ph is not null"), pending.filter("ph is null").drop("ph")] if long_keys else [pending]
        parts = [self.looked_up(self.locate(part, nodes).withColumn("_d", F.when(F.col("l") < F.col("len"), F.col("l") + 1))) for part in given]
        found = materialize(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).select("key", "len", "ph", "path", "l", "h1", "h2"), "trie-found")
        ended = found.filter("l = len")
        sent = F.min(F.struct(F.xxhash64("key").alias("_by"), "key", "len", "path", "l"))
        new = found.filter("l < len").groupBy("h1", "h2").agg(sent.alias("w")).select(F.col("w.key").alias("path"), F.lit(len(self.paths)).alias("batch"), F.col("w.path").alias("above"), F.col("w.l").alias("l"), F.col("w.len").alias("len"))
        new = materialize(new, "trie-paths")
        n_new, n_left = new.count(), found.filter("l < len").count()
        self.paths.append(new)
        self.n_paths += n_new
        self.ends += [ended.select("key", "path", F.col("l").alias("e")), new.select(F.col("path").alias("key"), "path", F.col("len").alias("e"))]
        places = ended.select("path", F.col("l").alias("e")).union(new.select(F.col("above").alias("path"), F.col("l").alias("e"))).filter("e > 0").union(new.select("path", F.col("len").alias("e"))).distinct()
        self.nodes = materialize(places if self.nodes is None else self.nodes.union(places).distinct(), "trie-places")
        self.n_nodes = self.nodes.count()
        heads = new.select(F.col("path").alias("c"), "l")
        rows = self.prefix.withColumnRenamed("_hot", "_common")
        rows = rows.join(F.broadcast(heads), "c") if n_new <= MAX_SIDE else spread_join(rows, heads, ["c"], self.long, F.col("d"), "inner")
        known = materialize(rows.filter("d > l").select("h1", "h2", F.col("_common").alias("_hot")), "trie-known")
        self.known.append(known)
        self.n_known += known.count()
        rest = found.filter("l < len").select("key", "len", "ph").join(_small(new.select(F.col("path").alias("key")), n_new), "key", "left_anti")
        return rest, n_left - n_new


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for a broadcast if `rows`, the most that it has, is within the bound."""
    return F.broadcast(df) if rows <= MAX_SIDE else df


def _digests(members: DataFrame, key: str) -> DataFrame:
    """(key, c) -> (key, sha): SHA-256 of the ids in order, joined by commas; pieces of ids are joined first, so a digest reads a row per piece."""
    parts = members.groupBy(key, F.shiftright("c", ID_BITS).alias("at")).agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("part"))
    parts = materialize(parts, "trie-ids")
    many = materialize(parts.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key), "trie-many")
    single = parts.join(many, key, "left_anti").select(key, F.sha2("part", 256).alias("sha"))
    return single.union(streamed_sha256(parts.join(many, key, "left_semi"), key, "at", "part", b",", "sha"))


def _along(nodes: DataFrame) -> DataFrame:
    """Sums of subtrees for the nodes of one batch's paths, given what ends in each node and what hangs from it."""
    up = W.partitionBy("path").orderBy(F.desc("e")).rowsBetween(W.unboundedPreceding, W.currentRow)
    below = W.partitionBy("path").orderBy(F.desc("e")).rowsBetween(W.unboundedPreceding, -1)
    last = F.row_number().over(W.partitionBy("path").orderBy(F.desc("e"))) == 1
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    rows = nodes.select("*", F.sum(zero("rows") + zero("hung_n")).over(up).alias("n"), F.min(F.least("id", "hung_id")).over(up).alias("conv"), last.alias("last"))
    rows = rows.withColumn("kids", zero("hung_kids") + F.when(F.col("last"), 0).otherwise(1)).withColumn("on_edge", (F.col("n") - 1) * (F.col("upto") - F.col("above_upto")))
    leaf = F.when(F.col("kids") == 0, 1).otherwise(0)
    return rows.withColumn("leaves", F.sum(zero("hung_leaves") + leaf).over(up).cast("bigint")).withColumn("under", zero("hung_saved") + zero(F.sum(F.col("on_edge") + zero("hung_saved")).over(below)))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    convs, turns, long_ = rebuilt(conversations)
    every = materialize(prefixes(turns), "trie-prefixes")
    last = materialize(every.groupBy("c").agg(F.max(F.struct("d", "h1", "h2")).alias("m")).select("c", F.col("m.d").alias("len"), F.col("m.h1").alias("h1"), F.col("m.h2").alias("h2")), "trie-last")
    name = F.concat_ws(":", "len", "h1", "h2").alias("sequence")
    classes = last.groupBy(name).agg(F.min("c").alias("key"), F.first("len").alias("len"), F.count("*").alias("rows"))
    keys = materialize(classes.join(_digests(last.select(name, "c"), "sequence"), "sequence").select("key", "len", "rows", "sha"), "trie-keys")
    n_keys = keys.count()
    named = keys.select(F.col("key").alias("c"), "len")
    prefix = every.join(F.broadcast(named), "c") if n_keys <= MAX_SIDE else spread_join(every, named, ["c"], long_, F.col("d"), "inner")
    prefix = materialize(prefix, "trie-own")
    common = F.broadcast(hot_keys(prefix, ["h1", "h2"], prefix.count()).withColumn("_hot", F.lit(True)))
    prefix = materialize(prefix.join(common, ["h1", "h2"], "left").withColumn("_hot", F.coalesce("_hot", F.lit(False))), "trie-marked")
    # A key of up to BLOCK turns carries the hashes of its prefixes along; longer ones look them up.
    short = prefix.filter(F.col("len") <= BLOCK).groupBy(F.col("c").alias("key"), "len").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "h1", "h2", "_hot"))), lambda p: F.struct(p["h1"].alias("h1"), p["h2"].alias("h2"), p["_hot"].alias("_hot"))).alias("ph"))
    longest = keys.agg(F.max("len")).first()[0] or 0
    pending = materialize(short.unionByName(keys.filter(F.col("len") > BLOCK).select("key", "len"), allowMissingColumns=True), "trie-pending")

    grown, left = _Trie(prefix.drop("len"), long_, longest), n_keys
    while left:
        pending, left = grown.insert(pending, longest > BLOCK)

    bare = materialize(convs.join(last.select("c"), "c", "left_anti").select(F.lit("root").alias("sequence"), "c"), "trie-bare")
    counts = convs.agg(F.count("*").alias("n"), F.min("c").alias("id")).first()
    empty = F.sha2(F.lit(""), 256)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    bare_sha = [r["sha"] for r in _digests(bare, "sequence").collect()]
    kids = leaves = saved = 0
    nodes = None
    if grown.paths:
        nodes = _summed(grown, keys, n_keys)
        at_root = nodes.filter("first and l = 0").agg(F.count("*"), F.sum("leaves"), F.sum(F.col("under") + F.col("on_edge"))).first()
        kids, leaves, saved = (v or 0 for v in at_root)
    rows = conversations.sparkSession.createDataFrame([(counts["id"], 0, None, counts["n"], kids, leaves or 1, saved, (bare_sha or [None])[0])] if counts["n"] else [], ", ".join(f"{c} bigint" for c in columns[:-1]) + ", sha string")
    root = rows.select(*columns[:-1], F.coalesce("sha", empty).alias("ends_sha256"))
    return root if nodes is None else root.unionByName(_expanded(grown, nodes, counts["id"]).select(columns))


def _summed(grown: _Trie, keys: DataFrame, n_keys: int) -> DataFrame:
    """All compacted nodes with the sums of their subtrees, from the last batch's paths to the first's."""
    paths = reduce(DataFrame.union, grown.paths)
    edges = grown.edges(("e", "e"), ("s", "s")).select("path", "e", "s", F.col("e_upto").alias("upto"), F.coalesce("s_upto", F.lit(0)).alias("above_upto"))
    ends = reduce(DataFrame.union, grown.ends).join(keys.select("key", "rows", "sha"), "key").select("path", "e", F.col("key").alias("id"), "rows", "sha")
    edges = materialize(edges.join(_small(paths.select("path", "batch", "above", "l"), grown.n_paths), "path").join(_small(ends, n_keys), ["path", "e"], "left"), "trie-edges")
    done, tops = [], None
    hung = ["hung_n", "hung_id", "hung_leaves", "hung_saved", "hung_kids"]
    for batch in range(len(grown.paths) - 1, -1, -1):
        level = edges.filter(F.col("batch") == batch)
        if tops is None:
            level = level.select("*", *[F.lit(None).cast("bigint").alias(c) for c in hung])
        else:
            sums = tops.groupBy("above", "l").agg(F.sum("n").alias("hung_n"), F.min("conv").alias("hung_id"), F.sum("leaves").alias("hung_leaves"), F.sum("total").alias("hung_saved"), F.count("*").alias("hung_kids"))
            level = level.join(_small(sums.select(F.col("above").alias("path"), F.col("l").alias("e"), *hung), grown.n_paths), ["path", "e"], "left")
        level = _along(level).withColumn("first", F.col("s") == F.col("l"))
        level = materialize(level.select("path", "e", "s", "above", "l", "first", "upto", "above_upto", "n", "conv", "kids", "leaves", "under", "on_edge", "sha"), "trie-sums")
        done.append(level)
        top = level.filter("first").select("above", "l", "n", "conv", "leaves", (F.col("under") + F.col("on_edge")).alias("total"))
        tops = top if tops is None else tops.union(top)
    return reduce(DataFrame.union, done)


def _expanded(grown: _Trie, nodes: DataFrame, root_id: int) -> DataFrame:
    """One row per depth of every edge."""
    named = nodes.select(F.col("path").alias("above"), F.col("e").alias("l"), F.col("conv").alias("above_conv"))
    tops = nodes.filter("first").select("path", "above", "l")
    if grown.n_nodes <= MAX_SIDE:
        joined = tops.join(F.broadcast(named), ["above", "l"], "left")
    else:
        joined = spread_join(tops, named, ["above", "l"], materialize(hot_keys(tops, ["above", "l"], grown.n_paths), "trie-crowded"), F.col("path"))
    parents = joined.select("path", F.coalesce("above_conv", F.lit(root_id)).alias("above_conv"))
    before = F.lag("conv").over(W.partitionBy("path").orderBy("e"))
    rows = nodes.withColumn("before", before).join(parents, "path").withColumn("parent", F.coalesce("before", "above_conv"))
    rows = _exploded(rows.select("path", "s", "e", "n", "conv", "parent", "kids", "leaves", "under", "upto", "sha"), "s", "e", "d")
    rows = rows.join(grown.prefix.select(F.col("c").alias("path"), "d", "chars", F.col("upto").alias("here")), ["path", "d"])
    ends = F.col("d") == F.col("e")
    return rows.select(
        F.col("conv").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("s") + 1, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(ends, F.col("kids")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("under") + (F.col("n") - 1) * (F.col("upto") - F.col("here") + F.col("chars"))).alias("saved_tokens"),
        F.when(ends & F.col("sha").isNotNull(), F.col("sha")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
