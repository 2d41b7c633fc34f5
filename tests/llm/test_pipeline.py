"""Each stage of the pipeline on its own input against brute force, and the whole of it."""

import collections
import hashlib
import re
import zlib

import corpus_pipeline
from test_operators import contamination, groups

STEPS = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def times_of(rows):
    """How often the mix takes each row: blocks of words along each source's line, as far as its slots reach."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    size = {s: sum(words(r[1]) for r in rows if r[3] == s) for s in sources}
    total, weight = sum(size.values()), {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:  # cap, reshare, until none is above
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        for s in over or open_:
            target[s] = 3 * size[s] if over else level * weight[s]
        open_ -= over or open_
    return target


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs.columns
    assert list(STEPS) == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]

    read = STEPS["language_id"](spark, docs, sf).cache()
    assert read.columns == start and sorted(rows_of(read), key=str) == sorted((r for r in rows_of(docs) if r[1] and any(c.isalpha() for c in r[1])), key=str)

    single = STEPS["near_dedup"](spark, read, sf).cache()
    kept = {i for i, (_, _, _, keep) in groups([(r.doc_id, r.text) for r in read.collect()]).items() if keep}
    assert single.columns == start and sorted(r.doc_id for r in single.collect()) == sorted(kept)

    clean = STEPS["decontamination"](spark, single, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {c[0] for c in contamination([(r.doc_id, r.text) for r in single.collect()], items) if c[-1]}
    assert clean.columns == start and {r.doc_id for r in clean.collect()} == kept - bad

    mixed = STEPS["mixing"](spark, clean, sf).cache()
    before, after = rows_of(clean), rows_of(mixed)
    at = [start.index(c) for c in ("doc_id", "text", "lang", "source")]
    pick = lambda rows: [tuple(r[i] for i in at) for r in rows]
    counts = collections.Counter(pick(after))
    assert mixed.columns == start and set(after) <= set(before) and max(counts.values()) <= 3
    target = times_of(pick(before))
    for s, want in target.items():
        got = sum(words(r[1]) * n for r, n in counts.items() if r[3] == s)
        longest = max((words(r[1]) for r in pick(before) if r[3] == s), default=0)
        assert abs(got - want) <= longest + 0.02 * want

    sharded = STEPS["sharding"](spark, mixed, sf)
    out = sharded.collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted((r[start.index("doc_id")], r[start.index("text")]) for r in after)
    by = collections.Counter()
    slots = collections.defaultdict(list)
    for r in out:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
    groups_of = collections.Counter()
    for r in out:
        groups_of[hashlib.md5((r.text or "").encode()).hexdigest()] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(by.values()) - min(by.values()) <= 4 * max(groups_of.values())


ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "plain words of a text here", None, None), (3, "plain words of a text here", None, None), (3, "something else is told in this one", "en", "a"),
    (None, "some more words here", "en", "a"), (None, "some more words here", "en", "a"), (None, "words that no other row has at all", "en", "null"), (4, "plain words of a text here", "en", "b"), (5, "...", "en", "b"),
]


def test_null_and_repeated_ids(spark, sf, texts):
    """Rows are known by their texts: none is lost for its id, and one of each group stays."""
    docs = texts(*ODD).withColumnRenamed("hash", "_key").withColumnRenamed("size", "_letters").selectExpr("*", "1 as row", "2 as id", "3 as k", "4 as _copy")
    read = STEPS["language_id"](spark, docs, sf)
    assert read.columns == docs.columns and sorted(map(str, rows_of(read))) == sorted(str(r) for r in rows_of(docs) if r[1] and any(c.isalpha() for c in r[1]))
    single = STEPS["near_dedup"](spark, read, sf)
    assert single.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in single.collect()) == sorted([("3", ODD[2][1]), ("3", ODD[4][1]), ("None", ODD[5][1]), ("None", ODD[7][1])])
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("text rlike '(\\\\w+\\\\W+){15}'").first().text
    dirty = docs.limit(1).selectExpr("cast(null as bigint) as doc_id", "'x' as text", *docs.columns[2:]).replace("x", item, subset="text")
    clean = STEPS["decontamination"](spark, single.unionByName(dirty).unionByName(dirty), sf)
    assert sorted(map(str, rows_of(clean))) == sorted(map(str, rows_of(single)))
    mixed = STEPS["mixing"](spark, clean, sf)
    assert mixed.columns == docs.columns and set(rows_of(mixed)) <= set(rows_of(clean))
    sharded = STEPS["sharding"](spark, mixed, sf)
    assert sharded.count() == mixed.count() and {"text", "_key", "_letters", "row"} <= set(sharded.columns)
    settings = dict(spark.conf.getAll) if hasattr(spark.conf, "getAll") else {}
    assert settings.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000"


def test_empty_input(spark, sf, texts):
    docs = texts()
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_odd_rows_pass(spark, sf, texts):
    docs = texts((1, None, "en", "a"), (2, "", "en", "a"), (3, "plain words of a text here", None, None), (3, "plain words of a text here", None, None), (None, "some more words here", "en", "a"), (4, "plain words of a text here", "en", "b")).drop("hash", "size")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() >= 1


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
