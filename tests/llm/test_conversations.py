"""The operators on conversations and SimHash against brute force."""

import collections
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from ledgerlake.llm import prefixtrie, queries, repair, simhash

CONV = "conv_id bigint, turn bigint, role string, text string, key string, d int"


def conversations(spark, rows):
    """Rows with columns of clashing names besides."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], CONV)


def given(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def odd(seed, most, ids):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(rng.randint(0, most)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(["Hi.", "Ok!", None, "", "  ", "no end", "What? ", "a.", "b.", "c.", "e?\n"])))
    return rows


# 11 prefix trie


def trie_of(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    for turns in own.values():
        turns.sort(key=lambda z: z[:2])
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = own.get(c - int(math.fmod(c, 100)), [])
        seqs[c] = tuple(z[2:] for z in donor[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, leaves, saved = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(seqs[c]) == len(k)).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


def test_trie_is_brute_force(spark, sf):
    got = queries.op11_prefix_trie(spark, sf)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect())) == trie_of(given(spark, sf))


@pytest.mark.parametrize("small", [False, True])
def test_trie_of_odd_conversations(spark, monkeypatch, small):
    # Turns with one number follow by hash, so numbers differ here.
    rng = random.Random(5)
    rows = [(c, t or None, rng.choice(["user", None]), rng.choice(["Hi.", "", None, "Ünï"])) for c in [*range(40), None, -105, -200, *range(100, 130), 250] for t in range(rng.randint(1, 13))]
    rows += [(c, t, "user", "the same") for c in (301, 302, 303) for t in range(30)]
    if small:  # every table is dealt out, runs of depths and ids are short
        for module, name, value in ((prefixtrie, "MAX_SIDE", 0), (prefixtrie, "BLOCK", 4), (prefixtrie, "ID_BITS", 3)):
            monkeypatch.setattr(module, name, value)
    assert sorted(map(tuple, prefixtrie.trie(conversations(spark, rows)).collect())) == trie_of(rows)


def test_trie_without_conversations(spark):
    assert prefixtrie.trie(conversations(spark, [])).isEmpty()
    assert prefixtrie.trie(conversations(spark, [(None, 1, "user", "x")])).isEmpty()
    # Its few turns all stand for borrowed ones, and there is no donor: only the root remains.
    bare = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(bare, 1, "user", "x")]
    assert sorted(map(tuple, prefixtrie.trie(conversations(spark, rows)).collect())) == trie_of(rows)


def test_the_search_asks_at_two_fattest_depths(spark):
    fattest = lambda a, b: max(range(a + 1, b + 1), key=lambda n: n & -n)
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 70)]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", prefixtrie._fattest("a", "b").alias("f")).collect()
    assert all(r["f"] == fattest(r["a"], r["b"]) for r in rows)


# 12 structure repair


def repaired(rows):
    """Dijkstra over (rows read, state), by cost and then audit."""
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c]
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            convs[c] += [(t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    need, after, full = ("u", "u", "a", "u"), (2, 2, 3, 2), {"u": "user", "a": "assistant"}
    out = {}
    for c, rs in convs.items():
        rs.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        turns = [z[0] for z in rs if z[0] is not None]
        seen, fault = set(), []
        for _, r, x in rs:
            signs = x.strip(" \t\n\x0b\x0c\r")
            fault.append("b" if not signs else "d" if (r, x) in seen else "" if signs[-1] in ".!?" else "t")
            seen.add((r, x))
        first = [z[1][:1] for z in rs]
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, s, said = heapq.heappop(heap)
            if i == len(rs) and s in (0, 3):
                break
            if (i, s) in done:
                continue
            done.add((i, s))
            heapq.heappush(heap, (cost + 5, audit + "I", i, after[s], (*said, full[need[s]] + ":")))
            if i < len(rs):
                _, r, x = rs[i]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, s, said))
                if fault[i] in ("", "t"):
                    more = 5 * (fault[i] == "t")
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, after[s], (*said, f"{full[need[s]]}:{x}")))
                    if first[i] == need[s] or (s == 0 and first[i] == "s"):
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, 1 if first[i] == "s" else after[s], (*said, f"{r}:{x}")))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
        out[c] = (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_repair_is_brute_force(spark, sf):
    got = queries.op12_structure_repair(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == repaired(given(spark, sf))


@pytest.mark.parametrize("pieces", [{}, {"max_rows": 1, "piece": 2}, {"max_bytes": 5, "piece": 3}])
def test_repair_of_odd_conversations(spark, pieces):
    rows = odd(1, 14, [*range(120), None, -5])
    rows += [r for r in rows if r[0] == 7] + [(500, None, None, None), (501, 1, "user", "Only.")]
    got = [tuple(r) for r in repair.repair(conversations(spark, rows), **pieces).collect()]
    assert len(got) == len({r[0] for r in rows}) and {r[0]: r[1:] for r in got} == repaired(rows)
    assert repair.repair(conversations(spark, []), **pieces).isEmpty()


def test_a_very_long_conversation_is_dealt_out(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}!", f"{t}", " "])) for t in range(700)]
    whole = repair.repair(conversations(spark, rows), max_rows=10**6).first()
    assert tuple(whole) == tuple(repair.repair(conversations(spark, rows), max_rows=10, piece=50).first()) and tuple(whole)[1:] == repaired(rows)[1]


def test_crossings_take_the_least_audit_of_all():
    rng = random.Random(4)
    for _ in range(300):
        symbols = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(0, 6)))
        best = None
        for states in itertools.product(range(4), repeat=len(symbols)):
            cost, said, at = 0, "", 0
            for s, to in zip(symbols, states, strict=True):
                way = repair._ROWS[s][at][to]
                if way is None:
                    break
                cost, said, at = cost + way[0], said + way[1], to
            else:
                total = (cost + repair._ENDS[at], said + repair.audit(repair._TAILS[at]))
                best = total if best is None else min(best, total)
        cost, tail, *codes = repair.solve(symbols)
        assert (int(cost), repair.audit("".join(codes) + tail)) == best


# 13 SimHash


def fingerprint_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(fps, ids):
    """Least id of each row's component, all pairs compared."""
    u, row = np.unique(np.array(fps, np.uint64), return_inverse=True)
    root = list(range(len(u)))

    def find(a):
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3) + i + 1:
            root[find(i)] = find(int(j))
    least = {}
    for k, i in zip(row, ids, strict=True):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in row]


def test_simhash_is_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps = [fingerprint_of(t) for _, t in docs]
    want = sorted(zip([i for i, _ in docs], [f"{f:016x}" for f in fps], near(fps, [i for i, _ in docs]), strict=True))
    assert sorted(map(tuple, queries.op13_simhash(spark, sf).collect())) == want


def test_simhash_odd_texts(spark, texts):
    long_ = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", "de", None), (4, "One TWO", "de", "b"), (5, "one two", None, "b"), (5, "one two", None, "b"), (None, "é É x y", "en", "a"), (7, long_, "en", "a"), (8, long_ + " w5", "en", "a"), (9, "é É x y", "en", "a"), (None, "alone here now", "en", "a")]
    fps = [fingerprint_of(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], near(fps, [r[0] for r in rows]), strict=True), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(texts(*rows)).collect()), key=str) == want
    assert simhash.near_duplicates(texts()).isEmpty()


@pytest.mark.parametrize("cell", [32, 2])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, cell):
    """Clouds of fingerprints around a few centres, whose members are at all distances from each other."""
    monkeypatch.setattr(simhash, "SMALL_CELL", cell)
    rng = random.Random(6)
    fps = set()
    for _ in range(6):
        centre, soft = rng.getrandbits(64), rng.sample(range(64), 14)
        for _ in range(150):
            fps.add(centre ^ sum(1 << b for b in rng.sample(soft, rng.randint(0, 7))))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {r["id"]: r["comp"] for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))).collect()}
    got, want = [found.get(f, f) for f in signed], near(fps, signed)
    assert got == want


def test_chains_hold_for_every_pair_within_the_distance(spark):
    """The pigeonring principle: some start's chain stays within its budget all the way."""
    rng = random.Random(7)
    pairs = [(a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))) for a in (rng.getrandbits(63) for _ in range(300))]
    rows = spark.createDataFrame([(a, b - (1 << 64) if b >> 63 else b) for a, b in pairs], "a bigint, b bigint").selectExpr("a", "b", "explode(sequence(0, 3)) as start")
    kept = rows.filter(simhash.within_budget("a", "b", "start")).select("a", "b").distinct().count()
    assert kept == len(set(pairs))
