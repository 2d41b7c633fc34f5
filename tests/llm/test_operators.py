"""The operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest

from ledgerlake.llm import avi, decontaminate, graph, htmltext, langid, mixing, neardup, pseudonyms, queries, sharding, suffixdedup, toxicity

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", "de", None), (4, "...!!!", "de", "b"), (5, "word", None, "b"), (5, "word", None, "b"), (None, "some words here", "en", "a")]


def docs_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


# 1 decontamination


def contamination(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(FOLD))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, met = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    met |= windows[g]
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination_is_brute_force(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op1_decontamination(spark, sf).collect()), key=str) == contamination(docs_of(spark, sf), items)


def test_decontamination_odd_cases(spark, texts):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)]
    long_ = " ".join(rng.choice(vocabulary) for _ in range(3000))
    rows = [*ODD, (7, long_, "en", "a"), (8, "Été ÉCLAIR one two", "fr", "a")]
    items = [("b", " ".join(long_.split()[500:540])), ("a", "one TWO"), ("c", None), ("d", ""), ("e", long_[:400]), ("e", long_[:400]), ("f", "some words here")]
    got = decontaminate.decontaminate(texts(*rows), spark.createDataFrame(items, "item_id string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == contamination([r[:2] for r in rows], items)
    assert decontaminate.decontaminate(texts(), spark.createDataFrame(items, "item_id string, text string")).count() == 0
    assert decontaminate.decontaminate(texts(*ODD), spark.createDataFrame([], "item_id string, text string")).filter("n_hit > 0").count() == 0


# 2 toxicity


def test_toxicity_learns_planted_words(spark, texts):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    plain = [word() for _ in range(300)]
    rows, marks = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        body = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        for _ in range(3 if bad else 0):
            body.insert(rng.randrange(len(body)), rng.choice(["vilezz", "grossyy", "rottenqq"]))
        rows.append((i, " ".join(body), "en", "a"))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    net = toxicity.train(texts(*rows), labels)
    got = {r.doc_id: r for r in toxicity.score(texts(*rows), net).collect()}
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[i].predicted == marks[i][1] for i in held]) >= 0.95
    odd = toxicity.score(texts(*ODD), net).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert {r.score for r in toxicity.score(texts(*ODD), toxicity.train(texts(*ODD), labels.limit(0))).collect()} == {0.0}


def test_toxicity_gradients_are_finite_differences():
    rng = np.random.default_rng(3)
    net = toxicity.Network()
    net.conv = [c + (0.2 * rng.standard_normal(c.shape)).astype(np.float32) for c in net.conv]
    for table in ("word", "stem", "out", "bias"):
        setattr(net, table, (0.5 * rng.standard_normal(getattr(net, table).shape)))  # float64, for small differences
    net.conv = [c.astype(np.float64) for c in net.conv]
    before = np.array([0, 5, 5, 6, 14])
    word, stem = rng.integers(0, 40, 14).astype(np.uint16), rng.integers(0, 40, 14).astype(np.uint16)
    label, weight = np.array([1, 0, 1, 0]), np.array([1.0, 0.5, 2.0, 1.5])

    def loss():
        z = net.pooled(word, stem, before)[0].astype(np.float64) @ net.out + float(net.shift)
        return float(np.mean(weight * (np.log1p(np.exp(z)) - label * z)))

    g = net.gradients(word, stem, before, label, weight)
    places = [(net.conv[i], g[f"conv{i}"]) for i in range(3)] + [(net.out, g["out"]), (net.bias, g["bias"]), (net.word[g["word"][0]], g["word"][1])]
    for k, (value, slope) in enumerate(places):
        for at in [tuple(rng.integers(0, n) for n in slope.shape) for _ in range(6)]:
            table, where = (net.word, (g["word"][0][at[0]], at[1])) if k == 5 else (value, at)
            kept, step = table[where], 1e-3
            table[where] = kept + step
            up = loss()
            table[where] = kept - step
            down = loss()
            table[where] = kept
            assert abs((up - down) / (2 * step) - slope[at]) < 2e-3 * max(1, abs(slope[at])) + 1e-3


def test_toxicity_of_held_out_rows(spark, sf):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op2_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    assert held and np.mean([r.predicted == toxic[r.doc_id] for r in held]) >= 0.9


# 3 HTML


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p></p>", ""),
    ("<html><head><title>x</title><script>if(a<b){}</script></head><body><nav><a href=/>Home</a></nav><article><h1>A title here</h1><p>First  par &amp; more.<p>Second\n par.</article><div class='comments'><p>I disagree with this text, it is wrong.</p></div><footer>(c) site</footer></body></html>", "A title here\nFirst par & more.\nSecond par."),
    ("<body><div class=menu>a b c</div><main><p><b>Bold start.<br>goes on &#233;</b></p></main><form><p>Your name, please.</p></form>", "Bold start. goes on é"),
    ("<article><p>Cut off te&amp", "Cut off te&"),
])
def test_main_text(html, text):
    assert htmltext.main_text(html) == text


@pytest.mark.parametrize("tag", ["script", "style", "textarea"])
def test_letters_that_lower_case_lengthens(tag):
    page = f"<article><p>{'\u0130' * 40}.</p><{tag}>x</{tag.upper()}><p>First paragraph stays.</p><p>Second.</p></article>"
    assert htmltext.main_text(page) == "\u0130" * 40 + ".\nFirst paragraph stays.\nSecond."


def test_minimum_cut_is_exhaustive_search():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 7)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        between = {(i, j): rng.uniform(0, 1) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(keep):
            return sum(s if s > 0 and not k else -s if s < 0 and k else 0 for s, k in zip(scores, keep, strict=True)) + sum(c for (i, j), c in between.items() if keep[i] != keep[j])  # noqa: B023

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(htmltext.minimum_cut(scores, between)) == pytest.approx(best)


PROSE = "A sentence of some length stands here, and it goes on for quite a while, so that nobody takes it for a link or a label."


@pytest.mark.parametrize("html,text", [
    # attributes: quotes that open no string, > in a string, = in an unquoted value, a class inside another value
    ("<article><p title=it's>One's own.</p><p data-x=\"a>b\" class='x'>Two.</p><p id=a=b'c>Three.</p><p title='class=nav'>Four.</p></article>", "One's own.\nTwo.\nThree.\nFour."),
    # a paragraph of links, a label and a doubtful name amid an article
    (f"<article><p>{PROSE}</p><p><a href=x>only a link</a></p><p>Label</p><p class=reader-note>{PROSE}</p><p>{PROSE}</p></article>", f"{PROSE}\nonly a link\nLabel\n{PROSE}\n{PROSE}"),
    # a doubtful name on what is none of the article
    (f"<article><p>{PROSE}</p><div class=share><a href=x>Send</a> <a href=y>Post</a></div><p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
    # prose in parts that are boilerplate, inside and outside the article
    (f"<aside><p>{PROSE}</p></aside><main><p>{PROSE}</p><div id=comments><p>{PROSE}</p><p>{PROSE}</p></div></main><div class='cookie notice'>{PROSE}</div>", PROSE),
    # cards in a sidebar are articles by tag only; a wrapper that names the sidebar is none
    (f"<div class=with-sidebar><article><p>{PROSE}</p></article><aside><section><article><p>{PROSE}</p></article></section></aside></div>", PROSE),
    (f"<div class=with-sidebar><article><p>{PROSE}</p></article><aside><p>{PROSE}</p></aside></div>", PROSE),
    # no named part at all: prose around a short line, links in a row
    (f"<div><a href=a>Home</a></div><div><a href=b>News</a></div><div><a href=c>About</a></div><p>{PROSE}</p><p>Then</p><p>{PROSE}</p><div><a href=d>Terms</a></div><div><a href=e>Imprint</a></div>", f"{PROSE}\nThen\n{PROSE}"),
])
def test_pages_that_the_cut_settles(html, text):
    assert htmltext.main_text(html) == text
    page, parts = htmltext.blocks(html)
    terminals, _ = htmltext.graph(page, parts, htmltext.PRIOR)
    alone = "\n".join(b.text for b, t in zip(page, terminals, strict=False) if t > 0)
    assert alone != text or "class=share" in html


def test_long_pages_take_linear_time():
    import time

    rng = random.Random(1)
    page = "".join(f"<div><p>{'word, ' * rng.randint(1, 30)}{'<a href=x>link text here</a>' * rng.randint(0, 2)}</p></div>" for _ in range(20_000))
    for html in (page, "<article>" + "<p>x</p><script>a</script>" * 20_000 + "</article>", "<div>a" * 20_000, "<" * 200_000, "<a b=\"c " * 50_000):
        start = time.process_time()
        htmltext.main_text(html)
        assert time.process_time() - start < 4


def test_pages(spark, sf):
    """The pages' articles, cut out of their one template by hand."""
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op3_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"</?(?:b|i|a)\b[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1|li|ul)[^>]*>", inside)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    assert sum(r.n_changed for r in rows) > 0.05 * sum(r.n_blocks for r in rows)


def test_odd_pages(spark):
    rows = [(1, None, None, 7), (None, "u", "", 8), (3, "u", "<p>" + "Long text. " * 100_000 + "</p>", 9), (3, "u", "<p>Twice.</p>", 9), (3, "u", "<p>Twice.</p>", 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = htmltext.extract(pages, htmltext.train(pages)).collect()
    assert sorted((r.n_chars, r.url or "") for r in got)[:2] == [(0, ""), (0, "u")] and len(got) == 5 and max(r.n_chars for r in got) == 1_099_999
    assert [len(r.text) for r in got] == [r.n_chars for r in got]
    none = pages.limit(0)
    assert htmltext.extract(none, htmltext.train(none)).count() == 0 and (htmltext.train(none) == htmltext.PRIOR).all()


# 4 repeated strings


def repeats(docs, length):
    seen = collections.Counter(b[p : p + length] for _, b in docs for p in range(len(b) - length + 1))
    out = []
    for i, b in docs:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(mark)))
        out.append((i, len(b), sum(mark), runs, hashlib.sha256(bytes(c for c, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return sorted(out, key=str)


def test_repeats_are_brute_force(spark, sf):
    docs = [(i, (t or "").encode()) for i, t in docs_of(spark, sf)]
    got = queries.op4_suffix_dedup(spark, sf).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == repeats(docs, 400)
    text = dict(docs)
    for r in got:
        keep = [text[r.doc_id][a:b] for a, b in zip([0, *r.spans[1::2]], [*r.spans[::2], r.n_bytes], strict=True)]
        assert hashlib.sha256(b"".join(keep)).hexdigest() == r.kept_sha256 and (r.text or "") == b"".join(keep).decode("utf-8", "ignore")


def test_repeats_odd_cases(spark, texts):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdeé ") for _ in range(3000))
    rows = [*ODD, (10, base, "", ""), (11, base[700:1400] + "x" + base[100:520], "", ""), (12, "ab" * 500, "", ""), (13, "z" * 401, "", ""), (14, "z" * 400, "", ""), (15, base[2000:2399], "", ""), (16, "q" + base[5:404] + "r" + base[5:410], "", ""), (11, "other " + base[700:1300], "", ""), (17, base[:450], "", ""), (17, base[:450], "", "")]
    got = suffixdedup.remove_repeats(texts(*rows)).drop("spans", "text").collect()
    assert sorted(map(tuple, got), key=str) == repeats([(r[0], (r[1] or "").encode()) for r in rows], 400)
    assert suffixdedup.remove_repeats(texts()).count() == 0


def test_bucket_identifiers_name_bytes():
    """Equal bytes at any two places have one identifier, different ones different ones, for all sizes between two depths."""
    rng = np.random.default_rng(6)
    part = rng.integers(97, 100, 90)
    buf = np.concatenate([part, rng.integers(97, 100, 13), part, rng.integers(97, 100, 7)]).astype(np.uint8)
    prefix = suffixdedup.bg.prefix_hash(buf, False)
    for size in range(10, 86):
        at = np.arange(len(buf) - size + 1)
        names = suffixdedup._refined(prefix, at, at + size, 10)
        strings = [bytes(buf[p : p + size]) for p in at]
        assert len(set(names.tolist())) == len(set(strings)) and names[0] == names[103]


# 5 media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 2048, 2049, 10_000, 300_000])
def test_avi_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = avi.encode(avi.payload_of(data))
    back, samples, ms = avi.decode(media)
    assert back == avi.payload_of(data) and len(back) % 64 == 0 and len(back) >= 64
    found = avi.shots(samples)
    assert found[0][0] == 0 and found[-1][1] == len(samples) and ms == avi.FRAME_MS
    length, _, spans = avi.parse(media)
    assert length == len(back) and all(media[a : a + 2] == b"\xff\xd8" and media[b - 2 : b] == b"\xff\xd9" for a, b in spans)


def test_foreign_files_are_refused():
    with pytest.raises(ValueError):
        avi.decode(b"RIFF....WAVE")


def jpeg(image, step, standard, restart=0):
    """A baseline grey JPEG of an image whose sides are multiples of 8, written the plain way."""
    rows, columns = image.shape[0] // 8, image.shape[1] // 8
    blocks = image.reshape(rows, 8, columns, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8).astype(float) - 128
    c = np.array([[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    coefficients = np.rint(np.einsum("ux,nxy,vy->nuv", c, blocks, c).reshape(-1, 64)[:, avi.ZIGZAG] / step).astype(int)

    def codes(counts, values):
        out, code, at = {}, 0, 0
        for n, many in enumerate(counts, 1):
            for v in values[at : at + many]:
                out[v] = f"{code:0{n}b}"
                code += 1
            at, code = at + many, code << 1
        return out

    dc_table, ac_table = (avi.DC_TABLE, avi.AC_TABLE) if standard else ((bytes([0] * 3 + [12] + [0] * 12), bytes(range(12))), (bytes([0] * 7 + [194] + [0] * 8), bytes(r << 4 | s for r in range(16) for s in range(1, 13)) + b"\x00\xf0"))
    dc_codes, ac_codes = codes(*dc_table), codes(*ac_table)
    number = lambda v: (abs(v).bit_length(), "" if not v else f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}")
    scan, bits, last = b"", "", 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for i, z in enumerate(coefficients):
        if restart and i and i % restart == 0:
            scan, bits, last = scan + flush(bits) + bytes([0xFF, 0xD0 + (i // restart - 1) % 8]), "", 0
        n, b = number(int(z[0]) - last)
        bits, last, run = bits + dc_codes[n] + b, int(z[0]), 0
        top = max(np.flatnonzero(z[1:]) + 1, default=0)
        for v in z[1 : top + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                bits, run = bits + ac_codes[0xF0], run - 16
            n, b = number(int(v))
            bits, run = bits + ac_codes[run << 4 | n] + b, 0
        if top < 63:
            bits += ac_codes[0]
    tables = b"" if standard else avi._segment(0xC4, b"\x00" + dc_table[0] + dc_table[1] + b"\x10" + ac_table[0] + ac_table[1])
    return b"\xff\xd8" + avi._segment(0xDB, b"\x00" + bytes([step] * 64)) + avi._segment(0xC0, struct.pack(">BHHB", 8, *image.shape, 1) + b"\x01\x11\x00") + tables + (avi._segment(0xDD, struct.pack(">H", restart)) if restart else b"") + avi._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize("step,standard,restart", [(1, True, 0), (1, False, 0), (3, True, 2), (16, False, 5)])
def test_foreign_frames_are_decoded(step, standard, restart):
    rng = np.random.default_rng(7)
    y, x = np.mgrid[0:40, 0:64]
    image = np.clip(128 + 60 * np.sin(x / 7) + 40 * np.cos(y / 5) + rng.normal(0, 20, x.shape), 0, 255).astype(np.uint8)
    got = avi.frame_samples(jpeg(image, step, standard, restart)).reshape(image.shape)
    assert np.abs(got.astype(int) - image).max() <= 4 * step + 1 and np.abs(got.astype(float) - image).mean() <= step
    frame = jpeg(image, step, standard, restart)
    body = avi._chunk(b"00dc", frame)
    index = b"".join(b"00dc" + avi.struct.pack("<III", 0x10, 4 + k * len(body), len(frame)) for k in range(3))
    media = avi._chunk(b"RIFF", b"AVI " + avi._list(b"hdrl", avi._chunk(b"avih", avi.struct.pack("<14I", 50_000, *[0] * 13))) + avi._list(b"movi", body * 3) + avi._chunk(b"idx1", index))
    payload, samples, ms = avi.decode(media)
    assert payload == b"" and samples.shape == (3, image.size) and ms == 50 and avi.shots(samples) == [(0, 3)]


def test_stored_frames_are_plain_to_any_decoder():
    payload = avi.payload_of(random.Random(1).randbytes(300))
    media = avi.encode(payload)
    a, b = avi.parse(media)[2][0]
    head = avi._Head(media[a:b])
    pixels = avi._samples(head, media[a + head.scan : b - 2]).reshape(head.height // 8, 8, head.width // 8, 8)
    plain = avi.frame_samples(media[a:b]).reshape(head.height // 8, head.width // 8)
    assert (pixels == plain[:, None, :, None]).all()


def test_broken_files_are_refused():
    media = avi.encode(avi.payload_of(b"some text" * 50))
    a, b = avi.parse(media)[2][0]
    for bad in (b"", media[:20], media[:a] + b"\0\0" + media[a + 2 :], media.replace(b"\xff\xc0", b"\xff\xc2"), media.replace(b"\xff\xda", b"\xff\xfe")):
        with pytest.raises((ValueError, struct.error)):
            avi.decode(bad)


def test_media_digest_is_hashlib_on_the_source(spark, sf):
    docs = dict(docs_of(spark, sf))
    rows = queries.op5_media(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        media = avi.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_shots_cut_at_a_change():
    rng = np.random.default_rng(5)
    dark, light = rng.integers(70, 86, (6, 256)), rng.integers(117, 133, (5, 256))
    assert avi.shots(np.concatenate([dark, light]).astype(np.uint8)) == [(0, 6), (6, 11)]


def test_shots_cut_between_kinds_of_ascii():
    prose = (b"the quick brown fox jumps over the lazy dog near the old river bank " * 400)[: 6 * avi.FRAME]
    digits = (b"1402 5531 9078 2264 1187 3390 4456 8213 " * 400)[: 6 * avi.FRAME]
    frames = range(0, 6 * avi.FRAME, avi.FRAME)
    some_digits = b"".join(digits[i : i + 580] + prose[i + 580 : i + avi.FRAME] for i in frames)  # a difference of 0.15 to 0.2
    for other in (prose.upper(), digits, some_digits):
        assert avi.shots(avi.decode(avi.encode(prose + other))[1]) == [(0, 6), (6, 12)]


def test_media_rows(spark, texts):
    media = avi.to_media(texts(*ODD, (9, "a" * 5000, "en", "a")))
    rows = avi.digest(media).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes)
    assert len({tuple(r)[1:] for r in rows if r.doc_id in (1, 2)}) == 1
    assert avi.clips(media).filter("end_ms <= start_ms").count() == 0


# 6 language


def test_languages_of_held_out_rows(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op6_language_id(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.9


def test_languages_odd_cases(spark, texts):
    model = langid.train(texts((7, "the cat and the dog " * 9, "en", "a"), (8, "der hund und die katze " * 9, "de", "a"), *ODD))
    got = {r.doc_id: r.lang_pred for r in langid.identify(texts(*ODD, (9, "UND DIE KATZE", "x", "a")), model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[9] == "de" and got[5] in ("de", "en")
    none = langid.identify(texts(*ODD), langid.train(texts()))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_many_languages(spark, texts):
    """600 values of lang, each with words of its own letters; costs of a language don't depend on what stands beside it."""
    import itertools

    trios = ["".join(t) for t in itertools.combinations("bcdfghjklmnpqrst", 3)][:560] + ["".join(t) for t in itertools.combinations("vwxyz0123", 3)][:40]
    word = lambda t, i: "".join(t[(i * k + k) % 3] for k in range(1, 7))
    rows = [(i, " ".join(word(t, n + i) for n in range(30)), f"l{i:03d}", "a") for i, t in enumerate(trios)]
    model = langid.train(texts(*rows))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert model.languages == sorted(r[2] for r in learned) and len(model.parts) == -(-len(learned) // langid.PART)
    got = {r.doc_id: r.lang_pred for r in langid.identify(texts(*learned), model).collect()}
    assert got == {r[0]: r[2] for r in learned}
    name, grams = model.languages[70], langid._grams(np.frombuffer(b"bcd bcf zz", np.uint8), np.array([0, 10]))
    counts = {}
    for i, text in ((r[2], r[1].encode()) for r in learned):
        counts[i] = tuple(x.astype(t) for x, t in zip(np.unique(langid._grams(np.frombuffer(text, np.uint8), np.array([0, len(text)])), return_counts=True), (np.uint32, float), strict=True))
    assert (model.costs(grams)[:, 70] == langid.Model([name], counts).costs(grams)[:, 0]).all()


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.", "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。", "qxz jvkw pzq xxv kqj zzw vbx qpl mzx qwv jkx zqp wvx kzj qxv bnm zxq vkj wqz xpv jzk qvx " * 3,
]


def test_texts_of_no_learned_language_are_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    rows = [(10**6 + i, t, "en", "a", len(t)) for i, t in enumerate(FOREIGN)]
    foreign = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert all(any(c.isalpha() for c in t) for t in FOREIGN)
    kept = langid.keep_identified(docs.unionByName(foreign), model)
    own = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == own


def test_own_code_is_the_sequential_one():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcde \xc3") for _ in range(n)) for n in (0, 1, 7, 300)]
    buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for bits, text in zip(langid.own_code(buf, offsets), texts, strict=True):
        seen, want = collections.Counter(), 0.0
        for i, b in enumerate(text):
            want -= np.log2((seen[b] + 0.5) / (i + 128))
            seen[b] += 1
        assert abs(bits - want) < 1e-6


def test_code_length_is_the_recursion():
    text = b"abracadabra abra"
    grams = langid._grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    keys, counts = np.unique(grams, return_counts=True)
    model = langid.Model(["x"], {"x": (keys, counts.astype(float))})
    table = dict(zip(keys.tolist(), counts.tolist(), strict=True))

    def bits(gram, order):
        if order < 0:
            return 8.0
        mask = (1 << 8 * order) - 1
        of = collections.Counter()
        for k, n in table.items():
            if (k >> 8) & mask == (gram >> 8) & mask:
                of[k & 255] += n
        if not of:
            return bits(gram, order - 1)
        total = sum(of.values()) + len(of)
        return np.log2(total / of[gram & 255]) if of[gram & 255] else np.log2(total / len(of)) + bits(gram, order - 1)

    probe = langid._grams(np.frombuffer(b"abraxad qbra", np.uint8), np.array([0, 12]))
    got = model.costs(probe)[:, 0] / langid.UNIT
    assert np.allclose(got, [bits(int(g), 3) for g in probe], atol=0.01)


# 7 pseudonyms


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark, texts):
    rows = [(1, "card 4111 1111 1111 1111 and 4111-1111-1111-1111", "", ""), (2, "4111111111111111 or 4111111111111112", "", ""), (3, "call +1 (212) 555-0100; ip 192.168.0.1, born 1984-02-29 or 29/02/1984, not 2023-02-30", "", ""), (4, "GB82 WEST 1234 5698 7654 32 ssn 123-45-6789 jane.doe99@mail.example.com password=abc123def456", "", ""), (5, None, "", ""), (6, "", "", ""), (7, "nothing here 12345", "", ""), (8, "x" * 200_000 + " 4111111111111111", "", "")]
    got = {r.doc_id: r for r in pseudonyms.pseudonymize(texts(*rows), key="k").collect()}
    assert len(got) == len(rows) and got[5].text is None and got[6].text == "" and got[7].text == rows[6][1]
    a, b = re.findall(r"\d(?:[ -]?\d){15}", got[1].text)
    c, d = re.findall(r"\d{16}", got[2].text)
    assert a.replace(" ", "") == b.replace("-", "") == c == got[8].text[-16:] and c != "4111111111111111" and luhn(c)
    assert d == "4111111111111112"
    m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}); ip (\d+)\.(\d+)\.(\d+)\.(\d+), born (\d{4})-(\d{2})-(\d{2}) or (\d{2})/(\d{2})/(\d{4}), not 2023-02-30", got[3].text)
    assert m and (m[8], m[9], m[10]) == (m[13], m[12], m[11]) and all(int(m[i]) < 256 for i in (4, 5, 6, 7))
    iban = re.match(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", got[4].text)[0].replace(" ", "")
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1
    assert "jane" not in got[4].text and "@mail.example.com" in got[4].text and "abc123def456" not in got[4].text
    assert pseudonyms.pseudonymize(texts(*rows), key="other").filter("doc_id = 2").first().text != got[2].text
    assert pseudonyms.pseudonymize(texts(), key="k").count() == 0


def test_pseudonyms_of_cards_and_ibans_among_other_signs(spark, texts):
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    cards = [f"card {card} 123", f"card {card} 12/27", f"card {card} 12/12/2027", f"card {card} 10.0.0.1", f"no 98 {card}", f"x{card} 123", f"{card} 12 {card} 123", f"{card}-7"]
    ibans = [f"{iban} EUR 500", f"{iban.replace(' ', '')} EUR", f"{iban.replace(' ', '')} INVOICE 7", f"AB12 {iban}", f"{iban} {card} 9"]
    left = ["card 4111 1111 1111 1112 123", "ES93 2100 0418 4502 0005 1332 EUR 500", None, ""]
    given = [*cards, *ibans, *left]
    got = [r for _, r in sorted((r.doc_id, r) for r in pseudonyms.pseudonymize(texts(*((i, t, "", "") for i, t in enumerate(given))), key="k").collect())]
    new_card, new_iban = got[0].text[5:24], got[len(cards)].text[: len(iban)]
    assert new_card != card and luhn(new_card.replace(" ", "")) and new_iban != iban
    assert int("".join(str(int(x, 36)) for x in (new_iban[4:] + new_iban[:4]).replace(" ", ""))) % 97 == 1
    for t, r in zip(given[:-4], got, strict=False):
        want = t.replace(card, new_card).replace(iban, new_iban).replace(iban.replace(" ", ""), new_iban.replace(" ", ""))
        assert (r.n_card, r.n_iban) == (t.count(card), t.replace(" ", "").count(iban.replace(" ", "")))
        if r.n_found == r.n_card + r.n_iban:
            assert r.text == want
        else:  # a date or an address after the card
            assert r.n_date + r.n_ip == 1 and r.text.startswith(want[:24]) and r.text[25:] != want[25:]
    assert [r.text for r in got[-4:]] == left and all(r.n_found == 0 for r in got[-4:])


def test_pseudonyms_of_long_secrets(spark, texts):
    value = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=2000))
    r = pseudonyms.pseudonymize(texts((1, f"token={value} end", "", "")), key="k").first()
    assert r.n_secret == 1 and re.fullmatch("token=[A-Za-z0-9]{2000} end", r.text)
    assert all(value[i : i + 20] not in r.text for i in range(0, 2000, 20))


def test_pseudonyms_are_permutations(spark, texts):
    rows = [(i, f"10.0.{i // 256}.{i % 256} {i:03d}-11-2222 {1900 + i % 200}-01-{1 + i % 28:02d}", "", "") for i in range(600)]
    got = pseudonyms.pseudonymize(texts(*rows), key="k").collect()
    for part, before in ((0, 600), (1, 600), (2, len({r[1].split()[2] for r in rows}))):
        assert len({r.text.split()[part] for r in got}) == before


# 8 near duplicates


def groups(docs, percent=75):
    sets = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(FOLD))
        sets[i] = frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        shared = collections.Counter(j for g in s for j in where[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (i, len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_are_brute_force(spark, sf):
    assert {r.doc_id: tuple(r) for r in queries.op8_near_duplicates(spark, sf).collect()} == groups(docs_of(spark, sf))


def test_near_duplicates_in_crowds(spark, texts):
    """A template with edits of all sizes, a passage that many share, chains and copies: crowded buckets with many components."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    template, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(template)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = word()
        rows.append(w)
    for _ in range(150):
        rows.append(passage + [word() for _ in range(rng.randint(5, 60))])
    for w in rows[:40]:
        rows.append([*w[:-1], word()])
    chain = [word() for _ in range(80)]
    for _ in range(20):
        chain = [*chain[3:], word(), word(), word()]
        rows.append(list(chain))
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(1000 + i, " ".join(rows[i])) for i in range(5)] + [(2000, None), (2001, " "), (2002, "two words"), (2003, "Two Words")]
    rng.shuffle(docs)
    got = neardup.near_duplicates(texts(*[(i, t, "", "") for i, t in docs]))
    assert {r.doc_id: tuple(r) for r in got.collect()} == groups(docs)


def test_near_duplicates_odd_cases(spark, texts):
    got = neardup.near_duplicates(texts(*ODD)).collect()
    assert len(got) == len(ODD) and all(r.kept for r in got)
    assert neardup.near_duplicates(texts()).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    assert {r.id: r.comp for r in graph.components(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# 9 mixing


def test_mixing_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries.op9_mixing(spark, sf).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(mixing.ORACLE).fetchall())


def test_mixing_targets_and_odd_cases(spark, texts):
    rows = [*ODD, *[(100 + i, "w " * (1 + i % 7), "", "big" if i % 3 else "small") for i in range(300)]]
    got = mixing.mix(texts(*rows)).collect()
    source = {(r[0]): r[3] for r in rows}
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    taken, aim = collections.Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        aim[source[r.doc_id]] = r.target
    assert sum(aim.values()) == pytest.approx(sum(r.size for r in got))
    assert all(abs(taken[s] - t) <= 4 for s, t in aim.items())
    assert mixing.mix(texts()).count() == 0
    assert {r.target for r in mixing.mix(texts((1, "", "", "a"), (2, None, "", "b"))).collect()} == {0.0}


def test_mixed_rows_repeat(spark, texts):
    rows = [(i, "w " * 10, "", "a" if i < 10 else "b") for i in range(100)]
    counts = collections.Counter(r.doc_id for r in mixing.mixed_rows(texts(*rows)).collect())
    took = {r.doc_id: r.taken / r.size for r in mixing.mix(texts(*rows)).collect()}
    assert all(counts[i] == int(took[i] + 0.5) for i in took)


# 10 sharding


def sharded(rows, texts_of, shards=16, tolerance=0.01):
    total = sum(r.size for r in rows)
    by, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        data = (texts_of[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
    largest = max(r.size for r in rows)
    assert all(abs(by[k] - total / shards) <= 2 * max(largest, tolerance * total / shards) for k in range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_brute_force(spark, sf):
    """Rows in order of their keys: shards are runs of it, slots are places in a run, and a run ends where the bytes come nearest."""
    texts_of = dict(docs_of(spark, sf))
    key = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    rows = sorted(((key(texts_of[r.doc_id] or ""), key(str(r.doc_id)), r.doc_id), r) for r in queries.op10_sharding(spark, sf).collect())
    total, done, shard, slot = sum(r.size for _, r in rows), 0, 0, 0
    group = collections.Counter()
    for k, r in rows:
        group[k[0]] += r.size
    for i, (k, r) in enumerate(rows):
        while r.shard > shard:
            shard, slot = shard + 1, 0
            want = shard * total / 16
            inside = i and rows[i - 1][0][0] == k[0]  # a group of copies is cut only if it outweighs the tolerance
            assert abs(done - want) <= max(0.01 * total / 16, group[k[0]], group[rows[i - 1][0][0]]) and (not inside or group[k[0]] > 0.01 * total / 16)
        assert (r.shard, r.slot) == (shard, slot)
        done, slot = done + r.size, slot + 1


def test_sharding(spark, sf):
    sharded(queries.op10_sharding(spark, sf).collect(), dict(docs_of(spark, sf)))


def test_sharding_splits_a_group_of_copies_only_if_it_must(spark, texts):
    rows = [(i, "the same text" if i % 3 == 0 else f"text number {i} " * (1 + i % 5), "", "") for i in range(3000)]
    got = sharding.shard(texts(*rows)).collect()
    sharded(got, {r[0]: r[1] for r in rows})
    assert len(sharding.shard(texts(*ODD)).collect()) == len(ODD) and sharding.shard(texts()).count() == 0
    pairs = [(i, f"pair {i // 2} " * 20, "", "") for i in range(4000)]
    where = collections.defaultdict(set)
    for r in sharding.shard(texts(*pairs)).collect():
        where[r.doc_id // 2].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) == 0


def test_queries_carry_integer_ids(spark, sf):
    for name, query in queries.QUERIES.items():
        if name not in ("op3_html_extraction",):
            assert dict(query(spark, sf).dtypes)["doc_id"] == "bigint", name


def test_pseudonym_plan_is_native(spark, sf):
    plan = queries.op7_pseudonyms(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_shingle_counts_pack_and_add():
    cells = np.array([0, 5, neardup.BLOCK_CELLS, 3 * neardup.BLOCK_CELLS + 7])
    packed = neardup._packed(cells, np.array([1, 2, 3, 4]))
    assert [b for b, _ in packed] == [0, 1, 3] and neardup._packed(cells[:0], cells[:0]) == []
    table = neardup.pa.table({"block": [0, 0], "counts": [packed[0][1], packed[0][1]]})
    assert np.frombuffer(neardup._sum_counts(table)["counts"][0].as_py(), np.int32).tolist() == [0, 2, 5, 4]


def feistel(a, b, n_a, n_b, key, kind):
    """The permutation of pairs, in plain Python."""
    draw = lambda i, other, n: int(hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()[:12], 16) % n
    for i in range(1, pseudonyms.ROUNDS + 1):
        a, b = (a, (b + draw(i, a, n_b)) % n_b) if i % 2 else ((a + draw(i, b, n_a)) % n_a, b)
    return a, b


def feistel_text(s, key, kind):
    """The permutation of strings of one shape, in plain Python."""

    def added(part, seed):
        out = ""
        for j, c in enumerate(part):
            block, at = divmod(j, 21)
            h = hashlib.sha256(f"{seed}|{block}".encode()).hexdigest() if block else seed
            lo, n = next(((lo, n) for lo, n in ((48, 10), (97, 26), (65, 26)) if lo <= ord(c) < lo + n), (0, 0))
            out += chr(lo + (ord(c) - lo + int(h[3 * at : 3 * at + 3], 16)) % n) if n else c
        return out

    x, y = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, pseudonyms.ROUNDS + 1):
        seed = lambda other: hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()  # noqa: B023, E731
        x, y = (x, added(y, seed(x))) if i % 2 else (added(x, seed(y)), y)
    return x + y


def test_pseudonyms_are_brute_force_feistel(spark, texts):
    import datetime

    start = datetime.date(1900, 1, 1)

    def date_of(d):
        n = (d - start).days
        while True:
            a, b = feistel(n // 270, n % 270, 271, 270, "k", "date")
            n = a * 270 + b
            if n < pseudonyms.DAYS:
                return start + datetime.timedelta(n)

    days = [start + datetime.timedelta(i * 733) for i in range(99)]
    secrets = ["".join(random.Random(i).choices("abcXYZ019_", k=10 + 7 * i)) for i in range(20)]
    phones = [f"{200 + 37 * i % 800} {200 + 91 * i % 800} {i * 77 % 10000:04d}" for i in range(30)]
    rows = [*((i, f"on {d.isoformat()} or {d:%d.%m.%Y}", "", "") for i, d in enumerate(days)), *((1000 + i, f"token={t} ", "", "") for i, t in enumerate(secrets)), *((2000 + i, p, "", "") for i, p in enumerate(phones))]
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymize(texts(*rows), key="k").collect()}
    for i, d in enumerate(days):
        assert got[i] == f"on {date_of(d).isoformat()} or {date_of(d):%d.%m.%Y}"
    for i, t in enumerate(secrets):
        assert got[1000 + i] == f"token={feistel_text(t, 'k', 'secret')} "
    for i, p in enumerate(phones):
        a, b = feistel(int(p[:3]) - 200, (int(p[4:7]) - 200) * 10000 + int(p[8:]), 800, 8_000_000, "k", "phone")
        assert got[2000 + i] == f"{a + 200} {b // 10000 + 200} {b % 10000:04d}"


def test_no_two_values_meet(spark):
    """Every date of a notation, and 20,000 values of the other kinds: as many pseudonyms as values, each of its kind."""
    import datetime

    start = datetime.date(1900, 1, 1)
    days = [start + datetime.timedelta(i) for i in range(0, pseudonyms.DAYS, 3)]
    slashed = sorted({f"{d:%d/%m/%Y}" for d in days} | {f"{d:%m/%d/%Y}" for d in days})
    rng = random.Random(9)
    ssn = sorted({f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(20_000)} | {f"9{i:02d}-78-{i:04d}" for i in range(100)})
    phone = sorted({f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04d}" for _ in range(20_000)} | {f"({i % 200:03d}) 155-{i:04d}" for i in range(500)})
    iso = [d.isoformat() for d in days]
    for values in (slashed, iso, ssn, phone):
        docs = spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string").repartition(8)
        got = [r.text for r in pseudonyms.pseudonymize(docs, key="k").select("text").collect()]
        assert len(got) == len(set(got)) == len(values)
        for t in got:
            if values is ssn:
                area, group, serial = map(int, t.split("-"))
                assert area >= 900 or (0 < area != 666 and group and serial)
            elif values is phone:
                assert re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}|\([01]\d\d\) 1\d\d-\d{4}", t)
            elif values is iso:
                assert 1900 <= datetime.date.fromisoformat(t).year <= 2099
    left = ["123-00-4567", "123-45-0000", "ssn 12-345-6789"]
    docs = spark.createDataFrame(list(enumerate(left)), "doc_id bigint, text string")
    assert [r.text for r in sorted(pseudonyms.pseudonymize(docs, key="k").collect())] == left
