"""Toxicity by a convolutional text classifier trained here, in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its
first four bytes. Filters over one, two and three neighbouring words are
max-pooled over the whole text; a logistic layer reads the pooled values. One
coordinate of the embeddings starts from the log-odds of the label among
training documents with the word; all weights are then trained by AdaGrad, the
gradient passing through the pooled maxima only.

Thresholds are calibrated by language: a naive Bayes model of hashed words,
trained on the same sample, guesses a text's language from its words; the
logit is shifted so that 0.5 is the best threshold of the calibration part of
the sample for that guess. Labels, lang, source and id are no inputs of a score.

Training takes at most `sample` documents per label (by hash of the id) out of
those whose crc32 leaves no 0 by division by 5; four bytes for each of their
words go to the driver.

Defined results: null, empty and wordless texts get the score of no evidence;
without labelled rows of both kinds every score is 0; a document labelled
twice takes its largest label, and an id with several texts is learned from by
one of them; of equal filter values the first takes the gradient, of equal
language guesses the first by name wins; repeated rows are scored alike; a very
long text is scored whole, in one piece of its task's memory; an empty table
gives no rows; rows with a null id count as held out; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import bytegrams as bg
from ledgerlake.llm.langid import held_out

#: Training documents per label at most; rows of an embedding table; its columns; filters of each width.
SAMPLE, BUCKETS, DIM, FILTERS, WIDTHS = 3000, 1 << 16, 12, 8, (1, 2, 3)
PREFIX, EPOCHS, RATE, BATCH = 4, 4, 0.05, 32
#: Calibration documents of each label at least; with fewer, thresholds are calibrated on the whole sample.
LEAST_HELD = 5


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both embedding tables for every word, and the number of words before each text."""
    starts, ends, before = bg.word_spans(buf, offsets, bg.LETTERS_DIGITS)
    if not len(starts):
        return np.empty(0, np.uint16), np.empty(0, np.uint16), before
    prefix = bg.prefix_hash(buf, True)
    shift = np.uint64(48)
    return (bg.span_hash(prefix, starts, ends) >> shift).astype(np.uint16), (bg.span_hash(prefix, starts, np.minimum(starts + PREFIX, ends)) >> shift).astype(np.uint16), before


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.word = (0.05 * rng.standard_normal((BUCKETS, DIM))).astype(np.float32)
        self.stem = (0.05 * rng.standard_normal((BUCKETS, DIM))).astype(np.float32)
        self.conv = [(0.3 * rng.standard_normal((w, DIM, FILTERS))).astype(np.float32) for w in WIDTHS]
        for c in self.conv:
            c[:, 0, :] = 1.0 / len(c)
        n = FILTERS * len(WIDTHS)
        self.bias = np.zeros(n, np.float32)
        self.out = np.full(n, 1.0 / n, np.float32)
        self.shift = np.float32(0)
        self.languages: list[str] = []
        self.lang_word = np.zeros((BUCKETS, 1), np.float32)
        self.thresholds = np.zeros(1, np.float32)

    def pooled(self, word: np.ndarray, stem: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The largest value of each filter in each text (0 at least), the word vectors, and the filters' values."""
        n_docs = len(before) - 1
        x = self.word[word] + self.stem[stem]
        top, values = np.zeros((n_docs, FILTERS * len(WIDTHS)), x.dtype), []
        for i, (w, c) in enumerate(zip(WIDTHS, self.conv, strict=True)):
            m = len(x) - w + 1
            if m <= 0:
                values.append(np.empty((0, FILTERS), x.dtype))
                continue
            z = x[:m] @ c[0]
            for j in range(1, w):
                z += x[j : j + m] @ c[j]
            z += self.bias[i * FILTERS : (i + 1) * FILTERS]
            if w > 1:
                z[~bg.inside_text(before, w, m)] = -1e9
            values.append(z)
            full = np.flatnonzero(np.diff(np.minimum(before, m)) > 0)
            if len(full):
                top[full, i * FILTERS : (i + 1) * FILTERS] = np.maximum(np.maximum.reduceat(z, before[:-1][full], axis=0), 0)
        return top, x, values

    def logits(self, word: np.ndarray, stem: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.pooled(word, stem, before)[0] @ self.out + self.shift

    def guess(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Index of the likeliest language of each text."""
        full = np.flatnonzero(np.diff(before))
        best = np.zeros(len(before) - 1, np.int64)
        if len(full) and self.lang_word.shape[1] > 1:
            best[full] = np.add.reduceat(self.lang_word[word], before[:-1][full], axis=0).argmax(axis=1)
        return best

    def gradients(self, word, stem, before, label, weight) -> dict:
        """Of the weighted mean logistic loss of a batch of texts; those of the embeddings as (rows, gradients)."""
        top, x, values = self.pooled(word, stem, before)
        p = 1 / (1 + np.exp(-(top @ self.out + self.shift)))
        err = ((p - label) * weight / len(label)).astype(np.float32)
        g_top = err[:, None] * self.out[None, :]
        g_x = np.zeros_like(x)
        g_conv = [np.zeros_like(c) for c in self.conv]
        g_bias = np.zeros_like(self.bias)
        docs = np.repeat(np.arange(len(label)), np.diff(before))
        for i, w in enumerate(WIDTHS):
            z = values[i]
            if not len(z):
                continue
            own = top[:, i * FILTERS : (i + 1) * FILTERS]
            at, f = np.nonzero((z == own[docs[: len(z)]]) & (own[docs[: len(z)]] > 0))
            d = docs[at]
            _, first = np.unique(d * FILTERS + f, return_index=True)
            at, f, d = at[first], f[first], d[first]
            g = g_top[d, i * FILTERS + f]
            np.add.at(g_bias, i * FILTERS + f, g)
            for j in range(w):
                np.add.at(g_x, at + j, g[:, None] * self.conv[i][j][:, f].T)
                np.add.at(g_conv[i][j].T, f, g[:, None] * x[at + j])
        used = np.flatnonzero(np.any(g_x, axis=1))
        found: dict = {}
        for name, rows in (("word", word[used]), ("stem", stem[used])):
            rows_u = np.unique(rows)
            g = np.zeros((len(rows_u), DIM), np.float32)
            np.add.at(g, np.searchsorted(rows_u, rows), g_x[used])
            found[name] = rows_u, g
        return found | {f"conv{i}": g for i, g in enumerate(g_conv)} | {"bias": g_bias, "out": err @ top, "shift": np.float32(err.sum())}

    def step(self, word, stem, before, label, weight, sums) -> None:
        """One AdaGrad step on a batch of texts."""
        g = self.gradients(word, stem, before, label, weight)
        for name in ("word", "stem"):
            (rows, own), table = g.pop(name), getattr(self, name)
            sums[name][rows] += own * own
            table[rows] -= RATE * own / (np.sqrt(sums[name][rows]) + 1e-6)
        for name, own in g.items():
            sums[name] = sums.get(name, 0) + own * own
            change = RATE * own / (np.sqrt(sums[name]) + 1e-6)
            if name == "shift":
                self.shift = np.float32(self.shift - change)
            else:
                weights = self.conv[int(name[4:])] if name.startswith("conv") else getattr(self, name)
                weights -= change


def _join(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int, str | None, bool]]) -> Network | None:
    """rows: word and stem rows, label, language or None, and whether the row is for calibration."""
    labels = np.array([r[2] for r in rows])
    if len(set(labels.tolist())) < 2:
        return None
    net = Network()
    train = [r for r in rows if not r[4]]
    if len({r[2] for r in train}) < 2:
        train = rows
    for table, k in ((net.word, 0), (net.stem, 1)):
        seen = np.zeros((2, BUCKETS))
        for r in train:
            seen[r[2], np.unique(r[k])] += 1
        totals = np.bincount([r[2] for r in train], minlength=2)
        odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
        table[:, 0] = np.where(seen.sum(axis=0) > 0, np.clip(odds, -2, 4), -0.5) / 2
    net.languages = sorted({r[3] for r in rows if r[3] is not None})
    if len(net.languages) > 1:
        counts = np.full((BUCKETS, len(net.languages)), 0.1)
        for r in rows:
            if r[3] is not None:
                counts[:, net.languages.index(r[3])] += np.bincount(r[0], minlength=BUCKETS)
        net.lang_word = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    rng = np.random.default_rng(11)
    y = np.array([r[2] for r in train])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    grads: dict = {"word": np.zeros((BUCKETS, DIM), np.float32), "stem": np.zeros((BUCKETS, DIM), np.float32)}
    for _ in range(EPOCHS):
        order = rng.permutation(len(train))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            word, stem, before = _join([train[i][:2] for i in pick])
            net.step(word, stem, before, y[pick], weight[pick], grads)
    held = [r for r in rows if r[4]]
    if min(sum(r[2] == y for r in held) for y in (0, 1)) < LEAST_HELD:
        held = rows
    got = np.concatenate([np.column_stack([net.logits(w, s, b), net.guess(w, b)]) for w, s, b in (_join([r[:2] for r in held[i : i + 64]]) for i in range(0, len(held), 64))])
    net.thresholds = np.zeros(max(1, len(net.languages)), np.float32)
    truth = np.array([r[2] for r in held])
    every = _best_threshold(got[:, 0], truth, 0.0)
    for i in range(len(net.thresholds)):
        own = got[:, 1] == i
        net.thresholds[i] = _best_threshold(got[own, 0], truth[own], every) if own.sum() >= 20 else every
    return net


def _best_threshold(logit: np.ndarray, label: np.ndarray, otherwise: float) -> float:
    """The middle of the gap between logits with the fewest errors, each label weighing alike."""
    if len(set(label.tolist())) < 2:
        return otherwise
    order = np.argsort(logit)
    x, y = logit[order], label[order]
    miss = np.concatenate([[0], np.cumsum(y == 1)]) / (y == 1).sum() + np.concatenate([[0], np.cumsum((y == 0)[::-1])])[::-1] / (y == 0).sum()
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    width = np.concatenate([[2.0], x[1:] - x[:-1], [2.0]])
    best = np.flatnonzero(miss <= miss.min() + 1e-9)
    return float(edges[best[width[best].argmax()]])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", sample: int = SAMPLE) -> Network | None:
    marked = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    place = F.xxhash64(F.col("_id").cast("string")).cast("double") / float(1 << 64) + 0.5
    totals = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if len(totals) < 2:
        return None
    picked = None
    for label, n in sorted(totals.items()):
        part = marked.filter((F.col("label") == label) & (place < min(1.0, 1.5 * sample / n))).orderBy(place).limit(sample)
        picked = part if picked is None else picked.union(part)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in bg.text_chunks(batch.column("_text")):
                word, stem, before = _words(buf, offsets)
                part = batch.slice(lo, hi - lo)
                lists = [pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(v.view(np.int16))) for v in (word, stem)]
                yield pa.RecordBatch.from_arrays([*lists, part.column("label"), part.column("_lang"), part.column("calibrate")], names=["word", "stem", "label", "lang", "calibrate"])

    chosen = docs.select(F.col(id_col).alias("_did"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).join(F.broadcast(picked), F.col("_did") == F.col("_id"))
    rows = chosen.dropDuplicates(["_did"]).select("_text", "_lang", "label", ((F.crc32(F.col("_id").cast("string")) % 5 == 1) & (F.xxhash64(F.col("_id").cast("string"), F.lit(1)) % 2 == 0)).alias("calibrate"), F.col("_id"))
    got = rows.orderBy("_id").mapInArrow(features, "word array<smallint>, stem array<smallint>, label int, lang string, calibrate boolean").toArrow()
    return fit([(np.asarray(w.values, np.int16).view(np.uint16), np.asarray(s.values, np.int16).view(np.uint16), y, lang, c) for w, s, y, lang, c in zip(got["word"], got["stem"], got["label"].to_pylist(), got["lang"].to_pylist(), got["calibrate"].to_pylist(), strict=True)])


def score(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for lo, hi, buf, offsets in bg.text_chunks(batch.column("_text"), 1 << 18) if net else ():
                word, stem, before = _words(buf, offsets)
                shifted = net.logits(word, stem, before) - net.thresholds[net.guess(word, before)]
                scores[lo:hi] = np.round(1 / (1 + np.exp(-np.clip(shifted.astype(np.float64), -30, 30))), 6)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["_id", "held_out", "score", "predicted"])

    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return given.mapInArrow(rows, f"_id {id_type}, held_out boolean, score double, predicted int").withColumnRenamed("_id", id_col)
