"""Language identification by prediction by partial matching.

Every language has a variable-order context tree over bytes: counts of each
byte after its three predecessors, from which those after two, one and none
follow by summing. A text's code length under a language is the sum over its
bytes of the exact cost: the byte's share in the longest context known to the
tree, and for every longer context that has not shown the byte, the cost of
escape (distinct bytes / (occurrences + distinct bytes)). The statistics are
frozen after training, so the cost of a byte depends on it and its three
predecessors only; costs of all seen 4-grams are tabulated for all languages.

Training takes at most `sample` documents per language (by hash of the id) of
every language that occurs; the model grows with their number, and its costs are
tabulated for 64 languages at a time. Case of A-Z and of Latin-1 letters is folded.

Defined results: a null text, or one with no letter, is `und` with score 0;
without training rows every row is `und`; ties go to the language first in
code-point order; rows with a null id or lang are not learned from (a null id
counts as held out); repeated rows are judged alike; an empty table gives no
rows; a very long text is scored whole, in one piece of its task's memory;
extra columns of docs are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlake.functions.staging import join_small
from ledgerlake.llm import bytegrams as bg

#: Training documents per language at most; languages whose costs stand side by side; the cost of a byte is an integer of 1/UNIT bits.
SAMPLE, PART, UNIT = 1500, 64, 1024
#: A text whose best language takes more than this part of its own code's bits, and so many bits besides, is in none that was learned.
MARGIN, SLACK = 1.25, 32
_PAD = 10


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 0 by division by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % 5 == 0


def _grams(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with its three predecessors (padding before a text) as one number, case folded."""
    n_docs = len(offsets) - 1
    padded = np.full(len(buf) + 3 * n_docs, _PAD, np.uint8)
    padded[np.arange(len(buf)) + 3 * np.repeat(np.arange(1, n_docs + 1), np.diff(offsets))] = buf
    upper = (padded >= 65) & (padded <= 90)
    upper[1:] |= (padded[:-1] == 0xC3) & (padded[1:] >= 0x80) & (padded[1:] <= 0x9E) & (padded[1:] != 0x97)
    padded += upper.astype(np.uint8) << 5
    x = padded.astype(np.uint32)
    keys = np.zeros(len(x), np.uint32)
    for back in range(4):
        keys[back:] |= x[: len(x) - back] << np.uint32(8 * back)
    keep = np.ones(len(x), bool)
    starts = offsets[:-1] + 3 * np.arange(n_docs)
    for j in range(3):
        keep[starts + j] = False
    return keys[keep]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lo, hi, buf, offsets in bg.text_chunks(batch.column("text")):
            keys = _grams(buf, offsets)
            names = sorted(set(langs[lo:hi]))
            which = np.repeat([names.index(x) for x in langs[lo:hi]], np.diff(offsets))
            for i, name in enumerate(names):
                values, counts = np.unique(keys[which == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Counts 4-grams of a bounded sample of docs on the executors; the model's size is bounded by the sample's."""
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.xxhash64(F.col(id_col).cast("string")).cast("double") / float(1 << 64) + 0.5
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    sizes = rows.groupBy("lang").agg((1.5 * sample / F.count("*")).alias("share"))
    picked = join_small(rows, sizes, "lang", "inner").filter("place < share")
    picked = picked.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("place", "text"))).filter(F.col("r") <= sample).select("lang", "text")
    grams = picked.mapInArrow(_count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    found = {k: (g["gram"].to_numpy(np.uint32), g["n"].to_numpy(np.float64)) for k, g in grams.groupby("lang")}
    return Model(sorted(found), found)


class _Table:
    """Rows of values by 32-bit key, in an open hash table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(4 * max(1, len(keys))).bit_length())
        self.slots = np.full((1 << self.bits) + 64, -1, np.int32)
        self.keys, self.values = keys, values
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], at[out] + 1
            if len(at) and at.max() >= len(self.slots):
                self.slots = np.concatenate([self.slots, np.full(64, -1, np.int32)])
        self.slots = np.concatenate([self.slots, [np.int32(-1)]])
        self.slot_keys = np.where(self.slots >= 0, keys[np.maximum(self.slots, 0)] if len(keys) else 0, 0).astype(np.uint32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it has none."""
        at = self._home(keys)
        row = self.slots[at]
        out = np.where(self.slot_keys[at] == keys, row, -1)
        left = np.flatnonzero((out < 0) & (row >= 0))
        while len(left):
            at[left] += 1
            row = self.slots[at[left]]
            hit = (row >= 0) & (self.slot_keys[at[left]] == keys[left])
            out[left[hit]] = row[hit]
            left = left[~hit & (row >= 0)]
        return out


class _Part:
    """Frozen costs, in 1/UNIT bits, of the grams of up to PART languages."""

    def __init__(self, languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        n = len(languages)
        costs = {0: np.full((1, n), 8.0)}
        seen: dict[int, np.ndarray] = {}
        lost: dict[int, np.ndarray] = {}
        for order in range(4):  # contexts of `order` bytes
            mask = np.uint32((1 << 8 * (order + 1)) - 1 if order < 3 else 0xFFFFFFFF)
            every = np.unique(np.concatenate([counts[name][0] & mask for name in languages if name in counts])) if order >= 2 else np.arange(1 << 8 * (order + 1), dtype=np.uint32)
            contexts = np.unique(every >> np.uint32(8))
            lower = costs[order][self._place(seen, order, every)] if order else np.repeat(costs[0], len(every), axis=0)
            cost, escape = np.empty((len(every), n)), np.zeros((len(contexts), n))
            for i, name in enumerate(languages):
                keys, weight = counts.get(name, (np.empty(0, np.uint32), np.empty(0)))
                hits = np.bincount(np.searchsorted(every, keys & mask), weight, len(every))
                of = np.searchsorted(contexts, every >> np.uint32(8))
                total, kinds = np.bincount(of, hits, len(contexts)), np.bincount(of, hits > 0, len(contexts))
                escape[:, i] = np.where(kinds > 0, np.log2(np.maximum(total + kinds, 1) / np.maximum(kinds, 1)), 0.0)
                with np.errstate(divide="ignore"):
                    cost[:, i] = np.where(hits > 0, np.log2(np.maximum(total + kinds, 1)[of] / np.maximum(hits, 1)), escape[of, i] + lower[:, i])
            seen[order + 1], costs[order + 1], lost[order] = every, cost, escape
            if order >= 2:
                lost[order] = escape
                seen[-order] = contexts
        unit = lambda x: np.round(x * UNIT).astype(np.int32)
        self.four, self.three = _Table(seen[4], unit(costs[4])), _Table(seen[3], unit(costs[3]))
        self.two = unit(costs[2])
        self.lost3 = _Table(seen[-3], unit(np.concatenate([lost[3], np.zeros((1, n))])))
        self.lost2 = np.zeros((1 << 16, n), np.int32)
        self.lost2[seen[-2]] = unit(lost[2])

    @staticmethod
    def _place(seen: dict[int, np.ndarray], order: int, every: np.ndarray) -> np.ndarray:
        return np.searchsorted(seen[order], every & np.uint32((1 << 8 * order) - 1))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """The cost of the last byte of each gram under each language."""
        row = self.four.find(grams)
        out = self.four.values[row]
        left = np.flatnonzero(row < 0)
        if len(left):
            g = grams[left]
            part = self.lost3.values[self.lost3.find(g >> np.uint32(8))].copy()
            row = self.three.find(g & np.uint32(0xFFFFFF))
            deep = row < 0
            part[~deep] += self.three.values[row[~deep]]
            part[deep] += self.lost2[g[deep] >> np.uint32(8) & np.uint32(0xFFFF)] + self.two[g[deep] & np.uint32(0xFFFF)]
            out[left] = part
        return out


class Model:
    """The trees of all languages, in parts."""

    def __init__(self, languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.parts = [_Part(languages[i : i + PART], counts) for i in range(0, len(languages), PART)]

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """The cost of the last byte of each gram under each language."""
        return np.concatenate([part.costs(grams) for part in self.parts], axis=1)

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text, the index of the language with the shortest code, its share of the probability, and whether that code beats the text's own."""
        best, share, known = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column), bool)
        for lo, hi, buf, offsets in bg.text_chunks(column, max(1 << 16, bg.CHUNK // min(PART, len(self.languages)))):
            full = np.flatnonzero(np.diff(offsets))
            if not len(full):
                continue
            grams = _grams(buf, offsets)
            total = np.concatenate([np.add.reduceat(part.costs(grams), offsets[:-1][full], axis=0, dtype=np.int64) for part in self.parts], axis=1)
            least = total.min(axis=1)
            best[lo + full] = total.argmin(axis=1)
            share[lo + full] = 1 / np.exp2(-(total - least[:, None]) / UNIT).sum(axis=1)
            known[lo + full] = least / UNIT < MARGIN * own_code(buf, offsets)[full] + SLACK
        return best, share, known


def own_code(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text in a code that knows no language: bytes by themselves, their frequencies learned along the text (Krichevsky and Trofimov)."""
    n = np.diff(offsets)
    most = int(n.max(initial=0))
    learned = lambda first: np.concatenate([[0.0], np.cumsum(np.log2(np.arange(most) + first))])
    whole, each = learned(128.0), learned(0.5)
    bits = whole[n]
    rows = max(1, (1 << 22) // 256)
    for lo in range(0, len(n), rows):
        hi = min(lo + rows, len(n))
        of = np.repeat(np.arange(hi - lo), n[lo:hi])
        counts = np.bincount(of * 256 + buf[offsets[lo] : offsets[hi]], minlength=256 * (hi - lo)).reshape(-1, 256)
        bits[lo:hi] -= each[counts].sum(axis=1)
    return bits


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, held_out, lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            letters = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            if model.languages:
                best, share, _ = model.score(batch.column("_text"))
                names = np.where(letters, np.array([*model.languages], object)[best], "und")
            else:
                names, share = np.full(len(letters), "und", object), np.zeros(len(letters))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(names == "und", 0.0, share))], names=["_id", "held_out", "lang_pred", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("_letters"), F.col(text_col).alias("_text"))
    return given.mapInArrow(rows, f"_id {id_type}, held_out boolean, lang_pred string, score double").withColumnRenamed("_id", id_col)


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, whose text has letters and is in a learned language.

    A text is rejected if the tree of its best language codes it in no fewer bits than
    a code that learns the bytes' frequencies along the text: noise, and other languages and scripts. Short
    texts pay that code's learning and stay. Only texts go to Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        model = shared.value
        return pa.array(model.score(texts)[2] if model.languages else np.zeros(len(texts), bool))

    return docs.filter(F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))).filter(known(F.col(text_col)))
