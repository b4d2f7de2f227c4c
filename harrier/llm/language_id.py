"""Language identification by interpolated Kneser-Ney character models.

A text is taken as its runs of letters, lower-cased. Each language has a model of order four
over the letters of a word and its end, read with three start marks before it. A model's
n-grams lie in sorted arrays of 64-bit keys, one array an order (a key holds 16 bits of
each character), beside the logarithm of the interpolated probability; contexts lie in
sorted arrays beside the logarithm of the weight of the lower order. The language with the
lowest cross-entropy per letter wins; a text whose best cross-entropy is far above what
held-back training texts of that language have is rejected.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, map_batches, short_batches

ORDER, DISCOUNT = 4, 0.75
START, END = 1, 2
LETTERS = regex.compile(r"\p{L}+").findall


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all positions (letters and end) of all words, and each word's first position.

    A key holds 16 bits of each character; those beyond the basic plane are folded into it.
    """
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    start, end = chr(START) * 3, chr(END)
    cp = np.frombuffer((start + (end + start).join(words) + end).encode("utf-32-le"), "<u4")
    flat = np.where(cp < 0x10000, cp, 0xE000 | cp & 0xFFF).astype(np.uint64)
    keys = flat[:-3] << np.uint64(48) | flat[1:-2] << np.uint64(32) | flat[2:-1] << np.uint64(16) | flat[3:]
    last = flat[3:] == END  # letters are never marks
    keep = flat[3:] != START
    ends = np.flatnonzero(last[keep])
    return keys[keep], np.concatenate([[0], ends[:-1] + 1])


class KneserNey:
    """One language's model, from its distinct 4-grams and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # by order: sorted keys, log probability
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []  # by order: sorted keys, log weight of the order below
        self.floor = -math.log(alphabet)
        levels = []
        for order in range(ORDER, 0, -1):
            levels.append((order, keys, counts))
            keys, counts = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)  # how many characters stand before
        for order, keys, counts in reversed(levels):
            at = np.argsort(keys)
            keys, counts = keys[at], counts[at].astype(float)
            context = keys >> np.uint64(16)
            heads, group = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(group, counts), np.bincount(group)
            weight = DISCOUNT * kinds / total
            lower = np.exp(self.log(keys & np.uint64((1 << 16 * (order - 1)) - 1), order - 1))
            p = (counts - DISCOUNT) / total[group] + weight[group] * lower
            self.grams.append((keys, np.log(p)))
            self.contexts.append((heads, np.log(weight)))

    def log(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), self.floor)
        (have, value), (heads, weight) = self.grams[order - 1], self.contexts[order - 1]
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        out = value[at]
        missing = np.flatnonzero(have[at] != keys)
        if len(missing):
            k = keys[missing]
            c = k >> np.uint64(16)
            i = np.minimum(np.searchsorted(heads, c), len(heads) - 1)
            out[missing] = np.where(heads[i] == c, weight[i], 0.0) + self.log(k & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        return out


class LanguageModels:
    """All languages' models, and what a worker has learned about words."""

    def __init__(self, models: dict[str, KneserNey], limits: dict[str, tuple[float, float]] | None = None, remember: int = 250_000):
        self.models, self.langs, self.limits, self.remember = models, sorted(models), limits or {}, remember
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.sums, self.lens = np.empty((0, len(self.langs)), np.float64), np.empty(0, np.int64)

    def __getstate__(self):
        return {"models": self.models, "limits": self.limits, "remember": self.remember}

    def __setstate__(self, state):
        self.__init__(**state)

    def learn(self, words: set[str]) -> None:
        new = sorted(words - self.rows.keys())
        if not new:
            return
        keys, first = _grams(new)
        sums = np.stack([np.add.reduceat(self.models[x].log(keys), first) for x in self.langs], axis=1)
        at = len(self.lens)
        self.sums = np.concatenate([self.sums, sums])
        self.lens = np.concatenate([self.lens, np.diff(np.append(first, len(keys)))])
        self.rows.update(zip(new, range(at, at + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, int, bool]]:
        """(language, score, cross-entropy, letters and ends, rejected) of each text."""
        if len(self.rows) > self.remember:
            self.forget()
        found = [LETTERS(t.lower()) if t else [] for t in texts]
        self.learn(set().union(*found))
        out = []
        for words in found:
            if not words:
                out.append(("und", 0.0, float("inf"), 0, True))
                continue
            at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            n = int(self.lens[at].sum())
            h = -self.sums[at].sum(axis=0) / n
            k = int(h.argmin())
            odds = np.exp(-(h - h[k]) * min(n, 200))
            lang = self.langs[k]
            base, width = self.limits.get(lang, (math.inf, 0.0))
            out.append((lang, float(1 / odds.sum()), float(h[k]), n, bool(h[k] > base + width / math.sqrt(n))))
        return out


#: Documents of a language that are drawn at least, and how many of them are all learned from.
LEAST, FEW = 40, 10


def train(labelled: DataFrame, *, per_language: int = 1500, total: int = 750_000, slack: float = 1.5) -> LanguageModels | None:
    """Models from rows with text and lang.

    A sample of about ``per_language`` documents a language is drawn by a hash of the id, of fewer if all
    languages together would have more than ``total``, but of ``LEAST`` at least, or all that there are (documented bounds of the
    classifier's sample). Every lang value that has a letter in its sample is learned.
    Nine tenths of it are counted; the rest set each language's limit of rejection:
    ``slack`` times the highest cross-entropy of a held-back text, and an allowance for
    short texts. Of a language with no more than ``FEW`` documents in the sample all are counted, and it rejects nothing.
    Null langs and texts are not learned from. None if nothing can be learned.
    """
    short_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    draw = lambda salt: F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(salt)), 11) / float(2**53)
    each = max(LEAST, min(per_language, total / len(sizes)))
    of_lang = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("lang"))
    sample = rows.where(draw(3) < of_lang({lang: each / n for lang, n in sizes.items()}))
    sample = sample.withColumn("back", draw(4) < of_lang({lang: 0.1 if min(n, each) > FEW else 0.0 for lang, n in sizes.items()}))

    def count(batches):
        grams: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                words = Counter(LETTERS(text.lower()))
                if words:
                    keys, first = _grams(list(words))
                    times = np.repeat(list(words.values()), np.diff(np.append(first, len(keys))))
                    keys, at = np.unique(keys, return_inverse=True)
                    grams.setdefault(lang, Counter()).update(dict(zip(keys.tolist(), np.bincount(at, times).astype(int).tolist(), strict=True)))
        for lang, c in grams.items():
            yield {"lang": [lang] * len(c), "gram": pa.array(np.fromiter(c.keys(), np.uint64, len(c)).view(np.int64)), "n": list(c.values())}

    counted = map_batches(sample.where(~F.col("back")).select("text", "lang"), "lang string, gram long, n long", count).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_lang: dict[str, tuple[list, list]] = {}
    for r in counted.toLocalIterator():
        g, n = by_lang.setdefault(r.lang, ([], []))
        g.append(r.gram)
        n.append(r.n)
    if not by_lang:
        return None
    grams = {lang: (np.array(g, np.int64).view(np.uint64), np.array(n)) for lang, (g, n) in by_lang.items()}
    alphabet = len(np.unique(np.concatenate([g & np.uint64(0xFFFF) for g, _ in grams.values()]))) + 1
    models = LanguageModels({lang: KneserNey(g, n, alphabet) for lang, (g, n) in grams.items()})

    def back(batches):
        for b in batches:
            p = models.predict(b["text"].to_pylist())
            yield {"lang": b["lang"], "pred": [x[0] for x in p], "h": [x[2] for x in p], "n": [x[3] for x in p]}

    limits = {}
    for r in map_batches(sample.where("back").select("text", "lang"), "lang string, pred string, h double, n long", back).where("lang = pred and n >= 100").groupBy("lang").agg(F.max("h").alias("h")).collect():
        limits[r.lang] = (slack * r.h, 6.0)
    models.limits = limits
    return models


def predict(docs: DataFrame, models: LanguageModels | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected for every row.

    lang_pred is ``und``, with score 0 and rejected, where the text is null or has no letter, or
    nothing was learned. Repeated rows are predicted one by one.
    """
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(models or LanguageModels({}))  # at most as large as its bounded sample

    def work(batches):
        models = held.value  # the same object in all of a worker's tasks, with the words it knows
        for b in batches:
            texts = b["text"].to_pylist()
            p = models.predict(texts) if models.langs else [("und", 0.0, float("inf"), 0, True)] * len(texts)
            yield {"doc_id": b["doc_id"], "lang_pred": [x[0] for x in p], "score": [x[1] for x in p], "cross_entropy": [x[2] for x in p], "rejected": [x[4] for x in p]}

    return map_batches(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean", work)


def known(docs: DataFrame, models: LanguageModels | None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; null texts, texts without a
    letter and, if nothing was learned, all rows are rejected."""
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(models or LanguageModels({}))

    def work(b):
        models, texts = held.value, b["text"].to_pylist()
        return {"_lid_rejected": [x[4] for x in models.predict(texts)] if models.langs else [True] * len(texts)}

    return extended(docs, "_lid_rejected boolean", work).where("NOT _lid_rejected").select(*docs.columns)
