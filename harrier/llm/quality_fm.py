"""A factorisation machine that scores the quality of texts.

Features of a text: hashed lower-cased words with length-normalised counts, statistics of its
structure, and the stored length as metadata. The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

so that all pairwise interactions cost time linear in the number of features.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, short_batches

HASHED = 1 << 15
TOKENS = regex.compile(r"\S+").findall
STATISTICS = 22


class Words(dict):
    """Bucket by word; forgets when it is full."""

    def __missing__(self, word: str) -> int:
        bucket = zlib.crc32(word.encode()) % HASHED
        if len(self) >= 250_000:
            self.clear()
        self[word] = bucket
        return bucket


def statistics(text: str, tokens: list[str], n_chars: int | None) -> np.ndarray:
    """Structure of a whole text; the last one is the stored length, where there is one."""
    cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n, m = max(1, len(cp)), max(1, len(tokens))
    ascii_ = np.bincount(np.minimum(cp, 127), minlength=128)
    kinds = Counter(tokens)
    share = lambda chars: sum(int(ascii_[ord(c)]) for c in chars) / n
    upper = int(ascii_[65:91].sum())
    lower = int(ascii_[97:123].sum())
    lines = text.split("\n")
    first = sum(t[0].isupper() for t in tokens)
    end = sum(not t[-1].isalnum() for t in tokens)
    top = max(kinds.values(), default=0)
    lens = np.fromiter(map(len, tokens), np.int64, len(tokens)) if tokens else np.zeros(1)
    symbols = share("#$%&*@^~+=<>\\{}[]")
    return np.array([
        np.log1p(len(cp)) / 10, np.log1p(len(tokens)) / 8, min(lens.mean(), 30) / 10, min(lens.std(), 30) / 10,
        upper / n, lower / n, upper / max(1, upper + lower), share("0123456789"), share(".,;:"), share("!?"), symbols, share("|/_-"),
        share("\n"), share(" "), float(symbols > 0.01), first / m, end / m, len(kinds) / m, top / m,
        len(set(lines)) / len(lines), sum(len(t) <= 3 for t in tokens) / m, np.log1p(len(cp) if n_chars is None else max(0, n_chars)) / 10,
    ])


def features(text: str | None, n_chars: int | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sparse row: feature numbers and values. The statistics follow the hashed words."""
    text = text or ""
    tokens = TOKENS(text)
    at = np.fromiter(map(words.__getitem__, map(str.lower, tokens)), np.int64, len(tokens))
    at, counts = np.unique(at, return_counts=True)
    x = np.sqrt(counts)
    x = x / np.sqrt((x * x).sum()) if len(x) else x
    return np.concatenate([at, HASHED + np.arange(STATISTICS)]), np.concatenate([x, statistics(text, tokens, n_chars)])


class FactorisationMachine:
    def __init__(self, factors: int = 8, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(HASHED + STATISTICS)
        self.v = draw.normal(0, 0.02, (HASHED + STATISTICS, factors))
        self.mean, self.std = np.zeros(STATISTICS), np.ones(STATISTICS)
        self.words = Words()

    def __getstate__(self):
        return {**self.__dict__, "words": Words()}

    def scaled(self, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.copy()
        x[-STATISTICS:] = np.clip((x[-STATISTICS:] - self.mean) / self.std, -4, 4) / 2
        return at, x

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The sum-of-squares identity on rows that are scaled."""
        lens = [len(at) for at, _ in rows]
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])[:, None]
        vx = self.v[at] * x
        pairs = np.add.reduceat(vx, first) ** 2 - np.add.reduceat(vx * vx, first)
        return self.w0 + np.add.reduceat(self.w[at] * x[:, 0], first) + 0.5 * pairs.sum(axis=1)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> None:
        """AdaGrad on the logistic loss, in an order that the seed fixes."""
        dense = np.stack([x[-STATISTICS:] for _, x in rows])
        self.mean, self.std = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-6)
        rows = [self.scaled(*r) for r in rows]
        p = np.clip(y.mean(), 0.01, 0.99)
        self.w0 = float(np.log(p / (1 - p)))
        gw0, gw, gv = 1e-8, np.full(self.w.shape, 1e-8), np.full(self.v.shape, 1e-8)
        draw = np.random.default_rng(seed)
        for _ in range(epochs):
            order = draw.permutation(len(rows))
            for k in range(0, len(rows), batch):
                some = [rows[i] for i in order[k : k + batch]]
                lens = np.array([len(r[0]) for r in some])
                first = np.concatenate([[0], np.cumsum(lens)[:-1]])
                at, x = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
                v = self.v[at]
                vx = v * x[:, None]
                sums = np.add.reduceat(vx, first)
                m = self.w0 + np.add.reduceat(self.w[at] * x, first) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, first)).sum(axis=1)
                g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[order[k : k + batch]]) / len(some)
                e = np.repeat(g, lens)
                seen, to = np.unique(at, return_inverse=True)
                dw = np.bincount(to, e * x) + decay * self.w[seen]
                d = (e * x)[:, None] * (np.repeat(sums, lens, axis=0) - vx)
                dv = np.stack([np.bincount(to, d[:, f]) for f in range(d.shape[1])], axis=1) + decay * self.v[seen]
                gw[seen] += dw**2
                gv[seen] += dv**2
                self.w[seen] -= rate * dw / np.sqrt(gw[seen])
                self.v[seen] -= 0.5 * rate * dv / np.sqrt(gv[seen])
                gw0 += g.sum() ** 2
                self.w0 -= rate * g.sum() / np.sqrt(gw0)


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 5000, label: str = "quality") -> FactorisationMachine | None:
    """Learn from a sample of about ``sample_rows`` labelled documents (documented bound of the
    classifier's sample), drawn by a hash of the id. Null labels are not learned from; None
    if there are none.
    """
    short_batches(docs.sparkSession)
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = marked.count()
    if not n:
        return None
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(9)), 11) / float(2**53)
    sample = docs.select("doc_id", "text", "n_chars").join(marked.where(chance < sample_rows / n), "doc_id")

    def work(batches):
        words = Words()
        for b in batches:
            rows = [features(t, n, words) for t, n in zip(b["text"].to_pylist(), b["n_chars"].to_pylist(), strict=True)]
            yield {"doc_id": b["doc_id"], "label": b["label"], "at": [r[0].astype("<i4").tobytes() for r in rows], "x": [r[1].astype("<f4").tobytes() for r in rows]}

    rows = sorted(map_batches(sample, "doc_id long, label int, at binary, x binary", work).collect())
    if not rows:
        return None
    model = FactorisationMachine()
    model.fit([(np.frombuffer(r.at, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4").astype(float)) for r in rows], np.array([r.label for r in rows], float))
    return model


def score(docs: DataFrame, model: FactorisationMachine | None) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) of every whole text.

    A null text counts as empty. Without a model every score is 0.5. Repeated rows are
    scored one by one.
    """
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def work(batches):
        m = held.value
        for b in batches:
            if m is None:
                p = np.full(len(b["doc_id"]), 0.5)
            else:
                rows = [m.scaled(*features(t, n, m.words)) for t, n in zip(b["text"].to_pylist(), b["n_chars"].to_pylist(), strict=True)]
                p = np.concatenate([1 / (1 + np.exp(-np.clip(m.margins(rows[k : k + 64]), -30, 30))) for k in range(0, len(rows), 64)])
            yield {"doc_id": b["doc_id"], "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return map_batches(docs.select("doc_id", "text", "n_chars"), "doc_id long, score double, predicted int", work)
