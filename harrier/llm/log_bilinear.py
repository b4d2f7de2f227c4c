"""A log-bilinear language model, trained in numpy by noise-contrastive estimation.

Tokens are the lower-cased (A-Z) words of a text and one end. The model predicts a symbol from
the two before it: a symbol is a word that occurs often enough, the end, or a tail of other words (by their
last two bytes, which tell much about a language's endings). The vocabulary is counted and grows
with the corpus; the words that are modelled do so up to ``most_words``.

Symbols lie in groups by their frequency, the frequent ones in small groups: the k-th, from 0, has 4 k + 1 symbols. A context is h = C1 r_a + C2 r_b; the group of
the next symbol has the score h . u + bias, the symbol in its group h . q + bias, and both are normalised by matrix products over a
batch of contexts. A word of a tail has its share of the tail by its count plus one, from the counts
of the whole training corpus.

All training tokens are learned from. Texts are dealt to parts by their hash, and the number of parts comes from the counted
tokens; a part trains on its distinct trigrams in an order of its own, so that the model is the same however the
table is laid out. The parameters are the parts' mean.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, saved, short_batches

TAILS, DIM = 160, 16
#: Contexts that are multiplied at once: few enough to stay in a core's cache.
ROWS = 512
#: Batches of texts that are scored at once: contexts that they share are normalised once.
LOT = 2
#: Scores of one symbol up to which exponentials of two may be multiplied: far within a double's range.
MODERATE = 300.0
#: Tokens that a part trains on, about.
PART_TOKENS = 4_000_000
#: The end as a token among words; words hold no white space.
END_TOKEN = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """Words of a text: bytes.lower and bytes.split know A-Z and the six ASCII spaces only."""
    return (text or "").encode().lower().split()


def encoded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``tokens`` of all texts: how many each has, the different ones as they come, and each token's place among those."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    keep = pc.greater(pc.binary_length(words), 0)  # white space at the ends leaves empty words
    found = words.filter(keep).dictionary_encode()
    lens = np.bincount(of[keep.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return lens, found.dictionary.view(pa.binary()), found.indices.to_numpy()


def _raw(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """Where each word begins, and the last one ends, in the bytes of all."""
    _, at, raw = words.buffers()
    at = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    return at, raw.to_pybytes() if raw else b""


def listed(words: pa.Array) -> list[bytes]:
    at, raw = _raw(words)
    at = at.tolist()
    return [raw[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]


def split(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """``encoded`` with the different words as a list."""
    lens, distinct, place = encoded(texts)
    return lens, listed(distinct), place


def tail(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-2:]) % TAILS


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each, as numbers with a sign."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, listed(words)), np.uint64, len(words))
    return (h ^ np.uint64(1 << 63)).view(np.int64)


@cache
def _tails() -> np.ndarray:
    """The tail of each ending: two bytes as a number, and after these the single bytes."""
    return np.array([tail(e.to_bytes(2, "big")) for e in range(1 << 16)] + [tail(bytes([e])) for e in range(256)])


def symbols_of(words: pa.Array, modelled: pa.Array) -> np.ndarray:
    """Of different words, none empty: a modelled word's place among ``modelled``, of others their tail, numbered behind those."""
    at, raw = _raw(words)
    lo, hi, letters = at[:-1], at[1:], np.frombuffer(raw, np.uint8)
    if not len(words):
        return np.zeros(0, np.int64)
    last = letters[hi - 1].astype(np.int64)
    endings = np.where(hi - lo > 1, (letters[hi - 2].astype(np.int64) << 8) + last, (1 << 16) + last)
    found = pc.index_in(words, value_set=modelled)
    return np.where(found.is_null().to_numpy(zero_copy_only=False), len(modelled) + _tails()[endings], found.fill_null(0).to_numpy())


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.unique(keys, return_inverse=True)`` of numbers from 0: where these and their places fit in 63 bits, they are
    sorted as one number, which is far quicker than an argsort."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)
    both = (keys.astype(np.int64) << bits) | np.arange(len(keys))
    both.sort()
    order, both = both & ((1 << bits) - 1), both >> bits
    new = np.concatenate([[True], both[1:] != both[:-1]])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return both[new], inverse


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of numbers in their order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def summed(keys: list[np.ndarray], times: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of all arrays in their order, and how often each occurs, an array as often as its ``times`` says."""
    out, n = _counted(np.concatenate([k for k, t in zip(keys, times, strict=True) if t == 1] or [np.zeros(0, np.int64)]))
    more = [(k, t) for k, t in zip(keys, times, strict=True) if t != 1]
    if more:  # the few texts that have copies
        extra, at = np.unique(np.concatenate([k for k, _ in more]), return_inverse=True)
        by = np.bincount(at, np.repeat([t for _, t in more], [len(k) for k, _ in more]), len(extra)).astype(np.int64)
        place = np.searchsorted(out, extra)
        old = np.isin(extra, out, assume_unique=True)
        n[place[old]] += by[old]
        out, n = np.insert(out, place[~old], extra[~old]), np.insert(n, place[~old], by[~old])
    return out, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class LogBilinear:
    """``counts``: of every symbol but that before a text, which is never predicted."""

    def __init__(self, counts: np.ndarray, seed: int = 3):
        n = len(counts)
        order = np.argsort(-counts, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.group = ((np.sqrt(1 + 8.0 * np.arange(n)) + 1) // 4).astype(np.int64)  # group k begins at rank k (2 k - 1) and has 4 k + 1 symbols
        self.begin = np.searchsorted(self.group, np.arange(self.group[-1] + 2)) if n else np.zeros(1, np.int64)
        p = np.maximum(counts[order], 1e-9).astype(float)
        self.p_group = np.add.reduceat(p, self.begin[:-1]) / p.sum()
        self.p_word = p / np.add.reduceat(p, self.begin[:-1])[self.group]
        self.below = np.concatenate([[0], np.cumsum(self.p_word)])  # a group's words have 1 together
        draw = np.random.default_rng(seed)
        near = lambda k: draw.normal(0, 0.1, (k, DIM)).astype(np.float32)
        self.doubles = None
        self.parts = [near(n + 1), near(len(self.p_group)), near(n), np.stack([np.eye(DIM), np.eye(DIM)]).astype(np.float32), np.log(self.p_group).astype(np.float32), np.log(self.p_word).astype(np.float32)]

    def parameters(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    def set_parameters(self, p: np.ndarray) -> None:
        self.doubles = None
        at = np.cumsum([0] + [x.size for x in self.parts])
        self.parts = [p[lo:hi].reshape(x.shape).astype(np.float32) for lo, hi, x in zip(at[:-1], at[1:], self.parts, strict=True)]

    def _word_finder(self) -> Callable[[np.ndarray], np.ndarray]:
        """Gives for numbers among ``below`` the last word that doesn't begin above each. A guide of eight places a word tells where
        to look from, so that few steps are left."""
        steps, above = 8 * len(self.below) / self.below[-1], np.append(self.below[1:-1], np.inf)
        guide = np.maximum(np.searchsorted(self.below, np.arange(8 * len(self.below) + 1) / steps, "right") - 2, 0)

        def find(drawn: np.ndarray) -> np.ndarray:
            y = guide.take(np.minimum((drawn * steps).astype(np.int64), len(guide) - 1))
            while (short := above.take(y) <= drawn).any():
                y += short
            return y

        return find

    def train(self, grams: np.ndarray, times: np.ndarray, *, noise: int = 32, inner: int = 2, batch: int = 16384, rate: float = 0.15, visits: int = 1_000_000, passes: int = 2000, seed: int = 1) -> None:
        """Noise-contrastive estimation over distinct trigrams (a, b, s), each as
        heavy as it is frequent: of groups, whose noise a batch shares, and of the words within a group.
        One pass, or as many as make ``visits`` of trigrams, ``passes`` at most."""
        self.doubles = None
        draw = np.random.default_rng(seed)
        passes = max(1, min(passes, visits // max(1, len(grams))))
        r, u, q, c, bias_u, bias_q = self.parts
        sq = [np.full(x.shape, 1e-6, np.float32) for x in self.parts]
        log_group, log_word = np.log(noise * self.p_group).astype(np.float32), np.log(inner * self.p_word).astype(np.float32)
        single = np.diff(self.begin) == 1
        grams = np.asarray(grams, np.int32)
        word_at = self._word_finder()
        weight = (times / times.mean()).astype(np.float32)

        def sums(at: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
            out = np.empty((n, g.shape[1]), np.float32)
            for f in range(g.shape[1]):
                out[:, f] = np.bincount(at, g[:, f], n)
            return out

        for at in (part for _ in range(passes) for part in np.split(draw.permutation(len(grams)), range(batch, len(grams), batch))):
            a, b, s = np.ascontiguousarray(grams.take(at, axis=0).T, np.int64)
            s = self.rank[s]
            k, w = self.group[s], weight[at] / len(at)
            ra, rb, uk, qs = r.take(a, axis=0), r.take(b, axis=0), u.take(k, axis=0), q.take(s, axis=0)
            h = ra @ c[0] + rb @ c[1]
            z = draw.choice(len(self.p_group), noise, p=self.p_group)
            gt = w * (_sigmoid(np.einsum("id,id->i", h, uk) + bias_u[k] - log_group[k]) - 1)
            gf = h @ u[z].T
            gf += bias_u[z] - log_group[z]
            gf = _sigmoid(gf)
            gf *= w[:, None]
            inside = w * ~single[k]  # a group of one word leaves nothing to learn
            y = word_at(k[:, None] + draw.random((len(at), inner)))
            y = np.clip(y, self.begin[k][:, None], self.begin[k + 1][:, None] - 1)
            it = inside * (_sigmoid(np.einsum("id,id->i", h, qs) + bias_q[s] - log_word[s]) - 1)
            qy = q.take(y, axis=0)
            iy = inside[:, None] * _sigmoid(np.einsum("id,ijd->ij", h, qy) + bias_q[y] - log_word[y])
            dh = gt[:, None] * uk + gf @ u[z] + it[:, None] * qs + np.einsum("ij,ijd->id", iy, qy)
            du = sums(k, gt[:, None] * h, len(u)) + sums(z, gf.T @ h, len(u))
            words, pull = np.concatenate([s, y.ravel()]), np.concatenate([it[:, None] * h, (iy[:, :, None] * h[:, None]).reshape(-1, DIM)])
            dq = sums(words, pull, len(q))
            dr = sums(np.concatenate([a, b]), np.concatenate([dh @ c[0].T, dh @ c[1].T]), len(r))
            dbu = np.bincount(k, gt, len(u)) + np.bincount(z, gf.sum(axis=0), len(u))
            dbq = np.bincount(words, np.concatenate([it, iy.ravel()]), len(q))
            for x, g, total in zip(self.parts, (dr, du, dq, np.stack([ra.T @ dh, rb.T @ dh]), dbu, dbq), sq, strict=True):
                g = g.astype(np.float32)
                total += g * g
                x -= rate * g / np.sqrt(total)

    def _doubles(self) -> tuple:
        """The parameters in double precision, each symbol's part of a context, and, unless they are out of all bounds, the
        exponentials of its scores of groups, before last and last. They are kept until the parameters change."""
        if self.doubles is None:
            r, u, q, c, bias_u, bias_q = (x.astype(np.float64) for x in self.parts)
            left, right = r @ c[0], r @ c[1]
            x, y = left @ u.T, right @ u.T + bias_u
            moderate = max(np.abs(x).max(), np.abs(y).max()) <= MODERATE
            self.doubles = (u, q, bias_u, bias_q, left, right, *((np.exp(x, out=x), np.exp(y, out=y)) if moderate else (None, None)))
        return self.doubles

    def log_probabilities(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over groups and over the words of the group.

        In double precision: a product's last bits hang on the rows beside it, which is then far below what scores are compared by."""
        u, q, bias_u, bias_q, left, right, left_groups, right_groups = self._doubles()
        s, n = self.rank[s], len(left)
        k = self.group[s]
        context, of = _ordered(a * np.int64(n) + b)  # half of a lot's contexts are repeated
        first, last = context // n, context % n
        all_groups = np.empty(len(context))
        for lo in range(0, len(context), ROWS):
            i = slice(lo, lo + ROWS)
            all_groups[i] = np.log(np.einsum("ij,ij->i", left_groups.take(first[i], axis=0), right_groups.take(last[i], axis=0))) if left_groups is not None else _log_sum(left[first[i]] + right[last[i]], u, bias_u)
        pair, which = _ordered(k * len(context) + of)  # a group in a context, by groups
        edge, inside = np.searchsorted(pair, np.arange(len(u) + 1) * len(context)), np.empty(len(pair))
        pair %= max(1, len(context))
        for g in np.flatnonzero(np.diff(edge)):
            own, at = slice(self.begin[g], self.begin[g + 1]), pair[edge[g] : edge[g + 1]]
            inside[edge[g] : edge[g + 1]] = _log_sums(left, right, first[at], last[at], q[own], bias_q[own])
        out = bias_u[k] + bias_q[s] - all_groups[of] - inside[which]
        for lo in range(0, len(out), 4 * ROWS):
            i = slice(lo, lo + 4 * ROWS)
            out[i] += np.einsum("id,id->i", left.take(a[i], axis=0) + right.take(b[i], axis=0), u.take(k[i], axis=0) + q.take(s[i], axis=0))
        return out


def _log_sums(left: np.ndarray, right: np.ndarray, first: np.ndarray, last: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """``_log_sum`` of contexts whose symbols are ``first`` and ``last``.

    A context's score is a sum of one by each symbol, so its exponential is a product: where symbols are shared by
    enough contexts, exponentials are taken once a symbol.
    """
    out = np.empty(len(first))
    mine, its = (_numbered(x, len(left)) for x in (first, last))
    if len(mine[0]) + len(its[0]) < 0.8 * len(first):
        x, y = left[mine[0]] @ vectors.T, right[its[0]] @ vectors.T + bias
        if max(np.abs(x).max(), np.abs(y).max()) <= MODERATE:
            np.exp(x, out=x), np.exp(y, out=y)
            for lo in range(0, len(first), ROWS):
                i = slice(lo, lo + ROWS)
                out[i] = np.einsum("ij,ij->i", x.take(mine[1][i], axis=0), y.take(its[1][i], axis=0))
            return np.log(out)
    for lo in range(0, len(first), ROWS):
        out[lo : lo + ROWS] = _log_sum(left.take(first[lo : lo + ROWS], axis=0) + right.take(last[lo : lo + ROWS], axis=0), vectors, bias)
    return out


def _numbered(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of numbers below n, and each one's place among them."""
    number = np.zeros(n, np.int64)
    number[x] = 1
    distinct = np.flatnonzero(number)
    number[distinct] = np.arange(len(distinct))
    return distinct, number[x]


def _log_sum(h: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Of each row, the logarithm of the sum of its exponential scores."""
    score = h @ vectors.T
    score += bias
    with np.errstate(over="ignore", divide="ignore"):
        out = np.log(np.exp(score).sum(axis=1))
    for i in np.flatnonzero(~np.isfinite(out)):  # beyond a double's range, which scores hardly ever are
        top = score[i].max()
        out[i] = top + np.log(np.exp(score[i] - top).sum())
    return out


class Scorer:
    """What a worker needs to score texts: the model, sums of the tails and the counts of known words."""

    def __init__(self, model, modelled, hashes, counts, tail_words, tail_tokens, total, kinds, ends):
        self.model, self.modelled, self.hashes, self.counts = model, pa.array(modelled, pa.binary()), hashes, counts
        self.tail_log = np.log10(tail_tokens + tail_words + 1.0)
        self.log_total, self.ends = math.log10(total + kinds + 1), ends
        self.hit, self.log = self._counted(self.modelled)

    def _counted(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Whether words are among those that workers know, and the logarithms of their counts plus one."""
        if not len(self.hashes):
            return np.zeros(len(words), bool), np.zeros(len(words))
        h = word_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return hit, np.where(hit, np.log10(self.counts[at] + 1.0), 0.0)

    def score(self, texts: pa.Array) -> dict:
        """Sums over known words, and each text's other words with their times."""
        lens, distinct, place = encoded(texts)
        first_tail, symbols = len(self.modelled), symbols_of(distinct, self.modelled)
        other = symbols >= first_tail
        hits, logs = np.empty(len(distinct), bool), np.empty(len(distinct))
        hits[~other], logs[~other] = self.hit[symbols[~other]], self.log[symbols[~other]]
        hits[other], logs[other] = self._counted(distinct.filter(pa.array(other)))
        symbol, hit, logs = symbols[place], hits[place], logs[place]
        rows, first = _trigrams(symbol, lens, first_tail + TAILS)
        lp = self.model.log_probabilities(*rows) / math.log(10)
        of = np.repeat(np.arange(len(texts)), lens)
        # a word of a tail has its share of the tail; a modelled word is a symbol itself
        share = np.where(symbol < first_tail, 0.0, logs - self.tail_log[np.maximum(symbol - first_tail, 0)])
        n = lens + 1
        others: list[Counter] = [Counter() for _ in texts]
        rare = np.flatnonzero(~hit)
        for i, w in zip(of[rare].tolist(), distinct.take(pa.array(place[rare])).to_pylist(), strict=True):
            others[i][w] += 1
        return {
            "n_tokens": n,
            "n_known": np.bincount(of, hit, len(texts)).astype(np.int64) + int(self.ends > 0),
            "base": np.bincount(of, logs, len(texts)) + math.log10(self.ends + 1) - n * self.log_total,
            "own": np.add.reduceat(lp, first) + np.bincount(of, share, len(texts)),
            "word": [list(c) for c in others],
            "times": [list(c.values()) for c in others],
        }


def _trigrams(symbol: np.ndarray, lens: np.ndarray, end: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Before last, last and symbol of all texts' symbols, each text closed by an end, and each text's first row."""
    text = np.arange(len(lens))
    first = np.cumsum(lens + 1) - (lens + 1)
    flat = np.full(len(symbol) + 3 * len(lens), end + 1, np.int64)
    flat[np.arange(len(symbol)) + 3 * np.repeat(text, lens) + 2] = symbol
    flat[first + lens + 2 * text + 2] = end
    keep = np.arange(len(symbol) + len(lens)) + np.repeat(2 * text, lens + 1)
    return (flat[keep], flat[keep + 1], flat[keep + 2]), first


def count_words(docs: DataFrame, entries: int = 400_000) -> DataFrame:
    """word (the end as a line break), n over all rows: counted in each task, then summed.

    A task adds up its batches' counts whenever they hold twice ``entries`` words, and hands them on where
    more than ``entries`` are left."""

    def added(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        words = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
        n = np.bincount(words.indices.to_numpy(), np.concatenate([n for _, n in held]), len(words.dictionary))
        return words.dictionary, n.astype(np.int64)

    def work(batches):
        held, size = [], 0
        for b in batches:
            _, distinct, place = encoded(b["text"])
            held += [(distinct, np.bincount(place, minlength=len(distinct))), (pa.array([END_TOKEN], pa.binary()), np.array([len(b["text"])]))]
            size += len(distinct)
            if size > 2 * entries:
                held = [added(held)]
                size = len(held[0][0])
                if size > entries:
                    yield {"word": held[0][0], "n": held[0][1]}
                    held, size = [], 0
        if held:
            words, n = added(held)
            yield {"word": words, "n": n}

    return map_batches(docs.select("text"), "word binary, n long", work).groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, modelled: list[bytes], counts: np.ndarray, total: int, *, slices: int = 32) -> LogBilinear:
    """Each part of the corpus trains from one start on all its tokens; the parameters are
    the parts' mean, weighted by tokens and added up slice by slice in the order of the parts."""
    spark = docs.sparkSession
    start = LogBilinear(counts)
    size, n = len(start.parameters()), len(counts) + 1
    parts = max(1, round(total / PART_TOKENS))
    held = spark.sparkContext.broadcast((modelled, counts))  # bounded by most_words

    def symbols(batches):
        words = pa.array(held.value[0], pa.binary())
        for b in batches:
            texts = b["text"].fill_null("").dictionary_encode()
            times = np.bincount(texts.indices.to_numpy(), minlength=len(texts.dictionary))
            of = [xxhash.xxh64_intdigest(t) for t in listed(texts.dictionary)]
            lens, distinct, place = encoded(texts.dictionary)
            symbol = symbols_of(distinct, words).astype(np.int32)[place]
            ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(4 * ends), pa.py_buffer(symbol)])
            yield {"part": [x % parts for x in of], "times": times, "ids": ids}

    def learn(batches):
        end, pad = n - 2, n - 1
        part, pending = None, []

        def trained():
            keys, times = summed([k for k, _ in pending], [t for _, t in pending])
            pending.clear()
            grams = np.empty((len(keys), 3), np.int32)
            keys, grams[:, 2] = np.divmod(keys, n)
            grams[:, 0], grams[:, 1] = np.divmod(keys, n)
            model = LogBilinear(held.value[1])
            model.train(grams, times, seed=part)
            weight = int(times.sum())
            pieces = np.array_split(model.parameters() * np.float64(weight), slices)
            return {"slice": list(range(slices)), "part": [part] * slices, "weight": [weight] * slices, "sums": [x.tobytes() for x in pieces]}

        for b in batches:
            for p, times, ids in zip(b["part"].to_pylist(), b["times"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if p != part and pending:
                    yield trained()
                part = p
                x = np.concatenate([[pad, pad], np.frombuffer(ids, np.int32), [end]]).astype(np.int64)
                pending.append(((x[:-2] * n + x[1:-1]) * n + x[2:], times))
        if pending:
            yield trained()

    def added(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for i, w, x in zip(b["slice"].to_pylist(), b["weight"].to_pylist(), b["sums"].to_pylist(), strict=True):
                held_ = sums.setdefault(i, [0, 0.0])
                held_[0], held_[1] = held_[0] + w, held_[1] + np.frombuffer(x)
        for i, (w, x) in sums.items():
            yield {"slice": [i], "part": [0], "weight": [w], "sums": [x.tobytes()]}

    schema = "slice int, part int, weight long, sums binary"
    dealt = map_batches(docs.select("text"), "part int, times long, ids binary", symbols).repartition(parts, "part").sortWithinPartitions("part")
    learned = saved(map_batches(dealt, schema, learn), "lm-parts").repartition(slices, "slice").sortWithinPartitions("slice", "part")
    got = {r.slice: np.frombuffer(bytes(r.sums)) / r.weight for r in map_batches(learned, schema, added).toLocalIterator()}  # one model
    if got:
        start.set_parameters(np.concatenate([got[i] for i in range(slices)]))
    assert len(start.parameters()) == size
    return start


def _tail_sums(words: DataFrame, modelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each tail, without the modelled words."""

    def tails(batches):
        n, k = np.zeros(TAILS), np.zeros(TAILS)
        known = pa.array(modelled, pa.binary())
        for b in batches:
            i = symbols_of(b["word"], known) - len(known)
            n += np.bincount(i[i >= 0], b["n"].to_numpy()[i >= 0], TAILS)
            k += np.bincount(i[i >= 0], minlength=TAILS)
        at = np.flatnonzero(k)
        yield {"tail": at, "n": n[at], "k": k[at]}

    tokens_, kinds = np.zeros(TAILS), np.zeros(TAILS)
    for r in map_batches(words, "tail int, n double, k double", tails).groupBy("tail").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect():
        tokens_[r.tail], kinds[r.tail] = r.n, r.k
    return tokens_, kinds


def _known(words: DataFrame, floor_modelled: int, known_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of all words above the lowest count that keeps the bound; modelled words are among them."""
    floor, room = 0, known_words
    for r in words.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(known_words).toLocalIterator():
        room -= r.k
        if room < 0:
            floor = r.n
            break

    def hashed(batches):
        for b in batches:
            yield {"hash": word_hashes(b["word"]), "n": b["n"]}

    above = words.where((F.col("n") > floor) | (F.col("n") >= floor_modelled))
    got = map_batches(above, "hash long, n long", hashed).toArrow()
    hashes, n = got["hash"].to_numpy(), got["n"].to_numpy()
    at = np.argsort(hashes)
    return hashes[at], n[at]


def score(docs: DataFrame, training: DataFrame, *, known_words: int = 1_000_000, min_count: int = 20, most_words: int = 20_000) -> DataFrame:
    """Scores of every whole text of ``docs`` by a model of all texts of ``training``.

    Words of ``min_count`` tokens or more are modelled; should there be more than ``most_words`` (3 MB of parameters), those
    above the count that keeps this bound. The counts of the ``known_words`` most frequent words go to all workers as sorted
    hashes (16 MB at most); the counts of all others are joined to the words that the texts
    have of them. A null text counts as empty: its only token is the end. With no training
    rows every token is unknown. Repeated rows are scored one by one.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    short_batches(spark)
    counts = saved(count_words(training), "lm-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = F.lit(bytearray(END_TOKEN))
    words = counts.where(F.col("word") != end)
    ends = sum(r.n for r in counts.where(F.col("word") == end).collect())
    floor, room = min_count, most_words
    for r in words.where(F.col("n") >= min_count).groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(most_words).toLocalIterator():
        room -= r.k
        if room < 0:
            floor = r.n + 1
            break
    top = sorted(((r.n, bytes(r.word)) for r in words.where(F.col("n") >= floor).collect()), key=lambda x: (-x[0], x[1]))  # most_words at most
    modelled = [w for _, w in top]
    tail_tokens, tail_words = _tail_sums(words, modelled)
    model = train(training, modelled, np.concatenate([np.array([n for n, _ in top], float), tail_tokens + 0.5, [ends + 0.5]]), total)
    scorer = Scorer(model, modelled, *_known(words, floor, known_words), tail_words, tail_tokens, total, kinds, ends)
    held = spark.sparkContext.broadcast(scorer)

    def work(batches):
        s, row = held.value, TaskContext.get().partitionId() << 40
        while some := list(islice(batches, LOT)):
            out = s.score(pa.concat_arrays([b["text"] for b in some]))
            yield {"row": row + np.arange(len(out["n_tokens"])), "doc_id": pa.concat_arrays([b["doc_id"] for b in some]), **out}
            row += len(out["n_tokens"])

    # each text's sums over the words that workers know, and its other words
    rows = saved(map_batches(docs.select("doc_id", "text"), "row long, doc_id long, n_tokens long, n_known long, base double, own double, word array<binary>, times array<long>", work), "lm-rows")
    rest = rows.select("row", F.explode(F.arrays_zip("word", "times")).alias("x")).select("row", "x.word", "x.times")
    rest = rest.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    none = F.lit(0.0)
    return rows.join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", none)).alias("base_score"), (F.col("own") + F.coalesce("more", none)).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The registered query: learn from those with crc32(doc_id) mod 7 not 2, score all."""
    out = held_out(7, 2)
    return score(docs, docs.where(~out)).withColumn("held_out", out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
