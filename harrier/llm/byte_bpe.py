"""Byte-level BPE by a segment tree of pair ranks, and decoding.

A text is cut into pieces by the tokenizer's pattern. Within a piece a segment tree over the
byte positions holds, for each live position, the rank of the pair that begins there; its root
is the leftmost pair of lowest rank. A merge removes one leaf and renews the two beside it,
each in logarithmic time, so that a piece of a megabyte costs n log n. Short pieces that are new
to a worker are merged side by side, a tree each, as arrays.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import extended, map_batches, short_batches

NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: merge the leftmost pair of lowest rank until none is left."""
    if piece in ranks:
        return (ranks[piece],)
    n, get = len(piece), ranks.get
    size = 1 << (n - 2).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r * n + i  # ties in rank go to the left
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    token = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            value = value if value < other else other
            if tree[i] == value:
                return
            tree[i] = value

    while (top := tree[1]) < NONE:
        i = top % n
        j = after[i]
        k = after[i] = after[j]
        token[i] += token[j]
        token[j] = b""
        if j < n - 1:
            put(j, NONE)
        if k < n:
            before[k] = i
            r = get(token[i] + token[k])
            put(i, NONE if r is None else r * n + i)
        else:
            put(i, NONE)
        if (p := before[i]) >= 0:
            r = get(token[p] + token[i])
            put(p, NONE if r is None else r * n + p)
    return tuple(ranks[t] for t in token if t)


class Pairs:
    """Merges many short pieces at once: one segment tree a piece, one merge of each a step."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = 1 + max(ranks.values())
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left * self.base + right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks.get(bytes([x]), -1) for x in range(256)], np.int64)

    def leaf(self, left: np.ndarray, right: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
        """Leaves for pairs of ids that begin at ``at``: by rank, ties to the left."""
        if not len(self.keys):
            return np.full(np.broadcast(left, right).shape, NONE)
        key = left * self.base + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[place] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.values[place] * size + at, NONE)

    def merge(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Serialized ids of pieces of at most ``size`` bytes, a power of two."""
        rows = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, rows)
        place = np.arange(size)
        text = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(rows, size)
        ids = np.full((rows, size + 1), -1, np.int64)  # the last column stands for the end
        ids[:, :size] = np.where(place < lengths[:, None], self.bytes[text], -1)
        after = np.minimum(np.tile(place + 1, (rows, 1)), lengths[:, None])
        after = np.where(after == lengths[:, None], size, after)
        after = np.concatenate([after, np.full((rows, 1), size)], axis=1)
        before = np.tile(np.arange(-1, size), (rows, 1))
        tree = np.full((rows, 2 * size), NONE)
        tree[:, size:] = self.leaf(ids[:, :size], ids[:, 1:], size, place)
        level = size
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = tree[:, 2 * level : 4 * level].reshape(rows, level, 2).min(axis=2)
        live = np.arange(rows)
        ids_, after_, before_, tree_ = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        while True:
            top = tree_[live * (2 * size) + 1]
            going = top < NONE
            live, top = live[going], top[going]
            if not len(live):
                break
            row, root = live * (size + 1), live * (2 * size)
            i, rank = top % size, top // size
            j = after_[row + i]
            k = after_[row + j]
            ids_[row + i] = rank
            ids_[row + j] = -1
            after_[row + i] = k
            before_[row + k] = i
            p = before_[row + i]
            p = np.where(p < 0, i, p)
            tree_[root + size + j] = NONE
            tree_[root + size + p] = self.leaf(ids_[row + p], rank, size, p)
            tree_[root + size + i] = self.leaf(rank, ids_[row + k], size, i)  # last: it is right where p is i
            nodes = np.concatenate([size + i, size + j, size + p])
            root = np.tile(root, 3)
            for _ in range(size.bit_length() - 1):
                nodes >>= 1
                child = root + 2 * nodes
                tree_[root + nodes] = np.minimum(tree_[child], tree_[child + 1])
        left = ids[:, :size] >= 0
        ends = 4 * np.cumsum(left.sum(axis=1))
        flat = ids[:, :size][left].astype("<u4").tobytes()
        return [flat[a:b] for a, b in pairwise([0, *ends.tolist()])]


class Pieces(dict):
    """Serialized ids by piece. Pieces are seen again and again, so a worker keeps the short ones."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 400_000, longest: int = 64):
        self.ranks, self.limit, self.longest, self.pairs = ranks, limit, longest, Pairs(ranks)

    def __missing__(self, piece: str) -> bytes:
        return np.array(merge_piece(piece.encode(), self.ranks), "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Merge the short pieces that are not known yet, those of like length together."""
        new = [x for x in pieces if x not in self and len(x) <= self.longest]
        if len(self) + len(new) > self.limit:
            self.clear()
            new = [x for x in pieces if len(x) <= self.longest]
        sized: dict[int, list[str]] = {}
        for x in new:
            raw = x.encode()
            if raw in self.ranks:
                self[x] = self.ranks[raw].to_bytes(4, "little")
            else:
                sized.setdefault(1 << (len(raw) - 1).bit_length(), []).append(x)
        for size, group in sized.items():
            step = max(1, (1 << 15) // size)
            for lo in range(0, len(group), step):
                lot = group[lo : lo + step]
                self.update(zip(lot, self.pairs.merge([x.encode() for x in lot], size), strict=True))


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pieces = Pieces(self.ranks)
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (1 + max(self.ranks.values()))
        for token, i in self.ranks.items():
            self.tokens[i] = token

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.encode_all([text])), "<u4").tolist()

    def encode_all(self, texts: list[str | None], chars: int = 1 << 20) -> Iterator[bytes]:
        """Ids of many texts as unsigned 32-bit little-endian integers; about ``chars`` characters
        are cut into pieces at once."""
        lot, held = [], 0
        for n, text in enumerate(texts, 1):
            lot.append(self.find(text or ""))
            held += len(text or "")
            if held >= chars or n == len(texts):
                self.pieces.learn(set(chain.from_iterable(lot)))
                for found in lot:
                    yield b"".join(map(self.pieces.__getitem__, found))
                lot, held = [], 0

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (unsigned 32-bit little-endian integers, as bytes) of every whole text.

    A null text counts as empty and has no ids; repeated rows are encoded one by one.
    ``path`` is a vocabulary file that every executor has.
    """
    short_batches(docs.sparkSession)

    def work(batches):
        c = codec(path, pattern)
        for b in batches:
            yield {"doc_id": b["doc_id"], "ids": list(c.encode_all(b["text"].to_pylist()))}

    return map_batches(docs.select("doc_id", "text"), "doc_id long, ids binary", work)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, content: the bytes that ``ids`` stand for."""

    def work(batches):
        c = codec(path, pattern)
        for b in batches:
            yield {"doc_id": b["doc_id"], "content": [c.decode(x) for x in b["ids"].to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, content binary", work)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns all columns of ``docs`` but its text, n_tokens, ids_sha256 and decoded_sha256; columns of these names are replaced. Null and empty texts have no ids and the digests of nothing.
    """
    short_batches(docs.sparkSession)

    def work(b):
        c = codec(path, pattern)
        n, a, d = [], [], []
        for ids in c.encode_all(b["text"].to_pylist()):
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            d.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": d}

    return extended(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", work).drop("text")
