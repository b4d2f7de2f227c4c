"""Exact removal of repeated strings by suffix sorting.

A byte goes if it lies in a string of ``SPAN`` bytes that also starts anywhere else. Almost all such
windows occur once, so they are narrowed down before any suffix is sorted: each window has an
anchor, the ``GRAM``-byte string in it of the least hash (the leftmost of ties), and equal windows have equal
anchors at equal places. The consecutive windows of one anchor are a hull of bytes:

* an anchor string that occurs once has no repeated window;
* equal hulls around equal anchors repeat all their windows (hulls are compared by 64 bits of a cryptographic hash
  under a key that is drawn anew in each run, so that no text can be made to collide, and only within one anchor);
* the different hulls of one anchor string (the ends of repeated passages, mostly) are brought together,
  one of each, and their suffixes are sorted (``suffix_sort``): neighbours with a common
  prefix of ``SPAN`` bytes are repeated windows.

A shard holds the hulls of many anchors. The hulls of an anchor that has more than ``crowd`` of them are dealt anew: their
windows get a second anchor by another hash, and equal windows agree in both; and so on, for ``LEVELS``
levels. Most of a crowd's windows are known to occur once then, and the rest is spread over many shards. A shard may be longer
than memory: the sorter goes to disk.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, extended, map_batches, saved, short_batches
from .suffix_sort import suffix_array

SPAN, GRAM, LEVELS = 200, 32, 5
SEGMENT, TOGETHER = 1 << 21, 1 << 15  # long texts are read in stretches that overlap by a window, short ones together
_draw = np.random.default_rng(41)
_VALUE = _draw.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = _powers[i]
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
            _powers[i] = p
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Prefixes:
    """Hashes of a text's substrings, from sums over its prefixes."""

    def __init__(self, text: bytes):
        b = np.frombuffer(text, np.uint8)
        up, self.down = _power(len(b) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[b] * up[:-1])])


def _hulls(text: bytes, lens: np.ndarray, level: int, key: bytes) -> tuple[np.ndarray, ...]:
    """Of texts that stand one after another: which text, anchor's hash, hash of hull and anchor's place in it, first
    window, last window. Each level has other anchors."""
    n = len(text) - SPAN + 1
    p = Prefixes(text)
    m = len(text) - GRAM + 1
    grams = _mix((p.sums[GRAM:] - p.sums[:m]) * p.down[:m])
    if level:
        grams = _mix(grams ^ np.uint64(level * _BASE % (1 << 64)))
    least = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)
    width, w = SPAN - GRAM + 1, 1
    while 2 * w <= width:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    least = np.minimum(least[:n], least[width - w : width - w + n])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    end = np.cumsum(lens)
    of = np.repeat(np.arange(len(lens)), lens)[:n]
    inside = np.arange(SPAN, n + SPAN) <= end[of]  # windows that lie in one text
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1]) | ~inside[:-1]])
    first = np.flatnonzero(new & inside)
    last = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    anchor, of = at[first], of[first]
    digest = hashlib.blake2b(key=key, digest_size=8)
    hashed = []
    for lo, hi in zip(first.tolist(), (last + SPAN).tolist(), strict=True):
        one = digest.copy()
        one.update(text[lo:hi])
        hashed.append(one.digest())
    hull = np.frombuffer(b"".join(hashed), np.uint64)
    begin = (end - lens)[of]
    return of, grams[anchor], _mix(hull ^ grams[anchor] * np.uint64(3)), first - begin, last - begin


def hulls(texts: list[bytes], key: bytes, level: int = 0) -> tuple[np.ndarray, ...]:
    """Of whole texts: those of ``_hulls``. A text that is shorter than a window has none."""
    stretches = [(i, lo, t[lo : lo + SEGMENT + SPAN - 1]) for i, t in enumerate(texts) for lo in range(0, len(t) - SPAN + 1, SEGMENT)]
    parts, held, size = [], [], 0
    for k, x in enumerate(stretches):
        held.append(x)
        size += len(x[2])
        if size >= TOGETHER or k == len(stretches) - 1:
            of, a, h, s, e = _hulls(b"".join(t for _, _, t in held), np.array([len(t) for _, _, t in held]), level, key)
            number, offset = np.array([i for i, _, _ in held]), np.array([lo for _, lo, _ in held])
            parts.append((number[of], a, h, s + offset[of], e + offset[of]))
            held, size = [], 0
    if not parts:
        return (np.empty(0, np.int64),) + (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _hull_rows(texts: DataFrame, key: bytes, once: bool) -> DataFrame:
    """anchor, hull, of and id (a text's hash and row), span (first and last window), n.

    ``once``: hulls that many texts of a batch have give one row, n counting them; else each
    distinct text of a batch gives its own. Copies of a text in a batch are read once.
    """

    def work(batches):
        for b in batches:
            texts_, of, ids = b["text"].to_pylist(), b["of"].to_pylist(), b["id"].to_pylist()
            times: dict[int, int] = {}
            for x in of:
                times[x] = times.get(x, 0) + 1
            seen: dict[int, int] = {}
            for i, (t, x) in enumerate(zip(texts_, of, strict=True)):
                if len(t) >= SPAN:
                    seen.setdefault(x, i)
            if not seen:
                continue
            rows = list(seen.values())
            k, a, h, s, e = hulls([texts_[i] for i in rows], key)
            text, row, n = np.array(list(seen))[k], np.array([ids[i] for i in rows])[k], np.array([times[x] for x in seen])[k]
            cols = [_signed(a), _signed(h), text, row, s << 32 | e, n]
            if once:
                _, at, group = np.unique(cols[1], return_index=True, return_inverse=True)
                n = np.bincount(group, cols[5]).astype(np.int64)
                cols = [c[at] for c in cols[:5]] + [n]
            yield dict(zip(("anchor", "hull", "of", "id", "span", "n"), cols, strict=True))

    return map_batches(texts, "anchor long, hull long, of long, id long, span long, n long", work)


def _windows(first: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive window starts, as byte ranges."""
    first = np.unique(first)
    new = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1] + 1]))
    return list(zip(first[new].tolist(), (first[np.append(new[1:], len(first)) - 1] + SPAN).tolist(), strict=True))


def _sort_shard(rows: pd.DataFrame, memory: int) -> pd.DataFrame:
    """The repeated windows of a shard's hulls, by their suffixes."""
    rows = rows.drop_duplicates(["anchor", "hull"]).sort_values(["anchor", "hull"])
    whose, start = rows.of.to_numpy(), rows["first"].to_numpy()
    parts = [np.frombuffer(b, np.uint8) for b in rows.bytes]
    lens = np.array([len(p) + 1 for p in parts])
    text = np.zeros(int(lens.sum()), np.int32)
    begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
    for at, p in zip(begin, parts, strict=True):
        text[at : at + len(p)] = p.astype(np.int32) + 1
    sa, lcp = suffix_array(text, SPAN, memory)
    hits = []
    for lo in range(0, len(sa), memory):  # in stretches: the arrays may be files
        hit = np.flatnonzero(lcp[lo : lo + memory] >= SPAN) + lo
        hits += [sa[hit], sa[hit - 1]]
    at = np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int64)
    row = np.searchsorted(begin, at, "right") - 1
    keep = at + SPAN <= begin[row] + lens[row] - 1
    at, row = at[keep], row[keep]
    edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else np.zeros(1, np.int64)
    out = [(whose[row[lo]], s, e) for lo, hi in zip(edges[:-1], edges[1:], strict=True) for s, e in _windows(at[lo:hi] - begin[row[lo]] + start[row[lo]])]
    return pd.DataFrame(out, columns=["of", "s", "e"]).astype("int64")


def _mixed(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (anchor, hull, n, at): hulls that occur twice or more, and hulls of anchors that have others, some
    of which occur once (with the number of the anchor's hulls)."""
    by_hull = rows.groupBy("anchor", "hull").agg(F.sum("n").alias("n"), F.first("at").alias("at"))
    by_anchor = by_hull.groupBy("anchor").agg(F.count("*").alias("hulls"), F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1").drop("total")
    found = saved(by_hull.join(by_anchor, "anchor"), name)
    return found.where("n > 1").select("anchor", "hull"), found.where("hulls > 1 and least = 1")


def repeated(texts: DataFrame, *, shard_bytes: int = 1 << 20, crowd: int = 4_000, memory: int = 4_000_000) -> DataFrame:
    """of, s, e: byte ranges of repeated windows of the texts (columns of, id, text as bytes).

    ``memory``: suffixes of a shard that are sorted in memory; beyond it the sorter uses files.
    """
    key = secrets.token_bytes(32)
    twice, mixed = _mixed(_hull_rows(texts, key, True).withColumn("at", F.struct("of", "id", "span")), "sfx-hulls")
    end = (F.col("span").bitwiseAND(0xFFFFFFFF) + SPAN).alias("e")
    marks = _hull_rows(texts, key, False).join(twice, ["anchor", "hull"]).select("of", F.shiftright("span", 32).alias("s"), end)
    asked = mixed.groupBy("at.of", "at.id").agg(F.collect_list(F.struct("anchor", "hull", "at.span", "hulls")).alias("asked"))
    asked = asked.select("of", "id", "asked.anchor", "asked.hull", "asked.span", "asked.hulls")

    def cut(batches):
        for b in batches:
            out = {c: [] for c in ("anchor", "hull", "of", "first", "bytes", "hulls")}
            for t, of, *lists in zip(*[b[c].to_pylist() for c in ("text", "of", "anchor", "hull", "span", "hulls")], strict=True):
                for a, h, span, k in zip(*lists, strict=True):
                    for c, x in zip(out, (a, h, of, span >> 32, t[span >> 32 : (span & 0xFFFFFFFF) + SPAN], k), strict=True):
                        out[c].append(x)
            yield out

    schema = "anchor long, hull long, of long, first long, bytes binary, hulls long"
    pieces = saved(map_batches(texts.join(asked, ["of", "id"]), schema, cut), "sfx-pieces")
    crowded, level = F.col("hulls") > crowd, 0

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        return _sort_shard(rows, memory)

    while True:
        level += 1
        few = pieces if level == LEVELS else pieces.where(~crowded)
        size = few.agg(F.sum(F.length("bytes"))).first()[0]
        if size:
            shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-size // shard_bytes))))
            marks = marks.unionByName(few.withColumn("shard", shard).groupBy("shard").applyInPandas(sort, "of long, s long, e long"))
        if level == LEVELS or pieces.where(crowded).isEmpty():
            return marks

        def split(batches, level=level):
            for b in batches:
                out: dict[str, list] = {c: [] for c in ("anchor", "hull", "of", "first", "bytes", "hulls")}
                parents, of, firsts, texts_ = (b[c].to_pylist() for c in ("anchor", "of", "first", "bytes"))
                k, a, h, s, e = hulls(texts_, key, level)
                a = _mix(a ^ np.array(parents, np.int64).view(np.uint64)[k] * np.uint64(3))
                h = _mix(h ^ a)
                out["anchor"], out["hull"], out["of"], out["first"] = _signed(a), _signed(h), np.array(of)[k], np.array(firsts)[k] + s
                out["bytes"] = [texts_[i][x : y + SPAN] for i, x, y in zip(k.tolist(), s.tolist(), e.tolist(), strict=True)]
                out["hulls"] = [0] * len(k)
                yield out

        each = saved(map_batches(pieces.where(crowded).dropDuplicates(["anchor", "hull"]), schema, split).drop("hulls"), "sfx-pieces")
        at = F.struct("of", "first", "bytes").alias("at")
        twice, mixed = _mixed(each.select("anchor", "hull", F.lit(1).alias("n"), at), "sfx-hulls")
        marks = marks.unionByName(each.join(twice, ["anchor", "hull"]).select("of", F.col("first").alias("s"), (F.col("first") + F.length("bytes")).alias("e")))
        pieces = mixed.select("anchor", "hull", "at.of", "at.first", "at.bytes", "hulls")


def _merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _inward(text: bytes, s: int, e: int) -> tuple[int, int]:
    """The range without the characters that it cuts."""
    while s < e and text[s] & 0xC0 == 0x80:
        s += 1
    while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
        e -= 1
    return s, e


def _spans(docs: DataFrame, keep: list[str], **sizes) -> DataFrame:
    """The rows of ``docs`` with their text as bytes and their marked ranges."""
    short_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(*keep, text.alias("text"), F.xxhash64(text).alias("of"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    marks = repeated(keyed.select("of", "id", "text"), **sizes).groupBy("of").agg(F.collect_set(F.struct("s", "e")).alias("marks"))
    marks = marks.select("of", "marks.s", "marks.e")
    return keyed.join(marks, "of", "left").select(*keep, "text", "s", "e")


def remove_repeats(docs: DataFrame, **sizes) -> DataFrame:
    """What is removed from each row's text and what is left.

    A null text counts as empty; texts shorter than a window keep all; equal texts of
    ``SPAN`` bytes or more lose everything, also those of repeated rows. Empty tables give no rows.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256. ``sizes``: those of ``repeated``.
    """

    def work(batches):
        for b in batches:
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for t, s, e in zip(b["text"].to_pylist(), b["s"].to_pylist(), b["e"].to_pylist(), strict=True):
                spans = _merged(zip(s or (), e or (), strict=True))
                digest, at = hashlib.sha256(), 0
                for x, y in [*spans, (len(t), len(t))]:
                    digest.update(t[at:x])
                    at = y
                for c, v in zip(out, (len(t), sum(y - x for x, y in spans), len(spans), digest.hexdigest()), strict=True):
                    out[c].append(v)
            yield {"doc_id": b["doc_id"], **out}

    return map_batches(_spans(docs, ["doc_id"], **sizes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", work)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left of each text and its length in n_chars, where there is such a column; all other columns stay.

    A removed range that cuts a character leaves that character whole, so that texts
    stay text. A null text stays null; all rows stay, those without any text left too.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    marked = docs.withColumns({"_sfx_of": F.xxhash64(text), "_sfx_id": F.coalesce("doc_id", F.lit(NO_ID))})
    keyed = marked.select(F.col("_sfx_of").alias("of"), F.col("_sfx_id").alias("id"), text.alias("text"))
    marks = repeated(keyed).groupBy("of").agg(F.collect_set(F.struct("s", "e")).alias("marks")).select(F.col("of").alias("_sfx_of"), F.col("marks").alias("_sfx_marks"))

    def work(b):
        texts = []
        for t, marks in zip(b["text"].to_pylist(), b["_sfx_marks"].to_pylist(), strict=True):
            if t is not None:
                at, left, t = 0, [], t.encode()
                for x, y in _merged((m["s"], m["e"]) for m in marks or ()):
                    x, y = _inward(t, x, y)
                    left.append(t[at:x])
                    at = max(at, y)
                t = (b"".join(left) + t[at:]).decode()
            texts.append(t)
        return {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}

    short_batches(docs.sparkSession)
    return extended(marked.join(marks, "_sfx_of", "left"), "text string, n_chars long", work).select(*docs.columns)
