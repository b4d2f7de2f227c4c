"""Token ids in files of separately compressed documents.

A volume is a run of documents in ascending doc_id order:

    magic "HTOK1\\0\\0\\0" | sha256 of the dictionary (32) | width of an id in bytes (u4) |
    documents (u4) | tokens before this volume in its range (u8) | doc_id (i8 each) |
    1 if the id is not null (u1 each) | tokens (u4 each) | frame ends (u8 each) | frames

All integers are little-endian. Each frame is one document's ids, compressed by zstandard with
a dictionary that all volumes share and that was trained on serialized id arrays; the offset
index lets a reader decompress one document alone. Volumes are binary cells of a Parquet table,
one folder per data set, so that Spark's commit protocol, not a task, decides which attempt of
a lost task counts, and so that any store that Spark can write to will do.
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
import zlib
from itertools import accumulate

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, map_batches, one_thread, scratch, short_batches

MAGIC = b"HTOK1\0\0\0"
HEAD = struct.Struct("<8s32sIIQ")
_LATIN, _MARKS, _SPACES = "A-Za-z0-9À-ÖØ-öø-ÿ", ".,!?;:$%&#*", " \n\r\t"
#: Latin letters and digits before one of _MARKS, a space or the end; _MARKS before those letters, a space or the end;
#: else all up to the next space.
PIECES = re.compile(rf"[{_LATIN}]++(?![^{_MARKS}{_SPACES}])|[{_MARKS}]++(?![^{_LATIN}{_SPACES}])|[^{_SPACES}]+").findall
LETTERS = re.compile(r"[a-zà-öø-ÿ]+")
_loaded: dict = {}


def _tokenizer(path: str, end_id: int) -> Words:
    if (path, end_id) not in _loaded:
        one_thread()
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        _loaded[path, end_id] = Words(t, end_id)
    return _loaded[path, end_id]


def _composed(text: str, low: str) -> bool:
    """Whether the library composes no characters of a text or of its lower case. It has none to compose below U+0100, which
    is found out by a copy of the text, not by a look at each character."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)


class Words(dict):
    """Serialized ids by piece of text; forgets when it is full.

    The tokenizer's normalizer and splitter never look across a space, which no token and no special token holds,
    and it reads a line break, a return and a tab as a space. A Latin letter or a digit and one of ``_MARKS`` never lie in one
    token. So a text cut at spaces and between those has the ids of its pieces one after another. Pieces are
    remembered, since most are seen again and again; new ones are encoded by the library.
    """

    def __init__(self, tokenizer, end_id: int, limit: int = 400_000, longest: int = 48):
        self.tokenizer, self.limit, self.longest = tokenizer, limit, longest
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.serial = "<u2" if max(*vocabulary.values(), end_id) < 65536 else "<u4"
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        self.lowers = tokenizer.encode("A B", add_special_tokens=False).ids == tokenizer.encode("a b", add_special_tokens=False).ids

    def _one_by_one(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.serial).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _ids(self, parts: list[str]) -> dict[str, bytes]:
        """Words of letters are encoded as one text, whose ids tell where each ends."""
        known_end = bool(self.ends.any())
        words = [p for p in parts if known_end and LETTERS.fullmatch(p)]
        others = [p for p in parts if not (known_end and LETTERS.fullmatch(p))]
        out: dict[str, bytes] = {}
        for k in range(0, len(others), 2048):
            out.update(zip(others[k : k + 2048], self._one_by_one(others[k : k + 2048]), strict=True))
        for k in range(0, len(words), 2048):
            some = words[k : k + 2048]
            (e,) = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, self.serial)
            cut, raw = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist(), ids.tobytes()
            if len(cut) != len(some):
                out.update(zip(some, self._one_by_one(some), strict=True))
                continue
            out.update(zip(some, [raw[lo:hi] for lo, hi in zip([0, *cut], cut, strict=False)], strict=True))
        return out

    def _cut(self, text: str | None) -> list[str]:
        """Pieces in lower case if the tokenizer makes no difference: not in texts with a sigma, whose lower case the library
        takes without regard to its place, with a dotted I, which becomes two characters, or its dot, or with what may become a special token;
        nor in texts whose characters it composes, before lower case is taken or after."""
        if not text:
            return []
        low = text.lower() if self.lowers else text
        return PIECES(low if _composed(text, low) and not any(x in text for x in "Σİ\u0307") and not any(x in low for x in self.special) else text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text."""
        cut = list(map(self._cut, texts))
        found = [list(map(self.get, t)) for t in cut]
        holes = []
        for k, parts in enumerate(found):
            at = -1
            try:
                while True:
                    at = parts.index(None, at + 1)
                    holes.append((k, at))
            except ValueError:
                pass
        new = {cut[k][at] for k, at in holes}
        if len(self) + len(new) > self.limit:
            self.clear()
        ids = self._ids(list(new))
        for k, at in holes:
            found[k][at] = ids[cut[k][at]]
        self.update((p, x) for p, x in ids.items() if len(p) <= self.longest)  # longer ones are seen once, mostly
        return list(map(b"".join, found))


def pack(rows: list[tuple], dictionary_sha: bytes, width: int, tokens_before: int) -> bytes:
    """A volume of (doc_id or None, tokens, frame) rows."""
    ids = np.array([0 if r[0] is None else r[0] for r in rows], "<i8")
    known = np.array([r[0] is not None for r in rows], "u1")
    counts = np.array([r[1] for r in rows], "<u4")
    ends = np.cumsum([len(r[2]) for r in rows]).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, dictionary_sha, width, len(rows), tokens_before), ids.tobytes(), known.tobytes(), counts.tobytes(), ends.tobytes(), *(r[2] for r in rows)])


class Volume:
    """Reads a volume; ``ids(k)`` decompresses the k-th document only."""

    def __init__(self, content: bytes, dictionary: bytes):
        magic, sha, self.width, n, self.tokens_before = HEAD.unpack_from(content)
        if magic != MAGIC or sha != hashlib.sha256(dictionary).digest():
            raise ValueError("not a volume of this dictionary")
        at = HEAD.size
        doc = np.frombuffer(content, "<i8", n, at)
        known = np.frombuffer(content, "u1", n, at := at + 8 * n)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc, known, strict=True)]
        self.counts = np.frombuffer(content, "<u4", n, at := at + n).astype(np.int64)
        ends = np.frombuffer(content, "<u8", n, at := at + 4 * n).astype(np.int64)
        self._from, self._to = at + 8 * n + np.concatenate([[0], ends[:-1]]).astype(np.int64), at + 8 * n + ends
        self._content = content
        self._zip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        raw = self._zip.decompress(self._content[self._from[k] : self._to[k]], max_output_size=int(self.counts[k]) * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, sample_docs: int, dictionary_bytes: int, rows: int) -> bytes:
    """A dictionary from about ``sample_docs`` documents, chosen by a hash of the id.

    It decides the size of the files only, never what is read back. With too little to
    train on there is none (empty), and frames are then compressed without one.
    """
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11) / float(2**53)
    sample = docs.select("doc_id", "text").where(chance < sample_docs / max(rows, 1))

    def work(batches):
        t = _tokenizer(tokenizer_path, end_id)
        for b in batches:
            yield {"piece": t.encode(b["text"].to_pylist())}

    pieces = [bytes(r.piece) for r in map_batches(sample, "piece binary", work).collect()]
    try:
        return zstandard.train_dictionary(dictionary_bytes, sorted(pieces)).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int, sample_docs: int = 1500, dictionary_bytes: int = 65536, volume_bytes: int = 4 << 20, level: int = 3) -> None:
    """Encode every whole text (null: empty), end it with ``end_id``, and write the volumes.

    Documents lie in ascending doc_id order, null ids first, repeated ids in the order of their
    frames: within a range by doc_id, and the ranges by their number.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n, *_ = docs.agg(F.count("*")).first()
    ranges = int(min(10_000, max(48, n // 2000)))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    bounds = np.unique(np.array(bounds, dtype=np.int64))
    serial = np.dtype(_tokenizer(tokenizer_path, end_id).serial)
    width, end = serial.itemsize, np.array([end_id], serial).tobytes()
    dictionary = train_dictionary(docs, tokenizer_path, end_id, width, sample_docs, dictionary_bytes, n)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def encode(batches):
        t = _tokenizer(tokenizer_path, end_id)
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if d:
            d.precompute_compress(level=level)
        c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        for b in batches:
            ids = [x + end for x in t.encode(b["text"].to_pylist())]
            doc = b["doc_id"].fill_null(NO_ID).to_numpy()
            yield {"doc_id": b["doc_id"], "part": np.searchsorted(bounds, doc, "right"), "n": [len(x) // width for x in ids], "frame": [c.compress(x) for x in ids]}

    def bind(batches):
        sha, rows, held, part, before = hashlib.sha256(dictionary).digest(), [], 0, None, 0

        def volume():
            return {"part": [part], "before": [before], "first_doc": [rows[0][0]], "last_doc": [rows[-1][0]], "n_docs": [len(rows)], "n_tokens": [sum(r[1] for r in rows)], "content": [pack(rows, sha, width, before)]}

        for b in batches:
            for p, doc, n, frame in zip(b["part"].to_pylist(), b["doc_id"].to_pylist(), b["n"].to_pylist(), b["frame"].to_pylist(), strict=True):
                if rows and (p != part or held + len(frame) > volume_bytes):
                    yield volume()
                    before += sum(r[1] for r in rows)
                    rows, held = [], 0
                if p != part:
                    part, before = p, 0
                rows.append((doc, n, frame))
                held += len(frame)
        if rows:
            yield volume()

    frames = map_batches(docs.select("doc_id", "text"), "part int, doc_id long, n long, frame binary", encode)
    ordered = frames.repartition("part").sortWithinPartitions("part", "doc_id", F.xxhash64("frame"))
    map_batches(ordered, "part int, before long, first_doc long, last_doc long, n_docs long, n_tokens long, content binary", bind).write.option("compression", "none").parquet(f"{folder}/volumes")


def _dictionary(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first().dictionary)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every stored document."""
    dictionary = _dictionary(spark, folder)
    volumes = spark.read.parquet(f"{folder}/volumes")
    totals = {r.part: r.n for r in volumes.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # as many as ranges, 10,000 at most
    parts = sorted(totals)
    starts = dict(zip(parts, accumulate([0] + [totals[p] for p in parts]), strict=False))

    def work(batches):
        for b in batches:
            for part, content in zip(b["part"].to_pylist(), b["content"].to_pylist(), strict=True):
                v = Volume(content, dictionary)
                first = starts[part] + v.tokens_before + np.concatenate([[0], np.cumsum(v.counts)[:-1]])
                yield {"doc_id": v.doc_ids, "start": first.astype(np.int64), "n_tokens": v.counts, "ids_crc32": [zlib.crc32(v.ids(k).tobytes()) for k in range(len(v.doc_ids))]}

    return map_batches(volumes.select("part", "content"), "doc_id long, start long, n_tokens long, ids_crc32 long", work)


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[int]:
    """The ids of one document: one volume is read, one frame is decompressed."""
    dictionary = _dictionary(spark, folder)
    for r in spark.read.parquet(f"{folder}/volumes").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).select("content").toLocalIterator():
        v = Volume(bytes(r.content), dictionary)
        if doc_id in v.doc_ids:
            return v.ids(v.doc_ids.index(doc_id)).tolist()
    raise KeyError(doc_id)


def digest(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write to the shared folder and read back; no rows from an empty table."""
    folder = scratch(docs.sparkSession, "tokens")
    write(docs, folder, tokenizer_path, end_id=end_id)
    return read(docs.sparkSession, folder)
