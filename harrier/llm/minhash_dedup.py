"""Near-duplicates by weighted MinHash: improved consistent weighted sampling.

A text is the bag of its runs of five words (lower-cased runs of letters and digits). A run's weight is
its count in the text times a smoothed inverse document frequency. Document frequencies are counted over
all rows in a sketch of fixed size; what other runs add to a cell on average is taken off, and runs
in fewer than one of ``RARE`` texts weigh alike, so that weights don't fade as the corpus grows. Each of
``BANDS * ROWS`` samples draws one run of a text with a chance in proportion to its
weight, consistently between texts, so that two texts have equal samples with a chance of their
weighted Jaccard similarity. Texts that share a band of samples (a bucket) are candidates, and candidates'
similarity is computed from their whole texts.

Classes need links that span them, not all pairs. Exact copies are one node. A bucket's texts are first compared
with one head, that one of them which shares most buckets with others (the text that the others vary). What a bucket has outside
its largest class then is compared with all its texts of other classes, in blocks: a block keeps its own record of what
it united and hands on the links that unite only, fewer than it has texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, map_batches, saved, short_batches

WORDS, BANDS, ROWS = 5, 16, 4
SAMPLES = BANDS * ROWS
#: Cells of the hashed document frequencies, and of the table of random numbers.
CELLS, DRAWS = 1 << 20, 1 << 14
#: Runs in fewer than one of so many texts weigh most.
RARE = 1000
#: Characters of the texts that one piece of a bucket compares with others.
BLOCK_CHARS = 4 << 20
TOKENS = re.compile(r"[^\W_]+").findall


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode())
        return h


_words = Hashes()


def all_runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' runs of words, in order, and where each text's begin and the last one's end.

    A text of fewer words is one run, one without any has none.
    """
    found = [TOKENS((t or "").lower()) for t in texts]
    lens = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(map(_words.__getitem__, chain.from_iterable(found)), np.uint64, int(lens.sum()))
    begin = np.concatenate([[0], np.cumsum(lens)])
    n = np.minimum(lens, np.maximum(lens - WORDS + 1, 1))  # runs of each text
    at = np.arange(int(n.sum())) + np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    padded = np.concatenate([flat, np.zeros(WORDS, np.uint64)])
    out = np.zeros(len(flat), np.uint64)
    for k in range(WORDS):
        out = (out ^ padded[k : len(flat) + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out = out[at]
    first = np.concatenate([[0], np.cumsum(n)])
    for i in np.flatnonzero((lens > 0) & (lens < WORDS)).tolist():
        h = 0
        for x in flat[begin[i] : begin[i + 1]].tolist():
            h = (h ^ x) * 0x9E3779B97F4A7C15 % (1 << 64)
            h ^= h >> 29
        out[first[i]] = h
    return out, first


def runs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct runs of words and their counts."""
    return np.unique(all_runs([text])[0], return_counts=True)


def document_frequencies(docs: DataFrame, groups: int = 32, pieces: int = 16) -> np.ndarray:
    """How many rows have a run of each cell; every row is counted, copies in a batch are read once."""
    step = CELLS // pieces

    def count(batches):
        df = np.zeros(CELLS, np.int64)
        for b in batches:
            times = Counter(b["text"].to_pylist())
            found, first = all_runs(list(times))
            of = np.repeat(np.arange(len(times)), np.diff(first))
            once = np.unique(of * CELLS + (found % np.uint64(CELLS)).astype(np.int64))  # a cell that comes twice in a text is counted once
            df += np.bincount(once % CELLS, np.fromiter(times.values(), float)[once // CELLS], CELLS).astype(np.int64)
        if df.any():
            group = TaskContext.get().partitionId() % groups
            yield {"group": [group] * pieces, "piece": list(range(pieces)), "df": [df[i * step : (i + 1) * step].astype("<i8").tobytes() for i in range(pieces)]}

    def add(*key):
        def summed(batches):
            sums: dict[tuple, np.ndarray] = {}
            for b in batches:
                for *k, x in zip(*[b[c].to_pylist() for c in key], b["df"].to_pylist(), strict=True):
                    sums[tuple(k)] = sums.get(tuple(k), 0) + np.frombuffer(x, "<i8")
            if sums:
                yield {"group": [k[0] if len(k) > 1 else 0 for k in sums], "piece": [k[-1] for k in sums], "df": [x.tobytes() for x in sums.values()]}

        return summed

    schema = "group int, piece int, df binary"
    counted = map_batches(docs.select("text"), schema, count)
    counted = map_batches(counted.repartition(groups * 2, "group", "piece"), schema, add("group", "piece"))
    out = np.zeros(CELLS, np.int64)
    for r in map_batches(counted.repartition(pieces, "piece"), schema, add("piece")).toLocalIterator():  # the cells, whatever the rows
        out[r.piece * step : (r.piece + 1) * step] += np.frombuffer(bytes(r.df), "<i8")
    return out


class Sampler:
    """Draws the samples; its random numbers are the same on every worker."""

    def __init__(self, df: np.ndarray, n: int, seed: int = 23):
        self.seed = seed
        # smoothed: between 1 (in all texts) and 1.5 (in one of RARE or fewer)
        own = np.maximum(df - df.sum() / CELLS, 1)
        self.idf = (1 + 0.5 * np.clip(np.log(max(n, 1) / own) / np.log(min(max(n, 2), RARE)), 0, 1)).astype(np.float32)
        self._make()

    def _make(self) -> None:
        draw = np.random.default_rng(self.seed)
        u = lambda: 1 - draw.random((DRAWS, SAMPLES))
        r = -np.log(u() * u())  # Gamma(2, 1)
        c = -np.log(u() * u())
        beta = u()
        self.table = np.concatenate([1 / r, beta, r, np.log(c)], axis=1).astype(np.float32)  # a run's numbers lie together
        self.mix = draw.integers(1, 2**63, SAMPLES, dtype=np.uint64) | np.uint64(1)

    def __getstate__(self):
        return {"seed": self.seed, "idf": self.idf}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._make()

    def _weigh(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.unique(found, return_counts=True)
        return keys, counts * self.idf[(keys % np.uint64(CELLS)).astype(np.int64)]

    def weights(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """A text's distinct runs in order, and their weights."""
        return self._weigh(all_runs([text])[0])

    def samples(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """32 bits of each of a text's samples: which run was drawn, and at which level of its weight."""
        found, first = all_runs(texts)
        return [self._sample(*self._weigh(found[lo:hi])) if hi > lo else None for lo, hi in zip(first[:-1], first[1:], strict=True)]

    def _sample(self, keys: np.ndarray, w: np.ndarray) -> np.ndarray:
        best, at, level = None, None, None
        log_w = np.log(w).astype(np.float32)
        cells = (keys >> np.uint64(40)).astype(np.int64) % DRAWS
        column = np.arange(SAMPLES)
        for lo in range(0, len(keys), 128):  # few enough to stay in a core's cache
            t, beta, r, log_c = self.table[cells[lo : lo + 128]].reshape(-1, 4, SAMPLES).transpose(1, 0, 2)
            t *= log_w[lo : lo + 128, None]
            t += beta
            np.floor(t, out=t)
            np.subtract(t, beta, out=beta)
            beta += 1
            beta *= r
            log_a = np.subtract(log_c, beta, out=log_c)
            i = log_a.argmin(axis=0)
            a, lev = log_a[i, column], t[i, column]
            if best is None:
                best, at, level = a, lo + i, lev
            else:
                less = a < best
                best, at, level = np.where(less, a, best), np.where(less, lo + i, at), np.where(less, lev, level)
        x = (keys[at] ^ level.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * self.mix
        return (x >> np.uint64(32)).astype("<u4")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two texts' weighted runs."""
    (ka, wa), (kb, wb) = a, b
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum(dtype=float)
    all_ = wa.sum(dtype=float) + wb.sum(dtype=float) - both
    return both / all_ if all_ else 0.0


def bands(samples: np.ndarray) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(bytes([k]) + samples[k * ROWS : (k + 1) * ROWS].tobytes(), digest_size=8).digest(), "little", signed=True) for k in range(BANDS)]


def components(links: DataFrame, name: str) -> DataFrame:
    """id, root (the smallest id of the component) of every id of the links (a, b).

    Large-star and small-star steps in turn, until the links stay as they are; each step's links
    are written to the shared folder.
    """
    links = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        if mark == state:
            return links.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
        state = mark
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        links = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        links = links.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        links = saved(links, name)


def _verified(pairs: DataFrame, texts: DataFrame, held, threshold: float, name: str) -> DataFrame:
    """The pairs (node, head) that are similar enough, from their whole texts, as links (a, b).

    A head may have any number of pairs: its text is copied once for every ``share`` of them.
    """
    share = 500
    parts = pairs.groupBy("head").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    left = pairs.join(parts, "head").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(texts, "node")
    right = parts.join(texts.select(F.col("node").alias("head"), F.col("text").alias("head_text")), "head")
    right = right.select("head", "head_text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def work(batches):
        s = held.value
        known: dict[int, tuple] = {}
        for b in batches:
            sim = []
            for h, x, y in zip(b["head"].to_pylist(), b["head_text"].to_pylist(), b["text"].to_pylist(), strict=True):
                if h not in known:
                    known = {h: s.weights(x)}  # rows come in the order of their heads
                sim.append(similarity(known[h], s.weights(y)))
            keep = pa.array([x >= threshold for x in sim])
            yield {"a": b["node"].filter(keep), "b": b["head"].filter(keep)}

    return saved(map_batches(left.join(right, ["head", "part"]).select("node", "head", "text", "head_text"), "a long, b long", work), name)


class Block:
    """Texts as weighted runs, numbered among themselves, and the classes that they are united in."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], roots: np.ndarray):
        self.size = np.array([len(k) for k, _ in vectors])
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        _, self.run = np.unique(np.concatenate([k for k, _ in vectors]), return_inverse=True)
        self.weight = np.concatenate([w for _, w in vectors]).astype(float)
        self.total = np.add.reduceat(self.weight, self.start)
        self.own = np.zeros(int(self.run.max()) + 1)
        _, self.cls = np.unique(roots, return_inverse=True)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Weighted Jaccard of text i with each of the others."""
        mine = slice(self.start[i], self.start[i] + self.size[i])
        self.own[self.run[mine]] = self.weight[mine]
        n = self.size[others]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        at = np.arange(int(n.sum())) + np.repeat(self.start[others] - begin, n)
        both = np.add.reduceat(np.minimum(self.weight[at], self.own[self.run[at]]), begin)
        self.own[self.run[mine]] = 0
        return both / (self.total[i] + self.total[others] - both)

    def unite(self, i: int, others: np.ndarray) -> np.ndarray:
        """Joins the classes of i and of the others; those of them that joined something new."""
        cls, first = np.unique(self.cls[others], return_index=True)
        new = others[first[cls != self.cls[i]]]
        self.cls[np.isin(self.cls, self.cls[new])] = self.cls[i]
        return new


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, alike: float = 0.5, block: int = 1024) -> DataFrame:
    """The class of every row: rows are of one class if a chain of links of ``threshold`` or more joins them.

    Returns doc_id, class_id (the smallest doc_id of the class), copies (rows of the same text), links (those of the links that
    span its class which its text has), kept (true for one row of each class, with its smallest doc_id).
    Rows of equal texts are of one class. Null texts, and texts without a letter or digit, are alone
    unless equal; null ids count as the smallest. A repeated row is kept once.

    ``alike``: share of equal samples below which a pair that has no head isn't verified; a pair at ``threshold`` has fewer
    than half of 64 with a chance of 1e-8. ``block``: rows that are compared with each other in one piece.
    """
    return _classes(docs, threshold, alike, block).drop("id", "node")


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, size, root, minor of buckets with more than one class; minor: not of the bucket's largest class."""
    rows = shared.join(roots.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    classes = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "size", "root")).alias("most")
    buckets = classes.groupBy("key").agg(most, F.sum("n").alias("n"), F.sum("size").alias("all")).where(F.col("n") > F.col("most.n"))
    buckets = buckets.select("key", F.col("most.root").alias("major"), (F.col("n") - F.col("most.n")).alias("minors"), (F.col("all") - F.col("most.size")).alias("minor_size"))
    return rows.join(buckets, "key").select("key", "node", "size", "root", (F.col("root") != F.col("major")).alias("minor"), "minors", "minor_size")


def _classes(docs: DataFrame, threshold: float = 0.8, alike: float = 0.5, block: int = 1024) -> DataFrame:
    """``near_duplicates`` with the keys of each row: id, never null, and node, the text's hash."""
    spark = docs.sparkSession
    short_batches(spark)
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))
    nodes = saved(keyed.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "mh-nodes")
    n = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    sampler = Sampler(document_frequencies(docs), n)
    held = spark.sparkContext.broadcast(sampler)  # a fixed number of cells

    def sign(batches):
        s, done = held.value, set()
        for b in batches:
            new = []
            for i, node in enumerate(b["node"].to_pylist()):
                if node not in done:  # a task signs each text once
                    done.add(node)
                    new.append(i)
            if not new:
                continue
            b = {c: x.take(pa.array(new)) for c, x in b.items()}
            texts = b["text"].to_pylist()
            got = s.samples(texts)
            keep = [i for i, x in enumerate(got) if x is not None]
            yield {"node": b["node"].take(pa.array(keep, pa.int64())), "size": [len(texts[i]) for i in keep], "sig": [got[i].tobytes() for i in keep], "keys": [bands(got[i]) for i in keep]}

    signed = map_batches(keyed.select("text", "node"), "node long, size long, sig binary, keys array<long>", sign)
    signed = saved(signed.dropDuplicates(["node"]), "mh-signatures")
    members = signed.select("node", "size", F.explode("keys").alias("key"))
    full = members.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1")
    shared = saved(members.join(full, "key"), "mh-shared")
    # the text that others are variants of has most neighbours over all bands: it heads its buckets
    neighbours = saved(shared.groupBy("node").agg(F.sum("texts").alias("neighbours")), "mh-neighbours")
    ranked = shared.select("key", "node").join(neighbours, "node")
    lead = F.max_by("node", F.struct("neighbours", "node")).alias("head")
    pairs = ranked.join(ranked.groupBy("key").agg(lead), "key").where("node <> head").select("node", "head").distinct()
    # one row of each text that shares a bucket
    wanted = nodes.join(neighbours.select("node"), "node").select("node", F.col("first").alias("id"))
    texts = keyed.select("node", "id", "text").join(wanted, ["node", "id"], "left_semi")
    texts = saved(texts.groupBy("node").agg(F.first("text").alias("text")), "mh-texts")
    links = _verified(saved(pairs, "mh-pairs"), texts, held, threshold, "mh-links")
    roots = components(links, "mh-components")
    rows = saved(_open(shared, roots), "mh-open")
    # buckets of many small classes get other heads for as long as that unites them
    left = rows.where(F.col("minor") & (F.col("minors") > block)).count()
    while left:
        few = rows.where(F.col("minor") & (F.col("minors") > block)).join(neighbours, "node").groupBy("key").agg(lead)
        more = rows.join(few, "key").join(roots.select(F.col("id").alias("head"), F.col("root").alias("head_root")), "head", "left")
        more = more.where(F.col("root") != F.coalesce("head_root", "head")).select("node", "head").distinct()
        links = links.unionByName(_verified(saved(more, "mh-pairs"), texts, held, threshold, "mh-links"))
        roots = components(links, "mh-components")
        rows = saved(_open(shared, roots), "mh-open")
        before, left = left, rows.where(F.col("minor") & (F.col("minors") > block)).count()
        if left > 0.9 * before:
            break

    # each row goes to every block of its bucket's minor rows
    dealt = rows.withColumn("blocks", F.ceil(F.greatest(F.col("minors") / block, F.col("minor_size") / BLOCK_CHARS)).cast("int"))
    dealt = dealt.withColumn("mine", F.when(F.col("minor"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "part", "node", "size", "root", F.coalesce(F.col("mine") == F.col("part"), F.lit(False)).alias("asks"))
    pieces = dealt.groupBy("key", "part").agg(F.ceil(F.greatest(F.count("*") / (4 * block), F.sum("size") / (4 * BLOCK_CHARS))).cast("int").alias("cut"))
    # a block's asking rows meet its other rows in pieces of about four blocks
    dealt = dealt.join(pieces, ["key", "part"]).withColumn("cuts", F.when(F.col("asks"), F.sequence(F.lit(0), F.col("cut") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(1)), F.col("cut")).cast("int"))))
    dealt = saved(dealt.select("key", "part", F.explode("cuts").alias("cut"), "node", "size", "root", "asks"), "mh-dealt")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Links that unite classes, from a lot of pieces."""
        s, out = held.value, []
        rows = rows.sort_values(["key", "part", "cut", "node"], ignore_index=True)
        vectors = {}
        for node, text in zip(rows.node, rows.text, strict=True):
            if node not in vectors:
                vectors[node] = s.weights(text)
        for _, piece in rows.groupby(["key", "part", "cut"]):
            node, asks, sig = piece.node.to_numpy(), piece.asks.to_numpy(), np.stack([np.frombuffer(x, "<u4") for x in piece.sig])
            b = Block([vectors[x] for x in node], piece.root.to_numpy())
            for i in np.flatnonzero(asks):
                at = np.flatnonzero((b.cls != b.cls[i]) & (~asks | (node < node[i])))
                at = at[(sig[at] == sig[i]).sum(axis=1) >= alike * SAMPLES]
                if len(at):
                    at = at[b.similar(i, at) >= threshold]
                    out += [(node[i], node[j]) for j in b.unite(i, at)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64").drop_duplicates()

    content = dealt.join(texts, "node").join(signed.select("node", "sig"), "node")
    volume = dealt.agg(F.sum(F.col("size") + 400)).first()[0]
    if volume:
        lots = max(1, volume // BLOCK_CHARS)
        lot = F.pmod(F.xxhash64("key", "part", "cut"), F.lit(lots)).alias("lot")
        more = content.select(lot, "key", "part", "cut", "node", "root", "asks", "sig", "text").groupBy("lot").applyInPandas(compare, "a long, b long")
        links = links.unionByName(saved(more, "mh-links"))
        roots = components(links, "mh-components")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    owned = nodes.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = owned.groupBy("root").agg(F.min(F.struct("first", "node")).alias("least"))
    owned = owned.join(smallest, "root").join(degree, "node", "left").select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.col("least.first").alias("class_first"), F.col("least.node").alias("class_node"))
    out = keyed.select("doc_id", "id", "node").join(saved(owned, "mh-classes"), "node")
    return out.select("doc_id", "id", "node", F.when(F.col("class_first") != NO_ID, F.col("class_first")).alias("class_id"), "copies", "links", ((F.col("node") == F.col("class_node")) & (F.col("id") == F.col("class_first"))).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of ``docs``. An id, or none, may stand at several
    texts: a row is known by its id and text together."""
    kept = _classes(docs).where("kept").select(F.col("id").alias("_mh_id"), F.col("node").alias("_mh_node")).distinct()
    rows = docs.withColumns({"_mh_id": F.coalesce("doc_id", F.lit(NO_ID)), "_mh_node": F.xxhash64(F.coalesce("text", F.lit("")))})
    return rows.join(kept, ["_mh_id", "_mh_node"], "left_semi").dropDuplicates(["_mh_id", "_mh_node"]).select(*docs.columns)
