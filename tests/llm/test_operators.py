"""Each operator on awkward rows, and against a plain version of itself."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from harrier.llm import byte_bpe, cross_polytope, decontaminate, language_id, log_bilinear, minhash_dedup, quality_fm, sharding, suffix_dedup, suffix_sort, token_files
from harrier.llm.common import scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long, dirty_id string, kept_id int, size string"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = [a + b + c for a in ("ba", "de", "ki", "lo", "mu") for b in ("ra", "ten", "si", "po") for c in ("n", "ble", "", "st", "lia")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, texts):
    """Rows with columns whose names clash with those that operators use inside."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1, "y") if not isinstance(i, tuple) else i for i, t in texts]
    return spark.createDataFrame(rows, DOC).repartition(3)


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "été 日本 😀 \x1c"), (4, "été 日本 😀 \x1c"), (None, "a null id"), (6, "!!! 123"), (7, "x" * 5000), (8, prose(1, 4000))]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, AWKWARD).persist()


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.limit(0)


OPERATORS = {
    "sharding": lambda d: sharding.digest(d),
    "byte_bpe": lambda d: byte_bpe.round_trip(d, RANKS, PATTERN),
    "token_files": lambda d: token_files.digest(d, public_tokenizers.path("word_bpe_49k.json")),
    "language_id": lambda d: language_id.predict(d, language_id.train(d)),
    "quality_fm": lambda d: quality_fm.score(d, quality_fm.train(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))),
    "log_bilinear": lambda d: log_bilinear.digest(d),
    "suffix_dedup": lambda d: suffix_dedup.remove_repeats(d),
    "minhash_dedup": lambda d: minhash_dedup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_awkward_row(name, awkward, nothing):
    assert Counter(r.doc_id for r in OPERATORS[name](awkward).collect()) == Counter(i for i, _ in AWKWARD)
    assert OPERATORS[name](nothing).collect() == []


def test_bpe_is_that_of_the_library(spark, awkward):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ["aaaa" * 300, " " * 999 + "x", "don't we'll 12345 $$$\r\n\t", "ß½Ⅷ x² ​ \x85 \x1c", prose(3, 200), "\U0001f600" * 40]:
        assert list(byte_bpe.codec(RANKS, PATTERN).encode(t)) == library.encode_ordinary(t)
    back = {(r.doc_id, bytes(r.content)) for r in byte_bpe.decode(byte_bpe.encode(awkward, RANKS, PATTERN), RANKS, PATTERN).collect()}
    assert back == {(i, (t or "").encode()) for i, t in AWKWARD}


def test_pieces_merged_side_by_side_are_those_merged_alone():
    ranks, draw = byte_bpe.load_ranks(RANKS), np.random.default_rng(4)
    pieces = list({"".join(draw.choice(list("aabcé汉 1"), draw.integers(1, 65))) for _ in range(600)})
    learned = byte_bpe.Pieces(ranks, limit=200)
    for lo in range(0, len(pieces), 150):  # forgets in between
        learned.learn(set(pieces[lo : lo + 150]))
        for x in pieces[lo : lo + 150]:
            assert tuple(np.frombuffer(learned[x], "<u4").tolist()) == byte_bpe.merge_piece(x.encode(), ranks)


def test_token_files_hold_the_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, prose(i, 50)) for i in range(40)]
    folder = scratch(spark, "test")
    token_files.write(docs(spark, rows), folder, path, end_id=1, volume_bytes=500)
    library, at = Tokenizer.from_file(path), 0
    for r in token_files.read(spark, folder).orderBy("doc_id").collect():
        ids = [*library.encode(rows[r.doc_id][1], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_document(spark, folder, 39) == ids


def test_suffixes_in_order():
    r = np.random.default_rng(0)
    for i in range(300):
        t = r.integers(0, r.integers(1, 5), r.integers(1, 60))
        if i % 7 == 0:
            t = np.tile(t[:12], 6)
        # with little memory everything goes to disk and the names are sorted by recursion
        sa, lcp = suffix_sort.suffix_array(t, 20, memory=(10**6, 10, 3, 1)[i % 4])
        want = sorted(range(len(t)), key=lambda k: list(t[k:]))
        assert list(sa) == want
        for a, b, n in zip(want, want[1:], lcp[1:], strict=False):
            k = 0
            while k < 20 and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert n == k


def test_a_long_string_goes_to_disk(monkeypatch):
    spills, depth = [], []
    spill, sort = suffix_sort.BucketQueues.spill, suffix_sort.suffix_array
    monkeypatch.setattr(suffix_sort.BucketQueues, "spill", lambda self: (spills.append(self.held), spill(self)))
    monkeypatch.setattr(suffix_sort, "suffix_array", lambda *a, **k: (depth.append(len(a[0])), sort(*a, **k))[1])
    t = np.random.default_rng(3).integers(0, 3, 30_000)
    sa, lcp = suffix_sort.suffix_array(t, 200, memory=500)
    assert isinstance(sa, np.memmap) and len(spills) > 20 and len(depth) >= 3
    want, same = sort(t, 200)
    assert (sa == want).all() and (lcp == same).all()


@pytest.mark.parametrize("sizes", [{}, {"crowd": 1}, {"crowd": 1, "memory": 50}, {"memory": 100, "shard_bytes": 1 << 30}], ids=str)
def test_repeats_against_all_windows(spark, sizes):
    passage = prose(100, 60)
    texts = [prose(i, 80) + " " + passage[i : 300 + i] + " " + prose(50 + i, 40) for i in range(5)] + ["ab" * 150, passage, passage, "é" * 150, None, prose(7, 90) * 3]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + 200] for t in raw for k in range(len(t) - 199))
    for r in suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts))), **sizes).collect():
        t = raw[r.doc_id]
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        assert (r.n_removed, r.kept_sha256, r.n_spans) == (gone.sum(), hashlib.sha256(kept).hexdigest(), int((gone[1:] < gone[:-1]).sum()))


def test_texts_stay_texts_without_repeats(spark):
    text = "é" * 150 + prose(1, 20)
    got = suffix_dedup.without_repeats(docs(spark, [(1, text), (2, "x" + text), (3, None), (4, "short")])).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4} and next(r for r in got if r.doc_id == 3).text is None and next(r for r in got if r.doc_id == 4).n_chars == 5


def test_near_copies_are_one_class(spark):
    base = [prose(i, 150) for i in range(12)]
    near = [b.replace(" ", " zzz ", 1) for b in base[:4]]
    rows = [*enumerate(base), *enumerate(near, 20), *enumerate(base[:2], 40)]
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    for i, _ in rows:
        assert got[i].class_id == (i if i < 20 else i % 20) and got[i].kept == (i < 20)
    assert got[0].copies == 2 and got[0].links == 1
    assert minhash_dedup.keep_one(docs(spark, rows)).count() == 12


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7)], "a long, b long")
    got = {r.id: r.root for r in minhash_dedup.components(links, "test").collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 150: 100, 200: 100}


def test_decontamination(spark):
    items = [prose(1000 + i, 30) for i in range(4)]
    bench = spark.createDataFrame([*enumerate(items), (9, items[0]), (10, None), (11, ""), (12, "two words")], "item_id long, text string")
    words = items[1].split()
    words[7] = words[20] = "other"
    rows = [(1, prose(1, 50) + " " + items[0].upper() + ". " + prose(2, 20)), (2, prose(3, 10) + " " + " ".join(words)), (3, prose(4, 300)), (3, prose(4, 300)), (4, None), (5, ""), (None, items[2]), (6, "two words")]
    d = docs(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(d, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (None, 2)} and got[2, 1].matched == 28 and got[1, 0].doc_from == 50
    assert Counter(r.doc_id for r in decontaminate.clean(d, bench).collect()) == Counter([3, 3, 4, 5, 6])
    assert decontaminate.find(d.limit(0), bench).isEmpty() and decontaminate.find(d, bench.limit(0)).isEmpty()


def test_neighbours(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(400, 16))
    v[10:30] = v[10]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0] * 3)]
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)] + odd, "vec_id long, embedding array<double>")
    got = {}
    for x in cross_polytope.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    hits = 0
    for q in range(0, 400, 20):
        s = v @ v[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        assert [x[0] for x in sorted(got[q])] == list(range(1, 21)) and all(math.isclose(x[2], s[x[1]], abs_tol=1e-9) for x in got[q])
        hits += len({x[1] for x in got[q]} & set(want))
    assert hits >= 0.9 * 400 and [x[1] for x in sorted(got[20])][:19] == [i for i in range(10, 30) if i != 20]
    few = cross_polytope.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert {x.vec_id for x in few} == {1, 2} and cross_polytope.search(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_language_model_against_counts(spark):
    rows = [(i, prose(i % 9, 30) + f" only{i}") for i in range(60)] + [(99, None)]
    d = docs(spark, rows)
    found = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for t, o in zip(found, out, strict=True) if not o for w in t)
    n, v = sum(c.values()), len(c)
    for known in (1_000_000, 5):
        got = {r.doc_id: r for r in log_bilinear.score(d, d.where(F.crc32(F.col("doc_id").cast("string")) % 7 != 2), known_words=known).collect()}
        for (i, _), t in zip(rows, found, strict=True):
            assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(c[w] > 0 for w in t), n) and got[i].score < 0


def test_model_is_normalised():
    counts = np.random.default_rng(1).integers(1, 500, 300).astype(float)
    m = log_bilinear.LogBilinear(counts)
    m.train(np.random.default_rng(0).integers(0, 300, (3000, 3)), np.ones(3000), batch=500)
    s = np.arange(300)
    for a, b in ((3, 5), (300, 300)):
        assert math.isclose(np.exp(m.log_probabilities(np.full(300, a), np.full(300, b), s)).sum(), 1, rel_tol=1e-4)
    assert m.begin[:5].tolist() == [0, 1, 6, 15, 28] and (m.group[m.rank[np.argsort(-counts)[:3]]] == [0, 1, 1]).all()


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(log_bilinear, "PART_TOKENS", 700)
    rows = [(i, prose(i % 40, 30 + i % 9) + " rare%d" % i) for i in range(150)] + [(200, None), (200, "twice"), (200, "twice")]
    d = docs(spark, rows)
    got = [sorted((r.doc_id, r.n_tokens, r.score) for r in log_bilinear.score(d.repartition(n), d.where("doc_id % 3 > 0").repartition(n), min_count=5).collect()) for n in (2, 7)]
    assert len(got[0]) == 153 and all(x[:2] == y[:2] and math.isclose(x[2], y[2], abs_tol=1e-9) for x, y in zip(*got, strict=True))


def test_model_learns_what_follows(spark):
    """Better than the counts on texts of a fixed order of words."""
    line = " ".join(WORDS[i * 7 % 60] for i in range(60))
    d = docs(spark, [(i, line[len(WORDS[0]) * (i % 5) :]) for i in range(400)])
    r = log_bilinear.score(d.where("doc_id < 5"), d).agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.75 * r[1]


def test_languages(spark):
    de, en = ["der", "die", "und", "nicht", "über", "straße"], ["the", "and", "with", "house", "thing"]
    mk = lambda ws, s: " ".join(random.Random(s).choices(ws, k=60))
    df = spark.createDataFrame([(i, mk(de, i), "de") for i in range(40)] + [(100 + i, mk(en, i), "en") for i in range(40)] + [(500, "x", None)], "doc_id long, text string, lang string")
    models = language_id.train(df)
    got = {r.doc_id: r for r in language_id.predict(df, models).collect()}
    assert all(got[i].lang_pred == "de" and got[100 + i].lang_pred == "en" and not got[i].rejected for i in range(40))
    p = models.predict(["", None, "123 !?", "Ξενοφών ζητεί " * 20])
    assert [x[0] for x in p[:3]] == ["und"] * 3 and all(x[4] for x in p)
    g = models.models["de"]
    keys = (np.uint64(1 << 48 | 1 << 32 | 1 << 16) | g.grams[0][0]).astype(np.uint64)
    assert np.exp(g.log(keys)).sum() < 1.0001


def test_shards_are_even(spark):
    rows = [(i, prose(i, 5 + i % 60)) for i in range(900)] + [(2000 + i, prose(5, 30)) for i in range(450)]
    got = sharding.shard_by_bytes(docs(spark, rows), 24).collect()
    size, slots = Counter(), {}
    for r in got:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 1350 and set(size) == set(range(24)) and max(size.values()) - min(size.values()) < 0.1 * sum(size.values()) / 24 + 1000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_quality_is_learned(spark):
    rows = [(i, prose(i, 40) if i % 2 else prose(i, 40).replace(" ", "### ")) for i in range(200)]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_fm.score(d, quality_fm.train(d, labels)).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) > 190 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_fm.score(d, None).collect()} == {0.5}
