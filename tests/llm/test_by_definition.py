"""Registered queries against the plain definitions of their methods."""

import math
import os
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrier.llm import decontaminate, language_id, quality_fm, queries, suffix_dedup, token_files
from harrier.llm.common import held_out, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_quality_is_the_sum_over_all_pairs(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality_fm.train(docs, labels.where(~held_out(3, 1)))
    got = {r.doc_id: r for r in queries.op3_quality_fm(spark, SF).collect()}
    rows = docs.select("doc_id", "text", "n_chars", held_out(3, 1).alias("held_out")).collect()
    assert len(got) == len(rows) and all(r.held_out == got[r.doc_id].held_out for r in rows)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:60]:
        at, x = model.scaled(*quality_fm.features(r.text, r.n_chars, quality_fm.Words()))
        margin = model.w0 + sum(model.w[i] * z for i, z in zip(at, x, strict=True))
        margin += sum(float(model.v[at[i]] @ model.v[at[j]]) * x[i] * x[j] for i, j in combinations(range(len(at)), 2))
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))
        assert abs(got[r.doc_id].score - p) < 1e-9 and got[r.doc_id].predicted == int(p >= 0.5)


class Plain:
    """Interpolated Kneser-Ney over strings, by its definition."""

    def __init__(self, words: Counter, alphabet: int):
        self.alphabet, self.tables = alphabet, {}
        counts = Counter()
        for w, n in words.items():
            s = "\1\1\1" + w + "\2"
            for i in range(3, len(s)):
                counts[s[i - 3 : i + 1]] += n
        for order in (4, 3, 2, 1):
            by = defaultdict(dict)
            for g, n in counts.items():
                by[g[:-1]][g[-1]] = n
            self.tables[order] = by
            counts = Counter(g[1:] for g in counts)  # the kinds of characters before

    def p(self, context: str, c: str) -> float:
        order = len(context) + 1
        lower = self.p(context[1:], c) if context else 1 / self.alphabet
        seen = self.tables[order].get(context)
        if not seen:
            return lower
        total = sum(seen.values())
        return max(seen.get(c, 0) - 0.75, 0) / total + 0.75 * len(seen) / total * lower

    def entropy(self, words: list[str]) -> float:
        logs = [math.log(self.p(s[i - 3 : i], s[i])) for w in words for s in ["\1\1\1" + w + "\2"] for i in range(3, len(s))]
        return -sum(logs) / len(logs)


def test_languages_are_those_of_plain_models(spark):
    docs = table(spark, SF, "documents")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(4)), 11) / float(2**53)
    rows = docs.select("doc_id", "text", "lang", held_out(4, 2).alias("out"), (draw < 0.1).alias("back")).collect()
    words = defaultdict(Counter)
    for r in rows:
        if r.lang is not None and r.text is not None and not r.out and not r.back:
            words[r.lang].update(language_id.LETTERS(r.text.lower()))
    alphabet = len(set().union(*(set("".join(w)) for w in words.values()))) + 2
    plain = {lang: Plain(w, alphabet) for lang, w in words.items()}
    got = {r.doc_id: r for r in queries.op4_language_id(spark, SF).collect()}
    models = language_id.train(docs.where(~held_out(4, 2)))
    tested = 0
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:60]:
        found = language_id.LETTERS((r.text or "").lower())
        assert got[r.doc_id].held_out == r.out
        if not found:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        h = {lang: m.entropy(found) for lang, m in plain.items()}
        best = min(h, key=lambda x: (h[x], x))
        assert got[r.doc_id].lang_pred == best and abs(models.predict([r.text])[0][2] - h[best]) < 1e-9
        tested += 1
    assert tested > 40


def test_every_language_is_learned(spark):
    rows = [(i, chr(97 + i % 20) * 4, f"l{i % 20}") for i in range(200)]
    models = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), total=120)
    assert sorted(models.langs) == sorted({lang for _, _, lang in rows})
    rows = [(i, chr(0x4E00 + i) * 3, f"l{i}") for i in range(40)]  # one document each
    models = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(models.langs) == sorted({lang for _, _, lang in rows})
    assert [p[0] for p in models.predict([r[1] for r in rows])] == [r[2] for r in rows]


def test_shards_are_cuts_of_one_order(spark):
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, SF, "documents").select(F.xxhash64(text).alias("h"), "doc_id", F.crc32(text).alias("crc"), (F.octet_length(text) + 8).alias("size")).collect()
    rows = sorted(map(tuple, rows))
    at = np.concatenate([[0], np.cumsum([r[3] for r in rows])]).tolist()
    total, cuts = at[-1], []
    for i in range(1, 24):
        aim = total * i // 24
        k = next(k for k in range(len(rows)) if at[k] <= aim < at[k + 1])
        same = [j for j, r in enumerate(rows) if r[0] == rows[k][0]]
        lo, hi = at[same[0]], at[same[-1] + 1]
        if hi - lo > 0.01 * total / 24:
            lo, hi = at[k], at[k + 1]
        cuts.append(lo if aim - lo <= hi - aim else hi)
    want, slots = [], Counter()
    for k, (_, doc, crc, size) in enumerate(rows):
        shard = sum(at[k] >= c for c in cuts)
        want.append((doc, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
    got = queries.op10_sharding(spark, SF).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_unlike_texts_of_one_polynomial_hash_keep_their_bytes(spark):
    end = "lrsnshkvaitvwfwkrssdwugusijdcpupclzcneajnyndbttybmwskriqhbjacdtrbgnjtiew"
    texts = [
        "k**k*kk**kk*k**k*kk*k**kk**k*kk*3BB3B33BB33B3BB3B33B3BB33BB3B33B)XX)X))XX))X)XX)X))X)XX))XX)X))X2??2?22??22?2??2?22?2??22??2?22?" + end,
        "*kk*k**kk**k*kk*k**k*kk**kk*k**kB33B3BB33BB3B33B3BB3B33BB33B3BB3X))X)XX))XX)X))X)XX)X))XX))X)XX)?22?2??22??2?22?2??2?22??22?2??2" + end,
    ]
    assert [len(t) for t in texts] == [200, 200]
    rows = spark.createDataFrame(list(enumerate([*texts, texts[0] + "!"])), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(rows).collect()}
    assert got == {0: 200, 1: 0, 2: 200}


def test_ids_of_all_marks_after_all_capitals(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), token_files._tokenizer(path, 1)
    marks = [chr(c) for c in range(0x300, 0x370)] + ["ͅ", "ٓ", "़", "゙", "᷄", "⃐", "ּ", ""]
    capitals = [chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x370, 0x400), *range(0x400, 0x460), *range(0x1E00, 0x2000)] if chr(c).isupper()]
    texts = [f"{a}{m}ek x{a.lower()}{m} {m}{a}" for a in capitals for m in marks]
    texts += ["J̌ek", "H̱alaf", "T̈a", "W̊", "Y̊", "Άͅ"]
    assert len(texts) > 40_000
    for k in range(0, len(texts), 4096):
        want = [e.ids for e in library.encode_batch(texts[k : k + 4096], add_special_tokens=False)]
        got = [np.frombuffer(x, mine.serial).tolist() for x in mine.encode(texts[k : k + 4096])]
        assert got == want


def test_a_copy_in_two_parts_is_in_the_sql_too(spark):
    import duckdb

    words = [f"w{i}" for i in range(100)]
    others = [f"x{i}" for i in range(60)]
    texts = [" ".join(words[:20] + others + words[80:]), " ".join(words[:12] + others), " ".join(words[:16] + others[:4] + words[20:30]), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.find(docs, items).collect()))
    documents, benchmark = docs.toPandas(), items.toPandas()  # noqa: F841  (DuckDB reads them by their names)
    assert got == sorted(duckdb.sql(decontaminate.oracle_sql()).fetchall())
    assert [g[:3] for g in got] == [(0, 7, 40), (2, 7, 26)]
