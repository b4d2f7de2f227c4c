"""The pipeline's stages on rows that are awkward: nulls, repeated ids, extra columns with clashing names, no rows."""

import datetime
import random
from collections import Counter

import pytest

import corpus_pipeline
from harrier.llm import decontaminate, suffix_dedup

WORDS = ["the", "house", "under", "water", "which", "never", "light", "garden", "stone", "about", "after", "through", "people", "morning"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected string, of timestamp, tags array<string>, n_tokens string, id int, node string, `a b` map<string,int>"


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ing", "ly"]) + str(r.randrange(30)) for _ in range(n))


def rows_of(pairs):
    when = datetime.datetime(2020, 1, 2, 3, 4, 5)
    return [(i, t, "en", "s", None, 0.5, "r", when, ["x", None], "t", 7, "n", {"k": 1}) for i, t in pairs]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    pairs = [(i, prose(i)) for i in range(60)] + [(None, prose(100)), (None, prose(101)), (5, prose(102)), (None, None), (70, None), (71, ""), (72, " 12 !"), (73, prose(3)), (74, prose(4) + " end"), (74, prose(4) + " end")]
    pairs += [(80, prose(200) + " " + BENCH), (80, prose(201)), (None, BENCH + " " + prose(202))]
    spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, BENCH), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


BENCH = prose(999, 40)


def test_each_stage_keeps_columns_and_clean_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = Counter((r.doc_id, r.text) for r in docs.collect())
    want = [
        {k: n for k, n in given.items() if k[1] and any(c.isalpha() for c in k[1])},
        {k: 1 for k in given if k[1] and any(c.isalpha() for c in k[1]) and k not in {(73, prose(3)), (74, prose(4) + " end")}},
    ]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, sf).persist()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = Counter((r.doc_id, r.text) for r in out.collect())
        if k < 2:
            assert got == want[k], name
        else:
            assert sum(got.values()) == docs.count() - 2 * (name == "decontaminate"), name
        if name == "decontaminate":  # of id 80 and of the rows without an id only those with the passage go
            assert (80, prose(201)) in got and (None, prose(100)) in got and not any(t and BENCH in t for _, t in got)
        docs = docs if name == "suffix_dedup" else out  # which would remove the passage of both rows
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert set(last.columns) == set(docs.columns) - {"text"} | {"n_tokens", "ids_sha256", "decoded_sha256"} and last.count() == docs.count()


def test_stages_of_no_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []
        docs = docs if "text" in docs.columns else None


def test_no_benchmark_and_no_repeats(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    nothing = spark.read.parquet(f"{sf}/benchmark.parquet").limit(0)
    assert decontaminate.clean(docs, nothing).count() == docs.count()
    same = suffix_dedup.without_repeats(docs.where("doc_id < 50 AND doc_id <> 5"))
    assert {r.doc_id: r.text for r in same.collect()} == {i: prose(i) for i in range(50) if i != 5}
