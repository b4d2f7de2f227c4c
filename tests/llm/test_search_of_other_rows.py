"""Recall against brute force, of rows without near ones and of unlike lengths, in more than one lot of blocks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from harrier.llm import cross_polytope


def test_recall_of_other_rows(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(1000, 64)) * np.exp(draw.normal(0, 1.0, 1000))[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(1000), "embedding": list(x)}))
    got: dict[int, set] = {}
    for r in cross_polytope.search(df, F.col("vec_id") % 20 == 0, lot=5000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert np.mean([len(got[q] & set(np.argsort(-s[q])[:20])) / 20 for q in range(0, 1000, 20)]) >= 0.95


def test_depths_of_bands():
    """The band that misses most goes deeper, at last to all of its rows; the others don't."""
    first, bands = np.array([0] * 50 + [9] * 40 + [400] * 10), np.array([3] * 50 + [1] * 40 + [0] * 10)
    assert cross_polytope.depths(first, bands, [6, 12, 24]) == {0: -1, 1: 12}


def test_lists_are_short_before_they_are_joined(spark, monkeypatch):
    """A query's best of each lot meet in one list of k + 1 before any join, and find what longer lists would."""
    kept = {}

    def saved(df, name, inner=cross_polytope.saved):
        kept[name] = inner(df, name)
        return kept[name]

    monkeypatch.setattr(cross_polytope, "saved", saved)
    x = np.random.default_rng(2).normal(size=(1500, 32))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(1500), "embedding": list(x)}))
    got = {(r.query_id, r["rank"]): r.score for r in cross_polytope.search(df, F.col("vec_id") % 20 == 0, k=5, lot=500).collect()}
    lists = [r["count"] for r in kept["ann-pairs"].groupBy("q").count().collect()]
    assert len(lists) == 75 and max(lists) == 6
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert len(got) == 75 * 5 and np.mean([abs(v - np.sort(s[q])[-r]) < 1e-9 for (q, r), v in got.items()]) >= 0.95
