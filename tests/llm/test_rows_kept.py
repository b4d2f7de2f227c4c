"""Rows without an id of their own are kept like others."""

import random
from collections import Counter

from harrier.llm import minhash_dedup


def text(seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(150))


def test_ids_that_are_missing_or_repeated(spark):
    near = text(5) + " end"
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (7, text(4)), (7, text(5)), (8, near), (9, text(6)), (9, near), (9, None), (None, near + " more")]
    # of text 5 and its variants, that without an id stays
    want = Counter([(None, text(1)), (None, text(2)), (None, text(3)), (None, near + " more"), (7, text(4)), (9, text(6)), (9, None)])
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept_id string")
    got = minhash_dedup.keep_one(docs)
    assert got.columns == docs.columns and Counter((r.doc_id, r.text) for r in got.collect()) == want
