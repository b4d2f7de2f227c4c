"""Token files' ids against the library, on texts rich in what could tell them apart."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from harrier.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "\u212a", "\u212b", "A\u030a", "I\u0307", "<|", "|>", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "​", "\xa0", " ", "é", "é", "́", ".", ",", "'s", "'t", "'", "'re", "Σ", "ΑΣ", "ß", "İ", "ﬁ", "½", "²", "Ⅷ", "123", "日本", "😀", "a", "The", "word", "!", "?", "$", "#", "*", "&", "%", "<", "=", "̸", "하", "क़", "_", "-", '"', "﻿", "x" * 70]


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    library, draw = Tokenizer.from_file(PATH), random.Random(5)
    words = token_files._tokenizer(PATH, 1)
    plain = token_files.Words(words.tokenizer, 1, limit=300)  # forgets all the time
    for _ in range(12):
        texts = ["".join(draw.choice(ODD) for _ in range(draw.randrange(25))) for _ in range(250)] + [None, ""]
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        for w in (words, plain):
            assert [np.frombuffer(x, w.serial).tolist() for x in w.encode(texts)] == want


def test_query_against_the_library(spark, tmp_path):
    """The registered query, with its start and crc, over a table of its own."""
    from tokenizers import Tokenizer

    library, draw = Tokenizer.from_file(PATH), random.Random(6)
    rows = [(i * 7, "".join(draw.choice(ODD + [" a word"] * 9) for _ in range(draw.randrange(40)))) for i in range(150)] + [(5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    at = 0
    for (i, t), r in zip(sorted(rows), queries.op7_token_files(spark, str(tmp_path)).orderBy("doc_id").collect(), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
