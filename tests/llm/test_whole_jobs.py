"""Cases that were once left out: parts of leaks."""

import random
import re

from harrier.llm import decontaminate


def words(seed, n):
    return [f"w{random.Random(seed * 1000 + i).randrange(10**9)}" for i in range(n)]


def plain_find(docs, bench):
    """(doc, item) to (agreeing words, lag), from all stretches of all alignments with a seed."""
    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    found = {}
    for d, text in docs:
        for b, item in bench:
            w, x = split(text), split(item)
            for lag in range(-len(x) + 1, len(w)):
                ok = [0 <= i + lag < len(w) and w[i + lag] == x[i] for i in range(len(x))]
                seeded = any(all(ok[i + k] for k, bit in enumerate(m) if bit == "1") and 0 <= i + lag and i + lag + len(m) <= len(w) for m in decontaminate.MASKS for i in range(len(x) - len(m) + 1))
                if not seeded:
                    continue
                whole = sum(ok) >= 0.8 * len(x)
                stretch = any(sum(ok[i:j]) >= 13 and sum(ok[i:j]) >= 0.8 * (j - i) for i in range(len(x)) for j in range(i + 1, len(x) + 1))
                if whole or stretch:
                    found[d, b] = max(found.get((d, b), (0, 0)), (sum(ok), -lag))
    return {k: (n, -back) for k, (n, back) in found.items()}


def test_parts_of_leaks_against_all_stretches(spark):
    item, long = words(1, 59), words(2, 200)
    bench = [(1, " ".join(item)), (2, " ".join(long))]
    docs = [
        (1, item[:20]),
        (2, item[:20] + words(3, 19) + item[39:]),  # more of the item, on the same lag
        (3, words(4, 5) + item[20:33] + words(5, 9)),  # 13 words, others right after
        (4, long[:15] + words(6, 150) + long[165:172] + words(7, 28)),  # a far hit by accident
        (5, item[:12]),
        (6, item[:12] + words(8, 30) + item[42:54]),  # two parts, each too short
    ]
    draw = random.Random(9)
    for k in range(60):
        share = draw.choice([0.6, 0.75, 0.8, 0.85, 0.9])
        lo = draw.randrange(40)
        part = item[lo : lo + draw.randrange(12, 59)]
        docs.append((100 + k, words(10 + k, draw.randrange(6)) + [w if draw.random() < share else "other" for w in part] + words(200 + k, draw.randrange(12))))
    docs = [(i, " ".join(w)) for i, w in docs]
    want = plain_find(docs, bench)
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.matched, r.doc_from) for r in got} == want
    assert {i for i, _ in want} & {1, 2, 3, 4, 5, 6} == {1, 2, 3, 4} and 10 < len(want) < 60
