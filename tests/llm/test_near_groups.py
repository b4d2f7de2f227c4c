"""Near-duplicates against all pairs, with a large group of varied near copies."""

import random
from collections import Counter

import numpy as np

from harrier.llm import minhash_dedup as m


def varied(base, seed, edits):
    r, words = random.Random(seed), list(base)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"v{r.randrange(10**6)}"
    return " ".join(words)


def plain_classes(texts):
    """Smallest index of each text's class, from the weighted Jaccard of all pairs, counted plainly."""
    bags = [Counter(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    names = {g: i for i, g in enumerate(sorted({g for b in bags for g in b}))}
    hashes = {g: int(m.runs(" ".join(g))[0][0]) for g in names}
    cells = Counter(c for b in bags for c in {hashes[g] % m.CELLS for g in b})
    noise, n = sum(cells.values()) / m.CELLS, len(texts)
    weigh = lambda g: 1 + 0.5 * min(1, max(0, np.log(n / max(cells[hashes[g] % m.CELLS] - noise, 1)) / np.log(min(n, m.RARE))))
    idf = {g: weigh(g) for g in names}
    bags = [{g: c * idf[g] for g, c in b.items()} for b in bags]
    cls = list(range(len(texts)))

    def root(i):
        while cls[i] != i:
            i = cls[i]
        return i

    holders = {}
    for i, b in enumerate(bags):
        shared = Counter()
        for g, w in b.items():
            for j in holders.get(g, ()):
                shared[j] += min(w, bags[j][g])
            holders.setdefault(g, []).append(i)
        total = sum(b.values())
        for j, both in shared.items():
            if both / (total + sum(bags[j].values()) - both) >= 0.8:
                a, c = sorted((root(i), root(j)))
                cls[c] = a
    return [root(i) for i in range(len(texts))]


def test_large_group_of_near_copies(spark):
    bases = [[f"w{random.Random(k * 1000 + i).randrange(10**6)}" for i in range(120)] for k in range(40)]
    texts = [varied(bases[0], k, k % 7) for k in range(1200)] + [varied(b, k, e) for k, b in enumerate(bases[1:], 5000) for e in range(6)]
    texts = list(dict.fromkeys(texts))
    random.Random(1).shuffle(texts)
    want = plain_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = m.near_duplicates(docs, block=64).collect()  # many blocks, with further heads
    got = {r.doc_id: r.class_id for r in rows}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(r.links for r in rows) < 4 * len(texts)  # links span classes; they aren't all pairs
    assert Counter(want).most_common(1)[0][1] > 300


def test_a_block_finds_what_pairs_have():
    r = np.random.default_rng(2)
    vectors = [(np.sort(r.choice(40, n, replace=False)).astype(np.uint64), r.uniform(1, 3, n)) for n in r.integers(1, 30, 25)]
    b = m.Block(vectors, np.arange(25))
    for i in range(25):
        others = np.setdiff1d(np.arange(25), [i])
        assert np.allclose(b.similar(i, others), [m.similarity(vectors[i], vectors[j]) for j in others])
    assert b.unite(3, np.array([5, 7])).tolist() == [5, 7] and b.unite(7, np.array([3, 5, 8])).tolist() == [8]
    assert len(set(b.cls[[3, 5, 7, 8]])) == 1
