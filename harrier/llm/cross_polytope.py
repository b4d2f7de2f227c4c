"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to length one and turned by pseudo-random rotations, each three rounds of
random signs and a fast Hadamard transform. A table's bucket is the signed axis nearest to the
turned vector. A query probes the buckets of its nearest few axes in every table; all vectors of
those buckets are candidates and are ranked by their exact inner product with the query.

How far a bucket has to be probed hangs on the rows: a long vector may be among the best at a wide angle, and in rows
without near ones all angles are wide. So a sample of queries is compared with all rows first, and vectors of like
length (a band) are probed deeper, up to all of a band, until enough of the sample's nearest are found.

Equal vectors are searched once. A bucket's vectors are dealt to blocks of bounded size, and its
queries likewise; a block of vectors and a block of queries are multiplied as matrices. A task
keeps each query's best over all of its blocks, and hands on these only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, saved


def _power_of_two(d: int) -> int:
    return 1 << max(0, d - 1).bit_length()


def rotations(d: int, tables: int, seed: int) -> np.ndarray:
    """Random signs of every table's three rounds."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, _power_of_two(d)))


def turn(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Apply one table's pseudo-rotation to the rows of x."""
    n = signs.shape[1]
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = y * s
        h = 1
        while h < n:
            z = y.reshape(len(y), n // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), n)
            h *= 2
        y /= np.sqrt(n)
    return y


def nearest_axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: axis, or axis + n if negative."""
    both = np.concatenate([y, -y], axis=1)
    probes = min(probes, both.shape[1])
    some = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(both, some, axis=1), axis=1, kind="stable"), axis=1)


#: Queries that are compared with all rows, the share of their nearest that has to be found, and bands of length.
SAMPLED, WANTED, BANDS = 128, 0.97, 12


def first_probes(q: np.ndarray, v: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The number, from 0, of the probe by which the luckiest table finds each row of v from that of q."""
    out = np.full(len(q), 2 * signs.shape[2])
    for s in signs:
        home = nearest_axes(turn(v, s), 1)
        y = turn(q, s)
        both = np.concatenate([y, -y], axis=1)
        out = np.minimum(out, (both > np.take_along_axis(both, home, axis=1)).sum(axis=1))
    return out


def depths(first: np.ndarray, bands: np.ndarray, steps: list[int]) -> dict[int, int]:
    """Probes for each band that finds too little with the first of ``steps``; -1: all of the band.

    The band that misses most of the sample's nearest goes a step deeper, until ``WANTED`` of all are found.
    """
    steps, level = [*steps, -1], {int(b): 0 for b in np.unique(bands)}
    while True:
        missed = {b: int((first[bands == b] >= steps[k]).sum()) if steps[k] >= 0 else 0 for b, k in level.items()}
        if sum(missed.values()) <= (1 - WANTED) * len(first):
            return {b: steps[k] for b, k in level.items() if k}
        level[max(missed, key=missed.get)] += 1


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def search(vectors: DataFrame, queries, *, k: int = 20, tables: int = 28, probes: int = 6, block: int = 2000, lot: int = 500_000, seed: int = 17) -> DataFrame:
    """Each query's ``k`` nearest by inner product among all rows but its own.

    ``queries`` is a condition on vec_id; ``lot`` the number of pairs that a task may hold before it drops all but each query's best. Vectors that are null, all zero, or hold a null or a
    component that is not finite take no part; those whose length differs from the most
    frequent one take none either. Ties go to the smaller vec_id; a query with fewer candidates
    than ``k`` gets every other row. Repeated rows (one vec_id with one vector) count once.

    Returns query_id, rank (from 1), vec_id, score (in double precision, of the original vectors).
    """
    spark = vectors.sparkSession
    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = v.where(F.forall("e", finite) & F.exists("e", lambda x: x != 0))
    size = v.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not size:
        return empty
    d = size[0].d
    v = v.where(F.size("e") == d)

    # equal vectors: their k + 1 smallest ids are all that a ranking of k can name
    ids = saved(v.select("vec_id", "e", queries.alias("asks")).distinct(), "ann-vectors")
    few = Window.partitionBy("e").orderBy("vec_id")
    classes = ids.withColumn("i", F.row_number().over(few)).where(F.col("i") <= k + 1).groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = ids.where("asks").select("e").distinct().withColumn("asks", F.lit(True))
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    classes = saved(classes.join(asked, "e", "left").withColumns({"cls": F.xxhash64("e", F.element_at("ids", 1)), "length": length}), "ann-classes")
    longest = classes.agg(F.max("length")).first()[0]
    # a band's lengths are within the square root of two; the last takes all that are shorter
    band = F.least(F.lit(BANDS - 1), F.greatest(F.lit(0), F.floor(2 * F.log2(F.try_divide(F.lit(longest), F.col("length")))))).cast("int")
    classes = classes.withColumn("band", band)
    bands = sorted(r.band for r in classes.select("band").distinct().collect())

    signs = rotations(d, tables, seed)
    axes_of_band = tables * 2 * signs.shape[2]
    sample = classes.where("asks").orderBy(F.xxhash64("cls"), "cls").limit(SAMPLED).select("cls", "e").collect()
    deeper: dict[int, int] = {}
    if sample:
        asking_e, asking_cls = np.array([r.e for r in sample], float), np.array([r.cls for r in sample])

        def nearest(batches):
            for b in batches:
                e = np.stack([np.asarray(x, float) for x in b["e"].to_pylist()])
                s = asking_e @ e.T
                m = min(k + 1, len(e))
                j = np.argpartition(-s, m - 1, axis=1)[:, :m].ravel()
                i = np.repeat(np.arange(len(s)), m)
                own = asking_cls[i] == b["cls"].to_numpy()[j]
                i, j = i[~own], j[~own]
                yield {"q": i, "s": s[i, j], "band": b["band"].to_numpy()[j], "v": [e[x].astype("<f8").tobytes() for x in j]}

        close = map_batches(classes.select("cls", "e", "band"), "q long, s double, band int, v binary", nearest)
        order = Window.partitionBy("q").orderBy(F.desc("s"))
        pairs = close.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k).select("q", "band", "v").collect()
        if pairs:
            first = first_probes(_unit(asking_e[[r.q for r in pairs]]), _unit(_matrix([r.v for r in pairs])), signs)
            deeper = depths(first, np.array([r.band for r in pairs]), [min(x, 2 * signs.shape[2]) for x in (probes, 2 * probes, 4 * probes)])
    deep = {b: deeper.get(b, probes) for b in bands}
    most_probes = max(1, *deep.values())

    def index(batches):
        for b in batches:
            e = np.stack([np.asarray(x, float) for x in b["e"].to_pylist()])
            unit = _unit(e)
            asks = b["asks"].fill_null(False).to_numpy(zero_copy_only=False)
            axes = np.stack([nearest_axes(turn(unit, s), most_probes) for s in signs], axis=1)  # row, table, probe
            buckets = axes + (np.arange(tables) * 2 * signs.shape[2])[None, :, None]
            # a band has its own buckets; one that is compared whole is one bucket
            home = [[-1 - x] if deep[x] < 0 else y + x * axes_of_band for x, y in zip(b["band"].to_pylist(), buckets[:, :, 0], strict=True)]
            asked = [np.concatenate([[-1 - x] if p < 0 else y[:, :p].ravel() + x * axes_of_band for x, p in deep.items()]) if q else [] for y, q in zip(buckets, asks, strict=True)]
            yield {"cls": b["cls"], "ids": b["ids"], "v": [x.astype("<f8").tobytes() for x in e], "home": home, "probes": asked}

    indexed = saved(map_batches(classes, "cls long, ids array<long>, v binary, home array<long>, probes array<long>", index), "ann-index")
    block_key = ["bucket", "home", "probe"]

    def reduced(pairs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """Each query's best of a task's pairs; ties at the edge stay."""
        q, c, s = (np.concatenate(x) for x in zip(*pairs, strict=True))
        at = np.lexsort((c, q))
        at = at[np.concatenate([[True], (np.diff(q[at]) != 0) | (np.diff(c[at]) != 0)])]
        at = at[np.lexsort((-s[at], q[at]))]
        first = np.flatnonzero(np.concatenate([[True], np.diff(q[at]) != 0]))
        size = np.diff(np.concatenate([first, [len(at)]]))
        at = at[s[at] >= np.repeat(s[at[first + np.minimum(k, size - 1)]], size) - 1e-9]
        return q[at], c[at], s[at]

    def best(batches):
        """Of rows sorted by blocks, a block's vectors before the queries that ask it. A task keeps each query's best over all of its
        blocks and hands them on at its end, or when it holds too many."""
        held, n, key, home = [], 0, None, []
        for b in batches:
            keys = np.stack([b[x].to_numpy() for x in block_key])
            asks, cls, v = b["asks"].to_numpy(), b["cls"].to_numpy(), _matrix(b["v"].to_pylist())
            cut = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0) | (asks[1:] != asks[:-1])) + 1).tolist()
            for lo, hi in zip([0, *cut], [*cut, len(cls)], strict=True):
                if (at := tuple(keys[:, lo])) != key:
                    key, home = at, []
                if not asks[lo]:
                    home.append((cls[lo:hi], v[lo:hi]))
                    continue
                if not home:
                    continue
                home = [tuple(map(np.concatenate, zip(*home, strict=True)))]
                c, cv = home[0]
                m = min(k + 1, len(c))
                for start in range(lo, hi, 500):
                    q = cls[start : min(hi, start + 500)]
                    s = v[start : start + len(q)] @ cv.T
                    edge = np.partition(s, len(c) - m, axis=1)[:, len(c) - m]
                    i, j = np.nonzero(s >= edge[:, None] - 1e-9)
                    held.append((q[i], c[j], s[i, j]))
                    n += len(i)
                if n > lot:
                    held = [reduced(held)]
                    n = len(held[0][0])
                if n > lot // 2 and len(held) == 1:
                    yield dict(zip("qcs", held.pop(), strict=True))
                    n = 0
        if held:
            yield dict(zip("qcs", reduced(held), strict=True))

    def compare(home: DataFrame, probe: DataFrame) -> DataFrame:
        """Best pairs of every bucket. Both sides' blocks are counted; the counts are a row a bucket,
        of which there are bands * tables * 2 * dimensions, whatever the rows."""
        rows = [{r.bucket: r["count"] for r in df.groupBy("bucket").count().collect()} for df in (home, probe)]
        n_home, n_probe = ({b: -(-n // block) for b, n in r.items()} for r in rows)
        blocks = spark.createDataFrame([(b, n_home[b], n) for b, n in n_probe.items() if b in n_home], "bucket long, n_home int, n_probe int")

        def spread(df: DataFrame, own: str, other: str) -> DataFrame:
            df = df.join(F.broadcast(blocks), "bucket").withColumn(own, F.pmod(F.xxhash64("cls", F.lit(own)), F.col(f"n_{own}")))
            df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
            return df.select("bucket", F.col("home").cast("long"), F.col("probe").cast("long"), F.lit(int(own == "probe")).alias("asks"), "cls", "v")

        both = spread(home, "home", "probe").unionByName(spread(probe, "probe", "home"))
        return map_batches(both.repartition(*block_key).sortWithinPartitions(*block_key, "asks"), "q long, c long, s double", best)

    asking = indexed.where(F.size("probes") > 0)
    found = compare(indexed.select(F.explode("home").alias("bucket"), "cls", "v"), asking.select(F.explode("probes").alias("bucket"), "cls", "v"))

    def nearest_of(pairs: DataFrame) -> DataFrame:
        """Each query's k + 1 best classes, with all that tie with the last: at most k + 1 of each task go in, but for ties."""
        one = Window.partitionBy("q")
        pairs = pairs.repartition("q").groupBy("q", "c").agg(F.max("s").alias("s")).withColumn("i", F.row_number().over(one.orderBy(F.desc("s"), "c")))
        return pairs.withColumn("edge", F.min(F.when(F.col("i") <= k + 1, F.col("s"))).over(one)).where(F.col("s") >= F.col("edge") - 1e-9).select("q", "c", "s")

    # whatever is joined from here on is a list of bounded length a query, however many buckets it asked
    found = saved(nearest_of(found), "ann-pairs")
    # queries whose buckets hold fewer than k other rows are compared with every row
    sizes = indexed.select(F.col("cls").alias("c"), F.size("ids").alias("rows"))
    short = asking.select("cls", "v").join(found.join(sizes, "c").groupBy(F.col("q").alias("cls")).agg(F.sum("rows").alias("rows")), "cls", "left").where(F.coalesce("rows", F.lit(0)) < k + 1).select("cls", "v")
    if not short.isEmpty():
        everywhere = F.lit(-1).cast("long").alias("bucket")
        found = saved(nearest_of(found.unionByName(compare(indexed.select(everywhere, "cls", "v"), short.select(everywhere, "cls", "v")))), "ann-found")

    # exact scores of the original vectors, component by component in order
    q = indexed.select(F.col("cls").alias("q"), F.col("v").alias("qv"))
    c = indexed.select(F.col("cls").alias("c"), F.col("v").alias("cv"), F.col("ids"))

    def exact(batches):
        for b in batches:
            s = np.einsum("ij,ij->i", _matrix(b["qv"].to_pylist()), _matrix(b["cv"].to_pylist()))
            yield {"q": b["q"], "ids": b["ids"], "score": s}

    scored = map_batches(found.join(q, "q").join(c, "c").select("q", "qv", "cv", "ids"), "q long, ids array<long>, score double", exact)
    ranked = scored.select("q", F.explode("ids").alias("vec_id"), "score")
    shortlist = ranked.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("i") <= k + 1)
    # every asking row of a class has the class's list but for itself
    members = ids.where("asks").select(F.col("vec_id").alias("query_id"), "e").join(classes.select("e", F.col("cls").alias("q")), "e").select("query_id", "q")
    own = members.join(shortlist.select("q", "vec_id", "score"), "q").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

