"""The prefix trie of conversations, with what sharing a prefix would save.

A turn is known by a digest, a prefix by the exclusive or of keyed digests of its turns at their depths; the key is
drawn anew in each run. The smallest conversation that begins with a prefix owns it. Whoever owns a
prefix owns all longer ones of its own too, so the first depth that a conversation owns is found by
binary search: each round looks up one prefix of every open conversation among the shared prefixes' minima, by one join, and
drops the half that it settles. What a conversation owns is a chain of nodes, hanging on a node of another's chain.
Chains' totals are added up the tree of chains in rounds that double their reach, and from the bottom of each chain.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, saved
from .running import running

#: Bytes of joined ids that are hashed at once.
CHUNK = 1 << 16


def _turns(conversations: DataFrame) -> DataFrame:
    """Conversations' own turns, numbered from 1: conv_id, t (digest of role and text), points (code points of the text), run_one."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    t = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", t.alias("t"), F.length(text).cast("long").alias("points"), F.lit(1).cast("long").alias("one"))
    # equal rows are alike; the number only lets ranges part them
    return running(rows.withColumn("tie", F.monotonically_increasing_id()), "conv_id", ["turn", "t", "tie"], sums=("one",), name="turns").select("conv_id", "t", "points", F.col("run_one").alias("number"))


def rebuilt(conversations: DataFrame, *, most: int = 6, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """All conversations with their lengths, and their turns (conv_id, depth, t, points, ends) after rebuilding: the first
    h original turns of conversation ``c - c % every``, then c's own after its first h, h being ``crc32(c) % most``."""
    own = _turns(conversations)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = own.where((F.col("conv_id") % every == 0) & (F.col("number") < most)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("number", "t", "points"))).alias("head"))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every}).join(heads, "base", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce(F.size("head"), F.lit(0))).cast("long"))
    convs = convs.withColumn("ends", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = saved(convs.select("conv_id", "m", "ends", F.slice(F.coalesce("head", F.array()), 1, F.col("m").cast("int")).alias("head")), "conversations")
    borrowed = convs.select("conv_id", "ends", F.explode("head").alias("x")).select("conv_id", F.col("x.number").alias("depth"), "x.t", "x.points", "ends")
    after = own.where(F.col("number") > h).join(convs.select("conv_id", "m", "ends"), "conv_id")
    after = after.select("conv_id", (F.col("m") + F.col("number") - h).alias("depth"), "t", "points", "ends")
    return convs.select("conv_id", "ends"), borrowed.unionAll(after)


def _first_owned(prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """conv_id, first: the smallest depth from which a conversation owns its prefixes, its length plus 1 if it owns none."""
    rows = prefixes.select("conv_id", "depth", "a", "b", F.lit(1).cast("long").alias("lo"), (F.col("ends") + 1).alias("hi"))
    found = None
    while True:
        asked = rows.where("depth = (lo + hi) div 2").join(minima.select("depth", "a", "b", "owner"), ["depth", "a", "b"], "left")
        owned = F.col("owner").isNull() | (F.col("owner") == F.col("conv_id"))
        state = asked.select("conv_id", F.when(owned, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owned, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        state = saved(state, "search")
        done = state.where("lo = hi").select("conv_id", F.col("lo").alias("first"))
        found = done if found is None else found.unionAll(done)
        rows = saved(rows.drop("lo", "hi").join(state.where("lo < hi"), "conv_id").where("depth >= lo AND depth < hi"), "open")
        if rows.isEmpty():
            return found


def _subtree_totals(chains: DataFrame) -> DataFrame:
    """conv_id, w, leaf summed over each chain and all chains below it; ``parent`` is the chain on which one hangs."""
    now = saved(chains.select("conv_id", "parent", "w", "leaf"), "chains")
    while not now.where("parent IS NOT NULL").isEmpty():
        below = now.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id")).agg(F.sum("w").alias("more_w"), F.sum("leaf").alias("more_leaf"))
        up = now.select(F.col("conv_id").alias("parent"), F.col("parent").alias("above"))
        none = F.lit(0).cast("long")
        now = now.join(below, "conv_id", "left").join(up, "parent", "left")
        now = saved(now.select("conv_id", F.col("above").alias("parent"), (F.col("w") + F.coalesce("more_w", none)).alias("w"), (F.col("leaf") + F.coalesce("more_leaf", none)).alias("leaf")), "chains")
    return now.drop("parent")


def _ends(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the ids (``who``) of each node's conversations in ascending order.

    Ids are joined in ranges, so that a node with any number of them is dealt to many tasks; the hash, which has
    to go in order, then streams over the pieces.
    """

    def joined(batches):
        node, first, held, size = None, None, [], 0

        def out():
            return {"conv_id": [node[0]], "depth": [node[1]], "first": [first], "ids": [b",".join(held)]}

        for b in batches:
            for c, d, who in zip(*(b[n].to_pylist() for n in ("conv_id", "depth", "who")), strict=True):
                if node != (c, d) or size >= CHUNK:
                    if held:
                        yield out()
                    node, first, held, size = (c, d), who, [], 0
                held.append(b"%d" % who)
                size += len(held[-1]) + 1
        if held:
            yield out()

    def hashed(batches):
        node, digest = None, None
        for b in batches:
            for c, d, ids in zip(*(b[n].to_pylist() for n in ("conv_id", "depth", "ids")), strict=True):
                if node == (c, d):
                    digest.update(b"," + ids)
                    continue
                if node:
                    yield {"conv_id": [node[0]], "depth": [node[1]], "ends_sha256": [digest.hexdigest()]}
                node, digest = (c, d), hashlib.sha256(ids)
        if node:
            yield {"conv_id": [node[0]], "depth": [node[1]], "ends_sha256": [digest.hexdigest()]}

    def whole(work):  # results of single nodes, put together to batches
        def batched(batches):
            held: dict[str, list] = {}
            for row in work(batches):
                for k, v in row.items():
                    held.setdefault(k, []).extend(v)
                if len(held["conv_id"]) >= 1000 or "ids" in row and sum(map(len, held["ids"])) > 16 * CHUNK:
                    yield held
                    held = {}
            if held:
                yield held

        return batched

    order = ["conv_id", "depth", "who"]
    pieces = map_batches(ends.repartitionByRange(*order).sortWithinPartitions(*order), "conv_id long, depth long, first long, ids binary", whole(joined))
    pieces = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return map_batches(pieces, "conv_id long, depth long, ends_sha256 string", whole(hashed))


def trie(conversations: DataFrame, *, most: int = 6, every: int = 100) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are in order of ``turn`` (null first), then of a digest of role and text; repeated rows are turns of their
    own; null role and text count as empty. Rows without conv_id belong to no conversation and take no part. An
    empty table has no nodes, not even a root. Other columns are not read.
    """
    convs, turns = rebuilt(conversations, most=most, every=every)
    total = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("root"), F.max_by("ends", -F.col("conv_id")).alias("ends")).first()
    n_all, root = total.n, total.root if total.n else 0
    a, b = secrets.token_hex(16), secrets.token_hex(16)
    rows = turns.select("conv_id", "depth", "points", "ends", F.xxhash64(F.lit(a), "depth", "t").alias("a"), F.xxhash64("t", F.lit(b), "depth").alias("b"))
    prefixes = running(rows, "conv_id", ["depth"], xors=("a", "b"), name="prefixes").select("conv_id", "depth", "points", "ends", F.col("run_a").alias("a"), F.col("run_b").alias("b"))
    minima = prefixes.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 1")
    minima = saved(minima, "minima")

    first = _first_owned(prefixes, minima)
    # the smallest conversation owns the root too
    first = saved(convs.join(first, "conv_id", "left").select("conv_id", "ends", F.when(F.col("conv_id") == root, 0).otherwise(F.coalesce("first", F.lit(1))).alias("first")), "first-owned")
    above = prefixes.join(first.select("conv_id", "first"), "conv_id").where("depth = first - 1").join(minima, ["depth", "a", "b"]).select("conv_id", F.col("owner").alias("parent"))
    hang = first.join(above, "conv_id", "left").withColumn("parent", F.when(F.col("first") == 1, F.lit(root)).otherwise(F.col("parent")))
    hang = saved(hang.select("conv_id", "ends", "first", "parent"), "hang")

    top = hang.where("first = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("points"), "ends", F.lit(n_all).cast("long").alias("n_convs"))
    shared = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs")
    nodes = prefixes.join(first.select("conv_id", "first"), "conv_id").where("depth >= first").select("conv_id", "depth", "points", "ends").join(shared, ["conv_id", "depth"], "left")
    nodes = nodes.withColumn("n_convs", F.coalesce("n_convs", F.lit(1))).unionByName(top).withColumn("w", (F.col("n_convs") - 1) * F.col("points"))
    nodes = saved(nodes.drop("points"), "nodes")

    chains = hang.where("first <= ends")
    hung = chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    bottom = chains.join(hung, (chains["conv_id"] == hung["conv_id"]) & (chains["ends"] == hung["depth"]), "left").select(chains["conv_id"], "parent", F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long").alias("leaf"))
    weights = nodes.groupBy("conv_id").agg(F.sum("w").alias("w"))
    totals = _subtree_totals(bottom.join(weights, "conv_id"))
    hung = chains.where("parent IS NOT NULL").join(totals, "conv_id").groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth"))
    hung = hung.agg(F.count("*").alias("hung"), F.sum("w").alias("hung_w"), F.sum("leaf").alias("hung_leaf"))

    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    nodes = nodes.join(hung, ["conv_id", "depth"], "left")
    nodes = nodes.select(
        "conv_id", "depth", "n_convs", (-F.col("depth")).alias("back"), (none("hung") + (F.col("depth") < F.col("ends")).cast("long")).alias("n_children"),
        (F.col("w") + none("hung_w")).alias("w"), F.when((F.col("depth") == F.col("ends")) & F.col("hung").isNull(), 1).otherwise(none("hung_leaf")).cast("long").alias("leaf"),
    )
    nodes = running(nodes, "conv_id", ["back"], sums=("w", "leaf"), name="subtrees")

    ends = _ends(hang.select(F.when(F.col("first") <= F.col("ends"), F.col("conv_id")).otherwise(F.col("parent")).alias("conv_id"), F.col("ends").alias("depth"), F.col("conv_id").alias("who")))
    nodes = nodes.join(ends, ["conv_id", "depth"], "left").join(hang.select("conv_id", "first", "parent"), "conv_id")
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent"))
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.col("run_leaf").alias("n_leaves"), F.col("run_w").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def oracle_sql() -> str:
    """The same in DuckDB, over the turns themselves: each prefix is a list."""
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))))"""
    return f"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, {crc} % 6 AS h, c - c % 100 AS base FROM (SELECT DISTINCT c FROM o) x),
r AS (SELECT k.c, i, role, text FROM k JOIN o ON o.c = base AND i <= h UNION ALL SELECT k.c, i, role, text FROM k JOIN o ON o.c = k.c AND i > h),
p AS (SELECT c, row_number() OVER w AS depth, length(text) AS points, list({{'role': role, 'text': text}}) OVER w AS prefix FROM r WINDOW w AS (PARTITION BY c ORDER BY i)
  UNION ALL SELECT c, 0, 0, [] FROM k),
n AS (SELECT *, min(c) OVER (PARTITION BY prefix) AS owner, count(*) OVER (PARTITION BY prefix) AS members, depth = max(depth) OVER (PARTITION BY c) AS last FROM p),
u AS (SELECT owner AS conv_id, depth, any_value(members) AS n_convs, any_value((members - 1) * points) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM n GROUP BY owner, depth),
l AS (SELECT n.c AS conv_id, n.depth, n.owner AS parent FROM n),
v AS (SELECT u.*, l.parent AS parent_conv_id FROM u LEFT JOIN l ON l.conv_id = u.conv_id AND l.depth = u.depth - 1),
h AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM v WHERE depth > 0 GROUP BY ALL),
x AS (SELECT v.*, coalesce(h.n, 0) AS n_children FROM v LEFT JOIN h USING (conv_id, depth)),
s AS (SELECT l.parent AS conv_id, l.depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(w) AS saved FROM x JOIN l ON l.conv_id = x.conv_id AND l.depth <= x.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM x JOIN s USING (conv_id, depth)"""
