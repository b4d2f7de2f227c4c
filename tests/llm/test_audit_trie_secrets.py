"""Divergence of sources, conversations' trie and secrets, against plain loops over awkward rows and against their SQL."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from harrier.llm import conversation_trie, divergence, queries, secret_scan
from harrier.llm.running import running

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, term string, n string"
TURN = "conv_id long, turn long, role string, text string, depth string, owner string"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op11_divergence", "op12_conversation_trie", "op13_secret_scan"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = db.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, SF)
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    table = lambda columns, rows: Counter(tuple(dict(zip(columns, r, strict=True))[n] for n in names) for r in rows)
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())


def test_running_totals_of_long_keys(spark):
    r = random.Random(1)
    rows = [(7, i, r.randrange(-9, 99)) for i in range(3000)] + [(k, i, r.randrange(99)) for k in range(-40, 40) if k != 7 for i in range(r.randrange(1, 6))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k long, i long, v long").withColumn("x", F.xxhash64("i", "k"))
    got = {(g.k, g.i): (g.run_v, g.run_x) for g in running(df.repartition(3), "k", ["i"], sums=("v",), xors=("x",)).collect()}
    total, want = defaultdict(lambda: [0, 0]), {}
    for g in sorted(df.collect(), key=lambda g: (g.k, g.i)):
        total[g.k][0] += g.v
        total[g.k][1] ^= g.x
        want[g.k, g.i] = tuple(total[g.k])
    assert got == want


def plain_audit(rows, least):
    docs = [(lang or "", source or "", [t.encode().lower().decode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in mine}}
        p = lambda c, t: 1 + 1000000000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        whole = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = [(o, sum(abs(p(c, t) - p(counts[o], t)) for t in kept)) for o in counts if o != s]
            terms = [(t, p(c, t) - p(whole, t)) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def test_divergence_of_awkward_rows(spark, monkeypatch):
    r = random.Random(4)
    words = ["ÀB", "àb", "Zoë", "ZOË", "x", "日本", "a\x7fb", "it's", "[u]"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    rows = [(i if i % 7 else None, " ".join(r.choice(words) for _ in range(r.randrange(30))), r.choice(["en", "", None, "de"]), r.choice(["s", "t", "", None, "ü"]), "x", "y") for i in range(300)]
    rows += [(1, None, "fr", "s", "x", "y"), (2, "", "fr", None, "x", "y"), (3, "lone", "it", "s", "x", "y"), (4, "z" * 70_000 + " w", "en", "s", "x", "y")] + [rows[5]] * 3
    monkeypatch.setattr(divergence, "SHARD_ROWS", 40)
    monkeypatch.setattr(divergence, "HELD", 25)
    monkeypatch.setattr(divergence, "PIECE", 50)
    got = divergence.audit(spark.createDataFrame(rows, DOC).repartition(5), least=4)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_audit(rows, 4)
    assert divergence.audit(spark.createDataFrame([], DOC)).collect() == []


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in own.items()}
    new = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        new[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = defaultdict(set)
    for c, ts in new.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].add(c)
    children = defaultdict(list)
    for n in nodes:
        if n:
            children[n[:-1]].append(n)
    out = set()
    for n, members in nodes.items():
        below = [m for m in nodes if m[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in members if len(new[c]) == len(n))))
        saved = sum((len(nodes[m]) - 1) * len(m[-1][1]) for m in below if m)
        out.add((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children[n]), sum(not children[m] for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie_of_awkward_rows(spark, monkeypatch):
    r = random.Random(9)
    said = ["hi", "", "日本😀", "ok then", "no"]
    rows = []
    for c in [*range(-5, 40), 100, 101, 105, 199, 230, 231, 302, -100, -101, -199, 10**12, 10**12 + 3]:
        for k in range(r.randrange(1, 9)):
            rows.append((c, None if k == 0 and c % 3 == 0 else k, r.choice(["user", "user", None]), r.choice(said[: 1 + c % 5]), "x", "y"))
    rows += [(100, 50 + k, "user", said[k % 2], "x", "y") for k in range(150)] + [(101, 50 + k, "user", said[k % 2], "x", "y") for k in range(145)]
    rows += [(None, 1, "user", "no id", "x", "y")] + [(5, 3, "user", "again", "x", "y")] * 3
    seen, once = set(), []
    for row in rows:  # one row a turn, or equal ones: ties of unlike rows are in the order of digests
        if (row[0], row[1]) not in seen or row in once:
            once.append(row)
            seen.add((row[0], row[1]))
    monkeypatch.setattr(conversation_trie, "CHUNK", 8)
    got = conversation_trie.trie(spark.createDataFrame(once, TURN).repartition(6))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == names and all(t == "bigint" for n, t in got.dtypes if n != "ends_sha256")
    found = [tuple(x) for x in got.collect()]
    want = plain_trie(once)
    assert len(found) == len(want) and set(found) == want
    assert conversation_trie.trie(spark.createDataFrame([], TURN)).collect() == []


def test_trie_of_copies(spark):
    rows = [(c, k, "user", f"turn {k}", "x", "y") for c in range(400) for k in range(3)] + [(1000, 1, "user", "alone", "x", "y")]
    assert {tuple(x) for x in conversation_trie.trie(spark.createDataFrame(rows, TURN)).collect()} == plain_trie(rows)


BASE = {
    "assign": (re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[1]) >= 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def plain_base(text):
    found = sorted((m.start(), k, name, m.end()) for k, (name, (p, keep)) in enumerate(BASE.items()) for m in p.finditer(text or "") if keep(m))
    count = Counter(f[2] for f in found)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(",".join(f"{n}:{a}:{e}" for a, _, n, e in found).encode()).hexdigest()


def test_secrets_of_awkward_rows(spark):
    r = random.Random(2)
    parts = ["password", "PassWd=", "token: \"", "api_key = '", "APIKEY:", "secret", ":", "=", " ", "  ", "AKIA", "AKIAABCDEFGHIJ1234", "deadbeef", "0123456789abcdef", "é", "😀", "x.y-z/", "abcdefghijkl", "ſecret=", "toKen:abcdefghijklmn", "\n", "\x00"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(40))), "en", "s", "x", "y") for i in range(250)]
    rows += [(None, None, "en", "s", "x", "y"), (900, "", "en", "s", "x", "y"), (3, "password: token: abcdefghijklmn", "en", "s", "x", "y"), (901, "ÀÀ " + "token=a " * 3000 + "token=abcdefghijklmnop", "en", "s", "x", "y")] * 2
    got = secret_scan.scan(spark.createDataFrame(rows, DOC).repartition(4)).collect()
    assert Counter((g.doc_id, g.n_assign, g.n_access, g.n_hex, g.base_sha256) for g in got) == Counter((x[0], *plain_base(x[1])) for x in rows)
    for g in got:  # what the models add is beside the base spans, which stay
        base = [s for s in g.spans.split(",") if s and not s.startswith("markov")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == g.base_sha256
    assert secret_scan.scan(spark.createDataFrame([], DOC)).collect() == []


def test_models_add_random_tokens_and_no_others(spark):
    r = random.Random(5)
    drawn = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36))
    rows = [(i, f"Schifffahrtsgesellschaften: Schifffahrt, Gesellschaft und understandings of Prose, MAX_NUMBER RETRIES token={drawn()}", "de", "s", "x", "y") for i in range(120)]
    rows += [(2000 + i, f"née ghp_{drawn()} understandingsgesellschaft Understandings_of_Retries ------------------------", "de", "s", "x", "y") for i in range(20)]
    got = secret_scan.scan(spark.createDataFrame(rows, DOC).repartition(4)).collect()
    assert {g.spans for g in got if g.doc_id >= 2000} == {"markov:4:44"} and {g.spans for g in got if g.doc_id < 2000} == {"assign:102:144"}
    assert all("markov" not in g.spans for g in secret_scan.scan(spark.createDataFrame(rows[120:], DOC)).collect())  # nothing labelled: no model


def test_ratio_is_that_of_two_chains(spark):
    rows = [(i, f"token={w * 2}zq9x7k2v ordinary words of ordinary prose {i}", "en", "s", "x", "y") for i, w in enumerate(["k9x2", "q7zz", "0v3j", "x8w1"])]
    docs = spark.createDataFrame(rows, DOC)
    found = secret_scan._found(docs)
    weights = secret_scan.train(docs, found)
    values = {BASE["assign"][0].search(x[1])[1] for x in rows}
    left = Counter(t for x in rows for t in re.findall(secret_scan.ORDINARY, re.sub(secret_scan.ASSIGN, " ", x[1])) if len(t) < 16)
    count = {}
    for name, strings in (("r", Counter(values)), ("o", left)):
        count[name] = Counter()
        for s, n in strings.items():
            for a, b in zip("\0" + s, s + "\0", strict=True):
                count[name][a, b] += n
    for probe in ("k9x27zz", "ordinary", "prose"):
        want = 0
        for a, b in zip("\0" + probe, probe + "\0", strict=True):
            p = {}
            for n, c in count.items():
                single = (sum(v for (_, y), v in c.items() if y == b) + 0.5) / (sum(c.values()) + 0.5 * 69)
                p[n] = (c[a, b] + 10 * single) / (sum(v for (x, _), v in c.items() if x == a) + 10)
            want += round(1000 * (math.log(p["r"]) - math.log(p["o"])))
        assert abs(spark.range(1).select(secret_scan.ratio(F.lit(probe), weights)).first()[0] - want) <= 1
