"""Secrets in texts, in DataFrame operations only.

Three patterns find assignments, access keys and runs of hexadecimal digits. Beside them two Markov models of
characters, one of random strings and one of ordinary identifiers, judge every other long token: what is likelier
under the first, by a stated log-likelihood ratio, is a secret too. The models are trained from labelled samples of the corpus:
all distinct strings that the patterns found are random, the shorter tokens of a sample of documents are ordinary.

Texts are read once for spans and long tokens and once more for the sample; models and scores need no texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# fixed values
ASSIGN = "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs that would fail for their length are left out by the pattern; no other match begins inside them.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models judge, those that train the ordinary one, and the symbols of both models with the end.
LONG = 16
TOKEN, ORDINARY, SYMBOLS = "[A-Za-z0-9+/_=-]{%d,}" % LONG, "[A-Za-z0-9+/_=-]{4,}", 69
#: A token without any is a line or a rule.
LETTER = "[A-Za-z0-9]"
#: How many symbols in the model's own proportions are added to those that follow a symbol.
SMOOTH = 10.0
#: Weights are thousandths of natural logarithms, as integers, so that sums are exact.
UNIT = 1000


def _prefix_sums(x: Column) -> Column:
    """Running sums of an array of int, in 31 passes that double their reach: no pass is quadratic, however many entries."""

    def doubled(a: Column, k: int) -> Column:  # as the one element of an array, ``a`` is computed once
        return F.get(F.transform(F.array(a), lambda v: F.transform(v, lambda y, i: y + F.coalesce(F.get(v, i - (1 << k)), F.lit(0)))), F.lit(0))

    def passes(n: int) -> Column:
        out = x
        for k in range(n):
            out = doubled(out, k)
        return out

    return F.when(F.size(x) <= 1, x).when(F.size(x) <= 16, passes(4)).otherwise(passes(31))


def placed(text: Column, found: Column, pattern: str) -> Column:
    """The matches ``found`` of a pattern in a text as structs of at (code points before), to (end, exclusive) and m."""
    gaps = F.split(text, pattern, -1)
    # gaps and lengths as the one element of an array: the text is split once
    lengths = F.get(F.transform(F.array(gaps), lambda g: F.transform(found, lambda m, i: F.length(m) + F.length(F.get(g, i)))), F.lit(0))
    spans = F.zip_with(found, _prefix_sums(lengths), lambda m, e: F.struct((e - F.length(m)).alias("at"), e.alias("to"), m.alias("m")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<at:int,to:int,m:string>>"))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, the spans assign, access and hex, and tokens: long tokens outside all matches of an assignment, that hold no other span."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[_all(F.col("text"), p).alias(n) for n, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))])
    rows = rows.select("doc_id", "text", *[placed(F.col("text"), F.col(n), p).alias(n) for n, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))])
    rest = F.when(F.size("assign") > 0, F.split("text", ASSIGN, -1)).otherwise(F.array("text"))
    rows = rows.withColumn("rest", F.transform(rest, lambda r: F.struct(r.alias("r"), _all(r, TOKEN).alias("found"))))
    after = lambda i: F.when(i > 0, F.get("assign", i - 1)["to"]).otherwise(0)
    moved = F.transform("rest", lambda r, i: F.transform(placed(r["r"], r["found"], TOKEN), lambda s: F.struct((s["at"] + after(i)).alias("at"), (s["to"] + after(i)).alias("to"), s["m"].alias("m"))))
    tokens = F.filter(F.flatten(moved), lambda s: F.rlike(s["m"], F.lit(LETTER)) & ~F.rlike(s["m"], F.lit(f"{HEX}|{ACCESS}")))
    value = lambda s: F.regexp_extract(s["m"], ASSIGN, 1)
    assign = F.filter(F.transform("assign", lambda s: F.struct(s["at"].alias("at"), s["to"].alias("to"), value(s).alias("m"))), lambda s: F.length(s["m"]) >= LEAST_ASSIGNED)
    return rows.select("doc_id", assign.alias("assign"), "access", "hex", tokens.alias("tokens"))


def _pairs(strings: DataFrame) -> DataFrame:
    """a, b, n: how often symbol b follows a in the strings m, each counted n times. 0 stands before and after a string."""
    codes = F.concat(F.array(F.lit(0)), F.transform(F.filter(F.split("m", ""), lambda c: c != ""), lambda c: F.ascii(c)), F.array(F.lit(0)))
    rows = strings.select("n", F.explode(F.array(codes)).alias("c")).select("n", F.explode(F.transform(F.slice("c", 2, F.size("c")), lambda b, i: F.struct(F.get("c", i).alias("a"), b.alias("b")))).alias("p"))
    return rows.groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, found: DataFrame, *, sample_rows: int = 20_000) -> list[int] | None:
    """The weight of symbol b after a at ``128 * a + b``: how much likelier it is in a random string, as a logarithm in
    units of 1 / UNIT. None where either sample is empty; then there is nothing to compare.

    Random strings are all distinct ones in the spans of ``found``. Ordinary are tokens too short to be judged, as often as
    they occur outside assignments in about ``sample_rows`` of all documents, drawn by a hash of id and text.
    """
    strings = found.select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select("s.m").distinct().withColumn("n", F.lit(1))
    drawn = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))), 1, 8), 16, 10).cast("long")
    share = min(1.0, sample_rows / max(1, found.count()))
    left = F.regexp_replace(F.coalesce("text", F.lit("")), ASSIGN, " ")
    tokens = docs.where(drawn < int(share * 2**32)).select(F.explode(_all(left, ORDINARY)).alias("m")).where(F.length("m") < LONG)
    tokens = tokens.groupBy("m").agg(F.count("*").alias("n"))
    counts = [{(r.a, r.b): r.n for r in _pairs(of).collect()} for of in (strings, tokens)]  # a row for each pair of symbols at most
    return weights(*counts) if all(counts) else None


def weights(random: dict[tuple[int, int], int], ordinary: dict[tuple[int, int], int]) -> list[int]:
    """The weights from how often symbol b follows a in the strings of each kind."""

    def logs(n: dict[tuple[int, int], int]) -> list[float]:
        follows, after = [0] * 128, [0] * 128
        for (a, b), k in n.items():
            after[a] += k
            follows[b] += k
        total = sum(after)
        single = [(k + 0.5) / (total + 0.5 * SYMBOLS) for k in follows]
        return [math.log((n.get((a, b), 0) + SMOOTH * single[b]) / (after[a] + SMOOTH)) for a in range(128) for b in range(128)]

    return [round(UNIT * (x - y)) for x, y in zip(logs(random), logs(ordinary), strict=True)]


def ratio(m: Column, table: list[int]) -> Column:
    """The log-likelihood ratio of a token, in units of 1 / UNIT."""
    w = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # a constant, found once
    step = lambda acc, c: F.struct(F.ascii(c).alias("a"), (acc["sum"] + F.get(w, 128 * acc["a"] + F.ascii(c))).alias("sum"))
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("sum"))
    return F.aggregate(F.filter(F.split(m, ""), lambda c: c != ""), start, step, lambda acc: acc["sum"] + F.get(w, 128 * acc["a"]))


def scan(docs: DataFrame, *, sample_rows: int = 20_000, least: float = 20.0) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, by start, then by KINDS. A long token outside all assignments that holds
    no other span is of kind ``markov`` if the natural logarithm of its likelihood ratio is ``least`` or more.
    Null texts count as empty; repeated rows and null ids keep a row each; an empty table gives none. Without
    labelled strings of both kinds there is no model and no span of it. Other columns are not read.
    """
    found = saved(_found(docs), "secrets")
    table = train(docs, found, sample_rows=sample_rows)
    if table is None:
        more = F.array().cast("array<struct<at:int,to:int,m:string>>")
    else:
        more = F.filter("tokens", lambda s: ratio(s["m"], table) >= int(least * UNIT))
    kinds = dict(zip(KINDS, (F.col("assign"), F.col("access"), F.col("hex"), more), strict=True))
    of_kind = lambda s, k: F.transform(s, lambda x: F.struct(x["at"].alias("at"), F.lit(KINDS.index(k)).alias("k"), x["to"].alias("to")))
    spans = {k: of_kind(s, k) for k, s in kinds.items()}
    named = F.array(*map(F.lit, KINDS))
    joined = lambda *s: F.array_join(F.transform(F.array_sort(F.concat(*s)), lambda x: F.concat_ws(":", F.get(named, x["k"]), x["at"].cast("string"), x["to"].cast("string"))), ",")
    base = [spans[k] for k in KINDS[:3]]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(*base).cast("binary"), 256).alias("base_sha256"), joined(*base, spans["markov"]).alias("spans"))


def oracle_sql() -> str:
    """The same in DuckDB, with the defaults of ``scan``."""
    quoted = ASSIGN.replace("'", "''")
    placed = "SELECT row, '{k}' AS kind, {k}, unnest(list_zip(regexp_extract_all(text, '{p}'), list_transform(string_split_regex(text, '{p}'), lambda x: length(x)), true)) AS z, unnest(range(len(regexp_extract_all(text, '{p}')))) AS i FROM d"
    first = " UNION ALL ".join(placed.format(k=k, p=p).replace(f", {k}, unnest", ", 0 AS piece, unnest") for k, p in (("assign", quoted), ("access", ACCESS), ("hex", HEX)))
    pair = "SELECT a, b, sum(n)::BIGINT AS n FROM (SELECT n, unnest(c[:-2]) AS a, unnest(c[2:]) AS b FROM (SELECT n, list_concat([0], list_transform(list_filter(string_split(m, ''), lambda x: x <> ''), lambda x: ascii(x)), [0]) AS c FROM {src}) x) y GROUP BY ALL"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
m0 AS ({first}),
m1 AS (SELECT row, kind, i, z[1] AS m, sum(z[2] + length(z[1])) OVER (PARTITION BY row, kind ORDER BY i)::INT AS ends FROM m0),
m2 AS MATERIALIZED (SELECT row, kind, i, ends - length(m) AS pos, ends, CASE kind WHEN 'assign' THEN regexp_extract(m, '{quoted}', 1) ELSE m END AS m FROM m1),
base AS (SELECT * FROM m2 WHERE kind <> 'assign' OR length(m) >= {LEAST_ASSIGNED}),
r0 AS (SELECT row, text, unnest(string_split_regex(text, '{quoted}')) AS r, unnest(range(len(string_split_regex(text, '{quoted}')))) AS piece FROM d),
r1 AS (SELECT row, piece, unnest(list_zip(regexp_extract_all(r, '{TOKEN}'), list_transform(string_split_regex(r, '{TOKEN}'), lambda x: length(x)), true)) AS z, unnest(range(len(regexp_extract_all(r, '{TOKEN}')))) AS i FROM r0),
r2 AS (SELECT row, piece, z[1] AS m, sum(z[2] + length(z[1])) OVER (PARTITION BY row, piece ORDER BY i)::INT AS ends FROM r1),
tokens AS (SELECT r2.row, r2.m, r2.ends - length(r2.m) + coalesce(m2.ends, 0) AS pos, r2.ends + coalesce(m2.ends, 0) AS ends FROM r2 LEFT JOIN m2 ON m2.row = r2.row AND m2.kind = 'assign' AND m2.i = piece - 1 WHERE regexp_matches(r2.m, '{LETTER}') AND NOT regexp_matches(r2.m, '{HEX}|{ACCESS}')),
strings AS (SELECT DISTINCT m, 1 AS n FROM base),
drawn AS (SELECT text FROM d WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || text), 1, 8))::BIGINT < (SELECT floor(least(1.0::DOUBLE, 20000::DOUBLE / greatest(1, count(*))) * 4294967296.0::DOUBLE)::BIGINT FROM d)),
ordinary AS (SELECT m, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '{quoted}', ' ', 'g'), '{ORDINARY}')) AS m FROM drawn) x WHERE length(m) < {LONG} GROUP BY m),
pr AS ({pair.format(src="strings")}), po AS ({pair.format(src="ordinary")}),
g AS (SELECT k, a, b, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT unnest(['r', 'o']) AS k) k1, (SELECT unnest(range(128))::INT AS a) a1, (SELECT unnest(range(128))::INT AS b) b1) grid
  LEFT JOIN (SELECT 'r' AS k, * FROM pr UNION ALL SELECT 'o', * FROM po) p USING (k, a, b)),
l AS (SELECT k, a, b, ln((n + {SMOOTH}::DOUBLE * (sum(n) OVER (PARTITION BY k, b) + 0.5::DOUBLE) / (sum(n) OVER (PARTITION BY k) + {0.5 * SYMBOLS}::DOUBLE)) / (sum(n) OVER (PARTITION BY k, a) + {SMOOTH}::DOUBLE)) AS log FROM g),
w AS (SELECT a, b, round({UNIT} * (max(log) FILTER (WHERE k = 'r') - max(log) FILTER (WHERE k = 'o')))::INT AS w FROM l GROUP BY a, b),
tp AS (SELECT DISTINCT m, unnest(c[:-2]) AS a, unnest(c[2:]) AS b, unnest(range(len(c) - 1)) AS i FROM (SELECT m, list_concat([0], list_transform(list_filter(string_split(m, ''), lambda x: x <> ''), lambda x: ascii(x)), [0]) AS c FROM (SELECT DISTINCT m FROM tokens) y) x),
score AS (SELECT m, sum(w) AS s FROM tp JOIN w USING (a, b) GROUP BY m),
spans AS (SELECT row, pos, list_position({list(KINDS)}, kind) AS k, kind || ':' || pos || ':' || ends AS span FROM base
  UNION ALL SELECT row, pos, 4, 'markov:' || pos || ':' || ends FROM tokens JOIN score USING (m) WHERE s >= {20 * UNIT} AND EXISTS (SELECT 1 FROM strings) AND EXISTS (SELECT 1 FROM ordinary))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE k = 1) AS n_assign, count(*) FILTER (WHERE k = 2) AS n_access, count(*) FILTER (WHERE k = 3) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY pos, k) FILTER (WHERE k < 4), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY pos, k), '') AS spans
FROM d LEFT JOIN spans USING (row) GROUP BY row"""
