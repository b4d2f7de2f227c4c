"""The registered queries in DuckDB's SQL, where it can express them."""

from __future__ import annotations

from ..functions.fantasy import WORLD_CUP_POINTS
from ..functions.federations import CONFIDENCE, FEDERATIONS
from ..operators.profiles import EVENTS
from ..schemas import FEATURES
from ..testing import league


def _league(body: str, *more: str) -> str:
    parts = [f"races AS ({league.RACES})", f"results AS ({league.RESULTS})", f"athletes AS ({league.ATHLETES})", *more]
    return "WITH " + ",\n".join(parts) + ("" if body.startswith(",") else "\n") + body


def _recursive(body: str, *more: str) -> str:
    return _league(body, *more).replace("WITH ", "WITH RECURSIVE ", 1)


DATABLE = "SELECT * FROM races WHERE race_date IS NOT NULL AND NOT coalesce(is_team, false)"
PERF = f"""perf AS (SELECT race_id, fis_code, race_date, season, kind, technique, length_km, gender, rank, field, pos, fis_points, contains(lower(series), 'world cup') AS world_cup,
  CASE WHEN rank IS NULL THEN 1.0 WHEN field <= 1 THEN 0.0 ELSE (rank - 1)::DOUBLE / (field - 1) END AS pct,
  CASE WHEN len(times) >= 6 AND times[len(times) // 2 + 1] > times[1] AND rank IS NOT NULL AND time_s <> 0 THEN (time_s - times[1]) / (times[len(times) // 2 + 1] - times[1]) END AS margin
  FROM (SELECT r.*, d.race_date, d.season, d.kind, d.technique, d.length_km, d.gender, d.series, count(*) OVER (PARTITION BY race_id) AS field,
    CAST(row_number() OVER (PARTITION BY race_id ORDER BY rank NULLS LAST, fis_code) AS INT) AS pos,
    list_sort(list(time_s) FILTER (WHERE rank IS NOT NULL AND time_s <> 0) OVER (PARTITION BY race_id)) AS times
    FROM results r JOIN ({DATABLE}) d USING (race_id)) x)"""


def _history(targets: str) -> str:
    tl = "CASE WHEN t.length_km > 0 THEN t.length_km WHEN t.kind = 'sprint' THEN 1.5 WHEN t.kind = 'distance' THEN 12.0 ELSE 8.0 END"
    pl = "CASE WHEN p.length_km <> 0 THEN p.length_km WHEN p.kind = 'sprint' THEN 1.5 ELSE 12.0 END"
    return f"""h AS (SELECT *, tech * kin * exp(-pow(ln(pl / tl), 2) / 1.125) * recency AS w FROM (
  SELECT t.race_id, t.fis_code, t.race_date, p.race_id AS p_race_id, p.race_date AS p_date, p.pct, p.fis_points, p.margin, {tl} AS tl, {pl} AS pl,
    CASE WHEN t.technique = p.technique THEN 1.0 WHEN 'CF' IN (t.technique, p.technique) THEN 0.75 ELSE 0.15 END AS tech,
    CASE WHEN t.kind = p.kind THEN 1.0 ELSE 0.3 END AS kin, pow(0.5::DOUBLE, date_diff('day', p.race_date, t.race_date) / 150.0::DOUBLE) AS recency
  FROM {targets} t JOIN past p ON p.fis_code = t.fis_code AND p.race_date < t.race_date) y)"""


SAMPLES = [
    PERF,
    "past AS (SELECT * FROM perf WHERE world_cup)",
    "targets AS (SELECT * FROM past WHERE rank IS NOT NULL)",
    _history("targets"),
    "q AS (SELECT race_id, fis_code, min(pct) AS best FROM (SELECT *, sum(w) OVER (PARTITION BY race_id, fis_code ORDER BY pct, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY race_id, fis_code) AS sw FROM h) z WHERE c >= 0.2 * sw - 1e-12 GROUP BY ALL)",
    """g AS (SELECT race_id, fis_code, sum(w) AS sw, sum(w * pct) AS swx, sum(w * pct * pct) AS swxx, sum(recency) AS sr, sum(recency * pct) AS srx, count(*) FILTER (WHERE date_diff('day', p_date, race_date) <= 90) AS recent,
  arg_max(fis_points, (p_date, p_race_id)) FILTER (WHERE fis_points > 0) AS points, sum(w) FILTER (WHERE margin IS NOT NULL) AS sm, sum(w * least(margin, 3.0)) FILTER (WHERE margin IS NOT NULL) AS smx FROM h GROUP BY ALL)""",
    """f AS (SELECT g.race_id, g.fis_code, t.pos, t.season, 1 - swx / sw AS similar_form, 1 - best AS similar_best, 1 - srx / sr AS overall_form, srx / sr - swx / sw AS specificity, ln(1 + sw) AS experience, ln(1 + recent::DOUBLE) AS recent_starts,
  CASE WHEN points IS NOT NULL THEN 1 - least(points, 300.0) / 300 ELSE 0.5 END AS fis_points, CASE WHEN points IS NOT NULL THEN 1.0 ELSE 0.0 END AS has_fis_points,
  1 - least(1.0, sqrt(greatest(0.0, swxx / sw - pow(swx / sw, 2)))) AS consistency, CASE WHEN sm > 0 THEN 1 - least(1.0, smx / sm / 3) ELSE 0.5 END AS similar_margin, CASE WHEN sm > 0 THEN 1.0 ELSE 0.0 END AS has_margin
  FROM g JOIN q USING (race_id, fis_code) JOIN targets t USING (race_id, fis_code) WHERE sw > 0)""",
    "s AS (SELECT * FROM f WHERE race_id IN (SELECT race_id FROM f GROUP BY race_id HAVING count(*) >= 6))",
]

READER = [PERF, "past AS (SELECT * REPLACE (NULL::DOUBLE AS fis_points) FROM perf WHERE world_cup AND rank IS NOT NULL AND technique = 'C')", "targets AS (SELECT * FROM perf WHERE world_cup AND rank IS NOT NULL)", *SAMPLES[3:7]]

CHARTS = [
    PERF,
    "pts AS (SELECT coalesce(nation, '?') AS chart, fis_code, race_id, race_date, rank, 1 + 99 * pct AS adjusted FROM perf JOIN athletes USING (fis_code) WHERE world_cup AND kind = 'sprint' AND rank IS NOT NULL)",
    "days AS (SELECT chart, race_date, list_position(l, race_date) AS k, len(l) AS n FROM (SELECT DISTINCT chart, race_date FROM pts) JOIN (SELECT chart, list_sort(list(DISTINCT race_date)) AS l FROM pts GROUP BY chart) USING (chart))",
    "worst AS (SELECT chart, (ceil(max(rank) / 10.0) * 10)::INT AS places, ceil(max(adjusted) / 10) * 10 AS adjusted FROM pts GROUP BY chart)",
    "xs AS (SELECT *, CASE WHEN n < 2 THEN 0.5 ELSE (k - 1)::DOUBLE / (n - 1) END AS x FROM days)",
]


#: One of each of 600 stretches of a race's numbered pairs.
PAIRS = """, t AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY pos) - 1 AS at FROM s),
c AS (SELECT race_id, count(*) * (count(*) - 1) // 2 AS pairs FROM t GROUP BY race_id HAVING count(*) > 1),
k AS (SELECT race_id, pairs, least(pairs, 600) AS most, unnest(range(least(pairs, 600))) AS k FROM c),
x AS (SELECT race_id, k * pairs // most + ('0x' || substr(md5('0|' || race_id || '|' || k), 1, 8))::BIGINT % ((k + 1) * pairs // most - k * pairs // most) AS number FROM k),
y AS (SELECT race_id, number, floor((1 + sqrt(1 + 8 * number::DOUBLE)) / 2)::BIGINT AS b FROM x)
SELECT y.race_id, a.pos AS i, b.pos AS j FROM y JOIN t a ON a.race_id = y.race_id AND a.at = y.number - y.b * (y.b - 1) // 2 JOIN t b ON b.race_id = y.race_id AND b.at = y.b"""

#: Thirty rounds of all races from those of the round before.
STRENGTH = """, o AS (SELECT race_id, race_date, world_cup, fis_code, pct, coalesce(sum(world_cup::INT) OVER (PARTITION BY fis_code ORDER BY race_date, race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 5 AS anchor FROM perf),
ra AS (SELECT race_id, world_cup, count(*)::INT AS n_starters, (count(*) FILTER (WHERE anchor))::INT AS n_anchors, world_cup OR count(*) FILTER (WHERE anchor) >= 5 AS usable FROM o GROUP BY race_id, world_cup),
u AS (SELECT o.*, n_anchors, row_number() OVER (PARTITION BY fis_code ORDER BY race_date, race_id) AS number FROM o JOIN ra USING (race_id) WHERE usable),
q AS (SELECT o.race_id, o.fis_code, r.n_anchors, u.race_id AS past, u.pct, row_number() OVER (PARTITION BY o.race_id, o.fis_code ORDER BY number DESC) AS back FROM o JOIN ra r USING (race_id) JOIN u ON u.fis_code = o.fis_code AND (u.race_date, u.race_id) < (o.race_date, o.race_id) WHERE o.anchor),
l AS (SELECT *, count(*) OVER (PARTITION BY race_id, fis_code) AS k FROM q WHERE back <= 12),
e AS (SELECT race_id, past, sum((1 - pct) / k / n_anchors) AS share FROM l GROUP BY ALL),
gr AS (SELECT race_id, least(1.0, ln(1 + n_anchors::DOUBLE) / ln(21.0::DOUBLE)) AS depth, coalesce((SELECT sum(share) FROM e JOIN ra p ON p.race_id = e.past AND p.world_cup WHERE e.race_id = ra.race_id), 0.0) AS base FROM ra WHERE usable AND NOT world_cup),
li AS (SELECT e.race_id, past, share FROM e JOIN gr USING (race_id) JOIN gr p ON p.race_id = past UNION ALL SELECT race_id, race_id, 0.0 FROM gr),
st AS (SELECT 0 AS round, race_id, 1.0::DOUBLE AS s FROM gr UNION ALL SELECT round + 1 AS round, li.race_id, least(1.0::DOUBLE, max(depth) * (max(base) + sum(share * s))) AS s FROM st JOIN li ON li.past = st.race_id JOIN gr ON gr.race_id = li.race_id WHERE round < 30 GROUP BY round, li.race_id),
fi AS (SELECT race_id, s FROM st WHERE round = 30 UNION ALL SELECT race_id, 1.0 FROM ra WHERE world_cup)
SELECT ra.race_id, n_anchors, n_starters, round(coalesce((SELECT sum(share * s) FROM e JOIN fi ON fi.race_id = e.past WHERE e.race_id = ra.race_id), 0.0), 6) AS anchor_quality, round(coalesce(fi.s, 0.0), 6) AS strength, usable FROM ra LEFT JOIN fi USING (race_id)"""


#: Performances of all races that count, with percentiles and margins adjusted by the field's strength.
_rounds, _last = STRENGTH.rsplit("\nSELECT ra.race_id", 1)
GRADED = [
    PERF,
    _rounds[2:],
    "fs AS (SELECT ra.race_id, ra.usable, coalesce(fi.s, 0.0) AS strength FROM ra LEFT JOIN fi USING (race_id))",
    """past AS (SELECT p.* REPLACE (1 - least(greatest(strength, 0.0), 1.0) * (1 - pct) AS pct, CASE WHEN strength > 0 THEN margin / greatest(strength, 0.15) ELSE margin END AS margin)
  FROM (SELECT perf.*, CASE WHEN world_cup THEN 1.0 ELSE strength END AS strength FROM perf JOIN fs USING (race_id) WHERE usable) p)""",
    *SAMPLES[2:],
]


#: Every pool's races in order, one a step; each step hands on all its ratings.
ELO = """se AS (SELECT *, dense_rank() OVER (PARTITION BY pool ORDER BY race_date NULLS FIRST, race_id) AS nth FROM (
  SELECT gender || '-' || kind AS pool, race_id, race_date, fis_code, rank, count(*) OVER (PARTITION BY race_id) AS n FROM results JOIN races USING (race_id) WHERE rank IS NOT NULL AND is_team = false AND status = 'OK') o WHERE n >= 3),
el AS (SELECT DISTINCT pool, max(nth) OVER (PARTITION BY pool) AS ends, 0::BIGINT AS step, fis_code, 1500.0::DOUBLE AS rating, 0 AS n_races, NULL::VARCHAR AS last_race_id, NULL::DATE AS last_date FROM se
UNION ALL SELECT pool, ends, step + 1, fis_code, CASE WHEN rank IS NULL THEN rating ELSE r + (CASE WHEN n_races < 10 THEN 60 ELSE 200 END) / (n - 1)::DOUBLE * list_sum(list_transform(field, lambda x: (CASE WHEN rank < x.rank THEN 1.0 WHEN rank = x.rank THEN 0.5 ELSE 0.0 END)::DOUBLE - 1 / (1 + pow(10.0::DOUBLE, (x.r - r) / 400)))) END,
  CASE WHEN rank IS NULL THEN n_races ELSE n_races + 1 END, CASE WHEN rank IS NULL THEN last_race_id ELSE race_id END, CASE WHEN rank IS NULL THEN last_date ELSE race_date END
  FROM (SELECT *, list({'rank': rank, 'r': r}) FILTER (WHERE rank IS NOT NULL) OVER (PARTITION BY pool) AS field FROM (
    SELECT el.*, se.rank, se.n, se.race_id, se.race_date, CASE WHEN se.race_date > el.last_date THEN 1500 + pow(0.5::DOUBLE, (se.race_date - el.last_date) / 1825.0::DOUBLE) * (rating - 1500) ELSE rating END AS r
    FROM el LEFT JOIN se ON se.pool = el.pool AND se.fis_code = el.fis_code AND se.nth = el.step + 1 WHERE step < ends) a) b)"""
BACKTEST = """b AS (SELECT se.race_id, se.fis_code, se.rank, el.n_races, CASE WHEN se.race_date > el.last_date THEN 1500 + pow(0.5::DOUBLE, (se.race_date - el.last_date) / 1825.0::DOUBLE) * (rating - 1500) ELSE rating END AS rating
  FROM se JOIN el ON el.pool = se.pool AND el.fis_code = se.fis_code AND el.step = se.nth - 1),
k AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY rank, fis_code) AS place FROM (SELECT *, count(*) OVER (PARTITION BY race_id) AS rated FROM b WHERE n_races > 0) x WHERE rated >= 10),
pr AS (SELECT x.rank < y.rank AS ahead, 1 / (1 + pow(10.0::DOUBLE, (y.rating - x.rating) / 400)) AS p FROM k x JOIN k y ON x.race_id = y.race_id AND x.place < y.place),
rc AS (SELECT race_id, corr(-rating, rank) AS rho, (list_position(list(place ORDER BY rating DESC, place), 1) <= 3)::INT AS top3 FROM k GROUP BY race_id)"""


def _mixed(x: str, keep: str, source: str | None) -> str:
    """A SELECT of ``keep`` and x, the 32-bit mixing of an expression; without a source ``x`` is the SELECT of what goes in, mixed with k1."""
    table = source or f"({x}) m"
    out = f"SELECT {keep}, {x if source else 'xor(x, k1)'} AS x FROM {table}"
    for step in ("xor(x, x >> 16)", "(x * 2146121005::UBIGINT) & 4294967295::UBIGINT", "xor(x, x >> 15)", "(x * 2221713035::UBIGINT) & 4294967295::UBIGINT", "xor(x, x >> 16)"):
        out = f"SELECT {keep}, {step} AS x FROM ({out}) m"
    return out


def oracle_sql() -> dict[str, str]:
    events = ", ".join(f"('{e}', '{k}', '{t}', {x})" for e, k, t, x in EVENTS)
    nations = ", ".join(f"'{n}'" for n in FEDERATIONS)
    names = ", ".join(f"'{n}'" for n in CONFIDENCE)
    title = "lower(title)"
    uniform = "(('0x' || substr(md5('0|' || {0} || '|' || {1}), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"
    sql = {
        "performances": _league("SELECT race_id, fis_code, rank, field, pos, round(pct, 6) AS pct, round(margin, 6) AS margin, world_cup FROM perf", PERF),
        "datable_races": _league(f"SELECT race_id, race_date FROM ({DATABLE}) d"),
        "finished_races": _league("SELECT race_id, race_date FROM races WHERE is_team = false AND race_id IN (SELECT race_id FROM results WHERE rank IS NOT NULL)"),
        "classify_title": _league(f"""SELECT race_id, CASE WHEN contains({title}, 'women') THEN 'W' ELSE 'M' END AS gender, CASE WHEN contains({title}, 'sprint') THEN 'sprint' ELSE 'distance' END AS kind,
  CASE WHEN contains({title}, 'classic') THEN 'C' WHEN contains({title}, 'free') THEN 'F' ELSE '?' END AS technique, CASE WHEN contains({title}, 'mass start') THEN 'mass' WHEN contains({title}, 'sprint') THEN 'sprint' END AS start_type,
  try_cast(nullif(regexp_extract({title}, '(\\d+)\\s*km', 1), '') AS DOUBLE) AS length_km, false AS is_team FROM races WHERE NOT contains({title}, 'standings')"""),
        "features": _league("SELECT race_id, fis_code, " + ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in FEATURES) + " FROM s", *SAMPLES),
        "baselines": _league(
            """, pairs AS (SELECT a.method, a.race_id, CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END AS ok FROM m a JOIN m b ON a.method = b.method AND a.race_id = b.race_id AND a.pos < b.pos)
SELECT method, count(DISTINCT race_id) AS races, count(*) AS pairs, round(round(sum(ok)::DOUBLE / count(*), 4), 4) AS accuracy FROM pairs GROUP BY method""",
            *SAMPLES, f"""m AS (SELECT 'random' AS method, race_id, pos, {uniform.format("race_id", "fis_code")} AS score FROM s UNION ALL SELECT 'fis_points', race_id, pos, fis_points FROM s
  UNION ALL SELECT 'recent_form', race_id, pos, overall_form FROM s UNION ALL SELECT 'similar_form', race_id, pos, similar_form FROM s)""").replace("\n, pairs AS", ",\npairs AS"),
        "scorers": _league(
            """, pairs AS (SELECT a.method, a.race_id, CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END AS ok FROM m a JOIN m b ON a.method = b.method AND a.race_id = b.race_id AND a.pos < b.pos)
SELECT method, count(DISTINCT race_id) AS races, count(*) AS pairs, round(sum(ok)::DOUBLE / count(*), 4) AS accuracy, (SELECT count(DISTINCT race_id) FROM s) - count(DISTINCT race_id) AS skipped FROM pairs GROUP BY method""",
            *SAMPLES, f"""m AS (SELECT 'random' AS method, race_id, pos, {uniform.format("race_id", "fis_code")} AS score FROM s UNION ALL SELECT 'fis_points', race_id, pos, fis_points FROM s
  UNION ALL SELECT 'recent_form', race_id, pos, overall_form FROM s UNION ALL SELECT 'similar_form', race_id, pos, similar_form FROM s
  UNION ALL SELECT 'margin', race_id, pos, similar_margin FROM s UNION ALL SELECT 'sprints', race_id, pos, similar_margin FROM s WHERE race_id IN (SELECT race_id FROM races WHERE kind = 'sprint'))""").replace("\n, pairs AS", ",\npairs AS"),
        "season_split": _league("SELECT CASE WHEN season = 2001 THEN 'test' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT race_id) AS races FROM s GROUP BY ALL", *SAMPLES),
        "weekends": _league("""SELECT concat(place, '|', min(race_date)::VARCHAR) AS key, place, min(race_date) AS start_date, max(race_date) AS end_date, string_agg(race_id, ',' ORDER BY race_id) AS race_ids, count(*) AS n_races
FROM (SELECT *, sum(CASE WHEN gap <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY place ORDER BY race_date, race_id) AS run FROM (SELECT *, date_diff('day', lag(race_date) OVER (PARTITION BY place ORDER BY race_date, race_id), race_date) AS gap FROM races) a) b GROUP BY place, run"""),
        "trajectory": _league("SELECT fis_code, race_id, race_date, rank, round(1 + 99 * pct, 6) AS adjusted FROM perf WHERE rank IS NOT NULL AND world_cup AND kind = 'sprint'", PERF),
        "athlete_summary": _league("SELECT fis_code, count(*) AS n_results, count(*) FILTER (WHERE world_cup) AS wc_starts, count(*) FILTER (WHERE rank = 1) AS wins, count(*) FILTER (WHERE rank <= 3) AS podiums, CASE WHEN min(gender) = max(gender) THEN min(gender) END AS gender FROM perf GROUP BY fis_code HAVING count(*) FILTER (WHERE world_cup AND rank IS NOT NULL) > 0", PERF),
        "best_events": _league("SELECT fis_code, race_id AS event, round(1 - sum(w * pct) / sum(w), 4) AS form, round(sum(w), 2) AS n_similar FROM h GROUP BY ALL", PERF, "past AS (SELECT * FROM perf)",
            f"ev AS (SELECT fis_code, d AS race_date, e AS race_id, k AS kind, t AS technique, x AS length_km FROM (SELECT fis_code, max(race_date) + 1 AS d FROM perf GROUP BY fis_code) l, (VALUES {events}) v(e, k, t, x))", _history("ev")),
        "race_index": _league("SELECT race_id, race_date, season, n, coalesce(season = 2001, false) AS held_out FROM races JOIN (SELECT race_id, count(*) AS n FROM results GROUP BY race_id) c USING (race_id)"),
        "rank_correlation": _league("""SELECT race_id, round(CASE WHEN count(*) > 1 THEN 1 - 6 * sum(pow(p - a, 2)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)) END, 6) AS spearman FROM (
  SELECT race_id, row_number() OVER (PARTITION BY race_id ORDER BY round(similar_form, 6) DESC, pos) AS p, row_number() OVER (PARTITION BY race_id ORDER BY pos) AS a FROM s) r GROUP BY race_id""", *SAMPLES),
        "start_list": _league("SELECT race_id, (row_number() OVER (PARTITION BY race_id ORDER BY fis_code))::INT AS bib, fis_code, name, nation FROM results LEFT JOIN athletes USING (fis_code)"),
        "start_lists": _league("SELECT race_id, fis_code, name, nation FROM results LEFT JOIN athletes USING (fis_code)"),
        "uncovered_nations": _league(f"SELECT DISTINCT nation FROM athletes WHERE nation IS NOT NULL AND nation <> '' AND nation NOT IN ({nations})"),
        "entry_signals": f"SELECT event_id, signal, CASE WHEN signal IN ('fis_startlist', 'federation') THEN 'authoritative' ELSE 'flag_for_review' END AS treatment, CASE signal WHEN 'news_confirmed' THEN 0.6::DOUBLE WHEN 'news_rumour' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM (SELECT event_id, [{names}][event_id % 4 + 1] AS signal FROM events) e",
        "fantasy_market": _league(f"""SELECT race_id, fis_code, coalesce(CASE WHEN rank <= 30 THEN {list(WORLD_CUP_POINTS)}[rank] END, 0)::INT AS worldcup, (CASE WHEN rank <= 30 THEN floor(100 * pow(0.93::DOUBLE, rank - 1) + 0.5) ELSE 0 END)::INT AS decay,
  (CASE WHEN rank <= 50 THEN greatest(1, 60 - rank) ELSE 0 END)::INT AS deep, (CASE WHEN rank <= 10 THEN floor(120 * pow(0.75::DOUBLE, rank - 1) + 0.5) ELSE 0 END)::INT AS podium,
  greatest(1, floor(3 + 27 * pow(1 - (rank - 1)::DOUBLE / greatest(1, n - 1), 2.2::DOUBLE) + 0.5))::INT AS price FROM (SELECT *, count(*) OVER (PARTITION BY race_id) AS n FROM results WHERE rank IS NOT NULL) r"""),
        "elo_first_race": _league("""SELECT pool, fis_code, round(1500 + 60 * ((n - rank) - (n - 1) * 0.5) / (n - 1)::DOUBLE, 6) AS rating FROM (SELECT pool, fis_code, rank, count(*) OVER (PARTITION BY pool) AS n FROM results
  JOIN (SELECT gender || '-' || kind AS pool, arg_min(race_id, (race_date, race_id)) AS race_id FROM races WHERE race_id IN (SELECT race_id FROM results WHERE rank IS NOT NULL) GROUP BY ALL) f USING (race_id) WHERE rank IS NOT NULL) x WHERE n >= 3"""),
        "elo_ratings": _recursive("SELECT fis_code, pool, round(rating, 6) AS rating, n_races, last_race_id, last_date FROM el WHERE step = ends", ELO),
        "leaderboard": _recursive("SELECT pool, place, fis_code, round(rating, 6) AS rating, n_races FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY rating DESC, fis_code)::INT AS place FROM el WHERE step = ends AND n_races >= 5) x WHERE place <= 20", ELO),
        "backtest": _recursive("""SELECT (SELECT count(*) FROM rc) AS races, (SELECT count(DISTINCT race_id) FROM se) - (SELECT count(*) FROM rc) AS skipped, count(*) AS pairs, round(avg(((p > 0.5) = ahead)::INT), 6) AS pair_accuracy,
  round(avg(-ln(greatest(CASE WHEN ahead THEN p ELSE 1 - p END, 1e-12))), 6) AS log_loss, round((SELECT avg(rho) FROM rc), 6) AS mean_spearman, round((SELECT avg(top3) FROM rc), 6) AS winner_top3 FROM pr""", ELO, BACKTEST),
        "ratings_as_of": _recursive("""SELECT r.race_id, r.fis_code, r.pool, round(CASE WHEN el.last_date < r.day THEN 1500 + pow(0.5::DOUBLE, (r.day - el.last_date) / 1825.0::DOUBLE) * (rating - 1500) ELSE coalesce(rating, 1500.0::DOUBLE) END, 6) AS rating, coalesce(n_races, 0) AS n_races
  FROM (SELECT race_id, fis_code, gender || '-' || kind AS pool, race_date AS day, (SELECT coalesce(max(nth), 0) FROM (SELECT DISTINCT pool, nth, race_date FROM se) d WHERE d.pool = gender || '-' || kind AND d.race_date < races.race_date) AS step FROM results JOIN races USING (race_id)) r
  LEFT JOIN el ON el.pool = r.pool AND el.fis_code = r.fis_code AND el.step = r.step""", ELO),
        "medal_table": _league("SELECT season, gender, kind, grouping_id(season, gender, kind) AS level, count(*) FILTER (rank = 1) AS golds, count(*) FILTER (rank = 2) AS silvers, count(*) FILTER (rank = 3) AS bronzes, count(DISTINCT fis_code) AS medallists FROM perf WHERE world_cup AND rank <= 3 GROUP BY ROLLUP (season, gender, kind)", PERF),
        "race_summary": _league("""SELECT race_id, n_athletes, round(round(ok / pairs, 4), 6) AS pair_accuracy, round(rho, 4) AS spearman, winner_predicted_rank FROM (SELECT race_id, count(*) AS n_athletes, max(p) FILTER (WHERE a = 1)::INT AS winner_predicted_rank,
  1 - 6 * sum(pow(p - a, 2)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)) AS rho FROM t GROUP BY race_id) x JOIN (SELECT x.race_id, count(*)::DOUBLE AS pairs, sum((x.p < y.p)::INT) AS ok FROM t x JOIN t y ON x.race_id = y.race_id AND x.a < y.a GROUP BY x.race_id) y USING (race_id)""",
            *SAMPLES, "t AS (SELECT race_id, row_number() OVER (PARTITION BY race_id ORDER BY round(similar_form, 6) DESC, pos) AS p, row_number() OVER (PARTITION BY race_id ORDER BY pos) AS a FROM s)"),
        "athlete_index": "",
        "listings": _league("SELECT replace(race_id, '-', '') AS race_id, season, CAST(season * 10 + (CASE WHEN contains(series, 'World') THEN 0 ELSE 1 END) AS VARCHAR) AS event_id FROM races"),
        "median_places": _league("SELECT fis_code, count(*) AS n, list_sort(list(rank))[count(*) // 2 + 1] AS median FROM perf WHERE rank IS NOT NULL AND world_cup GROUP BY fis_code", PERF),
        "sampled_pairs": _league(PAIRS, *SAMPLES),
        "training_pairs": _league(PAIRS.replace("FROM s)", "FROM s WHERE coalesce(season <> 2001, true))"), *SAMPLES),
        "graded_samples": _recursive("SELECT race_id, fis_code, " + ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in FEATURES) + " FROM s", *GRADED).replace("g AS (SELECT race_id, fis_code, sum(w)", "gg AS (SELECT race_id, fis_code, sum(w)").replace("FROM g JOIN q USING (race_id, fis_code)", "FROM gg AS g JOIN qq USING (race_id, fis_code)").replace("q AS (SELECT race_id, fis_code, min(pct) AS best", "qq AS (SELECT race_id, fis_code, min(pct) AS best"),
        "field_strength": _league(STRENGTH, PERF).replace("WITH ", "WITH RECURSIVE ", 1),
        "simulation": _league(f"""SELECT race_id, fis_code, round(avg(rank), 6) AS mean_rank, round(quantile_cont(rank, 0.5)::DOUBLE, 6) AS median_rank, round(avg((rank <= 1)::INT), 6) AS p_win, round(avg((rank <= 3)::INT), 6) AS p_podium, round(avg((rank <= 10)::INT), 6) AS p_top10 FROM (
  SELECT race_id, fis_code, row_number() OVER (PARTITION BY race_id, run ORDER BY (1500 + (fis_code::INT % 7) * 40.0::DOUBLE) * ln(10) / 400 - ln(-ln((x + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) DESC, fis_code) AS rank FROM ({_mixed(_mixed("xor(run, k2)", "race_id, fis_code, run, k1", "entered, (SELECT unnest(range(1, 201))::UBIGINT AS run) t"), "race_id, fis_code, run", None)}) a) b GROUP BY ALL""",
            "entered AS (SELECT race_id, fis_code, ('0x' || substr(md5('0|' || fis_code), 1, 8))::UBIGINT AS k1, ('0x' || substr(md5('0|' || fis_code), 9, 8))::UBIGINT AS k2 FROM results)"),
        "page_links": """SELECT page_id, substr(sha256(url), 1, 20) AS cache_key, len(l)::INT AS links, coalesce(l[1], '') AS first_link FROM (SELECT page_id, url, list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS d,
  list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x, i: list_position(regexp_extract_all(html, 'href="([^"]*)"', 1), x) = i) AS l FROM pages) p""",
        "result_pages": _league("SELECT race_id, fis_code::INT AS code, rank, nation, round(coalesce(fis_points, 0.0), 2) AS fis_points, status FROM results JOIN athletes USING (fis_code) WHERE race_id IN (SELECT race_id FROM results WHERE rank IS NOT NULL)"),
        "reader_features": _league("SELECT race_id, fis_code, " + ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in FEATURES) + " FROM f", *READER),
        "chart_axes": _league("SELECT a.chart, a.race_date, round(a.x::DOUBLE, 6) AS x, places AS worst, CASE WHEN b.chart IS NULL OR year(b.race_date) <> year(a.race_date) THEN year(a.race_date)::INT END AS year FROM xs a JOIN worst USING (chart) LEFT JOIN xs b ON b.chart = a.chart AND b.k = a.k - 1", *CHARTS),
        "chart_curves": _league("SELECT chart, fis_code, race_id, round(x::DOUBLE, 6) AS x, round((p.adjusted - 1) / (w.adjusted - 1), 6) AS y FROM pts p JOIN xs USING (chart, race_date) JOIN worst w USING (chart)", *CHARTS),
        "chart_ticks": _league("SELECT chart, tick, round((tick - 1)::DOUBLE / (places - 1), 6) AS y FROM (SELECT DISTINCT chart, places, tick FROM worst, (SELECT unnest([1, 5, 10, 20, 30, 50, 100]) AS t) u, LATERAL (SELECT unnest([t, places])::INT AS tick) v WHERE tick <= places) z", *CHARTS),
        "timed_pages": _league("SELECT race_id, race_date, 'Town' AS place, nullif(series, '') AS series, title, fis_code::INT AS code, (fis_code::INT % 900 + 1)::INT AS bib, rank, status, round(time_s::DOUBLE, 6) AS time_s FROM results JOIN races USING (race_id) JOIN athletes USING (fis_code)"),
        "upserts": _league("SELECT fis_code, CASE WHEN fis_code::INT % 3 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN fis_code::INT % 6 = 0 THEN 'NEW' ELSE nation END AS nation, CASE WHEN fis_code::INT % 3 = 0 THEN fis_code END AS competitor_id FROM athletes"),
        "quoted_csv": _league("""SELECT concat('"', race_id, '","', replace(title, '"', '""'), '","', coalesce(length_km::VARCHAR, ''), '"') AS line FROM races"""),
    }
    sql["athlete_index"] = f"""SELECT fis_code, name, nation, gender, n_results, wc_starts, wins, podiums, best_event, best_form FROM ({sql["athlete_summary"]}) s
  LEFT JOIN (SELECT fis_code, arg_min(event, (-form, event)) AS best_event, max(form) AS best_form FROM ({sql["best_events"]}) e GROUP BY fis_code) b USING (fis_code) LEFT JOIN ({league.ATHLETES}) a USING (fis_code) WHERE n_results >= 3"""
    return sql
