"""Registered queries of the library's operators over the league, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fantasy, federations, titles
from ..functions import kernels as K
from ..operators import features as feat
from ..operators import charts, folds, metrics, profiles, ranker, results, simulate
from ..schemas import FEATURES
from ..sources import pages, store
from ..sources.scratch import settled
from ..testing import league

HELD_OUT = [2001]


def _perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.performances(league.races(spark, sf_dir), league.results(spark, sf_dir))


def _six(df: DataFrame) -> DataFrame:
    """Doubles to six places, as in the SQL."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _wc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.samples(_perf(spark, sf_dir), other_series=False)


def performances(spark, sf_dir):
    return _six(_perf(spark, sf_dir).select("race_id", "fis_code", "rank", "field", "pos", "pct", "margin", "world_cup"))


def datable_races(spark, sf_dir):
    return results.datable_races(league.races(spark, sf_dir)).select("race_id", "race_date")


def finished_races(spark, sf_dir):
    return results.finished_races(league.races(spark, sf_dir), league.results(spark, sf_dir)).select("race_id", "race_date")


def classify_title(spark, sf_dir):
    return titles.classify_title(results.single_races(league.races(spark, sf_dir)).select("race_id", "title")).drop("title")


def features(spark, sf_dir):
    return _six(_wc_samples(spark, sf_dir).select("race_id", "fis_code", *FEATURES))


def baselines(spark, sf_dir):
    return metrics.pair_accuracy(metrics.baseline_scores(_wc_samples(spark, sf_dir))).withColumn("accuracy", F.round("accuracy", 4)).drop("correct")


def season_split(spark, sf_dir):
    train, test = results.split_by_season(_wc_samples(spark, sf_dir).select("race_id", "season"), HELD_OUT)
    return train.agg(F.lit("train").alias("part"), F.count("*").alias("n"), F.countDistinct("race_id").alias("races")).unionByName(test.agg(F.lit("test").alias("part"), F.count("*").alias("n"), F.countDistinct("race_id").alias("races")))


def weekends(spark, sf_dir):
    return results.weekends(league.races(spark, sf_dir), gap=20)


def trajectory(spark, sf_dir):
    return _six(results.trajectory(_perf(spark, sf_dir), world_cup=True, kind="sprint"))


def athlete_summary(spark, sf_dir):
    return profiles.athlete_summary(_perf(spark, sf_dir))


def best_events(spark, sf_dir):
    return profiles.best_events(_perf(spark, sf_dir))


def race_index(spark, sf_dir):
    return profiles.race_index(league.races(spark, sf_dir), league.results(spark, sf_dir), HELD_OUT)


def rank_correlation(spark, sf_dir):
    s = _wc_samples(spark, sf_dir).withColumn("score", F.round("similar_form", 6))
    return _six(metrics.rank_correlation(metrics.predicted_ranks(s)))


def start_list(spark, sf_dir):
    """Of all races, in the order of bibs, here the athletes' numbers within the race."""
    bib = F.row_number().over(Window.partitionBy("race_id").orderBy("fis_code"))
    entries = league.results(spark, sf_dir).select("race_id", "fis_code", bib.alias("bib"))
    return store.start_list(entries, league.athletes(spark, sf_dir)).select("race_id", "bib", "fis_code", "name", "nation")


def start_lists(spark, sf_dir):
    return store.start_list(league.results(spark, sf_dir).select("race_id", "fis_code"), league.athletes(spark, sf_dir)).select("race_id", "fis_code", "name", "nation")


def race_summary(spark, sf_dir):
    return _six(profiles.race_summary(_wc_samples(spark, sf_dir).withColumn("score", F.round("similar_form", 6))))


def athlete_index(spark, sf_dir):
    return profiles.athlete_index(_perf(spark, sf_dir), league.athletes(spark, sf_dir))


def median_places(spark, sf_dir):
    return results.median_places(results.trajectory(_perf(spark, sf_dir), world_cup=True))


def listings(spark, sf_dir):
    """Calendar and event pages made from the league's races, parsed again: a season's World Cup races are one event, others another."""
    r = league.races(spark, sf_dir).withColumn("category", F.when(F.col("series").contains("World"), "WC").otherwise("COC"))
    r = r.withColumns({"event_id": (F.col("season") * 10 + (F.col("category") == "COC").cast("int")).cast("string"), "id": F.regexp_replace("race_id", "-", "")})
    link = lambda url: F.concat(F.lit('<a href="'), url, F.lit('">x</a>'))
    calendars = r.groupBy("season", "category").agg(F.array_join(F.collect_set(link(pages.event_url(F.col("event_id"), F.col("season")))), "").alias("html"))
    events = r.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set(link(pages.race_url(F.col("id"))))), "").alias("html"))
    return pages.listed_races(calendars, events)


def uncovered_nations(spark, sf_dir):
    return federations.uncovered(league.athletes(spark, sf_dir))


def entry_signals(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.element_at(F.array(*map(F.lit, federations.CONFIDENCE)), (F.col("event_id") % 4 + 1).cast("int")).alias("signal"))
    return s.select("event_id", "signal", federations.treat(F.col("signal")).alias("treatment"), federations.confidence(F.col("signal")).alias("confidence"))


def fantasy_market(spark, sf_dir):
    r = league.results(spark, sf_dir).where("rank IS NOT NULL")
    n = r.groupBy("race_id").agg(F.count("*").alias("n"))
    r = r.join(n, "race_id")
    return r.select("race_id", "fis_code", *[fantasy.payout(F.col("rank"), s).alias(s) for s in ("worldcup", "decay", "deep", "podium")], fantasy.price(F.col("rank"), F.col("n")).alias("price"))


def _games(spark, sf_dir):
    """Starters of each season's last men's and women's World Cup races, with points and prices."""
    p = _perf(spark, sf_dir).where("world_cup AND rank IS NOT NULL")
    last = p.groupBy("season", "gender").agg(F.max("race_id").alias("race_id"))
    p = p.join(last.select("race_id"), "race_id")
    n = p.groupBy("race_id").agg(F.count("*").alias("n"))
    market = p.join(n, "race_id").select(F.col("season").alias("game"), "gender", F.concat("gender", F.lit("-"), "fis_code").alias("fis_code"), fantasy.payout(F.col("rank")).alias("points"), fantasy.price(F.col("rank"), F.col("n")).alias("price"))
    return market.where("points > 0")


def fantasy_teams(spark, sf_dir):
    """The best team of each season's last men's and women's World Cup races."""
    return fantasy.teams(_games(spark, sf_dir))


def forcing_costs(spark, sf_dir):
    return fantasy.forcing_costs(_games(spark, sf_dir))


def distinct_starters(spark, sf_dir):
    return profiles.distinct_starters(profiles.starter_sketches(_perf(spark, sf_dir), league.athletes(spark, sf_dir)), "season")


def scorers(spark, sf_dir):
    """The baselines beside two scorers of a user's, one of which declines what isn't of kind sprint."""
    by_margin = lambda s: s.select("race_id", "fis_code", "pos", F.col("similar_margin").alias("score"))
    races = league.races(spark, sf_dir).where("kind = 'sprint'").select("race_id")
    return metrics.compare(_wc_samples(spark, sf_dir), {"margin": by_margin, "sprints": lambda s: by_margin(s.join(races, "race_id", "left_semi"))}).drop("correct")


def elo_first_race(spark, sf_dir):
    """Each pool's first race, as one update from equal ratings."""
    r = results.finished_races(league.races(spark, sf_dir).withColumn("is_team", F.lit(False)), league.results(spark, sf_dir)).select("race_id", "race_date", K.pool(F.col("gender"), F.col("kind")).alias("pool"))
    first = r.groupBy("pool").agg(F.min_by("race_id", F.struct("race_date", "race_id")).alias("race_id"))
    rows = league.results(spark, sf_dir).where("rank IS NOT NULL").join(first, "race_id").select("pool", "race_id", "fis_code", "rank")
    n = rows.groupBy("pool").agg(F.count("*").alias("n")).where("n >= 3")
    surprise = (F.col("n") - F.col("rank")) - (F.col("n") - 1) * K.expected_score(F.lit(1500.0), F.lit(1500.0))
    return _six(rows.join(n, "pool").select("pool", "fis_code", (K.ELO_START + K.k_factor(F.lit(0)) * surprise / (F.col("n") - 1)).alias("rating")))


def elo_ratings(spark, sf_dir):
    return _six(folds.elo_ratings(league.races(spark, sf_dir), league.results(spark, sf_dir)))


def leaderboard(spark, sf_dir):
    return _six(profiles.leaderboard(folds.elo_ratings(league.races(spark, sf_dir), league.results(spark, sf_dir))))


def backtest(spark, sf_dir):
    return _six(metrics.backtest(folds.ratings_before(league.races(spark, sf_dir), league.results(spark, sf_dir))))


def ratings_as_of(spark, sf_dir):
    """Of every starter, before the day of each race; races of the day itself don't count."""
    races, res = league.races(spark, sf_dir), league.results(spark, sf_dir)
    asked = res.select("race_id", "fis_code").join(races.select("race_id", F.col("race_date").alias("day"), K.pool(F.col("gender"), F.col("kind")).alias("pool")), "race_id")
    return _six(folds.ratings_as_of(folds.rating_history(races, res), asked)).select("race_id", "fis_code", "pool", "rating", "n_races")


def medal_table(spark, sf_dir):
    return profiles.medal_table(_perf(spark, sf_dir))


def field_strength(spark, sf_dir):
    return _six(folds.field_strength(settled(_perf(spark, sf_dir), "performances")))


def graded_samples(spark, sf_dir):
    p = settled(_perf(spark, sf_dir), "performances")
    return _six(feat.samples(p, folds.field_strength(p), world_cup_only=False).select("race_id", "fis_code", *FEATURES))


def reader_features(spark, sf_dir):
    """Of all World Cup finishers, from their classic World Cup races only."""
    p = _perf(spark, sf_dir)
    return _six(feat.reader_features(p.where("world_cup AND rank IS NOT NULL"), p, world_cup=True, technique="C").select("race_id", "fis_code", *FEATURES))


def _nations_sprints(spark, sf_dir):
    """A chart for each nation, of its athletes' places in World Cup sprints."""
    points = results.trajectory(_perf(spark, sf_dir), world_cup=True, kind="sprint")
    return points.join(league.athletes(spark, sf_dir).select("fis_code", F.coalesce("nation", F.lit("?")).alias("chart")), "fis_code")


def chart_axes(spark, sf_dir):
    return _six(charts.axes(_nations_sprints(spark, sf_dir)))


def chart_curves(spark, sf_dir):
    return _six(charts.curves(_nations_sprints(spark, sf_dir), "adjusted").select("chart", "fis_code", "race_id", "x", "y"))


def chart_ticks(spark, sf_dir):
    return _six(charts.ticks(_nations_sprints(spark, sf_dir)))


def learned_ranker(spark, sf_dir):
    """Trained on all but the held-out seasons, scored on those."""
    train, test = results.split_by_season(_wc_samples(spark, sf_dir), HELD_OUT)
    model = ranker.fit(train)
    return _six(metrics.ranker_metrics(test.withColumn("score", model.score())))


def sampled_pairs(spark, sf_dir):
    return ranker.sampled_pairs(_wc_samples(spark, sf_dir)).select("race_id", "i", "j")


def training_pairs(spark, sf_dir):
    """Pairs of the races that the ranker learns from: of all but the held-out seasons."""
    train, _ = results.split_by_season(_wc_samples(spark, sf_dir), HELD_OUT)
    return ranker.sampled_pairs(train).select("race_id", "i", "j")


def race_payloads(spark, sf_dir):
    return profiles.race_payloads(_wc_samples(spark, sf_dir).withColumn("score", F.col("similar_form")))


def athlete_payloads(spark, sf_dir):
    return profiles.athlete_payloads(_perf(spark, sf_dir))


def _field(spark, sf_dir):
    return league.results(spark, sf_dir).select("race_id", "fis_code", (1500.0 + F.pmod(F.col("fis_code").cast("int"), F.lit(7)) * 40.0).alias("rating"))


def simulation(spark, sf_dir):
    """All races, in 200 runs, which SQL can repeat; ``simulations`` has the default number."""
    return _six(simulate.simulate(_field(spark, sf_dir), 200))


def simulations(spark, sf_dir):
    return _six(simulate.simulate(_field(spark, sf_dir)))


def page_links(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return p.select("page_id", pages.cache_key(F.col("url")).alias("cache_key"), F.size(links).alias("links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"))


def result_pages(spark, sf_dir):
    """Race pages made from the league's results, parsed again."""
    r = league.results(spark, sf_dir).join(league.athletes(spark, sf_dir), "fis_code")
    code = F.expr("lpad(fis_code, greatest(7, length(fis_code)), '0')")
    cells = [F.coalesce(F.col("rank").cast("string"), F.col("status")), code, F.concat(F.lit("Name "), "name"), F.col("nation"), F.format_string("%.2f", F.coalesce("fis_points", F.lit(0.0)))]
    row = F.concat(F.lit('<a class="table-row" href="athlete.html?competitorid='), "fis_code", F.lit('">'), *[F.concat(F.lit("<div>"), c, F.lit("</div>")) for c in cells], F.lit("</a>"))
    heads = league.races(spark, sf_dir).select("race_id", F.lit('<div class="event-header__name"><h1>Town</h1></div>').alias("text"))
    html = league.pages(heads, r.select("race_id", row.alias("text")))
    rows = pages.parse_race_pages(html).select("race_id", F.col("fis_code").cast("int").alias("code"), "rank", "nation", "fis_points", "status")
    return pages.results_of(settled(rows, "pages"))


def timed_pages(spark, sf_dir):
    """Race pages with headers, spelled-out dates, bibs and clocks, made from the league's results and parsed again."""
    r = league.results(spark, sf_dir).join(league.athletes(spark, sf_dir), "fis_code")
    tenths = F.round(F.col("time_s") * 10).cast("long")
    clock = F.format_string("%d:%02d.%d", F.expr("div(tenths, 600)"), F.expr("div(tenths % 600, 10)"), F.col("tenths") % 10)
    cells = [F.coalesce(F.col("rank").cast("string"), F.col("status")), (F.col("fis_code").cast("int") % 900 + 1).cast("string"), F.expr("lpad(fis_code, greatest(7, length(fis_code)), '0')"), F.concat(F.lit("Name "), "name"), F.col("nation"), F.when(F.col("tenths").isNotNull(), clock)]
    row = F.concat(F.lit('<a class="table-row">'), F.concat_ws("", *[F.concat(F.lit("<div>"), c, F.lit("</div>")) for c in cells]), F.lit("</a>"))
    rows = r.withColumn("tenths", tenths).select("race_id", row.alias("text"))
    part = lambda name, text: F.concat(F.lit(f'<div class="event-header__{name}">'), F.coalesce(text, F.lit("")), F.lit("</div>"))
    head = [part("name", F.lit("<h1>Town</h1>")), part("subtitle", F.col("series")), part("kind", F.col("title")), part("date", F.date_format("race_date", "MMMM d, yyyy"))]
    html = league.pages(league.races(spark, sf_dir).select("race_id", F.concat(*head).alias("text")), rows)
    return _six(pages.parse_race_pages(html).select("race_id", F.col("race_date").cast("date").alias("race_date"), "place", "series", "title", F.col("fis_code").cast("int").alias("code"), "bib", "rank", "status", "time_s"))


def upserts(spark, sf_dir):
    """Athletes merged with a later crawl that lacks some nations."""
    old = league.athletes(spark, sf_dir).select("fis_code", "name", "nation", F.lit(None).cast("int").alias("birth_year"), F.lit(None).cast("string").alias("competitor_id"))
    new = old.where("CAST(fis_code AS INT) % 3 = 0").select("fis_code", F.upper("name").alias("name"), F.when(F.col("fis_code").cast("int") % 2 == 0, F.lit("NEW")).alias("nation"), "birth_year", F.col("fis_code").alias("competitor_id"), F.lit(1).alias("seq"))
    return store.upsert_athletes(old, new).select("fis_code", "name", "nation", "competitor_id")


def quoted_csv(spark, sf_dir):
    return store.quoted_csv(league.races(spark, sf_dir).select("race_id", "title", "length_km"))


def queries() -> dict:
    return {f.__name__: f for f in (
        performances, datable_races, finished_races, classify_title, features, baselines, season_split, weekends, trajectory, athlete_summary, best_events, race_index, rank_correlation, start_list, start_lists,
        race_summary, athlete_index, median_places, listings, uncovered_nations, entry_signals, fantasy_market, fantasy_teams, forcing_costs, distinct_starters, scorers, elo_first_race, elo_ratings, leaderboard, backtest, ratings_as_of, medal_table, field_strength, graded_samples, reader_features, chart_axes, chart_curves, chart_ticks, learned_ranker, sampled_pairs, training_pairs, race_payloads,
        athlete_payloads, simulation, simulations, page_links, result_pages, timed_pages, upserts, quoted_csv,
    )}
