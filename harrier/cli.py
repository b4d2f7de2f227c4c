"""Command line: rate, backtest, predict, train, evaluate and export over a store of Parquet tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .functions.kernels import ELO_HALF_LIFE, ELO_K
from .functions.kernels import pool as pool_of
from .operators import features, folds, metrics, profiles, ranker, results, simulate
from .session import local_session
from .sources import ingest, pages, store

#: Seasons that training leaves out where none are named.
HOLDOUT = [2026]
METHODS = ("random", "fis_points", "recent_form", "similar_form", "elo", "learned")


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--store", default=argparse.SUPPRESS, help="folder of the tables")
    out = argparse.ArgumentParser(prog="harrier", parents=[common])
    verbs = out.add_subparsers(dest="verb", required=True)
    add = lambda name: verbs.add_parser(name, parents=[common])
    into = add("ingest")
    into.add_argument("--pages", required=True, help="Parquet table of saved race pages (race_id, html)")
    into.add_argument("--calendars", help="Parquet table of calendar pages (season, category, html)")
    into.add_argument("--events", help="Parquet table of event pages (event_id, html)")
    add("startlist").add_argument("race_id")
    rate, backtest, predict = add("rate"), add("backtest"), add("predict")
    for verb in (rate, backtest, predict):
        verb.add_argument("--half-life", type=float, default=ELO_HALF_LIFE, help="days in which an idle rating loses half its distance to the start")
        if verb is not predict:
            verb.add_argument("--k", type=float, default=ELO_K)
    rate.add_argument("--min-races", type=int, default=5)
    rate.add_argument("--top", type=int, default=20)
    backtest.add_argument("--min-rated", type=int, default=10)
    predict.add_argument("race_id")
    predict.add_argument("--pool", help="a whole pool's name; else that of the race")
    predict.add_argument("--sims", type=int, default=20_000)
    predict.add_argument("--spread", type=float, default=1.0, help="above 1 the race is more random")
    predict.add_argument("--seed", type=int, default=0)
    predict.add_argument("--top", type=int, default=15)
    for name in ("train", "evaluate", "export"):
        verb = add(name)
        verb.add_argument("--holdout", type=int, nargs="+", default=HOLDOUT, metavar="SEASON")
        verb.add_argument("--model", default="model.json")
        if name == "train":
            verb.add_argument("--epochs", type=int, default=300)
            verb.add_argument("--lr", type=float, default=0.5)
        if name == "export":
            verb.add_argument("--out", default="site")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    root = getattr(args, "store", "data/store")
    spark = local_session()
    read = lambda name: store.read(spark, root, name)
    races, res = read("races"), read("results")
    if args.verb == "ingest":
        listed = pages.listed_races(spark.read.parquet(args.calendars), spark.read.parquet(args.events)) if args.calendars and args.events else None
        bad = ingest.ingest(spark, root, spark.read.parquet(args.pages), listed)
        if bad:
            print(f"{bad} pages can't be parsed, see the table bad_pages", file=sys.stderr)
    elif args.verb == "rate":
        elo = folds.Elo(args.k, args.half_life)
        store.write(folds.elo_ratings(races, res, elo), root, "ratings")
        store.write(folds.rating_history(races, res, elo), root, "rating_history")
        profiles.leaderboard(read("ratings"), args.min_races, args.top).orderBy("pool", "place").show(1000, truncate=False)
    elif args.verb == "backtest":
        metrics.backtest(folds.ratings_before(races, res, folds.Elo(args.k, args.half_life)), args.min_rated).show(truncate=False)
    elif args.verb == "startlist":
        store.start_list(read("start_list").where(F.col("race_id") == args.race_id), read("athletes")).select("bib", "fis_code", "name", "nation").orderBy("bib", "fis_code").show(1000, truncate=False)
    elif args.verb == "predict":
        race = races.where(F.col("race_id") == args.race_id).select("race_date", pool_of(F.col("gender"), F.col("kind")).alias("pool")).first()
        if race is None:
            print(f"no race {args.race_id}", file=sys.stderr)
            return 1
        field = simulate.starters(read("start_list").where(F.col("race_id") == args.race_id), read("athletes"), read("rating_history"), args.pool or race.pool, race.race_date and str(race.race_date), folds.Elo(half_life=args.half_life))
        if field.isEmpty():
            print(f"no start list of race {args.race_id}", file=sys.stderr)
            return 1
        print(simulate.format_table(simulate.simulate(field, args.sims, seed=args.seed, spread=args.spread).join(field.select("fis_code", "name", "n_races"), "fis_code"), args.top))
    else:
        perf = results.performances(races, res)
        samples = features.samples(perf, folds.field_strength(perf))
        train, test = results.split_by_season(samples, args.holdout)
        if args.verb == "train":
            model = ranker.fit(train, epochs=args.epochs, rate=args.lr)
            with open(args.model, "w") as f:
                f.write(model.to_json())
            print(*[f"{n:<18}{w:+.4f}" for n, w in model.explain()], sep="\n")
            return 0
        with open(args.model) as f:
            model = ranker.Ranker.from_json(f.read())
        scored = test.withColumn("score", model.score())
        if args.verb == "evaluate":
            learned = scored.select(F.lit("learned").alias("method"), "race_id", "fis_code", "pos", "score")
            elo = metrics.elo_scores(test, folds.ratings_before(races, res))
            print(metrics.format_comparison(metrics.pair_accuracy(metrics.baseline_scores(test).unionByName(learned).unionByName(elo), test), METHODS))
        else:
            profiles.race_payloads(scored).write.mode("overwrite").json(f"{args.out}/races")
            profiles.athlete_payloads(perf).write.mode("overwrite").json(f"{args.out}/athletes")
            profiles.athlete_index(perf, read("athletes")).orderBy(F.desc("wc_starts"), "name").coalesce(1).write.mode("overwrite").json(f"{args.out}/athlete_index")
            for name, files in (("races", profiles.race_csv(scored, races, read("athletes"))), ("athletes", profiles.athlete_csv(perf, races, read("athletes"))), ("weekends", profiles.weekend_csv(scored, races, read("athletes")))):
                files.write.mode("overwrite").parquet(f"{args.out}/csv/{name}")
            metrics.pair_accuracy(metrics.baseline_scores(test), test).coalesce(1).write.mode("overwrite").json(f"{args.out}/baselines")
            spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.out}/model")
            profiles.race_index(races, res, args.holdout).orderBy(F.desc_nulls_last("race_date"), F.desc("race_id")).coalesce(1).write.mode("overwrite").json(f"{args.out}/index")
    return 0


if __name__ == "__main__":
    sys.exit(main())
