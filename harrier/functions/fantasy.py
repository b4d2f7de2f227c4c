"""Points and prices of a fantasy game, and the best team for a budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
WORLD_CUP_POINTS = (100, 80, 60, 50, 45, 40, 36, 32, 29, 26, 24, 22, 20, 18, 16, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1)
BUDGET, MOST_MEN, MOST_WOMEN = 200, 8, 8


def payout(place: Column, scheme: str = "worldcup") -> Column:
    """Points of a place by scheme; 0 beyond the places that it pays."""
    rules = {
        "worldcup": (len(WORLD_CUP_POINTS), F.get(F.array(*map(F.lit, WORLD_CUP_POINTS)), place.cast("int") - 1)),
        "decay": (30, F.floor(100 * F.pow(F.lit(0.93), place - 1) + 0.5)),
        "deep": (50, F.greatest(F.lit(1), 60 - place)),
        "podium": (10, F.floor(120 * F.pow(F.lit(0.75), place - 1) + 0.5)),
    }
    last, points = rules[scheme]
    return F.when((place >= 1) & (place <= last), points).otherwise(0).cast("int")


def price(rank: Column, n: Column) -> Column:
    share = 1 - (rank - 1) / F.greatest(F.lit(1), n - 1)
    return F.greatest(F.lit(1), F.floor(3 + 27 * F.pow(F.greatest(share, F.lit(0.0)), 2.2) + 0.5)).cast("int")


def best_team(pdf: pd.DataFrame, budget: int = BUDGET, men: int = MOST_MEN, women: int = MOST_WOMEN) -> list[int]:
    """Row numbers of the team with the most points: at most so many of each gender and so much money.

    States are (money, men, women); each keeps its value and its team.
    """
    best: dict[tuple[int, int, int], tuple[float, tuple[int, ...]]] = {(0, 0, 0): (0.0, ())}
    for i, r in enumerate(pdf.itertuples()):
        for (c, m, w), (value, team) in list(best.items()):
            key = (c + int(r.price), m + (r.gender == "M"), w + (r.gender == "W"))
            if r.points > 0 and key[0] <= budget and key[1] <= men and key[2] <= women and best.get(key, (-1.0,))[0] < value + r.points:
                best[key] = (value + r.points, (*team, i))
    return list(max(best.values(), key=lambda x: x[0])[1])


def teams(market: DataFrame, game: str = "game", budget: int = BUDGET, men: int = MOST_MEN, women: int = MOST_WOMEN) -> DataFrame:
    """The best team of each game. A game's market is one field of starters."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fis_code", ignore_index=True)
        return pdf.iloc[best_team(pdf, budget, men, women)][[game, "fis_code", "gender", "points", "price"]]

    kinds = dict(market.dtypes)
    schema = f"{game} {kinds[game]}, fis_code string, gender string, points {kinds['points']}, price {kinds['price']}"
    return market.groupBy(game).applyInPandas(solve, schema)


def cost_of_forcing(pdf: pd.DataFrame, fis_code: str, budget: int = BUDGET, men: int = MOST_MEN, women: int = MOST_WOMEN) -> float | None:
    """Points lost if a starter must be in the team; None if no such team can be paid."""
    free = pdf.iloc[best_team(pdf, budget, men, women)].points.sum()
    one = pdf[pdf.fis_code == fis_code]
    if one.empty or one.price.iloc[0] > budget:
        return None
    r = one.iloc[0]
    left = (men - (r.gender == "M"), women - (r.gender == "W"))
    if min(left) < 0:
        return None
    rest = pdf[pdf.fis_code != fis_code]
    return float(free - r.points - rest.iloc[best_team(rest, budget - int(r.price), *left)].points.sum())


def forcing_costs(market: DataFrame, budget: int = BUDGET, men: int = MOST_MEN, women: int = MOST_WOMEN) -> DataFrame:
    """game, fis_code, cost: how many points the best team of a game loses if it must have that starter; null if it can't.

    Not two solutions a starter: the best values of all others are found for all of them together, by halves. A table of values by
    money, men and women takes in one half before the other is looked at, so each starter is taken in once a level.
    A game's rows (game, fis_code, gender, points, price) are one group, a race's starters.
    """

    def costs(rows: pd.DataFrame) -> pd.DataFrame:
        price, points = rows.price.to_numpy(int), rows.points.to_numpy(float)
        is_man, is_woman = (rows.gender == "M").to_numpy(int), (rows.gender == "W").to_numpy(int)
        rest = np.full(len(rows), -np.inf)

        def more(best: np.ndarray, some: range) -> np.ndarray:
            best = best.copy()
            for i in some:
                c, m, w = price[i], is_man[i], is_woman[i]
                if points[i] > 0 and c <= budget and m <= men and w <= women:
                    with_it = best[: budget + 1 - c, : men + 1 - m, : women + 1 - w] + points[i]
                    best[c:, m:, w:] = np.maximum(best[c:, m:, w:], with_it)
            return best

        def halves(lo: int, hi: int, best: np.ndarray) -> None:
            if hi - lo == 1:
                left = (budget - price[lo], men - is_man[lo], women - is_woman[lo])
                if min(left) >= 0:
                    rest[lo] = best[left]
                return
            mid = (lo + hi) // 2
            halves(lo, mid, more(best, range(mid, hi)))
            halves(mid, hi, more(best, range(lo, mid)))

        nothing = np.zeros((budget + 1, men + 1, women + 1))
        halves(0, len(rows), nothing)
        free = more(nothing, range(len(rows)))[budget, men, women]
        cost = np.where(np.isfinite(rest), free - (rest + points), np.nan)
        return pd.DataFrame({"game": rows.game.to_numpy(), "fis_code": rows.fis_code.to_numpy(), "cost": cost})

    game = dict(market.dtypes)["game"]
    return market.groupBy("game").applyInPandas(costs, f"game {game}, fis_code string, cost double").withColumn("cost", F.nanvl("cost", F.lit(None).cast("double")))
