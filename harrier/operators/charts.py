"""Curves of many athletes on shared axes: where each point lies, and what the axes are marked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places that the upright axis is marked with.
TICKS = (1, 5, 10, 20, 30, 50, 100)


def axes(points: DataFrame, value: str = "rank") -> DataFrame:
    """chart, race_date, x, worst, year of each day on which any athlete of a chart (``points.chart``) has a point.

    Days are equally far apart, whatever lies between them: x goes from 0 to 1, and a single day is in the middle. worst
    is the chart's largest value, rounded up to tens. year is set where a day is the chart's first or of another year than
    the day before. Points without a day or value have no place. Points become a row a day before any window, so that a
    chart of many athletes is no larger than the calendar.
    """
    days = points.where(F.col("race_date").isNotNull() & F.col(value).isNotNull()).groupBy("chart", "race_date").agg(F.max(value).alias("largest"))
    chart = Window.partitionBy("chart")
    by = chart.orderBy("race_date")
    n, year = F.count("*").over(chart), F.year("race_date")
    x = F.when(n < 2, 0.5).otherwise((F.row_number().over(by) - 1) / (n - 1))
    worst = (F.ceil(F.greatest(F.max("largest").over(chart), F.lit(1)) / 10) * 10).cast("int")
    return days.select("chart", "race_date", x.alias("x"), worst.alias("worst"), F.when(~F.lag(year).over(by).eqNullSafe(year), year).alias("year"))


def _height(value):
    return (value - 1) / (F.col("worst") - 1)


def curves(points: DataFrame, value: str = "rank") -> DataFrame:
    """``points`` with x and y on their chart's axes. y is 0 at the top, for a value of 1, and 1 for the chart's worst."""
    return points.join(axes(points, value).select("chart", "race_date", "x", "worst"), ["chart", "race_date"]).where(F.col(value).isNotNull()).withColumn("y", _height(F.col(value))).drop("worst")


def ticks(points: DataFrame, value: str = "rank") -> DataFrame:
    """chart, tick, y: the fixed places up to the chart's worst, and the worst itself."""
    worst = axes(points, value).groupBy("chart").agg(F.max("worst").alias("worst"))
    marked = F.array_distinct(F.concat(F.filter(F.array(*map(F.lit, TICKS)), lambda t: t <= F.col("worst")), F.array("worst")))
    return worst.select("chart", "worst", F.explode(marked).alias("tick")).select("chart", "tick", _height(F.col("tick")).alias("y"))
