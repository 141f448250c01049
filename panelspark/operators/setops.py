"""Unions, set differences and intersections over months, counts and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_blocks(*frames: DataFrame) -> DataFrame:
    """Stack area/block frames by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def fact_counts(**facts: DataFrame) -> DataFrame:
    counted = [f.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("fact"), "n_rows") for n, f in facts.items()]
    return union_blocks(*counted)


def month_domain(*facts: DataFrame) -> DataFrame:
    """Distinct months over all facts, each fact reduced to its months before the union."""
    months = [f.select("bulletin_date").distinct() for f in facts]
    return union_blocks(*months).distinct()


def missing_months(panel: DataFrame, by: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """Months inside a group's own range without a row, minus the allowed ones.

    Only the distinct (group, month) pairs travel; ``allowed`` is anti-joined on the month.
    """
    present = panel.select(*by, "bulletin_date").distinct()
    bounds = present.groupBy(*by).agg(F.min("bulletin_date").alias("_lo"), F.max("bulletin_date").alias("_hi"))
    expected = bounds.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias("bulletin_date"))
    out = expected.join(present, [*by, "bulletin_date"], "left_anti")
    if allowed is not None:
        # Distinct months: at most one row per calendar month.
        out = out.join(F.broadcast(allowed.select("bulletin_date").distinct()), "bulletin_date", "left_anti")
    return out.select(*by, "bulletin_date")


def common_dates(forecasts: DataFrame, key: list[str], models: int) -> DataFrame:
    """Dates that every one of ``models`` models forecasts, per series."""
    per_date = forecasts.groupBy(*key, "date").agg(F.countDistinct("model").alias("_n"))
    return per_date.filter(F.col("_n") == models).drop("_n")
