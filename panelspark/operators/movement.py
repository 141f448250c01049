"""Month-over-month movement of published cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import BIG_JUMP_YEARS, DATA_K, DATA_MIN_FLAGGED, DAYS_PER_YEAR, SERIES
from panelspark.operators.series import difference, over_series, whole_series


def retro_events(obs: DataFrame) -> DataFrame:
    """Observed rows that moved backward, with the size of the step in days."""
    return (
        difference(obs)
        .filter(F.col("delta") < 0)
        .select(*SERIES, "bulletin_date", (-F.col("delta")).cast("bigint").alias("days"))
    )


def big_jumps(obs: DataFrame, years: float = BIG_JUMP_YEARS) -> DataFrame:
    step = F.col("delta") / F.lit(DAYS_PER_YEAR)
    return (
        difference(obs)
        .filter(F.abs(step) > years)
        .select(*SERIES, "bulletin_date", F.round(step, 4).alias("delta_years"))
    )


def movement_class(panel: DataFrame) -> DataFrame:
    """Class of every (series, calendar month): absent, advance, frozen, retro, current or other.

    The calendar is the panel's own month range; each series is expanded over it once.
    """
    bounds = panel.agg(F.min("bulletin_date").alias("lo"), F.max("bulletin_date").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    w = over_series()
    delta = F.col("days_since_base") - F.lag("days_since_base").over(w)
    prev, nxt = F.lag("bulletin_date").over(w), F.lead("bulletin_date").over(w)
    start = F.when(F.col("_prev").isNull(), lo).otherwise(F.col("bulletin_date"))
    end = F.when(F.col("_next").isNull(), hi).otherwise(F.add_months("_next", -1))
    label = (
        F.when(F.col("_month") != F.col("bulletin_date"), "absent")
        .when((F.col("status") == "F") & (F.col("_delta") < 0), "retro")
        .when((F.col("status") == "F") & (F.col("_delta") == 0), "frozen")
        .when(F.col("status") == "F", "advance")
        .when(F.col("status") == "C", "current")
        .otherwise("other")
    )
    return (
        panel.withColumns({"_delta": delta, "_prev": prev, "_next": nxt})
        .withColumn("_month", F.explode(F.sequence(start, end, F.expr("interval 1 month"))))
        .select(*SERIES, F.col("_month").alias("bulletin_date"), label.alias("movement"))
    )


def bulletin_feed(panel: DataFrame, months: int = 24) -> DataFrame:
    """Rows of the last ``months`` published months with the F-to-F step from the previous published month.

    The predecessor of the first month of the window is still used. A series' previous row counts
    only when it sits in the previous *published* month, so no self-join is needed.
    """
    calendar = panel.select("bulletin_date").distinct()
    by_month = Window.partitionBy(F.lit(0)).orderBy("bulletin_date")
    newest = Window.partitionBy(F.lit(0)).orderBy(F.col("bulletin_date").desc())
    calendar = calendar.select(
        "bulletin_date",
        F.lag("bulletin_date").over(by_month).alias("_prev_month"),
        F.row_number().over(newest).alias("_age"),
    ).filter(F.col("_age") <= months)
    w = over_series()
    both = (F.lag("status").over(w) == "F") & (F.col("status") == "F")
    step = F.when(both, F.datediff("priority_date", F.lag("priority_date").over(w)))
    return (
        panel.withColumns({"_step": step, "_prev": F.lag("bulletin_date").over(w)})
        .join(F.broadcast(calendar), "bulletin_date")  # at most ``months`` rows
        .select(
            *SERIES,
            "bulletin_date",
            "status",
            "raw_value",
            "priority_date",
            F.when(F.col("_prev") == F.col("_prev_month"), F.col("_step")).cast("double").alias("delta_days"),
        )
    )


def data_drift(obs: DataFrame, k: float = DATA_K, min_rows: int = 12, min_deltas: int = 6) -> DataFrame:
    """Series whose newest step is further than ``k`` MADs from its own median step.

    Only series observed in the newest month of the panel are candidates.
    """
    newest = obs.agg(F.max("bulletin_date")).scalar()
    whole = whole_series()
    tagged = (
        difference(obs)
        .withColumn("_last", F.max("bulletin_date").over(whole))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .filter((F.col("_last") == newest) & (F.col("_n") >= min_rows))
        .withColumn("_hist", F.when(F.col("bulletin_date") < F.col("_last"), F.col("delta")))
        .withColumn("_med", F.median("_hist").over(whole))
        .withColumn("_mad", F.median(F.abs(F.col("_hist") - F.col("_med"))).over(whole))
        .withColumn("_nd", F.count("delta").over(whole))
    )
    return tagged.filter(
        (F.col("bulletin_date") == F.col("_last"))
        & (F.col("_nd") >= min_deltas)
        & (F.col("_mad") > 0)
        & (F.abs(F.col("delta") - F.col("_med")) > k * F.col("_mad"))
    ).select(
        *SERIES,
        F.col("delta").cast("bigint").alias("delta_days"),
        F.col("_med").alias("hist_median_delta"),
        F.col("_mad").alias("mad"),
    )


def systemic_drift(flagged: DataFrame, min_flagged: int = DATA_MIN_FLAGGED) -> DataFrame:
    """One row: how many series drifted, and whether so many that the source itself must have changed."""
    n = F.count(F.lit(1))
    return flagged.agg(n.alias("n_flagged"), F.countDistinct("country").alias("n_areas"), (n >= min_flagged).alias("data_drift"))
