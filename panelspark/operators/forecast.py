"""Rolling-origin baselines as window lags, and the forecaster registry.

A forecast for month t made h months earlier only needs the level at t-h, so every origin of every
horizon is a lag on the dense grid: no refits, no exploded origins, one shuffle per series key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import HORIZONS, SERIES, Protocol
from panelspark.operators.series import densify, min_train, over_series, positions, split_regions

BASELINES = ("naive1", "seasonal", "drift")

Forecaster = Callable[..., DataFrame]
FORECASTERS: dict[str, Forecaster] = {}


def forecaster(name: str) -> Callable[[Forecaster], Forecaster]:
    """Register ``fn(obs, protocol) -> one-step long forecasts`` under ``name``."""

    def wrap(fn: Forecaster) -> Forecaster:
        FORECASTERS[name] = fn
        return fn

    return wrap


def at_horizon(h: int, season: int) -> dict[str, Column]:
    """The three baselines for a target ``h`` months after the origin, as columns of the target row."""
    w = over_series()
    level = F.lag("level", h).over(w)
    back = season * -(-h // season)
    first = F.first("level").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return {
        "naive1": level,
        "seasonal": F.lag("level", back).over(w),
        "drift": level + h * (level - first) / F.nullif(F.col("pos") - h - 1, F.lit(0)),
    }


def rolling_baselines(
    obs: DataFrame, horizons: tuple[int, ...] = HORIZONS, protocol: Protocol = Protocol()
) -> DataFrame:
    """Long forecasts (model, series, h, date, forecast, actual) of observed targets over all origins."""
    return rolling(positions(densify(obs)), horizons, protocol, lambda h: at_horizon(h, protocol.season))


def rolling(
    grid: DataFrame, horizons: tuple[int, ...], protocol: Protocol, values: Callable[[int], dict[str, Column]]
) -> DataFrame:
    """Forecasts at all horizons from columns of the target row: ``values(h)`` gives one for each model.

    The origin has at least the minimum training length and the longest feasible horizon of the
    series fits behind it, so all horizons of a series share their origins.
    """
    grid = grid.withColumn("_min", min_train(protocol))
    reach = F.least(F.lit(max(horizons)), F.col("n_grid") - F.col("_min"))
    rows = []
    for h in horizons:
        origin = F.col("pos") - h
        valid = (origin >= F.col("_min")) & (origin <= F.col("n_grid") - reach) & (F.lit(h) <= reach)
        rows += [
            F.struct(F.lit(m).alias("model"), F.lit(h).alias("h"), F.when(valid, value).alias("forecast"))
            for m, value in values(h).items()
        ]
    return (
        grid.withColumn("_rows", F.array(*rows))
        .filter(F.col("y").isNotNull())
        .select(*SERIES, F.col("bulletin_date").alias("date"), F.col("y").alias("actual"), F.inline("_rows"))
        .filter(F.col("forecast").isNotNull())
    )


def one_step(obs: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """One-step baseline forecasts of every month after the minimum training length.

    Wide rows on the dense grid: ``y`` is NULL on months that are never scored, ``region`` tells
    selection from hold-out. Series too short for hold-out plus buffer are left out.
    """
    values = at_horizon(1, protocol.season)
    return (
        split_regions(densify(obs), protocol)
        .withColumns({m: values[m] for m in BASELINES})
        .filter(F.col("n_grid") >= min_train(protocol) + protocol.holdout + protocol.buffer)
        .filter(F.col("region") != "train")
        .select(*SERIES, "bulletin_date", "y", "level", "pos", "n_grid", "hold_start", "region", *BASELINES)
    )


def melt_models(wide: DataFrame, models: tuple[str, ...], keep: list[str]) -> DataFrame:
    """One row per model; inlining structs keeps the partitioning of the wide frame."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("forecast")) for m in models])
    return wide.select(*keep, F.inline(rows))


def one_step_long(obs: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    keep = [*SERIES, "bulletin_date", "y", "hold_start", "region"]
    return melt_models(one_step(obs, protocol), BASELINES, keep)


def combine(forecasts: DataFrame, key: list[str], agg: str = "median", models: tuple[str, ...] | None = None) -> DataFrame:
    """Mean or median over the models of each key; only dates every model covers when ``models`` is given."""
    df = forecasts if models is None else forecasts.filter(F.col("model").isin(*models))
    point = F.median("forecast") if agg == "median" else F.avg("forecast")
    out = df.groupBy(*key).agg(point.alias("forecast"), F.count("forecast").alias("n_models"))
    return out if models is None else out.filter(F.col("n_models") == len(models))


def combine_seeds(forecasts: DataFrame, key: list[str], agg: str = "median") -> DataFrame:
    """Median over the seeds of each model first, then over models."""
    per_model = forecasts.groupBy(*key, "model").agg(F.median("forecast").alias("forecast"))
    return combine(per_model, key, agg)


def future_baselines(obs: DataFrame, horizon: int = 12, protocol: Protocol = Protocol()) -> DataFrame:
    """Baselines ``horizon`` months past the last grid month of each series, in long form."""
    w = over_series()
    season = protocol.season
    grid = positions(densify(obs))
    last_year = F.collect_list("level").over(w.rowsBetween(-(season - 1), 0))
    first = F.first("level").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = grid.withColumns({"_year": last_year, "_first": first}).filter(F.col("pos") == F.col("n_grid"))
    rows = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    same_phase = F.get(F.col("_year"), F.pmod(F.col("h") - 1, F.lit(season)))
    wide = rows.select(
        *SERIES,
        F.col("bulletin_date").alias("origin_date"),
        "h",
        F.add_months("bulletin_date", F.col("h")).alias("date"),
        F.col("level").alias("naive1"),
        F.when(F.size("_year") == season, same_phase).alias("seasonal"),
        (F.col("level") + F.col("h") * (F.col("level") - F.col("_first")) / F.nullif(F.col("n_grid") - 1, F.lit(0))).alias("drift"),
    )
    return melt_models(wide, BASELINES, [*SERIES, "origin_date", "h", "date"])


@forecaster("naive1")
def _naive1(obs: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    return one_step_long(obs, protocol).filter(F.col("model") == "naive1")


@forecaster("seasonal")
def _seasonal(obs: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    return one_step_long(obs, protocol).filter(F.col("model") == "seasonal")


@forecaster("drift")
def _drift(obs: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    return one_step_long(obs, protocol).filter(F.col("model") == "drift")
