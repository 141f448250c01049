"""Band scales, adaptive and quantile-regression conformal corrections, coverage intervals, coherence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import (
    ACI_GAMMAS,
    ALPHA,
    BAND80_RATIO,
    MIN_CELL_N,
    SMALL_N,
    WORLD,
)
from panelspark.functions.special import jeffreys
from panelspark.operators.metrics import conformal_rank
from panelspark.operators.quantiles import higher_rank, order_statistic

LEVELS = (80, 95)
BANDS = ("lo80", "hi80", "lo95", "hi95")


def _jeffreys_bounds(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    pairs = [jeffreys(int(a), int(b)) if b and b > 0 else (None, None) for a, b in zip(k, n, strict=True)]
    return pd.DataFrame(pairs, columns=["lo", "hi"], dtype="float64")


def coverage_ci(k: Column, n: Column) -> Column:
    """Jeffreys interval as a struct (lo, hi); meant for aggregated rows, one call per row."""
    fn = F.pandas_udf(_jeffreys_bounds, "lo double, hi double")
    return fn(k, n)


def with_coverage_ci(df: DataFrame, k: str, n: str, prefix: str) -> DataFrame:
    return (
        df.withColumn("_ci", coverage_ci(F.col(k), F.col(n)))
        .withColumns({f"{prefix}_lo": F.round("_ci.lo", 6), f"{prefix}_hi": F.round("_ci.hi", 6)})
        .drop("_ci")
    )


def standardized_errors(scored: DataFrame) -> DataFrame:
    """|error| over the one-step half-width: undoes the sqrt(h) growth the bands were frozen with.

    Rows whose bands were already scaled per horizon must not enter; only ``sqrt_h`` rows do.
    """
    half = (F.col("hi95") - F.col("lo95")) / 2.0 / F.sqrt("h")
    rows = scored.filter(F.col("actual").isNotNull() & (half > 0))
    if "band_method" in scored.columns:
        rows = rows.filter(F.col("band_method").isNull() | F.col("band_method").startswith("sqrt"))
    return rows.withColumn("std", F.abs(F.col("pred") - F.col("actual")) / half)


def band_scales(errors: DataFrame, min_cell_n: int = MIN_CELL_N) -> DataFrame:
    """Band scale per (table, level, h): a "higher" order statistic, floored and monotone in h.

    A (table, h) cell pools every series, so its quantile comes from the distributed order statistic.
    """
    ranks = {f"q{lv}": higher_rank(lv / 100.0) for lv in LEVELS}
    cells = order_statistic(errors, ["table", "h"], "std", ranks)
    rows = F.array(
        *[
            F.struct(F.lit(lv).alias("level"), F.col(f"q{lv}").alias("q"), F.lit(min_cell_n * (2 if lv >= 95 else 1)).alias("_floor"))
            for lv in LEVELS
        ]
    )
    up_to_h = Window.partitionBy("table", "level").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    floored = F.when(F.col("h") == 1, F.greatest("q", F.lit(1.0))).otherwise(F.col("q"))
    return (
        cells.select("table", "h", "n", F.inline(rows))
        .filter(F.col("n") >= F.col("_floor"))
        .select("table", "level", "h", "n", F.round(F.max(floored).over(up_to_h), 4).alias("scale"))
    )


def pivot_scales(scales: DataFrame) -> DataFrame:
    """One row per (table, h) with both levels, NULL where a level has no cell."""
    return scales.groupBy("table", "h").agg(
        *[F.max(F.when(F.col("level") == lv, F.col("scale"))).alias(f"q{lv}") for lv in LEVELS]
    )


def band_halves(half: Column, h: Column, q80: Column | None = None, q95: Column | None = None) -> dict[str, Column]:
    """Half-widths at horizon ``h``: calibrated scales when both exist, else sqrt(h) growth."""
    grow = F.sqrt(h.cast("double"))
    if q80 is None or q95 is None:
        return {"half80": half * F.lit(BAND80_RATIO) * grow, "half95": half * grow, "band_method": F.lit("sqrt_h")}
    ok = q80.isNotNull() & q95.isNotNull()
    return {
        "half80": F.when(ok, half * q80).otherwise(half * F.lit(BAND80_RATIO) * grow),
        "half95": F.when(ok, half * q95).otherwise(half * grow),
        "band_method": F.when(ok, "q_h").otherwise("sqrt_h"),
    }


def bands(points: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """Adds ``half80``, ``half95`` and ``band_method`` to rows with ``table``, ``h`` and one-step ``half``."""
    if scales is None:
        return points.withColumns(band_halves(F.col("half"), F.col("h")))
    # At most tables x horizons rows.
    wide = F.broadcast(pivot_scales(scales))
    joined = points.join(wide, ["table", "h"], "left")
    return joined.withColumns(band_halves(F.col("half"), F.col("h"), F.col("q80"), F.col("q95"))).drop("q80", "q95")


def validate_scales(errors: DataFrame, scales: DataFrame) -> DataFrame:
    """Held-out coverage of the calibrated scales per (table, level), with its interval and n."""
    hits = (
        errors.join(F.broadcast(scales.select("table", "level", "h", "scale")), ["table", "h"])
        .groupBy("table", "level")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("std") <= F.col("scale")).alias("k"))
    )
    out = hits.withColumn("coverage", F.round(F.col("k") / F.col("n"), 6)).withColumn(
        "insufficient_n", F.col("n") < SMALL_N
    )
    return with_coverage_ci(out, "k", "n", "ci")


def aci_alpha(scorecard: DataFrame, by: list[str], alpha0: float = ALPHA, gamma: float = 0.05, min_hits: int = 0) -> DataFrame:
    """Miscoverage level after the online updates; the replay is a sum, clamped once at the end."""
    step = F.sum(F.lit(alpha0) - F.when(F.col("in95") == 1, 0.0).otherwise(1.0))
    n = F.count(F.lit(1))
    value = F.least(F.greatest(F.lit(alpha0) + F.lit(gamma) * step, F.lit(1e-3)), F.lit(0.999))
    return scorecard.groupBy(*by).agg(
        n.alias("n_hits"), F.when(n >= min_hits, value).otherwise(F.lit(alpha0)).alias("alpha_eff")
    )


def aci_path(scorecard: DataFrame, by: list[str], order: list[str], alpha0: float = ALPHA, gamma: float = 0.05) -> DataFrame:
    """The level in force before and after each scored row, as a running sum in time order."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.lit(alpha0) - F.when(F.col("in95") == 1, 0.0).otherwise(1.0)
    after = F.lit(alpha0) + F.lit(gamma) * F.sum(step).over(w)
    return scorecard.withColumn("alpha_after", after)


def _replay(residuals: list[np.ndarray], share: float, alpha: float, gammas: tuple[float, ...]) -> list[list[dict]]:
    """Hits and total width of every series at every step size under quantile feedback, for a batch of series at a time.

    The pool of a month is the sorted errors before it, the same for every step size; only the level differs.
    """
    sizes = np.array([len(r) for r in residuals], dtype=np.int64)
    cuts = np.maximum(1, (sizes * share + 1e-9).astype(np.int64))
    errors = np.full((len(sizes), sizes.max(initial=0)), np.inf)
    for row, r in zip(errors, residuals, strict=True):
        row[: len(r)] = np.abs(r)
    steps = np.array(gammas)
    level = np.full((len(sizes), len(steps)), alpha)
    hits, width = np.zeros(level.shape, np.int64), np.zeros(level.shape)
    for month in range(1, errors.shape[1]):
        rows = np.flatnonzero((cuts <= month) & (month < sizes))
        if not len(rows):
            continue
        pool = np.sort(errors[rows, :month], axis=1)
        q = 1.0 - np.clip(level[rows], 1e-3, 0.999)
        half = np.take_along_axis(pool, np.ceil(np.round(q * (month - 1), 9)).astype(np.int64), axis=1)
        hit = errors[rows, month, None] <= half
        hits[rows] += hit
        width[rows] += 2.0 * half
        level[rows] += steps * (alpha - np.where(hit, 0.0, 1.0))
    online = (sizes - cuts).tolist()
    return [
        [{"gamma": g, "n": n, "hits": h, "width": w} for g, h, w in zip(gammas, hs, ws, strict=True)] if n > 0 else []
        for n, hs, ws in zip(online, hits.tolist(), width.tolist(), strict=True)
    ]


def aci_replay(
    residuals: DataFrame, by: list[str], calibration_share: float = 2.0 / 3.0, alpha: float = ALPHA, gammas: tuple[float, ...] = ACI_GAMMAS
) -> DataFrame:
    """Adaptive conformal replay per series and step size: n, hits and mean width.

    ``residuals`` has ``date`` and ``resid`` per series. The pool grows with each scored month, so a
    series is sequential by nature; Spark spreads the series, each bounded by the calendar, and a task takes them in batches.
    """
    kind = "array<struct<gamma: double, n: bigint, hits: bigint, width: double>>"
    # plain series are what a batch is replayed from
    replay = F.pandas_udf(lambda r: pd.Series(_replay(list(r), calibration_share, alpha, gammas), dtype="object"), kind)
    ordered = F.sort_array(F.collect_list(F.struct("date", "resid")))
    series = residuals.filter(F.col("resid").isNotNull()).select(*by, "date", "resid").groupBy(*by).agg(ordered.alias("_r"))
    return series.select(*by, replay(F.transform("_r", lambda e: e["resid"].cast("double"))).alias("_runs")).select(*by, F.inline("_runs"))


def select_gamma(replay: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """Step size whose pooled coverage is closest to nominal, then the narrowest."""
    pooled = replay.groupBy(*by, "gamma").agg(
        (F.sum("hits") / F.sum("n")).alias("coverage"), (F.sum("width") / F.sum("n")).alias("mean_width")
    )
    gap = F.round(F.abs(F.col("coverage") - (1 - alpha)), 12)
    order = F.struct(gap, F.col("mean_width"), F.col("gamma"))
    return pooled.groupBy(*by).agg(
        F.min_by("gamma", order).alias("gamma"),
        F.min_by("coverage", order).alias("coverage"),
        F.min_by("mean_width", order).alias("mean_width"),
    )


def cqr(rows: DataFrame, by: list[str], calibration: int | float, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Conformalised quantile bands: the first rows of each series calibrate, the rest are widened.

    ``calibration`` is a number of rows, or, below one, the part of a series' rows (rounded down). ``rows`` has ``date``,
    ``y`` and ``lo{level}``/``hi{level}``; each level gets its own order statistic.
    """
    own = Window.partitionBy(*by)
    df = rows.withColumn("_pos", F.row_number().over(own.orderBy("date")))
    first = F.lit(calibration) if calibration >= 1 else F.floor(F.round(F.count(F.lit(1)).over(own) * calibration, 9))
    cal = F.col("_pos") <= first
    df = df.withColumn("_n", F.count_if(cal).over(own)).withColumn("_cal", cal)
    for lv in levels:
        lo, hi = F.col(f"lo{lv}"), F.col(f"hi{lv}")
        score = F.greatest(lo - F.col("y"), F.col("y") - hi)
        rank = F.row_number().over(Window.partitionBy(*by, "_cal").orderBy(score))
        wanted = conformal_rank(F.col("_n"), 1.0 - lv / 100.0)
        df = (
            df.withColumn("_rank", rank)
            .withColumn("_q", F.max(F.when(F.col("_cal") & (F.col("_rank") == wanted), score)).over(own))
            .withColumns({f"lo{lv}": lo - F.col("_q"), f"hi{lv}": hi + F.col("_q"), f"shift{lv}": F.col("_q")})
        )
    return df.filter(~F.col("_cal")).drop("_pos", "_n", "_cal", "_rank", "_q")


def _shifted(df: DataFrame, new: Column) -> DataFrame:
    """Sets ``days`` and moves every band by the same amount."""
    out = df.withColumn("_delta", new - F.col("days"))
    return out.withColumns({c: F.col(c) + F.col("_delta") for c in BANDS}).withColumn("days", new).drop("_delta")


def cap_by_world(forecasts: DataFrame, extra: list[str] | None = None, world: str = WORLD) -> DataFrame:
    """No area runs ahead of the world series of the same category, table and date.

    The world side holds one row per origin, category, table and date: calendar times code lists times
    horizon, some hundred thousand rows at the very most and independent of the number of areas, hence
    the broadcast.
    """
    key = [*(extra or []), "block", "category", "table", "date"]
    ref = forecasts.filter(F.col("country") == world).select(*key, F.col("days").alias("_world"))
    capped = forecasts.join(F.broadcast(ref), key, "left").withColumn(
        "capped", F.coalesce((F.col("country") != world) & (F.col("days") > F.col("_world")), F.lit(False))
    )
    return _shifted(capped, F.when(F.col("capped"), F.col("_world")).otherwise(F.col("days"))).drop("_world")


def order_tables(forecasts: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """FAD never exceeds DFF: a crossing pair swaps to (min, max).

    Both tables of a key meet in one window of at most two rows instead of a self-join.
    """
    w = Window.partitionBy("country", "category", "block", *(extra or []), "date")
    fad = F.max(F.when(F.col("table") == "FAD", F.col("days"))).over(w)
    dff = F.max(F.when(F.col("table") == "DFF", F.col("days"))).over(w)
    df = forecasts.withColumns({"_fad": fad, "_dff": dff}).withColumn(
        "swapped", F.coalesce(F.col("_fad") > F.col("_dff"), F.lit(False))
    )
    new = F.when(F.col("swapped"), F.when(F.col("table") == "FAD", F.col("_dff")).otherwise(F.col("_fad")))
    return _shifted(df, new.otherwise(F.col("days"))).drop("_fad", "_dff")


def project_cone(forecasts: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """World cap, then table order; ``capped`` and ``swapped`` tell which rows moved."""
    return order_tables(cap_by_world(forecasts, extra), extra)


def cone_violations(forecasts: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Counts of rows above the world series and of crossing (FAD, DFF) pairs."""
    above = cap_by_world(forecasts, extra).agg(F.count_if("capped").alias("n")).select(
        F.lit("area_le_world").alias("constraint"), "n"
    )
    crossing = order_tables(forecasts, extra).agg(F.count_if(F.col("swapped") & (F.col("table") == "FAD")).alias("n"))
    return above.unionByName(crossing.select(F.lit("fad_le_dff").alias("constraint"), "n"))
