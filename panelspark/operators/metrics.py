"""Scales, point, interval and distribution scores.

Only observed months are scored, and a degenerate scale is NULL, never one. Errors and their
residual ranks stay inside (series, model) groups, which the calendar bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import ALPHA, QUANTILE_LEVELS, SEASON, SERIES, Protocol
from panelspark.functions.cells import month_index
from panelspark.operators.series import cluster, densify, look_up, over_series, whole_series


def _naive_diffs(m: int) -> dict[str, Column]:
    w = over_series()
    y = F.col("y")
    return {"_dm": F.abs(y - F.lag("y", m).over(w)), "_d1": F.abs(y - F.lag("y", 1).over(w))}


def _scale(n: Column, mean_m: Column, mean_1: Column, m: int) -> Column:
    return F.nullif(F.when(n > m, mean_m).otherwise(mean_1), F.lit(0.0))


def naive_scale(obs: DataFrame, m: int = SEASON) -> DataFrame:
    """Mean absolute seasonal step of each series over observed rows, lagged by position."""
    return (
        obs.withColumns(_naive_diffs(m))
        .groupBy(*SERIES)
        .agg(
            F.count(F.lit(1)).alias("n"),
            _scale(F.count(F.lit(1)), F.avg("_dm"), F.avg("_d1"), m).alias("scale"),
        )
    )


def with_scale_before(rows: DataFrame, obs: DataFrame, cutoff: str, m: int = SEASON) -> DataFrame:
    """``rows`` with ``n_history`` and ``scale`` of the history of their series strictly before their ``cutoff``.

    The running means of a series are one array by month, bounded by the calendar, so a row finds those of the last observation
    before it by position: a range join without the join. Rows are neither sorted nor, once dealt out by area and category, moved.
    """
    run = over_series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count(F.lit(1)).over(run)
    prefix = cluster(obs).withColumns(_naive_diffs(m)).withColumn(
        "_stat",
        F.struct(
            F.col("bulletin_date").alias("at"), n.alias("n"), _scale(n, F.avg("_dm").over(run), F.avg("_d1").over(run), m).alias("scale")
        ),
    )
    month = F.struct(month_index(F.col("bulletin_date")).alias("month"), F.col("_stat").alias("stat"))
    history = densify(prefix, "_stat").groupBy(*SERIES).agg(F.sort_array(F.collect_list(month)).alias("_months"))
    first = F.get("_months", F.lit(0))["month"].alias("first")
    history = history.select(*SERIES, F.struct(first, F.transform("_months", lambda e: e["stat"]).alias("stats")).alias("_history"))
    found = look_up(rows, history, "_history")
    # the last month that can lie before the cutoff; after the end of the series its last month stands
    stats = F.col("_history.stats")
    at = F.least(month_index(F.date_sub(cutoff, 1)) - F.col("_history.first"), F.size(stats) - 1)
    here = F.get(stats, at)
    known = F.when(here["at"] < F.col(cutoff), here).otherwise(F.get(stats, at - 1))
    rest = [c for c in rows.columns if c not in SERIES]
    return found.select(*SERIES, *rest, known.alias("_s")).select(
        *SERIES, *rest, F.coalesce(F.col("_s.n"), F.lit(0)).alias("n_history"), F.col("_s.scale").alias("scale")
    )


def scale_before(obs: DataFrame, cutoffs: DataFrame, m: int = SEASON) -> DataFrame:
    """Scale of the history strictly before each (series, cutoff)."""
    return with_scale_before(cutoffs.select(*SERIES, "cutoff").distinct(), obs, "cutoff", m)


def holdout_scale(obs: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """Seasonal and lag-one scale before each series' own hold-out start, in one shuffle."""
    m = protocol.season
    start = F.add_months(F.max("bulletin_date").over(whole_series()), -(protocol.holdout - 1))
    before = F.col("bulletin_date") < F.col("hold_start")
    n = F.count_if(before)
    return (
        obs.withColumns(_naive_diffs(m))
        .withColumn("hold_start", start)
        .groupBy(*SERIES, "hold_start")
        .agg(
            _scale(n, F.avg(F.when(before, F.col("_dm"))), F.avg(F.when(before, F.col("_d1"))), m).alias("scale"),
            F.nullif(F.avg(F.when(before, F.col("_d1"))), F.lit(0.0)).alias("scale1"),
        )
    )


def mask_observed(forecasts: DataFrame, obs: DataFrame, date: str = "date") -> DataFrame:
    """Forecast rows whose month was really observed."""
    seen = obs.select(*SERIES, F.col("bulletin_date").alias(date))
    return forecasts.join(seen, [*SERIES, date], "left_semi")


def error_aggregates(err: Column, actual: Column, forecast: Column) -> dict[str, Column]:
    return {
        "n": F.count(err),
        "mae": F.avg(F.abs(err)),
        "rmse": F.sqrt(F.avg(err * err)),
        "smape": 200.0 * F.avg(F.abs(err) / (F.abs(actual) + F.abs(forecast) + 1e-9)),
    }


def point_metrics(scored: DataFrame, scales: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE, sMAPE (0-200), MASE against the seasonal and the lag-one naive."""
    err = F.col("y") - F.col("forecast")
    agg = scored.filter(F.col("y").isNotNull()).groupBy(*by).agg(
        *[c.alias(n) for n, c in error_aggregates(err, F.col("y"), F.col("forecast")).items()]
    )
    return (
        agg.join(scales.select(*SERIES, "scale", "scale1"), SERIES, "left")
        .withColumn("mase", F.col("mae") / F.col("scale"))
        .withColumn("mase1", F.col("mae") / F.col("scale1"))
        .drop("scale", "scale1")
    )


def mase_by_series(forecasts: DataFrame, obs: DataFrame, by: list[str] | None = None, min_points: int = 1) -> DataFrame:
    """Scaled error per series: observed dates only, scale from before the first scored date.

    ``forecasts`` carries the series key, ``date`` and ``forecast`` (plus ``by`` columns).
    """
    by = by or []
    actual = obs.select(*SERIES, F.col("bulletin_date").alias("date"), "y")
    per = (
        forecasts.join(actual, [*SERIES, "date"])
        .groupBy(*SERIES, *by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(F.col("y") - F.col("forecast"))).alias("mae"),
            F.min("date").alias("cutoff"),
        )
        .filter(F.col("n") >= min_points)
    )
    scales = scale_before(obs, per.select(*SERIES, "cutoff"))
    return per.join(scales.select(*SERIES, "cutoff", "scale"), [*SERIES, "cutoff"]).select(
        *SERIES, *by, "n", "mae", (F.col("mae") / F.col("scale")).alias("mase")
    )


def interval_score(y: Column, lo: Column, hi: Column, alpha: float = ALPHA) -> Column:
    below = F.greatest(lo - y, F.lit(0.0))
    above = F.greatest(y - hi, F.lit(0.0))
    return (hi - lo) + F.lit(2.0 / alpha) * (below + above)


def conformal_rank(n: Column, alpha: float | Column = ALPHA) -> Column:
    """1-based order statistic of the finite-sample conformal quantile, "higher" convention."""
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    q = F.least(F.lit(1.0), F.ceil(F.round((n + 1) * (1 - a), 9)) / n)
    return (F.ceil(F.round(q * (n - 1), 9)) + 1).cast("int")


def conformal_half(residuals: DataFrame, by: list[str], alpha: float = ALPHA, value: str = "resid") -> DataFrame:
    """Half-width per group from absolute residuals: an order statistic, never an interpolation.

    Groups are (series, model): at most one residual per month.
    """
    own = Window.partitionBy(*by)
    ranked = (
        residuals.filter(F.col(value).isNotNull())
        .withColumn("_abs", F.abs(value))
        .withColumn("_n", F.count(F.lit(1)).over(own))
        .withColumn("_rn", F.row_number().over(own.orderBy("_abs")))
    )
    return ranked.filter(F.col("_rn") == conformal_rank(F.col("_n"), alpha)).select(
        *by, F.col("_n").alias("n_calibration"), F.col("_abs").alias("half")
    )


def interval_metrics(scored: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """Coverage, interval score and its scaled form from ``y``, ``lo``, ``hi`` and ``scale``."""
    y, lo, hi = F.col("y"), F.col("lo"), F.col("hi")
    return (
        scored.filter(y.isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(((y >= lo) & (y <= hi)).cast("double")).alias("coverage"),
            F.avg(interval_score(y, lo, hi, alpha)).alias("interval_score"),
            F.max("scale").alias("_scale"),
        )
        .withColumn("msis", F.col("interval_score") / F.col("_scale"))
        .drop("_scale")
    )


def crps_of_samples(samples: Column, y: Column) -> Column:
    """Energy-form CRPS of an array of samples in O(n log n).

    The mean absolute difference of all sample pairs is a weighted sum of the sorted samples.
    """
    n = F.size(samples)
    distance = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + F.abs(x - y)) / n
    ordered = F.transform(F.sort_array(samples), lambda x, i: x * (2 * (i + 1) - n - 1))
    spread = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x)
    return distance - spread / (n * n)


def pinball(y: Column, q: Column, level: float | Column) -> Column:
    e = y - q
    tau = level if isinstance(level, Column) else F.lit(level)
    return F.greatest(tau * e, (tau - 1) * e)


def quantile_crps(y: Column, quantiles: dict[float, Column]) -> Column:
    """Twice the mean pinball loss over the quantile levels."""
    total = F.lit(0.0)
    for level, q in quantiles.items():
        total = total + pinball(y, q, level)
    return F.lit(2.0 / len(quantiles)) * total


def residual_quantiles(residuals: DataFrame, by: list[str], min_n: int = 8, value: str = "resid") -> DataFrame:
    """Signed residual quantiles per (series, model), linearly interpolated, as one array column."""
    levels = F.array(*[F.lit(q) for q in QUANTILE_LEVELS])
    return (
        residuals.filter(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_residuals"), F.percentile(value, levels).alias("rq"))
        .filter(F.col("n_residuals") >= min_n)
    )


def backtest(long: DataFrame, obs: DataFrame, models: tuple[str, ...], protocol: Protocol = Protocol()) -> DataFrame:
    """Selection and hold-out scores with a conformal interval, one row per (series, model).

    ``long`` holds one-step forecasts with ``y`` and ``region``. Half-widths come from selection
    residuals by rank inside the same window as the errors, so the report needs one shuffle on
    (series, model) and one join with the scales. ``models`` names the models to report; series without
    forecasts of one of them stay, with NULL scores.
    """
    group = [*SERIES, "model"]
    own = Window.partitionBy(*group)
    sel, hold = F.col("region") == "selection", F.col("region") == "holdout"
    err = F.col("y") - F.col("forecast")
    y, f = F.col("y"), F.col("forecast")
    ranked = (
        long.filter(y.isNotNull() & f.isNotNull())
        .withColumn("_abs", F.abs(err))
        .withColumn("_nsel", F.count_if(sel).over(own))
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "region").orderBy("_abs")))
        .withColumn(
            "half",
            F.max(F.when(sel & (F.col("_rn") == conformal_rank(F.col("_nsel"))), F.col("_abs"))).over(own),
        )
    )
    lo, hi = f - F.col("half"), f + F.col("half")
    aggs = []
    for prefix, mask in (("sel", sel), ("hold", hold)):
        e = F.when(mask, err)
        aggs += [c.alias(f"{prefix}_{n}") for n, c in error_aggregates(e, y, f).items()]
    scores = ranked.groupBy(*group).agg(
        *aggs,
        F.max("half").alias("half"),
        F.avg(F.when(hold & F.col("half").isNotNull(), F.abs(err) <= F.col("half")).cast("double")).alias("coverage"),
        F.avg(F.when(hold, interval_score(y, lo, hi))).alias("interval_score"),
    )
    grid = holdout_scale(obs, protocol).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return (
        grid.join(scores, group, "left")
        .withColumn("sel_mase", F.col("sel_mae") / F.col("scale"))
        .withColumn("hold_mase", F.col("hold_mae") / F.col("scale"))
        .withColumn("hold_mase1", F.col("hold_mae") / F.col("scale1"))
        .withColumn("msis", F.col("interval_score") / F.col("scale"))
    )


def mase_by_horizon(rolling: DataFrame, scales: DataFrame) -> DataFrame:
    """MASE per (model, series, h) of rolling-origin forecasts, on the series' pre-hold-out scale."""
    per = rolling.groupBy("model", *SERIES, "h").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae")
    )
    return per.join(scales.filter(F.col("scale").isNotNull()).select(*SERIES, "scale"), SERIES).select(
        "model", *SERIES, "h", "n", (F.col("mae") / F.col("scale")).alias("mase")
    )


def champion_by_horizon(per_series: DataFrame) -> DataFrame:
    """Best model per (table, horizon) by mean MASE over its series."""
    means = per_series.groupBy("table", "h", "model").agg(
        F.avg("mase").alias("mase"), F.count(F.lit(1)).alias("n_series")
    )
    return means.groupBy("table", "h").agg(
        F.min_by("model", F.struct(F.round("mase", 9), F.col("model"))).alias("champion"),
        F.min("mase").alias("mase"),
        F.max("n_series").alias("n_series"),
    )
