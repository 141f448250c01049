"""Exponential smoothing and theta over rolling origins: one recursion, a state for every origin.

A forecast of any horizon follows from the state at its origin: level, slope and damping of exponential smoothing, level
and half the least-squares slope of theta. So the recursion runs once over the months, for a batch of series and a whole
grid of smoothing parameters at a time, and keeps the state of each month: no refit per origin, none per horizon.
Deliberate deviations: parameters come from a grid (the best so far at each origin) instead of a likelihood search, and theta
is the classic form (smoothed level plus half the least-squares slope).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.config import HORIZONS, SERIES, Protocol
from panelspark.operators.forecast import BASELINES, at_horizon, forecaster, rolling
from panelspark.operators.series import cluster, densify, min_train, over_series, positions, whole_series

ALPHAS = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99])
BETAS = np.array([0.01, 0.05, 0.1, 0.2, 0.4])
PHIS = np.array([0.8, 0.9, 0.98])
HORIZON = 12
CANDIDATES = (*BASELINES, "ets", "theta")


def _grid() -> dict[str, np.ndarray]:
    """Parameter rows (alpha, beta, phi, trend on/off) of the three non-seasonal forms."""
    level = np.array([(a, 0.0, 0.0, 0.0) for a in ALPHAS])
    trend = np.array([(a, b, 1.0, 1.0) for a in ALPHAS for b in BETAS])
    damped = np.array([(a, b, p, 1.0) for a in ALPHAS for b in BETAS for p in PHIS])
    return {"level": level, "trend": trend, "damped": damped}


GRID = _grid()
PARAMS = np.vstack(list(GRID.values()))
FORM = np.concatenate([np.full(len(v), i) for i, v in enumerate(GRID.values())])
# Free parameters per form: smoothing constants plus initial states.
FREE = np.array([2, 4, 5])
#: Least squared error that the choice of a form tells apart.
LEAST_SSE = 1e-12
#: What is known of a series at an origin; ``ets_phi`` is 0 for a level, 1 for a full trend.
STATES = ("ets_level", "ets_slope", "ets_phi", "theta_level", "theta_slope")
#: Series that go through the recursion side by side.
BATCH = 256


def choose_forms(sse: np.ndarray, n: int) -> np.ndarray:
    """For each row of squared errors on ``n`` values, the form with the lowest corrected information criterion."""
    m = max(n - 2, 1)
    least = np.stack([np.maximum(sse[:, form == FORM].min(1), LEAST_SSE) for form in range(len(FREE))], axis=1)
    return np.argmin(m * np.log(least / m) + form_penalty(m), axis=1)


def form_penalty(m: int) -> np.ndarray:
    """What the criterion adds for a form's free parameters on ``m`` errors."""
    return np.array([2.0 * k + 2.0 * k * (k + 1) / max(m - k - 1, 1) for k in FREE.tolist()])


def batch_states(y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``STATES`` (first axis) of every series (rows of ``y``) after each month; NaN before ``first`` months.

    The form is chosen once, at ``first`` months; among its parameters, those with the least squared error up to the
    origin count. Errors count from the third month on.
    """
    n, months = y.shape
    out = np.full((len(STATES), n, months), np.nan)
    x = np.arange(months, dtype=np.float64)
    sx, sxx, sy, sxy = np.cumsum(x), np.cumsum(x * x), np.cumsum(y, axis=1), np.cumsum(x * y, axis=1)
    for start in np.unique(first[first <= months]).tolist():
        rows = np.flatnonzero(first == start)
        begun = _start(y[rows])
        for t in range(1, start):
            _month(y[rows, t, None], begun, PARAMS, t)
        chosen = choose_forms(begun[2], start)
        # from here on only the parameters of the chosen form count, and those of the plain level for theta
        for form in range(len(FREE)):
            some, own = np.flatnonzero(chosen == form), FORM == form
            if len(some):
                _follow(out[:3], rows[some], y, tuple(v[np.ix_(some, own)] for v in begun), PARAMS[own], start)
        plain = tuple(v[:, FORM == 0] for v in begun)
        _follow(out[3:4], rows, y, tuple(map(np.ascontiguousarray, plain)), PARAMS[FORM == 0], start)
        for t in range(start - 1, months):
            det = (t + 1) * sxx[t] - sx[t] * sx[t]
            out[4, rows, t] = 0.5 * ((t + 1) * sxy[rows, t] - sx[t] * sy[rows, t]) / det if det > 0 else 0.0
    return out


State = tuple[np.ndarray, np.ndarray, np.ndarray]


def _start(y: np.ndarray) -> State:
    """Level, slope and squared error of every series (rows) and parameter row (columns) after the first month."""
    level = np.repeat(y[:, :1], len(PARAMS), axis=1)
    slope = PARAMS[:, 3] * (y[:, 1:2] - y[:, :1]) if y.shape[1] > 1 else np.zeros_like(level)
    return level, slope, np.zeros_like(level)


def _month(y: np.ndarray, state: State, params: np.ndarray, t: int) -> None:
    """Takes the state over month ``t``, in place."""
    level, slope, sse = state
    a, b, phi, _ = params.T
    slope *= phi
    ahead = level + slope
    e = y - ahead
    np.multiply(a, e, out=level)
    level += ahead
    slope += a * b * e
    if t >= 2:
        e *= e
        sse += e


def _follow(out: np.ndarray, rows: np.ndarray, y: np.ndarray, state: State, params: np.ndarray, start: int) -> None:
    """Level, slope and damping (as many as ``out`` has) of the parameters with the least squared error after each month from ``start`` on."""
    every = np.arange(len(rows))
    for t in range(start - 1, y.shape[1]):
        if t >= start:
            _month(y[rows, t, None], state, params, t)
        pick = state[2].argmin(1)
        found = (state[0][every, pick], state[1][every, pick], params[pick, 2])
        for column, values in zip(out, found):
            column[rows, t] = values


def _states(levels: pd.Series, first: pd.Series) -> pd.DataFrame:
    """Arrow batches of whole series in, an array for each state out, from ``first`` months on."""
    found: list[list[np.ndarray]] = [[] for _ in STATES]
    for at in range(0, len(levels), BATCH):
        some, starts = levels.iloc[at : at + BATCH], first.iloc[at : at + BATCH].to_numpy()
        lengths = [len(v) for v in some]
        y = np.zeros((len(some), max(lengths)))
        for row, values, n in zip(y, some, lengths, strict=True):
            row[:n] = values
        states = batch_states(y, starts)
        for column, values in zip(found, states, strict=True):
            column += [v[s - 1 : n] for v, s, n in zip(values, starts.tolist(), lengths, strict=True)]
    return pd.DataFrame(dict(zip(STATES, found, strict=True)))


def levels(obs: DataFrame) -> DataFrame:
    """The dense grid with the columns that forecasts need."""
    return positions(densify(cluster(obs))).select(*SERIES, "bulletin_date", "y", "level", "pos", "n_grid")


def with_states(grid: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """Rows of a dense grid with the ``STATES`` after their month; NULL before the minimum training length.

    A series that never gets there, or whose table has no such length, has no state at all and is left out.

    Series become arrays in month order (bounded by the calendar) and are unfolded again. Spark does not know how rows
    that come out of Python are dealt out, so they move once more by area and category, as arrays: a row for each series.
    """
    others = [c for c in grid.columns if c not in (*SERIES, "bulletin_date")]
    months = F.sort_array(F.collect_list(F.struct("bulletin_date", *others)))
    recursion = F.pandas_udf(_states, ", ".join(f"{name} array<double>" for name in STATES))
    rows = grid.groupBy(*SERIES).agg(months.alias("_m")).withColumn("_first", min_train(protocol))
    # no filter of the panel itself, so that its exchange is the one that scoring reads, too
    rows = rows.filter(F.coalesce(F.size("_m") >= F.col("_first"), F.lit(False)))
    rows = rows.withColumn("_s", recursion(F.transform("_m", lambda m: m["level"]), "_first"))

    def month(m: Column, i: Column) -> Column:
        states = [F.get(F.col(f"_s.{name}"), i - F.col("_first") + 1).alias(name) for name in STATES]
        return F.struct(*[m[c].alias(c) for c in ("bulletin_date", *others)], *states)

    return cluster(rows).select(*SERIES, F.inline(F.transform("_m", month)))


def ahead(state: Column, h: Column | int) -> dict[str, Column]:
    """Both forecasts ``h`` months after an origin from a struct of its ``STATES``."""
    steps = F.lit(h) if isinstance(h, int) else h
    phi = state["ets_phi"]
    damped = phi * (1 - F.pow(phi, steps)) / F.nullif(1 - phi, F.lit(0.0))
    growth = F.when(phi == 1, steps.cast("double")).when(phi == 0, 0.0).otherwise(damped)
    return {"ets": state["ets_level"] + state["ets_slope"] * growth, "theta": state["theta_level"] + state["theta_slope"] * steps}


def state_struct() -> Column:
    return F.struct(*STATES)


def rolling_candidates(obs: DataFrame, horizons: tuple[int, ...] = HORIZONS, protocol: Protocol = Protocol()) -> DataFrame:
    """Baselines, smoothing and theta of every origin at every horizon, in the form of ``rolling_baselines``."""

    def values(h: int) -> dict[str, Column]:
        return {**at_horizon(h, protocol.season), **ahead(F.lag(state_struct(), h).over(over_series()), h)}

    return rolling(with_states(levels(obs), protocol), horizons, protocol, values)


def smoothing_forecasts(obs: DataFrame, models: tuple[str, ...] = ("ets", "theta"), protocol: Protocol = Protocol(), horizon: int = HORIZON) -> DataFrame:
    """One-step rows of every origin after the minimum training length, plus a ``future`` path per series."""
    grid = with_states(levels(obs), protocol)
    grid = grid.filter(F.col("n_grid") >= min_train(protocol) + protocol.holdout + protocol.buffer)
    last = F.col("pos") == F.col("n_grid")
    # a month's row carries its own one-step forecast, the last month's row the path beyond it as well
    one = ahead(F.lag(state_struct(), 1).over(over_series()), 1)
    rows = [_row(F.lit(0), F.lit(1), F.col("y"), one[m], m, F.lit(False)) for m in models]
    path = [_path(m, horizon) for m in models]
    grid = grid.withColumn("hold_start", F.add_months(F.max("bulletin_date").over(whole_series()), -(protocol.holdout - 1)))
    grid = grid.withColumn("_rows", F.array(*rows))
    grid = grid.withColumn("_rows", F.when(last, F.concat("_rows", *path)).otherwise(F.col("_rows")))
    held = F.when(F.col("date") >= F.col("hold_start"), "holdout").otherwise("selection")
    return (
        grid.select(*SERIES, "bulletin_date", "hold_start", F.inline("_rows"))
        .withColumn("date", F.add_months("bulletin_date", F.col("_shift")))
        .filter(F.col("forecast").isNotNull())
        .withColumn("region", F.when(F.col("_ahead"), "future").otherwise(held))
        .select(*SERIES, F.col("date").alias("bulletin_date"), "y", "hold_start", "region", "model", "h", "forecast")
    )


def _row(shift: Column, h: Column, y: Column, forecast: Column, model: str, future: Column) -> Column:
    return F.struct(
        shift.cast("int").alias("_shift"), h.cast("int").alias("h"), y.alias("y"), forecast.alias("forecast"), F.lit(model).alias("model"), future.alias("_ahead")
    )


def _path(model: str, horizon: int) -> Column:
    """Rows of one model's forecasts beyond an origin."""
    none = F.lit(None).cast("double")
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: _row(h, h, none, ahead(state_struct(), h)[model], model, F.lit(True)))


@forecaster("ets")
def _ets(obs: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    return smoothing_forecasts(obs, ("ets",), protocol).filter(F.col("region") != "future").drop("h")


@forecaster("theta")
def _theta(obs: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    return smoothing_forecasts(obs, ("theta",), protocol).filter(F.col("region") != "future").drop("h")
