"""Per-series windows: grid, fills, differences, causal features, runs and regions.

Every window of this module partitions by the series key, so one shuffle serves a whole chain; a
series holds at most one row per calendar month, which bounds each window group by the calendar.
Frames carry the series key, ``bulletin_date`` and the target ``y``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelspark.config import MAX_INTERPOLABLE_GAP, SERIES, WORLD, Protocol
from panelspark.functions.cells import calendar_features, month_index

DY_LAGS = (1, 2, 3, 6, 12, 24)
#: Columns by which the series of an area are dealt out.
PLACE = ["country", "category"]


def over_series(key: list[str] | None = None, order: str = "bulletin_date") -> WindowSpec:
    return Window.partitionBy(*(key or SERIES)).orderBy(order)


def whole_series(key: list[str] | None = None) -> WindowSpec:
    return Window.partitionBy(*(key or SERIES))


def cluster(obs: DataFrame) -> DataFrame:
    """Both tables of an area and category in one partition.

    Serves every window of a series and those across its two tables, and whatever else has both columns in its key (such as
    the ledger's, which leaves out the block), with this single shuffle; a category belongs to one block, so a
    partition key still holds at most two rows per calendar month.
    """
    return obs.repartition(*PLACE)


def look_up(rows: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """``rows`` with the ``value`` of their series, NULL for a series that ``series`` does not have.

    ``series`` has a row for each series. The few series of an area and category come as one map, so that the join is on
    the place alone: rows that ``cluster`` has dealt out stay where they are, and none are sorted.
    """
    own = F.struct("block", "table")
    maps = series.groupBy(*PLACE).agg(F.map_from_entries(F.collect_list(F.struct(own, F.col(value)))).alias("_found"))
    joined = rows.join(maps.hint("shuffle_hash"), PLACE, "left")
    return joined.select(*[c for c in rows.columns], F.try_element_at("_found", own).alias(value))


def densify(obs: DataFrame, *carried: str) -> DataFrame:
    """Gap-free monthly grid from the first to the last observation of each series.

    Each observed row is expanded up to the month before the next one, so grid, last observed value
    and distance to it come from a single shuffle, without a join against a calendar.
    Adds ``level`` (last observation carried forward), ``months_since_obs``, ``gap`` (missing months in
    the span) and ``next_y``; ``y`` stays NULL on missing months. ``carried`` columns keep the value of the last observed row.
    """
    w = over_series()
    nxt = F.lead("bulletin_date").over(w)
    month = F.col("_month")
    return (
        obs.withColumn("_next", nxt)
        .withColumn("next_y", F.lead("y").over(w))
        .withColumn("gap", F.coalesce(month_index(F.col("_next")) - month_index(F.col("bulletin_date")) - 1, F.lit(0)))
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.col("gap"))))
        .withColumn("_month", F.add_months("bulletin_date", F.col("_step")))
        .select(
            *SERIES,
            month.alias("bulletin_date"),
            F.when(F.col("_step") == 0, F.col("y")).alias("y"),
            F.col("y").alias("level"),
            F.col("_step").alias("months_since_obs"),
            "gap",
            "next_y",
            *carried,
        )
    )


def fill_locf(obs: DataFrame) -> DataFrame:
    return densify(obs).select(*SERIES, "bulletin_date", "y", "level")


def interpolate_short(obs: DataFrame, max_gap: int = MAX_INTERPOLABLE_GAP) -> DataFrame:
    """Linear interpolation of whole gaps up to ``max_gap`` months; longer gaps stay NULL.

    Looks at the next observation, hence for description only, never for training.
    """
    step = F.col("months_since_obs")
    inside = F.col("level") + (F.col("next_y") - F.col("level")) * step / (F.col("gap") + 1)
    return densify(obs).select(
        *SERIES,
        "bulletin_date",
        F.when(step == 0, F.col("y")).when(F.col("gap") <= max_gap, inside).alias("y"),
    )


def positions(grid: DataFrame) -> DataFrame:
    """Adds 1-based ``pos`` and series length ``n_grid``."""
    return grid.withColumn("pos", F.row_number().over(over_series())).withColumn(
        "n_grid", F.count(F.lit(1)).over(whole_series())
    )


def split_regions(grid: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """Tags the last ``holdout`` grid months as hold-out, the origins before them as selection.

    Months earlier than the minimum training length are ``train``; ``hold_start`` is repeated on the series.
    """
    minimum = min_train(protocol)
    last = F.max("bulletin_date").over(whole_series())
    return (
        positions(grid)
        .withColumn("hold_start", F.add_months(last, -(protocol.holdout - 1)))
        .withColumn(
            "region",
            F.when(F.col("bulletin_date") >= F.col("hold_start"), "holdout")
            .when(F.col("pos") > minimum, "selection")
            .otherwise("train"),
        )
    )


def min_train(protocol: Protocol) -> Column:
    items = list(protocol.min_train.items())
    case = F.when(F.col("table") == items[0][0], items[0][1])
    for name, value in items[1:]:
        case = case.when(F.col("table") == name, value)
    return case


def tuning_regions(grid: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """Validation windows inside the selection region: ``tune`` then ``confirm``, hold-out excluded."""
    back = F.col("n_grid") - F.col("pos")
    confirm = protocol.holdout + protocol.val_confirm
    return positions(grid).withColumn(
        "window",
        F.when(back < protocol.holdout, "holdout")
        .when(back < confirm, "confirm")
        .when(back < confirm + protocol.val_tune, "tune")
        .otherwise("fit"),
    )


def horizon_grid(obs: DataFrame, horizons: tuple[int, ...], protocol: Protocol = Protocol()) -> DataFrame:
    """Every (series, horizon) of the evaluation grid and whether the series is long enough for it."""
    span = month_index(F.max("bulletin_date")) - month_index(F.min("bulletin_date")) + 1
    series = obs.groupBy(*SERIES).agg(span.alias("_span"))
    rows = series.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return rows.select(*SERIES, "h", (F.col("_span") - min_train(protocol) >= F.col("h")).alias("feasible"))


def tail_per_series(df: DataFrame, n: int) -> DataFrame:
    """Last ``n`` grid rows of each series."""
    w = Window.partitionBy(*SERIES).orderBy(F.col("bulletin_date").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def difference(df: DataFrame, value: str = "y", out: str = "delta") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(over_series()))


def undifference(df: DataFrame, delta: str = "delta", anchor: str = "last_level", out: str = "level") -> DataFrame:
    """Cumulated deltas on top of the last observed level; each row uses deltas up to itself only."""
    run = over_series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.col(anchor) + F.sum(delta).over(run))


def mask_features(obs: DataFrame, horizon: int = 0) -> DataFrame:
    """``observed`` and ``months_since_obs``; ``horizon`` future months continue the count unobserved."""
    last = over_series()
    nxt = F.lead("bulletin_date").over(last)
    gap = month_index(F.col("_next")) - month_index(F.col("bulletin_date")) - 1
    return (
        obs.withColumn("_next", nxt)
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.coalesce(gap, F.lit(horizon)))))
        .select(
            *SERIES,
            F.add_months("bulletin_date", F.col("_step")).alias("bulletin_date"),
            (F.col("_step") == 0).cast("int").alias("observed"),
            F.col("_step").alias("months_since_obs"),
        )
    )


def runs(obs: DataFrame) -> DataFrame:
    """Islands of consecutive observed months: series, ``run_start``, ``run_length``."""
    island = month_index(F.col("bulletin_date")) - F.row_number().over(over_series())
    return (
        obs.withColumn("_island", island)
        .groupBy(*SERIES, "_island")
        .agg(F.min("bulletin_date").alias("run_start"), F.count(F.lit(1)).alias("run_length"))
        .drop("_island")
    )


def max_run(obs: DataFrame) -> DataFrame:
    return runs(obs).groupBy(*SERIES).agg(F.max("run_length").alias("max_run"))


def missing_profile(obs: DataFrame) -> DataFrame:
    """How the months are missing: gap runs and their lengths, longest observed run, share missing."""
    w = over_series()
    idx = month_index(F.col("bulletin_date"))
    spans = (
        obs.withColumn("_gap", idx - F.lag(idx).over(w) - 1)
        .withColumn("_island", idx - F.row_number().over(w))
        .withColumn("_run", F.count(F.lit(1)).over(Window.partitionBy(*SERIES, "_island")))
    )
    gap = F.when(F.col("_gap") > 0, F.col("_gap"))
    return (
        spans.groupBy(*SERIES)
        .agg(
            F.count(F.lit(1)).alias("n_observed"),
            F.coalesce(F.sum(gap), F.lit(0)).alias("n_missing"),
            F.count(gap).alias("n_gap_runs"),
            F.coalesce(F.max(gap), F.lit(0)).cast("bigint").alias("max_gap_run"),
            F.coalesce(F.median(gap), F.lit(0.0)).alias("median_gap_run"),
            F.max("_run").alias("longest_observed_run"),
        )
        .withColumn("n_months", F.col("n_observed") + F.col("n_missing"))
        .withColumn("pct_missing", F.round(F.col("n_missing") / F.col("n_months"), 4))
    )


def lag_features(grid: DataFrame, lags: tuple[int, ...] = DY_LAGS) -> DataFrame:
    """Δ of the filled level at several lags, plus the previous level; nothing of the month itself."""
    w = over_series()
    return (
        difference(grid, "level", "target_dy")
        .withColumn("prev_level", F.lag("level").over(w))
        .withColumns({f"dy_lag{lag}": F.lag("target_dy", lag).over(w) for lag in lags})
    )


def _streak(flag: Column, grid_key: list[str], name: str, df: DataFrame) -> DataFrame:
    """Length of the run of true flags that ends at each row."""
    up_to_here = over_series(grid_key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_false = F.max(F.when(~F.coalesce(flag, F.lit(False)), F.col("pos"))).over(up_to_here)
    return df.withColumn(name, (F.col("pos") - F.coalesce(last_false, F.lit(0))).cast("double"))


def streaks(frame: DataFrame) -> DataFrame:
    """Trailing frozen and advancing streaks, shifted one month so that they are known at the origin."""
    w = over_series()
    out = frame if "pos" in frame.columns else frame.withColumn("pos", F.row_number().over(w))
    out = _streak(F.col("target_dy") == 0, SERIES, "_frozen", out)
    out = _streak(F.col("target_dy") > 0, SERIES, "_advance", out)
    return (
        out.withColumn("months_frozen", F.lag("_frozen").over(w))
        .withColumn("advance_streak", F.lag("_advance").over(w))
        .drop("_frozen", "_advance")
    )


def retro_recent(frame: DataFrame, window: int = 6) -> DataFrame:
    """1 when one of the last ``window`` months, the current one excluded, moved backward."""
    w = over_series()
    # The first month has no delta; it counts as "not backward", like a comparison with NULL.
    flag = F.coalesce((F.col("target_dy") < 0).cast("double"), F.lit(0.0))
    return (
        frame.withColumn("_retro", F.max(flag).over(w.rowsBetween(-(window - 1), 0)))
        .withColumn("retro_recent", F.lag("_retro").over(w))
        .drop("_retro")
    )


def rolling_std(obs: DataFrame, window: int = 12, min_periods: int = 6) -> DataFrame:
    """Rolling sample deviation of the increments; NULL below ``min_periods`` increments."""
    frame = over_series().rowsBetween(-(window - 1), 0)
    return difference(obs).withColumn(
        "volatility",
        F.when(F.count("delta").over(frame) >= min_periods, F.stddev_samp("delta").over(frame)),
    )


def with_calendar(df: DataFrame, date: str = "bulletin_date") -> DataFrame:
    return df.withColumns(calendar_features(F.col(date)))


def table_spread(grid: DataFrame) -> DataFrame:
    """Level minus the last known level of the other table's series, both as of the previous month.

    Both tables share one window per (country, block, category): the as-of lookup is a running
    ``last`` per table, not a join.
    """
    w = Window.partitionBy("country", "block", "category").orderBy("bulletin_date")
    known = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # month order inside a RANGE frame: ties of the two tables see each other
    fad = F.last(F.when(F.col("table") == "FAD", F.col("level")), ignorenulls=True).over(known)
    dff = F.last(F.when(F.col("table") == "DFF", F.col("level")), ignorenulls=True).over(known)
    return (
        grid.withColumn("_other", F.when(F.col("table") == "FAD", dff).otherwise(fad))
        .withColumn("_spread", F.col("level") - F.col("_other"))
        .withColumn("spread_other_table", F.lag("_spread").over(over_series()))
        .drop("_other", "_spread")
    )


def world_spread(grid: DataFrame, world: str = WORLD) -> DataFrame:
    """Level minus the world series' last known level, both as of the previous month; NULL for the world.

    The world side has one row per (block, category, table, month): code lists times the calendar, at
    most some ten thousand rows whatever the number of areas, hence the broadcast. After its own
    end its last level stands, which a second one-row-per-key lookup supplies.
    """
    key = ["block", "category", "table"]
    ref = grid.filter(F.col("country") == world).select(*key, "bulletin_date", F.col("level").alias("_world"))
    last = ref.groupBy(*key).agg(F.max("bulletin_date").alias("_end"), F.max_by("_world", "bulletin_date").alias("_final"))
    known = F.coalesce(F.col("_world"), F.when(F.col("bulletin_date") > F.col("_end"), F.col("_final")))
    return (
        grid.join(F.broadcast(ref), [*key, "bulletin_date"], "left")
        .join(F.broadcast(last), key, "left")
        .withColumn("_spread", F.when(F.col("country") != world, F.col("level") - known))
        .withColumn("spread_vs_world", F.lag("_spread").over(over_series()))
        .drop("_world", "_spread", "_end", "_final")
    )


def feature_frame(obs: DataFrame) -> DataFrame:
    """One row per (series, target month); every feature is known at the previous month."""
    grid = densify(cluster(obs)).select(*SERIES, "bulletin_date", "y", "level", "months_since_obs")
    frame = retro_recent(streaks(lag_features(positions(grid))))
    return with_calendar(world_spread(table_spread(frame)))
