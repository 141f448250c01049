"""Panel summaries: inventories, census, coverage, facts, correlations.

Groups are either series (calendar-bounded) or small domains fed by partial aggregation; medians of
day counts aggregate by distinct value, medians of real-valued scores go through ``quantiles``.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import DAYS_PER_YEAR, REGIMES, SERIES, Protocol
from panelspark.functions.cells import fiscal_year, month_index, strip
from panelspark.operators.quantiles import exact_median
from panelspark.operators.series import difference, min_train, over_series

FISCAL_MONTHS = (10, 11, 12, 1, 2, 3, 4, 5, 6, 7, 8, 9)


def span_months(date: str = "bulletin_date") -> Column:
    return month_index(F.max(date)) - month_index(F.min(date)) + 1


def evaluable_flag(n_f: Column, span: Column, protocol: Protocol = Protocol()) -> Column:
    """Enough observed months and enough span for a walk-forward with its hold-out."""
    return (n_f >= protocol.min_f) & (span >= min_train(protocol) + protocol.holdout + protocol.buffer)


def series_summary(panel: DataFrame, modified: str | None = None) -> DataFrame:
    """One row per series; regimes are counted by a bit mask instead of a distinct shuffle."""
    mask = F.lit(0)
    for i, regime in enumerate(REGIMES):
        mask = mask + F.when(F.col("status") == regime, 1 << i).otherwise(0)
    extra = [F.max(modified).alias("last_modified_at")] if modified else []
    return panel.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count_if(F.col("status") == "F").alias("n_trainable"),
        F.min("bulletin_date").alias("first_month"),
        F.max("bulletin_date").alias("last_month"),
        F.bit_count(F.bit_or(mask)).cast("bigint").alias("n_regimes"),
        *extra,
    )


def list_series(
    panel: DataFrame,
    table: str | None = None,
    block: str | None = None,
    countries: tuple[str, ...] | None = None,
    min_trainable: int = 0,
) -> DataFrame:
    """Series catalogue; the key filters reach the scan because they come before the grouping."""
    df = panel
    if table is not None:
        df = df.filter(F.col("table") == table)
    if block is not None:
        df = df.filter(F.col("block") == block)
    if countries is not None:
        df = df.filter(F.col("country").isin(*countries))
    return series_summary(df).filter(F.col("n_trainable") >= min_trainable)


def evaluable_series(obs: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    return (
        obs.groupBy(*SERIES)
        .agg(F.count(F.lit(1)).alias("n_trainable"), span_months().alias("span_months"))
        .filter(evaluable_flag(F.col("n_trainable"), F.col("span_months"), protocol))
    )


def alias_bridge(raw: DataFrame) -> DataFrame:
    """Label lineage: each published spelling of a category with its first, last and number of months."""
    label = strip(F.regexp_replace("raw_category", r"\s+", " "))
    return (
        raw.withColumn("raw_label", label)
        .groupBy("block", F.col("category").alias("code"), "raw_label")
        .agg(
            F.min("bulletin_date").alias("valid_from"),
            F.max("bulletin_date").alias("valid_to"),
            F.countDistinct("bulletin_date").alias("n_months"),
        )
    )


def status_mix(panel: DataFrame, *by: str) -> DataFrame:
    """Rows and share per regime, overall or within ``by``."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = panel.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n_rows") / F.sum("n_rows").over(w), 1))


def latest(obs: DataFrame, *by: str, value: str = "priority_date") -> DataFrame:
    return obs.groupBy(*by).agg(
        F.max("bulletin_date").alias("latest_month"), F.max_by(value, "bulletin_date").alias(f"latest_{value}")
    )


def inventory(panel: DataFrame) -> DataFrame:
    return panel.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "F").alias("n_f"),
        F.min("bulletin_date").alias("start"),
        F.max("bulletin_date").alias("end"),
        span_months().cast("bigint").alias("span"),
        (span_months() - F.countDistinct("bulletin_date")).cast("bigint").alias("gaps"),
    )


def coverage_matrix(panel: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Area by category: how many tables carry data. Columns come from the given category domain."""
    one = panel.groupBy("country", "category", "table").agg(F.lit(1).alias("_one"))
    return one.groupBy("country").pivot("category", list(categories)).agg(F.count("_one")).na.fill(0)


def observed_step(panel: DataFrame) -> DataFrame:
    """Adds ``delta``: the step from the previous *observed* row of the series, NULL off regime F."""
    before = over_series().rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last("days_since_base", ignorenulls=True).over(before)
    return panel.withColumn("delta", (F.col("days_since_base") - prev).cast("double"))


def census(panel: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """Profile of each series: regimes, continuity, gaps, retreats, typical step, evaluable or not."""
    f_month = F.when(F.col("status") == "F", F.col("bulletin_date"))
    span = F.coalesce(month_index(F.max(f_month)) - month_index(F.min(f_month)) + 1, F.lit(0)).cast("bigint")
    profile = observed_step(panel).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in REGIMES],
        F.min(f_month).alias("first_f"),
        F.max(f_month).alias("last_f"),
        span.alias("span_months"),
        F.count_if(F.col("delta") < 0).alias("n_retro"),
        F.coalesce(F.greatest(F.lit(0.0), -F.min("delta")), F.lit(0.0)).alias("worst_retro_days"),
        F.round(F.coalesce(F.median("delta"), F.lit(0.0)), 1).alias("median_step_days"),
        F.round(F.coalesce(F.avg((F.col("delta") == 0).cast("double")), F.lit(0.0)), 4).alias("pct_frozen"),
    )
    return profile.withColumns(
        {
            "continuity": F.when(F.col("span_months") > 0, F.round(F.col("n_f") / F.col("span_months"), 4)).otherwise(0.0),
            "n_gaps": F.col("span_months") - F.col("n_f"),
            "evaluable": evaluable_flag(F.col("n_f"), F.col("span_months"), protocol),
        }
    )


def panel_facts(panel: DataFrame) -> DataFrame:
    """One row of headline facts about the panel, in one pass over its series windows."""
    is_f = F.col("status") == "F"
    first_row = F.row_number().over(over_series()) == 1
    before = over_series().rowsBetween(Window.unboundedPreceding, -1)
    first_f = is_f & (F.count_if(is_f).over(before) == 0)
    tagged = observed_step(panel).withColumns({"_first": first_row, "_first_f": first_f})
    return tagged.agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count_if(is_f).alias("n_obs_f"),
        F.countDistinct("bulletin_date").alias("n_months"),
        F.min("bulletin_date").alias("date_first"),
        F.max("bulletin_date").alias("date_last"),
        F.count_if("_first").alias("n_series"),
        F.count_if("_first_f").alias("n_series_with_f"),
        F.round(100 * F.avg((F.col("delta") < 0).cast("double")), 2).alias("pct_retro"),
        F.round(100 * F.avg((F.col("delta") == 0).cast("double")), 2).alias("pct_frozen"),
        F.round(F.median("delta"), 1).alias("median_step_days"),
        F.round(100.0 * F.count_if(is_f) / F.count(F.lit(1)), 2).alias("pct_trainable"),
    )


def annotate_facts(facts: DataFrame, notes: dict[str, tuple[str, str, str]], vintage: str) -> DataFrame:
    """One-row facts to long form: name, value, unit, population, source, vintage."""
    names = list(notes)
    long = facts.select(F.col(vintage).cast("string").alias("vintage"), *[F.col(n).cast("double").alias(n) for n in names])
    long = long.unpivot("vintage", names, "fact", "value")

    def pick(i: int) -> Column:
        case = F.when(F.col("fact") == names[0], notes[names[0]][i])
        for n in names[1:]:
            case = case.when(F.col("fact") == n, notes[n][i])
        return case

    return long.withColumns({"unit": pick(0), "population": pick(1), "source": pick(2)})


def monthly_advance(obs: DataFrame) -> DataFrame:
    """Median step by calendar month of the bulletin."""
    d = difference(obs).filter(F.col("delta").isNotNull())
    return d.groupBy(F.month("bulletin_date").alias("month")).agg(
        F.round(F.median("delta"), 1).alias("median_advance"), F.count(F.lit(1)).alias("n")
    )


def fiscal_pulse(obs: DataFrame) -> DataFrame:
    """Median step, fiscal year by month in fiscal order."""
    d = (
        difference(obs)
        .filter(F.col("delta").isNotNull())
        .select(fiscal_year(F.col("bulletin_date")).alias("fiscal_year"), F.month("bulletin_date").alias("_m"), "delta")
    )
    wide = d.groupBy("fiscal_year").pivot("_m", list(FISCAL_MONTHS)).agg(F.median("delta"))
    return wide.select("fiscal_year", *[F.col(str(m)).alias(f"m{m:02d}") for m in FISCAL_MONTHS])


def table_gap(obs: DataFrame) -> DataFrame:
    """DFF minus FAD in the last month where both tables publish a date."""
    wide = obs.groupBy("country", "block", "category", "bulletin_date").agg(
        F.max(F.when(F.col("table") == "FAD", F.col("y"))).alias("fad"),
        F.max(F.when(F.col("table") == "DFF", F.col("y"))).alias("dff"),
    )
    return (
        wide.filter(F.col("fad").isNotNull() & F.col("dff").isNotNull())
        .groupBy("country", "block", "category")
        .agg(
            F.max("bulletin_date").alias("date"),
            F.max_by(F.col("dff") - F.col("fad"), "bulletin_date").cast("bigint").alias("gap_days"),
        )
    )


def backlog_today(panel: DataFrame) -> DataFrame:
    """Years between the newest bulletin with dates and the dates it published."""
    f = panel.filter((F.col("status") == "F") & F.col("priority_date").isNotNull())
    newest = f.agg(F.max("bulletin_date")).scalar()
    return f.filter(F.col("bulletin_date") == newest).select(
        *SERIES,
        F.round(F.datediff("bulletin_date", "priority_date") / F.lit(DAYS_PER_YEAR), 1).alias("backlog_years"),
    )


def retro_by_month(events: DataFrame) -> DataFrame:
    """Retreats per month: how many series and how many days in total."""
    return events.groupBy("bulletin_date").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("days").cast("bigint").alias("total_days")
    )


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Sort and limit: each task keeps its own ``n`` rows, the driver merges those."""
    return df.orderBy(*order).limit(n)


def regime_share(panel: DataFrame) -> DataFrame:
    """Share of each regime inside a series."""
    total = F.count(F.lit(1))
    return panel.groupBy(*SERIES).agg(
        *[F.round(F.count_if(F.col("status") == s) / total, 6).alias(f"share_{s.lower()}") for s in REGIMES]
    )


def step_histogram(obs: DataFrame, lo: float = -200, hi: float = 400, bins: int = 60) -> DataFrame:
    """Counts of steps inside [lo, hi] per bin; the tails are counted in their own rows, never clipped."""
    width = (hi - lo) / bins
    d = difference(obs).filter(F.col("delta").isNotNull())
    inner = F.least(F.floor((F.col("delta") - lo) / F.lit(width)), F.lit(bins - 1))
    label = F.when(F.col("delta") < lo, -1).when(F.col("delta") > hi, bins).otherwise(inner).cast("int")
    return d.groupBy(label.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("delta").alias("min_step"), F.max("delta").alias("max_step")
    )


def wins_by_model(errors: DataFrame, error: str = "mase") -> DataFrame:
    """How many series each model wins; ties go to the alphabetically first model."""
    best = (
        errors.filter(F.col(error).isNotNull())
        .groupBy(*SERIES)
        .agg(F.min_by("model", F.struct(F.col(error), F.col("model"))).alias("model"))
    )
    return best.groupBy("model").agg(F.count(F.lit(1)).alias("wins"))


def ranking(errors: DataFrame, error: str = "mase") -> DataFrame:
    """Mean error per model over the series it could be scored on, with the failed ones counted."""
    return errors.groupBy("model").agg(
        F.round(F.avg(error), 6).alias("mean_error"),
        F.count(error).alias("n_scored"),
        F.count_if(F.col(error).isNull()).alias("n_failed"),
    )


def with_total_row(per_series: DataFrame) -> DataFrame:
    """Per-series rows plus one ALL row per table: both grouping sets in one aggregation."""
    label = [F.coalesce(F.col(c), F.lit("ALL")).alias(c) for c in ("block", "country", "category")]
    key = [F.col(c) for c in ("table", "block", "country", "category")]
    return (
        per_series.groupingSets([key, [F.col("table")]], *key)
        .agg(
            F.sum("n").alias("n"),
            F.round(F.avg("crps"), 6).alias("crps"),
            F.sum("k95").alias("k95"),
            F.round(F.sum("k95") / F.sum("n"), 6).alias("cov95"),
            F.count(F.lit(1)).alias("n_series"),
        )
        .select("table", *label, "n", "crps", "k95", "cov95", "n_series")
    )


def acceptance(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Tuned against default per group: accepted on the mean, the median reported beside it."""
    means = pairs.groupBy(*by).agg(
        F.avg("confirm_tuned").alias("tuned_mean"),
        F.avg("confirm_default").alias("default_mean"),
        F.avg(F.coalesce(F.col("confirm_tuned") < F.col("confirm_default"), F.lit(False)).cast("double")).alias("pct_improve"),
        F.count(F.lit(1)).alias("n"),
    )
    return (
        means.join(exact_median(pairs, by, "confirm_tuned", "tuned_median"), by, "left")
        .join(exact_median(pairs, by, "confirm_default", "default_median"), by, "left")
        .withColumn("delta_pct", 100 * (F.col("default_mean") - F.col("tuned_mean")) / F.col("default_mean"))
        .withColumn("accepted", F.col("tuned_mean") < F.col("default_mean"))
        .withColumn("median_agrees", F.col("tuned_median") < F.col("default_median"))
    )


def area_increments(obs: DataFrame, areas: tuple[str, ...]) -> DataFrame:
    """Mean step per month, one column per area of a given domain."""
    d = difference(obs).filter(F.col("delta").isNotNull() & F.col("country").isin(*areas))
    return d.groupBy("bulletin_date").pivot("country", list(areas)).agg(F.avg("delta"))


def increment_corr(obs: DataFrame, areas: tuple[str, ...]) -> DataFrame:
    """Correlation of the steps of each pair of areas within (block, category, table).

    Areas become columns of one month row, and every pair is one aggregate over those rows: no pair
    of rows is ever emitted. Months where one side is missing drop out of that pair only.
    """
    d = difference(obs).filter(F.col("country").isin(*areas))
    wide = d.groupBy("block", "category", "table", "bulletin_date").pivot("country", list(areas)).agg(F.max("delta"))
    pairs = list(combinations(areas, 2))
    both = {(a, b): F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs}
    out = wide.groupBy("block", "category", "table").agg(
        *[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs],
        *[F.count_if(both[p]).alias(f"{p[0]}#{p[1]}") for p in pairs],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("area_a"),
                F.lit(b).alias("area_b"),
                F.col(f"`{a}~{b}`").alias("corr"),
                F.col(f"`{a}#{b}`").alias("n_months"),
            )
            for a, b in pairs
        ]
    )
    return out.select("block", "category", "table", F.inline(rows)).filter(F.col("n_months") > 0)


def lead_lag(obs: DataFrame, areas: tuple[str, ...], max_lag: int = 6) -> DataFrame:
    """Lag in months at which one area's mean step follows another's best, by correlation."""
    sig = area_increments(obs, areas)
    # Lagged copies: the row of month t, shifted by k, meets month t + k.
    lagged = sig.withColumn("k", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).select(
        "k",
        F.add_months("bulletin_date", F.col("k")).alias("bulletin_date"),
        *[F.col(a).alias(f"lag_{a}") for a in areas],
    )
    pairs = list(product(areas, areas))
    corrs = sig.join(lagged, "bulletin_date").groupBy("k").agg(
        *[F.corr(a, f"lag_{b}").alias(f"{a}~{b}") for a, b in pairs]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("area_a"), F.lit(b).alias("area_b"), F.col(f"`{a}~{b}`").alias("corr"))
            for a, b in pairs
        ]
    )
    long = corrs.select("k", F.inline(rows)).filter(F.col("corr").isNotNull() & ~F.isnan("corr"))
    # Rounded before comparing so that equal correlations tie; the earliest lag wins.
    best = F.struct(F.round("corr", 9), -F.col("k"))
    return long.groupBy("area_a", "area_b").agg(
        F.max("corr").alias("corr"), F.max_by("k", best).alias("lag")
    )
