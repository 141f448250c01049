"""Characterisation of series: shape, strength, entropy, tests, and feature selection.

Per-series statistics are windows and aggregates on the filled monthly grid. Two deliberate
deviations keep them declarative: trend and season come from a centred 2x12 moving average instead of a
robust loess, and the unit-root test uses a fixed lag instead of a searched one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import SEASON, SERIES
from panelspark.functions import special
from panelspark.operators.quantiles import average_ranks, sort_key
from panelspark.operators.series import over_series, positions, whole_series
from panelspark.operators.warehouse import Contract, validate
from panelspark.session import numbered, stage

# Robust z limits, tile width, test lags.
OUTLIER_Z = 3.0
HAMPEL_WINDOW = 13
HAMPEL_MIN = 6
HAMPEL_SIGMA = 3.0
MAD_TO_SIGMA = 1.4826
LAGS = 12
#: Rows that the inversion count takes as one block, as a power of two, and the bits of a key it looks at together.
BLOCK_BITS = 7
BLOCK = 1 << BLOCK_BITS
DIGIT = 4
# KPSS level critical values and Dickey-Fuller t with a constant, with their p-values.
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
DF_TABLE = ((-3.43, 0.01), (-3.12, 0.025), (-2.86, 0.05), (-2.57, 0.10))
# Studentised range / sqrt(2) at 5 % for 2 to 10 models.
NEMENYI_Q = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def interpolate_table(x: Column, table: tuple[tuple[float, float], ...]) -> Column:
    """Linear interpolation of p between tabulated statistics, clamped at both ends."""
    case = F.when(x <= table[0][0], table[0][1])
    for (x0, p0), (x1, p1) in zip(table, table[1:], strict=False):
        case = case.when(x <= x1, F.lit(p0) + (x - x0) * F.lit((p1 - p0) / (x1 - x0)))
    return case.otherwise(table[-1][1])


def _acf1(x: str) -> Column:
    centred, before = F.col(f"_c_{x}"), F.col(f"_p_{x}")
    return F.sum(centred * before) / F.nullif(F.sum(centred * centred), F.lit(0.0))


def shape_features(level: DataFrame) -> DataFrame:
    """First autocorrelation of level and step, skewness and excess kurtosis of the step."""
    w, own = over_series(), whole_series()
    df = level.withColumn("_d", F.col("level") - F.lag("level").over(w))
    for name, col in (("y", "level"), ("d", "_d")):
        df = df.withColumn(f"_c_{name}", F.col(col) - F.avg(col).over(own))
        df = df.withColumn(f"_p_{name}", F.lag(f"_c_{name}").over(w))
    return df.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"),
        _acf1("y").alias("acf1"),
        _acf1("d").alias("acf1_diff"),
        F.skewness("_d").alias("step_skew"),
        F.kurtosis("_d").alias("step_kurtosis"),
    )


def tiled(level: DataFrame, width: int = SEASON) -> DataFrame:
    """Variance of the tile means and of the tile variances over full tiles; 0 below two tiles."""
    grid = positions(level)
    full = grid.withColumn("_tile", F.floor((F.col("pos") - 1) / width)).filter(
        F.col("_tile") < F.floor(F.col("n_grid") / width)
    )
    tiles = full.groupBy(*SERIES, "_tile").agg(F.avg("level").alias("_m"), F.var_pop("level").alias("_v"))
    several = F.count(F.lit(1)) >= 2
    return tiles.groupBy(*SERIES).agg(
        F.when(several, F.var_pop("_m")).otherwise(0.0).alias("stability"),
        F.when(several, F.var_pop("_v")).otherwise(0.0).alias("lumpiness"),
    )


def decompose(level: DataFrame, period: int = SEASON) -> DataFrame:
    """Centred moving-average trend, calendar-month season and residual; NULL at the half-period ends."""
    w = over_series()
    half = period // 2
    inner = F.sum("level").over(w.rowsBetween(-(half - 1), half - 1))
    ends = F.lag("level", half).over(w) + F.lead("level", half).over(w)
    month = Window.partitionBy(*SERIES, F.month("bulletin_date"))
    return (
        level.withColumn("trend", (inner + ends / 2) / period)
        .withColumn("_detrended", F.col("level") - F.col("trend"))
        .withColumn("_phase", F.avg("_detrended").over(month))
        .withColumn("_mean", F.avg("_detrended").over(whole_series()))
        .withColumn("season", F.when(F.col("trend").isNotNull(), F.col("_phase") - F.col("_mean")))
        .withColumn("resid", F.col("_detrended") - F.col("season"))
        .drop("_detrended", "_phase", "_mean")
    )


def strengths(parts: DataFrame) -> DataFrame:
    """Trend and seasonal strength of a decomposition, each in [0, 1]."""

    def strength(component: str) -> Column:
        total = F.var_pop(F.col(component) + F.col("resid"))
        return F.coalesce(F.greatest(F.lit(0.0), 1 - F.var_pop("resid") / F.nullif(total, F.lit(0.0))), F.lit(0.0))

    return parts.groupBy(*SERIES).agg(
        strength("trend").alias("trend_strength"), strength("season").alias("seasonal_strength")
    )


def outliers(parts: DataFrame, z: float = OUTLIER_Z) -> DataFrame:
    """Residuals whose robust z exceeds ``z``; a zero MAD counts as scale one."""
    own = whole_series()
    dev = (
        parts.filter(F.col("resid").isNotNull())
        .withColumn("_dev", F.col("resid") - F.median("resid").over(own))
        .withColumn("_mad", F.median(F.abs("_dev")).over(own))
    )
    score = F.lit(0.6745) * F.col("_dev") / F.when(F.col("_mad") == 0, 1.0).otherwise(F.col("_mad"))
    return dev.groupBy(*SERIES).agg(F.count_if(F.abs(score) > z).alias("n_outliers"))


def hampel(parts: DataFrame, window: int = HAMPEL_WINDOW, min_n: int = HAMPEL_MIN, sigma: float = HAMPEL_SIGMA) -> DataFrame:
    """Point anomalies of the residual against a centred rolling median and MAD."""
    frame = over_series().rowsBetween(-(window // 2), window // 2)
    rows = parts.filter(F.col("resid").isNotNull())
    med = F.when(F.count("resid").over(frame) >= min_n, F.percentile("resid", F.lit(0.5)).over(frame))
    rows = rows.withColumn("_dev", F.abs(F.col("resid") - med))
    mad = F.when(F.count("_dev").over(frame) >= min_n, F.percentile("_dev", F.lit(0.5)).over(frame))
    scale = F.lit(MAD_TO_SIGMA) * F.col("_mad")
    return rows.withColumn("_mad", mad).withColumn(
        "anomaly", F.coalesce((scale > 0) & (F.col("_dev") > sigma * scale), F.lit(False))
    )


def _chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) else special.chi2_sf(float(a), int(b)) for a, b in zip(x, df, strict=True)], dtype="float64"
    )


def ljung_box(df: DataFrame, value: str, lags: int = LAGS) -> DataFrame:
    """Q over min(lags, n/2) autocorrelations and its chi-square tail.

    All lags are window columns of the same sort; nothing is self-joined.
    """
    w, own = over_series(), whole_series()
    rows = df.filter(F.col(value).isNotNull()).withColumn("_c", F.col(value) - F.avg(value).over(own))
    rows = rows.withColumns({f"_l{k}": F.lag("_c", k).over(w) for k in range(1, lags + 1)})
    agg = rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_c") * F.col("_c")).alias("_v"),
        *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)],
    )
    used = F.least(F.lit(lags), F.floor(F.col("n") / 2)).cast("int")
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        r = F.col(f"_s{k}") / F.nullif(F.col("_v"), F.lit(0.0))
        q = q + F.when(k <= used, r * r / (F.col("n") - k)).otherwise(0.0)
    q = F.col("n") * (F.col("n") + 2) * q
    scored = agg.filter(F.col("n") > 3).select(*SERIES, "n", used.alias("lb_lags"), q.alias("lb_q"))
    return scored.withColumn("lb_p", F.pandas_udf(_chi2_tail, "double")("lb_q", "lb_lags"))


def chi2_tail_even(x: Column, df: int) -> Column:
    """Upper chi-square tail for even degrees of freedom as a plain expression."""
    total, factorial = F.lit(1.0), 1.0
    for i in range(1, df // 2):
        factorial *= i
        total = total + F.pow(x / 2, F.lit(float(i))) / F.lit(factorial)
    return F.exp(-x / 2) * total


def kpss(df: DataFrame, value: str, max_lag: int = 12, out: str = "kpss") -> DataFrame:
    """KPSS level statistic with a Bartlett window of floor(4 (n/100)^(1/4)) lags.

    A series whose window is wider than ``max_lag`` (12: over 8,100 months) fails the query; none is cut short.
    """
    w, own = over_series(), whole_series()
    rows = df.filter(F.col(value).isNotNull()).withColumn("_e", F.col(value) - F.avg(value).over(own))
    rows = rows.withColumn("_cum", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({f"_l{k}": F.lag("_e", k).over(w) for k in range(1, max_lag + 1)})
    agg = rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("_cum") * F.col("_cum")).alias("_eta"),
        F.sum(F.col("_e") * F.col("_e")).alias("_g0"),
        *[F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"_g{k}") for k in range(1, max_lag + 1)],
    )
    n = F.col("_n")
    lag = F.floor(4 * F.pow(n / 100.0, F.lit(0.25)))
    too_long = F.raise_error(F.lit(f"kpss: a series needs more than max_lag={max_lag} lags")).cast("bigint")
    lag = F.when(lag > max_lag, too_long).otherwise(lag)
    s2 = F.col("_g0")
    for k in range(1, max_lag + 1):
        s2 = s2 + F.when(k <= lag, 2 * (1 - k / (lag + 1)) * F.coalesce(F.col(f"_g{k}"), F.lit(0.0))).otherwise(0.0)
    return agg.select(*SERIES, (F.col("_eta") / (n * n) / F.nullif(s2 / n, F.lit(0.0))).alias(out))


def dickey_fuller(df: DataFrame, value: str) -> DataFrame:
    """t statistic of the lagged level in the step regression with a constant and no lagged steps."""
    w = over_series()
    rows = df.filter(F.col(value).isNotNull()).withColumn("_x", F.lag(value).over(w)).withColumn("_d", F.col(value) - F.col("_x"))
    agg = rows.groupBy(*SERIES).agg(
        F.regr_count("_d", "_x").alias("_n"),
        F.regr_sxx("_d", "_x").alias("_sxx"),
        F.regr_sxy("_d", "_x").alias("_sxy"),
        F.regr_syy("_d", "_x").alias("_syy"),
    )
    slope = F.col("_sxy") / F.nullif(F.col("_sxx"), F.lit(0.0))
    sse = F.col("_syy") - slope * F.col("_sxy")
    se = F.sqrt(F.greatest(sse, F.lit(0.0)) / (F.col("_n") - 2) / F.col("_sxx"))
    return agg.filter(F.col("_n") > 3).select(*SERIES, (slope / F.nullif(se, F.lit(0.0))).alias("df_t"))


def stationarity(df: DataFrame, value: str = "y") -> DataFrame:
    """Both tests with interpolated p-values and the agreement verdict."""
    both = kpss(df, value).join(dickey_fuller(df, value), SERIES)
    kp, dp = interpolate_table(F.col("kpss"), KPSS_TABLE), interpolate_table(F.col("df_t"), DF_TABLE)
    unit_root_rejected, level_kept = F.col("df_p") < 0.05, F.col("kpss_p") >= 0.05
    return both.withColumns({"kpss_p": kp, "df_p": dp}).withColumn(
        "verdict",
        F.when(unit_root_rejected & level_kept, "stationary")
        .when(~unit_root_rejected & ~level_kept, "difference")
        .when(F.col("kpss").isNull() | F.col("df_t").isNull(), "failed")
        .otherwise("mixed"),
    )


def ndiffs(level: DataFrame) -> DataFrame:
    """Differences needed until the level test stops rejecting, at most two."""
    w = over_series()
    df = level.withColumn("_d1", F.col("level") - F.lag("level").over(w))
    df = df.withColumn("_d2", F.col("_d1") - F.lag("_d1").over(w))
    limit = KPSS_TABLE[1][0]
    both = kpss(df, "level", out="_k0").join(kpss(df, "_d1", out="_k1"), SERIES, "left")
    passed = lambda c: F.coalesce(F.col(c) <= limit, F.lit(True))
    return both.select(*SERIES, F.when(passed("_k0"), 0).when(passed("_k1"), 1).otherwise(2).alias("ndiffs"))


def permutation_entropy(level: DataFrame, value: str = "level") -> DataFrame:
    """Normalised entropy of ordinal patterns of three consecutive values; equal values keep time order."""
    w = over_series()
    a, b, c = F.col(value), F.col("_b"), F.col("_c")
    rows = level.withColumns({"_b": F.lead(value).over(w), "_c": F.lead(value, 2).over(w)}).filter(c.isNotNull())
    pattern = F.concat((a <= b).cast("string"), (a <= c).cast("string"), (b <= c).cast("string"))
    counts = rows.groupBy(*SERIES, pattern.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # Entropy from counts alone: log N - sum(n log n) / N.
    total = F.sum("_n")
    entropy = F.log(total) - F.sum(F.col("_n") * F.log("_n")) / total
    return counts.groupBy(*SERIES).agg((entropy / F.lit(float(np.log(6)))).alias("perm_entropy"))


def _spectral(values: pd.Series) -> pd.Series:
    out = []
    for v in values:
        x = np.asarray(v, dtype="float64")
        n = len(x)
        power = np.abs(np.fft.rfft(x - x.mean())) ** 2
        power[1 : (n - 1) // 2 + 1] *= 2  # one-sided: every bin but the mean and the Nyquist bin counts twice
        power = power[power > 1e-9 * max(power.max(), 1e-300)]
        if power.size <= 1:
            out.append(1.0)
            continue
        p = power / power.sum()
        out.append(float(-(p * np.log(p)).sum() / np.log(p.size)))
    return pd.Series(out, dtype="float64")


def series_arrays(df: DataFrame, value: str) -> DataFrame:
    """One row per series with its values in month order; an array is bounded by the calendar."""
    pairs = F.sort_array(F.collect_list(F.struct("bulletin_date", value)))
    return df.filter(F.col(value).isNotNull()).groupBy(*SERIES).agg(F.transform(pairs, lambda p: p[value]).alias("values"))


def spectral_entropy(level: DataFrame, value: str = "level") -> DataFrame:
    """Normalised entropy of the periodogram: one FFT per series array, in Arrow batches."""
    return series_arrays(level, value).select(*SERIES, F.pandas_udf(_spectral, "double")("values").alias("spectral_entropy"))


def _arch(values: pd.Series) -> pd.DataFrame:
    rows = []
    for v in values:
        e2 = np.asarray(v, dtype="float64")
        e2 = (e2 - e2.mean()) ** 2
        n = len(e2) - LAGS
        if n <= LAGS + 1 or np.ptp(e2) == 0:
            rows.append((None, None))
            continue
        x = np.column_stack([np.ones(n)] + [e2[LAGS - k : len(e2) - k] for k in range(1, LAGS + 1)])
        target = e2[LAGS:]
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        resid = target - x @ beta
        centred = target - target.mean()
        lm = n * (1.0 - resid @ resid / (centred @ centred)) if centred @ centred > 0 else 0.0
        rows.append((lm, special.chi2_sf(max(lm, 0.0), LAGS)))
    return pd.DataFrame(rows, columns=["lm", "p"], dtype="float64")


def arch_lm(steps: DataFrame, value: str = "delta") -> DataFrame:
    """Lagrange-multiplier test of twelve squared-step lags per series."""
    out = series_arrays(steps, value).withColumn("_t", F.pandas_udf(_arch, "lm double, p double")("values"))
    return out.select(*SERIES, F.col("_t.lm").alias("arch_lm"), F.col("_t.p").alias("arch_p"))


def dm_statistic(pairs: DataFrame, by: list[str], h: int = 1) -> DataFrame:
    """Diebold-Mariano statistic with the small-sample factor, from aligned errors ``e1`` and ``e2``."""
    w = Window.partitionBy(*by).orderBy("date")
    rows = pairs.withColumn("_d", F.col("e1") * F.col("e1") - F.col("e2") * F.col("e2"))
    rows = rows.withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(1, h)})
    agg = rows.groupBy(*by).agg(
        F.count("_d").alias("n"),
        F.avg("_d").alias("_m"),
        F.var_pop("_d").alias("_v0"),
        *[F.covar_pop("_d", f"_d{k}").alias(f"_v{k}") for k in range(1, h)],
    )
    var = F.col("_v0")
    for k in range(1, h):
        var = var + 2 * F.coalesce(F.col(f"_v{k}"), F.lit(0.0))
    n = F.col("n")
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    return agg.select(*by, "n", F.when(var > 0, F.col("_m") / F.sqrt(var / n) * factor).otherwise(0.0).alias("dm"))


def _t_two_sided(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([2.0 * special.t_cdf(-abs(a), b - 1) if b > 1 else 1.0 for a, b in zip(t, n, strict=True)], dtype="float64")


def dm_test(pairs: DataFrame, by: list[str], h: int = 1) -> DataFrame:
    return dm_statistic(pairs, by, h).withColumn("p", F.pandas_udf(_t_two_sided, "double")("dm", "n"))


def gw_test(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Giacomini-White with a constant and the lagged loss difference; closed-form 2x2 solve."""
    w = Window.partitionBy(*by).orderBy("date")
    rows = pairs.withColumn("_d", F.col("e1") * F.col("e1") - F.col("e2") * F.col("e2"))
    rows = rows.withColumn("_g2", F.col("_d") * F.lag("_d").over(w)).withColumn("_n", F.count("_d").over(Window.partitionBy(*by)))
    agg = (
        rows.filter(F.col("_g2").isNotNull())
        .groupBy(*by)
        .agg(
            F.max("_n").alias("n"),
            F.avg("_d").alias("_a"),
            F.avg("_g2").alias("_b"),
            F.var_samp("_d").alias("_aa"),
            F.covar_samp("_d", "_g2").alias("_ab"),
            F.var_samp("_g2").alias("_bb"),
        )
        .filter(F.col("n") >= 5)
    )
    a, b, aa, ab, bb = (F.col(c) for c in ("_a", "_b", "_aa", "_ab", "_bb"))
    det = F.nullif(aa * bb - ab * ab, F.lit(0.0))
    stat = (F.col("n") - 1) * (a * a * bb - 2 * a * b * ab + b * b * aa) / det
    return agg.select(*by, "n", stat.alias("gw")).withColumn("p", F.exp(-F.col("gw") / 2))


def friedman(errors: DataFrame, models: tuple[str, ...], error: str = "mase") -> DataFrame:
    """Friedman chi-square with tie correction and the Nemenyi critical difference of average ranks."""
    own = Window.partitionBy(*SERIES)
    e = F.round(error, 12)
    k = len(models)
    complete = errors.filter(F.col("model").isin(*models) & F.col(error).isNotNull()).withColumn("_k", F.count(F.lit(1)).over(own))
    t = F.count(F.lit(1)).over(Window.partitionBy(*SERIES, e))
    ranked = complete.filter(F.col("_k") == k).withColumn("_t", t).withColumn("_rank", F.rank().over(own.orderBy(e)) + (F.col("_t") - 1) / 2.0)
    # Summed over members, t^2 - 1 gives t^3 - t per tie group.
    per_model = ranked.groupBy("model").agg(
        F.sum("_rank").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties")
    )
    n = F.max("_n")
    raw = 12.0 / (n * k * (k + 1)) * F.sum(F.col("_sum") * F.col("_sum")) - 3.0 * n * (k + 1)
    correction = 1 - F.sum("_ties") / (n * k * (k * k - 1))
    out = per_model.agg(n.alias("n_series"), (raw / correction).alias("friedman"))
    tail = chi2_tail_even(F.col("friedman"), k - 1) if k % 2 else F.pandas_udf(
        lambda x: pd.Series([special.chi2_sf(float(v), k - 1) for v in x], dtype="float64"), "double"
    )("friedman")
    cd = F.lit(NEMENYI_Q[k]) * F.sqrt(F.lit(k * (k + 1)) / (6.0 * F.col("n_series")))
    return out.withColumn("p", tail).withColumn("critical_difference", cd)


#: Values that a bootstrap's uniform numbers can have.
DRAWS = 1 << 32


def poisson_steps(draws: int = DRAWS) -> list[float]:
    """Distribution function of the Poisson law of mean one, up to the largest uniform number below one."""
    steps, term, i = [float(np.exp(-1.0))], float(np.exp(-1.0)), 0
    while steps[-1] <= 1.0 - 1.0 / draws:
        i += 1
        term /= i
        steps.append(steps[-1] + term)
    return steps[:-1]


def model_confidence_set(losses: DataFrame, unit: list[str], models: tuple[str, ...], alpha: float = 0.05, reps: int = 500, seed: int = 42) -> list[str]:
    """Models not significantly worse than the best, by a unit bootstrap.

    Losses shrink to a sum and count per (unit, model); each unit gets a Poisson weight per replication
    from the md5 digest of (seed, unit, replication), so resampling is a distributed aggregation that any engine can repeat.
    Only the (replication, model) means reach the driver, where models are eliminated one by one.
    """
    per_unit = losses.filter(F.col("model").isin(*models)).groupBy(*unit, "model").agg(F.sum("loss").alias("_s"), F.count("loss").alias("_c"))
    wide = per_unit.groupBy(*unit).pivot("model", list(models)).agg(F.first("_s"))
    size = per_unit.groupBy(*unit).agg(F.min("_c").alias("_c"), F.count(F.lit(1)).alias("_k"))
    rows = wide.join(size, unit).filter(F.col("_k") == len(models))
    drawn = rows.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in unit], F.col("_rep").cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(DRAWS))
    weight = sum(((u >= step).cast("double") for step in poisson_steps()), F.lit(0.0))
    # Replication 0 is the sample itself.
    drawn = drawn.withColumn("_w", F.when(F.col("_rep") == 0, 1.0).otherwise(weight))
    table = (
        drawn.groupBy("_rep")
        .agg(*[(F.sum(F.col("_w") * F.col(m)) / F.nullif(F.sum(F.col("_w") * F.col("_c")), F.lit(0.0))).alias(m) for m in models])
        .orderBy("_rep")
        .toPandas()
    )
    means = table.set_index("_rep")[list(models)].dropna()
    kept = list(models)
    while len(kept) > 1:
        dev = means[kept].sub(means[kept].mean(axis=1), axis=0)
        centre = dev.loc[0]
        spread = dev.loc[1:].sub(centre, axis=1)
        sd = spread.pow(2).mean().pow(0.5).replace(0.0, np.nan)
        t = (centre / sd).fillna(0.0)
        worst = t.idxmax()
        p = float((spread.div(sd, axis=1).max(axis=1) >= t[worst]).mean())
        if p >= alpha:
            break
        kept.remove(worst)
    return kept


def _discordant_in(entries: Column) -> Column:
    """Pairs of entries (k, c) of which the earlier has the larger k, each as often as its rows have it."""

    def after(i: Column) -> Column:
        one = F.get(entries, i)
        less = F.filter(F.slice(entries, i + 2, F.lit(BLOCK)), lambda e: _unsigned(e["k"]) < _unsigned(one["k"]))
        return one["c"].cast("double") * F.aggregate(less, F.lit(0).cast("bigint"), lambda total, e: total + e["c"])

    return F.aggregate(F.sequence(F.lit(0), F.size(entries) - 1), F.lit(0.0), lambda total, i: total + after(i))


def _unsigned(key: Column) -> Column:
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def counted_ties(ordered: DataFrame) -> DataFrame:
    """Pairs of a feature's rows that agree on x and y."""
    c = F.col("c").cast("double")
    return ordered.groupBy("feature").agg(F.sum(c * (c - 1) / 2).alias("xytie"))


def kendall(long: DataFrame) -> DataFrame:
    """Kendall tau-b of every feature with the target, asymptotic p with tie correction.

    ``long`` has ``feature``, ``x`` and ``y``. Equal (x, y) rows count as one, with their number. Rows are dealt by range in the
    order of (x, y) and cut into blocks of ``BLOCK``, and two rows of different blocks are discordant if the earlier has the larger
    y: there is exactly one digit at which their keys first differ. So a row's key of y, a digit of ``DIGIT`` bits at a
    time, puts it in one node for each digit (the bits before it), and a group-by counts the digits of each block and
    node; what earlier blocks of the node have of larger digits, times what the block has, adds up to all such pairs.
    Pairs within a block are counted in its array. No pair is emitted, no task holds a feature: the largest group has
    a row for each block.
    """
    rows = long.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    counted = rows.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    ordered = counted.repartitionByRange("feature", "x", "y").sortWithinPartitions("feature", "x", "y")
    # consecutive ids follow the order; keys are made unsigned, so that their bits order them
    key = sort_key(F.col("y").cast("double")).bitwiseXOR(F.lit(-(1 << 63)))
    ordered = numbered(ordered.withColumn("k", key), "_id", "kendall").withColumn("_block", F.shiftright("_id", BLOCK_BITS))

    entries = F.sort_array(F.collect_list(F.struct("_id", "k", "c")))
    blocks = ordered.groupBy("feature", "_block").agg(entries.alias("_e"))
    # bits that all keys share need no count
    bits = ordered.agg(F.bit_or("k").alias("some"), F.bit_and("k").alias("all")).first()
    differ = 0 if bits["some"] is None else (bits["some"] & ~bits["all"]) & ((1 << 64) - 1)
    shifts = [s for s in range(64 - DIGIT, -1, -DIGIT) if differ >> s & (2**DIGIT - 1)]

    inside = blocks.select("feature", _discordant_in(F.col("_e")).alias("d"))
    parts = inside
    if shifts:
        each = blocks.select("feature", "_block", F.explode("_e").alias("_e"), F.lit(0).alias("_"))
        each = each.select("feature", "_block", F.col("_e.k").alias("k"), F.col("_e.c").alias("c"), F.explode(F.array(*map(F.lit, shifts))).alias("shift"))
        at = lambda s: F.expr(f"shiftrightunsigned(k, {s})")
        node = F.when(F.col("shift") == 64 - DIGIT, F.lit(0).cast("bigint")).otherwise(at(f"shift + {DIGIT}"))
        each = each.withColumn("node", node).withColumn("digit", at("shift").bitwiseAND(F.lit(2**DIGIT - 1)))
        digits = range(2**DIGIT)
        counts = each.groupBy("feature", "_block", "shift", "node").agg(*[F.sum(F.when(F.col("digit") == d, F.col("c")).otherwise(0)).alias(f"d{d}") for d in digits])
        earlier = Window.partitionBy("feature", "shift", "node").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        larger = [sum((F.col(f"d{e}") for e in range(d + 2, 2**DIGIT)), F.col(f"d{d + 1}")) for d in range(2**DIGIT - 1)]
        pairs = [F.col(f"d{d}").cast("double") * F.coalesce(F.sum(more).over(earlier), F.lit(0)) for d, more in enumerate(larger)]
        parts = parts.unionByName(counts.select("feature", sum(pairs[1:], pairs[0]).alias("d")))
    discordant = parts.groupBy("feature").agg(F.sum("d").alias("_d"))
    both = counted_ties(ordered)
    score = discordant.join(both, "feature")

    def ties(col: str, prefix: str) -> DataFrame:
        t = F.col("_t").cast("double")
        counted = ordered.groupBy("feature", col).agg(F.sum("c").alias("_t"))
        return counted.groupBy("feature").agg(
            F.sum(t * (t - 1) / 2).alias(f"{prefix}tie"),
            F.sum(t * (t - 1) * (t - 2)).alias(f"{prefix}0"),
            F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{prefix}1"),
            F.sum("_t").alias(f"{prefix}n"),
        )

    out = score.join(ties("x", "x"), "feature").join(ties("y", "y"), "feature")
    n = F.col("xn").cast("double")
    m = n * (n - 1)
    # comparable pairs, less the discordant ones twice
    out = out.withColumn("s", m / 2 - F.col("xtie") - F.col("ytie") + F.col("xytie") - 2 * F.col("_d"))
    tau = F.col("s") / F.nullif(F.sqrt((m / 2 - F.col("xtie")) * (m / 2 - F.col("ytie"))), F.lit(0.0))
    var = (
        (m * (2 * n + 5) - F.col("x1") - F.col("y1")) / 18
        + 2 * F.col("xtie") * F.col("ytie") / m
        + F.col("x0") * F.col("y0") / (9 * m * (n - 2))
    )
    z = F.abs(F.col("s")) / F.nullif(F.sqrt(var), F.lit(0.0))
    tail = F.pandas_udf(lambda v: pd.Series([1.0 if pd.isna(a) else 2 * special.normal_sf(float(a)) for a in v], dtype="float64"), "double")
    return out.select("feature", F.col("xn").alias("n"), "s", tau.alias("tau"), F.coalesce(tail(z), F.lit(1.0)).alias("p"))


def fdr_by(pvalues: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Yekutieli: everything up to the last p under its line is kept (a handful of features)."""
    w = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(w.orderBy("p", "feature"))
    m = F.count(F.lit(1)).over(w)
    harmonic = F.sum(1.0 / F.col("_i")).over(w)
    df = pvalues.withColumn("_i", rank).withColumn("_m", m).withColumn("_c", harmonic)
    passing = F.when(F.col("p") <= F.col("_i") * alpha / (F.col("_m") * F.col("_c")), F.col("_i"))
    return df.withColumn("_last", F.max(passing).over(w)).withColumn(
        "relevant", F.coalesce(F.col("_i") <= F.col("_last"), F.lit(False))
    ).drop("_i", "_m", "_c", "_last")


def spearman_matrix(long: DataFrame, row_id: list[str], features: list[str]) -> DataFrame:
    """|Spearman| of each pair of features: distributed ranks, then one aggregate per pair."""
    ranks = average_ranks(long, ["feature"], "x", {}).select("feature", "x", "rank")
    wide = long.join(ranks, ["feature", "x"]).groupBy(*row_id).pivot("feature", features).agg(F.first("rank"))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    agg = wide.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(F.col(f"`{a}~{b}`")).alias("rho")) for a, b in pairs]
    return agg.select(F.inline(F.array(*rows)))


def select_features(long: DataFrame, row_id: list[str], alpha: float = 0.05, threshold: float = 0.9) -> tuple[list[str], dict[str, str]]:
    """Relevant features by p-value order, dropping those too correlated with one already kept."""
    long = stage(long, "feature-selection")
    ranked = fdr_by(kendall(long), alpha).filter("relevant").orderBy("p", "feature").collect()
    order = [r["feature"] for r in ranked]
    if len(order) < 2:
        return order, {}
    rho = {(r["a"], r["b"]): r["rho"] for r in spearman_matrix(long.filter(F.col("feature").isin(*order)), row_id, order).collect()}
    kept: list[str] = []
    dropped: dict[str, str] = {}
    for name in order:
        twin = next((k for k in kept if (rho.get((k, name)) or rho.get((name, k)) or 0.0) > threshold), None)
        if twin is None:
            kept.append(name)
        else:
            dropped[name] = twin
    return kept, dropped


def feature_table(level: DataFrame) -> DataFrame:
    """All characteristics side by side, one row per series."""
    parts = decompose(level)
    steps = level.withColumn("delta", F.col("level") - F.lag("level").over(over_series()))
    out = shape_features(level)
    for other in (tiled(level), strengths(parts), outliers(parts), ndiffs(level), spectral_entropy(level), permutation_entropy(level),
                  ljung_box(steps, "delta", 2 * SEASON).select(*SERIES, F.col("lb_p").alias("ljung_box_p"))):
        out = out.join(other, SERIES, "left")
    return out


def validate_features(features: DataFrame) -> DataFrame:
    """Range contract of the feature table, as violations per rule."""
    unit = lambda c: F.col(c).between(0, 1)
    checks = {f"{c}_in_unit": unit(c) for c in ("trend_strength", "seasonal_strength", "spectral_entropy", "ljung_box_p")}
    checks |= {"ndiffs_range": F.col("ndiffs").between(0, 2), "outliers_not_negative": F.col("n_outliers") >= 0}
    return validate(features, Contract(checks=checks, keys={"one_row_per_series": tuple(SERIES)}))
