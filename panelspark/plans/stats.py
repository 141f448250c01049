"""Series characterisation and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import SERIES
from panelspark.operators import forecast as FC
from panelspark.operators import metrics as ME
from panelspark.operators import series as S
from panelspark.operators import stats as ST
from panelspark.plans.ctes import KEY, W, register, sql
from panelspark.plans.governance import series_errors
from panelspark.plans.protocol import SHORT, obs, r6
from panelspark.plans.registry import query

PK = f"PARTITION BY {KEY}"


def level(spark, sf):
    return S.densify(obs(spark, sf)).select(*SERIES, "bulletin_date", "level")


register(
    "centred",
    ("sdy",),
    f"""SELECT *, lag(cy) OVER ({W}) AS py, lag(cd) OVER ({W}) AS pd FROM (
          SELECT {KEY}, m, level, dy, level - avg(level) OVER ({PK}) AS cy, dy - avg(dy) OVER ({PK}) AS cd FROM sdy)""",
)


@query(
    "shape_features",
    "N1",
    sql(
        f"""SELECT {KEY}, count(*) AS n, round(sum(cy * py) / nullif(sum(cy * cy), 0), 6) AS acf1, round(sum(cd * pd) / nullif(sum(cd * cd), 0), 6) AS acf1_diff,
              round(avg(cd^3) / nullif(avg(cd^2)^1.5, 0), 6) AS step_skew, round(avg(cd^4) / nullif(avg(cd^2)^2, 0) - 3, 6) AS step_kurtosis
            FROM centred GROUP BY ALL""",
        "centred",
    ),
)
def _shape(spark, sf):
    return ST.shape_features(level(spark, sf)).withColumns(r6("acf1", "acf1_diff", "step_skew", "step_kurtosis"))


@query(
    "tile_variances",
    "N2",
    sql(
        f"""WITH t AS (SELECT {KEY}, (pos - 1) // 12 AS tile, avg(level) AS a, var_pop(level) AS v FROM slev
                       WHERE (pos - 1) // 12 < n_grid // 12 GROUP BY ALL)
            SELECT {KEY}, round(CASE WHEN count(*) >= 2 THEN var_pop(a) ELSE 0.0 END, 4) AS stability,
                   round(ln(1 + CASE WHEN count(*) >= 2 THEN var_pop(v) ELSE 0.0 END), 6) AS log_lumpiness FROM t GROUP BY ALL""",
        "slev",
    ),
)
def _tiles(spark, sf):
    return ST.tiled(level(spark, sf)).select(*SERIES, F.round("stability", 4).alias("stability"), F.round(F.log1p("lumpiness"), 6).alias("log_lumpiness"))


register(
    "decomp",
    ("slev",),
    f"""SELECT *, detr - season AS resid FROM (
          SELECT *, CASE WHEN trend IS NOT NULL THEN avg(detr) OVER (PARTITION BY {KEY}, month(m)) - avg(detr) OVER ({PK}) END AS season FROM (
            SELECT *, level - trend AS detr FROM (
              SELECT {KEY}, m, level, (sum(level) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
                + (lag(level, 6) OVER ({W}) + lead(level, 6) OVER ({W})) / 2) / 12 AS trend FROM slev)))""",
)


@query(
    "trend_season_strength",
    "N3",
    sql(
        f"""SELECT {KEY}, round(coalesce(greatest(0.0::DOUBLE, 1 - var_pop(resid) / nullif(var_pop(trend + resid), 0)), 0.0), 6) AS trend_strength,
              round(coalesce(greatest(0.0::DOUBLE, 1 - var_pop(resid) / nullif(var_pop(season + resid), 0)), 0.0), 6) AS seasonal_strength
            FROM decomp GROUP BY ALL""",
        "decomp",
    ),
)
def _strength(spark, sf):
    return ST.strengths(ST.decompose(level(spark, sf))).withColumns(r6("trend_strength", "seasonal_strength"))


@query(
    "residual_outliers",
    "N4",
    sql(
        f"""WITH a AS (SELECT {KEY}, resid - median(resid) OVER ({PK}) AS dev FROM decomp WHERE resid IS NOT NULL),
                 b AS (SELECT *, median(abs(dev)) OVER ({PK}) AS mad FROM a)
            SELECT {KEY}, count(*) FILTER (abs(0.6745 * dev / CASE WHEN mad = 0 THEN 1 ELSE mad END) > 3) AS n_outliers FROM b GROUP BY ALL""",
        "decomp",
    ),
)
def _outliers(spark, sf):
    return ST.outliers(ST.decompose(level(spark, sf)))


_FRAME = f"({W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)"


@query(
    "point_anomalies",
    "W14",
    sql(
        f"""WITH a AS (SELECT {KEY}, m, CASE WHEN count(resid) OVER {_FRAME} >= 6 THEN abs(resid - median(resid) OVER {_FRAME}) END AS dev
                       FROM decomp WHERE resid IS NOT NULL),
                 b AS (SELECT *, CASE WHEN count(dev) OVER {_FRAME} >= 6 THEN median(dev) OVER {_FRAME} END AS mad FROM a)
            SELECT {KEY}, m AS bulletin_date, round(dev, 6) AS deviation FROM b WHERE 1.4826 * mad > 0 AND dev > 3 * 1.4826 * mad""",
        "decomp",
    ),
)
def _hampel(spark, sf):
    flagged = ST.hampel(ST.decompose(level(spark, sf))).filter("anomaly")
    return flagged.select(*SERIES, "bulletin_date", F.round("_dev", 6).alias("deviation"))


_LB = " + ".join(f"power(sum(cd * l{k}) / nullif(sum(cd * cd), 0), 2) / (count(*) - {k})" for k in range(1, 13))
_POISSON = "1" + "".join(
    f" + power(q / 2, {i}) / {f}" for i, f in zip(range(1, 6), (1, 2, 6, 24, 120), strict=True)
)


@query(
    "ljung_box",
    "N10",
    sql(
        f"""WITH l AS (SELECT {KEY}, cd, """
        + ", ".join(f"lag(cd, {k}) OVER ({W}) AS l{k}" for k in range(1, 13))
        + f""" FROM centred WHERE dy IS NOT NULL),
             s AS (SELECT {KEY}, count(*) AS n, count(*) * (count(*) + 2) * ({_LB}) AS q FROM l GROUP BY ALL HAVING count(*) >= 24)
        SELECT {KEY}, n, CAST(12 AS INTEGER) AS lb_lags, round(q, 6) AS lb_q, round(exp(-q / 2) * ({_POISSON}), 6) AS lb_p FROM s""",
        "centred",
    ),
)
def _lb(spark, sf):
    steps = S.difference(level(spark, sf), "level")
    return ST.ljung_box(steps, "delta").filter(F.col("n") >= 24).withColumns(r6("lb_q", "lb_p"))


_KP = " + ".join(
    f"CASE WHEN {k} <= lg THEN 2 * (1 - {k} / (lg + 1)) * coalesce(g{k}, 0) ELSE 0 END" for k in range(1, 13)
)


def _kpss_cte(col: str, source: str) -> str:
    return f"""SELECT {KEY}, eta / (n * n) / nullif((g0 + {_KP}) / n, 0) AS k FROM (
        SELECT {KEY}, count(*) AS n, sum(cum * cum) AS eta, sum(e * e) AS g0, floor(4 * power(count(*) / 100.0, 0.25)) AS lg, """ + ", ".join(
        f"sum(e * l{k}) AS g{k}" for k in range(1, 13)
    ) + f""" FROM (SELECT *, sum(e) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, """ + ", ".join(
        f"lag(e, {k}) OVER ({W}) AS l{k}" for k in range(1, 13)
    ) + f""" FROM (SELECT {KEY}, m, {col} - avg({col}) OVER ({PK}) AS e FROM {source} WHERE {col} IS NOT NULL)) GROUP BY ALL)"""


register("kpss_y", ("fs",), _kpss_cte("y", "fs"))
register("kpss_level", ("sdy",), _kpss_cte("level", "sdy"))
register("kpss_step", ("sdy",), _kpss_cte("dy", "sdy"))
register(
    "dfuller",
    ("fs",),
    f"""SELECT {KEY}, (sxy / nullif(sxx, 0)) / nullif(sqrt(greatest(syy - sxy * sxy / nullif(sxx, 0), 0) / (n - 2) / sxx), 0) AS t FROM (
          SELECT {KEY}, regr_count(d, x) AS n, regr_sxx(d, x) AS sxx, regr_sxy(d, x) AS sxy, regr_syy(d, x) AS syy FROM (
            SELECT *, lag(y) OVER ({W}) AS x, y - lag(y) OVER ({W}) AS d FROM fs) GROUP BY ALL) WHERE n > 3""",
)


def _interp(x: str, table) -> str:
    out = f"CASE WHEN {x} <= {table[0][0]} THEN {table[0][1]}"
    for (x0, p0), (x1, p1) in zip(table, table[1:], strict=False):
        out += f" WHEN {x} <= {x1} THEN {p0} + ({x} - {x0}) * {(p1 - p0) / (x1 - x0)}"
    return out + f" ELSE {table[-1][1]} END"


@query(
    "stationarity",
    "N11",
    sql(
        f"""SELECT {KEY}, round(k, 6) AS kpss, round(t, 6) AS df_t, round(kp, 6) AS kpss_p, round(dp, 6) AS df_p,
              CASE WHEN dp < 0.05 AND kp >= 0.05 THEN 'stationary' WHEN dp >= 0.05 AND kp < 0.05 THEN 'difference' ELSE 'mixed' END AS verdict
            FROM (SELECT *, {_interp("k", ST.KPSS_TABLE)} AS kp, {_interp("t", ST.DF_TABLE)} AS dp
                  FROM kpss_y JOIN dfuller USING ({KEY}))""",
        "kpss_y",
        "dfuller",
    ),
)
def _stationarity(spark, sf):
    return ST.stationarity(obs(spark, sf)).withColumns(r6("kpss", "df_t", "kpss_p", "df_p"))


@query(
    "differences_needed",
    "N15",
    sql(
        f"""SELECT {KEY}, CAST(CASE WHEN coalesce(a.k <= 0.463, true) THEN 0 WHEN coalesce(b.k <= 0.463, true) THEN 1 ELSE 2 END AS INTEGER) AS ndiffs
            FROM kpss_level a LEFT JOIN kpss_step b USING ({KEY})""",
        "kpss_level",
        "kpss_step",
    ),
)
def _ndiffs(spark, sf):
    return ST.ndiffs(level(spark, sf))


@query(
    "permutation_entropy",
    "N12",
    sql(
        f"""WITH p AS (SELECT {KEY}, (a <= b) || '' || (a <= c) || '' || (b <= c) AS pat, count(*) AS n FROM (
              SELECT {KEY}, level AS a, lead(level) OVER ({W}) AS b, lead(level, 2) OVER ({W}) AS c FROM slev) WHERE c IS NOT NULL GROUP BY ALL)
            SELECT {KEY}, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(6), 6) AS perm_entropy FROM p GROUP BY ALL""",
        "slev",
    ),
)
def _perm(spark, sf):
    return ST.permutation_entropy(level(spark, sf)).withColumns(r6("perm_entropy"))


@query(
    "spectral_entropy",
    "N12",
    sql(
        f"""WITH f AS (SELECT {KEY}, k, power(sum(cy * cos(2 * pi() * k * (pos - 1) / n)), 2) + power(sum(cy * sin(2 * pi() * k * (pos - 1) / n)), 2) AS s,
                          any_value(n) AS n
                       FROM (SELECT c.country, c.block, c.category, c."table", c.cy, g.pos, g.n_grid AS n, unnest(generate_series(0, g.n_grid // 2)) AS k
                             FROM centred c JOIN slev g USING (country, block, category, "table", m)) GROUP BY ALL),
                 w AS (SELECT {KEY}, CASE WHEN k = 0 OR 2 * k = n THEN s ELSE 2 * s END AS s FROM f),
                 p AS (SELECT {KEY}, s / sum(s) OVER ({PK}) AS p FROM (SELECT *, max(s) OVER ({PK}) AS mx FROM w) WHERE s > 1e-9 * mx)
            SELECT {KEY}, round(CASE WHEN count(*) <= 1 THEN 1.0 ELSE -sum(p * ln(p)) / ln(count(*)) END, 6) AS spectral_entropy FROM p GROUP BY ALL""",
        "centred",
        "slev",
    ),
)
def _spectral(spark, sf):
    return ST.spectral_entropy(level(spark, sf)).withColumns(r6("spectral_entropy"))


@query("arch_effect", "N13")
def _arch(spark, sf):
    return ST.arch_lm(S.difference(obs(spark, sf))).withColumns(r6("arch_lm", "arch_p"))


def error_pairs(spark, sf):
    wide = FC.one_step(obs(spark, sf), SHORT).filter(F.col("y").isNotNull())
    return wide.select(
        *SERIES,
        F.col("bulletin_date").alias("date"),
        (F.col("y") - F.col("naive1")).alias("e1"),
        (F.col("y") - F.col("seasonal")).alias("e2"),
    )


register(
    "epairs",
    ("onestep",),
    f"SELECT {KEY}, m, power(y - naive1, 2) - power(y - seasonal, 2) AS d FROM onestep WHERE y IS NOT NULL",
)
register(
    "dmstat",
    ("epairs",),
    f"""SELECT {KEY}, n, CASE WHEN v > 0 THEN a / sqrt(v / n) * sqrt((n + 1 - 6 + 6.0 / n) / n) ELSE 0 END AS dm FROM (
          SELECT {KEY}, count(*) AS n, avg(d) AS a, var_pop(d) + 2 * coalesce(covar_pop(d, d1), 0) + 2 * coalesce(covar_pop(d, d2), 0) AS v FROM (
            SELECT *, lag(d) OVER ({W}) AS d1, lag(d, 2) OVER ({W}) AS d2 FROM epairs) GROUP BY ALL)""",
)


@query(
    "diebold_mariano",
    "N6",
    sql(f"SELECT {KEY}, n, round(dm, 6) AS dm FROM dmstat", "dmstat"),
)
def _dm(spark, sf):
    return ST.dm_statistic(error_pairs(spark, sf), SERIES, 3).withColumns(r6("dm"))


@query("diebold_mariano_test", "N6")
def _dm_test(spark, sf):
    return ST.dm_test(error_pairs(spark, sf), SERIES, 3).withColumns(r6("dm", "p"))


@query(
    "giacomini_white",
    "N7",
    sql(
        f"""SELECT {KEY}, n, round(gw, 6) AS gw, round(exp(-gw / 2), 6) AS p FROM (
              SELECT {KEY}, n, (n - 1) * (a * a * bb - 2 * a * b * ab + b * b * aa) / nullif(aa * bb - ab * ab, 0) AS gw FROM (
                SELECT {KEY}, max(n) AS n, avg(d) AS a, avg(g) AS b, var_samp(d) AS aa, covar_samp(d, g) AS ab, var_samp(g) AS bb FROM (
                  SELECT *, d * lag(d) OVER ({W}) AS g, count(*) OVER ({PK}) AS n FROM epairs) WHERE g IS NOT NULL GROUP BY ALL) WHERE n >= 5)""",
        "epairs",
    ),
)
def _gw(spark, sf):
    return ST.gw_test(error_pairs(spark, sf), SERIES).withColumns(r6("gw", "p"))


@query(
    "friedman_test",
    "N8 W21",
    sql(
        f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY {KEY}, rk) AS t FROM mranks WHERE k = 3),
                 s AS (SELECT model, sum(rk) AS s, count(*) AS n, sum(t * t - 1) AS ties FROM r GROUP BY ALL),
                 q AS (SELECT max(n) AS n_series, (12.0 / (max(n) * 12) * sum(s * s) - 12.0 * max(n)) / (1 - sum(ties) / (max(n) * 24.0)) AS f FROM s)
            SELECT n_series, round(f, 6) AS friedman, round(exp(-f / 2), 6) AS p, round(2.343 * sqrt(12 / (6.0 * n_series)), 6) AS critical_difference FROM q""",
        "mranks",
    ),
)
def _friedman(spark, sf):
    return ST.friedman(series_errors(spark, sf), FC.BASELINES).withColumns(r6("friedman", "p", "critical_difference"))


_STEPS = ", ".join(f"{v:.17e}" for v in ST.poisson_steps())
register(
    "bootmeans",
    ("onelong",),
    f"""WITH u AS (SELECT {KEY}, model, sum((y - forecast)^2) AS s, count(*) AS c FROM onelong WHERE region = 'holdout' AND y IS NOT NULL GROUP BY ALL),
             n AS (SELECT {KEY}, min(c) AS c FROM u GROUP BY ALL HAVING count(*) = 3),
             w AS (SELECT n.*, r, CASE WHEN r = 0 THEN 1.0 ELSE len(list_filter([{_STEPS}], lambda x:
                     ('0x' || substr(md5(concat_ws('|', '42', country, block, category, "table", r)), 1, 8))::BIGINT / {float(ST.DRAWS)!r} >= x)) END AS w
                   FROM n, (SELECT unnest(range(501)) AS r)),
             v AS (SELECT r, model, sum(w * s) / nullif(sum(w * w.c), 0) AS v FROM w JOIN u USING ({KEY}) GROUP BY ALL)
        SELECT * FROM v WHERE r IN (SELECT r FROM v GROUP BY r HAVING count(v) = 3)""",
)


def _eliminate(kept: str) -> str:
    """One step: the models in ``kept`` without the worst, if it is significantly worse than the others."""
    return f"""
      SELECT model FROM {kept} WHERE (SELECT count(*) FROM {kept}) < 2 OR model NOT IN (
        WITH d AS (SELECT r, model, v - avg(v) OVER (PARTITION BY r) AS d FROM bootmeans WHERE model IN (SELECT model FROM {kept})),
             c AS (SELECT d.r, d.model, d.d - z.d AS e, z.d AS centre FROM d JOIN d z ON z.r = 0 AND z.model = d.model WHERE d.r > 0),
             t AS (SELECT model, sqrt(avg(e * e)) AS sd, coalesce(any_value(centre) / nullif(sqrt(avg(e * e)), 0), 0) AS t FROM c GROUP BY model),
             m AS (SELECT r, max(e / nullif(sd, 0)) AS m FROM c JOIN t USING (model) GROUP BY r)
        SELECT arg_max(model, t) FROM t HAVING (SELECT avg(CASE WHEN m >= (SELECT max(t) FROM t) THEN 1.0 ELSE 0.0 END) FROM m) < 0.05)"""


register("kept0", ("bootmeans",), "SELECT DISTINCT model FROM bootmeans")
register("kept1", ("kept0",), _eliminate("kept0"))
register("kept2", ("kept1",), _eliminate("kept1"))


@query("model_confidence_set", "N9", sql("SELECT model, model IN (SELECT model FROM kept2) AS included FROM kept0", "kept2"))
def _mcs(spark, sf):
    long = FC.one_step_long(obs(spark, sf), SHORT).filter((F.col("region") == "holdout") & F.col("y").isNotNull())
    losses = long.withColumn("loss", F.pow(F.col("y") - F.col("forecast"), F.lit(2.0)))
    kept = ST.model_confidence_set(losses, SERIES, FC.BASELINES)
    models = losses.select("model").distinct()
    return models.withColumn("included", F.col("model").isin(*kept))


FEATURES = ["n", "mean_step", "sd_step", "share_frozen", "share_retro"]


def step_features(spark, sf):
    """Candidate features per series against its seasonal scale."""
    o = obs(spark, sf)
    d = S.difference(o)
    feats = d.groupBy(*SERIES).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.round(F.avg("delta"), 6).alias("mean_step"),
        F.round(F.stddev_samp("delta"), 6).alias("sd_step"),
        F.round(F.avg((F.col("delta") == 0).cast("double")), 6).alias("share_frozen"),
        F.round(F.avg((F.col("delta") < 0).cast("double")), 6).alias("share_retro"),
    )
    target = ME.naive_scale(o).select(*SERIES, F.round("scale", 6).alias("y"))
    return feats.join(target, SERIES).unpivot([*SERIES, "y"], FEATURES, "feature", "x")


register(
    "sfeat",
    ("sd", "sdiffs"),
    f"""SELECT * FROM (SELECT {KEY}, CAST(count(*) AS DOUBLE) AS n, round(avg(d), 6) AS mean_step, round(stddev_samp(d), 6) AS sd_step,
          round(avg(CASE WHEN d = 0 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 6) AS share_frozen,
          round(avg(CASE WHEN d < 0 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 6) AS share_retro FROM sd GROUP BY ALL)
        JOIN (SELECT {KEY}, round(nullif(CASE WHEN count(*) > 12 THEN avg(dm) ELSE avg(d1) END, 0), 6) AS y FROM sdiffs GROUP BY ALL) USING ({KEY})""",
)
register("sflong", ("sfeat",), " UNION ALL ".join(f"SELECT {KEY}, '{f}' AS feature, {f} AS x, y FROM sfeat" for f in FEATURES))


@query(
    "kendall_relevance",
    "N14",
    sql(
        """WITH p AS (SELECT a.feature, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM sflong a JOIN sflong b ON a.feature = b.feature
                        AND (a.country, a.block, a.category, a."table") < (b.country, b.block, b.category, b."table")
                      WHERE a.x IS NOT NULL AND b.x IS NOT NULL AND a.y IS NOT NULL AND b.y IS NOT NULL),
                q AS (SELECT feature, sum(sx * sy) AS s, count(*) FILTER (sx <> 0) AS nx, count(*) FILTER (sy <> 0) AS ny FROM p GROUP BY ALL)
           SELECT feature, CAST(s AS DOUBLE) AS s, round(s / sqrt(CAST(nx AS DOUBLE) * ny), 6) AS tau,
             (SELECT count(*) FROM sflong f WHERE f.feature = q.feature AND f.x IS NOT NULL AND f.y IS NOT NULL) AS n FROM q""",
        "sflong",
    ),
)
def _kendall(spark, sf):
    return ST.kendall(step_features(spark, sf)).drop("p").withColumns(r6("tau"))


@query("selected_features", "N14")
def _selected(spark, sf):
    kept, dropped = ST.select_features(step_features(spark, sf), SERIES)
    used = step_features(spark, sf).groupBy("feature").agg(F.count("x").alias("n"))
    cover = F.when(F.col("feature").isin(*kept), "selected")
    for name, twin in dropped.items():
        cover = cover.when(F.col("feature") == name, f"covered by {twin}")
    return used.withColumn("verdict", cover.otherwise("not relevant"))


@query(
    "spearman_matrix",
    "N14",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{a}' AS a, '{b}' AS b, round(abs(corr(ra, rb)), 6) AS rho FROM (
                  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
                         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM sfeat)"""
            for i, a in enumerate(FEATURES)
            for b in FEATURES[i + 1 :]
        ),
        "sfeat",
    ),
)
def _spearman(spark, sf):
    return ST.spearman_matrix(step_features(spark, sf), SERIES, FEATURES).withColumns(r6("rho"))


@query("series_feature_table", "N1 N2 N3 N4 N10 N12 N15")
def _features(spark, sf):
    return ST.feature_table(level(spark, sf))


@query("feature_contract", "N16")
def _feature_contract(spark, sf):
    return ST.validate_features(ST.feature_table(level(spark, sf)))
