"""Rolling-origin forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import HORIZONS, QUANTILE_LEVELS, SERIES
from panelspark.operators import aggregates as A
from panelspark.operators import forecast as FC
from panelspark.operators import metrics as ME
from panelspark.operators import series as S
from panelspark.operators import setops as SO
from panelspark.operators import smoothing as SM
from panelspark.plans.ctes import KEY, W, register, sql
from panelspark.plans.protocol import SHORT, area_obs, obs, r6, settle, settle_sql
from panelspark.plans.registry import query
from panelspark.plans.states import MINTRAIN, ahead

# One-step forecasts of the three baselines on the dense grid, with the walk-forward region.
register(
    "onestep",
    ("slev",),
    f"""SELECT *, CASE WHEN m >= hold_start THEN 'holdout' ELSE 'selection' END AS region FROM (
          SELECT {KEY}, m, y, level, pos, n_grid, lag(level) OVER ({W}) AS naive1, lag(level, 12) OVER ({W}) AS seasonal,
            lag(level) OVER ({W}) + (lag(level) OVER ({W}) - first_value(level) OVER ({W})) / nullif(pos - 2, 0) AS drift,
            CAST(max(m) OVER (PARTITION BY {KEY}) - INTERVAL 23 MONTH AS DATE) AS hold_start
          FROM slev) WHERE n_grid >= {MINTRAIN} + 30 AND (pos > {MINTRAIN} OR m >= hold_start)""",
)
register(
    "onelong",
    ("onestep",),
    " UNION ALL ".join(
        f"SELECT {KEY}, m, y, region, hold_start, '{n}' AS model, {n} AS forecast FROM onestep" for n in FC.BASELINES
    ),
)
register(
    "sdiffs",
    ("fs",),
    f"""SELECT *, abs(y - lag(y, 12) OVER ({W})) AS dm, abs(y - lag(y) OVER ({W})) AS d1,
               CAST(max(m) OVER (PARTITION BY {KEY}) - INTERVAL 23 MONTH AS DATE) AS hold_start FROM fs""",
)
register(
    "hscale",
    ("sdiffs",),
    f"""SELECT {KEY}, hold_start, nullif(CASE WHEN count(*) FILTER (m < hold_start) > 12 THEN avg(dm) FILTER (m < hold_start)
               ELSE avg(d1) FILTER (m < hold_start) END, 0) AS scale, nullif(avg(d1) FILTER (m < hold_start), 0) AS scale1
        FROM sdiffs GROUP BY ALL""",
)


@query(
    "naive_scale",
    "W15",
    sql(
        f"""SELECT {KEY}, count(*) AS n, round(nullif(CASE WHEN count(*) > 12 THEN avg(dm) ELSE avg(d1) END, 0), 6) AS scale
            FROM sdiffs GROUP BY ALL""",
        "sdiffs",
    ),
)
def _scale(spark, sf):
    return ME.naive_scale(obs(spark, sf)).withColumns(r6("scale"))


def monthly_cutoffs(o):
    """A cutoff at every grid month, the dense case of vintage scoring."""
    return S.densify(o).select(*SERIES, F.col("bulletin_date").alias("cutoff"))


@query(
    "scale_before_cutoff",
    "J7",
    sql(
        f"""SELECT c.country, c.block, c.category, c."table", c.m AS cutoff, count(d.m) AS n_history,
              round(nullif(CASE WHEN count(d.m) > 12 THEN avg(dm) ELSE avg(d1) END, 0), 6) AS scale
            FROM slev c
            LEFT JOIN sdiffs d ON d.country = c.country AND d.block = c.block AND d.category = c.category
              AND d."table" = c."table" AND d.m < c.m GROUP BY ALL""",
        "slev",
        "sdiffs",
    ),
)
def _scale_before(spark, sf):
    o = obs(spark, sf)
    return ME.scale_before(o, monthly_cutoffs(o)).withColumns(r6("scale"))


# Rolling origins, by explicit (origin, target) pairs here.
register(
    "rolling",
    ("lev",),
    f"""SELECT * FROM (
          SELECT o.country, o.block, o.category, o."table", t.m AS date, t.y AS actual, h,
            o.level AS naive1, s.level AS seasonal, o.level + h * (o.level - f.level) / nullif(o.pos - 1, 0) AS drift, o.pos AS origin
          FROM (SELECT *, {MINTRAIN} AS mt, least(60, n_grid - {MINTRAIN}) AS reach FROM lev) o
          CROSS JOIN (SELECT unnest([{", ".join(map(str, HORIZONS))}]) AS h) hs
          JOIN lev t USING (country, block, category, "table")
          LEFT JOIN lev s ON s.country = o.country AND s.block = o.block AND s.category = o.category AND s."table" = o."table"
            AND s.pos = t.pos - 12 * CAST(ceil(h / 12) AS BIGINT)
          JOIN lev f ON f.country = o.country AND f.block = o.block AND f.category = o.category AND f."table" = o."table" AND f.pos = 1
          WHERE t.pos = o.pos + h AND o.pos >= mt AND o.pos <= o.n_grid - reach AND h <= reach AND t.y IS NOT NULL)""",
)
register(
    "rollong",
    ("rolling",),
    " UNION ALL ".join(
        f"SELECT country, block, category, \"table\", date, actual, CAST(h AS INTEGER) AS h, '{n}' AS model, {n} AS forecast FROM rolling WHERE {n} IS NOT NULL"
        for n in FC.BASELINES
    ),
)


@query(
    "rolling_baselines",
    "E1",
    sql(f"SELECT {KEY}, date, actual, model, h, round(forecast, 6) AS forecast FROM rollong", "rollong"),
)
def _rolling(spark, sf):
    return FC.rolling_baselines(area_obs(spark, sf), HORIZONS, SHORT).withColumns(r6("forecast"))


register(
    "ascale",
    ("f",),
    f"""SELECT {KEY}, nullif(CASE WHEN count(*) FILTER (m < hs) > 12 THEN avg(dm) FILTER (m < hs) ELSE avg(d1) FILTER (m < hs) END, 0) AS scale
        FROM (SELECT *, abs(y - lag(y, 12) OVER ({W})) AS dm, abs(y - lag(y) OVER ({W})) AS d1,
                     CAST(max(m) OVER (PARTITION BY {KEY}) - INTERVAL 23 MONTH AS DATE) AS hs FROM f) GROUP BY ALL""",
)
_SMOOTH = ahead("s", "h")
register(
    "candidates",
    ("rolling", "rollong", "states"),
    "SELECT * FROM rollong"
    + "".join(
        f""" UNION ALL SELECT country, block, category, "table", date, actual, CAST(h AS INTEGER), '{m}', {f}
             FROM rolling r JOIN states s USING (country, block, category, "table") WHERE s.pos = r.origin"""
        for m, f in _SMOOTH.items()
    ),
)
register(
    "mbh",
    ("candidates", "ascale"),
    f"""SELECT model, {KEY}, h, count(*) AS n, avg(abs(actual - forecast)) / any_value(scale) AS mase
        FROM candidates JOIN ascale USING ({KEY}) WHERE scale IS NOT NULL GROUP BY ALL""",
)


@query(
    "rolling_candidates",
    "E2 E3 E17",
    sql(f"SELECT {KEY}, date, actual, model, h, {settle_sql('forecast')} AS forecast FROM candidates", "candidates"),
)
def _candidates(spark, sf):
    return SM.rolling_candidates(area_obs(spark, sf), HORIZONS, SHORT).withColumns(settle("forecast"))


def horizon_errors(spark, sf):
    o = area_obs(spark, sf)
    return ME.mase_by_horizon(SM.rolling_candidates(o, HORIZONS, SHORT), ME.holdout_scale(o, SHORT))


@query(
    "mase_by_horizon",
    "E17",
    sql(f"SELECT model, {KEY}, h, n, {settle_sql('mase')} AS mase FROM mbh", "mbh"),
)
def _by_horizon(spark, sf):
    return horizon_errors(spark, sf).withColumns(settle("mase"))


@query(
    "champion_by_horizon",
    "W22",
    sql(
        """SELECT "table", h, arg_min(model, (round(a, 9), model)) AS champion, round(min(a), 6) AS mase, max(n) AS n_series FROM (
             SELECT "table", h, model, avg(mase) AS a, count(*) AS n FROM mbh GROUP BY ALL) GROUP BY ALL""",
        "mbh",
    ),
)
def _champion(spark, sf):
    return ME.champion_by_horizon(horizon_errors(spark, sf)).withColumns(r6("mase"))


@query(
    "point_metrics",
    "E11 J6",
    sql(
        f"""SELECT {KEY}, model, region, count(*) AS n, round(avg(abs(y - forecast)), 6) AS mae, round(sqrt(avg((y - forecast)^2)), 6) AS rmse,
              round(200 * avg(abs(y - forecast) / (abs(y) + abs(forecast) + 1e-9)), 6) AS smape,
              round(avg(abs(y - forecast)) / any_value(scale), 6) AS mase, round(avg(abs(y - forecast)) / any_value(scale1), 6) AS mase1
            FROM onelong JOIN hscale USING ({KEY}) WHERE y IS NOT NULL GROUP BY ALL""",
        "onelong",
        "hscale",
    ),
)
def _point(spark, sf):
    o = obs(spark, sf)
    out = ME.point_metrics(FC.one_step_long(o, SHORT), ME.holdout_scale(o, SHORT), [*SERIES, "model", "region"])
    return out.withColumns(r6("mae", "rmse", "smape", "mase", "mase1"))


@query(
    "mase_by_series",
    "E12 J6 J7",
    sql(
        f"""SELECT s.*, round(s.mae0, 6) AS mae, round(s.mae0 / k.scale, 6) AS mase FROM (
              SELECT {KEY}, model, count(*) AS n, avg(abs(y - forecast)) AS mae0, min(m) AS cut FROM onelong
              WHERE region = 'holdout' AND y IS NOT NULL GROUP BY ALL) s
            JOIN (SELECT c.country, c.block, c.category, c."table", nullif(CASE WHEN count(d.m) > 12 THEN avg(dm) ELSE avg(d1) END, 0) AS scale
                  FROM (SELECT {KEY}, min(m) AS cut FROM onelong WHERE region = 'holdout' AND y IS NOT NULL GROUP BY ALL) c
                  LEFT JOIN sdiffs d ON d.country = c.country AND d.block = c.block AND d.category = c.category
                    AND d."table" = c."table" AND d.m < c.cut GROUP BY ALL) k USING ({KEY})""",
        "onelong",
        "sdiffs",
    ).replace("SELECT s.*, round", "SELECT s.country, s.block, s.category, s.\"table\", s.model, s.n, round"),
)
def _mase(spark, sf):
    o = obs(spark, sf)
    fc = FC.one_step_long(o, SHORT).filter(F.col("region") == "holdout").select(
        *SERIES, "model", F.col("bulletin_date").alias("date"), "forecast"
    )
    return ME.mase_by_series(ME.mask_observed(fc, o), o, ["model"]).withColumns(r6("mae", "mase"))


register(
    "resid",
    ("onelong",),
    f"""SELECT *, abs(y - forecast) AS e, count(*) FILTER (region = 'selection') OVER (PARTITION BY {KEY}, model) AS nsel,
               row_number() OVER (PARTITION BY {KEY}, model, region ORDER BY abs(y - forecast)) AS rn
        FROM onelong WHERE y IS NOT NULL AND forecast IS NOT NULL""",
)
_RANK = "CAST(ceil(round(least(1.0, ceil(round((nsel + 1) * 0.95, 9)) / nsel) * (nsel - 1), 9)) AS BIGINT) + 1"
register(
    "halves",
    ("resid",),
    f"SELECT {KEY}, model, any_value(nsel) AS nsel, max(e) AS half FROM resid WHERE region = 'selection' AND rn = {_RANK} GROUP BY ALL",
)


@query(
    "conformal_half",
    "W19",
    sql(f"SELECT {KEY}, model, nsel AS n_calibration, round(half, 6) AS half FROM halves", "halves"),
)
def _half(spark, sf):
    long = FC.one_step_long(obs(spark, sf), SHORT).filter(F.col("region") == "selection")
    res = long.withColumn("resid", F.col("y") - F.col("forecast"))
    return ME.conformal_half(res, [*SERIES, "model"]).withColumns(r6("half"))


register(
    "bt",
    ("resid", "halves", "hscale"),
    f"""SELECT h.country, h.block, h.category, h."table", md.model, sel_n, sel_mae, sel_rmse, hold_n, hold_mae, hold_smape, half, coverage, iscore,
               sel_mae / scale AS sel_mase, hold_mae / scale AS hold_mase, hold_mae / scale1 AS hold_mase1, iscore / scale AS msis
        FROM hscale h CROSS JOIN (SELECT unnest(['naive1', 'seasonal', 'drift']) AS model) md
        LEFT JOIN (SELECT r.country, r.block, r.category, r."table", r.model, count(*) FILTER (region = 'selection') AS sel_n,
                     avg(e) FILTER (region = 'selection') AS sel_mae, sqrt(avg(e * e) FILTER (region = 'selection')) AS sel_rmse,
                     count(*) FILTER (region = 'holdout') AS hold_n, avg(e) FILTER (region = 'holdout') AS hold_mae,
                     200 * avg(e / (abs(y) + abs(forecast) + 1e-9)) FILTER (region = 'holdout') AS hold_smape, max(half) AS half,
                     avg(CASE WHEN e <= half THEN 1.0 WHEN half IS NOT NULL THEN 0.0 END) FILTER (region = 'holdout') AS coverage,
                     avg(2 * half + 40 * greatest(e - half, 0)) FILTER (region = 'holdout') AS iscore
                   FROM resid r LEFT JOIN halves q ON q.country = r.country AND q.block = r.block AND q.category = r.category
                     AND q."table" = r."table" AND q.model = r.model GROUP BY ALL) s
          ON s.country = h.country AND s.block = h.block AND s.category = h.category AND s."table" = h."table" AND s.model = md.model""",
)


def backtest_report(spark, sf, source=obs):
    o = source(spark, sf)
    return ME.backtest(FC.one_step_long(o, SHORT), o, FC.BASELINES, SHORT)


@query(
    "backtest_report",
    "E16 E13 W19",
    sql(
        f"""SELECT {KEY}, model, CAST(sel_n AS DOUBLE) AS sel_n, CAST(hold_n AS DOUBLE) AS hold_n, round(sel_mae, 6) AS sel_mae, round(sel_rmse, 6) AS sel_rmse,
              round(hold_mae, 6) AS hold_mae, round(hold_smape, 6) AS hold_smape, round(half, 6) AS half, round(coverage, 6) AS coverage,
              round(iscore, 6) AS interval_score, round(sel_mase, 6) AS sel_mase, round(hold_mase, 6) AS hold_mase,
              round(hold_mase1, 6) AS hold_mase1, round(msis, 6) AS msis FROM bt""",
        "bt",
    ),
)
def _backtest(spark, sf):
    names = ["sel_mae", "sel_rmse", "hold_mae", "hold_smape", "half", "coverage", "interval_score", "sel_mase", "hold_mase", "hold_mase1", "msis"]
    out = backtest_report(spark, sf)
    return out.select(
        *SERIES, "model", F.col("sel_n").cast("double").alias("sel_n"), F.col("hold_n").cast("double").alias("hold_n"),
        *[F.round(n, 6).alias(n) for n in names],
    )


@query(
    "interval_metrics",
    "E13",
    sql(
        f"""SELECT r.country, r.block, r.category, r."table", r.model, count(*) AS n,
              round(avg(CASE WHEN e <= half THEN 1.0 ELSE 0.0 END), 6) AS coverage,
              round(avg(2 * half + 40 * greatest(e - half, 0)), 6) AS interval_score,
              round(avg(2 * half + 40 * greatest(e - half, 0)) / any_value(scale), 6) AS msis
            FROM resid r JOIN halves q USING (country, block, category, "table", model) JOIN hscale s USING (country, block, category, "table")
            WHERE region = 'holdout' GROUP BY ALL""",
        "halves",
        "hscale",
    ),
)
def _intervals(spark, sf):
    o = obs(spark, sf)
    group = [*SERIES, "model"]
    long = FC.one_step_long(o, SHORT).withColumn("resid", F.col("y") - F.col("forecast"))
    half = ME.conformal_half(long.filter(F.col("region") == "selection"), group)
    scored = (
        long.filter(F.col("region") == "holdout")
        .join(half, group)
        .join(ME.holdout_scale(o, SHORT).select(*SERIES, "scale"), SERIES)
        .withColumn("lo", F.col("forecast") - F.col("half"))
        .withColumn("hi", F.col("forecast") + F.col("half"))
    )
    return ME.interval_metrics(scored, group).withColumns(r6("coverage", "interval_score", "msis"))


@query(
    "crps_of_samples",
    "E14",
    sql(
        f"""WITH d AS (SELECT *, lag(level) OVER ({W}) AS prev FROM (SELECT *, level - lag(level) OVER ({W}) AS dy FROM slev)),
                 w AS (SELECT {KEY}, m, y, prev, list(dy) OVER ({W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS ds,
                              count(dy) OVER ({W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS nd FROM d),
                 x AS (SELECT {KEY}, m, y, unnest(ds) + prev AS s FROM w WHERE nd = 24 AND y IS NOT NULL),
                 g AS (SELECT {KEY}, m, y, s, row_number() OVER (PARTITION BY {KEY}, m ORDER BY s) AS i FROM x)
            SELECT {KEY}, count(*) AS n, {settle_sql("avg(c)")} AS crps FROM (
              SELECT {KEY}, m, avg(abs(s - y)) - sum((2 * i - 25) * s) / 576 AS c FROM g GROUP BY ALL) GROUP BY ALL""",
        "slev",
    ),
)
def _crps(spark, sf):
    w = S.over_series()
    grid = S.difference(S.densify(obs(spark, sf)), "level", "dy")
    rows = grid.withColumn("_d", F.collect_list("dy").over(w.rowsBetween(-24, -1))).withColumn("_prev", F.lag("level").over(w))
    rows = rows.filter((F.size("_d") == 24) & F.col("y").isNotNull())
    samples = F.transform("_d", lambda d: d + F.col("_prev"))
    scored = rows.withColumn("samples", samples).withColumn("crps", ME.crps_of_samples(F.col("samples"), F.col("y")))
    return scored.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.avg("crps").alias("crps")).withColumns(settle("crps"))


LEVELS = ", ".join(str(q) for q in QUANTILE_LEVELS)
register(
    "rquant",
    ("onelong",),
    f"""SELECT {KEY}, model, count(*) AS nres, quantile_cont(y - forecast, [{LEVELS}]) AS rq FROM onelong
        WHERE region = 'selection' AND y IS NOT NULL GROUP BY ALL HAVING count(*) >= 8""",
)


@query(
    "residual_quantiles",
    "E22",
    sql(
        f"""SELECT {KEY}, model, nres AS n_residuals, round(rq[1], 8) AS q025, round(rq[5], 8) AS q500, round(rq[9], 8) AS q975 FROM rquant""",
        "rquant",
    ),
)
def _rq(spark, sf):
    long = FC.one_step_long(obs(spark, sf), SHORT).filter(F.col("region") == "selection")
    rq = ME.residual_quantiles(long.withColumn("resid", F.col("y") - F.col("forecast")), [*SERIES, "model"])
    pick = {"q025": 0, "q500": 4, "q975": 8}
    return rq.select(*SERIES, "model", "n_residuals", *[F.round(F.col("rq")[i], 8).alias(n) for n, i in pick.items()])


def quantile_scores(o):
    """Vincentised ensemble of the baselines' residual-quantile bands on hold-out rows."""
    group = [*SERIES, "model"]
    long = FC.one_step_long(o, SHORT)
    rq = ME.residual_quantiles(
        long.filter(F.col("region") == "selection").withColumn("resid", F.col("y") - F.col("forecast")), group
    )
    rows = (
        long.filter((F.col("region") == "holdout") & F.col("y").isNotNull())
        .join(rq, group)
        .groupBy(*SERIES, "bulletin_date")
        .agg(
            F.max("y").alias("y"),
            F.count(F.lit(1)).alias("n_members"),
            *[F.avg(F.col("forecast") + F.col("rq")[i]).alias(f"q{i}") for i in range(len(QUANTILE_LEVELS))],
        )
        .filter(F.col("n_members") == len(FC.BASELINES))
    )
    quantiles = {level: F.col(f"q{i}") for i, level in enumerate(QUANTILE_LEVELS)}
    hit = (F.col("y") >= F.col("q0")) & (F.col("y") <= F.col("q8"))
    return rows.withColumn("crps", ME.quantile_crps(F.col("y"), quantiles)).withColumn("hit", hit.cast("int"))


@query(
    "quantile_crps",
    "E15 E22 A18",
    sql(
        f"""WITH v AS (SELECT {KEY}, m, any_value(y) AS y, count(*) AS k, """
        + ", ".join(f"avg(forecast + rq[{i + 1}]) AS q{i}" for i in range(9))
        + f""" FROM onelong JOIN rquant USING ({KEY}, model) WHERE region = 'holdout' AND y IS NOT NULL
                       GROUP BY {KEY}, m HAVING count(*) = 3),
             s AS (SELECT *, 2.0 / 9 * ("""
        + " + ".join(f"greatest({q} * (y - q{i}), ({q} - 1) * (y - q{i}))" for i, q in enumerate(QUANTILE_LEVELS))
        + f""") AS crps, CASE WHEN y >= q0 AND y <= q8 THEN 1 ELSE 0 END AS hit FROM v),
             p AS (SELECT "table", block, country, category, count(*) AS n, avg(crps) AS crps, sum(hit) AS k FROM s GROUP BY ALL)
        SELECT "table", coalesce(block, 'ALL') AS block, coalesce(country, 'ALL') AS country, coalesce(category, 'ALL') AS category,
          CAST(sum(n) AS BIGINT) AS n, round(avg(crps), 6) AS crps, CAST(sum(k) AS BIGINT) AS k95, round(sum(k) / sum(n), 6) AS cov95,
          count(*) AS n_series
        FROM p GROUP BY GROUPING SETS (("table", block, country, category), ("table"))""",
        "onelong",
        "rquant",
    ),
)
def _qcrps(spark, sf):
    per = quantile_scores(obs(spark, sf)).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.avg("crps").alias("crps"), F.sum("hit").alias("k95")
    )
    return A.with_total_row(per)


register(
    "combined",
    ("onelong",),
    f"""SELECT {KEY}, m, any_value(y) AS y, any_value(region) AS region, median(forecast) AS med, avg(forecast) AS mean, count(forecast) AS n_models
        FROM onelong GROUP BY {KEY}, m""",
)


@query(
    "combined_forecasts",
    "E8 U5",
    sql(f"SELECT {KEY}, m AS date, round(med, 6) AS forecast, n_models FROM combined WHERE n_models = 3", "combined"),
)
def _combined(spark, sf):
    long = FC.one_step_long(obs(spark, sf), SHORT).withColumnRenamed("bulletin_date", "date")
    return FC.combine(long, [*SERIES, "date"], "median", FC.BASELINES).withColumns(r6("forecast"))


@query(
    "seed_combined_forecasts",
    "E8",
    sql(
        f"""SELECT {KEY}, m AS date, round(avg(p), 6) AS forecast, count(p) AS n_models FROM (
              SELECT {KEY}, m, model, median(forecast + s * (day(m) + 1)) AS p FROM onelong, (SELECT unnest([1, 2, 5]) AS s)
              WHERE region = 'holdout' GROUP BY ALL) GROUP BY {KEY}, m""",
        "onelong",
    ),
)
def _seeds(spark, sf):
    long = FC.one_step_long(obs(spark, sf), SHORT).filter(F.col("region") == "holdout")
    seeds = long.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5)))).withColumn(
        "forecast", F.col("forecast") + F.col("seed") * (F.dayofmonth("bulletin_date") + 1)
    )
    return FC.combine_seeds(seeds.withColumnRenamed("bulletin_date", "date"), [*SERIES, "date"], "mean").withColumns(r6("forecast"))


@query(
    "common_dates",
    "U5",
    sql(
        f"""SELECT {KEY}, h, date FROM (SELECT DISTINCT {KEY}, h, date, model FROM candidates) GROUP BY ALL HAVING count(*) = 5""",
        "candidates",
    ),
)
def _common(spark, sf):
    """Every horizon's common dates of all five candidates."""
    rolling = SM.rolling_candidates(area_obs(spark, sf), HORIZONS, SHORT)
    return SO.common_dates(rolling, [*SERIES, "h"], len(SM.CANDIDATES))


@query(
    "future_baselines",
    "E1",
    sql(
        f"""WITH z AS (SELECT {KEY}, max(m) AS m, max(n_grid) AS n, arg_max(level, m) AS lst, arg_min(level, m) AS fst FROM lev GROUP BY ALL),
                 fut AS (SELECT z.*, CAST(h AS INTEGER) AS h, CAST(z.m + to_months(CAST(h AS INTEGER)) AS DATE) AS date
                         FROM z, (SELECT unnest(generate_series(1, 12)) AS h))
            SELECT {KEY}, m AS origin_date, h, date, 'naive1' AS model, lst AS forecast FROM fut
            UNION ALL SELECT {KEY}, m, h, date, 'drift', round(lst + h * (lst - fst) / nullif(n - 1, 0), 6) FROM fut
            UNION ALL SELECT f.country, f.block, f.category, f."table", f.m, f.h, f.date, 'seasonal', CASE WHEN f.n >= 12 THEN l.level END FROM fut f
              LEFT JOIN lev l ON l.country = f.country AND l.block = f.block AND l.category = f.category AND l."table" = f."table"
                AND l.pos = f.n - 12 + f.h""",
        "lev",
    ),
)
def _future(spark, sf):
    return FC.future_baselines(area_obs(spark, sf), 12, SHORT).withColumns(r6("forecast"))


@query(
    "wins_by_model",
    "A16",
    sql(
        f"""SELECT model, count(*) AS wins FROM (SELECT {KEY}, arg_min(model, (round(hold_mase, 9), model)) AS model FROM bt
            WHERE hold_mase IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
        "bt",
    ),
)
def _wins(spark, sf):
    return A.wins_by_model(backtest_report(spark, sf).withColumn("hold_mase", F.round("hold_mase", 9)), "hold_mase")


@query(
    "model_ranking",
    "A20",
    sql(
        """SELECT model, round(avg(hold_mase), 6) AS mean_error, count(hold_mase) AS n_scored,
             count(*) FILTER (hold_mase IS NULL) AS n_failed FROM bt GROUP BY ALL""",
        "bt",
    ),
)
def _ranking(spark, sf):
    return A.ranking(backtest_report(spark, sf), "hold_mase")


@query(
    "last_forecast_vs_actual",
    "E27",
    sql(
        f"""SELECT {KEY}, model, max(m) AS date, round(arg_max(forecast, m), 6) AS forecast, arg_max(y, m) AS actual FROM onelong
            WHERE region = 'holdout' AND y IS NOT NULL GROUP BY ALL""",
        "onelong",
    ),
)
def _last(spark, sf):
    long = FC.one_step_long(obs(spark, sf), SHORT).filter((F.col("region") == "holdout") & F.col("y").isNotNull())
    d = "bulletin_date"
    return long.groupBy(*SERIES, "model").agg(
        F.max(d).alias("date"),
        F.round(F.max_by("forecast", d), 6).alias("forecast"),
        F.max_by("y", d).alias("actual"),
    )
