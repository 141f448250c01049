"""Windows over dense and observed series."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import SERIES
from panelspark.operators import series as S
from panelspark.plans.ctes import KEY, W, register, sql
from panelspark.plans.protocol import SHORT, obs, r6
from panelspark.plans.registry import query

KEYD = f"{KEY}, m AS bulletin_date"


@query(
    "densify_locf",
    "W7 W8",
    sql(
        f"SELECT {KEYD}, y, level, CAST(date_diff('month', last_value(CASE WHEN y IS NOT NULL THEN m END IGNORE NULLS) "
        f"OVER w, m) AS INTEGER) AS months_since_obs FROM slev WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        "slev",
    ),
)
def _densify(spark, sf):
    return S.densify(obs(spark, sf)).select(*SERIES, "bulletin_date", "y", "level", "months_since_obs")


register(
    "sfilled",
    ("sgrid",),
    f"""SELECT {KEY}, m, y,
       last_value(y IGNORE NULLS) OVER back AS p, first_value(y IGNORE NULLS) OVER ahead AS nx,
       last_value(CASE WHEN y IS NOT NULL THEN m END IGNORE NULLS) OVER back AS pm,
       first_value(CASE WHEN y IS NOT NULL THEN m END IGNORE NULLS) OVER ahead AS nm
  FROM sgrid WINDOW back AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    ahead AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)


@query(
    "interpolate_short_gaps",
    "W9",
    sql(
        f"""SELECT {KEYD}, round(CASE WHEN y IS NOT NULL THEN y
              WHEN date_diff('month', pm, nm) - 1 <= 3
              THEN p + (nx - p) * date_diff('month', pm, m) / date_diff('month', pm, nm) END, 6) AS y FROM sfilled""",
        "sfilled",
    ),
)
def _interp(spark, sf):
    return S.interpolate_short(obs(spark, sf)).withColumns(r6("y"))


@query(
    "difference_reintegrate",
    "W1",
    sql(
        f"""SELECT {KEYD}, y, y - lag(y) OVER ({W}) AS delta,
              first_value(y) OVER (PARTITION BY {KEY} ORDER BY m)
              + coalesce(sum(y - y0) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS level
            FROM (SELECT *, coalesce(lag(y) OVER ({W}), y) AS y0 FROM fs)""",
        "fs",
    ),
)
def _diff(spark, sf):
    w = S.over_series()
    d = S.difference(obs(spark, sf)).withColumn("last_level", F.first("y").over(w))
    d = d.withColumn("_d", F.coalesce("delta", F.lit(0.0)))
    return S.undifference(d, "_d").drop("_d", "last_level")


@query(
    "walk_forward_regions",
    "W16",
    sql(
        f"""SELECT {KEY}, region, count(*) AS n_months, count(y) AS n_observed, min(m) AS first_month, max(m) AS last_month
            FROM (SELECT *, CASE WHEN n_grid - pos < 24 THEN 'holdout'
                                 WHEN pos > CASE "table" WHEN 'FAD' THEN 36 ELSE 24 END THEN 'selection'
                                 ELSE 'train' END AS region FROM slev)
            GROUP BY ALL""",
        "slev",
    ),
)
def _regions(spark, sf):
    return (
        S.split_regions(S.densify(obs(spark, sf)), SHORT)
        .groupBy(*SERIES, "region")
        .agg(
            F.count(F.lit(1)).alias("n_months"),
            F.count("y").alias("n_observed"),
            F.min("bulletin_date").alias("first_month"),
            F.max("bulletin_date").alias("last_month"),
        )
    )


@query(
    "tuning_windows",
    "E28",
    sql(
        f"""SELECT {KEY}, win AS "window", count(*) AS n_months, min(m) AS first_month FROM (
              SELECT *, CASE WHEN n_grid - pos < 24 THEN 'holdout' WHEN n_grid - pos < 30 THEN 'confirm'
                             WHEN n_grid - pos < 42 THEN 'tune' ELSE 'fit' END AS win FROM slev) GROUP BY ALL""",
        "slev",
    ),
)
def _tuning(spark, sf):
    return (
        S.tuning_regions(S.densify(obs(spark, sf)), SHORT)
        .groupBy(*SERIES, "window")
        .agg(F.count(F.lit(1)).alias("n_months"), F.min("bulletin_date").alias("first_month"))
    )


@query(
    "last_months_per_series",
    "K8",
    sql(f"SELECT {KEYD}, level FROM slev WHERE n_grid - pos < 24", "slev"),
)
def _tail(spark, sf):
    return S.tail_per_series(S.densify(obs(spark, sf)), 24).select(*SERIES, "bulletin_date", "level")


register(
    "future_mask",
    ("slev",),
    f"""SELECT {KEY}, m, CASE WHEN y IS NOT NULL THEN 1 ELSE 0 END AS observed FROM slev
        UNION ALL
        SELECT {KEY}, CAST(unnest(generate_series(mx + INTERVAL 1 MONTH, mx + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS DATE), 0
        FROM (SELECT {KEY}, max(m) AS mx FROM slev GROUP BY ALL)""",
)


@query(
    "missing_masks",
    "W6",
    sql(
        f"""SELECT {KEYD}, observed, CAST(date_diff('month', last_value(CASE WHEN observed = 1 THEN m END IGNORE NULLS)
              OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), m) AS INTEGER) AS months_since_obs
            FROM future_mask""",
        "future_mask",
    ),
)
def _masks(spark, sf):
    return S.mask_features(obs(spark, sf), 12)


register(
    "srun",
    ("fs",),
    f"""SELECT {KEY}, grp, count(*) AS len FROM (
          SELECT *, date_diff('month', DATE '1970-01-01', m) - row_number() OVER ({W}) AS grp FROM fs) GROUP BY ALL""",
)


@query("longest_observed_run", "W4", sql(f"SELECT {KEY}, max(len) AS max_run FROM srun GROUP BY ALL", "srun"))
def _max_run(spark, sf):
    return S.max_run(obs(spark, sf))


@query(
    "missingness_profile",
    "W5",
    sql(
        f"""SELECT g.*, r.longest_observed_run FROM (
              SELECT {KEY}, count(*) AS n_observed, CAST(coalesce(sum(gap) FILTER (gap > 0), 0) AS BIGINT) AS n_missing,
                     count(*) FILTER (gap > 0) AS n_gap_runs, CAST(coalesce(max(gap) FILTER (gap > 0), 0) AS BIGINT) AS max_gap_run,
                     CAST(coalesce(median(gap) FILTER (gap > 0), 0) AS DOUBLE) AS median_gap_run,
                     CAST(count(*) + coalesce(sum(gap) FILTER (gap > 0), 0) AS BIGINT) AS n_months,
                     round(coalesce(sum(gap) FILTER (gap > 0), 0) / (count(*) + coalesce(sum(gap) FILTER (gap > 0), 0)), 4) AS pct_missing
              FROM (SELECT *, date_diff('month', lag(m) OVER ({W}), m) - 1 AS gap FROM fs) GROUP BY ALL) g
            JOIN (SELECT {KEY}, max(len) AS longest_observed_run FROM srun GROUP BY ALL) r USING ({KEY})""",
        "srun",
    ),
)
def _profile(spark, sf):
    return S.missing_profile(obs(spark, sf))


register(
    "sdy",
    ("slev",),
    f"SELECT *, level - lag(level) OVER ({W}) AS dy FROM slev",
)


@query(
    "lagged_increments",
    "W10",
    sql(
        f"SELECT {KEYD}, dy AS target_dy, lag(level) OVER ({W}) AS prev_level, "
        + ", ".join(f"lag(dy, {k}) OVER ({W}) AS dy_lag{k}" for k in S.DY_LAGS)
        + " FROM sdy",
        "sdy",
    ),
)
def _lags(spark, sf):
    f = S.lag_features(S.densify(obs(spark, sf)))
    return f.select(*SERIES, "bulletin_date", "target_dy", "prev_level", *[f"dy_lag{k}" for k in S.DY_LAGS])


# Streak as "rows since the last row that broke it", spelled with a break counter here.
register(
    "sstreak",
    ("sdy",),
    f"""SELECT {KEY}, m, CAST(count(*) FILTER (zero) OVER (PARTITION BY {KEY}, zg ORDER BY m) AS DOUBLE) AS fz,
               CAST(count(*) FILTER (up) OVER (PARTITION BY {KEY}, ug ORDER BY m) AS DOUBLE) AS au
        FROM (SELECT *, count(*) FILTER (NOT zero) OVER ({W}) AS zg, count(*) FILTER (NOT up) OVER ({W}) AS ug
              FROM (SELECT *, coalesce(dy = 0, false) AS zero, coalesce(dy > 0, false) AS up FROM sdy))""",
)


@query(
    "trailing_streaks",
    "W11",
    sql(
        f"SELECT {KEYD}, lag(fz) OVER ({W}) AS months_frozen, lag(au) OVER ({W}) AS advance_streak FROM sstreak",
        "sstreak",
    ),
)
def _streaks(spark, sf):
    f = S.streaks(S.difference(S.densify(obs(spark, sf)), "level", "target_dy"))
    return f.select(*SERIES, "bulletin_date", "months_frozen", "advance_streak")


register(
    "sretro",
    ("sdy",),
    f"""SELECT {KEY}, m, max(CASE WHEN dy < 0 THEN 1.0::DOUBLE ELSE 0.0 END) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS r
        FROM sdy""",
)


@query(
    "recent_retrogression",
    "W12",
    sql(f"SELECT {KEYD}, CAST(lag(r) OVER ({W}) AS DOUBLE) AS retro_recent FROM sretro", "sretro"),
)
def _retro_recent(spark, sf):
    f = S.retro_recent(S.difference(S.densify(obs(spark, sf)), "level", "target_dy"))
    return f.select(*SERIES, "bulletin_date", "retro_recent")


@query(
    "rolling_volatility",
    "W13",
    sql(
        f"""SELECT {KEYD}, round(CASE WHEN count(d) OVER fr >= 6 THEN stddev_samp(d) OVER fr END, 6) AS volatility
            FROM (SELECT *, y - lag(y) OVER ({W}) AS d FROM fs)
            WINDOW fr AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
        "fs",
    ),
)
def _vol(spark, sf):
    return S.rolling_std(obs(spark, sf)).select(*SERIES, "bulletin_date", F.round("volatility", 6).alias("volatility"))


@query(
    "spread_other_table",
    "J8",
    sql(
        f"""SELECT a.country, a.block, a.category, a."table", a.m AS bulletin_date,
              lag(a.level - b.level) OVER (PARTITION BY a.country, a.block, a.category, a."table" ORDER BY a.m) AS spread_other_table
            FROM (SELECT *, CASE "table" WHEN 'FAD' THEN 'DFF' ELSE 'FAD' END AS ot FROM slev) a
            ASOF LEFT JOIN slev b ON a.country = b.country AND a.block = b.block AND a.category = b.category
              AND a.ot = b."table" AND a.m >= b.m""",
        "slev",
    ),
)
def _spread(spark, sf):
    return S.table_spread(S.densify(obs(spark, sf))).select(*SERIES, "bulletin_date", "spread_other_table")


@query(
    "spread_vs_world",
    "J8",
    sql(
        """SELECT a.country, a.block, a.category, a."table", a.m AS bulletin_date,
              lag(CASE WHEN a.country <> 'all_chargeability' THEN a.level - b.level END)
                OVER (PARTITION BY a.country, a.block, a.category, a."table" ORDER BY a.m) AS spread_vs_world
            FROM slev a
            ASOF LEFT JOIN (SELECT * FROM slev WHERE country = 'all_chargeability') b
              ON a.block = b.block AND a.category = b.category AND a."table" = b."table" AND a.m >= b.m""",
        "slev",
    ),
)
def _world(spark, sf):
    return S.world_spread(S.densify(obs(spark, sf))).select(*SERIES, "bulletin_date", "spread_vs_world")


_CAL = """round(sin(2 * pi() * month(m) / 12), 6) AS month_sin, round(cos(2 * pi() * month(m) / 12), 6) AS month_cos,
  round(sin(2 * pi() * ((month(m) + 2) % 12) / 12), 6) AS fiscal_sin, round(cos(2 * pi() * ((month(m) + 2) % 12) / 12), 6) AS fiscal_cos"""


@query(
    "feature_frame",
    "W10 W11 W12 J8 P12",
    sql(
        f"""SELECT d.country, d.block, d.category, d."table", d.m AS bulletin_date, dy AS target_dy,
              lag(level) OVER w AS prev_level, lag(dy, 1) OVER w AS dy_lag1, lag(dy, 12) OVER w AS dy_lag12,
              lag(fz) OVER w AS months_frozen, lag(au) OVER w AS advance_streak, CAST(lag(r) OVER w AS DOUBLE) AS retro_recent,
              round(sin(2 * pi() * month(d.m) / 12), 6) AS month_sin,
              round(cos(2 * pi() * ((month(d.m) + 2) % 12) / 12), 6) AS fiscal_cos
            FROM sdy d JOIN sstreak s USING (country, block, category, "table", m)
            JOIN sretro t USING (country, block, category, "table", m)
            WINDOW w AS (PARTITION BY d.country, d.block, d.category, d."table" ORDER BY d.m)""",
        "sdy",
        "sstreak",
        "sretro",
    ),
)
def _features(spark, sf):
    return S.feature_frame(obs(spark, sf)).select(
        *SERIES,
        "bulletin_date",
        "target_dy",
        "prev_level",
        "dy_lag1",
        "dy_lag12",
        "months_frozen",
        "advance_streak",
        "retro_recent",
        F.round("month_sin", 6).alias("month_sin"),
        F.round("fiscal_cos", 6).alias("fiscal_cos"),
    )
