"""Score blocks, seeds, replicas, drift, significance and promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import HORIZONS, SERIES, WORLD
from panelspark.operators import aggregates as A
from panelspark.operators import forecast as FC
from panelspark.operators import governance as G
from panelspark.operators import ledger as L
from panelspark.operators import metrics as ME
from panelspark.operators import series as S
from panelspark.operators import significance as SG
from panelspark.plans.challengers import challengers
from panelspark.plans.ctes import KEY, holm_sql, register, signed_rank, sql
from panelspark.plans.evaluation import MINTRAIN, backtest_report, horizon_errors
from panelspark.plans.ledger import ledger, score, shadow_recipes, stamped, vintage_rows
from panelspark.plans.protocol import SHORT, obs, r6, settle, settle_sql
from panelspark.plans.registry import query
from panelspark.session import stage
from panelspark.sources.tables import area_panel, supplier_panel

_AGG = f"""count(*) AS n, {settle_sql("avg(abs_err)")} AS mae_days, {settle_sql("avg(scaled_err)")} AS mase,
  CAST(sum(in80) AS BIGINT) AS k80, CAST(sum(in95) AS BIGINT) AS k95, round(avg(in80), 6) AS cov80, round(avg(in95), 6) AS cov95"""


@query(
    "score_summary",
    "A17",
    sql(
        f"""SELECT *, n < 30 AS insufficient_n FROM (
              SELECT evaluation_mode, CAST(h AS DOUBLE) AS h, "table", origin, {_AGG} FROM score
              GROUP BY GROUPING SETS ((evaluation_mode), (evaluation_mode, h), (evaluation_mode, "table"), (evaluation_mode, origin)))""",
        "score",
    ),
)
def _summary(spark, sf):
    return G.score_summary(score(spark, sf)).withColumn("h", F.col("h").cast("double"))


@query("score_summary_with_intervals", "A17 A25")
def _summary_ci(spark, sf):
    return G.score_summary_ci(score(spark, sf))


SEEDS = [f"auto_s{i}" for i in range(1, 6)]


def seed_runs(spark, sf):
    """Five runs of the drift model whose errors differ by a small share of the selection error."""
    bt = backtest_report(spark, sf).filter((F.col("model") == "drift") & F.col("hold_mase").isNotNull() & F.col("sel_mase").isNotNull())
    runs = bt.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return runs.select(
        *SERIES,
        F.concat(F.lit("auto_s"), F.col("_i").cast("string")).alias("variant"),
        (F.col("hold_mase") + F.col("_i") * F.col("sel_mase") / 100).alias("hold_mase"),
    )


@query(
    "seed_aggregate",
    "A19",
    sql(
        """SELECT count(*) AS n_seeds, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max,
             round(stddev_samp(v) / sqrt(count(*)), 6) AS se, round(avg(v) - 2.7764451051977987 * stddev_samp(v) / sqrt(count(*)), 6) AS lo,
             round(avg(v) + 2.7764451051977987 * stddev_samp(v) / sqrt(count(*)), 6) AS hi
           FROM (SELECT i, avg(hold_mase + i * sel_mase / 100) AS v FROM bt, (SELECT unnest([1, 2, 3, 4, 5]) AS i)
                 WHERE model = 'drift' AND hold_mase IS NOT NULL AND sel_mase IS NOT NULL GROUP BY ALL)""",
        "bt",
    ),
)
def _seeds(spark, sf):
    return G.aggregate_seeds(seed_runs(spark, sf), SEEDS).withColumns(r6("mean", "sd", "min", "max", "se", "lo", "hi"))


@query(
    "tuning_acceptance",
    "A21",
    sql(
        """SELECT model, "table", block, round(avg(t), 6) AS tuned_mean, round(avg(d), 6) AS default_mean, round(median(t), 6) AS tuned_median,
             round(median(d), 6) AS default_median, round(avg(CASE WHEN t < d THEN 1.0 ELSE 0.0 END), 6) AS pct_improve, count(*) AS n,
             round(100 * (avg(d) - avg(t)) / avg(d), 6) AS delta_pct, avg(t) < avg(d) AS accepted, median(t) < median(d) AS median_agrees
           FROM (SELECT b.model, b."table", b.block, b.sel_mase AS t, n.sel_mase AS d FROM bt b JOIN bt n USING (country, block, category, "table")
                 WHERE n.model = 'naive1' AND b.model <> 'naive1' AND b.sel_mase IS NOT NULL) GROUP BY ALL""",
        "bt",
    ),
)
def _acceptance(spark, sf):
    bt = backtest_report(spark, sf).select(*SERIES, "model", "sel_mase")
    default = bt.filter(F.col("model") == "naive1").select(*SERIES, F.col("sel_mase").alias("confirm_default"))
    pairs = bt.filter((F.col("model") != "naive1") & F.col("sel_mase").isNotNull()).join(default, SERIES)
    out = A.acceptance(pairs.withColumnRenamed("sel_mase", "confirm_tuned"), ["model", "table", "block"])
    return out.withColumns(r6("tuned_mean", "default_mean", "tuned_median", "default_median", "pct_improve", "delta_pct"))


@query(
    "performance_drift",
    "G23",
    sql(
        """WITH l AS (SELECT max(origin) AS o FROM score), m AS (SELECT s.*, s.origin = l.o AS latest FROM score s, l
                   WHERE h IN (SELECT h FROM score, l WHERE origin = l.o)),
             r AS (SELECT max(origin) AS latest_vintage, count(*) FILTER (latest) AS latest_n, avg(scaled_err) FILTER (latest) AS a,
                     avg(scaled_err) FILTER (NOT latest) AS b, count(*) FILTER (NOT latest) AS baseline_n, avg(in95) FILTER (latest) AS c FROM m)
           SELECT latest_vintage, latest_n, round(a, 6) AS latest_mase, round(b, 6) AS baseline_mase, baseline_n, round(c, 6) AS latest_cov95,
             round(a / nullif(b, 0), 6) AS perf_ratio, coalesce(a / nullif(b, 0) > 1.5, false) AS performance_drift,
             latest_n >= 30 AND c < 0.85 AS coverage_drift FROM r""",
        "score",
    ),
)
def _perf(spark, sf):
    return G.performance_drift(score(spark, sf)).withColumns(r6("latest_mase", "baseline_mase", "latest_cov95", "perf_ratio"))


@query(
    "drift_streak",
    "W24",
    sql(
        """WITH h AS (SELECT origin AS vintage, avg(scaled_err) > (SELECT avg(scaled_err) FROM score) AS d FROM score GROUP BY ALL)
           SELECT CAST(count(*) FILTER (vintage > coalesce((SELECT max(vintage) FROM h WHERE NOT d), '')) AS INTEGER) AS consecutive_perf_drift,
             count(*) FILTER (vintage > coalesce((SELECT max(vintage) FROM h WHERE NOT d), '')) >= 3 AS recampaign_due FROM h""",
        "score",
    ),
)
def _streak(spark, sf):
    return G.drift_streak(G.vintage_flags(score(spark, sf)))


def with_world_copies(spark, sf):
    """Observations in which every fifth area publishes the world series' own cut-offs."""
    o = obs(spark, sf)
    copies = F.col("country").rlike("^s[0-9]*[16]$")
    areas = o.filter(copies).select(*SERIES).distinct()
    world = o.filter(F.col("country") == WORLD).drop("country")
    return o.filter(~copies).unionByName(areas.join(world, ["block", "category", "table"]).select(*o.columns))


register(
    "copied",
    ("fs",),
    """SELECT country, block, category, "table", m, y FROM fs WHERE NOT regexp_matches(country, '^s[0-9]*[16]$')
       UNION ALL SELECT a.country, a.block, a.category, a."table", w.m, w.y
       FROM (SELECT DISTINCT country, block, category, "table" FROM fs WHERE regexp_matches(country, '^s[0-9]*[16]$')) a
       JOIN fs w ON w.country = 'all_chargeability' AND w.block = a.block AND w.category = a.category AND w."table" = a."table\"""",
)


@query(
    "replica_representatives",
    "K3",
    sql(
        """SELECT block, category, "table", min(country) AS country, count(*) AS class_size FROM (
             SELECT country, block, category, "table", list(m ORDER BY m) AS lm, list(y ORDER BY m) AS ly FROM copied GROUP BY ALL)
           GROUP BY block, category, "table", lm, ly""",
        "copied",
    ),
)
def _replicas(spark, sf):
    values = with_world_copies(spark, sf).withColumnRenamed("bulletin_date", "date").withColumnRenamed("y", "actual")
    return G.replica_representatives(values, SERIES, ["block", "category", "table"]).select(*SERIES, "class_size")


@query(
    "replica_counts",
    "K3",
    sql(
        """SELECT CAST(sum(c) AS BIGINT) AS n_raw, count(*) AS n_effective FROM (SELECT count(*) AS c FROM (
             SELECT country, block, category, "table", list(m ORDER BY m) AS lm, list(y ORDER BY m) AS ly FROM copied GROUP BY ALL)
           GROUP BY block, category, "table", lm, ly)""",
        "copied",
    ),
)
def _replica_counts(spark, sf):
    values = with_world_copies(spark, sf).withColumnRenamed("bulletin_date", "date").withColumnRenamed("y", "actual")
    return G.effective_counts(G.replica_representatives(values, SERIES, ["block", "category", "table"]))


def copied_pairs(spark, sf):
    o = stage(with_world_copies(spark, sf), "with-copies")
    second = shadow_recipes(spark, sf)
    champ = L.scorecard(stamped(vintage_rows(o, coherent=False)), o)
    shadow = L.scorecard(stamped(vintage_rows(o, second, coherent=False), second), o)
    return L.pair_scorecards(champ, shadow)


@query("deduplicated_pairs", "K4")
def _dedup_pairs(spark, sf):
    kept = G.dedup_pairs(copied_pairs(spark, sf))
    return kept.groupBy("country", "block", "category", "table").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("promotion_decision", "G20")
def _decide(spark, sf):
    return G.decide(copied_pairs(spark, sf)).withColumns(r6("cov95_shadow", "cov95_champ", "min_margin"))


@query("evidence_fingerprint", "G21")
def _evidence(spark, sf):
    card = score(spark, sf).drop("scaled_err")
    return G.evidence_hash(card, ["2000-12", "2001-03"])


def series_errors(spark, sf):
    return backtest_report(spark, sf).select(*SERIES, "model", F.round("hold_mase", 9).alias("mase"))


@query(
    "champion_challenger",
    "G22 N5 W23",
    sql(
        f"""SELECT "table", model, n_series_raw, n_series_effective, {settle_sql("mean")} AS mean, {settle_sql("champion_mean")} AS champion_mean,
              {settle_sql("margin")} AS margin, 'normal' AS method, {settle_sql("p")} AS p, {settle_sql("holm_p")} AS holm_p, holdout_pass FROM verdicts""",
        "verdicts",
    ),
)
def _challenge(spark, sf):
    return challengers(spark, sf).withColumns(settle("mean", "champion_mean", "margin", "p", "holm_p"))


@query("best_challenger", "E24 G22", sql("SELECT * FROM best", "best"))
def _best(spark, sf):
    return G.best_challenger(challengers(spark, sf), ["table"])


register("hpairs", ("mbh",), f"""SELECT c.model, c."table", c.h, round(c.mase, 9) AS champ, round(b.mase, 9) AS base, round(c.mase, 9) - round(b.mase, 9) AS d
    FROM mbh c JOIN mbh b USING ({KEY}, h) WHERE c.model <> 'naive1' AND b.model = 'naive1'""")
register("htests", ("hpairs",), signed_rank("hpairs", 'model, "table", h'))
register("hmeans", ("hpairs", "htests"), """SELECT m.*, coalesce(t.p, 1.0) AS p FROM (SELECT model, "table", h, avg(champ) AS champion_mase, avg(base) AS baseline_mase, count(*) AS n
    FROM hpairs GROUP BY ALL HAVING count(*) >= 6) m LEFT JOIN htests t USING (model, "table", h)""")
register("hverdicts", ("hmeans",), holm_sql("hmeans", 'model, "table"', "h"))


@query(
    "significance_by_horizon",
    "E18 N5 W23",
    sql(
        f"""SELECT model, "table", h, {settle_sql("champion_mase")} AS champion_mase, {settle_sql("baseline_mase")} AS baseline_mase,
              {settle_sql("100 * (baseline_mase - champion_mase) / baseline_mase")} AS delta_pct, n, {settle_sql("p")} AS p, {settle_sql("holm_p")} AS holm_p,
              holm_p < 0.05 AND champion_mase < baseline_mase AS significant FROM hverdicts""",
        "hverdicts",
    ),
)
def _sig(spark, sf):
    """Every candidate against the random walk at every horizon."""
    errors = horizon_errors(spark, sf).withColumn("mase", F.round("mase", 9))
    return G.significance_by_horizon(errors, "naive1").withColumns(settle("champion_mase", "baseline_mase", "delta_pct", "p", "holm_p"))


register(
    "diffs",
    ("bt",),
    f"""SELECT b."table", b.model, round(round(n.hold_mase, 9) - round(b.hold_mase, 9), 12) AS d FROM bt b JOIN bt n USING ({KEY})
        WHERE n.model = 'naive1' AND b.model <> 'naive1' AND b.hold_mase IS NOT NULL""",
)


@query(
    "signed_rank_sums",
    "N5",
    sql(
        """WITH z AS (SELECT "table", model, count(*) FILTER (d = 0) AS zeros FROM diffs GROUP BY ALL),
                r AS (SELECT "table", model, d, rank() OVER w + (count(*) OVER (PARTITION BY "table", model, abs(d)) - 1) / 2.0 AS rk,
                             count(*) OVER (PARTITION BY "table", model, abs(d)) AS t
                      FROM diffs WHERE d <> 0 WINDOW w AS (PARTITION BY "table", model ORDER BY abs(d)))
           SELECT "table", model, count(*) AS n, any_value(zeros) AS zeros, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus,
                  CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r JOIN z USING ("table", model) GROUP BY ALL""",
        "diffs",
    ),
)
def _ranks(spark, sf):
    e = series_errors(spark, sf)
    base = e.filter(F.col("model") == "naive1").select(*SERIES, F.col("mase").alias("_b"))
    pairs = e.filter((F.col("model") != "naive1") & F.col("mase").isNotNull()).join(base, SERIES)
    pairs = pairs.withColumn("d", F.round(F.col("_b") - F.col("mase"), 12))
    return SG.signed_rank_sums(pairs, ["table", "model"], "d").drop("has_ties")


@query(
    "holm_adjustment",
    "W23",
    sql(
        """WITH p AS (SELECT block, category, "table", count(*) FILTER (status = 'U') / count(*) AS p FROM panel GROUP BY ALL),
                r AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY block) - row_number() OVER w + 1) * p) AS raw,
                             row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY block ORDER BY p, category, "table"))
           SELECT block, category, "table", round(p, 6) AS p, round(max(raw) OVER (PARTITION BY block ORDER BY i), 6) AS holm_p FROM r""",
        "panel",
    ),
)
def _holm(spark, sf):
    p = area_panel(spark, sf).groupBy("block", "category", "table").agg(
        (F.count_if(F.col("status") == "U") / F.count(F.lit(1))).alias("p")
    )
    return SG.holm(p, ["block"], "p", "holm_p", ["category", "table"]).withColumns(r6("p", "holm_p"))


register(
    "mranks",
    ("bt",),
    f"""SELECT {KEY}, model, rank() OVER (PARTITION BY {KEY} ORDER BY e) + (count(*) OVER (PARTITION BY {KEY}, e) - 1) / 2.0 AS rk,
               count(*) OVER (PARTITION BY {KEY}) AS k
        FROM (SELECT {KEY}, model, round(round(hold_mase, 9), 12) AS e FROM bt WHERE hold_mase IS NOT NULL)""",
)


@query(
    "average_ranks",
    "W21 N8",
    sql("SELECT model, round(avg(rk), 6) AS avg_rank, count(*) AS n_series, sum(rk) AS rank_sum FROM mranks WHERE k = 3 GROUP BY ALL", "mranks"),
)
def _avg_ranks(spark, sf):
    return SG.average_model_ranks(series_errors(spark, sf), FC.BASELINES).withColumns(r6("avg_rank"))


register(
    "picks",
    ("bt",),
    f"""SELECT {KEY}, model FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY round(sel_mase, 9), model) AS rn FROM bt
        WHERE sel_mase IS NOT NULL) WHERE rn <= 2""",
)


@query(
    "best_two_models",
    "K5",
    sql(
        f"""SELECT {KEY}, m AS date, median(forecast) AS forecast, string_agg(model, '+' ORDER BY model) AS models
            FROM onelong JOIN picks USING ({KEY}, model) WHERE region = 'holdout' GROUP BY {KEY}, m""",
        "onelong",
        "picks",
    ).replace("median(forecast) AS forecast", "round(median(forecast), 6) AS forecast"),
)
def _best_k(spark, sf):
    o = obs(spark, sf)
    long = FC.one_step_long(o, SHORT)
    errors = ME.backtest(long, o, FC.BASELINES, SHORT).select(*SERIES, "model", F.round("sel_mase", 9).alias("sel_mase"))
    hold = long.filter(F.col("region") == "holdout").withColumnRenamed("bulletin_date", "date")
    return G.best_k(errors, hold, 2, [*SERIES, "date"]).withColumns(r6("forecast"))


@query(
    "selection_strategies",
    "K6",
    sql(
        f"""WITH c AS (SELECT {KEY}, model, round(sel_mase, 9) AS s, hold_mase AS h FROM bt WHERE sel_mase IS NOT NULL AND hold_mase IS NOT NULL),
               g AS (SELECT model, avg(s) AS s, avg(h) AS h, count(*) AS n FROM c GROUP BY ALL),
               p AS (SELECT {KEY}, arg_min(h, (s, model)) AS sel, min(h) AS orc FROM c GROUP BY ALL)
            SELECT 'global_best' AS strategy, round(h, 6) AS mase, n AS n_series FROM g WHERE s = (SELECT min(s) FROM g)
            UNION ALL SELECT 'per_series', round(avg(sel), 6), count(*) FROM p UNION ALL SELECT 'oracle', round(avg(orc), 6), count(*) FROM p""",
        "bt",
    ),
)
def _strategies(spark, sf):
    bt = backtest_report(spark, sf).withColumn("sel_mase", F.round("sel_mase", 9))
    return G.strategies(bt).withColumns(r6("mase"))


def seed_grid(spark, sf):
    wide = FC.one_step(obs(spark, sf), SHORT).filter((F.col("region") == "holdout") & F.col("y").isNotNull())
    rows = wide.select(
        F.concat_ws("/", *SERIES).alias("unique_id"), F.col("bulletin_date").alias("ds"), "y", "naive1", "drift",
        F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seed"),
    )
    gap = (F.col("seed") == 2) & (F.month("ds") == 5)
    return rows.withColumn("drift", F.when(~gap, F.col("drift"))).filter((F.col("seed") != 3) | (F.month("ds") != 7))


@query(
    "seed_grid_problems",
    "G19",
    sql(
        """WITH s AS (SELECT h.*, k.seed FROM onestep h, (SELECT unnest([1, 2, 3]) AS seed) k WHERE region = 'holdout' AND y IS NOT NULL
                        AND (seed <> 3 OR month(m) <> 7)),
               c AS (SELECT count(DISTINCT n) - 1 AS d FROM (SELECT seed, count(*) AS n FROM s GROUP BY ALL))
           SELECT 'different grids' AS problem, d AS n FROM c UNION ALL SELECT 'different truths', d FROM c UNION ALL SELECT 'different sizes', d FROM c
           UNION ALL SELECT 'naive1: non-finite rows', 0
           UNION ALL SELECT 'drift: non-finite rows', count(*) FILTER (seed = 2 AND month(m) = 5) FROM s""",
        "onestep",
    ),
)
def _seed_problems(spark, sf):
    return G.seed_problems(G.seed_coverage(seed_grid(spark, sf), ("naive1", "drift")), ("naive1", "drift"))


@query(
    "aligned_models",
    "J13 K8",
    sql(
        f"""SELECT g.country, g.block, g.category, g."table", g.m AS bulletin_date, g.y, round(o.naive1, 6) AS naive1, round(o.drift, 6) AS drift,
              CAST(NULL AS DOUBLE) AS absent
            FROM (SELECT * FROM slev WHERE n_grid - pos < 24) g LEFT JOIN onestep o USING (country, block, category, "table", m)""",
        "onestep",
    ),
)
def _align(spark, sf):
    o = obs(spark, sf)
    grid = S.tail_per_series(S.densify(o), 24).select(*SERIES, "bulletin_date", "y")
    long = FC.one_step_long(o, SHORT).filter(F.col("model") != "seasonal")
    out = G.align_models(grid, long, ("naive1", "drift", "absent"), [*SERIES, "bulletin_date"])
    return out.withColumns(r6("naive1", "drift"))


@query(
    "vintage_completeness",
    "J11",
    sql(
        f"""WITH e AS (SELECT DISTINCT {KEY} FROM sup WHERE country <> 's7'), g AS (SELECT DISTINCT {KEY} FROM led WHERE origin = '2001-06'),
               miss AS (SELECT * FROM e ANTI JOIN g USING ({KEY}))
            SELECT *, CASE WHEN regexp_matches(country, '3$') THEN 'excused' ELSE 'missing' END AS problem FROM miss
            UNION ALL SELECT *, 'extra' FROM (SELECT * FROM g ANTI JOIN e USING ({KEY}))""",
        "sup",
        "led",
    ),
)
def _complete(spark, sf):
    expected = supplier_panel(spark, sf).filter(F.col("country") != "s7")
    got = ledger(spark, sf).filter(F.col("origin") == "2001-06")
    allowed = (
        expected.filter(F.col("country").rlike("[34]$"))
        .select(*SERIES)
        .distinct()
        .withColumn("expires", F.when(F.col("country").endswith("3"), "2001-09").otherwise("2000-01"))
        .withColumn("reason", F.lit("short history"))
    )
    return L.completeness(expected, got, SERIES, allowed, "2001-06")


@query(
    "horizon_grid",
    "J12",
    sql(
        f"""SELECT {KEY}, h, n - {MINTRAIN} >= h AS feasible FROM (SELECT {KEY}, max(n_grid) AS n FROM slev GROUP BY ALL),
              (SELECT CAST(unnest([{", ".join(map(str, HORIZONS))}]) AS INTEGER) AS h)""",
        "slev",
    ),
)
def _grid(spark, sf):
    return S.horizon_grid(obs(spark, sf), HORIZONS, SHORT)


@query(
    "append_missing_models",
    "S8",
    sql(
        f"""SELECT model, {KEY}, m AS date, round(forecast, 6) AS forecast FROM onelong WHERE region = 'holdout' AND model = 'naive1'
            UNION ALL SELECT model, {KEY}, m, round(forecast + 1, 6) FROM onelong WHERE region = 'holdout' AND model <> 'naive1'""",
        "onelong",
    ),
)
def _append(spark, sf):
    hold = FC.one_step_long(obs(spark, sf), SHORT).filter(F.col("region") == "holdout")
    rows = hold.select("model", *SERIES, F.col("bulletin_date").alias("date"), "forecast")
    stored = rows.filter(F.col("model") == "naive1")
    return L.append_missing(stored, rows.withColumn("forecast", F.col("forecast") + 1)).withColumns(r6("forecast"))


@query(
    "conservative_objective",
    "E28",
    sql(
        f"""SELECT "table", model, count(*) AS n, round(avg(e) + stddev_pop(e), 6) AS objective FROM (
              SELECT {KEY}, model, avg(abs(y - forecast)) / any_value(scale) AS e FROM (
                SELECT o.*, h.scale FROM onelong o JOIN slev g USING (country, block, category, "table", m) JOIN hscale h USING (country, block, category, "table")
                WHERE n_grid - pos BETWEEN 30 AND 41 AND o.y IS NOT NULL) GROUP BY ALL) WHERE e IS NOT NULL GROUP BY ALL""",
        "onelong",
        "hscale",
    ).replace("SELECT o.*, h.scale", "SELECT o.country, o.block, o.category, o.\"table\", o.model, o.y, o.forecast, h.scale"),
)
def _objective(spark, sf):
    o = obs(spark, sf)
    windows = S.tuning_regions(S.densify(o), SHORT).filter(F.col("window") == "tune").select(*SERIES, "bulletin_date")
    rows = FC.one_step_long(o, SHORT).filter(F.col("y").isNotNull()).join(windows, [*SERIES, "bulletin_date"], "left_semi")
    err = rows.groupBy(*SERIES, "model").agg(F.avg(F.abs(F.col("y") - F.col("forecast"))).alias("mae"))
    errors = err.join(ME.holdout_scale(o, SHORT), SERIES).withColumn("mase", F.col("mae") / F.col("scale"))
    return G.conservative_objective(errors, ["table", "model"]).withColumns(r6("objective"))
