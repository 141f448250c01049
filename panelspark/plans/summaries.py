"""Panel summaries, movement, coverage and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import SERIES
from panelspark.operators import aggregates as A
from panelspark.operators import movement as M
from panelspark.operators import setops as SO
from panelspark.plans.ctes import KEY, W, register, sql
from panelspark.plans.protocol import SHORT, obs, region_obs
from panelspark.plans.registry import query
from panelspark.sources.tables import REGIONS, area_panel, rank_panel, region_panel, supplier_panel

KEYB = 'country, block, category, "table", bulletin_date'
WB = 'PARTITION BY country, block, category, "table" ORDER BY bulletin_date'


@query(
    "status_mix",
    "A4",
    sql(
        """SELECT status, count(*) AS n_rows, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM panel GROUP BY status""",
        "panel",
    ),
)
def _mix(spark, sf):
    return A.status_mix(area_panel(spark, sf))


@query(
    "status_mix_by_block",
    "A4",
    sql(
        """SELECT block, "table", status, count(*) AS n_rows,
             round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY block, "table"), 1) AS pct FROM panel GROUP BY block, "table", status""",
        "panel",
    ),
)
def _mix_by(spark, sf):
    return A.status_mix(area_panel(spark, sf), "block", "table")


@query(
    "latest_cutoff",
    "A5",
    sql(
        """SELECT country, category, max(bulletin_date) AS latest_month, arg_max(priority_date, bulletin_date) AS latest_priority_date
           FROM sup WHERE status = 'F' AND block = 'family' AND "table" = 'FAD' GROUP BY ALL""",
        "sup",
    ),
)
def _latest(spark, sf):
    f = supplier_panel(spark, sf).filter(
        (F.col("status") == "F") & (F.col("block") == "family") & (F.col("table") == "FAD")
    )
    return A.latest(f, "country", "category")


@query(
    "series_inventory",
    "A6",
    sql(
        f"""SELECT {KEY}, count(*) AS n, count(*) FILTER (status = 'F') AS n_f, min(bulletin_date) AS start, max(bulletin_date) AS "end",
              date_diff('month', min(bulletin_date), max(bulletin_date)) + 1 AS span,
              date_diff('month', min(bulletin_date), max(bulletin_date)) + 1 - count(DISTINCT bulletin_date) AS gaps
            FROM sup GROUP BY ALL""",
        "sup",
    ),
)
def _inventory(spark, sf):
    return A.inventory(supplier_panel(spark, sf))


CATEGORIES = ("EB1", "EB2", "EB4_RW", "F1", "F2A")


@query(
    "coverage_matrix",
    "A7",
    sql(
        "SELECT country, "
        + ", ".join(f"count(DISTINCT \"table\") FILTER (category = '{c}') AS \"{c}\"" for c in CATEGORIES)
        + " FROM panel GROUP BY ALL",
        "panel",
    ),
)
def _coverage(spark, sf):
    return A.coverage_matrix(area_panel(spark, sf), CATEGORIES)


register("sd", ("fs",), f"SELECT *, y - lag(y) OVER ({W}) AS d FROM fs")
register("fd", ("f",), f"SELECT *, y - lag(y) OVER ({W}) AS d FROM f")
register("rd", ("fr",), f"SELECT *, y - lag(y) OVER ({W}) AS d FROM fr")


@query(
    "series_census",
    "A8 W2",
    sql(
        f"""SELECT a.*, first_f, last_f, coalesce(span, 0) AS span_months, coalesce(round(n_f / span, 4), 0.0) AS continuity,
              coalesce(span - n_f, 0) AS n_gaps, coalesce(n_retro, 0) AS n_retro, coalesce(worst, 0.0) AS worst_retro_days,
              round(coalesce(med, 0.0), 1) AS median_step_days, coalesce(round(frozen, 4), 0.0) AS pct_frozen,
              n_f >= 48 AND coalesce(span, 0) >= CASE a."table" WHEN 'FAD' THEN 36 ELSE 24 END + 30 AS evaluable
            FROM (SELECT {KEY}, count(*) AS n_total, count(*) FILTER (status = 'F') AS n_f, count(*) FILTER (status = 'C') AS n_c,
                         count(*) FILTER (status = 'U') AS n_u, count(*) FILTER (status = 'UNK') AS n_unk FROM sup GROUP BY ALL) a
            LEFT JOIN (SELECT {KEY}, min(m) AS first_f, max(m) AS last_f, date_diff('month', min(m), max(m)) + 1 AS span,
                         count(*) FILTER (d < 0) AS n_retro, greatest(0.0::DOUBLE, -min(d)) AS worst, median(d) AS med,
                         avg(CASE WHEN d IS NULL THEN NULL WHEN d = 0 THEN 1.0 ELSE 0.0 END) AS frozen
                       FROM sd GROUP BY ALL) USING ({KEY})""",
        "sup",
        "sd",
    ),
)
def _census(spark, sf):
    return A.census(supplier_panel(spark, sf), SHORT)


register(
    "pfacts",
    ("sup", "sd"),
    """SELECT p.*, q.*, round(100.0 * n_obs_f / n_obs, 2) AS pct_trainable FROM
        (SELECT count(*) AS n_obs, count(*) FILTER (status = 'F') AS n_obs_f, count(DISTINCT bulletin_date) AS n_months,
                min(bulletin_date) AS date_first, max(bulletin_date) AS date_last,
                count(DISTINCT country || '/' || block || '/' || category || '/' || "table") AS n_series,
                count(DISTINCT CASE WHEN status = 'F' THEN country || '/' || block || '/' || category || '/' || "table" END) AS n_series_with_f
         FROM sup) p,
        (SELECT round(100 * avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END), 2) AS pct_retro,
                round(100 * avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 2) AS pct_frozen,
                round(median(d), 1) AS median_step_days FROM sd WHERE d IS NOT NULL) q""",
)


@query("panel_facts", "A9", sql("SELECT * FROM pfacts", "pfacts"))
def _facts(spark, sf):
    return A.panel_facts(supplier_panel(spark, sf))


NOTES = {
    "n_obs": ("rows", "all regimes", "panel"),
    "n_obs_f": ("rows", "regime F", "panel"),
    "pct_retro": ("percent", "observed steps", "panel"),
    "median_step_days": ("days", "observed steps", "panel"),
}


@query(
    "annotated_facts",
    "A22",
    sql(
        "\nUNION ALL ".join(
            f"SELECT CAST(date_last AS VARCHAR) AS vintage, '{n}' AS fact, CAST({n} AS DOUBLE) AS \"value\", '{u}' AS unit, "
            f"'{p}' AS population, '{s}' AS source FROM pfacts"
            for n, (u, p, s) in NOTES.items()
        ),
        "pfacts",
    ),
)
def _annotated(spark, sf):
    return A.annotate_facts(A.panel_facts(supplier_panel(spark, sf)), NOTES, "date_last")


@query(
    "monthly_advance",
    "A10",
    sql(
        """SELECT CAST(month(m) AS INTEGER) AS "month", round(median(d), 1) AS median_advance, count(*) AS n
           FROM sd WHERE d IS NOT NULL GROUP BY ALL""",
        "sd",
    ),
)
def _monthly(spark, sf):
    return A.monthly_advance(obs(spark, sf))


@query(
    "fiscal_pulse",
    "A10",
    sql(
        "SELECT CAST(year(m) + CASE WHEN month(m) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, "
        + ", ".join(f"median(d) FILTER (month(m) = {k}) AS m{k:02d}" for k in A.FISCAL_MONTHS)
        + " FROM sd WHERE d IS NOT NULL GROUP BY ALL",
        "sd",
    ),
)
def _pulse(spark, sf):
    return A.fiscal_pulse(obs(spark, sf))


@query(
    "table_gap",
    "A11",
    sql(
        """SELECT country, block, category, max(m) AS date, CAST(arg_max(dff - fad, m) AS BIGINT) AS gap_days FROM (
             SELECT country, block, category, m, max(y) FILTER ("table" = 'FAD') AS fad, max(y) FILTER ("table" = 'DFF') AS dff
             FROM fs GROUP BY ALL) WHERE fad IS NOT NULL AND dff IS NOT NULL GROUP BY ALL""",
        "fs",
    ),
)
def _gap(spark, sf):
    return A.table_gap(obs(spark, sf))


@query(
    "backlog_today",
    "A12",
    sql(
        f"""SELECT {KEY}, round(date_diff('day', priority_date, bulletin_date) / 365.25, 1) AS backlog_years FROM sup
            WHERE status = 'F' AND bulletin_date = (SELECT max(bulletin_date) FROM sup WHERE status = 'F')""",
        "sup",
    ),
)
def _backlog(spark, sf):
    return A.backlog_today(supplier_panel(spark, sf))


@query(
    "retro_events",
    "W2",
    sql(f"SELECT {KEY}, m AS bulletin_date, CAST(-d AS BIGINT) AS days FROM sd WHERE d < 0", "sd"),
)
def _retro(spark, sf):
    return M.retro_events(obs(spark, sf))


@query(
    "retro_by_month",
    "A13",
    sql(
        """SELECT m AS bulletin_date, count(*) AS n_events, CAST(sum(-d) AS BIGINT) AS total_days FROM sd WHERE d < 0 GROUP BY ALL""",
        "sd",
    ),
)
def _retro_month(spark, sf):
    return A.retro_by_month(M.retro_events(obs(spark, sf)))


@query(
    "top_retro_events",
    "A13 K7",
    sql(
        f"""SELECT {KEY}, m AS bulletin_date, CAST(-d AS BIGINT) AS days FROM sd WHERE d < 0
            ORDER BY -d DESC, m, country, block, category, "table" LIMIT 5""",
        "sd",
    ),
)
def _top_retro(spark, sf):
    ev = M.retro_events(obs(spark, sf))
    return A.top_n(ev, 5, F.col("days").desc(), F.col("bulletin_date"), *[F.col(c) for c in SERIES])


@query(
    "shortest_series",
    "K7",
    sql(
        f"""SELECT {KEY}, count(*) AS n, count(*) FILTER (status = 'F') AS n_f FROM sup GROUP BY ALL
            ORDER BY n_f, country, block, category, "table" LIMIT 12""",
        "sup",
    ),
)
def _shortest(spark, sf):
    inv = A.inventory(supplier_panel(spark, sf)).select(*SERIES, "n", "n_f")
    return A.top_n(inv, 12, F.col("n_f"), *[F.col(c) for c in SERIES])


@query(
    "big_jumps",
    "W3",
    sql(f"SELECT {KEY}, m AS bulletin_date, round(d / 365.25, 4) AS delta_years FROM sd WHERE abs(d / 365.25) > 8", "sd"),
)
def _jumps(spark, sf):
    return M.big_jumps(obs(spark, sf))


@query(
    "regime_share",
    "A14",
    sql(
        f"SELECT {KEY}, "
        + ", ".join(f"round(count(*) FILTER (status = '{s}') / count(*), 6) AS share_{s.lower()}" for s in ("F", "C", "U", "UNK"))
        + " FROM panel GROUP BY ALL",
        "panel",
    ),
)
def _share(spark, sf):
    return A.regime_share(area_panel(spark, sf))


@query(
    "step_histogram",
    "A15",
    sql(
        """SELECT CAST(CASE WHEN d < -200 THEN -1 WHEN d > 400 THEN 60 ELSE least(floor((d + 200) / 10), 59) END AS INTEGER) AS bin,
             count(*) AS n, min(d) AS min_step, max(d) AS max_step FROM sd WHERE d IS NOT NULL GROUP BY ALL""",
        "sd",
    ),
)
def _hist(spark, sf):
    return A.step_histogram(obs(spark, sf))


register(
    "move_grid",
    ("sup",),
    f"""SELECT {KEY}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS bulletin_date
        FROM (SELECT DISTINCT {KEY}, (SELECT min(bulletin_date) FROM sup) AS lo, (SELECT max(bulletin_date) FROM sup) AS hi FROM sup)""",
)


@query(
    "movement_class",
    "P15",
    sql(
        f"""SELECT {KEYB}, CASE WHEN status IS NULL THEN 'absent' WHEN status = 'F' AND d < 0 THEN 'retro'
              WHEN status = 'F' AND d = 0 THEN 'frozen' WHEN status = 'F' THEN 'advance' WHEN status = 'C' THEN 'current'
              ELSE 'other' END AS movement
            FROM move_grid LEFT JOIN (SELECT *, days_since_base - lag(days_since_base) OVER ({WB}) AS d FROM sup) USING ({KEYB})""",
        "move_grid",
    ),
)
def _movement(spark, sf):
    return M.movement_class(supplier_panel(spark, sf))


@query(
    "bulletin_feed",
    "W17 S6",
    sql(
        f"""WITH cal AS (SELECT bulletin_date, lag(bulletin_date) OVER (ORDER BY bulletin_date) AS pm,
                                row_number() OVER (ORDER BY bulletin_date DESC) AS age
                         FROM (SELECT DISTINCT bulletin_date FROM panel))
            SELECT a.country, a.block, a.category, a."table", a.bulletin_date, a.status, a.raw_value, a.priority_date,
              CASE WHEN a.status = 'F' AND b.status = 'F' THEN CAST(date_diff('day', b.priority_date, a.priority_date) AS DOUBLE) END AS delta_days
            FROM panel a JOIN cal c ON c.bulletin_date = a.bulletin_date AND age <= 24
            LEFT JOIN panel b ON b.country = a.country AND b.block = a.block AND b.category = a.category AND b."table" = a."table"
              AND b.bulletin_date = c.pm""",
        "panel",
    ),
)
def _feed(spark, sf):
    return M.bulletin_feed(area_panel(spark, sf), 24)


register(
    "drifted",
    ("sd",),
    f"""WITH c AS (SELECT *, max(m) OVER (PARTITION BY {KEY}) AS lm, count(*) OVER (PARTITION BY {KEY}) AS n FROM sd),
                 h AS (SELECT {KEY}, median(d) AS med FROM c WHERE m < lm AND d IS NOT NULL GROUP BY ALL),
                 a AS (SELECT {KEY}, any_value(med) AS med, median(abs(d - med)) AS mad FROM c JOIN h USING ({KEY})
                       WHERE m < lm AND d IS NOT NULL GROUP BY {KEY})
            SELECT {KEY}, CAST(d AS BIGINT) AS delta_days, med AS hist_median_delta, mad FROM c JOIN a USING ({KEY})
            WHERE m = lm AND lm = (SELECT max(m) FROM fs) AND n >= 12 AND mad > 0 AND abs(d - med) > 8 * mad""",
)


@query("data_drift", "W18", sql("SELECT * FROM drifted", "drifted"))
def _drift(spark, sf):
    return M.data_drift(obs(spark, sf))


@query(
    "systemic_drift",
    "W18",
    sql("SELECT count(*) AS n_flagged, count(DISTINCT country) AS n_areas, count(*) >= 8 AS data_drift FROM drifted", "drifted"),
)
def _systemic(spark, sf):
    return M.systemic_drift(M.data_drift(obs(spark, sf)))


@query(
    "increment_correlation",
    "A23",
    sql(
        """SELECT a.block, a.category, a."table", a.country AS area_a, b.country AS area_b, round(corr(a.d, b.d), 6) AS corr,
             count(*) AS n_months
           FROM rd a JOIN rd b ON a.block = b.block AND a.category = b.category AND a."table" = b."table" AND a.m = b.m
             AND a.country < b.country WHERE a.d IS NOT NULL AND b.d IS NOT NULL GROUP BY ALL""",
        "rd",
    ),
)
def _corr(spark, sf):
    return A.increment_corr(region_obs(spark, sf), REGIONS).withColumn("corr", F.round("corr", 6))


register(
    "rsig",
    ("rd",),
    "SELECT country, m, avg(d) AS s FROM rd WHERE d IS NOT NULL GROUP BY ALL",
)


@query(
    "lead_lag",
    "A24",
    sql(
        """WITH c AS (SELECT a.country AS area_a, b.country AS area_b, k, corr(a.s, b.s) AS r
                      FROM rsig a, rsig b, (SELECT unnest(generate_series(-6, 6)) AS k)
                      WHERE a.m = b.m + to_months(CAST(k AS INTEGER)) GROUP BY ALL)
           SELECT area_a, area_b, round(max(r), 6) AS corr, CAST(arg_max(k, (round(r, 9), -k)) AS INTEGER) AS lag FROM c GROUP BY ALL""",
        "rsig",
    ),
)
def _leadlag(spark, sf):
    return A.lead_lag(region_obs(spark, sf), REGIONS).withColumn("corr", F.round("corr", 6))


@query(
    "missing_months",
    "U3",
    sql(
        """SELECT region, bulletin_date FROM (
             SELECT region, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS bulletin_date
             FROM (SELECT region, min(bulletin_date) AS lo, max(bulletin_date) AS hi FROM ranks WHERE status = 'F' GROUP BY ALL))
           EXCEPT SELECT region, bulletin_date FROM ranks WHERE status = 'F'""",
        "ranks",
    ),
)
def _missing(spark, sf):
    return SO.missing_months(rank_panel(spark, sf).filter(F.col("status") == "F"), ["region"])


@query(
    "missing_months_by_series",
    "U3",
    sql(
        f"""SELECT {KEY}, m AS bulletin_date FROM sgrid WHERE y IS NULL AND m NOT IN
              (SELECT bulletin_date FROM ranks WHERE region = 'asia' AND status <> 'F')""",
        "sgrid",
        "ranks",
    ),
)
def _missing_series(spark, sf):
    allowed = rank_panel(spark, sf).filter((F.col("region") == "asia") & (F.col("status") != "F"))
    return SO.missing_months(obs(spark, sf), SERIES, allowed)


@query(
    "stacked_blocks",
    "U1",
    sql(
        """SELECT block, "table", status, count(*) AS n FROM (SELECT block, "table", status FROM panel
             UNION ALL SELECT block, "table", status FROM rpanel) GROUP BY ALL""",
        "panel",
        "rpanel",
    ),
)
def _stack(spark, sf):
    both = SO.union_blocks(area_panel(spark, sf), region_panel(spark, sf))
    return both.groupBy("block", "table", "status").agg(F.count(F.lit(1)).alias("n"))
