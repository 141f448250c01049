"""Audit, reconciliation, guards and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import PANEL_KEY
from panelspark.operators import audit as AU
from panelspark.operators import ledger as L
from panelspark.plans.ctes import KEY, register, sql
from panelspark.plans.registry import query
from panelspark.sources.tables import annotate, area_panel, order_cells, published, rank_panel

KEY5 = 'country, block, category, "table", bulletin_date'


def fine_cells(spark, sf):
    return annotate(published(order_cells(spark, sf, by_priority=True), "o_orderpriority"), "o_orderpriority")


register(
    "dedup",
    ("fine",),
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY5} ORDER BY CASE status WHEN 'F' THEN 0 WHEN 'C' THEN 1 WHEN 'U' THEN 2
          ELSE 3 END, priority_date, raw_value) AS rn FROM fine) WHERE rn = 1""",
)


@query(
    "dedup_by_regime",
    "K1",
    sql(f"SELECT {KEY5}, status, priority_date, raw_value FROM dedup", "dedup"),
)
def _dedup(spark, sf):
    return AU.dedup_regime(fine_cells(spark, sf)).select(*PANEL_KEY, "status", "priority_date", "raw_value")


@query(
    "dedup_conflicts",
    "K1",
    sql(
        f"""SELECT {KEY5}, min(priority_date) AS first_date, max(priority_date) AS last_date FROM fine WHERE status = 'F'
            GROUP BY ALL HAVING min(priority_date) < max(priority_date)""",
        "fine",
    ),
)
def _conflicts(spark, sf):
    return AU.dedup_conflicts(fine_cells(spark, sf))


@query(
    "dedup_keep_first",
    "K2",
    sql(
        f"""SELECT {KEY5}, status, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY {KEY5} ORDER BY o_orderpriority) AS rn
            FROM fine) WHERE rn = 1""",
        "fine",
    ),
)
def _first(spark, sf):
    return L.dedup_first(fine_cells(spark, sf).select(*PANEL_KEY, "status", "o_orderpriority"), PANEL_KEY, ["o_orderpriority"])


_RULES = {
    "negative_days": "days_since_base < 0",
    "date_out_of_range": "status = 'F' AND (year(priority_date) < 1975 OR year(priority_date) > (SELECT max(year(bulletin_date)) FROM panel))",
    "date_after_bulletin": "status = 'F' AND priority_date > bulletin_date",
    "c_raw_mismatch": "status = 'C' AND rtrim(upper(raw_value), '*† ') <> 'C'",
    "u_raw_mismatch": "status = 'U' AND rtrim(upper(raw_value), '*† ') <> 'U'",
    "status_domain": "status NOT IN ('F', 'C', 'U', 'UNK')",
    "f_without_date": "status = 'F' AND (priority_date IS NULL OR days_since_base IS NULL)",
    "date_off_regime": "status <> 'F' AND (priority_date IS NOT NULL OR days_since_base IS NOT NULL)",
}


register(
    "validity",
    ("panel",),
    " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS n FROM panel" for n, c in _RULES.items()),
)


@query("date_validity", "G9", sql("SELECT rule, n FROM validity", "validity"))
def _validity(spark, sf):
    return AU.date_validity(area_panel(spark, sf))


register(
    "tpairs",
    ("panel",),
    """SELECT * FROM (SELECT country, block, category, bulletin_date, max(priority_date) FILTER ("table" = 'FAD') AS fad,
         max(priority_date) FILTER ("table" = 'DFF') AS dff FROM panel WHERE status = 'F' GROUP BY ALL)
       WHERE fad IS NOT NULL AND dff IS NOT NULL""",
)


@query("table_pairs", "J10", sql("SELECT *, dff < fad AS violation FROM tpairs", "tpairs"))
def _pairs(spark, sf):
    return AU.pair_tables(area_panel(spark, sf))


register(
    "recon",
    ("fine", "dedup"),
    """SELECT status, coalesce(s.n, 0) AS n_source, coalesce(p.n, 0) AS n_panel, coalesce(s.n, 0) - coalesce(p.n, 0) AS diff,
         CASE WHEN coalesce(s.n, 0) - coalesce(p.n, 0) < 0 OR coalesce(s.n, 0) - coalesce(p.n, 0) > 50 THEN 'CRIT'
              WHEN coalesce(s.n, 0) - coalesce(p.n, 0) > 0 THEN 'INFO' ELSE 'OK' END AS severity
       FROM (SELECT status, count(*) AS n FROM fine GROUP BY ALL) s FULL JOIN (SELECT status, count(*) AS n FROM dedup GROUP BY ALL) p USING (status)""",
)


@query("source_reconciliation", "G8", sql("SELECT * FROM recon", "recon"))
def _recon(spark, sf):
    fine = fine_cells(spark, sf)
    return AU.reconcile(fine, AU.dedup_regime(fine))


register(
    "djump",
    ("dedup",),
    f"""SELECT *, days_since_base - lag(days_since_base) OVER (PARTITION BY {KEY} ORDER BY bulletin_date) AS d FROM dedup WHERE status = 'F'""",
)


@query(
    "cleaning_ledger",
    "G10",
    sql(
        f"""SELECT strftime(max(bulletin_date), '%Y-%m') AS vintage, count(*) AS n_rows,
              count(DISTINCT country || '/' || block || '/' || category || '/' || "table") AS n_series,
              count(*) FILTER (status = 'F') AS rows_f, count(*) FILTER (status = 'C') AS rows_c, count(*) FILTER (status = 'U') AS rows_u,
              count(*) FILTER (status = 'UNK') AS rows_unk, (SELECT count(*) FROM djump WHERE abs(d) > 8 * 365.25) AS big_jumps_gt_8y,
              (SELECT count(*) FROM fine) - count(*) AS dup_collapsed FROM dedup""",
        "djump",
    ),
)
def _cleaning(spark, sf):
    fine = fine_cells(spark, sf)
    return AU.cleaning_ledger(AU.dedup_regime(fine), fine)


@query(
    "build_guards",
    "G11",
    sql(
        """SELECT 'month_unparseable' AS guard, count(*) FILTER (bulletin_date IS NULL) AS n FROM fine
           UNION ALL SELECT 'f_date_unparseable', count(*) FILTER (status = 'F' AND priority_date IS NULL) FROM fine
           UNION ALL SELECT 'epoch_underflow', count(*) FILTER (days_since_base < 0) FROM fine
           UNION ALL SELECT 'unknown_table', count(*) FILTER ("table" NOT IN ('FAD', 'DFF')) FROM fine
           UNION ALL SELECT 'empty_source', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM fine""",
        "fine",
    ),
)
def _guards(spark, sf):
    return AU.guards(fine_cells(spark, sf))


@query(
    "areas_behind",
    "G11",
    sql(
        """SELECT country, max(bulletin_date) AS last_month FROM panel WHERE status = 'F' GROUP BY ALL
           HAVING max(bulletin_date) < (SELECT max(bulletin_date) FROM panel WHERE status = 'F')""",
        "panel",
    ),
)
def _behind(spark, sf):
    return AU.newest_month_gaps(area_panel(spark, sf).filter(F.col("status") == "F"))


@query(
    "newest_month_coverage",
    "G12",
    sql(
        """WITH c AS (SELECT block, "table", count(*) AS n FROM panel WHERE status <> 'C' AND bulletin_date = (SELECT max(bulletin_date) FROM panel WHERE status <> 'C') GROUP BY ALL)
           SELECT 'missing combination' AS problem, block || '/' || "table" AS detail
           FROM (VALUES ('employment', 'FAD'), ('employment', 'DFF'), ('family', 'FAD'), ('family', 'DFF')) r(block, "table") ANTI JOIN c USING (block, "table")
           UNION ALL SELECT 'too few rows', CAST(sum(n) AS VARCHAR) FROM c HAVING sum(n) < 9000""",
        "panel",
    ),
)
def _coverage(spark, sf):
    return AU.month_coverage(area_panel(spark, sf).filter(F.col("status") != "C"), min_rows=9000)


@query(
    "panel_freshness",
    "G12 G5",
    sql(
        """SELECT (SELECT max(bulletin_date) FROM panel) AS panel_month, (SELECT max(bulletin_date) FROM ranks) AS source_month,
             (SELECT max(bulletin_date) FROM panel) < (SELECT max(bulletin_date) FROM ranks) AS stale""",
        "panel",
        "ranks",
    ),
)
def _fresh(spark, sf):
    return AU.freshness(area_panel(spark, sf), rank_panel(spark, sf))


register(
    "findings",
    ("validity", "tpairs", "panel", "dedup"),
    f"""SELECT 'schema' AS dimension, 'OK' AS severity, 'missing columns' AS message, 0 AS n
        UNION ALL SELECT 'completeness', CASE WHEN n > 0 THEN 'CRIT' ELSE 'OK' END, 'unexplained absent months', n FROM (
          SELECT date_diff('month', min(bulletin_date), max(bulletin_date)) + 1 - count(DISTINCT bulletin_date) AS n FROM panel)
        UNION ALL SELECT 'inventory', 'OK', 'series', count(*) FROM (SELECT DISTINCT {KEY} FROM panel)
        UNION ALL SELECT 'regimes', CASE WHEN n > 0 THEN 'WARN' ELSE 'OK' END, 'unparsed cells', n FROM (SELECT count(*) FILTER (status = 'UNK') AS n FROM panel)
        UNION ALL SELECT 'keys', 'OK', 'repeated keys', 0
        UNION ALL SELECT 'dates', CASE WHEN n = 0 THEN 'OK' WHEN rule = 'date_after_bulletin' THEN 'WARN'
                    WHEN rule IN ('c_raw_mismatch', 'u_raw_mismatch') THEN 'INFO' ELSE 'CRIT' END, rule, n FROM validity
        UNION ALL SELECT 'tables', CASE WHEN n > 0 THEN 'INFO' ELSE 'OK' END, 'DFF behind FAD', n FROM (SELECT count(*) FILTER (dff < fad) AS n FROM tpairs)
        UNION ALL SELECT 'jumps', CASE WHEN n > 0 THEN 'INFO' ELSE 'OK' END, 'steps over 8 years', n FROM (
          SELECT count(*) FILTER (abs(d) > 8 * 365.25) AS n FROM (SELECT days_since_base - lag(days_since_base) OVER
            (PARTITION BY {KEY} ORDER BY bulletin_date) AS d FROM panel WHERE status = 'F'))
        UNION ALL SELECT 'reconciliation', CASE WHEN d < 0 OR d > 50 THEN 'CRIT' WHEN d > 0 THEN 'INFO' ELSE 'OK' END, status, d FROM (
          SELECT status, coalesce(s.n, 0) - coalesce(p.n, 0) AS d FROM (SELECT status, count(*) AS n FROM fine GROUP BY ALL) s
            FULL JOIN (SELECT status, count(*) AS n FROM panel GROUP BY ALL) p USING (status))
        UNION ALL SELECT 'coverage', 'OK', 'area and category pairs with one table', count(*) FILTER (t < 2) FROM (
          SELECT country, category, count(DISTINCT "table") AS t FROM panel GROUP BY ALL)
        UNION ALL SELECT 'trainability', 'OK', 'series with 24 consecutive observed months', count(*) FROM (SELECT {KEY} FROM (
          SELECT {KEY}, count(*) AS len FROM (SELECT {KEY}, date_diff('month', DATE '1970-01-01', bulletin_date) - row_number() OVER
            (PARTITION BY {KEY} ORDER BY bulletin_date) AS g FROM panel WHERE status = 'F') GROUP BY {KEY}, g) GROUP BY ALL HAVING max(len) >= 24)""",
)


@query("panel_audit", "G7 G8 G9", sql("SELECT dimension, severity, message, CAST(n AS BIGINT) AS n FROM findings", "findings"))
def _audit(spark, sf):
    return AU.audit(area_panel(spark, sf), fine_cells(spark, sf))


@query(
    "audit_verdict",
    "G7",
    sql(
        """SELECT count(*) FILTER (severity = 'CRIT') AS crit, count(*) FILTER (severity = 'WARN') AS warn, count(*) FILTER (severity = 'INFO') AS info,
             CASE WHEN count(*) FILTER (severity = 'CRIT') > 0 THEN 'needs attention' ELSE 'fit' END AS verdict FROM findings""",
        "findings",
    ),
)
def _verdict(spark, sf):
    return AU.verdict(AU.audit(area_panel(spark, sf), fine_cells(spark, sf)))
