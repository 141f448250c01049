"""Star schema queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import PANEL_KEY
from panelspark.functions.hashing import table_fingerprint
from panelspark.operators import aggregates as A
from panelspark.operators import setops as SO
from panelspark.operators import warehouse as W
from panelspark.plans.ctes import register, sql
from panelspark.plans.registry import query
from panelspark.session import stage
from panelspark.sources.tables import annotate, area_panel, order_cells, published, rank_panel

KEY5 = 'country, block, category, "table", bulletin_date'

register(
    "darea",
    ("panel",),
    """SELECT CAST(row_number() OVER (ORDER BY slug) AS INTEGER) AS area_id, slug,
         CASE WHEN slug = 'all_chargeability' THEN 'All Chargeability Areas Except Those Listed' ELSE slug END AS name,
         slug = 'all_chargeability' AS is_residual_group FROM (SELECT DISTINCT country AS slug FROM panel)""",
)
register(
    "dcat",
    ("panel",),
    """SELECT CAST(row_number() OVER (ORDER BY block, category) AS INTEGER) AS category_id, block, category AS code,
         CASE category WHEN 'EB4_RW' THEN 'EB4' WHEN 'F2A' THEN 'F2' END AS parent_code,
         CAST(CASE category WHEN 'EB4_RW' THEN 4 WHEN 'EB2' THEN 2 WHEN 'F2A' THEN 2 ELSE 1 END AS INTEGER) AS preference_level,
         category IN ('EB4_RW', 'F2A') AS is_subcategory,
         CASE category WHEN 'EB1' THEN 'INA 203(b)(1)' WHEN 'EB2' THEN 'INA 203(b)(2)' WHEN 'EB4_RW' THEN 'INA 203(b)(4)'
              WHEN 'F1' THEN 'INA 203(a)(1)' ELSE 'INA 203(a)(2)(A)' END AS ina_basis
       FROM (SELECT DISTINCT block, category FROM panel)""",
)
register(
    "ddate",
    ("panel", "ranks"),
    """SELECT CAST(row_number() OVER (ORDER BY bulletin_date) AS INTEGER) AS date_id, bulletin_date
       FROM (SELECT bulletin_date FROM panel UNION SELECT bulletin_date FROM ranks)""",
)


@query("dim_area", "G1", sql("SELECT * FROM darea", "darea"))
def _dim_area(spark, sf):
    return W.dim_area(area_panel(spark, sf))


@query("dim_category", "G1", sql("SELECT * FROM dcat", "dcat"))
def _dim_category(spark, sf):
    return W.dim_category(area_panel(spark, sf))


@query(
    "keyed_facts",
    "J1 G1",
    sql(
        """SELECT area_id, category_id, CAST(CASE "table" WHEN 'DFF' THEN 1 ELSE 2 END AS INTEGER) AS table_id, date_id, status,
             priority_date, CAST(days_since_base AS DOUBLE) AS days_since_base, raw_value
           FROM panel p JOIN darea ON slug = country JOIN dcat c ON c.block = p.block AND c.code = p.category
             JOIN ddate USING (bulletin_date)""",
        "darea",
        "dcat",
        "ddate",
    ),
)
def _keyed(spark, sf):
    panel = stage(area_panel(spark, sf), "panel")
    star = W.build_dims(panel, rank_panel(spark, sf))
    return W.key_facts(panel, star).withColumn("days_since_base", F.col("days_since_base").cast("double"))


@query(
    "panel_view",
    "J2",
    sql(f"SELECT {KEY5}, status, priority_date, CAST(days_since_base AS DOUBLE) AS days_since_base, raw_value FROM panel", "panel"),
)
def _panel_view(spark, sf):
    panel = stage(area_panel(spark, sf), "panel")
    star = W.build_dims(panel)
    view = W.panel_view(W.key_facts(panel, star, check=False), star)
    return view.withColumn("days_since_base", F.col("days_since_base").cast("double"))


@query(
    "rank_view",
    "J2",
    sql("SELECT region, bulletin_date, status, CAST(rank_cutoff AS DOUBLE) AS rank_cutoff, raw_value, exceptions FROM ranks", "ranks"),
)
def _rank_view(spark, sf):
    ranks = rank_panel(spark, sf)
    star = W.Star({"dim_region": W.dim_region(ranks), "dim_date": W.dim_date(ranks)})
    return W.rank_view(W.key_ranks(ranks, star), star).withColumn("rank_cutoff", F.col("rank_cutoff").cast("double"))


@query(
    "training_mart",
    "J3",
    sql(
        f"""SELECT {KEY5}, CAST(year(bulletin_date) AS INTEGER) AS "year", CAST(month(bulletin_date) AS INTEGER) AS "month",
              CAST(quarter(bulletin_date) AS INTEGER) AS "quarter",
              CAST(CASE category WHEN 'EB4_RW' THEN 4 WHEN 'EB2' THEN 2 WHEN 'F2A' THEN 2 ELSE 1 END AS INTEGER) AS preference_level,
              priority_date, days_since_base FROM panel WHERE status = 'F'""",
        "panel",
    ),
)
def _mart(spark, sf):
    panel = stage(area_panel(spark, sf), "panel")
    star = W.build_dims(panel)
    return W.training_mart(W.key_facts(panel, star, check=False), star)


@query(
    "rollup_preference",
    "A2",
    sql(
        """SELECT p.block, preference_level, count(*) AS n_obs FROM panel p JOIN dcat c ON c.block = p.block AND c.code = category
           WHERE status = 'F' GROUP BY ALL""",
        "panel",
        "dcat",
    ),
)
def _rollup(spark, sf):
    panel = stage(area_panel(spark, sf), "panel")
    star = W.Star({"dim_category": W.dim_category(panel)})
    fact = panel.join(
        star["dim_category"].select("category_id", "block", F.col("code").alias("category")), ["block", "category"]
    )
    return W.rollup_preference(fact, star["dim_category"])


@query(
    "rollup_levels",
    "A2",
    sql(
        """SELECT p.block, preference_level, code, count(*) AS n_obs, grouping(p.block, preference_level, code) AS depth
           FROM panel p JOIN dcat c ON c.block = p.block AND c.code = category
           WHERE status = 'F' GROUP BY ROLLUP (p.block, preference_level, code)""",
        "panel",
        "dcat",
    ),
)
def _rollup_levels(spark, sf):
    panel = stage(area_panel(spark, sf), "panel")
    dim = W.dim_category(panel)
    fact = panel.join(dim.select("category_id", "block", F.col("code").alias("category")), ["block", "category"])
    return W.rollup_levels(fact, dim)


@query(
    "fact_counts",
    "U2",
    sql(
        """SELECT 'fact_priority' AS fact, count(*) AS n_rows FROM panel
           UNION ALL SELECT 'fact_dv_rank', count(*) FROM ranks""",
        "panel",
        "ranks",
    ),
)
def _counts(spark, sf):
    return SO.fact_counts(fact_priority=area_panel(spark, sf), fact_dv_rank=rank_panel(spark, sf))


# The previous build is the panel before 2001 with one cell in ten rewritten.
register(
    "prevstate",
    ("panel",),
    f"""SELECT {KEY5}, days_since_base IS NULL OR days_since_base % 10 <> 0 AS same,
               CASE WHEN month(bulletin_date) = 3 THEN CAST(bulletin_date + INTERVAL 2 MONTH AS DATE) ELSE bulletin_date END AS upd
        FROM panel WHERE bulletin_date < DATE '2001-01-01'""",
)


def previous_state(panel):
    changed = F.coalesce(F.col("days_since_base") % 10 == 0, F.lit(False))
    return (
        W.fact_sha(panel.filter(F.col("bulletin_date") < F.lit("2001-01-01").cast("date")))
        .withColumn("content_sha", F.when(changed, F.lit("rewritten")).otherwise(F.col("content_sha")))
        .withColumn(
            "updated_at",
            F.when(F.month("bulletin_date") == 3, F.add_months("bulletin_date", 2)).otherwise(F.col("bulletin_date")),
        )
    )


@query(
    "carry_forward",
    "J4 G3",
    sql(
        f"""SELECT {KEY5}, bulletin_date AS created_at,
              greatest(CASE WHEN same IS NULL THEN bulletin_date WHEN same THEN upd
                            ELSE (SELECT max(bulletin_date) FROM panel) END, bulletin_date) AS updated_at
            FROM panel LEFT JOIN prevstate USING ({KEY5})""",
        "prevstate",
    ),
)
def _carry(spark, sf):
    panel = area_panel(spark, sf)
    ceiling = panel.agg(F.max("bulletin_date")).scalar()
    out = W.carry_forward(W.fact_sha(panel), previous_state(panel), PANEL_KEY, ceiling)
    return out.select(*PANEL_KEY, "created_at", "updated_at")


@query(
    "series_summary",
    "A1",
    sql(
        f"""SELECT country, block, category, "table", count(*) AS n_obs, count(*) FILTER (status = 'F') AS n_trainable,
              min(bulletin_date) AS first_month, max(bulletin_date) AS last_month, count(DISTINCT status) AS n_regimes,
              max(greatest(CASE WHEN same IS NULL THEN bulletin_date WHEN same THEN upd
                  ELSE (SELECT max(bulletin_date) FROM panel) END, bulletin_date)) AS last_modified_at
            FROM panel LEFT JOIN prevstate USING ({KEY5}) GROUP BY ALL""",
        "prevstate",
    ),
)
def _summary(spark, sf):
    panel = area_panel(spark, sf)
    ceiling = panel.agg(F.max("bulletin_date")).scalar()
    dated = W.carry_forward(W.fact_sha(panel), previous_state(panel), PANEL_KEY, ceiling)
    return A.series_summary(dated, "updated_at")


@query(
    "constraint_violations",
    "G2",
    sql(
        f"""SELECT 'status_domain' AS rule, 'check' AS kind, count(*) FILTER (status NOT IN ('F','C','U','UNK')) AS n FROM fine
            UNION ALL SELECT 'days_iff_f', 'check', count(*) FILTER ((status = 'F') <> (days_since_base IS NOT NULL)) FROM fine
            UNION ALL SELECT 'pdate_iff_f', 'check', count(*) FILTER ((status = 'F') <> (priority_date IS NOT NULL)) FROM fine
            UNION ALL SELECT 'days_not_negative', 'check', count(*) FILTER (days_since_base < 0) FROM fine
            UNION ALL SELECT 'days_is_datediff', 'check',
                      count(*) FILTER (days_since_base <> date_diff('day', DATE '1975-01-01', priority_date)) FROM fine
            UNION ALL SELECT 'panel_key', 'unique', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM fine GROUP BY {KEY5})
            UNION ALL SELECT 'month_fk', 'reference', count(*) FROM fine WHERE bulletin_date NOT IN
                      (SELECT bulletin_date FROM ranks WHERE status = 'F')""",
        "fine",
        "ranks",
    ),
)
def _violations(spark, sf):
    fine = annotate(published(order_cells(spark, sf, by_priority=True)))
    months = rank_panel(spark, sf).filter(F.col("status") == "F").select("bulletin_date").distinct()
    contract = W.Contract(
        checks=W.priority_checks(),
        keys={"panel_key": tuple(PANEL_KEY)},
        references={"month_fk": ("bulletin_date", months, "bulletin_date")},
    )
    return W.validate(fine, contract)


@query(
    "build_record",
    "G4",
    sql(
        """SELECT CAST(1 AS INTEGER) AS run_id, p.*, r.n_fact_dv, n_trainable_f / n_fact_priority AS pct_trainable,
             least(lo, rlo) AS panel_floor, greatest(hi, rhi) AS panel_ceiling, 'degraded' AS build_status,
             'source_lineage_missing' AS degradations
           FROM (SELECT count(*) AS n_fact_priority, count(*) FILTER (status = 'F') AS n_trainable_f FROM panel) p,
                (SELECT min(bulletin_date) AS lo, max(bulletin_date) AS hi FROM panel) q,
                (SELECT count(*) AS n_fact_dv FROM ranks) r,
                (SELECT min(bulletin_date) AS rlo, max(bulletin_date) AS rhi FROM ranks) s""",
        "panel",
        "ranks",
    ).replace("SELECT CAST(1 AS INTEGER) AS run_id, p.*, r.n_fact_dv,", "SELECT CAST(1 AS INTEGER) AS run_id, p.*, r.n_fact_dv,"),
)
def _record(spark, sf):
    return W.build_record(area_panel(spark, sf), rank_panel(spark, sf), ["source_lineage_missing"])


@query(
    "table_fingerprint",
    "G6",
    sql(
        """SELECT count(*) AS n_rows, sha256(concat_ws('|', count(*), CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT),
             CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS BIGINT), CAST(sum(CAST('0x' || substr(h, 17, 8) AS BIGINT)) AS BIGINT),
             CAST(sum(CAST('0x' || substr(h, 25, 8) AS BIGINT)) AS BIGINT))) AS fingerprint
           FROM (SELECT sha256(concat_ws('|', block, CAST(bulletin_date AS VARCHAR), category, country,
                   coalesce(CAST(days_since_base AS VARCHAR), chr(0)), raw_value, status, "table")) AS h FROM panel)""",
        "panel",
    ),
)
def _fingerprint(spark, sf):
    panel = area_panel(spark, sf)
    return table_fingerprint(
        panel, ["country", "block", "category", "table", "bulletin_date", "status", "days_since_base", "raw_value"]
    )
