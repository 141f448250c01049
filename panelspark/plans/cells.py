"""Classifiers, scalar projections and the panel itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import PANEL_KEY
from panelspark.functions import cells as C
from panelspark.functions import hashing as H
from panelspark.functions import rules
from panelspark.operators import aggregates as A
from panelspark.operators import labelling as LB
from panelspark.operators import series as S
from panelspark.operators import setops as SO
from panelspark.operators import warehouse as W
from panelspark.plans.ctes import KEY, sql
from panelspark.plans.ctes import W as WIN
from panelspark.plans.protocol import SHORT
from panelspark.plans.registry import query
from panelspark.session import stage
from panelspark.sources.tables import (
    area_panel,
    observed,
    order_cells,
    published,
    rank_cells,
    rank_panel,
    supplier_panel,
    table,
)

KEY5 = 'country, block, category, "table", bulletin_date'


@query(
    "area_panel",
    "P1 P2 P5 P6 P9",
    sql(f"SELECT {KEY5}, status, priority_date, CAST(days_since_base AS DOUBLE) AS days_since_base, raw_value FROM panel", "panel"),
)
def _area_panel(spark, sf):
    return area_panel(spark, sf).withColumn("days_since_base", F.col("days_since_base").cast("double"))


@query(
    "supplier_panel",
    "P9",
    sql(f"SELECT {KEY5}, status, priority_date, CAST(days_since_base AS DOUBLE) AS days_since_base FROM sup", "sup"),
)
def _supplier_panel(spark, sf):
    return supplier_panel(spark, sf).drop("raw_value").withColumn(
        "days_since_base", F.col("days_since_base").cast("double")
    )


@query(
    "rank_cells",
    "P3 P7",
    sql("SELECT region, bulletin_date, status, CAST(rank_cutoff AS DOUBLE) AS rank_cutoff, raw_value, exceptions FROM ranks", "ranks"),
)
def _ranks(spark, sf):
    return rank_panel(spark, sf).withColumn("rank_cutoff", F.col("rank_cutoff").cast("double"))


@query(
    "normalised_labels",
    "P4",
    """SELECT label, count(*) AS n, CAST(sum(length(raw)) AS BIGINT) AS n_chars FROM (
         SELECT lower(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g'))) AS label, text AS raw
         FROM conversations) GROUP BY ALL""",
)
def _labels(spark, sf):
    text = table(spark, sf, "conversations").select(C.norm_label(F.col("text")).alias("label"), F.length("text").alias("_n"))
    return text.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("n_chars"))


@query(
    "category_labels",
    "P5 P6 A3",
    sql(
        """SELECT block, category AS code, trim(regexp_replace(raw_category, '\\s+', ' ', 'g')) AS raw_label,
              min(bulletin_date) AS valid_from, max(bulletin_date) AS valid_to, count(DISTINCT bulletin_date) AS n_months
            FROM panel GROUP BY ALL""",
        "panel",
    ),
)
def _alias(spark, sf):
    raw = published(order_cells(spark, sf)).withColumn(
        "category", rules.panel_category(F.col("block"), F.col("raw_category"))
    )
    return A.alias_bridge(raw)


#: Two versions of the rule sets; the second is coarser.
RULE_BOOK = {
    ("v1", "employment"): rules.EMPLOYMENT_RULES,
    ("v1", "family"): rules.FAMILY_RULES,
    ("v1", "region"): rules.REGION_RULES,
    ("v2", "employment"): (rules.Rule("TOP", "equals", ("1st", "2nd")), rules.Rule("OTHER", "contains", ("relig",), "workers")),
    ("v2", "family"): (rules.Rule("FIRST", "equals", ("1st", "f1")), rules.Rule("REST", "prefix", ("2",))),
}


@query(
    "labels_by_rule_table",
    "P5 P6 P7",
    sql(
        """SELECT block, 'v1' AS version, CASE block WHEN 'family' THEN substr(category, 2) ELSE category END AS code, count(*) AS n FROM panel GROUP BY ALL
           UNION ALL SELECT block, 'v2', CASE category WHEN 'EB1' THEN 'TOP' WHEN 'EB2' THEN 'TOP' WHEN 'EB4_RW' THEN 'OTHER' WHEN 'F1' THEN 'FIRST' ELSE 'REST' END, count(*)
           FROM panel GROUP BY ALL
           UNION ALL SELECT 'region', 'v1', region, count(*) FROM ranks GROUP BY ALL UNION ALL SELECT 'region', 'v2', NULL, count(*) FROM ranks""",
        "panel",
        "ranks",
    ),
)
def _by_rule_table(spark, sf):
    """Labels under both versions of the rules, which are read from a stored table."""
    book = LB.read_rules(stage(LB.rule_rows(spark, RULE_BOOK), "rules"))
    cells = published(order_cells(spark, sf)).select("block", F.col("raw_category").alias("label"))
    labels = cells.unionByName(rank_cells(spark, sf).select(F.lit("region").alias("block"), "label"))
    clean = F.when(F.col("block") == "region", C.norm_label(F.col("label"))).otherwise(C.strip_footnotes(C.norm_label(F.col("label"))))
    versions = F.array(*[F.struct(F.lit(v).alias("version"), LB.coded(clean, F.col("block"), v, book).alias("code")) for v in ("v1", "v2")])
    return labels.select("block", F.inline(versions)).groupBy("block", "version", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "wait_times",
    "P8 P10",
    sql(
        f"""SELECT {KEY5}, round(date_diff('day', priority_date, bulletin_date) / 365.25, 6) AS wait_years,
              round(1975 + days_since_base / 365.25, 6) AS priority_year FROM panel WHERE status = 'F'""",
        "panel",
    ),
)
def _wait(spark, sf):
    f = area_panel(spark, sf).filter(F.col("status") == "F")
    return f.select(
        *PANEL_KEY,
        F.round(C.wait_years(F.col("bulletin_date"), F.col("priority_date")), 6).alias("wait_years"),
        F.round(C.days_to_year(F.col("days_since_base")), 6).alias("priority_year"),
    )


@query(
    "calendar_dimension",
    "P11 P12 U4",
    sql(
        """SELECT bulletin_date, CAST(year(bulletin_date) AS INTEGER) AS "year", CAST(month(bulletin_date) AS INTEGER) AS "month",
              CAST(quarter(bulletin_date) AS INTEGER) AS "quarter",
              CAST(year(bulletin_date) + CASE WHEN month(bulletin_date) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS us_fiscal_year,
              round(sin(2 * pi() * month(bulletin_date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(bulletin_date) / 12), 6) AS month_cos,
              round(sin(2 * pi() * ((month(bulletin_date) + 2) % 12) / 12), 6) AS fiscal_sin,
              round(cos(2 * pi() * ((month(bulletin_date) + 2) % 12) / 12), 6) AS fiscal_cos
            FROM (SELECT bulletin_date FROM panel UNION SELECT bulletin_date FROM ranks)""",
        "panel",
        "ranks",
    ),
)
def _calendar(spark, sf):
    months = SO.month_domain(area_panel(spark, sf), rank_panel(spark, sf))
    return W.calendar_columns(months).withColumns(
        {n: F.round(c, 6) for n, c in C.calendar_features(F.col("bulletin_date")).items()}
    )


@query(
    "row_hashes",
    "P13",
    sql(
        f"""SELECT {KEY5},
              sha256(concat_ws('|', status, coalesce(CAST(priority_date AS VARCHAR), chr(0)),
                     coalesce(CAST(days_since_base AS VARCHAR), chr(0)), raw_value)) AS content_sha,
              substr(sha1(concat_ws('|', country, category, "table", CAST(bulletin_date AS VARCHAR))), 1, 12) AS row_id,
              coalesce(CAST(days_since_base AS VARCHAR), '') AS days_text FROM panel""",
        "panel",
    ),
)
def _hashes(spark, sf):
    c = F.col
    return area_panel(spark, sf).select(
        *PANEL_KEY,
        H.content_sha(c("status"), c("priority_date"), c("days_since_base"), c("raw_value")).alias("content_sha"),
        H.short_sha1(c("country"), c("category"), c("table"), c("bulletin_date").cast("string")).alias("row_id"),
        H.canonical_number(c("days_since_base").cast("double")).alias("days_text"),
    )


@query(
    "signed_log_steps",
    "P14",
    sql(
        f"""SELECT {KEY}, m AS bulletin_date, round(sign(d) * ln(1 + abs(d)), 6) AS signed_log
            FROM (SELECT *, y - lag(y) OVER ({WIN}) AS d FROM fs) WHERE d IS NOT NULL""",
        "fs",
    ),
)
def _slog(spark, sf):
    d = S.difference(observed(supplier_panel(spark, sf))).filter(F.col("delta").isNotNull())
    return d.select(*PANEL_KEY, F.round(C.signed_log(F.col("delta")), 6).alias("signed_log"))


@query(
    "series_catalogue",
    "P16",
    sql(
        f"""SELECT {KEY}, count(*) AS n_obs, count(*) FILTER (status = 'F') AS n_trainable, min(bulletin_date) AS first_month,
              max(bulletin_date) AS last_month, count(DISTINCT status) AS n_regimes
            FROM panel WHERE "table" = 'FAD' AND block = 'family' GROUP BY ALL HAVING count(*) FILTER (status = 'F') >= 24""",
        "panel",
    ),
)
def _catalogue(spark, sf):
    return A.list_series(area_panel(spark, sf), table="FAD", block="family", min_trainable=24)


@query(
    "evaluable_series",
    "P16",
    sql(
        f"""SELECT {KEY}, count(*) AS n_trainable, CAST(date_diff('month', min(m), max(m)) + 1 AS INTEGER) AS span_months
            FROM fs GROUP BY ALL HAVING count(*) >= 48 AND date_diff('month', min(m), max(m)) + 1
              >= CASE "table" WHEN 'FAD' THEN 36 ELSE 24 END + 30""",
        "fs",
    ),
)
def _evaluable(spark, sf):
    return A.evaluable_series(observed(supplier_panel(spark, sf)), SHORT)


@query(
    "series_uid_split",
    "P17",
    sql(
        """SELECT country || '/' || block || '/' || category AS uid, country, block, category, count(*) AS n_rows
           FROM sup GROUP BY ALL""",
        "sup",
    ),
)
def _uid(spark, sf):
    uid = supplier_panel(spark, sf).groupBy(
        C.series_uid(F.col("country"), F.col("block"), F.col("category")).alias("uid")
    ).agg(F.count(F.lit(1)).alias("n_rows"))
    return uid.select("uid", "n_rows", *[c.alias(n) for n, c in C.split_uid(F.col("uid")).items()])


@query(
    "regime_encoding",
    "P18",
    sql(
        f"""SELECT {KEY5}, CAST(CASE status WHEN 'F' THEN days_since_base
              WHEN 'C' THEN date_diff('day', DATE '1975-01-01', bulletin_date) END AS DOUBLE) AS level FROM panel""",
        "panel",
    ),
)
def _encode(spark, sf):
    level = C.encode_regime(F.col("status"), F.col("days_since_base"), F.col("bulletin_date"))
    return area_panel(spark, sf).select(*PANEL_KEY, level.alias("level"))
