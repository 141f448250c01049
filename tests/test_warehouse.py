"""Contracts reject bad rows, views are lossless, publishing is all or nothing."""

import datetime as dt

import pytest
from frames import PANEL_SCHEMA, panel_frame, panel_rows
from pyspark.sql import functions as F

from panelspark.config import PANEL_KEY
from panelspark.operators import audit as AU
from panelspark.operators import warehouse as W
from panelspark.sources import sinks


def counts(df, contract):
    return {r["rule"]: r["n"] for r in W.validate(df, contract).collect()}


BAD = {
    "status_domain": ("X", None, None),
    "pdate_iff_f": ("F", None, 9000),
    "days_iff_f": ("C", None, 9000),
    "days_is_datediff": ("F", dt.date(2000, 1, 1), 1),
    "days_not_negative": ("F", dt.date(1974, 12, 31), -1),
}


@pytest.mark.parametrize("rule", sorted(BAD))
def test_bad_row_is_counted(spark, rule):
    status, date, days = BAD[rule]
    row = ("mexico", "family", "F1", "FAD", dt.date(2030, 1, 1), status, date, days, "x")
    df = spark.createDataFrame([*panel_rows(), row], PANEL_SCHEMA)
    contract = W.Contract(checks=W.priority_checks(), keys={"key": tuple(PANEL_KEY)})
    assert counts(df, contract)[rule] == 1
    with pytest.raises(W.ContractError):
        W.enforce(df, contract, "panel")


def test_duplicate_key_and_lost_reference(spark):
    df = spark.createDataFrame([*panel_rows(), panel_rows()[0]], PANEL_SCHEMA)
    dim = df.select("country").distinct().filter("country <> 'mexico'")
    got = counts(df, W.Contract(keys={"key": tuple(PANEL_KEY)}, references={"area": ("country", dim, "country")}))
    assert got == {"key": 1, "area": 121}


def test_dimension_contracts(spark):
    cat = spark.createDataFrame([(1, "family", "F1", 6), (2, "other", "X", 1)], "category_id int, block string, code string, preference_level int")
    assert counts(cat, W.category_contract()) == {"block_domain": 1, "preference_range": 1, "category_natural_key": 0}
    date = spark.createDataFrame([(dt.date(2000, 1, 1), 13, 5)], "bulletin_date date, month int, quarter int")
    assert counts(date, W.date_contract())["month_range"] == 1
    alias = spark.createDataFrame(
        [(1, "a", dt.date(2001, 1, 1), dt.date(2000, 1, 1), 0), (9, "b", dt.date(2000, 1, 1), dt.date(2000, 2, 1), 5)],
        "category_id int, raw_label string, valid_from date, valid_to date, n_months int",
    )
    got = counts(alias, W.alias_contract(cat))
    # Row one runs backward with no months (0 <= -11 fails as well); row two claims five months in a span of two.
    assert got == {"valid_order": 1, "months_positive": 1, "months_within_span": 2, "alias_natural_key": 0, "alias_category_fk": 1}
    record = spark.createDataFrame([(1.5, "degraded", None)], "pct_trainable double, build_status string, degradations string")
    assert counts(record, W.record_contract()) == {"pct_range": 1, "build_status_domain": 0, "degraded_iff_reasons": 1}


def test_build_publish_and_guard(spark, tmp_path):
    panel = panel_frame(spark)
    raw = panel.withColumn("raw_category", F.col("category"))
    with pytest.raises(W.ContractError):
        W.build_warehouse(panel, None, raw)
    star = W.build_warehouse(panel, None, raw, allow_degraded=True)
    record = star["etl_run"].first()
    assert record["build_status"] == "degraded" and record["degradations"] == "dv_missing, source_lineage_missing"
    view = W.panel_view(star["fact_priority"], star)
    assert view.exceptAll(panel.select(*view.columns)).count() == 0 and view.count() == panel.count()
    root = str(tmp_path / "wh")
    first = sinks.publish(star, root)
    assert sinks.open_warehouse(spark, root, panel)["fact_priority"].count() == panel.count()
    broken = W.Star({**star.tables, "etl_run": star["etl_run"].select(F.expr("raise_error('stop')").alias("x"))})
    with pytest.raises(Exception, match="stop"):
        sinks.publish(broken, root)
    assert sinks.current_version(spark, root) == first
    newer = spark.createDataFrame([*panel_rows(), ("mexico", "family", "F1", "FAD", dt.date(2030, 1, 1), "C", None, None, "C")], PANEL_SCHEMA)
    with pytest.raises(W.ContractError):
        sinks.open_warehouse(spark, root, newer)


def test_carry_forward(spark):
    panel = W.fact_sha(panel_frame(spark))
    key = PANEL_KEY
    ceiling = F.lit(dt.date(2012, 6, 1))
    first = W.carry_forward(panel, None, key, ceiling)
    assert first.filter("created_at <> updated_at").count() == 0
    prev = panel.withColumn("updated_at", F.lit(dt.date(2012, 1, 1))).withColumn(
        "content_sha", F.when(F.col("bulletin_date") == F.lit(dt.date(2010, 3, 1)), "old").otherwise(F.col("content_sha"))
    ).filter("bulletin_date < '2011-01-01'")
    got = {(r["bulletin_date"], r["updated_at"]) for r in W.carry_forward(panel, prev, key, ceiling).select("bulletin_date", "updated_at").distinct().collect()}
    assert (dt.date(2010, 3, 1), dt.date(2012, 6, 1)) in got
    assert (dt.date(2010, 4, 1), dt.date(2012, 1, 1)) in got
    assert (dt.date(2011, 5, 1), dt.date(2011, 5, 1)) in got


def test_ordered_ids_are_dense_ranks(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("slug")).repartition(7)
    got = W.ordered_ids(df, "i", "slug").orderBy("slug").select("i").collect()
    assert [r[0] for r in got] == list(range(1, 501))


def test_dedup_prefers_regime_and_reports_conflicts(spark):
    key = ("mexico", "family", "F1", "FAD", dt.date(2010, 1, 1))
    rows = [
        (*key, "U", None, None, "U"),
        (*key, "F", dt.date(2000, 1, 1), 9131, "01JAN00"),
        (*key, "C", None, None, "C"),
    ]
    df = spark.createDataFrame(rows, PANEL_SCHEMA)
    assert [r["status"] for r in AU.dedup_regime(df, strict=True).collect()] == ["F"]
    twice = spark.createDataFrame([*rows, (*key, "F", dt.date(2000, 2, 1), 9162, "01FEB00")], PANEL_SCHEMA)
    with pytest.raises(W.ContractError):
        AU.dedup_regime(twice, strict=True)


def test_ingestion_gate(spark):
    panel = panel_frame(spark)
    assert AU.month_coverage(panel, min_rows=8).count() == 0
    late = panel.filter("NOT (bulletin_date = '2012-06-01' AND block = 'family' AND table = 'DFF')")
    got = {(r["problem"], r["detail"]) for r in AU.month_coverage(late, min_rows=7).collect()}
    assert got == {("missing combination", "family/DFF"), ("too few rows", "6")}
