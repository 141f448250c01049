"""Plans that must hold on many partitions: no shuffle on a key of two values, few scans, all partitions at work."""

import re

import pytest

from panelspark.plans import ledger as P
from panelspark.plans.protocol import obs
from panelspark.sources.tables import observed, supplier_panel


@pytest.fixture
def many(spark):
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("recipe", [P.CHAMPION, P.V.recipes(("naive1", "drift"), "mean")])
def test_vintages_use_all_partitions(many, recipe, sf):
    rows = P.vintage_rows(P.observed_once(many, sf), recipe, coherent=False)
    text = plan(rows)
    assert not re.search(r"hashpartitioning\(table#\d+(L)?, \d+\)", text)
    assert rows.select("origin", "country").rdd.getNumPartitions() == 64
    assert rows.select("country", "block", "category", "table").distinct().count() > 2


def test_scorecard_scans_little(many, sf):
    text = plan(P.score(many, sf))
    assert text.split("== Initial Plan ==")[0].count("FileScan") <= 3
    assert not re.search(r"hashpartitioning\(table#\d+(L)?, \d+\)", text)


def test_panel_is_one_scan(many, sf):
    assert observed(supplier_panel(many, sf)).columns == obs(many, sf).columns
