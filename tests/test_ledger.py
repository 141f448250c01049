"""Ledger identity, keep-first append, validation, completeness and scoring."""

import datetime as dt

import pytest
from frames import obs_frame
from pyspark.sql import functions as F

from panelspark.config import SERIES, Protocol
from panelspark.operators import governance as G
from panelspark.operators import ledger as L
from panelspark.operators import vintage as V
from panelspark.sources import sinks

SHORT = Protocol(min_train={"FAD": 24, "DFF": 24}, holdout=12, min_f=24)


def stamped(spark, frozen="2007-01-01", **kw):
    obs = obs_frame(spark, gaps=False)
    origins = obs.filter("bulletin_date IN ('2006-01-01', '2006-06-01')").select("bulletin_date")
    rows = V.vintages(obs, origins, protocol=SHORT, coherent=False)
    return L.stamp(rows, F.lit("m"), F.col("origin"), frozen, **kw)


def problems(df):
    return {r["rule"]: r["n"] for r in L.validate_ledger(df).collect() if r["n"]}


def test_clean_ledger_validates(spark):
    assert problems(stamped(spark)) == {}


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        (lambda d: d.withColumn("days", F.col("days") + 1), "row_hash_mismatch"),
        (lambda d: d.withColumn("model_version", F.lit("other")), "forecast_id_mismatch"),
        (lambda d: d.withColumn("frozen_at", F.lit(None).cast("string")), "null_frozen_at"),
        (lambda d: d.withColumn("freeze_panel_vintage", F.lit("2030-01")), "live_already_published"),
        (lambda d: d.unionByName(d), "duplicate_key"),
    ],
)
def test_violations(spark, change, rule):
    rows = stamped(spark)
    assert problems(change(rows))[rule] == rows.count()


def test_integral_floats_hash_like_integers(spark):
    rows = stamped(spark)
    floats = rows.withColumns({c: F.col(c).cast("double") for c in ("days", "lo80", "hi95")})
    assert problems(floats) == {}


def test_backfill_is_never_live(spark):
    modes = stamped(spark, backfill=F.col("origin") == "2006-01").select("origin", "evaluation_mode").distinct().collect()
    assert {tuple(r) for r in modes} == {("2006-01", "backfill"), ("2006-06", "live")}


def test_append_is_idempotent(spark, tmp_path):
    rows = stamped(spark)
    path = str(tmp_path / "ledger")
    assert sinks.append_ledger(rows.filter("origin = '2006-01'"), path, "1") > 0
    changed = rows.withColumn("days", F.col("days") + 99)
    n = sinks.append_ledger(changed, path, "2")
    assert sinks.append_ledger(changed, path, "2") == n  # the same batch again
    stored = sinks.read_ledger(spark, path)
    assert stored.count() == rows.count()
    kept = stored.filter("origin = '2006-01'").select("forecast_id", "days").exceptAll(rows.select("forecast_id", "days"))
    assert kept.count() == 0


def test_completeness_rules(spark):
    exp = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    got = spark.createDataFrame([("a",), ("z",)], "k string")
    allow = spark.createDataFrame([("b", "2030-01", "known"), ("c", "2010-01", "known"), ("d", "2030-01", "  ")], "k string, expires string, reason string")
    out = {r["k"]: r["problem"] for r in L.completeness(exp, got, ["k"], allow, "2026-01").collect()}
    assert out == {"b": "excused", "c": "missing", "d": "missing", "z": "extra"}
    bad = spark.createDataFrame(
        [("a", "never", "x"), ("b", "2026-13", "x"), ("c", "2029-01", "x"), ("d", "2026-07", ""), ("e", "2026-7", "x"), ("f", "2027-12", "x")],
        "k string, expires string, reason string",
    )
    out = {r["k"]: r["problem"] for r in L.allowlist_problems(bad, ["k"], "2026-01").collect()}
    assert out == {"a": "invalid expiry", "b": "invalid expiry", "c": "expiry too far", "d": "no reason", "e": "invalid expiry"}


def pairs(spark, n_series=12, shadow=0.5, mode="live", vintages=("2006-01", "2006-02", "2006-03"), in95=1):
    rows = []
    for v in vintages:
        for s in range(n_series):
            for h in range(1, 13):
                err = 1.0 + 0.01 * s + 0.001 * h
                rows.append((v, f"a{s}", "family", "F1", "FAD", dt.date(2007, h, 1), h, 100.0 + s, 90.0, 95.0, err, err * shadow, 1, in95, mode, mode))
    return spark.createDataFrame(
        rows,
        "origin string, country string, block string, category string, `table` string, target date, h int, actual_champ double, "
        "pred_champ double, pred_shadow double, scaled_err_champ double, scaled_err_shadow double, in95_champ int, in95_shadow int, "
        "evaluation_mode_champ string, evaluation_mode_shadow string",
    )


@pytest.mark.parametrize(
    ("kw", "decision"),
    [
        ({}, "promote"),
        ({"shadow": 0.95}, "retain"),  # better, but not by a material margin
        ({"shadow": 1.5}, "reject"),
        ({"in95": 0}, "retain"),  # coverage outside policy
        ({"mode": "backfill"}, "extend-shadow"),
        ({"vintages": ("2006-01",)}, "extend-shadow"),
        ({"n_series": 2}, "extend-shadow"),
    ],
)
def test_promotion_gate(spark, kw, decision):
    row = G.decide(pairs(spark, **kw)).first()
    assert row["decision"] == decision, row


def test_copies_of_the_world_do_not_add_evidence(spark):
    one = pairs(spark, n_series=1).withColumn("country", F.lit("all_chargeability"))
    copy = one.withColumn("country", F.lit("b"))
    own = pairs(spark, n_series=2).filter("country = 'a1'")
    kept = G.dedup_pairs(one.unionByName(copy).unionByName(own)).select("country").distinct().collect()
    assert {r[0] for r in kept} == {"all_chargeability", "a1"}


def test_seed_gate(spark):
    rows = [("a", "f", "F1", "FAD", f"s{i}", 0.1 * i) for i in (1, 2, 3)]
    schema = "country string, block string, category string, `table` string, variant string, hold_mase double"
    runs = spark.createDataFrame(rows, schema)
    out = G.aggregate_seeds(runs, ["s1", "s2", "s3"]).first()
    assert out["n_seeds"] == 3 and abs(out["mean"] - 0.2) < 1e-12 and abs(out["hi"] - 0.2 - 4.302652729911275 * 0.1 / 3**0.5) < 1e-9
    for bad in (
        rows[:2],
        [*rows, ("b", "f", "F1", "FAD", "s1", 0.1)],
        [*rows[:2], ("a", "f", "F1", "FAD", "s3", float("nan"))],
        [*rows, ("a", "f", "F1", "FAD", "s4", 0.1)],
    ):
        with pytest.raises(G.SeedError):
            G.aggregate_seeds(spark.createDataFrame(bad, schema), ["s1", "s2", "s3"])


def test_scorecard_modes_never_pool(spark):
    obs = obs_frame(spark, gaps=False)
    card = L.scorecard(stamped(spark, backfill=F.col("origin") == "2006-01"), obs)
    summary = G.score_summary_ci(card)
    assert summary.filter("evaluation_mode IS NULL").count() == 0
    total = summary.filter("h IS NULL AND `table` IS NULL AND origin IS NULL")
    assert {r["evaluation_mode"] for r in total.collect()} == {"backfill", "live"}
    assert summary.filter("cov95_ci_lo > cov95 OR cov95_ci_hi < cov95").count() == 0
    assert card.select(*SERIES).distinct().count() == 3
