"""Ledger rows stay where their area and category are dealt out, and find what they need there."""

import datetime as dt
import math
import random
import re

import pytest
from frames import month, obs_frame
from pyspark.sql import functions as F

from panelspark.operators import governance as G
from panelspark.operators import intervals as IV
from panelspark.operators import ledger as L
from panelspark.operators import metrics as ME
from panelspark.plans import load
from panelspark.sources import sinks

load()

from test_scale import P, many  # noqa: E402, F401

from panelspark.plans import streams  # noqa: E402

SEALED = {"model_version": "m", "evaluation_mode": "live"}


def shuffled(df):
    """Keys that rows are dealt out by, from the plan before it runs."""
    return {re.sub(r"#\d+L?", "", k) for k in re.findall(r"hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())}


PLACES = {"country, category", "bulletin_date"}


def test_scoring_deals_out_series_only(many, sf):  # noqa: F811
    assert shuffled(P.score(many, sf)) <= PLACES | {"l_suppkey, l_returnflag, l_linestatus, bulletin_date"}


def test_pairs_deal_out_series_only(many, sf):  # noqa: F811
    o = P.observed_once(many, sf)
    assert shuffled(L.pair_scorecards(P.score_of(o), P.score_of(o, P.V.recipes(("ets",), "mean")))) <= PLACES


def test_scale_before_equals_the_history(spark):
    """Rows at, between and far beyond observations, also of a series without any."""
    obs = obs_frame(spark, series=2, months=40)
    seen = {}
    for r in sorted(obs.collect(), key=lambda r: r["bulletin_date"]):
        seen.setdefault(r["country"], []).append((r["bulletin_date"], r["y"]))
    cuts = [month(i) for i in (-5, 0, 1, 2, 13, 20, 39, 40, 90)] + [dt.date(2001, 5, 17)]
    asked = [(c, "family", "F1", t, d) for c, t in (("a0", "DFF"), ("a1", "FAD"), ("a9", "FAD")) for d in cuts]
    rows = spark.createDataFrame(asked, "country string, block string, category string, `table` string, cutoff date")
    got = {(r["country"], r["cutoff"]): (r["n_history"], r["scale"]) for r in ME.with_scale_before(rows, obs, "cutoff").collect()}
    assert len(got) == len(asked)
    for country, _, _, _, cut in asked:
        y = [v for d, v in seen.get(country, []) if d < cut]
        lag = 12 if len(y) > 12 else 1
        steps = [abs(b - a) for a, b in zip(y, y[lag:])]
        want = sum(steps) / len(steps) if steps else None
        n, scale = got[country, cut]
        assert n == len(y) and ((scale is None and not want) or scale == pytest.approx(want))


def test_pairs_are_the_join(spark):
    key = dict(country="a", block="family", category="F1", table="FAD", target=dt.date(2006, 2, 1))
    rows = [("2006-01", 1, 1.0), ("2006-01", 2, 2.0), ("2006-02", 1, 3.0), ("2006-02", 1, 4.0)]

    def card(some, plus):
        shape = "origin string, h int, country string, block string, category string, `table` string, target date, pred double"
        df = spark.createDataFrame([(o, h, *key.values(), p + plus) for o, h, p in some], shape)
        more = {"actual": F.lit(0.0), "abs_err": F.lit(1.0), "scaled_err": F.lit(None).cast("double"), "in95": F.lit(1)}
        return df.withColumns(more | {k: F.lit(v) for k, v in SEALED.items()})

    out = L.pair_scorecards(card(rows, 0.0), card([rows[0], rows[2], ("2007-01", 1, 9.0)], 10.0))
    got = sorted(tuple(r) for r in out.select("origin", "h", "pred_champ", "pred_shadow").collect())
    assert got == [("2006-01", 1, 1.0, 11.0), ("2006-02", 1, 3.0, 13.0), ("2006-02", 1, 4.0, 13.0)]
    assert out.columns[: len(L.PAIR_KEY)] == L.PAIR_KEY and out.count() == 3


def test_append_and_validation_deal_out_series_only(many, sf):  # noqa: F811
    rows = P.ledger(many, sf)
    retry = rows.withColumn("days", F.col("days") + 1)
    assert shuffled(L.append_frozen(rows.filter(F.col("origin") < "2001-03"), retry.unionByName(retry))) <= PLACES
    assert shuffled(L.validate_ledger(rows.unionByName(rows))) <= PLACES


def test_new_rows_are_one_for_each_key_not_frozen(spark):
    shape = "origin string, country string, category string, `table` string, date date, frozen_at string, days int"
    row = lambda origin, country, at, days: (origin, country, "F1", "FAD", dt.date(2006, 5, 1), at, days)
    old = spark.createDataFrame([row("2006-01", "a", "1", 1), row("2006-01", None, "1", 1)], shape)
    new = spark.createDataFrame([row("2006-01", "a", "0", 9), row("2006-01", None, "2", 2), row("2006-02", "a", "3", 4), row("2006-02", "a", "2", 5)], shape)
    got = {tuple(r) for r in L.new_rows(old, new).collect()}
    assert got == {row("2006-01", None, "2", 2), row("2006-02", "a", "2", 5)}
    assert L.new_rows(None, new).count() == 3


def card_pairs(spark, rows):
    shape = (
        "origin string, country string, block string, category string, `table` string, target date, h int, actual_champ double, pred_champ double, "
        "pred_shadow double, evaluation_mode_champ string, evaluation_mode_shadow string, scaled_err_champ double, scaled_err_shadow double"
    )
    return spark.createDataFrame([(o, c, "family", "F1", "FAD", dt.date(2006, 1 + h, 1), h, a, p, p, *m, e, 2 * e) for o, c, h, a, p, m, e in rows], shape)


LIVE, MIXED = ("live", "live"), ("live", "backfill")


def test_a_copy_agrees_in_every_pair_and_has_no_others(spark):
    both = [("2006-01", h, 5.0, 7.0 + h) for h in (1, 2)]
    series = {"all_chargeability": both, "copy": both, "other": [both[0], ("2006-01", 2, 5.0, 1.0)], "less": both[:1], "more": [*both, ("2006-02", 1, 5.0, 8.0)]}
    rows = [(o, c, h, a, p, LIVE, 1.0) for c, some in series.items() for o, h, a, p in some]
    kept = G.dedup_pairs(card_pairs(spark, rows))
    assert sorted(r["country"] for r in kept.collect()) == sorted(r[1] for r in rows if r[1] != "copy")
    assert G.dedup_pairs(card_pairs(spark, rows).filter("country <> 'all_chargeability'")).count() == len(rows) - 2
    assert "collect_list" not in kept._jdf.queryExecution().executedPlan().toString()


def test_head_to_head_scores_its_pairs_once(spark):
    rows = [("2006-01", "a", h, 5.0, 6.0, m, e) for h, m, e in ((1, LIVE, 1.0), (1, LIVE, None), (1, LIVE, 2.0), (2, LIVE, 4.0), (2, MIXED, 9.0)) if e is not None]
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    pairs = card_pairs(spark, rows)
    out = L.head_to_head(pairs.mapInPandas(counted, pairs.schema))
    got = {(r["mode"], r["h"]): (r["n"], r["champion_mase"], r["shadow_mase"]) for r in out.collect()}
    assert got == {("live", 1): (2, 1.5, 3.0), ("live", 2): (1, 4.0, 8.0), ("live", None): (3, 2.333333, 4.666667), ("mixed", None): (1, None, None)}
    assert runs.value == len(rows)
    assert L.head_to_head(pairs.limit(0)).collect()[0]["n"] == 0


def test_a_table_is_replayed_as_it_lies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "shared_dir", lambda spark, name: str(tmp_path / name))
    stream = streams._staged_stream(spark, spark.range(0, 50, 1, 5), "replayed")
    assert len(list(tmp_path.glob("replayed/part-*.zstd.parquet"))) == 5 and stream.isStreaming


def test_whole_days_are_what_two_roundings_give(spark):
    odd = [0.5, 1.5, -0.5, -2.5, 2.4999996, 2.4999994, 2.5000004, 0.4999995, 1e-9, -1e-9, 0.0, -0.0, 7.99999999, 1.9e9 + 0.5, 3.49999, 3.50001, None]
    df = spark.createDataFrame([(x,) for x in odd + [i / 7 - 300 for i in range(4000)]], "x double")
    slow = F.bround(F.round("x", 6)).cast("int")
    assert df.filter(~P.V.whole_days(F.col("x")).eqNullSafe(slow)).count() == 0


def one_by_one(calibration, online, alpha, gamma):
    """The replay of one series and step size, a month at a time."""
    pool, level, hits, width = sorted(map(abs, calibration)), alpha, 0, 0.0
    for r in map(abs, online):
        half = pool[math.ceil(round((1.0 - min(max(level, 1e-3), 0.999)) * (len(pool) - 1), 9))]
        hits, width = hits + (r <= half), width + 2.0 * half
        level += gamma * (alpha - (0.0 if r <= half else 1.0))
        pool = sorted([*pool, r])
    return hits, width


def test_replay_of_a_batch_is_that_of_each_series(spark):
    rng = random.Random(4)
    series = {f"s{i}": [float(rng.choice([0, 30, -30, 61, 15.5]) * (1 + i % 3)) for _ in range(n)] for i, n in enumerate([1, 2, 3, 7, 20, 59, 41, 12])}
    rows = [(k, month(i), r) for k, v in series.items() for i, r in enumerate(v)] + [("s3", month(99), None)]
    df = spark.createDataFrame(rows, "k string, date date, resid double").repartition(3)
    out = IV.aci_replay(df, ["k"])
    want = {}
    for k, v in series.items():
        cut = max(1, int(len(v) * 2 / 3 + 1e-9))
        want |= {(k, g): (len(v) - cut, *one_by_one(v[:cut], v[cut:], 0.05, g)) for g in IV.ACI_GAMMAS if len(v) > cut}
    assert {(r["k"], r["gamma"]): (r["n"], r["hits"], r["width"]) for r in out.collect()} == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_drift_reads_its_scorecard_once(spark):
    rows = [("2006-01", 1, "FAD", 1.0, 1), ("2006-01", 2, "FAD", 9.0, 0), ("2006-02", 1, "FAD", 2.0, 1), ("2006-02", 1, "DFF", None, 0), ("2006-02", 1, "DFF", 4.0, 1)]
    card = spark.createDataFrame(rows, "origin string, h int, `table` string, scaled_err double, in95 int")
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    row = G.performance_drift(card.mapInPandas(counted, card.schema), min_n=3).first()
    assert runs.value == len(rows)
    assert (row["latest_vintage"], row["latest_n"], row["latest_mase"], row["baseline_mase"], row["baseline_n"]) == ("2006-02", 3, 3.0, 1.0, 1)
    assert row["latest_cov95"] == pytest.approx(2 / 3) and row["performance_drift"] and row["coverage_drift"]
    flags = G.vintage_flags(card.mapInPandas(counted, card.schema))
    assert {tuple(r) for r in flags.collect()} == {("2006-01", True), ("2006-02", False)} and runs.value == 2 * len(rows)
    assert {tuple(r) for r in G.vintage_flags(card, ["table"]).collect()} == {("FAD", "2006-01", True), ("FAD", "2006-02", False), ("DFF", "2006-02", False)}


def test_whole_rows_of_an_append_move_only_for_mixed_keys(spark, tmp_path, monkeypatch):
    shape = "origin string, country string, category string, `table` string, date date, frozen_at string, days int"
    row = lambda origin, country, at, days: (origin, country, "F1", "FAD", dt.date(2006, 5, 1), at, days)
    calls = []
    monkeypatch.setattr(sinks, "new_rows", lambda *a: calls.append(1) or L.new_rows(*a))
    path = str(tmp_path / "ledger")
    add = lambda batch, *rows: sinks.append_ledger(spark.createDataFrame(rows, shape), path, batch)
    assert add("1", row("2006-01", "a", "1", 1), row("2006-01", "b", "1", 2)) == 2 and not calls
    assert add("2", row("2006-01", "a", "2", 8), row("2006-01", "b", "2", 9)) == 0 and not calls
    assert add("3", row("2006-01", "a", "3", 7), row("2006-02", "a", "3", 3), row("2006-02", "a", "2", 4)) == 1 and calls == [1]
    assert add("4", row("2006-03", None, "4", 5)) == 1 and add("5", row("2006-03", None, "5", 6)) == 1
    got = {(r["origin"], r["country"], r["days"]) for r in sinks.read_ledger(spark, path).collect()}
    assert got == {("2006-01", "a", 1), ("2006-01", "b", 2), ("2006-02", "a", 4), ("2006-03", None, 5), ("2006-03", None, 6)}
