"""Pooled learners train on the past only and return one forecast per evaluation row."""

import datetime as dt

import numpy as np
import pytest
from frames import obs_frame
from pyspark.sql import functions as F

from panelspark.config import SERIES, Protocol
from panelspark.operators import learners as LE

SHORT = Protocol(min_train={"FAD": 30, "DFF": 30}, holdout=12, min_f=24)
CUT = dt.date(2006, 1, 1)


@pytest.fixture(scope="module")
def obs(spark):
    return obs_frame(spark, series=4, months=84)


FITS = {
    "gbm": lambda o: LE.global_gbm(LE.design(o, SHORT), iterations=2, depth=2, months=30),
    "hurdle": lambda o: LE.hurdle(LE.design(o, SHORT), iterations=2, depth=2, months=30),
    "ridge": lambda o: LE.ridge_lags(LE.ridge_frame(o, SHORT), months=30),
}


@pytest.mark.parametrize("name", sorted(FITS))
def test_blocks_only_see_the_past(spark, obs, name):
    out = FITS[name](obs)
    assert out.groupBy(*SERIES, "bulletin_date").count().filter("count > 1").count() == 0
    changed = obs.withColumn("y", F.when(F.col("bulletin_date") > F.lit(CUT), F.col("y") * 2).otherwise(F.col("y")))
    early = lambda df: sorted(
        (tuple(r)[:-1], round(r["forecast"], 6))
        for r in df.filter(F.col("bulletin_date") <= F.lit(dt.date(2004, 12, 1))).select(*SERIES, "bulletin_date", "forecast").collect()
    )
    got = early(out)
    assert got and got == early(FITS[name](changed))


def test_no_missing_features(obs):
    frame = LE.design(obs, SHORT)
    cols = LE.design_columns(frame)
    nulls = frame.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    assert all(v == 0 for v in nulls) and len(cols) == len(set(cols))


def test_leave_one_class_out_equals_refits(spark):
    """Coefficients from downdated sums are those of a fit on all other classes, one class holding a third of the rows."""
    g = np.random.default_rng(3)
    rows = []
    for c in range(20):
        for _ in range(60 if c == 7 else 6):
            x = g.normal(size=3) * [1.0, 100.0, 0.01] + [0.0, 5000.0, 0.0]
            rows.append(("m", f"c{c}", *map(float, x), 4.0, float(2 + x[0] - 0.01 * x[1] + 30 * x[2] + g.normal() * 0.1)))
    columns = ["a", "b", "c", "flat"]
    df = spark.createDataFrame(rows, "model string, class string, a double, b double, c double, flat double, err double").repartition(3)
    stats = LE.class_statistics(df, columns, "err", ["model", "class"])
    got = {r["class"]: r for r in LE.leave_out_coefficients(stats, ["model"], "class").collect()}
    assert len(got) == 20
    for c, r in got.items():
        rest = np.array([row[2:] for row in rows if row[1] != c])
        x = np.column_stack([np.ones(len(rest)), rest[:, :4]])
        gram = x.T @ x
        penalty = LE.RIDGE * len(x) * x.var(0)
        penalty[4] = 1.0 + gram[4, 4]
        want = np.linalg.solve(gram + np.diag(penalty), x.T @ rest[:, 4])
        assert r["n"] == len(rest) and np.allclose(r["coefficients"], want, rtol=1e-6, atol=1e-6)
        assert abs(r["mean"] - rest[:, 4].mean()) < 1e-9
    few = df.limit(3)
    assert LE.leave_out_coefficients(LE.class_statistics(few, columns, "err", ["model", "class"]), ["model"], "class").count() >= 1
