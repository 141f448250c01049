"""Order statistics, ranks, tests and models against brute force, hot groups included."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import special
from panelspark.operators import intervals as IV
from panelspark.operators import learners as LE
from panelspark.operators import quantiles as Q
from panelspark.operators import significance as SG
from panelspark.operators import smoothing as SM
from panelspark.operators import stats as ST

rng = random.Random(3)


def hot_rows():
    """Three groups; one value holds a third of the rows of the first, another group is tiny."""
    rows = [("a", 5.0)] * 700 + [("a", rng.gauss(0, 10)) for _ in range(1300)]
    rows += [("b", float(rng.randint(0, 5))) for _ in range(400)] + [("c", 1.5)]
    rng.shuffle(rows)
    return rows


def test_exact_order_statistics(spark):
    rows = hot_rows()
    df = spark.createDataFrame([*rows, ("a", None)], "k string, v double")
    out = Q.order_statistic(df, ["k"], "v", {"q80": Q.higher_rank(0.8), "lo": lambda n: F.lit(1)}).collect()
    med = {r["k"]: r["m"] for r in Q.exact_median(df, ["k"], "v", "m").collect()}
    for r in out:
        v = sorted(x for k, x in rows if k == r["k"])
        assert (r["n"], r["lo"]) == (len(v), v[0])
        assert r["q80"] == np.quantile(v, 0.8, method="higher")
        assert med[r["k"]] == np.median(v)


def test_average_ranks(spark):
    rows = hot_rows()
    out = Q.average_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {}).collect()
    for k in "abc":
        v = [x for g, x in rows if g == k]
        for r in (r for r in out if r["k"] == k):
            below, same = sum(x < r["v"] for x in v), sum(x == r["v"] for x in v)
            assert r["rank"] == below + (same + 1) / 2


def brute_wilcoxon(d, side):
    d = [x for x in d if x]
    order = sorted(abs(x) for x in d)
    rank = {a: (order.index(a) + 1 + len(order) - order[::-1].index(a)) / 2 for a in order}
    w = sum(rank[abs(x)] for x in d if x > 0)
    sums = [sum(r for r, s in zip(range(1, len(d) + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    up, down = sum(s >= w for s in sums) / len(sums), sum(s <= w for s in sums) / len(sums)
    return {"greater": up, "less": down, "two": min(1.0, 2 * min(up, down))}[side]


def test_wilcoxon_exact(spark):
    d = [1.2, -0.4, 2.2, 3.1, -0.9, 4.4, 0.3, 5.0]
    out = SG.wilcoxon(spark.createDataFrame([("g", x) for x in d], "g string, d double"), ["g"], "d", ("two", "greater", "less"), "exact").first()
    for side in ("two", "greater", "less"):
        assert math.isclose(out[f"p_{side}"], brute_wilcoxon(d, side), rel_tol=1e-12)


def test_wilcoxon_all_equal(spark):
    out = SG.wilcoxon(spark.createDataFrame([("g", 0.0)] * 9, "g string, d double"), ["g"], "d").first()
    assert (out["n"], out["zeros"], out["p_two"]) == (0, 9, 1.0)


def test_special_functions():
    assert math.isclose(special.t_quantile(0.975, 4), 2.7764451051977987, rel_tol=1e-10)
    assert math.isclose(special.chi2_sf(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(special.chi2_sf(11.070497693516351, 5), 0.05, rel_tol=1e-9)
    assert math.isclose(special.beta_cdf(0.3, 2, 5), 0.579825, rel_tol=1e-9)
    lo, hi = special.jeffreys(0, 10)
    assert lo == 0.0 and math.isclose(special.beta_cdf(hi, 0.5, 10.5), 0.975, rel_tol=1e-9)
    assert special.jeffreys(10, 10)[1] == 1.0
    with pytest.raises(ValueError):
        special.jeffreys(3, 2)


def sign_sum(x, y):
    return float(np.triu(np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum())


def pairs_apart(v):
    return float(np.triu(v[:, None] != v, 1).sum())


def test_kendall_counts_inversions_over_blocks(spark):
    """Ties, a value of a third of the rows, one-value and all-distinct columns, against all pairs."""
    g = np.random.default_rng(1)
    n = 1500
    x = np.where(g.random(n) < 0.34, 2.0, np.round(g.normal(size=n), 2))
    made = {
        "tied": (x, np.round(x + g.normal(size=n), 1)),
        "distinct": (g.permutation(n).astype(float), g.normal(size=n) * 1e300),
        "falling": (np.arange(n, dtype=float), -np.arange(n, dtype=float) ** 3),
        "one x": (np.ones(n), g.normal(size=n)),
        "one y": (g.normal(size=n), np.zeros(n)),
        "tiny": (np.array([1.0, 2.0, 3.0]), np.array([-1e-310, 0.0, -5e-324])),
    }
    rows = [(f, float(a), float(b)) for f, (xs, ys) in made.items() for a, b in zip(xs, ys, strict=True)]
    df = spark.createDataFrame([*rows, ("tied", None, 1.0), ("tied", 1.0, None)], "feature string, x double, y double").repartition(5)
    out = {r["feature"]: r for r in ST.kendall(df).collect()}
    assert out.keys() == made.keys()
    for name, (xs, ys) in made.items():
        s, ends = sign_sum(xs, ys), pairs_apart(xs) * pairs_apart(ys)
        assert (out[name]["s"], out[name]["n"]) == (s, len(xs)), name
        assert out[name]["tau"] is None if not ends else math.isclose(out[name]["tau"], s / math.sqrt(ends), rel_tol=1e-12)
    assert out["tied"]["p"] < 1e-6 and out["one x"]["p"] == 1.0


def test_sort_key_orders_doubles(spark):
    g = np.random.default_rng(7)
    special_values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf]
    powers = [s * f(2.0**e) for e in range(-1074, 1024, 37) for s in (1, -1) for f in (lambda v: v, lambda v: np.nextafter(v, 0), lambda v: np.nextafter(v, math.inf))]
    values = np.array(special_values + powers + (g.normal(size=200) * 10.0 ** g.integers(-300, 300, 200)).tolist())
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    keys = np.array([r["k"] for r in df.select(Q.sort_key(F.col("v")).alias("k")).collect()], np.int64)
    bits = values.view(np.int64)
    assert keys.tolist() == np.where(bits < 0, -(bits & (2**63 - 1)), bits).tolist()
    nan = df.sparkSession.createDataFrame([(math.nan,)], "v double").select(Q.sort_key(F.col("v"))).first()[0]
    assert nan > keys.max()


def test_order_statistics_keep_null_groups_and_integers(spark):
    rows = [(None, 1, 2**53 + i) for i in range(5)] + [("a", None, i % 3) for i in range(10)] + [(None, None, 7)]
    df = spark.createDataFrame(rows, "k string, j int, v long")
    out = {(r["k"], r["j"]): (r["n"], r["lo"], r["hi"]) for r in Q.order_statistic(df, ["k", "j"], "v", {"lo": lambda n: F.lit(1), "hi": lambda n: n}).collect()}
    assert out == {(None, 1): (5, 2**53, 2**53 + 4), ("a", None): (10, 0, 2), (None, None): (1, 7, 7)}
    ranks = {(r["k"], r["j"], r["v"]): r["rank"] for r in Q.average_ranks(df, ["k", "j"], "v", {}).collect()}
    assert ranks[("a", None, 0)] == 2.5 and ranks[(None, 1, 2**53 + 4)] == 5.0 and ranks[(None, None, 7)] == 1.0


def test_feature_selection(spark):
    g = np.random.default_rng(0)
    signal = g.normal(size=300)
    y = signal + g.normal(0, 0.3, 300)
    cols = {"signal": signal, "twin": signal + g.normal(0, 0.01, 300), "noise": g.normal(size=300)}
    rows = [(i, float(y[i]), name, float(v[i])) for name, v in cols.items() for i in range(300)]
    kept, dropped = ST.select_features(spark.createDataFrame(rows, "id int, y double, feature string, x double"), ["id"])
    assert len(kept) == 1 and set(kept) | set(dropped) == {"signal", "twin"}


def test_confidence_set_drops_the_bad_model(spark):
    g = np.random.default_rng(2)
    rows = [(i, m, float(abs(g.normal(0, s)))) for i in range(120) for m, s in (("good", 1.0), ("same", 1.01), ("bad", 3.0))]
    df = spark.createDataFrame(rows, "u int, model string, loss double")
    kept = ST.model_confidence_set(df, ["u"], ("good", "same", "bad"), reps=200)
    assert "bad" not in kept and kept


def test_states_are_those_of_a_series_cut_at_the_origin():
    g = np.random.default_rng(5)
    y = np.cumsum(g.normal(20, 60, (3, 70)), axis=1) + 5000
    first = np.array([30, 24, 36])
    states = SM.batch_states(y, first)
    for origin in (36, 44, 69):
        assert np.array_equal(SM.batch_states(y[:, :origin], first)[:, :, -1], states[:, :, origin - 1])
        alone = SM.batch_states(y[1:2], first[1:2])
        assert np.array_equal(alone[:, 0], states[:, 1], equal_nan=True)
    assert np.isnan(states[:, 2, 34]).all() and np.isfinite(states[:, 2, 35:]).all()
    steady = 100.0 + 30.0 * np.arange(60)
    level, slope, phi = SM.batch_states(steady[None], np.array([24]))[:3, 0, -1]
    assert (phi, round(slope, 9)) == (1.0, 30.0) and math.isclose(level, steady[-1])


def test_theta_matches_a_plain_recursion():
    y = np.cumsum(np.random.default_rng(6).normal(10, 40, 50)) + 3000
    states = SM.batch_states(y[None], np.array([20]))
    for origin in (20, 35, 49):
        hist = y[:origin]
        best = None
        for a in SM.ALPHAS:
            level, sse = hist[0], 0.0
            for t, v in enumerate(hist[1:], 1):
                e = v - level
                sse += e * e if t >= 2 else 0.0
                level += a * e
            if best is None or sse < best[0] - 1e-9:
                best = (sse, level)
        slope = np.polyfit(np.arange(origin), hist, 1)[0]
        assert math.isclose(states[3, 0, origin - 1] + states[4, 0, origin - 1], best[1] + 0.5 * slope, rel_tol=1e-9)


def test_adaptive_replay():
    cal, new = np.array([1.0, 2.0, 3.0, 4.0]), np.array([10.0, 0.5])
    hits, width = IV._replay(cal, new, 0.05, 0.1)
    # First month misses against the largest residual; it joins the pool and the level falls to its floor.
    assert hits == 1 and width == 2 * 4.0 + 2 * 10.0


def test_simplex_weights(spark):
    g = np.random.default_rng(4)
    a, b, c = g.normal(size=(3, 300))
    y = 0.7 * a + 0.3 * b
    df = spark.createDataFrame([tuple(map(float, r)) + (1.0,) for r in zip(y, a, b, c, strict=True)], "y double, a double, b double, c double, scale double")
    w = LE.stack_weights(df, ("a", "b", "c"))
    assert abs(w["a"] - 0.7) < 1e-6 and abs(w["b"] - 0.3) < 1e-6 and w["c"] < 1e-6
    assert np.allclose(LE.project_simplex(np.array([2.0, 0.0])), [1.0, 0.0])
