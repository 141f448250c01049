"""Hard negatives against a comparison of all rows."""

import math

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from panelspark.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows):
    sound = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        one = ((label + 1) % 10 if key % 7 == 0 else label, [float(np.float32(x)) for x in vector])
        sound[key] = min(sound[key], one) if key in sound else one
    sound = {k: (label, [math.floor(256 * x) for x in v]) for k, (label, v) in sound.items()}
    out = []
    for a, (label, v) in sound.items():
        if a % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), b, other) for b, (other, w) in sound.items() if b != a and len(w) == len(v)]
        scores.sort()
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            band = [x for x in scores if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(band[:5], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def made():
    """Lengths from tiny to large, clusters, equal vectors, zero vectors, and rows that take no part."""
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 16))
    rows = []
    for i in range(3000):
        v = (centres[rnd.integers(12)] + 0.3 * rnd.normal(size=16)) * rnd.choice([0.02, 1, 1, 5])
        rows.append((int(i), v.astype(np.float32).tolist(), int(rnd.integers(0, 10)) if i % 3 else 4))
    for i in range(0, 3000, 5):
        rows[i] = (i, rows[1][1], rows[i][2])
    rows[200], rows[300], rows[301] = (200, [0.0] * 16, 1), (300, [0.0] * 16, 1), (301, [0.0] * 16, 2)
    rows[400] = (400, [float("nan")] * 16, 1)
    rows[401], rows[402], rows[403], rows[500] = (401, None, 1), (402, [None] * 16, 1), (403, [math.inf] * 16, 1), (500, rows[500][1], None)
    rows += [(None, rows[1][1], 1), (600, rows[600][1], 0), (601, rows[601][1], rows[601][2]), (5000, [1.0, 2.0], 3), (5001, [1.0, 2.5], 3), (5002, [1.0, 1.9], 4)]
    rows += [(6000, [], 1), (6001, [], 1), (6002, [], 2)]
    return rows


@pytest.mark.parametrize(("part", "bucket"), [(2048, 512), (100, 16)])
def test_all_rows_compared(spark, made, part, bucket, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PART_ROWS", (part, part))
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    table = spark.createDataFrame(made, SCHEMA).repartition(3).withColumns({"part": F.lit(1), "Length": F.lit("x"), "kind": F.lit(None)})
    got = found(hard_negatives.mine(table))
    assert got == plain(made) and len(got) > 200


def test_query_and_sql(spark, sf):
    assert not differences(queries.op13_hard_negatives(spark, sf), connect(sf), hard_negatives.SQL)


def test_few_rows(spark):
    assert found(hard_negatives.mine(spark.createDataFrame([], SCHEMA))) == []
    alone = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)]
    assert found(hard_negatives.mine(spark.createDataFrame(alone, SCHEMA))) == []
    large = [(100, [1e30, 1.0], 1), (1, [1e30, 0.5], 1), (2, [9e29, 0.0], 2)]
    got = found(hard_negatives.mine(spark.createDataFrame(large, SCHEMA)))
    most = (1 << 63) - 1  # beyond a long
    assert got == [(100, 1, 1, 2, most, most)]


def test_ranges_leave_out_only_what_cannot_reach_the_threshold():
    rnd = np.random.default_rng(1)
    rows = np.floor(256 * rnd.normal(size=(400, 6)))
    bucket = hard_negatives.Bucket(0, np.arange(400), rows, hard_negatives.lengths_of(rows))
    pruned = 0
    for anchor in np.floor(256 * rnd.normal(size=(50, 6))):
        length, focus = hard_negatives.prepared(anchor)
        scores = rows @ anchor
        for threshold in np.quantile(scores, [0.5, 0.9, 0.99, 1.0]):
            kept = bucket.candidates(anchor, length, focus, threshold)
            kept = np.arange(400) if kept is None else kept
            assert set(np.flatnonzero(scores >= threshold)) <= set(kept)
            pruned += 400 - len(kept)
    assert pruned > 10_000
