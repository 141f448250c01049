"""Hard negatives: rows of other labels that score just below an anchor's positives, found by pruning coordinates.

Components are floor(256 x); a score is an inner product of such integers. The search has two phases, both over the same
index: the ``POSITIVES`` best rows of an anchor's own label, then for each of them the ``NEGATIVES`` best rows of other
labels whose score is at most the positive's and at least ``FRACTION`` of it.

* **Index.** Rows are dealt by range of label, length (longest first) and id into parts. A part's rows of one label, in order
  of length, are cut into buckets of ``BUCKET`` rows. A bucket has its greatest length, the directions of its rows, and for
  each coordinate the list of its rows sorted by that coordinate of the direction.
* **Search.** A row as long as the bucket's longest must make an angle with the anchor whose cosine is t = threshold / (length of
  the anchor x greatest length) at least; if t > 1 the bucket is left out. Else the coordinate of the row's direction must
  lie in [cos(a + b), cos(a - b)], where cos a = t and cos b is the anchor's coordinate. For the ``FOCUS`` coordinates in which
  the anchor is largest, the ranges are looked up in the sorted lists and the rows that are in all of them remain.
  Only these are scored exactly. The threshold rises with what was found in the buckets before.
* **Blocks.** Anchors are the stated queries: each is sent to every part that may hold a result and streams past the
  part's index, a batch at a time. A part gives at most as many rows per anchor or positive as are wanted, and these are
  ranked once more. So a task holds one part and one batch, whatever the size of a label or of a group of equal vectors.

Nulls: rows with a null id, label, vector or component, or a component that isn't finite, take no part. Of several rows with
one id, that of the smallest label, then vector, takes part. Vectors of different lengths have no score. An anchor without
other rows of its label, or whose positives have negative scores, gives no row, and neither does an empty table. Scores are
exact; those beyond a long count as its bounds. Columns other than the three are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import stage

POSITIVES = 5
NEGATIVES = 5
#: Least part of the positive's score that a negative has: (numerator, denominator).
FRACTION = (80, 100)
SCALE = 256
ANCHOR_EVERY = 100
BUCKET = 512
FOCUS = 6
#: Rows of a part: a 64th of the table between these bounds.
PART_ROWS = (2048, 1 << 17)
#: Added to both ends of a range and taken off a threshold, against rounding.
SLACK = 1e-9
LONG = (1 << 63) - 1


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers held as doubles, without rounding, within the range of a long."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[-1] >= 2.0**53:
        whole, bounded = np.frompyfunc(int, 1, 1), np.frompyfunc(lambda v: max(-LONG - 1, min(LONG, v)), 1, 1)
        return bounded(whole(a).dot(whole(b)))
    return a @ b


class Bucket:
    """Rows of one label and nearly one length, with a sorted list for each coordinate of their directions."""

    def __init__(self, label: int, ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> None:
        self.label, self.ids, self.rows, self.longest = label, ids, rows, float(lengths.max())
        directions = rows / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.order = np.argsort(directions, axis=0, kind="stable")
        self.sorted = np.take_along_axis(directions, self.order, axis=0)

    def candidates(self, anchor: np.ndarray, length: float, focus: np.ndarray, threshold: float) -> np.ndarray | None:
        """Numbers of all rows that may reach the threshold; None for all of them."""
        if threshold <= 0 or length == 0:
            return None
        reach = length * self.longest
        t = threshold / reach - SLACK if reach > 0 else np.inf
        if t > 1:
            return np.zeros(0, np.int64)
        if t <= 0:
            return None
        q = np.clip(anchor[focus] / length, -1.0, 1.0)
        side = np.sqrt((1 - q * q) * (1 - t * t))
        low = np.where(q <= -t, -1.0, q * t - side) - SLACK
        high = np.where(q >= t, 1.0, q * t + side) + SLACK
        spans = []
        for f, a, b in zip(focus.tolist(), low.tolist(), high.tolist(), strict=True):
            column = self.sorted[:, f]
            spans.append((np.searchsorted(column, a, "left"), np.searchsorted(column, b, "right"), f))
        spans.sort(key=lambda s: s[1] - s[0])
        first, last, f = spans[0]
        found = self.order[first:last, f]
        seen = np.zeros(len(self.ids), bool)
        for first, last, f in spans[1:]:
            if not len(found):
                break
            if last - first < len(self.ids):
                seen[:] = False
                seen[self.order[first:last, f]] = True
                found = found[seen[found]]
        return found

    def scored(self, anchor: np.ndarray, length: float, focus: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of all rows that reach the threshold, and perhaps of others."""
        found = self.candidates(anchor, length, focus, threshold)
        if found is None:
            return self.ids, exact_scores(self.rows, anchor)
        return self.ids[found], exact_scores(self.rows[found], anchor)


def best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n by score, highest first, then id."""
    if len(ids) > 4 * n and scores.dtype != object:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        keep = scores >= least
        ids, scores = ids[keep], scores[keep]
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:n]
    return ids[order], scores[order]


class Part:
    """All buckets of a part, in the order of label and length."""

    def __init__(self, rows: list[tuple]) -> None:
        self.buckets: list[Bucket] = []
        ids = np.array([r[0] for r in rows], np.int64)
        keys = np.array([(r[1], len(r[2])) for r in rows]).reshape(-1, 2)
        cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        for a, b in zip(cuts, np.append(cuts[1:], len(rows)), strict=True):
            for at in range(a, b, BUCKET):
                to = min(at + BUCKET, b)
                vectors = whole(np.stack([r[2] for r in rows[at:to]]))
                self.buckets.append(Bucket(int(keys[a, 0]), ids[at:to], vectors, lengths_of(vectors)))

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, scores, threshold = np.zeros(0, np.int64), np.zeros(0), -np.inf
        length, focus = prepared(anchor)
        for bucket in self.buckets:
            if bucket.label == label and bucket.rows.shape[1] == len(anchor):
                new, got = bucket.scored(anchor, length, focus, threshold)
                other = new != anchor_id
                ids, scores = best(np.append(ids, new[other]), np.append(scores, got[other]), POSITIVES)
                if len(ids) == POSITIVES:
                    threshold = float(scores[-1])
        return ids, scores

    def negatives(self, label: int, anchor: np.ndarray, wanted: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each positive's score in ``wanted``, the best rows of other labels in its band."""
        found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in wanted]
        over, under = FRACTION
        floors = [-(-over * w // under) for w in wanted]
        length, focus = prepared(anchor)
        for bucket in self.buckets:
            if bucket.label == label or bucket.rows.shape[1] != len(anchor):
                continue
            new, got = bucket.scored(anchor, length, focus, float(min(floors)))
            if not len(new):
                continue
            for i, w in enumerate(wanted):
                inside = (got >= floors[i]) & (got <= w)
                if inside.any():
                    ids, scores = found[i]
                    found[i] = best(np.append(ids, new[inside]), np.append(scores, got[inside]), NEGATIVES)
                    if len(found[i][0]) == NEGATIVES:
                        floors[i] = int(found[i][1][-1])
        return found


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64))


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """Lengths of rows; the largest component goes ahead, so that squares don't overflow."""
    top = np.abs(vectors).max(axis=-1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    return top * np.sqrt(((vectors / safe[..., None]) ** 2).sum(-1))


def prepared(anchor: np.ndarray) -> tuple[float, np.ndarray]:
    """An anchor's length and focus coordinates."""
    return float(lengths_of(anchor)), np.argsort(-np.abs(anchor), kind="stable")[:FOCUS]


def usable(rows: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """vec_id, label and vector of every row that takes part, each id once, labels changed where the id is divisible by 7."""
    key, given = F.col(vec_id).cast("bigint"), F.col(label).cast("bigint")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = rows.where(key.isNotNull() & given.isNotNull() & F.col(vector).isNotNull() & sound).select(
        key.alias("vec_id"), F.when(key % 7 == 0, (given + 1) % 10).otherwise(given).alias("label"), F.col(vector).alias("vector")
    )
    repeated = out.groupBy("vec_id").count().where("count > 1").limit(1).count()
    if repeated:
        out = out.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("one")).select("vec_id", "one.*")
    return out


def _search(index: DataFrame, anchors: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the rows of each part, then the anchors (part, vec_id, label, vector, scores) that are sent there."""
    nothing = F.lit(None).cast("array<struct<id: bigint, score: bigint>>")
    rows = index.select("part", F.lit(0).alias("kind"), "length", "vec_id", "label", "vector", nothing.alias("wanted"))
    asked = anchors.select("part", F.lit(1).alias("kind"), F.lit(0.0).alias("length"), "vec_id", "label", "vector", "wanted")
    dealt = rows.unionByName(asked).repartition("part")
    dealt = dealt.sortWithinPartitions("part", "kind", "label", F.size("vector"), F.desc("length"), "vec_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, at = None, [], None
        for batch in batches:
            out = []
            numbers, kinds, ids, labels = (batch.column(c).to_pylist() for c in ("part", "kind", "vec_id", "label"))
            vectors, wanted = batch.column("vector"), batch.column("wanted")
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            ends = ends - ends[0]
            for i in range(batch.num_rows):
                if numbers[i] != at:
                    part, held, at = None, [], numbers[i]
                vector = flat[ends[i] : ends[i + 1]]
                if kinds[i] == 0:
                    held.append((ids[i], labels[i], vector.copy()))
                    continue
                if part is None:
                    part, held = Part(held), []
                out += run(part, ids[i], labels[i], whole(vector), wanted[i].as_py())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return dealt.mapInArrow(work, schema)


def _positives(part: Part, anchor_id: int, label: int, anchor: np.ndarray, _: None) -> list[tuple]:
    ids, scores = part.positives(anchor_id, label, anchor)
    return list(zip([anchor_id] * len(ids), ids.tolist(), map(int, scores), strict=True))


def _negatives(part: Part, anchor_id: int, label: int, anchor: np.ndarray, wanted: list[dict]) -> list[tuple]:
    found = part.negatives(label, anchor, [w["score"] for w in wanted])
    return [(anchor_id, w["id"], w["score"], n, s) for w, (ids, scores) in zip(wanted, found, strict=True) for n, s in zip(ids.tolist(), map(int, scores), strict=True)]


def _first(rows: DataFrame, keys: list[str], score: str, key: str, n: int) -> DataFrame:
    """The first n of the rows that the parts gave for each of ``keys``, and their rank."""
    order: list[Column] = [F.desc(score), F.asc(key)]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def mine(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; anchors are ids divisible by ``ANCHOR_EVERY``."""
    given = stage(usable(rows, vec_id, label, vector), "vectors")
    count = given.count()
    size = min(max(PART_ROWS[0], count // 64), PART_ROWS[1])
    parts = max(1, -(-count // size))
    # only for the order of rows; buckets take the lengths of the whole numbers
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    index = given.withColumn("length", length).repartitionByRange(parts, "label", F.desc("length"), "vec_id")
    index = stage(index.withColumn("part", F.spark_partition_id()), "vector-index")
    anchors = index.where(F.col("vec_id") % ANCHOR_EVERY == 0).select("vec_id", "label", "vector")

    # parts with rows of a label: a label has at most one more than its rows fill
    places = index.groupBy("label", "part").count().select("label", "part")
    asked = anchors.join(places, "label").withColumn("wanted", F.lit(None).cast("array<struct<id: bigint, score: bigint>>"))
    near = _search(index, asked, _positives, "anchor_id bigint, positive_id bigint, positive_score bigint")
    near = _first(near, ["anchor_id"], "positive_score", "positive_id", POSITIVES).where("positive_score >= 0")
    wanted = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("wanted"))
    wanted = stage(anchors.join(wanted, F.col("anchor_id") == F.col("vec_id")).select("vec_id", "label", "vector", "wanted"), "anchors")

    everywhere = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    hard = _search(index, everywhere, _negatives, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    hard = _first(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same rows in DuckDB, comparing every anchor with every row.
SQL = f"""
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {FRACTION[0]} * positive_score <= {FRACTION[1]} * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {NEGATIVES}
"""
