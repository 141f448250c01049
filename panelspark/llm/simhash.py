"""Near duplicates by SimHash, found with an index in Gray order; by fingerprints alone or by similar sets (``keep_one``).

Fingerprint: XXH64 (seed 42) of each run of three words votes on 64 bits; a bit is set if it is set in over half of
the hashes. Two fingerprints are linked if they differ in at most ``DISTANCE`` bits, and documents are grouped by the
connected components of the links.

Only distinct fingerprints are compared, so that exact copies, however many, count once. The search has two steps:

* **Buckets.** The bits are cut into ``DISTANCE`` + 1 blocks; linked fingerprints agree in one block at least. So each
  fingerprint goes to one bucket for each block, keyed by the block's place and its bits. A bucket of over ``BUCKET``
  fingerprints is cut again in the same way along the bits that its key leaves free, until it is small enough;
  a bucket whose key leaves ``DISTANCE`` bits free holds eight fingerprints at most, so this ends. No link is lost
  and no task gets a large bucket.
* **Gray-order index.** A bucket is sorted by Gray rank, which puts fingerprints that share bit patterns side by side.
  Neighbours are joined into nodes of a tree; a node holds the bits on which all below it agree, less those that
  nodes above already hold. A search goes down from the root and adds up the differences in these shared bits; as
  soon as they pass ``DISTANCE``, the whole group below the node is left out. At the leaves the sum is the distance.

A task gives a spanning forest of the links in its bucket rather than all pairs, and the forests are joined by rounds
of large-star and small-star joins, each written to the shared folder.

``keep_one`` wants sets of five-word runs of Jaccard similarity 0.8 or more. Their fingerprints differ in about ten bits of 64, too
many to cut buckets by bits, so minimum hashes deal the sets to buckets, and the Gray-order index searches each bucket for
fingerprints that differ in at most ``NEAR`` bits; what it finds is compared exactly (``similar_sets``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import as_bytes, field, lists, map_texts, pick
from panelspark.session import numbered, stage

WORDS = 3
SEED = 42
DISTANCE = 3
BITS = 64
#: Fingerprints in a bucket, beyond which it is cut further.
BUCKET = 1024
#: Children of a node of the index.
FAN = 8
#: Pairs of search and node that are looked at together, at most about; bounds a task's memory.
PAIRS = 1 << 18

ALL = (1 << BITS) - 1
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Words of a shingle and the Jaccard similarity (a fraction) from which ``keep_one`` takes texts as near duplicates.
SET_WORDS = 5
SIMILARITY = (4, 5)
#: Bits in which the fingerprints of similar sets may differ. At similarity 0.8 they differ in 9.7 bits on average, with a
#: deviation of 2.9: 95 of 100 such pairs are within 14 bits, 99 of 100 at 0.85.
NEAR = 14
#: Bands and minimum hashes in each. Sets of similarity s share a band with probability 1 - (1 - s ** BAND_ROWS) ** BANDS:
#: at 0.8 97 of 100 pairs do, at 0.85 all but 4 in 10,000, at 0.9 all but 2 in 10 ** 8; at 0.7 half do, at 0.6 a tenth.
BANDS = 48
BAND_ROWS = 12
#: Sets of each bucket with which all of its sets are compared before the index searches what is left.
STARS = 2
#: Nearest sets that a search gives at first, and how much more it gives in each further round.
FIRST, MORE = 4, 8
_random = np.random.default_rng(SEED)
FLIPS, TIMES = (_random.integers(0, ALL, BANDS * BAND_ROWS, np.uint64, endpoint=True) for _ in range(2))
TIMES |= np.uint64(1)


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of a text in UTF-8; 0 for null and for a text without words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    votes, n = np.zeros(BITS, np.int64), len(words) - WORDS + 1
    starts, ends = starts[:n].tolist(), ends[WORDS - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):  # in parts, so that a long text's bits don't fill the memory
        cuts = zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cuts], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", passed: tuple[str, ...] = ("doc_id",), name: str = "fp") -> DataFrame:
    """``passed`` columns and the fingerprint of every row's whole text as a signed long with the same bits."""

    def start():
        def work(texts: pa.Array):
            found = np.array([fingerprint(t) for t in as_bytes(texts)], np.uint64)
            return [pa.array(found.view(np.int64))]

        return work

    return map_texts(docs, text, passed, [field(name, "bigint")], start)


def signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def finer(mask: int) -> list[int]:
    """``mask`` with each of DISTANCE + 1 nearly equal runs of its free bits added."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    cuts = [round(k * len(free) / (DISTANCE + 1)) for k in range(DISTANCE + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the Gray code: each bit is the parity of the bits from the top down to it."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _keyed(fps: DataFrame, masks: dict[int, list[int]] | None = None) -> DataFrame:
    """(mask, value, fp): a row for each bucket of each fingerprint; ``masks`` gives the finer masks of a cut bucket's."""
    if masks is None:
        finer_masks = F.array(*(F.lit(signed(m)) for m in finer(0)))
    else:
        pairs = [x for m, ms in masks.items() for x in (F.lit(m), F.array(*(F.lit(signed(f)) for f in ms)))]
        finer_masks = F.element_at(F.create_map(*pairs), F.col("mask"))
    rows = fps.select("fp", F.explode(finer_masks).alias("mask"))
    return rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def _buckets(fps: DataFrame, limit: int) -> DataFrame:
    """Rows of all buckets with at most ``limit`` fingerprints, cut finer where needed."""
    done, rows = [], _keyed(fps)
    while True:
        large = stage(rows.groupBy("mask", "value").count().where(F.col("count") > limit).drop("count"), "simhash-large")
        masks = [r[0] for r in large.select("mask").distinct().collect()]  # four for the first cut, sixteen for the next
        if not masks:
            done.append(rows)
            break
        done.append(rows.join(large, ["mask", "value"], "left_anti"))
        cut = rows.join(large, ["mask", "value"], "left_semi")
        rows = _keyed(cut, {m: finer(m & ALL) for m in masks})
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _expand(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entry each element comes from, and starts[i], starts[i] + 1, ... for each entry."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


class GrayIndex:
    """Trees over several buckets of fingerprints, each bucket in Gray order."""

    def __init__(self, fps: np.ndarray, starts: np.ndarray) -> None:
        self.fps, self.starts = fps, starts
        ends = np.append(starts[1:], len(fps))
        # level 0 is the fingerprints; a level's node has a first fingerprint, the bits in which those below differ,
        # the range of its children in the level below and the end of its rows
        self.levels = [(fps, np.zeros(len(fps), np.uint64), None, None, np.arange(1, len(fps) + 1))]
        sizes, first, bucket_end = ends - starts, starts, ends
        while True:
            below_first, below_mixed, _, _, _ = self.levels[-1]
            groups = -(-sizes // FAN)
            owner, number = _expand(groups, np.zeros(len(groups), np.int64))
            child = first[owner] + number * FAN
            last = np.minimum(child + FAN, (first + sizes)[owner])
            head = below_first[child]
            of = np.repeat(np.arange(len(child)), last - child)
            mixed = np.bitwise_or.reduceat(below_mixed | (below_first ^ head[of]), child)
            self.levels.append((head, mixed, child, last, self.levels[-1][4][last - 1]))
            first, sizes = np.cumsum(groups) - groups, groups
            if sizes.max() == 1:
                break

    def links(self, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of rows of one bucket whose fingerprints differ in at most ``distance`` bits."""
        ends = np.append(self.starts[1:], len(self.fps))
        # buckets side by side until their pairs fill the memory set aside
        work = np.cumsum((ends - self.starts) ** 2) // PAIRS
        for part in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(work)) + 1):
            root, search = _expand((ends - self.starts)[part], self.starts[part])
            yield self._search(search, part[root], distance)

    def _search(self, search: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        # the bits that a whole bucket shares don't differ from those of a search inside it
        differ = np.zeros(len(node), np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            _, mixed, child, last, _ = self.levels[level]
            head, below, _, _, end = self.levels[level - 1]
            owner, into = _expand(last[node] - child[node], child[node])
            query = search[owner]
            new = mixed[node][owner] & ~below[into]  # bits shared here but not yet further up
            total = differ[owner] + np.bitwise_count((self.fps[query] ^ head[into]) & new)
            ok = (total <= distance) & (end[into] > query + 1)  # each pair is found from its lower row
            search, node, differ = query[ok], into[ok], total[ok]
        return search, node


    def near(self, queries: np.ndarray, bucket: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, differing bits) of all rows in a query's bucket that differ from it in at most ``distance`` bits."""
        sizes = np.diff(np.append(self.starts, len(self.fps)))
        work = np.cumsum(sizes[bucket]) // PAIRS
        for part in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(work)) + 1):
            search, node, differ = part, bucket[part], np.zeros(len(part), np.int64)
            # bits that a whole bucket shares are looked at before the tree below it
            top, mixed, _, _, _ = self.levels[-1]
            differ += np.bitwise_count((queries[search] ^ top[node]) & ~mixed[node])
            ok = differ <= distance
            search, node, differ = search[ok], node[ok], differ[ok]
            for level in range(len(self.levels) - 1, 0, -1):
                _, mixed, child, last, _ = self.levels[level]
                head, below, _, _, _ = self.levels[level - 1]
                owner, into = _expand(last[node] - child[node], child[node])
                query = search[owner]
                new = mixed[node][owner] & ~below[into]
                total = differ[owner] + np.bitwise_count((queries[query] ^ head[into]) & new)
                ok = total <= distance
                search, node, differ = query[ok], into[ok], total[ok]
            yield search, node, differ


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest row that each of ``n`` rows is connected to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        a, b = (x[label[a] != label[b]] for x in (a, b))
    return label


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of a spanning forest of each bucket, from rows (mask, value, fp) that are sorted by bucket and Gray rank."""
    rest = np.zeros((3, 0), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(0)) if rows.shape[1] else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, rows.shape[1]))
        several = np.repeat(sizes > 1, sizes)
        rows, starts = rows[:, several], np.cumsum(np.append(0, sizes[sizes > 1]))[:-1]
        fps = rows[2]
        if len(fps):
            found = list(GrayIndex(fps.view(np.uint64), starts).links())
            root = _forest(len(fps), np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        else:
            root = np.zeros(0, np.int64)
        other = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[other]), pa.array(fps[root[other]])], ["a", "b"])

    for batch in batches:
        rows = np.hstack([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])])
        ended = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(0))
        cut = int(ended[-1]) + 1 if len(ended) else 0
        rest = np.ascontiguousarray(rows[:, cut:])  # the last bucket may go on in the next batch
        yield links(np.ascontiguousarray(rows[:, :cut]))
    yield links(rest)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of linked fingerprints that connect all that are linked, directly or by others; ``fps`` has each once."""
    rows = _buckets(fps.where(F.col("fp").isNotNull()).select("fp"), bucket)
    rows = rows.repartition("mask", "value").sortWithinPartitions("mask", "value", gray_rank(F.col("fp")))
    return rows.mapInArrow(_bucket_links, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the lowest node that each node of the undirected ``edges`` (a, b) reaches; nodes without edge are left out.

    Large-star and small-star rounds: every node points its higher neighbours, then its lower ones, to the lowest;
    the rounds end when the set of edges stays as it was.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        mark = now


def groups(fps: DataFrame, doc_id: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """(fp, root, component_id): for each distinct ``fp`` its component's root and the smallest ``doc_id`` of all in it.

    Null ids don't count; a component without any other id has a null component_id. ``fps`` should be stored, as it is
    read more than once.
    """
    firsts = fps.groupBy("fp").agg(F.min(doc_id).alias("first"))
    connected = components(links(firsts, bucket)).withColumnRenamed("node", "fp")
    # only fingerprints with a link take part; the others are components of their own
    linked = stage(connected.join(firsts, "fp"), "linked")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = linked.join(lowest, "root").select("fp", "root", "lowest")
    out = firsts.join(linked, "fp", "left")
    out = out.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("lowest", "first").alias("component_id"))
    # written, so that a join with all documents has plain shuffles on both sides, whose hot keys Spark splits
    return stage(out, "groups")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    Null and empty texts, and those of white space alone, have fingerprint zero and are linked like any other.
    Repeated rows each give a row. A null id is never a component_id.
    """
    fps = stage(fingerprints(docs, text, (doc_id,)), "fingerprints")
    found = fps.join(groups(fps, doc_id).select("fp", "component_id"), "fp")
    return found.select(doc_id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct XXH64 of the runs of ``SET_WORDS`` words of a text in UTF-8, ascending; a shorter text is one run.

    Null and a text without words have the one hash of an empty run.
    """
    words = (text or b"").translate(LOWER).split()
    joined = b" ".join(words)
    if len(words) <= SET_WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - SET_WORDS + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SET_WORDS - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each of ``BANDS`` bands of ``BAND_ROWS`` minimum hashes of a set."""
    lowest = np.full(len(TIMES), ALL, np.uint64)
    for at in range(0, len(hashes), 512):  # in parts, so that a long text's hashes don't fill the memory
        mixed = (hashes[at : at + 512, None] ^ FLIPS) * TIMES
        mixed ^= mixed >> np.uint64(29)
        np.minimum(lowest, mixed.min(0), out=lowest)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in lowest.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys


def set_fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes: a bit is set if it is set in over half of them."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _with_bands(docs: DataFrame, text: str, passed: tuple[str, ...], mark: str) -> DataFrame:
    """``passed`` columns, the digest of every row's set of shingles (``mark``), its size, fingerprint and band keys."""

    def start():
        def work(texts: pa.Array):
            sets = [shingles(t) for t in as_bytes(texts)]
            keys = np.concatenate([band_keys(s) for s in sets] or [np.zeros(0, np.uint64)])
            prints = np.array([set_fingerprint(s) for s in sets], np.uint64)
            return [
                [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [len(s) for s in sets],
                pa.array(prints.view(np.int64)), lists(pa.array(keys.view(np.int64)), [BANDS] * len(sets)),
            ]

        return work

    fields = [field(mark, "binary"), field(f"{mark}n", "int"), field(f"{mark}bits", "bigint"), field(f"{mark}keys", "array<bigint>")]
    return map_texts(docs, text, passed, fields, start)


def _alike(a: Column | int, b: Column | int, shared: Column | int) -> Column:
    """Whether sets of ``a`` and ``b`` members of which ``shared`` are in both are as similar as ``SIMILARITY`` or more."""
    over, under = SIMILARITY
    return under * shared >= over * (a + b - shared)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similar) of the ``pairs`` from their whole sets, of ``sets`` (fp, members)."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("fp").alias(side), F.col("members").alias(f"{side}s")), side)
    shared = F.size(F.array_intersect("as", "bs"))
    return pairs.select("a", "b", _alike(F.size("as"), F.size("bs"), shared).alias("similar"))


def _near_pairs(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[pa.RecordBatch]:
    """(a, b, more): for each search, the ``most`` nearest sets of its part of a bucket in other components, less the ``least`` nearest.

    Rows (key, chunk, kind, bits, n, c, root, fp) are sorted by part, rows of the index (kind 0) before searches (1), and by
    Gray rank. ``more`` tells that a search found further sets.
    """
    over, under = SIMILARITY
    kinds = [np.int64, np.int32, np.int32, np.int64, np.int64, np.int64, "S16", "S16"]
    rest = [np.zeros(0, k) for k in kinds]

    def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, chunk, kind, bits, n, c, root, fp = rows
        new = np.append(True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) if len(key) else np.zeros(0, bool)
        part = np.cumsum(new) - 1
        inside, ask = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        found: list[list] = [[], [], []]
        if len(inside) and len(ask):
            # a part's searches are rows of its bucket, so that each part has rows of the index, or the search finds none
            parts, starts = np.unique(part[inside], return_index=True)
            ask = ask[np.isin(part[ask], parts)]
            index = GrayIndex(bits[inside].view(np.uint64), starts)
            for q, r, differ in index.near(bits[ask].view(np.uint64), np.searchsorted(parts, part[ask]), NEAR):
                q, r = ask[q], inside[r]
                shared = np.minimum(c[q], c[r])  # at most
                ok = (root[q] != root[r]) & (under * shared >= over * (n[q] + n[r] - shared))
                q, r, differ = q[ok], r[ok], differ[ok]
                order = np.lexsort((fp[r], differ, q))
                q, r = q[order], r[order]
                first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
                rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
                more = np.isin(q, q[rank == most])
                keep = (rank >= least) & (rank < most)
                a, b = fp[q[keep]], fp[r[keep]]
                both = list(zip(a.tolist(), b.tolist(), strict=True))
                found[0] += map(min, both)
                found[1] += map(max, both)
                found[2] += more[keep].tolist()
        whole = [[x.ljust(16, b"\0") for x in column] for column in found[:2]]  # numpy leaves out zeros at the end
        return pa.RecordBatch.from_arrays([pa.array(whole[0], pa.binary()), pa.array(whole[1], pa.binary()), pa.array(found[2], pa.bool_())], ["a", "b", "more"])

    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False).astype(k) if k != "S16" else np.array(c.to_pylist(), k) for c, k in zip(batch.columns, kinds, strict=True)]
        rows = [np.append(x, y) for x, y in zip(rest, new, strict=True)]
        ended = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        cut = int(ended[-1]) + 1 if len(ended) else 0
        rest = [x[cut:] for x in rows]  # the last part may go on in the next batch
        if cut:
            yield pairs([x[:cut] for x in rows])
        if len(rest[0]) > 1 << 16:  # many searches: those read so far are done, the index stays
            yield pairs(rest)
            rest = [x[rest[2] == 0] for x in rest]
    yield pairs(rest)


def similar_sets(stored: DataFrame, text: str, mark: str) -> DataFrame:
    """(node, root): the lowest set that each set with a similar one reaches, of the written rows of ``_with_bands``.

    Sets that share a band key are in one bucket. A shingle that only one of all these sets has can't be shared, so sets with
    too many of them can't have a partner and leave, and such shingles bound the similarity of every other pair. Then
    each set is compared with ``STARS`` sets of each of its buckets; that is linear and joins most of what belongs
    together. Last, every set that is not in the component of its bucket's first star searches the bucket, in parts of at most
    about ``BUCKET`` sets, for the fingerprints of other components within ``NEAR`` bits. A search gives its nearest sets first;
    the rest follow in later rounds, as long as the components stay apart. So all candidates are compared but those
    that can't be similar or are connected already.
    """
    distinct = stored.groupBy(F.col(mark).alias("fp")).agg(
        F.min(f"{mark}id").alias("id"), F.first(f"{mark}n").alias("n"), F.first(f"{mark}bits").alias("bits"), F.first(f"{mark}keys").alias("keys")
    )
    distinct = stage(distinct, "sets")
    # only ids and keys are dealt by key; what else is needed joins the few rows that are left
    keyed = distinct.select("id", F.explode("keys").alias("key"))
    several = stage(keyed.groupBy("key").count().where("count > 1").select("key"), "several")
    keyed = stage(keyed.join(several, "key", "left_semi"), "bands")
    rows = keyed.join(distinct.select("id", "fp", "n", "bits"), "id").drop("id")

    # texts of the sets that share a bucket, each once
    wanted = keyed.select(F.col("id").alias(f"{mark}id")).distinct()
    chosen = pick(stored, wanted, f"{mark}id")

    def start():
        def work(texts: pa.Array):
            found = [shingles(t) for t in as_bytes(texts)]
            return [lists(pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64)), [len(s) for s in found])]

        return work

    sets = stage(map_texts(chosen, text, (mark,), [field("members", "array<bigint>")], start).withColumnRenamed(mark, "fp"), "members")

    lonely = sets.select("fp", F.explode("members").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("fp").alias("fp"))
    lonely = stage(lonely.where("c = 1").groupBy("fp").agg(F.count(F.lit(1)).cast("int").alias("lonely")), "lonely")
    rows = rows.join(lonely, "fp", "left").withColumn("c", F.col("n") - F.coalesce("lonely", F.lit(0))).drop("lonely")
    rows = stage(rows.where(_alike(F.col("n"), F.col("c"), F.col("c"))), "counted")

    tested = stage(sets.select(F.col("fp").alias("a"), F.col("fp").alias("b"), F.lit(True).alias("similar")).where(F.lit(False)), "tested")
    known = None

    def rooted() -> DataFrame:
        """Rows of buckets that hold several components."""
        out = rows.withColumn("root", F.col("fp"))
        if known is not None:
            out = rows.join(known.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        out = stage(out, "rooted")
        mixed = out.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        return stage(out.join(mixed, "key", "left_semi"), "mixed")

    def compare(pairs: DataFrame) -> int:
        """Compare what has not been compared; the number of new links."""
        nonlocal tested, known
        fresh = stage(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        done = stage(_verified(fresh, sets), "compared")
        tested = stage(tested.unionByName(done), "tested")
        linked = done.where("similar").count()
        if linked:
            # the components so far stand for the links that made them
            new = done.where("similar").select("a", "b")
            known = components(new if known is None else new.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        return linked

    def star(turn: int) -> Column:
        return F.min(F.struct(F.xxhash64("fp", F.lit(turn)), "fp", "n", "c", "root"))

    now = rooted()
    stars = now.groupBy("key").agg(F.array_distinct(F.array(*[star(turn) for turn in range(STARS)])).alias("s"))
    stars = stage(stars.select("key", F.explode("s").alias("s")).select("key", F.col("s.fp").alias("centre"), F.col("s.n").alias("m"), F.col("s.c").alias("d")), "stars")
    pairs = now.join(stars, "key").where("fp <> centre").where(_alike(F.col("n"), F.col("m"), F.least("c", "d")))
    compare(pairs.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")))

    least, most = 0, FIRST
    while True:
        now = rooted()
        sizes = now.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("chunks"), star(0).alias("s"))
        now = now.join(stage(sizes.select("key", "chunks", F.col("s.root").alias("other")), "bucket-sizes"), "key")
        index = now.withColumn("chunk", F.pmod(F.hash("fp"), F.col("chunks"))).withColumn("kind", F.lit(0))
        search = now.where("root <> other").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("kind", F.lit(1))
        dealt = index.unionByName(search).select("key", "chunk", "kind", "bits", "n", "c", "root", "fp")
        dealt = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "kind", gray_rank(F.col("bits")))
        found = stage(dealt.mapInArrow(lambda batches, m=least, n=most: _near_pairs(batches, m, n), "a binary, b binary, more boolean"), "near")
        unfinished = found.where("more").limit(1).count()
        linked = compare(found.select("a", "b"))
        if not linked and not unfinished:
            break
        # the nearest sets are new where components have changed
        least, most = 0 if linked else most, most * MORE
    return known if known is not None else components(tested.select("a", "b"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near duplicates, with all columns: that of the smallest id (a null id only if there is no other).

    Near duplicates have sets of runs of ``SET_WORDS`` words with a Jaccard similarity of ``SIMILARITY`` or more, or are
    connected by others that have (``similar_sets``). Null and empty texts, and those of white space alone, are copies of
    each other. Rows of one id in a group are told apart by a hash of their text and then by their place in the written
    copy, so that repeated rows leave one. Helper columns start with a prefix that no column has, whatever its case.
    """
    names = docs.columns
    mark = "fp"
    while any(name.lower().startswith(mark) for name in names):
        mark += "_"
    marked = _with_bands(docs, text, tuple(names), mark).withColumn(f"{mark}hash", F.xxhash64(text))
    stored = numbered(marked, f"{mark}id", "marked")
    best = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col(f"{mark}hash"), F.col(f"{mark}id").alias("id"))  # texts aren't read for it
    # the best of each set first, so that copies, however many, meet the roots as one row
    rows = stored.groupBy(F.col(mark).alias("fp")).agg(F.min(best).alias("best"))
    roots = stage(similar_sets(stored, text, mark), "roots")
    found = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = found.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.id").alias(f"{mark}id"))
    return pick(stored, kept, f"{mark}id").select(*names)
