"""Packing into sequences of a fixed length by deficit round-robin over one queue for each source.

Every document becomes token ids and an end id; the documents of a source, laid end to end, are its queue. Windows of
``window`` tokens follow each other in one global line of tokens. At a place g of that line a queue should have given
ideal(g) tokens: its target share of g. What it is behind (or ahead) is its deficit (or credit); each window visits the
queues in turn, starting with another one each time, serves those whose deficit has reached ``MIN_PIECE`` tokens, and
fills what room is left from the queues that are furthest behind, which then start the next window with less. Nothing
is lost at a window's end: the deficit is the difference between ideal(g) and what was given, whatever happened before.

That makes the work divisible. The line is cut into groups of ``GROUP`` windows; a queue's tokens from floor(ideal) at a
group's start to floor(ideal) at its end belong to the group, so a task that knows a group's place and tokens knows
all deficits that are carried over from the group before, and a window that two groups share is filled by both. A
group is a bounded number of tokens, however large a source or a document is; documents are cut where they have to be.

Targets: without any, every source is a queue with its own share of all tokens, so that all queues end together. With
weights for some sources, these are queues with these weights and all others share one more; a queue that has run out
leaves its share to the others.

All windows are full but those at the very end: the last T mod ``window`` tokens go to sequences whose lengths are
powers of two, which need no padding.

Nulls: a null text is empty, and an empty text is its end id alone; a null source is a source of its own; a null id is
an id. Repeated rows are documents of their own. No rows give no rows. A text is encoded whole, in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from panelspark.llm.common import PART_ROWS, field
from panelspark.llm.token_files import load
from panelspark.session import stage

WINDOW = 1024
#: Windows whose tokens one task handles at a time.
GROUP = 256
#: Tokens that a queue must be behind to get its turn in a window.
MIN_PIECE = 128
#: Groups whose sizes are added up together.
BLOCK = 4096
#: The queue of all sources without a target weight. Names of sources start with "=", so that none is the same.
OTHERS = "others"
NULL_SOURCE = ""


class Shares:
    """ideal(queue, g): tokens that a queue should have given when the line holds g tokens, exactly.

    Without weights a queue's share is its part of all tokens. With weights the line has phases: in each, the queues that
    are not yet empty share by weight.
    """

    def __init__(self, tokens: int, sizes: Mapping[str, int] | None = None, weights: Mapping[str, Fraction] | None = None) -> None:
        self.tokens, self.sizes, self.phases = tokens, sizes, None
        if weights is None:
            return
        given, place, self.phases, self.starts = dict.fromkeys(sizes, Fraction(0)), Fraction(0), [], []
        while open_ := [q for q in sizes if given[q] < sizes[q]]:
            # queues of weight zero wait until all others are empty, then share by size
            weight = {q: Fraction(weights[q]) for q in open_ if weights[q] > 0} or {q: Fraction(sizes[q]) for q in open_}
            whole = sum(weight.values())
            rate = {q: w / whole for q, w in weight.items()}
            step = min((sizes[q] - given[q]) / r for q, r in rate.items())
            self.starts.append(place)
            self.phases.append((place, dict(given), rate))
            place += step
            for q, r in rate.items():
                given[q] = min(Fraction(sizes[q]), given[q] + r * step)

    def ideal(self, queue: str, size: int, place: int) -> int:
        """The whole tokens of ideal(queue, place); ``size`` is the queue's."""
        if place >= self.tokens:
            return size
        if self.phases is None:
            return size * place // self.tokens
        start, given, rate = self.phases[bisect_right(self.starts, place) - 1]
        return min(size, int(given[queue] + rate.get(queue, 0) * (place - start)))


def sequence_at(place: int, tokens: int, window: int) -> tuple[int, int, int]:
    """Number, first place and end of the sequence that holds a place of the line."""
    full = tokens // window
    if place < full * window:
        at = place // window
        return at, at * window, (at + 1) * window
    number, first, rest = full, full * window, tokens - full * window
    while True:
        length = 1 << (rest.bit_length() - 1)
        if place < first + length:
            return number, first, first + length
        number, first, rest = number + 1, first + length, rest - length


def _fill(rows: list[tuple[str, int, int]], begin: int, shares: Shares, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (row, tokens before it in the row, length, sequence, offset) of one group that starts at ``begin``.

    ``rows``: queue, size of the queue, and tokens of each row, ordered by queue and place in the queue, with the
    first row of each queue giving the queue's tokens before the group as a fourth entry.
    """
    names, sizes, taken, first, last, left = [], [], [], [], [], []
    for i, (queue, size, n, before) in enumerate(rows):
        if not names or names[-1] != queue:
            names.append(queue)
            sizes.append(size)
            taken.append(before)
            first.append(i)
            last.append(i)
            left.append(0)
        last[-1] = i + 1
        left[-1] += n
    count, inside = len(names), [0] * len(names)
    pieces: list[tuple[int, int, int, int, int]] = []
    place, end = begin, begin + sum(left)

    def serve(q: int, n: int, number: int, start: int) -> None:
        nonlocal place
        left[q] -= n
        taken[q] += n
        while n:
            i, off = first[q], inside[q]
            k = min(n, rows[i][2] - off)
            pieces.append((i, off, k, number, place - start))
            place += k
            n -= k
            if off + k == rows[i][2]:
                first[q], inside[q] = i + 1, 0
            else:
                inside[q] = off + k

    while place < end:
        number, start, stop = sequence_at(place, shares.tokens, window)
        stop = min(stop, end)
        turn = number % count
        behind = [shares.ideal(names[q], sizes[q], stop) - taken[q] if left[q] else None for q in range(count)]
        for q in (*range(turn, count), *range(turn)):
            if behind[q] is not None and behind[q] >= MIN_PIECE and place < stop:
                n = min(behind[q], left[q], stop - place)
                serve(q, n, number, start)
                behind[q] = behind[q] - n if left[q] else None
        while place < stop:
            q = max((q for q in range(count) if behind[q] is not None), key=behind.__getitem__)
            n = min(max(behind[q], MIN_PIECE), left[q], stop - place)
            serve(q, n, number, start)
            behind[q] = behind[q] - n if left[q] else None
    return pieces


def _queue(source: str | None, targets: Mapping | None) -> Column:
    """The name of a row's queue, never null."""
    if source is None:
        return F.lit(NULL_SOURCE)
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(NULL_SOURCE))
    if targets is None:
        return name
    return F.when(name.isin(*(_name(s) for s in targets)), name).otherwise(F.lit(OTHERS)) if targets else F.lit(OTHERS)


def _name(source: object) -> str:
    return NULL_SOURCE if source is None else f"={source}"


def _tokens(rows: DataFrame, path: str, end_id: int, wide: str) -> DataFrame:
    """Ids of every row (doc_id, queue, text), with the place of its first id among those of its queue in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, given = load(path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], wide).tobytes()
        for batch in batches:
            for row in range(0, batch.num_rows, PART_ROWS):
                some = batch.slice(row, PART_ROWS)
                coded = encoder.encode([t or "" for t in some.column(2).to_pylist()])
                ids = [np.frombuffer(c, "<u4").astype(wide).tobytes() + end for c in coded]
                at = []
                for queue, one in zip(some.column(1).to_pylist(), ids, strict=True):
                    at.append(given.get(queue, 0))
                    given[queue] = at[-1] + len(one) // len(end)
                n = [len(one) // len(end) for one in ids]
                columns = [some.column(0), some.column(1), pa.array([part] * len(ids), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], ["doc_id", "queue", "part", "at", "n", "ids"])

    schema = [rows.schema["doc_id"], field("queue", "string"), field("part", "bigint"), field("at", "bigint"), field("n", "bigint"), field("ids", "binary")]
    return rows.select("doc_id", "queue", "text").mapInArrow(run, T.StructType(schema))


class _Groups:
    """Which group a queue's token belongs to; remembers each queue's last group, as places mostly ascend."""

    def __init__(self, shares: Shares, size: int) -> None:
        self.shares, self.size, self.last = shares, size, {}
        self.count = -(-shares.tokens // size)

    def at(self, queue: str, total: int, place: int) -> tuple[int, int, int]:
        """Group, and the queue's places from which on to which it has the queue's tokens."""
        low, high, found = 0, self.count - 1, self.last.get(queue)
        if found and found[1] <= place < found[2]:
            return found
        while low < high:  # the last group that starts at or before the place
            middle = (low + high + 1) // 2
            if self.shares.ideal(queue, total, middle * self.size) <= place:
                low = middle
            else:
                high = middle - 1
        begin, end = (self.shares.ideal(queue, total, g * self.size) for g in (low, low + 1))
        self.last[queue] = low, begin, end
        return self.last[queue]


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 0,
    window: int = WINDOW,
    targets: Mapping[str | None, float] | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str | None = "source",
    group: int = GROUP,
) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit), doc_tokens, queue, sequence_id and offset of every piece.

    ``start`` counts the ids of the document before the piece, ``doc_tokens`` all of them with the end id. ``targets`` gives
    weights of sources (None: of rows without one) and, under the key ``OTHERS``, of all that are not named; if that is
    left out, these get their part of all tokens.
    """
    spark = docs.sparkSession
    named = {s: w for s, w in targets.items() if s != OTHERS} if targets is not None else None
    rows = docs.select(F.col(doc_id).alias("doc_id"), _queue(source, named).alias("queue"), F.col(text).alias("text"))
    wide = "<u2" if max(end_id, Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1) < 1 << 16 else "<u4"
    width = int(wide[-1])
    coded = stage(_tokens(rows, path, end_id, wide), "packing-ids")

    out_schema = T.StructType(
        [rows.schema["doc_id"], field("start", "bigint"), field("length", "bigint"), field("ids", "binary"), field("doc_tokens", "bigint")]
        + [field("queue", "string"), field("sequence_id", "bigint"), field("offset", "bigint")]
    )
    # a row for each part and queue; a queue has at most one for each part, so its window is bounded by the parts
    sums = coded.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", "queue", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("queue")).alias("total"))
    offsets = stage(offsets, "packing-offsets")
    tokens = sums.agg(F.sum("n")).first()[0]
    if tokens is None:
        return spark.createDataFrame([], out_schema)
    if targets is None:
        shares = Shares(tokens)
    else:
        # one queue for each weight given, and that of the others
        sizes = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
        weights = {_name(s): Fraction(w) for s, w in named.items()}
        whole, others = sum(weights.values()), Fraction(sizes.get(OTHERS, 0), tokens)
        weights[OTHERS] = Fraction(targets[OTHERS]) if OTHERS in targets else whole * others / (1 - others) if others < 1 else Fraction(1)
        shares = Shares(tokens, sizes, weights)
    size = group * window

    placed = coded.join(offsets, ["part", "queue"]).withColumn("place", F.col("before") + F.col("at"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(shares, size)
        for batch in batches:
            held: dict[int, int] = {}
            for queue, total, place, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while n:
                    at, _, end = groups.at(queue, total, place)
                    k = min(n, end - place)
                    held[at] = held.get(at, 0) + k
                    place, n = place + k, n - k
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["g", "n"])

    held = placed.select("queue", "total", "place", "n").mapInArrow(measure, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    held = stage(held.withColumn("block", F.floor(F.col("g") / BLOCK)), "packing-groups")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.groupBy("block").agg(F.sum("n").alias("m")).select("block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m"))
    inside = Window.partitionBy("block").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    begins = held.join(blocks, "block").select("g", (F.col("m") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("begin"))

    cut_schema = T.StructType(
        [field("g", "bigint"), field("queue", "string"), field("place", "bigint"), field("total", "bigint")]
        + [rows.schema["doc_id"], field("start", "bigint"), field("doc_tokens", "bigint"), field("ids", "binary")]
    )
    cut_arrow = to_arrow_schema(cut_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(shares, size)
        for batch in batches:
            for row in range(0, batch.num_rows, PART_ROWS):
                out = []
                for queue, total, place, key, ids in zip(*(c.to_pylist() for c in batch.slice(row, PART_ROWS).columns), strict=True):
                    n, start = len(ids) // width, 0
                    while start < n:
                        at, _, end = groups.at(queue, total, place)
                        k = min(n - start, end - place)
                        out.append((at, queue, place, total, key, start, n, ids[start * width : (start + k) * width]))
                        place, start = place + k, start + k
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), cut_arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=cut_arrow)

    cuts = placed.select("queue", "total", "place", "doc_id", "ids").mapInArrow(cut, cut_schema)
    # each group is headed by a row with its place in the line
    heads = begins.select("g", F.lit(None).cast("string").alias("queue"), F.col("begin").alias("place"))
    dealt = cuts.unionByName(heads, allowMissingColumns=True).repartition("g").sortWithinPartitions("g", F.col("queue").asc_nulls_first(), "place")
    out_arrow = to_arrow_schema(out_schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []  # the head and the rows of a group

        def close() -> Iterator[pa.RecordBatch]:
            if not open_:
                return
            begin, rows = open_[0][2], open_[1:]
            pieces = _fill([(r[1], r[3], len(r[7]) // width, r[2]) for r in rows], begin, shares, window)
            wide_ids = [np.frombuffer(r[7], wide).astype("<u4").tobytes() for r in rows]
            for at in range(0, len(pieces), 1 << 14):
                out = [
                    (rows[i][4], rows[i][5] + off, k, wide_ids[i][4 * off : 4 * (off + k)], rows[i][6], rows[i][1], number, offset)
                    for i, off, k, number, offset in pieces[at : at + (1 << 14)]
                ]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), out_arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=out_arrow)
            open_.clear()

        for batch in batches:
            for row in range(0, batch.num_rows, PART_ROWS):
                for one in zip(*(c.to_pylist() for c in batch.slice(row, PART_ROWS).columns), strict=True):
                    if one[1] is None:
                        yield from close()
                    open_.append(one)
        yield from close()

    return dealt.mapInArrow(deal, out_schema)
