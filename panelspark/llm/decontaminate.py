"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of letters and digits after A-Z is lower-cased (any other character beyond ASCII counts as a
letter). Each run of ``WINDOW`` words of a benchmark item is a test string; an item of fewer words is one by itself. Test
strings of one length are searched together: a shift table tells for the last two words of the place looked at how far
the search may go on, since no test string holds these words further right; where it says zero, the bucket
of the strings that end in these two words is opened and the words there are compared with its strings directly.

The test strings go to the executors in blocks of at most about ``BLOCK`` strings, each block's bound known before it is
sent. With one block a single pass over the documents gives the result; with more, each block has a pass of its own and
the hits, which are few, are joined by the place of the row.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import as_bytes, field, keep_rows, map_texts
from panelspark.session import stage

WINDOW = 13
#: Pairs of item and test string in a block.
BLOCK = 200_000
#: A text is contaminated if one in so many of its words, or more, is inside a test string.
ONE_IN = 20

#: Word bytes (letters lower-cased), all else a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Found = tuple[list[tuple[int, int]], set[int]]


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def windows(text: bytes | None) -> list[bytes]:
    """The test strings of an item, their words joined by a space."""
    w = words(text)
    return [b" ".join(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))] if w else []


class Search:
    """Test strings of ``size`` words; ``strings`` maps each one to the ids of its items."""

    def __init__(self, size: int, strings: dict[bytes, list[int]]) -> None:
        self.size, self.block = size, min(2, size)
        self.default = size - self.block + 1
        self.shift: dict[bytes | tuple[bytes, bytes], int] = {}
        self.buckets: dict[bytes | tuple[bytes, bytes], dict[bytes, list[int]]] = defaultdict(dict)
        for string, items in strings.items():
            w = string.split(b" ")
            for end in range(self.block, size + 1):
                key = self._key(w, end - 1)
                self.shift[key] = min(size - end, self.shift.get(key, self.default))
            self.buckets[self._key(w, size - 1)][string] = items

    def _key(self, w: list[bytes], at: int) -> bytes | tuple[bytes, bytes]:
        return w[at] if self.block == 1 else (w[at - 1], w[at])

    def find(self, w: list[bytes]) -> Iterable[tuple[int, list[int]]]:
        """(end, items) of every occurrence in the words ``w``; it covers the ``size`` words before ``end``."""
        at, n, size, default, shift, pairs = self.size - 1, len(w), self.size, self.default, self.shift, self.block == 2
        while at < n:
            key = (w[at - 1], w[at]) if pairs else w[at]
            skip = shift.get(key, default)
            if skip:
                at += skip
                continue
            items = self.buckets[key].get(b" ".join(w[at - size + 1 : at + 1]))
            if items is not None:
                yield at + 1, items
            at += 1


def searches(strings: Iterable[tuple[bytes, list[int]]]) -> list[Search]:
    """One search for each length among the test strings."""
    by_size: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
    for string, items in strings:
        by_size[string.count(b" ") + 1][string] = items
    return [Search(size, found) for size, found in sorted(by_size.items())]


def occurrences(w: list[bytes], tables: list[Search]) -> Found:
    """Disjoint ascending ranges of the words inside test strings, and the ids of the items hit."""
    ranges, items = [], set()
    for table in tables:
        for end, ids in table.find(w):
            ranges.append((end - table.size, end))
            items.update(ids)
    return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and ONE_IN * n_hit >= n_words


class Strings:
    """All test strings of a benchmark table, in blocks.

    Items with a null or wordless text have none. Items with a null id mark words as hit but are not listed.
    """

    def __init__(self, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block: int = BLOCK) -> None:
        def start():
            return lambda texts: [[[s.decode() for s in windows(t)] for t in as_bytes(texts)]]

        found = map_texts(benchmark, text, (item_id,), [field("strings", "array<string>")], start)
        #: SQL type of item ids
        self.kind = benchmark.schema[item_id].dataType.simpleString()
        pairs = found.select(F.col(item_id).alias("item"), F.explode("strings").alias("string")).distinct()
        self.pairs = stage(pairs, "test-strings")
        self.blocks = max(1, math.ceil(self.pairs.count() / block))

    def block(self, number: int) -> list[tuple[bytes, list[int]]]:
        """(string, ids of its items) of one block; all items of a string are in the same block."""
        part = self.pairs.where(F.pmod(F.xxhash64("string"), F.lit(self.blocks)) == number)
        rows = part.groupBy("string").agg(F.sort_array(F.collect_set("item")).alias("items")).collect()
        return [(r["string"].encode(), r["items"]) for r in rows]


def _finder(strings):
    """A task's search over texts; ``strings`` is the block's broadcast."""

    def start():
        tables = searches(strings.value)

        def work(texts: pa.Array):
            all_words = [words(t) for t in as_bytes(texts)]
            found = [occurrences(w, tables) for w in all_words]
            ranges = [[{"start": a, "end": b} for a, b in r] for r, _ in found]
            return [len(w) for w in all_words], ranges, [sorted(i) for _, i in found]

        return work

    return start


def _fields(strings: Strings) -> list:
    return [field("n_words", "bigint"), field("hits", "array<struct<start:int,end:int>>"), field("items", f"array<{strings.kind}>")]


def find(docs: DataFrame, strings: Strings, text: str = "text", passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``passed`` columns, n_words, hits (ranges of words inside test strings) and items (ids, ascending) of every row.

    A null text has no words. Repeated rows each give a row.
    """
    send = docs.sparkSession.sparkContext.broadcast
    if strings.blocks == 1:
        return map_texts(docs, text, passed, _fields(strings), _finder(send(strings.block(0))))
    stored = stage(docs.select(*passed, F.col(text).alias("_text")), "texts")
    placed = stored.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    hits = None
    for number in range(strings.blocks):
        block = map_texts(placed, "_text", ("_file", "_row"), _fields(strings), _finder(send(strings.block(number)))).where(F.size("hits") > 0)
        hits = block if hits is None else hits.unionByName(block)
    hits = hits.groupBy("_file", "_row").agg(
        F.flatten(F.collect_list("hits")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )

    def start():
        return lambda texts: [[len(words(t)) for t in as_bytes(texts)]]

    counted = map_texts(placed, "_text", (*passed, "_file", "_row"), _fields(strings)[:1], start)
    out = counted.join(hits, ["_file", "_row"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        *passed, "n_words", _merged(F.coalesce("ranges", none)).alias("hits"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items")
    )


def _merged(ranges: Column) -> Column:
    """Disjoint ascending ranges with the same words."""

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        meets = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= r["start"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<start:int,end:int>>"), add)


def keep_clean(docs: DataFrame, strings: Strings, text: str = "text") -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    send = docs.sparkSession.sparkContext.broadcast
    if strings.blocks == 1:
        block = send(strings.block(0))

        def start():
            tables = searches(block.value)

            def work(texts: pa.Array):
                out = []
                for t in as_bytes(texts):
                    w = words(t)
                    out.append(not contaminated(sum(b - a for a, b in occurrences(w, tables)[0]), len(w)))
                return out

            return work

        return keep_rows(docs, text, start)
    stored = stage(docs, "documents")
    key = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    judged = find(stored.select(text, *key), strings, text, ("file", "row"))
    bad = judged.where(n_hit() * ONE_IN >= F.col("n_words")).where(n_hit() > 0).select("file", "row")
    here = (F.col("_metadata.file_name") == bad["file"]) & (F.col("_metadata.row_index") == bad["row"])
    return stored.join(bad, here, "left_anti")


def n_hit() -> Column:
    """Words inside test strings, from the column ``hits``."""
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
