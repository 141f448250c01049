"""Packed sequences: every id once, no padding, proportions in every window."""

import os
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import packing, queries
from panelspark.llm.common import table

os.environ["TOKENIZERS_PARALLELISM"] = "false"
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def check_sequences(rows, window=packing.WINDOW):
    """Offsets without gaps; full windows, then powers of two."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    lengths = []
    for number in range(len(sequences)):
        at = 0
        for offset, length in sorted(sequences[number]):
            assert offset == at and length > 0
            at += length
        lengths.append(at)
    short = [n for n in lengths if n != window]
    assert lengths == [window] * (len(lengths) - len(short)) + short and len(short) == len(set(short))
    assert all(n < window and n & (n - 1) == 0 for n in short)
    return lengths


def test_query_has_every_id_once(spark, sf, library):
    rows = queries.op11_packing(spark, sf).collect()
    check_sequences(rows)
    docs = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in table(spark, sf, "documents").collect()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == docs.keys()
    for doc_id, ids in docs.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def shares_by_window(rows):
    held = defaultdict(lambda: defaultdict(int))
    for r in rows:
        held[r.sequence_id][r.queue] += r.length
    return held


@pytest.mark.parametrize("group", [1, 3, 256])
def test_windows_keep_the_proportions(spark, sf, group):
    """What each source has given never strays far from its share, over the edges of groups as well."""
    docs = table(spark, sf, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = packing.pack(docs, JSON, group=group).drop("ids").collect()
    lengths, held = check_sequences(rows), shares_by_window(rows)
    total, sums = sum(lengths), defaultdict(int)
    for by in held.values():
        for queue, n in by.items():
            sums[queue] += n
    given, place = dict.fromkeys(sums, 0), 0
    for number, length in enumerate(lengths):
        place += length
        for queue in sums:
            given[queue] += held[number][queue]
            # a queue waits until it is MIN_PIECE behind and is at most that far ahead, but for what a full window keeps back
            assert abs(given[queue] - sums[queue] * place / total) < 3 * packing.MIN_PIECE, (number, queue)


def test_targets_until_a_queue_is_empty(spark, sf):
    docs = table(spark, sf, "documents")
    targets = {"src1": 3.0, "src2": 1.0, packing.OTHERS: 4.0}
    rows = packing.pack(docs, JSON, targets=targets, group=5).drop("ids").collect()
    lengths, held = check_sequences(rows), shares_by_window(rows)
    sums, given = defaultdict(int), defaultdict(int)
    for by in held.values():
        for queue, n in by.items():
            sums[queue] += n
    assert set(sums) == {"=src1", "=src2", packing.OTHERS}
    place, compared = 0, 0
    for number, length in enumerate(lengths):
        place += length
        for queue, n in held[number].items():
            given[queue] += n
        if all(given[q] < sums[q] - packing.WINDOW for q in sums):
            compared += 1
            for queue, share in (("=src1", 3 / 8), ("=src2", 1 / 8), (packing.OTHERS, 4 / 8)):
                assert abs(given[queue] - share * place) < 3 * packing.MIN_PIECE
    assert compared > 10
    natural = packing.pack(docs, JSON, targets={"src1": 1.0, "none such": 0.0}).drop("ids").collect()
    assert sum(r.length for r in natural) == sum(lengths)


def test_shares_add_up():
    sizes = {"=a": 1000, "=b": 50, "others": 300}
    shares = packing.Shares(1350, sizes, {"=a": Fraction(1), "=b": Fraction(1), "others": Fraction(0)})
    assert [shares.ideal(q, n, 1350) for q, n in sizes.items()] == [1000, 50, 300]
    assert [shares.ideal(q, n, 100) for q, n in sizes.items()] == [50, 50, 0]
    assert [shares.ideal(q, n, 1200) for q, n in sizes.items()] == [1000, 50, 150]


def test_odd_rows(odd, empty, library):
    rows = packing.pack(odd, JSON, window=64, group=2).collect()
    check_sequences(rows, 64)
    by_id = defaultdict(int)
    for r in rows:
        by_id[r.doc_id] += r.length
    want = defaultdict(int)
    for r in odd.collect():
        want[r.doc_id] += 1 + len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert by_id == want and {r.queue for r in rows} == {"", "=src0", "=src1"}
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(empty, JSON).collect() == []
    clash = odd.withColumns({"queue": F.lit(1), "G": F.lit(2), "place": F.lit("x"), "ids": F.lit(None)})
    assert {r.queue for r in packing.pack(clash, JSON, source=None).collect()} == {""}
