"""The conversation trie against a plain version and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from panelspark.llm import prefix_trie, queries


def plain(rows):
    """Nodes of the trie of rows (conv_id, turn, role, text), by dictionaries of prefixes."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [said for _, said in sorted(t)] for c, t in turns.items()}
    built = {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + own[c][h:] for c in own}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(nodes):
    return sorted((tuple(r) for r in nodes.select(*COLUMNS).collect()), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def made():
    """Copies, shared starts, nulls, ties and a conversation whose leader is longer; ids of one digit to seven."""
    rnd = random.Random(5)
    rows = []
    for c in [*range(0, 420), 1_000_000, 1_000_001, 7_654_399]:
        start = rnd.choice(["hello", "hi", "hello", ""])
        for i in range(rnd.choice([1, 2, 3, 7])):
            text = start if i == 0 else rnd.choice(["yes", "no", "naïve 👍🏽", None, ""]) if i < 3 else f"turn {rnd.randint(0, 3)}"
            rows.append((c, None if rnd.random() < 0.05 else i, rnd.choice(["user", "user", None]), text))
        if c % 3 == 0:
            rows = [r for r in rows if r[0] != c] + [(c, 0, "user", "the same"), (c, 1, "assistant", "for all")]
    rows += [(5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "tool", "tie"), (None, 0, "user", "of none"), (None, None, None, None)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shards", [1, 3, 17])
def test_trie_is_that_of_a_plain_version(spark, made, shards, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame(made, SCHEMA).repartition(3)
        assert found(prefix_trie.conversation_trie(turns)) == plain(made)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_and_sql(spark, sf, made, tmp_path):
    assert not differences(queries.op12_prefix_trie(spark, sf), connect(sf), prefix_trie.SQL)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", made)
    got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.SQL}) ORDER BY 1, 2").fetchall()
    assert got == plain(made)


def test_empty_table_long_text_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(prefix_trie.conversation_trie(none)) == []
    rows = [(200, 0, "user", "é" * 300_000), (201, 0, "user", "é" * 300_000), (201, 1, None, None)]
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit(1), "Code": F.lit("x"), "block": F.lit(None), "own": F.lit(0)})
    assert found(prefix_trie.conversation_trie(turns)) == plain(rows)


def test_conversations_of_null_rows_and_without_turns(spark):
    # 301 borrows from a conversation that is not there
    rows = [(301, None, None, None), (302, None, None, None), (302, None, None, None)]
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_median_order_balances_the_tree():
    assert sorted(prefix_trie.median_order(100)) == list(range(100))
    tree = prefix_trie.Tree()
    for i in prefix_trie.median_order(1023):
        tree.insert([i], [1], 1, i, i)
    depth, open_ = 0, [(tree.equal[0], 1)]
    while open_:
        node, at = open_.pop()
        if node >= 0:
            depth = max(depth, at)
            open_ += [(tree.low[node], at + 1), (tree.high[node], at + 1)]
    assert depth == 10
