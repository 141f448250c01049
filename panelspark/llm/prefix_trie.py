"""Prefix trie of conversations: ternary search trees over coded turns, one for each range of sequences.

* **Codes.** A turn is a role and a text; each distinct one gets a number from a dictionary. Texts are digested where they are
  read and never shuffled. Turns that make up more than one in ``HOT`` of all rows, at most ``HOT`` of them, get their
  numbers by a broadcast; all others by a join in which no key has more than that part of the rows.
* **Rebuilding.** ``rebuild`` puts the first turns of the leader of a block of conversations before what a conversation keeps.
* **Shards.** Sequences are sorted by their codes and then by conversation, and dealt by range; a sequence that many
  conversations share goes on from one shard to the next. Each shard holds its distinct sequences in a ternary search
  tree: a node has a code, nodes of lower and of higher codes, and the node of the next turn. Inserting the median of
  the sorted sequences first, then the medians of both halves and so on, balances the nodes of each prefix. One
  iterative traversal lists parents before children; going back over that list adds up members, leaves and savings.
* **Boundary nodes.** Only prefixes of a shard's first and last sequence can occur in other shards. These nodes, two paths a
  shard, are written out unfinished and merged in the order of the shards with a stack as deep as the trie: members
  add up, a node is finished when the next path leaves it. All other nodes are final in their shard.
* **Digests of members.** Where a node's own conversations are all in one shard their digest is taken there; else their ids
  go on as pieces of text in ascending order, and one pass over a node's pieces takes the digest.

A conversation's codes are held in one task; its texts are not. A shard holds its distinct sequences.

Nulls: a null role or text is empty; a null turn comes first; rows without a conversation id belong to none and are left out.
Rows of one turn number go by the digest of role and text, and repeated rows are turns of their own. An empty table
has no node, not even the root. Columns other than the four are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelspark.session import numbered, stage

#: Turns that fill more than one in so many rows are coded by a broadcast; there are fewer than that.
HOT = 1000
#: Characters of joined ids, beyond which they are written as a piece.
PIECE = 1 << 20
#: Conversations in a block, and the number of values that the shared length takes.
BLOCK = 100
SHARED = 6

NODE = "conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
SHARD_SCHEMA = (
    f"kind string, {NODE}, shard int, side int, parent_depth int, code bigint, chars bigint, end_key bigint, piece string"
)
MERGED_SCHEMA = (
    "node bigint, parent bigint, conv_id bigint, depth int, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "ends_sha256 string, places array<struct<shard: int, side: int>>, end_keys array<bigint>"
)


def coded_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, digest, code and chars (code points of the text) of every row with a conversation id."""
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.char_length(said).cast("bigint").alias("chars")
    )
    rows = stage(rows, "trie-turns")
    dictionary = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("times"))
    dictionary = numbered(dictionary, "code", "trie-codes")
    often = F.col("times") * HOT > rows.count()
    hot = rows.join(F.broadcast(dictionary.where(often).drop("times")), "digest", "left")
    rest = hot.where("code is null").drop("code").join(dictionary.where(~often).drop("times"), "digest")
    names = ("conv_id", "turn", "digest", "code", "chars")
    return hot.where("code is not null").select(*names).unionByName(rest.select(*names))


def rebuild(turns: DataFrame) -> DataFrame:
    """conv_id, codes and chars of every conversation: the leader's first turns, then its own after as many.

    The leader of c is c - c % ``BLOCK``; crc32 of c in decimal, modulo ``SHARED``, says how many turns.
    """
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "digest", "code", "chars"))), lambda t: F.struct(t["code"].alias("code"), t["chars"].alias("chars")))
    own = turns.withColumn("block", block).repartition("block").groupBy("block", "conv_id").agg(said.alias("own"))
    own = stage(own, "trie-own")
    leaders = own.where("conv_id = block").select("block", F.slice("own", 1, SHARED - 1).alias("lead"))
    n = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    both = own.join(leaders, "block", "left").withColumn("n", n.cast("int"))
    nothing = F.array().cast("array<struct<code: bigint, chars: bigint>>")
    first = F.slice(F.coalesce("lead", nothing), F.lit(1), F.col("n"))
    after = F.slice("own", F.col("n") + 1, F.greatest(F.size("own"), F.lit(1)))
    whole = both.select("conv_id", F.concat(first, after).alias("all"))
    return whole.select("conv_id", F.col("all.code").alias("codes"), F.col("all.chars").alias("chars"))


def median_order(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of both halves, and so on."""
    ranges = [(0, n)]
    for low, high in ranges:
        if low < high:
            middle = (low + high) // 2
            yield middle
            ranges += [(low, middle), (middle + 1, high)]


class Tree:
    """Ternary search tree of distinct sequences, given in ascending order; node 0 is the empty prefix."""

    def __init__(self) -> None:
        self.code, self.chars = [-1], [0]
        self.low, self.equal, self.high = [-1], [-1], [-1]
        self.n, self.first, self.end = [0], [None], [-1]

    def _new(self, code: int, chars: int) -> int:
        for column, value in ((self.code, code), (self.chars, chars), (self.low, -1), (self.equal, -1), (self.high, -1), (self.n, 0), (self.first, None), (self.end, -1)):
            column.append(value)
        return len(self.code) - 1

    def _count(self, node: int, n: int, first: int) -> None:
        self.n[node] += n
        if self.first[node] is None or first < self.first[node]:
            self.first[node] = first

    def insert(self, codes: Sequence[int], chars: Sequence[int], n: int, first: int, end: int) -> list[int]:
        """Add a sequence with ``n`` members, ``first`` the smallest of them; the nodes on its path."""
        node, path = 0, [0]
        self._count(0, n, first)
        for code, size in zip(codes, chars, strict=True):
            at, links, of = self.equal[node], self.equal, node
            while at >= 0 and self.code[at] != code:
                links, of = (self.low if code < self.code[at] else self.high), at
                at = links[at]
            if at < 0:
                at = links[of] = self._new(code, size)
            node = at
            path.append(node)
            self._count(node, n, first)
        self.end[node] = end
        return path

    def traverse(self) -> tuple[list[int], list[int], list[int]]:
        """All nodes, parents before children, with the parent and depth of each node."""
        parent, depth = [-1] * len(self.code), [0] * len(self.code)
        order, open_ = [0], [(self.equal[0], 0)] if self.equal[0] >= 0 else []
        while open_:
            node, above = open_.pop()
            parent[node], depth[node] = above, depth[above] + 1
            order.append(node)
            open_ += [(at, above) for at in (self.low[node], self.high[node]) if at >= 0]
            if self.equal[node] >= 0:
                open_.append((self.equal[node], node))
        return order, parent, depth


@dataclass
class Group:
    """A distinct sequence in a shard with its members; ids that are not yet written, and the digest of all."""

    codes: list[int]
    chars: list[int]
    first: int
    n: int = 0
    cut: bool = False
    ids: list[str] = field(default_factory=list)
    held: int = 0
    head: int = 0


COLUMNS = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]


def _shard(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    shard, groups, rows = TaskContext.get().partitionId(), [], []
    digests: list[str | None] = []

    def out(kind: str, **values) -> None:
        rows.append({"kind": kind, "shard": shard, **values})

    def flush(force: bool = False) -> Iterator[pa.RecordBatch]:
        if rows and (force or len(rows) >= 4096 or rows[-1].get("piece")):
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows.clear()

    def key(number: int) -> int:
        return (shard << 32) + number

    def write(number: int) -> None:
        """The ids that a sequence holds, as a piece."""
        group = groups[number]
        if group.ids:
            out("piece", end_key=key(number), conv_id=group.head, piece=",".join(group.ids))
        group.cut, group.ids, group.held = True, [], 0

    def close(whole: bool) -> None:
        """The last sequence is complete in this shard (``whole``) or may have members in others."""
        number = len(groups) - 1
        group = groups[number]
        if group.cut or not whole:
            write(number)
            digests.append(None)
        else:
            digests.append(hashlib.sha256(",".join(group.ids).encode()).hexdigest())
            group.ids = []

    for batch in batches:
        for codes, chars, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not groups or groups[-1].codes != codes:
                if groups:
                    close(len(groups) > 1)
                    yield from flush()
                groups.append(Group(codes, chars, conv_id))
            group = groups[-1]
            if not group.ids:
                group.head = conv_id
            group.n += 1
            group.ids.append(str(conv_id))
            group.held += len(group.ids[-1]) + 1
            if group.held >= PIECE:
                write(len(groups) - 1)
                yield from flush()
    if not groups:
        return
    close(False)

    tree, paths = Tree(), {}
    for i in median_order(len(groups)):
        path = tree.insert(groups[i].codes, groups[i].chars, groups[i].n, groups[i].first, i)
        if i in (0, len(groups) - 1):
            paths[i] = path
    order, parent, depth = tree.traverse()
    place = {node: (0, d) for d, node in enumerate(paths[0])}
    for d, node in enumerate(paths[len(groups) - 1]):
        place.setdefault(node, (1, d))
    size = len(order)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in reversed(order):
        if node not in place:
            leaves[node] = leaves[node] or 1
            saved[node] += (tree.n[node] - 1) * tree.chars[node]
            above = parent[node]
            children[above] += 1
            leaves[above] += leaves[node]
            saved[above] += saved[node]
    for node in order:
        end = tree.end[node]
        sums = {"conv_id": tree.first[node], "depth": depth[node], "n_convs": tree.n[node], "n_children": children[node], "n_leaves": leaves[node], "saved_tokens": saved[node]}
        end_key = key(end) if end >= 0 and digests[end] is None else None
        if node in place:
            whole = digests[end] if end >= 0 else None
            out("edge", **sums, side=place[node][0], code=tree.code[node], chars=tree.chars[node], ends_sha256=whole, end_key=end_key)
        else:
            digest = hashlib.sha256().hexdigest() if end < 0 else digests[end]
            above = parent[node]
            if above in place:
                out("node", **sums, ends_sha256=digest, end_key=end_key, side=place[above][0], parent_depth=depth[above])
            else:
                out("node", **sums, ends_sha256=digest, end_key=end_key, parent_conv_id=tree.first[above])
        yield from flush()
    yield from flush(True)


class Open:
    """A boundary node that the next path may still enter."""

    def __init__(self, number: int, parent: int, depth: int, code: int) -> None:
        self.number, self.parent, self.depth, self.code = number, parent, depth, code
        self.n = self.children = self.leaves = self.saved = self.chars = 0
        self.first, self.digest, self.places, self.ends = None, None, [], []


def _merge(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Merged boundary nodes, from rows (shard, side, depth, code, ...) in the order of shard, side and depth."""
    stack: list[Open] = []
    rows, numbers = [], 0

    def close(depth: int) -> None:
        """Finish the nodes at ``depth`` and deeper."""
        while len(stack) > depth:
            node = stack.pop()
            if not node.children:
                node.leaves = 1
            node.saved += (node.n - 1) * node.chars
            if stack:
                above = stack[-1]
                above.children += 1
                above.leaves += node.leaves
                above.saved += node.saved
            rows.append(
                {
                    "node": node.number, "parent": node.parent, "conv_id": node.first, "depth": node.depth, "n_convs": node.n, "n_children": node.children,
                    "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": node.digest, "places": node.places, "end_keys": node.ends,
                }
            )

    for batch in batches:
        for r in batch.to_pylist():
            depth = r["depth"]
            if depth < len(stack) and stack[depth].code != r["code"]:
                close(depth)
            if depth == len(stack):
                stack.append(Open(numbers, stack[-1].number if stack else -1, depth, r["code"]))
                numbers += 1
            node = stack[depth]
            node.n += r["n_convs"]
            node.first = r["conv_id"] if node.first is None else min(node.first, r["conv_id"])
            node.children += r["n_children"]
            node.leaves += r["n_leaves"]
            node.saved += r["saved_tokens"]
            node.chars = r["chars"]
            node.places.append({"shard": r["shard"], "side": r["side"]})
            node.digest = node.digest or r["ends_sha256"]  # of a sequence that is whole in its shard
            if r["end_key"] is not None:
                node.ends.append(r["end_key"])
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows.clear()
    close(0)
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, depth and the digest of all pieces of each node, from rows sorted by node and first id."""
    names, kinds = ["conv_id", "depth", "found_sha256"], [pa.int64(), pa.int32(), pa.string()]
    node, state = None, None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    for batch in batches:
        done = []
        for conv_id, depth, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv_id, depth) != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (conv_id, depth), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield rows(done)
    if node:
        yield rows([(*node, state.hexdigest())])


def trie(sequences: DataFrame) -> DataFrame:
    """A row (``NODE``) for each prefix of the sequences (conv_id, codes, chars)."""
    shard_arrow, merged_arrow = (to_arrow_schema(T._parse_datatype_string(s)) for s in (SHARD_SCHEMA, MERGED_SCHEMA))
    stored = stage(sequences.select("codes", "chars", "conv_id"), "trie-sequences")
    dealt = stored.repartitionByRange("codes", "conv_id").sortWithinPartitions("codes", "conv_id")
    parts = stage(dealt.mapInArrow(lambda batches: _shard(batches, shard_arrow), SHARD_SCHEMA), "trie-shards")

    # two paths a shard, whatever the number of conversations
    edges = parts.where("kind = 'edge'").select("shard", "side", "depth", "code", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars", "ends_sha256", "end_key")
    edges = edges.repartition(1).sortWithinPartitions("shard", "side", "depth")
    merged = stage(edges.mapInArrow(lambda batches: _merge(batches, merged_arrow), MERGED_SCHEMA), "trie-merged")

    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = F.coalesce("ends_sha256", F.when(F.size("end_keys") == 0, F.lit(hashlib.sha256().hexdigest())))
    columns = [c.split()[0] for c in NODE.split(", ")]
    shared = merged.join(above, "parent", "left").withColumn("ends_sha256", ends)
    inner = parts.where("kind = 'node'")
    tops = merged.select(F.col("depth").alias("parent_depth"), F.col("conv_id").alias("top"), F.explode("places").alias("p"))
    tops = tops.select("parent_depth", "top", F.col("p.shard").alias("shard"), F.col("p.side").alias("side"))
    below = inner.where("side is not null").drop("parent_conv_id").join(tops, ["shard", "side", "parent_depth"]).withColumnRenamed("top", "parent_conv_id")
    nodes = shared.select(*columns).unionByName(inner.where("side is null").select(*columns)).unionByName(below.select(*columns))

    # nodes whose members were written as pieces
    keyed = merged.select("conv_id", "depth", F.explode("end_keys").alias("end_key")).unionByName(inner.where("end_key is not null").select("conv_id", "depth", "end_key"))
    pieces = parts.where("kind = 'piece'").select("end_key", F.col("conv_id").alias("head"), "piece").join(keyed, "end_key")
    pieces = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "head").select("conv_id", "depth", "piece")
    found = pieces.mapInArrow(_digest, "conv_id bigint, depth int, found_sha256 string")
    late = nodes.where("ends_sha256 is null").drop("ends_sha256").join(found, ["conv_id", "depth"]).withColumnRenamed("found_sha256", "ends_sha256")
    return nodes.where("ends_sha256 is not null").unionByName(late.select(*columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(rebuild(coded_turns(conversations)))


#: The same rows in DuckDB; the cyclic redundancy check goes bit by bit.
SQL = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc(c, k, v) AS (
  SELECT c, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT c, k + 1, xor(w >> 1, CASE WHEN w & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT c, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(substr(CAST(c AS VARCHAR), k // 8 + 1, 1)) AS BIGINT)) ELSE v END AS w
    FROM crc WHERE k < 8 * length(CAST(c AS VARCHAR)))),
shared AS (SELECT c, xor(v, 4294967295) % {SHARED} AS h FROM crc WHERE k = 8 * length(CAST(c AS VARCHAR))),
said AS (
  SELECT conv_id AS c, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS s,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT h.c, said.i, said.s FROM shared h JOIN said ON said.c = h.c - h.c % {BLOCK} AND said.i <= h.h
  UNION ALL
  SELECT h.c, said.i, said.s FROM shared h JOIN said ON said.c = h.c AND said.i > h.h),
lists AS (SELECT ids.c, coalesce(list(s ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS l FROM ids LEFT JOIN rebuilt USING (c) GROUP BY ids.c),
members AS (SELECT c, d, l[1:d] AS p, len(l) = d AS ends FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM lists)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ended,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(p[d].t) END AS own
  FROM members GROUP BY p, d),
kin AS (
  SELECT a.p, a.d, a.conv_id, a.n, a.ended, any_value(u.conv_id) AS above, count(b.p) AS kids
  FROM nodes a LEFT JOIN nodes u ON a.d > 0 AND u.d = a.d - 1 AND u.p = a.p[1 : a.d - 1] LEFT JOIN nodes b ON b.d = a.d + 1 AND b.p[1 : a.d] = a.p
  GROUP BY a.p, a.d, a.conv_id, a.n, a.ended),
under AS (
  SELECT x[1:k] AS p, k AS d, sum(own) AS saved, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT nodes.p AS x, own, kids, unnest(range(nodes.d + 1)) AS k FROM nodes JOIN kin ON nodes.p = kin.p) GROUP BY 1, 2)
SELECT kin.conv_id, kin.d AS depth, kin.above AS parent_conv_id, kin.n AS n_convs, kin.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(kin.ended) AS ends_sha256
FROM kin JOIN under ON under.d = kin.d AND under.p = kin.p
"""
