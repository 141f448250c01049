"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model reads characters as they are: every code point is a symbol of its own, and a character that trusted text doesn't
have gets its share of a uniform distribution over all code points. So the tables of n-grams grow with the trusted text;
they are Spark tables throughout, dealt by n-gram, and none goes through the driver.

* **Counts** of the longest n-grams are added up by n-gram, after each task has added up its own in parts of ``PART``
  characters. Lower orders count different left neighbours (Kneser-Ney).
* **Probabilities**: joins of these tables by n-gram and by context give each n-gram's interpolated probability, with one
  discount each for counts of one, two, and three or more, estimated from the counts of counts of its order.
* **Scores**: documents are put into chunks of about ``CHUNK`` characters. The different n-grams of each chunk, however often it
  has them, are joined with the tables of probabilities; those not seen in trusted text are joined with what is left
  over of their context and go on to the shorter n-gram. A frequent n-gram so has a row for each chunk at most, not for
  each place. What comes out goes back to its chunk, where every character of every document is scored.

A document's score is the perplexity of all its characters; it is kept if the score is at most the ``KEEP`` quantile of the
trusted documents of its language (or of all, where the language has none).
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelspark.llm.common import field
from panelspark.session import stage

ORDER = 4
SYMBOLS = 32
#: Share of the trusted documents of a language that its threshold lets pass.
KEEP = 0.99
#: Accuracy of the quantiles: a rank is off by at most the rows over this.
ACCURACY = 10_000
#: Trusted ids that may be broadcast (8 bytes each); beyond it the join is shuffled.
MAX_SENT_IDS = 2_000_000
#: Characters whose n-grams are told apart together, and characters of a chunk of documents, both at least.
PART, CHUNK = 1 << 20, 1 << 25
#: Bytes of a symbol in an n-gram, the highest first.
WIDE = 3

OTHER_LETTER, DIGIT, SPACE, MARK, ELSE = 26, 27, 28, 29, 30
BEGIN = 31


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, ELSE, np.int64)
    for code in range(0x110000):
        char = chr(code)
        if char.isspace():
            out[code] = SPACE
        elif char in ".,;:?!'\"()-":
            out[code] = MARK
        elif char.isdigit():
            out[code] = DIGIT
        elif char.isalpha():
            base = unicodedata.normalize("NFD", char)[0].lower() if code < 0x2000 else char
            out[code] = ord(base) - 97 if "a" <= base <= "z" else OTHER_LETTER
    return out


@dataclass(frozen=True)
class Alphabet:
    """The symbols of code points, the mark that stands before a text, and the number of symbols that may follow others."""

    begin: int
    size: int
    symbols: Callable[[np.ndarray], np.ndarray] | None = None


CHARACTERS = Alphabet(0x110000, 0x110000)
#: Letters by their Latin base, all else in a few classes: tables that are small enough to be looked at whole (``fit``).
CLASSES = Alphabet(BEGIN, SYMBOLS, lambda codes: _classes()[codes])


def _grams(texts: list[str | None], order: int, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams of the texts (as bytes), how often each ends at a character, and for each character its n-gram and text."""
    sizes = np.array([len(t or "") for t in texts], np.int64)
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), sizes)
    if not len(codes):
        return np.zeros(0, f"S{WIDE * order}"), np.zeros(0, np.int64), np.zeros(0, np.int64), owner
    # marks before each text, so that an n-gram holds characters of one text only
    line = np.full(len(codes) + len(texts) * (order - 1), alphabet.begin, np.int64)
    places = np.arange(len(codes)) + (owner + 1) * (order - 1)
    line[places] = alphabet.symbols(codes) if alphabet.symbols else codes
    known = np.zeros(max(int(line.max()), alphabet.begin) + 1, np.int64)
    known[line] = 1
    own = int(known.sum())
    number = (np.cumsum(known) - 1)[line]
    code, bound = np.zeros(len(places), np.int64), 1
    for k in range(order - 1, -1, -1):
        if bound * own >= 1 << 62:  # many symbols: numbers of the shorter n-grams that there are
            seen, code = np.unique(code, return_inverse=True)
            bound = len(seen)
        code = code * own + number[places - k]
        bound *= own
    _, first, which, counts = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    symbols = line[places[first][:, None] + np.arange(1 - order, 1)].astype(">u4")
    packed = np.ascontiguousarray(symbols.view(np.uint8).reshape(len(first), order, 4)[:, :, 4 - WIDE :])
    return packed.reshape(len(first), -1).view(f"S{WIDE * order}").ravel(), counts, which, owner


def _binary(grams: np.ndarray) -> pa.Array:
    """Fixed-width bytes as an Arrow column of their whole width."""
    width = grams.dtype.itemsize
    data = np.ascontiguousarray(grams)
    ends = pa.py_buffer(np.arange(0, (len(data) + 1) * width, width, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, ends, pa.py_buffer(data.tobytes())])


def _front(gram: str, n: int) -> Column:
    """The first ``n`` symbols of a column of n-grams."""
    return F.substring(gram, 1, WIDE * n)


def _back(gram: str) -> Column:
    """All symbols but the first."""
    return F.expr(f"substring({gram}, {WIDE + 1})")


def _parts(batches: Iterator[pa.RecordBatch], at_column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end as soon as they have ``PART`` characters."""
    for batch in batches:
        sizes = np.array([len(t or "") for t in batch.column(at_column).to_pylist()], np.int64)
        before = np.cumsum(sizes) - sizes
        cuts = [0, *(np.flatnonzero(np.diff(before // PART)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def _counts(texts: DataFrame, order: int, alphabet: Alphabet) -> DataFrame:
    """(gram, c): how often each n-gram stands in the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 0):
            grams, counts, _, _ = _grams(part.column(0).to_pylist(), order, alphabet)
            yield pa.RecordBatch.from_arrays([_binary(grams), pa.array(counts)], ["gram", "c"])

    return texts.select("text").mapInArrow(run, "gram binary, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2 and 3 or more, from the number of n-grams counted once to four times."""
    n = dict(counts.where("c <= 4").groupBy("c").count().collect())
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):  # too little text to tell them apart
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.9) for k, d in enumerate(found))


@dataclass(frozen=True)
class Tables:
    """``seen``: for each order from 1, (gram, p) of the n-grams of trusted text; ``left``: (context, rest), what their discounts left over."""

    alphabet: Alphabet
    seen: list[DataFrame]
    left: list[DataFrame]


def tables(trusted: DataFrame, order: int = ORDER, alphabet: Alphabet = CHARACTERS) -> Tables:
    """The model of the texts of ``trusted`` (column ``text``)."""
    counts = {order: stage(_counts(trusted, order, alphabet), "ngrams")}
    for n in range(order - 1, 0, -1):
        # different left neighbours of each shorter n-gram
        counts[n] = stage(counts[n + 1].groupBy(_back("gram").alias("gram")).agg(F.count(F.lit(1)).alias("c")), "order")
    seen, left = [], []
    for n in range(1, order + 1):
        d1, d2, d3 = _discounts(counts[n])
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        table = counts[n].withColumns({"context": _front("gram", n - 1), "cut": cut})
        sums = stage(table.groupBy("context").agg(F.sum("c").alias("total"), F.sum("cut").alias("lost")), "contexts")
        own = table.join(sums, "context").select("gram", ((F.col("c") - F.col("cut")) / F.col("total")).alias("p"), (F.col("lost") / F.col("total")).alias("rest"))
        if n > 1:
            shorter = seen[-1].select(F.col("gram").alias("shorter"), F.col("p").alias("q"))
            own = own.withColumn("shorter", _back("gram")).join(shorter, "shorter")
        else:
            own = own.withColumn("q", F.lit(1 / alphabet.size))
        seen.append(stage(own.select("gram", (F.col("p") + F.col("rest") * F.col("q")).alias("p")), "probabilities"))
        left.append(sums.select("context", (F.col("lost") / F.col("total")).alias("rest")))
    return Tables(alphabet, seen, left)


def probabilities(asked: DataFrame, model: Tables, n: int) -> DataFrame:
    """(gram, p) of all different n-grams of length ``n`` in ``asked`` (gram), seen in trusted text or not."""
    if not n:
        return asked.select("gram", F.lit(1 / model.alphabet.size).alias("p"))
    found = stage(asked.join(model.seen[n - 1], "gram", "left"), "asked")
    # those not seen get what is left over of their context, and the shorter one's probability of that
    unseen = found.where("p is null").select("gram", _front("gram", n - 1).alias("context"), _back("gram").alias("shorter"))
    unseen = stage(unseen.join(model.left[n - 1], "context", "left").select("gram", "shorter", F.coalesce("rest", F.lit(1.0)).alias("rest")), "unseen")
    shorter = probabilities(unseen.select(F.col("shorter").alias("gram")).distinct(), model, n - 1)
    unseen = unseen.join(shorter.select(F.col("gram").alias("shorter"), "p"), "shorter")
    return stage(found.where("p is not null").unionByName(unseen.select("gram", (F.col("rest") * F.col("p")).alias("p"))), "probable")


@dataclass(frozen=True)
class Model:
    """``logs``: the natural logarithm of each n-gram's probability, by its code, for all of them, seen or not."""

    order: int
    logs: np.ndarray


def fit(trusted: DataFrame, order: int = ORDER) -> Model | None:
    """The same model over ``CLASSES``, written out for all n-grams; None if the texts have no character. To look at, not to score with."""
    model = tables(trusted, order, CLASSES)
    if model.seen[0].isEmpty():
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            symbols = np.stack([number // SYMBOLS**k % SYMBOLS for k in range(order - 1, -1, -1)], 1).astype(">u4")
            packed = np.ascontiguousarray(symbols.view(np.uint8).reshape(len(number), order, 4)[:, :, 4 - WIDE :])
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(packed.reshape(len(number), -1).view(f"S{WIDE * order}").ravel())], ["id", "gram"])

    every = stage(trusted.sparkSession.range(SYMBOLS**order).mapInArrow(run, "id bigint, gram binary"), "every")
    rows = every.join(probabilities(every.select("gram"), model, order), "gram").select("id", "p").toPandas()
    logs = np.zeros(SYMBOLS**order, np.float32)
    logs[rows["id"].to_numpy()] = np.log(rows["p"].to_numpy())
    return Model(order, logs)


def _chunked(docs: DataFrame, text: str, passed: tuple[str, ...], order: int, alphabet: Alphabet) -> DataFrame:
    """Rows of two kinds: (chunk, gram) for each different n-gram of a chunk, and (chunk, part), some of its rows with their texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
        chunk, size, held = None, 0, np.zeros(0, f"S{WIDE * order}")

        def of_chunk() -> pa.RecordBatch:
            column = _binary(held)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), chunk)), column, pa.nulls(len(held), pa.binary())], ["chunk", "gram", "part"])

        # a row's number tells its task, so that no two tasks name a chunk alike
        for part in _parts(batches, 1):
            if chunk is None:
                chunk = part.column(0)[0].as_py()
            texts = part.column(1).to_pylist()
            held = np.union1d(held, _grams(texts, order, alphabet)[0])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, part.schema, options=packing) as writer:
                writer.write_batch(part)
            packed = pa.array([out.getvalue().to_pybytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.nulls(1, pa.binary()), packed], ["chunk", "gram", "part"])
            size += sum(len(t or "") for t in texts)
            if size >= CHUNK:
                yield of_chunk()
                chunk, size, held = None, 0, held[:0]
        if chunk is not None:
            yield of_chunk()

    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"), *(F.col(c) for c in passed))
    return numbered.mapInArrow(run, "chunk bigint, gram binary, part binary")


def perplexities(docs: DataFrame, model: Tables, text: str = "text", passed: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """``passed`` columns, n_chars and perplexity of every row's whole text; null for a null or empty text or without a model."""
    order, alphabet = len(model.seen), model.alphabet
    chunks = stage(_chunked(docs, text, passed, order, alphabet), "chunks", compression="zstd")
    asked = chunks.where("gram is not null").select("chunk", "gram")
    known = probabilities(asked.select("gram").distinct(), model, order)
    empty = model.seen[0].isEmpty()
    dealt = asked.join(known, "gram").select("chunk", "gram", F.log("p").cast("float").alias("log"), F.lit(None).cast("binary").alias("part"))
    dealt = dealt.unionByName(chunks.where("part is not null").select("chunk", "gram", F.lit(None).cast("float").alias("log"), "part"))
    dealt = dealt.repartition("chunk").sortWithinPartitions("chunk", F.col("part").isNotNull())
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in passed] + [field("n_chars", "bigint"), field("perplexity", "double")])
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, blocks, lookup = None, [], None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            filled = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (filled[1:] != filled[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b <= a:
                    continue
                if ids[a] != chunk:
                    chunk, blocks, lookup = ids[a], [], None
                rows = batch.slice(a, b - a)
                if not filled[a]:
                    blocks.append((np.array(rows.column(1).to_pylist(), f"S{WIDE * order}"), rows.column(2).to_numpy()))
                    continue
                if lookup is None:
                    grams = np.concatenate([g for g, _ in blocks] or [np.zeros(0, f"S{WIDE * order}")])
                    logs = np.concatenate([x for _, x in blocks] or [np.zeros(0, np.float32)]).astype(np.float64)
                    sort = np.argsort(grams)
                    lookup, blocks = (grams[sort], logs[sort]), []
                for part in rows.column(3):
                    yield from scored(part.as_buffer(), *lookup)

    def scored(part: pa.Buffer, grams: np.ndarray, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in pa.ipc.open_stream(part):
            texts = batch.column(1).to_pylist()
            own, _, which, owner = _grams(texts, order, alphabet)
            at = np.searchsorted(grams, own)
            if len(own) and not (len(grams) and (grams[np.minimum(at, len(grams) - 1)] == own).all()):
                raise RuntimeError("an n-gram of a chunk is missing")
            totals = np.bincount(owner, logs[at][which] if len(own) else None, len(texts))
            sizes = np.array([len(t or "") for t in texts], np.int64)
            none = (sizes == 0) | empty
            found = pa.array(np.exp(-totals / np.maximum(sizes, 1)), pa.float64(), mask=none)
            columns = [batch.column(2 + i).cast(wanted.field(i).type) for i in range(len(passed))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), found], names=wanted.names)

    return dealt.mapInArrow(run, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the rows whose quality is 1 and that are not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, keep: float = KEEP) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold and kept of every row of ``docs``.

    Rows without any character are not kept. A null language is one of its own. Without any trusted text all
    scores are null and nothing is kept.
    """
    ids = stage(trusted_ids(labels), "trusted")
    small = ids.count() <= MAX_SENT_IDS
    near = F.broadcast(ids) if small else ids
    model = tables(docs.join(near, "doc_id", "left_semi").select("text"), order)
    scored = stage(perplexities(docs, model), "scores")
    known = scored.join(near, "doc_id", "left_semi").where("perplexity is not null")
    quantile = F.percentile_approx("perplexity", F.lit(keep), F.lit(ACCURACY)).alias("own")
    by_lang = known.groupBy("lang").agg(quantile)
    overall = known.agg(quantile).first()["own"]
    out = scored.join(by_lang.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left")
    out = out.withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", kept.alias("kept"))
