"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is read as its runs of letters, lower-cased. Every run of two to four neighbouring symbols inside a word
(the word's borders are a symbol too) is hashed to one of ``BUCKETS`` embeddings; their mean goes through a linear
softmax. Embeddings and softmax are trained together by stochastic gradient descent on a bounded, documented
sample of labelled rows (``SAMPLE_PER_LANG`` for each language that any row is labelled with); prediction reads every
character of every text. As the model is linear after the mean, the product of both matrices is one table with
a row of language scores for each bucket.

Part of the sample is held back from training. On it a temperature is fitted, so that scores are
probabilities, and the lowest score is found at which a right prediction is still to be believed: texts below it
are rejected (``accepted`` false), and at most ``REJECT_RATE`` of the rightly predicted calibration texts lie there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import field, keep_rows, map_texts, worker_tables

UNKNOWN = "und"
BUCKETS = 1 << 13
DIM = 16
#: Bounds of the fitting sample: rows for each language, and characters in an excerpt of a sampled row.
SAMPLE_PER_LANG = 400
EXCERPT = 60
REJECT_RATE = 0.001
#: No text whose best language has this probability or more is rejected.
SURE = 0.5
EPOCHS, BATCH, RATE, SEED = 12, 8, 0.4, 7
#: Longer texts are cut at a space into pieces of at most this many characters, which bounds memory (a run of
#: as many characters without any space is cut where it is).
PIECE = 1 << 18


@dataclass(frozen=True)
class Model:
    """``scores`` has a row for each bucket and a column for each language; logits are divided by ``temperature``."""

    langs: tuple[str, ...]
    scores: np.ndarray
    temperature: float
    reject_below: float


@worker_tables
def _symbols() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _pieces(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at, at + PIECE)
        cut = cut if cut > at else at + PIECE
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def histograms(texts: list[str]) -> np.ndarray:
    """How often each text has each bucket: float32, a row for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    pieces, owner = [], []
    for i, text in enumerate(texts):
        for piece in _pieces(text) if len(text) > PIECE else (text,):
            pieces.append(piece)
            owner.append(i)
        if sum(map(len, pieces)) >= PIECE or i + 1 == len(texts):
            _count(pieces, owner, out)
            pieces, owner = [], []
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return x


def _count(pieces: list[str], owner: list[int], out: np.ndarray) -> None:
    first = owner[0]
    codes = np.frombuffer(("\n" + "\n".join(pieces) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    of = np.repeat(np.array(owner, np.int64) - first, [len(p) + 1 for p in pieces])
    of = np.concatenate([[0], of])
    symbols = _symbols()[codes]
    inside = symbols != 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[0] = True
    symbols, of, inside = symbols[keep], of[keep], inside[keep]
    found = []
    mixed = _mix(symbols)
    ok = np.ones(len(symbols), bool)
    for n in (2, 3, 4):
        size = len(symbols) - n + 1
        if size <= 0:
            break
        mixed = _mix(mixed[:size] ^ symbols[n - 1 :])
        # borders stand only at either end; two of them meet where a piece has no letter
        ok = ok[:size] & inside[n - 2 : n - 2 + size] if n > 2 else inside[:size] | inside[1:]
        at = np.flatnonzero(ok)
        # the row is that of the first letter: a border may belong to the piece before
        found.append(of[at + ~inside[at]] * BUCKETS + (mixed[at] & np.uint32(BUCKETS - 1)))
    if found:
        rows = owner[-1] - first + 1
        out[first : first + rows] += np.bincount(np.concatenate(found), minlength=rows * BUCKETS).reshape(rows, BUCKETS)


def held_out(doc_id: Column) -> Column:
    """Rows that are kept from learning: crc32 of the id as text, modulo 4, is 2. A null id is not held out, nor learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sample(labelled: DataFrame, doc_id: str, lang: str, text: str) -> pd.DataFrame:
    """SAMPLE_PER_LANG rows of each language, or all if there are fewer, as bucket counts, each as a whole and as a short excerpt.

    Rows are drawn by a hash of id and text; equal rows, however many, count once, so that they can't fill a language's part.
    """
    roll = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), doc_id, text), 11) / F.lit(float(1 << 53))
    rows = labelled.select(roll.alias("roll"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # a row for each language; its share leaves about twice the rows wanted, of which the first by hash stay
    shares = rows.groupBy("lang").agg(F.approx_count_distinct("roll").alias("rows"))
    share = {r["lang"]: min(1.0, 2 * SAMPLE_PER_LANG / r["rows"]) for r in shares.collect()}
    if not share:
        return pd.DataFrame({"lang": [], "buckets": [], "counts": []})
    least = labelled.sparkSession.createDataFrame(sorted(share.items()), "lang string, share double")
    chosen = rows.withColumn("lang", F.col("lang").cast("string")).join(F.broadcast(least), "lang").where("roll <= share")
    chosen = chosen.groupBy("lang", "roll").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("roll"))
    chosen = chosen.withColumn("place", first).where(F.col("place") <= SAMPLE_PER_LANG)

    def start():
        def work(texts: pa.Array):
            texts = texts.to_pylist()
            short = [t[(at := sum(t.encode()[:64]) % max(1, len(t) - EXCERPT)) : at + EXCERPT] for t in texts]
            rows = [histograms(texts), histograms(short)]
            found = [[np.flatnonzero(h[i]) for h in rows] for i in range(len(texts))]
            return [f.tolist() for f, _ in found], [rows[0][i, f].tolist() for i, (f, _) in enumerate(found)], [f.tolist() for _, f in found], [rows[1][i, f].tolist() for i, (_, f) in enumerate(found)]

        return work

    kinds = [field(c, "array<int>") if c.startswith("b") else field(c, "array<float>") for c in ("b_whole", "c_whole", "b_short", "c_short")]
    rows = map_texts(chosen, "text", ["roll", "lang"], kinds, start)
    rows = rows.toPandas()
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["lang"][i], list(rows["b_short"][i]), list(rows["b_whole"][i])))]
    parts = [rows[["lang", f"b_{k}", f"c_{k}"]].set_axis(["lang", "buckets", "counts"], axis=1) for k in ("whole", "short")]
    out = pd.concat(parts, ignore_index=True)
    return out[out["buckets"].map(len) > 0].reset_index(drop=True)


def _dense(rows: pd.DataFrame) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (buckets, counts) in enumerate(zip(rows["buckets"], rows["counts"], strict=True)):
        x[i, np.asarray(buckets, np.int64)] = np.asarray(counts, np.float32)
    return x / np.maximum(1, x.sum(1, keepdims=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> Model | None:
    """Train on the labelled rows that ``held_out`` does not hold out; None if there are none.

    Rows with a null id, text or language are not learned from.
    """
    labelled = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(doc_id)))
    rows = _sample(labelled, doc_id, lang, text)
    if rows.empty:
        return None
    langs = tuple(sorted(rows["lang"].unique()))
    rng = np.random.default_rng(SEED)
    target = np.searchsorted(langs, rows["lang"])
    order = rng.permutation(len(rows))
    cut = max(1, len(rows) // 5) if len(rows) >= 10 else 0
    train, check = order[cut:], order[:cut] if cut else order
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    linear = np.zeros((DIM, len(langs)), np.float32)
    steps, step = EPOCHS * math.ceil(len(train) / BATCH), 0
    x_all = [(np.asarray(b, np.int64), np.asarray(c, np.float32) / np.sum(c)) for b, c in zip(rows["buckets"], rows["counts"], strict=True)]
    for _ in range(EPOCHS):
        mixed = rng.permutation(train)
        for at in range(0, len(mixed), BATCH):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            some = mixed[at : at + BATCH]
            hidden = np.stack([w @ embed[b] for b, w in (x_all[i] for i in some)])
            slope = _softmax(hidden @ linear)
            slope[np.arange(len(some)), target[some]] -= 1
            back = slope @ linear.T
            linear -= rate * (hidden.T @ slope)
            for i, g in zip(some, back, strict=True):
                b, w = x_all[i]
                # each subword of a text moves by its part in the text, scaled up so that rare ones learn too
                embed[b] -= rate * np.minimum(1, w * len(b))[:, None] * g
    scores = embed @ linear
    logits = np.stack([x_all[i][1] @ scores[x_all[i][0]] for i in check])
    temperature = min(
        np.geomspace(0.05, 20, 121), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(check)), target[check]] + 1e-12).sum()
    )
    best = _softmax(logits / temperature)
    right = np.sort(best.max(1)[best.argmax(1) == target[check]])
    below = float(right[int(REJECT_RATE * len(right))]) if len(right) else 0.0
    return Model(langs, scores.astype(np.float32), float(temperature), min(below, SURE))


def _predictor(model: Model | None):
    def work(texts: pa.Array):
        texts = [t or "" for t in texts.to_pylist()]
        if model is None:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        counts = histograms(texts)
        total = counts.sum(1)
        p = _softmax(counts @ model.scores / np.maximum(total, 1)[:, None] / model.temperature)
        best, top = p.argmax(1), p.max(1).astype(float)
        known = total > 0
        names = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        top = np.where(known, top, 0.0)
        return names, top, known & (top >= model.reject_below)

    return work


def predict(docs: DataFrame, model: Model | None, text: str = "text", passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``passed`` columns, lang_pred, score and accepted of every row.

    Only the text is read. A null text, or one without a letter, gets ``und``, score 0 and is rejected; so does
    every text if there was nothing to learn from. Ties go to the language first in the alphabet.
    """
    fields = [field("lang_pred", "string"), field("score", "double"), field("accepted", "boolean")]
    return map_texts(docs, text, passed, fields, lambda: _predictor(model))


def keep_accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows whose language is told with enough confidence, with all their columns."""

    def start():
        work = _predictor(model)
        return lambda texts: work(texts)[2]

    return keep_rows(docs, text, start)
