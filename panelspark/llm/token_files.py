"""Token ids in binary files: Simple-8b words in blocks.

Simple-8b packs as many ids as fit into the lower 60 bits of a 64-bit word; the upper four bits, the selector, say how
many there are and how wide. A value of 60 bits or more is escaped: a word of one value with all its 60 bits set, then
the value as a word of its own.

A file, all little-endian: the magic bytes; blocks; the index, an entry (offset, documents, ids) of three 64-bit
integers for each block; the number of blocks as a 64-bit integer; the magic bytes. A block holds whole documents, at
least about ``BLOCK_IDS`` ids of them unless it is the last: the numbers of documents, ids and words as 64-bit integers;
the document ids as 64-bit integers; a byte for each document that is 1 if its id is null; the number of ids of each
document as 64-bit integers; the words. So a block is found from the index and decoded by whole-array operations.

Files hold the documents in ascending id order, null ids first; file ``part-00000`` comes before ``part-00001``.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm.common import PART_ROWS
from panelspark.llm.memo import Memo, spaced
from panelspark.session import shared_dir, stage

#: Fixed values of the coding: how many ids a word holds under selectors 0 to 15, and their bits (0: all are zero).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = np.uint64((15 << 60) | ((1 << 60) - 1))
PAYLOAD = np.uint64((1 << 60) - 1)
MAGIC = b"S8IDS\x00\x00\x01"
BLOCK_IDS = 1 << 16
#: Words whose ids a Python worker remembers at most.
ENTRIES = 1 << 21
#: Letters and ASCII marks other than the apostrophe (which may stand for a left-out letter), once or at both sides of a
#: line feed: byte-level tokenizers cut such a word just between these groups.
MARKS = r"[!-&(-/:-@\[-`{-~]*"
GROUPS = regex.compile(rf"(\p{{L}}+)({MARKS})(?:(\n)(\p{{L}}+)({MARKS}))?")


def pack(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit values; each word takes as many of the next values as any selector can."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([values.astype(np.uint64), np.zeros(COUNTS[0], np.uint64)])
    wide = padded >= PAYLOAD
    bits = np.frexp(padded.astype(np.float64))[1].astype(np.uint8)
    choice = np.full(n, 15, np.uint8)
    for s in range(14, -1, -1):
        fit, width, k = bits <= WIDTHS[s], 1, int(COUNTS[s])
        while width < k:  # fit[i]: the ``width`` values from i on are small enough
            more = min(width, k - width)
            fit = fit[:-more] & fit[more:]
            width += more
            if not fit.any():
                break
        else:
            choice[fit[:n]] = s
    steps, places, at = COUNTS[choice].tolist(), [], 0
    while at < n:
        places.append(at)
        at += steps[at]
    starts = np.array(places)
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if WIDTHS[s]:
            rows, k = np.flatnonzero(chosen == s), int(COUNTS[s])
            shifts = np.arange(k, dtype=np.uint64) * np.uint64(WIDTHS[s])
            words[rows] |= np.bitwise_or.reduce(padded[starts[rows][:, None] + np.arange(k)] << shifts, axis=1)
    if wide.any():
        escaped = np.flatnonzero(wide[starts] & (chosen == 15))
        words[escaped] = ESCAPE
        words = np.insert(words, escaped + 1, padded[starts[escaped]])
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values in the words."""
    raw = np.zeros(len(words) + 1, bool)
    for at in np.flatnonzero(words == ESCAPE):
        if not raw[at]:  # else it is itself an escaped value
            raw[at + 1] = True
    raw = raw[: len(words)]
    chosen = np.where(raw, 15, words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    counts[np.flatnonzero(raw) - 1] = 0
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(chosen):
        rows = np.flatnonzero((chosen == s) & (counts > 0))
        if WIDTHS[s]:
            k, width = int(COUNTS[s]), np.uint64(WIDTHS[s])
            values = (words[rows][:, None] >> (np.arange(k, dtype=np.uint64) * width)) & np.uint64((1 << int(width)) - 1)
            out[starts[rows][:, None] + np.arange(k)] = values
    out[starts[raw]] = words[raw]
    return out[:n]


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is visible, else one from U+0100 on."""
    seen = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    unseen = [b for b in range(256) if b not in seen]
    return {**{b: chr(b) for b in seen}, **{b: chr(256 + i) for i, b in enumerate(unseen)}}


class Words(dict):
    """Ids of words, remembered up to a bound; ``asked`` collects words for which ``compute`` gives None."""

    def __init__(self, before: str, compute: Callable[[str], bytes | None]) -> None:
        super().__init__()
        self.before, self.compute, self.asked = before, compute, set()

    def __missing__(self, word: str) -> bytes | None:
        ids = self.compute(word)
        if ids is None:
            self.asked.add(word)
        else:
            if len(self) >= ENTRIES:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Whole texts through the tokenizers library, as unsigned 32-bit ids.

    A byte-level tokenizer without normaliser starts a new piece at each space before a word. There the library is
    asked once for each distinct word: its model for words of letters and marks, whose pieces are known, else the
    library itself, all such new words of some texts in a call. What it gave is remembered up to a bound. Texts with
    a special token's string, and all texts of other tokenizers, go to it whole.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec.get("pre_tokenizer") or {}
        byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.by_word = bool(byte_level and not spec.get("normalizer") and not spec["model"].get("dropout"))
        self.first, self.later = Words("", lambda word: None), Words(" ", self._word)
        self.model, self.letters = self.library.model, byte_letters()
        self.groups = Memo(self._group)

    def _group(self, group: str) -> bytes:
        """Ids of a group that the tokenizer leaves whole: straight from the library's model."""
        letters = group.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of a space and a word of such groups; None for any other word."""
        if word.isalpha():
            return self._group(" " + word)
        cut = GROUPS.fullmatch(word)
        if cut is None:
            return None
        head, *rest = cut.groups("")
        known = self.later.get(head) or self.groups[" " + head]
        return known + b"".join([self.groups[group] for group in rest if group])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: Words) -> None:
        if words.asked:
            if len(words) + len(words.asked) > ENTRIES:
                words.clear()
            mixed = list(words.asked)
            words.update(zip(mixed, self.whole([words.before + w for w in mixed]), strict=True))
            words.asked.clear()

    def _known(self, pieces: list[str]) -> bytes | None:
        """The ids of a text cut into words; None if one of them has to be asked for."""
        try:
            return b"".join([self.first[pieces[0]], *map(self.later.__getitem__, pieces[1:])])
        except TypeError:  # one of the words gave None
            return None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        if not self.by_word:
            return self.whole(texts)
        out: list[bytes | None] = [None] * len(texts)
        open_, odd = [], []
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                odd.append(i)
                continue
            pieces = spaced(text)
            out[i] = self._known(pieces)
            if out[i] is None:
                open_.append((i, pieces))
        self._learn(self.first)
        self._learn(self.later)
        for i, pieces in open_:
            out[i] = self._known(pieces)
            if out[i] is None:  # forgotten meanwhile
                odd.append(i)
        self.first.asked.clear()
        self.later.asked.clear()
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out


@functools.cache
def load(path: str) -> Encoder:
    """The encoder of a tokenizer file, once for each Python process."""
    # Spark runs a worker for each core; threads of the library's own would only stand in their way
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def block_bytes(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A block of documents."""
    lengths = np.array([len(x) // 4 for x in ids], "<i8")
    words = pack(np.frombuffer(b"".join(ids), "<u4"))
    head = struct.pack("<3q", len(ids), int(lengths.sum()), len(words))
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return head + keys.tobytes() + bytes(d is None for d in doc_ids) + lengths.tobytes() + words.astype("<u8").tobytes()


def read_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of a block."""
    n, n_ids, n_words = struct.unpack_from("<3q", data)
    keys = np.frombuffer(data, "<i8", n, 24).tolist()
    nulls = data[24 + 8 * n : 24 + 9 * n]
    lengths = np.frombuffer(data, "<i8", n, 24 + 9 * n)
    ids = unpack(np.frombuffer(data, "<u8", n_words, 24 + 17 * n), n_ids)
    return [None if z else k for k, z in zip(keys, nulls, strict=True)], lengths, ids.astype("<u4")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, path: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write the ids of every row's whole text, each followed by ``end_id``, to files in ``folder``.

    Returns part, file and n_ids of each file. A null text counts as empty; rows of one id go by a hash of their text.
    A file gets its name when it is whole, and a task that is run again writes the same file again.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = load(path), TaskContext.get().partitionId()
        store, place = _open(f"{folder}/part-{part:05d}.s8")
        unfinished, index, total = f"{place}.{uuid.uuid4().hex}", [], 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        out, at = None, len(MAGIC)

        def close_block() -> None:
            nonlocal at, total
            data, n = block_bytes(keys, ids), sum(map(len, ids)) // 4
            out.write(data)
            index.append((at, len(keys), n))
            at, total = at + len(data), total + n
            keys.clear()
            ids.clear()

        for batch in batches:
            for row in range(0, batch.num_rows, PART_ROWS):
                some = batch.slice(row, PART_ROWS)
                if out is None:
                    store.create_dir(folder_of(place), recursive=True)
                    out = store.open_output_stream(unfinished)
                    out.write(MAGIC)
                coded = encoder.encode([t or "" for t in some.column(1).to_pylist()])
                held = 0
                for key, one in zip(some.column(0).to_pylist(), coded, strict=True):
                    keys.append(key)
                    ids.append(one + end)
                    held += len(ids[-1])
                    if held >= 4 * BLOCK_IDS:
                        close_block()
                        held = 0
        if out is not None:
            if keys:
                close_block()
            out.write(np.array(index, "<i8").tobytes() + struct.pack("<q", len(index)) + MAGIC)
            out.close()
            store.move(unfinished, place)
            yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{folder}/part-{part:05d}.s8", "n_ids": total}])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("key"), F.col(text).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "salt": F.rand(7)})  # the salt spreads repeated rows
    rows = rows.repartitionByRange("key", "hash", "salt").sortWithinPartitions("key", "hash").select("key", "text")
    return rows.mapInArrow(run, "part bigint, file string, n_ids bigint")


def folder_of(place: str) -> str:
    return place.rpartition("/")[0]


def read_index(uri: str) -> np.ndarray:
    """(offset, documents, ids) of each block of a file."""
    store, place = _open(uri)
    with store.open_input_file(place) as file:
        end = file.size()
        file.seek(end - len(MAGIC) - 8)
        tail = file.read(len(MAGIC) + 8)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no whole token file")
        (blocks,) = struct.unpack("<q", tail[:8])
        file.seek(end - len(MAGIC) - 8 - 24 * blocks)
        return np.frombuffer(file.read(24 * blocks), "<i8").reshape(-1, 3)


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian 32-bit integers) of every document in ``files``.

    The numbers of ids in the files are added up on the driver: a number for each file. Blocks are then read apart.
    """
    sizes = sorted((r["part"], r["n_ids"]) for r in files.select("part", "n_ids").collect())
    before, start_of = 0, {}
    for part, n in sizes:
        start_of[part] = before
        before += n

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = read_index(row["file"])
                starts = start_of[row["part"]] + np.cumsum(index[:, 2]) - index[:, 2]
                names = pa.array([row["file"]] * len(index))
                yield pa.RecordBatch.from_arrays([names, pa.array(index[:, 0]), pa.array(starts)], ["file", "offset", "start"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = _open(row["file"])
                with store.open_input_file(place) as file:
                    file.seek(row["offset"])
                    head = file.read(24)
                    n, _, n_words = struct.unpack("<3q", head)
                    keys, lengths, ids = read_block(head + file.read(17 * n + 8 * n_words))
                ends = np.cumsum(lengths)
                data = ids.tobytes()
                cut = [data[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])

    places = files.select("part", "file").mapInArrow(blocks, "file string, offset bigint, start bigint")
    # a few thousand blocks to a task at most; the places are small
    places = places.repartition(max(1, min(len(sizes) * 4, 1 + before // (16 * BLOCK_IDS))))
    return places.mapInArrow(documents, "doc_id bigint, start bigint, ids binary")


def round_trip(docs: DataFrame, path: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``write`` to a new folder among the shared ones, then ``read``."""
    folder = shared_dir(docs.sparkSession, "token-files")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    return read(stage(write(docs, folder, path, end_id, text, doc_id), "token-manifest"))
