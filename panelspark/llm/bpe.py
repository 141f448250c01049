"""Byte-level BPE in linear time.

A text is cut by the tokenizer's pattern, and each match is encoded by itself. An encoding by merges is the only
sequence of tokens in which every two neighbours are compatible, that is, in which the merges of the two together would
not have crossed the border between them. So the encoder takes the longest token at a place (found for all places at
once by an Aho-Corasick automaton over the bytes, as Latin-1 characters), goes on if it is compatible with the token
before, else tries its next shorter prefix, and goes back one token when none is left; a place from which nothing fits
is marked and never tried again, which keeps the work linear. Compatibility depends on two tokens only and is
remembered.

Texts repeat their words: the ids of what stands between two spaces are remembered up to a bound.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from panelspark.llm.common import field, lists, map_texts, worker_tables
from panelspark.llm.memo import Memo, spaced

#: White space as rank-file tokenizers know it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pairs of tokens, and matches without a space before them, that a Python worker remembers at most.
PAIRS = 1 << 18
OTHERS = 1 << 16


def exact_pattern(pattern: str) -> regex.Pattern:
    """The pattern with its white space classes spelled out, as engines differ on a few control characters."""
    spelled = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
    return regex.compile(spelled)


def _ranges(codes: Iterable[int]) -> str:
    """A character class (without brackets) of code points in ascending order."""
    out: list[list[int]] = []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _planes() -> Iterator[str]:
    """All code points but surrogates, a plane at a time, as objects for all at once would fill a worker's memory."""
    for at in range(0, 0x110000, 0x10000):
        yield "".join(chr(c) for c in range(at, at + 0x10000) if not 0xD800 <= c < 0xE000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@worker_tables
def library_classes() -> dict[str, np.ndarray]:
    """Which code points are in the classes L and N as the tiktoken library knows them, asked from the library itself."""
    found = {}
    for name in "LN":
        one = tiktoken.Encoding("class", pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found[name] = np.zeros(0x110000, bool)
        for chars in _planes():
            found[name][_codes(bytes(one.encode_ordinary(chars)).decode())] = True
    return found


@worker_tables
def _unlike() -> np.ndarray:
    """Which code points Python, the regex module and the library class differently: their Unicode versions differ."""
    classes = library_classes()
    letters, numbers, alpha = (np.zeros(0x110000, bool) for _ in range(3))
    for chars in _planes():
        letters[_codes(regex.sub(r"\P{L}+", "", chars))] = True
        numbers[_codes(regex.sub(r"\P{N}+", "", chars))] = True
        alpha[_codes("".join(filter(str.isalpha, chars)))] = True
    return (letters ^ classes["L"]) | (numbers ^ classes["N"]) | (alpha ^ classes["L"])


def unlike(text: str) -> bool:
    """Whether a text has such a code point."""
    return not text.isascii() and bool(_unlike()[_codes(text)].any())


def library_pattern(pattern: str) -> regex.Pattern:
    """The pattern with the library's classes spelled out; much slower, so only for texts in which ``unlike`` finds something."""
    for name, inside in library_classes().items():
        listed, mark = _ranges(np.flatnonzero(inside).tolist()), rf"\p{{{name}}}"
        # inside a class the ranges stand as they are, elsewhere as a class of their own
        parts, depth = [], 0
        for piece in re.split(r"((?<!\\)[\[\]])", pattern):
            depth += {"[": 1, "]": -1}.get(piece, 0)
            parts.append(piece.replace(mark, listed if depth else f"[{listed}]"))
        pattern = "".join(parts)
    return exact_pattern(pattern)


class Bpe:
    """The vocabulary of a rank file and its encoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern, self.given, self.slow = ranks, exact_pattern(pattern), pattern, None
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.base = max(ranks.values(), default=0) + 1
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        # the two tokens whose merge made a token
        self.parts = {i: self._parts(t, i) for t, i in ranks.items() if len(t) > 1}
        self.made = {pair: i for i, pair in self.parts.items()}
        self.shorter = Memo(self._shorter, len(ranks) + 1)
        self.compatible = Memo(self._compatible, PAIRS)
        self.other_ids = Memo(self._match, OTHERS)
        self.word_ids = Memo(self._word)

    def _parts(self, token: bytes, rank: int) -> tuple[int, int]:
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            ranked = [(self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False))]
            least, i = min(ranked)
            if least >= rank:
                raise ValueError(f"token {rank} can't be made by merges")
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        return self.ranks[pieces[0]], self.ranks[pieces[1]]

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix; -1 for a single byte."""
        text = self.tokens[token]
        return next((self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), -1)

    def _compatible(self, pair: int) -> bool:
        """Whether merges of the two tokens' bytes, side by side, leave the two tokens; ``pair`` is the left one times ``base`` plus the right.

        The merges of both sides are undone from the last; as soon as the tokens at the border could have been merged
        before the one that was undone, the border would not have stayed.
        """
        left, right = divmod(pair, self.base)
        limit = None
        while True:
            joined = self.made.get((left, right))
            if joined is not None and (limit is None or joined < limit):
                return False
            inside_left, inside_right = self.parts.get(left), self.parts.get(right)
            if inside_left and (left > right or not inside_right):
                limit, left = left, inside_left[1]
            elif inside_right:
                # of two merges of one rank the left one is made first
                limit, right = right + 1, inside_right[0]
            else:
                return True

    def encode_match(self, match: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(match)
        if whole is not None:
            return [whole]
        n, size, shorter, compatible, base = len(match), self.size, self.shorter, self.compatible, self.base
        longest = [0] * n
        for last, token in self.automaton.iter(match.decode("latin-1")):
            longest[last + 1 - size[token]] = token  # matches come by their ends, so a later one is longer
        out: list[int] = []
        stuck = bytearray(n + 1)
        at = 0
        token = longest[0] if n else 0
        while at < n:
            end = at + size[token]
            if not stuck[end] and (not out or compatible[out[-1] * base + token]):
                out.append(token)
                at = end
                token = longest[at] if at < n else 0
                continue
            token = shorter[token]
            if token < 0:
                stuck[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def _match(self, match: str) -> bytes:
        return array("i", self.encode_match(match.encode("utf-8", "surrogatepass"))).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and what follows it up to the next."""
        return self._match(" " + word) if word.isalpha() else self._joined(" " + word)

    def _joined(self, text: str) -> bytes:
        # a match of a space and letters is remembered as a word, any other by itself
        found = self.pattern.findall(text)
        return b"".join([self.word_ids[m[1:]] if m[0] == " " and m[1:].isalpha() else self.other_ids[m] for m in found])

    def encode(self, text: str) -> bytes:
        """Token ids of a text as 32-bit integers laid end to end."""
        if unlike(text):
            self.slow = self.slow or library_pattern(self.given)
            return b"".join([self._match(m) for m in self.slow.findall(text)])
        first, *rest = spaced(text)
        return self._joined(first) + b"".join(map(self.word_ids.__getitem__, rest)) if rest else self._joined(first)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@worker_tables
def load(path: str, pattern: str) -> Bpe:
    """The encoder of a rank file, once for each Python worker as long as tasks use it."""
    return Bpe(read_ranks(path), pattern)


@worker_tables
def load_tokens(path: str) -> dict[int, bytes]:
    """The bytes of each token: all that decoding needs."""
    return {rank: token for token, rank in read_ranks(path).items()}


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``passed`` columns and ``ids`` (array of int) of every row's whole text; null counts as empty and gives no ids."""

    def start():
        bpe = load(path, pattern)

        def work(texts: pa.Array):
            found = [bpe.encode(t or "") for t in texts.to_pylist()]
            return [lists(pa.array(np.frombuffer(b"".join(found), "<i4")), [len(f) // 4 for f in found])]

        return work

    return map_texts(docs, text, passed, [field("ids", "array<int>")], start)


def decode_ids(tokens: dict[int, bytes], ids: Iterable[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def decode(encoded: DataFrame, path: str, ids: str = "ids", passed: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """``passed`` columns and ``decoded``, the bytes of every row's tokens; null ids give null."""

    def start():
        tokens = load_tokens(path)
        return lambda rows: [[None if r is None else decode_ids(tokens, r) for r in rows.to_pylist()]]

    return map_texts(encoded, ids, passed, [field("decoded", "binary")], start)


def round_trip(
    docs: DataFrame, path: str, pattern: str, text: str = "text", passed: tuple[str, ...] = ("doc_id",), whole: bool = True
) -> DataFrame:
    """``passed`` columns, ``ids`` of every row's whole text, and what these ids give when decoded, in one pass.

    With ``whole`` the bytes come back as ``decoded``, else only ``round_trip``: whether they are the text's bytes.
    Null counts as empty: no ids, no bytes, a round trip that holds. One worker and one copy of the text do for both.
    """

    def start():
        bpe = load(path, pattern)

        def work(texts: pa.Array):
            rows = [t or "" for t in texts.to_pylist()]
            found = [bpe.encode(t) for t in rows]
            ids = lists(pa.array(np.frombuffer(b"".join(found), "<i4")), [len(f) // 4 for f in found])
            back = [decode_ids(bpe.tokens, array("i", f)) for f in found]
            return [ids, back if whole else [b == t.encode() for b, t in zip(back, rows, strict=True)]]

        return work

    last = field("decoded", "binary") if whole else field("round_trip", "boolean")
    return map_texts(docs, text, passed, [field("ids", "array<int>"), last], start)
