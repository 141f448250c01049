"""Token counts of a piece vocabulary (BPE with byte fallback), without making any ids.

The symbols of a text, its characters with each space written as a lower bar, stand in a linked list. A heap holds the
adjacent pairs whose join is a piece, by rank and place. The lowest is popped again and again, its two symbols become
one and the new neighbours go on the heap; each merge takes one off the count. A character that is no piece counts
with its UTF-8 bytes.

No piece of such a vocabulary has a bar after another character, so that a merge never crosses the place before a
bar, nor a character that stands in no longer piece. Counts between such places are added and remembered up to a bound.
"""

from __future__ import annotations

import functools
import heapq
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from panelspark.llm.common import field, map_texts
from panelspark.llm.memo import Memo

BAR = "▁"
LIMIT = 4096
RUNS = re.compile(r" +[^ ]*")


def count_merges(symbols: str, ranks: dict[str, float]) -> int:
    """Merges made in ``symbols`` by always joining the adjacent pair of lowest rank, the leftmost of several."""
    n = len(symbols)
    start, end = list(range(n)), list(range(1, n + 1))  # a symbol's characters, at the place of its first
    before, merges = list(range(-1, n - 1)), 0
    heap = [(ranks[symbols[i : i + 2]], i, i + 2) for i in range(n - 1) if symbols[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = end[left]
        # outdated if the left symbol is gone, or either has grown since
        if start[left] != left or right >= n or end[right] != stop:
            continue
        merges += 1
        start[right] = left
        end[left] = stop
        if stop < n:
            before[stop] = left
            rank = ranks.get(symbols[left : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end[stop]))
        if (prior := before[left]) >= 0:
            rank = ranks.get(symbols[prior:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, prior, stop))
    return merges


class Counter:
    """Counts of the model at ``path``; its normaliser must leave texts as they are but for the bar before them."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if not any(map(model.is_byte, ids)) or model.encode("a  b", out_type=str)[:2] != [BAR + "a", BAR]:
            raise ValueError("a BPE model with byte fallback that keeps white space is needed")
        self.ranks = {model.id_to_piece(i): -model.get_score(i) for i in pieces}
        longer = [p for p in self.ranks if len(p) > 1]
        if any(BAR in p.lstrip(BAR) for p in longer):
            raise ValueError("a piece has a bar inside")
        joined = "".join(sorted({c for p in longer for c in p}))
        if any(c not in self.ranks for c in joined):
            raise ValueError("a character of a longer piece is no piece")
        self.parts = re.compile(f"[{re.escape(joined)}]+|.", re.DOTALL)
        self.part_count = Memo(self._count_part)
        self.word_count = Memo(self._count_word)

    def _count_part(self, part: str) -> int:
        symbols = sum(1 if c in self.ranks else len(c.encode("utf-8", "surrogatepass")) for c in part)
        return symbols - count_merges(part, self.ranks)

    def _count_word(self, word: str) -> int:
        return sum(map(self.part_count.__getitem__, self.parts.findall(BAR + word.replace(" ", BAR))))

    def count(self, text: str) -> int:
        """Tokens of a whole text; none for an empty one."""
        if not text:
            return 0
        if BAR in text:  # a bar in a text is read as a space
            text = text.replace(BAR, " ")
        if "  " in text or text[0] == " ":
            return sum(self.word_count[run[1:]] for run in RUNS.findall(" " + text))
        return sum(map(self.word_count.__getitem__, text.split(" ")))


@functools.cache
def load(path: str) -> Counter:
    """The counter of a model, once for each Python process."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``passed`` columns and n_tokens of every row's whole text; null counts as empty and has none."""

    def start():
        counter = load(path)
        return lambda texts: [[counter.count(t or "") for t in texts.to_pylist()]]

    return map_texts(docs, text, passed, [field("n_tokens", "bigint")], start)
