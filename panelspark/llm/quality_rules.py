"""Quality rules as a short-circuit cascade.

Words are runs of other characters than white space (space and U+0009 to U+000D). Each rule says of one text
whether it fails. On a sample of ``SAMPLE_ROWS`` rows every rule is run on every text, its time and its share of
rejections are taken, and the rules are put in the order of rejections per second, so that the cheap and sharp ones
come first; on the whole table a text meets the rules in this order and is done with the first that it fails. What is
kept does not depend on the order, because a text is kept if it fails no rule.

The base counts are part of the result and are taken of every text; the first rule, which stands on them alone,
is therefore free and always first. Thresholds are those that are in common use for web text.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import field, keep_rows, map_texts

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Rows of the sample on which cost and selectivity are measured.
SAMPLE_ROWS = 2000
#: Rejected beyond these.
MEAN_WORD_CHARS = (3, 12)
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINE_CHARS = 0.3
MIN_WORDS_WITH_LETTER = 0.8
MAX_BULLET_LINES = 0.9
MAX_ELLIPSIS_LINES = 0.3
MAX_UPPER_WORDS = 0.5

LETTER = re.compile(r"[^\W\d_]")
BULLETS = ("-", "*", "•", "‣", "●")
ELLIPSES = ("...", "…")


class Text:
    """A text and what the rules want to know of it, each taken at most once."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        # bytes.split() knows just the six white space characters meant here
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of three words that stands in the text twice or more."""
        n = len(self.words) - 2
        if n < 2:
            return 0
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in self.words], np.int64)
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, window, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[window] > 1
        hit = np.zeros(n + 2, bool)
        for k in range(3):
            hit[k : n + k] |= twice
        return int(hit.sum())

    @property
    def base(self) -> tuple[int, int, int, int, int]:
        return len(self.words), self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words


def base_failed(t: Text) -> bool:
    n = len(t.words)
    return n < MIN_WORDS or 100 * t.n_repeat_words > 50 * n


def _mean_word(t: Text) -> bool:
    low, high = MEAN_WORD_CHARS
    n = len(t.words)
    return not low * n <= t.word_chars <= high * n


def _symbols(t: Text) -> bool:
    return t.n_symbols > MAX_SYMBOLS_PER_WORD * len(t.words)


def _dup_lines(t: Text) -> bool:
    """Repeats of earlier lines hold too many of the characters."""
    if not t.n_dup_lines:
        return False
    chars = sum(map(len, t.lines))
    return chars - sum(map(len, set(t.lines))) > MAX_DUP_LINE_CHARS * chars


def _letters(t: Text) -> bool:
    with_letter = sum(1 for w in t.words if w.isalpha() or LETTER.search(w.decode("utf-8", "surrogatepass")))
    return with_letter < MIN_WORDS_WITH_LETTER * len(t.words)


def _bullets(t: Text) -> bool:
    return sum(x.lstrip(SPACE).startswith(BULLETS) for x in t.lines) > MAX_BULLET_LINES * len(t.lines)


def _ellipses(t: Text) -> bool:
    return sum(x.rstrip(SPACE).endswith(ELLIPSES) for x in t.lines) > MAX_ELLIPSIS_LINES * len(t.lines)


def _capitals(t: Text) -> bool:
    return sum(len(w) > 1 and w.isupper() for w in t.words) > MAX_UPPER_WORDS * len(t.words)


#: The rules after the base rule, by name.
RULES: dict[str, Callable[[Text], bool]] = {
    "mean_word": _mean_word,
    "symbols": _symbols,
    "dup_lines": _dup_lines,
    "letters": _letters,
    "bullets": _bullets,
    "ellipses": _ellipses,
    "capitals": _capitals,
}


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> list[tuple[str, int, int, float]]:
    """(rule, texts, rejected, seconds) over about ``rows`` rows chosen by a hash of ``key``; timed on the executors."""
    total = docs.count()
    share = min(1.0, rows / max(1, total))
    roll = F.pmod(F.xxhash64(F.lit("rules"), key), F.lit(1 << 30))
    names = list(RULES)

    def start():
        def work(texts: pa.Array):
            got = []
            for value in texts.to_pylist():
                seen = []
                for name in names:
                    fresh = Text(value)  # each rule pays for all that it needs
                    at = time.perf_counter()
                    failed = RULES[name](fresh)
                    seen.append((failed, time.perf_counter() - at))
                got.append(seen)
            return [[int(f) for f, _ in s] for s in got], [[c for _, c in s] for s in got]

        return work

    sample = docs.select(text, key).where(roll < int(share * (1 << 30)))
    found = map_texts(sample, text, [], [field("failed", "array<int>"), field("seconds", "array<double>")], start)
    sums = [F.sum(F.get(c, i)).alias(f"{c}{i}") for i in range(len(names)) for c in ("failed", "seconds")]
    row = found.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return [(name, row["n"], row[f"failed{i}"] or 0, row[f"seconds{i}"] or 0.0) for i, name in enumerate(names)]


def order(measured: list[tuple[str, int, int, float]]) -> list[str]:
    """Rule names by rejections per second, most first; rules that reject as much for their cost go by name."""
    return [name for name, *_ in sorted(measured, key=lambda m: (-m[2] / max(m[3], 1e-9), m[0]))]


def first_failed(t: Text, names: list[str]) -> str | None:
    """The base rule's name, or that of the first rule in the order of ``names`` that the text fails."""
    if base_failed(t):
        return "base"
    return next((name for name in names if RULES[name](t)), None)


def judge(docs: DataFrame, names: list[str], text: str = "text", passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``passed`` columns, the base counts, base_failed, kept and failed_rule (null if kept; depends on the order) of every row.

    A null text counts as one without words. It and an empty one fail the base rule.
    """
    fields = [field(c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [field("base_failed", "boolean"), field("kept", "boolean"), field("failed_rule", "string")]

    def start():
        def work(texts: pa.Array):
            all_ = [Text(t) for t in texts.to_pylist()]
            rules = [first_failed(t, names) for t in all_]
            counts = list(zip(*(t.base for t in all_), strict=True)) or [()] * 5
            return [*map(list, counts), [r == "base" for r in rules], [r is None for r in rules], rules]

        return work

    return map_texts(docs, text, passed, fields, start)


def keep_good(docs: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """The rows that fail no rule, with all their columns."""
    return keep_rows(docs, text, lambda: lambda texts: [first_failed(Text(t), names) is None for t in texts.to_pylist()])
