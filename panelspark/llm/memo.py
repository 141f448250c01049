"""Pieces of text between spaces, and a bounded memory of what was computed for them."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Generic, TypeVar

T = TypeVar("T")

#: Results that a Python worker remembers at most.
ENTRIES = 1 << 19
#: A space that stands before a character that is no white space of any kind.
BEFORE_WORD = re.compile(r" (?=\S)")


class Memo(dict, Generic[T]):
    """``compute(key)`` for each key asked for; starts anew when ``limit`` results are held."""

    def __init__(self, compute: Callable[[str], T], limit: int = ENTRIES) -> None:
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key: str) -> T:
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


#: White space other than the space and the line feed: texts with it are cut by the pattern.
RARE_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def spaced(text: str) -> list[str]:
    """The text cut at each space before a word; these spaces are left out."""
    if "  " in text or " \n" in text or text.endswith(" ") or any(c in text for c in RARE_SPACE):
        return BEFORE_WORD.split(text)
    return text.split(" ")
