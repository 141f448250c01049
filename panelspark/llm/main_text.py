"""Main text of web pages by line-block distribution.

Markup is stripped and leaves lines, one for each block of the page. Text in page parts that are named as something other
than the article (menus, headers, footers, sidebars, notices, adverts, forms, reader comments; by element, role, class
or id) does not count, nor do scripts, styles and comments in the markup. A part ends where HTML ends it: at its end
tag, at the end of an element around it, or, where its end tag may be left out, at the tag that implies its end. A part around
nearly all text of the page is not taken for something else.

The lengths of the remaining lines, with their linked text taken off, are summed over sliding windows of ``WIDTH`` lines. The
main text surges where a window's sum rises over the threshold and the windows after it hold text, and dives where a window
holds none; all lines between are kept. The threshold is ``SURGE`` characters, but never more than half of the fullest
window. Names then correct the edges: where most of what the windows keep is in articles that the page names, these
articles are the main text, with their short first and last lines and without what stands beside them.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from panelspark.llm.common import field, map_texts

WIDTH = 3
SURGE = 86
#: Beyond this share of linked text a line outside a named article has no text of its own.
MAX_LINKED = 0.6

#: Elements of HTML.
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    section summary table tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|noscript|iframe|svg|math|object|textarea|select|title"
OTHER_PARTS = frozenset("nav aside footer form head menu button dialog canvas audio video".split())
ARTICLES = frozenset(("article", "main"))
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that name a part as something other than the article.
OTHER_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation
    breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer bottombar colophon copyright sidebar aside
    widget widgets related recommended recommendations share sharing social comment comments commentlist disqus reply replies respond notice
    notices notification alert cookie cookies consent gdpr newsletter subscribe subscription signup login register search form
    popup modal overlay tooltip skip hidden""".split()
)
#: Names that stand for the part as a whole only as the last word: a search page or a header of a post is no such part.
LAST_ONLY = frozenset("search header related recommended recommendations banner hidden skip signup login register subscribe subscription share sharing social".split())
#: What follows ``related`` and its like in the name of a list of other pages.
OTHER_PAGES = frozenset("posts post articles article stories story links items news topics pages videos products content reading".split())
#: A name that begins so tells that the page has, or has not, such a part.
ABOUT = frozenset("has have with without no not is".split())
#: What has a header of its own inside the article.
OWN_HEADER = frozenset("post entry article story content".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: These may hold the article, whatever their names.
NEVER_OTHER = frozenset(("html", "body", "main"))
#: Elements whose end tag may be left out, and the start tags that end them.
IMPLIED = {
    "p": BLOCKS - frozenset(("br", "option", "legend", "caption")),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option", "optgroup")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "tr": frozenset(("tr", "tbody", "tfoot")),
}
#: A part is taken for the article's surroundings after all if it has this many times the text outside of such parts.
AROUND = 10

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


@dataclass
class Line:
    """A block's text: ``linked`` characters of it are in links; ``named`` if it is in a named article."""

    text: str
    linked: int
    named: bool


def _named_other(name: str, named: bool) -> str | None:
    """The word for which a class or id names a part other than the article; only whole names count, not any word in them."""
    words = [w.lower() for w in NAME_PARTS.findall(name)]
    if not words or len(words) > 1 and words[0] in ABOUT:
        return None
    first, last = words[0], words[-1]
    if last in OTHER_NAMES:
        if last == "header" and (named or first in OWN_HEADER):
            return None
        return last
    if first in OTHER_NAMES and (first not in LAST_ONLY or first in ("related", "recommended", "share", "social", "sharing") and last in OTHER_PAGES | {"buttons", "bar", "icons", "box"}):
        return first
    return None


def _other(tag: str, more: str, named: bool) -> bool:
    """Whether an element is a part of the page other than the article."""
    if tag in NEVER_OTHER:
        return False
    if tag in OTHER_PARTS or tag == "header" and not named:
        return True
    if "=" not in more and "hidden" not in more:
        return False
    found = [w for key, *values in ATTRIBUTE.findall(more) if key.lower() in ("class", "id") for name in next(filter(None, values), "").split() if (w := _named_other(name, named))]
    if tag == "article":
        return any(w in COMMENTS for w in found)
    if found or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", more):
        return True
    for key, *values in ATTRIBUTE.findall(more):
        key, value = key.lower(), next(filter(None, values), "")
        if key == "role" and value.lower() in OTHER_ROLES or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return False


def lines(page: str) -> list[Line]:
    """The lines with text of a page, without its other parts, character references decoded and white space made one space."""
    around: set[int] = set()
    while True:
        out, sizes = _lines(page, around)
        inside = sum(len(x.text) for x in out)
        place, most = max(sizes.items(), key=lambda part: part[1], default=(0, 0))
        if most <= max(AROUND * inside, SURGE // 2):
            return out
        around.add(place)  # nothing to speak of is outside this part: look into it


def _lines(page: str, around: set[int]) -> tuple[list[Line], dict[int, int]]:
    """Lines of the page, and the unlinked characters in each other part by its place; parts at ``around`` are none."""
    out: list[Line] = []
    held: list[str] = []
    sizes: dict[int, int] = {}
    inner: list[str] = []  # open elements of the part that is left out, itself first
    linked, links, named, place, at, comments = 0, 0, 0, 0, 0, False

    def add(text: str) -> None:
        nonlocal linked
        if not text:
            return
        if inner:
            if not links and not comments:
                sizes[place] = sizes.get(place, 0) + sum(map(len, text.split()))
            return
        held.append(text)
        if links and not text.isspace():
            linked += len(text)

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        if text:
            out.append(Line(text, min(linked, len(text)), named > 0))
        held.clear()
        linked = 0

    for token in TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        closing, more = token["close"], token["more"]
        if tag == "a":
            links = 0 if closing else 1
        if inner:
            if closing:
                if tag in inner:
                    del inner[len(inner) - 1 - inner[::-1].index(tag) :]
                    continue
                if tag not in BLOCKS:
                    continue
                inner.clear()  # an element around the part ends
            elif tag in ARTICLES and not named and not _other(tag, more, False):
                close()
                inner.clear()
                named = 1
                continue
            elif inner == ["head"] and tag == "body" or len(inner) == 1 and tag in IMPLIED.get(inner[0], ()):
                inner.clear()
            else:
                if tag not in VOID and not more.endswith("/"):
                    inner.append(tag)
                continue
        if tag in BLOCKS:
            close()
        if closing:
            if tag in ARTICLES:
                named = max(0, named - 1)
        elif tag not in VOID and not more.endswith("/") and token.start() not in around and _other(tag, more, named > 0):
            close()
            place, comments = token.start(), any(w in COMMENTS for w in NAME_PARTS.findall(more.lower()))
            inner.append(tag)
        elif tag in ARTICLES:
            named += 1
    add(page[at:])
    close()
    return out, sizes


def main_lines(found: list[Line]) -> list[str]:
    """The lines between the surge and dive points of the distribution, in named articles if most of them are."""
    lengths = [0 if x.linked > MAX_LINKED * len(x.text) and not x.named else len(x.text) - x.linked for x in found]
    sums = [sum(lengths[i : i + WIDTH]) for i in range(len(lengths))]
    threshold = min(SURGE, max(sums, default=0) / 2)
    kept, i = [], 0
    while i < len(sums):
        if sums[i] > threshold and lengths[i]:
            dive = i
            while dive < len(sums) and sums[dive]:
                dive += 1
            last = max(k for k in range(i, dive) if lengths[k])
            kept.extend(range(i, last + 1))
            i = dive
        else:
            i += 1
    inside = sum(len(found[k].text) for k in kept if found[k].named)
    if 2 * inside >= sum(len(found[k].text) for k in kept):
        named = [x.text for x in found if x.named]
        if named:
            return named
    return [found[k].text for k in kept]


def main_text(page: str | None) -> str:
    """The main text of a page, a block to a line; empty for null and for a page without any."""
    return "\n".join(main_lines(lines(page))) if page else ""


def extract(pages: DataFrame, page: str = "html", passed: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``passed`` columns and the main ``text`` of every row's whole page."""

    def start():
        return lambda texts: [[main_text(t) for t in texts.to_pylist()]]

    return map_texts(pages, page, passed, [field("text", "string")], start)
