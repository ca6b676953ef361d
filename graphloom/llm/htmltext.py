"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass judges each block by itself, from its length in words, its link density
(words inside links over all words) and its stop-word density (over the words of ``measures.STOP_WORDS``):

* ``bad``: more than ``LINKS`` of the words are links, or it starts with a copyright sign;
* ``good``: at least ``LONG`` words and a stop-word density of at least ``STOPS``, or at least ``MEDIUM`` words and twice that density;
* ``bad``: at least ``LONG`` words and less than ``STOPS``;
* else it is ambiguous.

In the second pass every ambiguous block takes the label of the nearest block that the first pass decided; at equal distance the one
after it counts, as a heading goes with what follows, and with none decided on the page it is bad. Good blocks, joined by line ends, are the page's text.

Defined results: a null or empty page has an empty text and no blocks; scripts, styles, comments and the head are left
out, up to the end of the page where they aren't closed; a ``<`` that starts no tag is text; rows without page_id
and repeated rows get a row each; an empty table gives none; other columns are ignored. A page of any length, well formed or not, takes
time in proportion to it.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.measures import STOP_WORDS
from graphloom.llm.textkit import chunks

LINKS, STOPS, LONG, MEDIUM = 0.34, 0.05, 30, 15
HIDDEN = {"script", "style", "noscript", "template", "svg", "head", "textarea", "select", "iframe"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
SPECIAL = re.compile(r"[>\"']")
NEAR = 512
WORD = re.compile(r"[^\W_]+")
STOP = frozenset(STOP_WORDS)
CLOSE = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in HIDDEN}

Block = tuple[str, int, int, int]  # text, words, words in links, stop words


class _Ends:
    """Where tags end: at the first ``>`` outside quotes. Looks a short way ahead; where that isn't enough, all ends are worked out at
    once, from the last one back, so that a page of tags that never end takes no more time than its length."""

    def __init__(self, page: str) -> None:
        self.page, self.place, self.end = page, None, None

    def of(self, at: int) -> int:
        """The place after the tag whose attributes begin there, or -1."""
        if self.place is None:
            m = REST.match(self.page, at, at + NEAR)
            if m:
                return m.end()
            self._all()
        return self.end[bisect.bisect_left(self.place, at)]

    def _all(self) -> None:
        self.place = [m.start() for m in SPECIAL.finditer(self.page)]
        self.end = [-1] * (len(self.place) + 1)
        same: dict[str, int] = {}
        for i in range(len(self.place) - 1, -1, -1):
            c = self.page[self.place[i]]
            if c == ">":
                self.end[i] = self.place[i] + 1
            else:
                self.end[i] = self.end[same[c] + 1] if c in same else -1
                same[c] = i


def blocks(page: str) -> list[Block]:
    """The page's blocks that have a word, in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked, links, at, n = 0, 0, 0, len(page)

    def end() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        words = WORD.findall(text.lower())
        if words:
            out.append((text, len(words), min(linked, len(words)), sum(w in STOP for w in words)))
        parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        text = html.unescape(text) if "&" in text else text
        if links:
            linked += len(WORD.findall(text))
        parts.append(text)

    ends, last = _Ends(page), page.rfind(">")
    while at < n:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = n if stop < 0 else stop + 3
            continue
        if start > last:  # nothing closes a tag any more
            comment = page.find("<!--", start)
            at = n if comment < 0 else comment
            say(page[start:at])
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            at = page.index(">", start) + 1
            continue
        m = NAME.match(page, start)
        stop = ends.of(m.end()) if m else -1
        if stop < 0:
            say("<")
            at = start + 1
            continue
        at = stop
        name, closing = m.group(2).lower(), bool(m.group(1))
        if name in HIDDEN and not closing and page[stop - 2] != "/":
            close = CLOSE[name].search(page, at)
            end()
            at = close.end() if close else n
        elif name == "a":
            links = max(0, links - 1) if closing else links + 1
        elif name not in INLINE:
            end()
    end()
    return out


def first_pass(b: Block) -> bool | None:
    text, words, linked, stops = b
    if linked > LINKS * words or text.startswith(("©", "(c)", "Copyright")):
        return False
    density = stops / words
    if words >= LONG:
        return density >= STOPS
    return True if words >= MEDIUM and density >= 2 * STOPS else None


def labels(first: list[bool | None]) -> list[bool]:
    """The second pass."""
    decided = [i for i, x in enumerate(first) if x is not None]
    before, after, out = None, 0, []
    for i, x in enumerate(first):
        while after < len(decided) and decided[after] < i:
            before = decided[after]
            after += 1
        if x is None:
            near = [j for j in (before, decided[after] if after < len(decided) else None) if j is not None]
            x = bool(near) and bool(first[min(near, key=lambda j: (abs(j - i), -j))])
        out.append(x)
    return out


def main_text(page: str | None) -> tuple[str, int, int]:
    """The page's text, and how many blocks it has and keeps."""
    own = blocks(page or "")
    keep = labels([first_pass(b) for b in own])
    return "\n".join(b[0] for b, k in zip(own, keep) if k), len(own), sum(keep)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, text, n_blocks, n_kept)`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            rows = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32()))]], ["page_id", "text", "n_blocks", "n_kept"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_blocks int, n_kept int")
