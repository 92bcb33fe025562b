"""Leaf blocks of an HTML page with their tag paths and feature vectors."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np

# Elements that start a block, elements without content, elements whose text is never shown.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol optgroup option p "
    "pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template title head svg foreignobject annotation annotation-xml iframe object canvas".split())
# Silent elements that may stand inside a line of text and do not cut it.
INLINE_SILENT = SILENT_TAGS - {"title", "head"}
# Start tags that may stand in head; any other one ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes title style script noscript template".split())
# A start tag closes an open element of these kinds before it.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
INSIDE_P = BLOCK_TAGS - {"button", "label", "option", "select", "textarea", "optgroup", "legend", "iframe"}
LISTS = frozenset(("ul", "ol", "dl", "table", "select", "menu", "dir"))

PATH_BUCKETS, WORD_BUCKETS, NUMBERS = 256, 64, 6
WIDTH = PATH_BUCKETS + WORD_BUCKETS + NUMBERS


@dataclass
class Block:
    """One leaf: text with single blanks, path of (tag and attribute words) from the root, share of linked text."""

    text: str
    path: tuple[str, ...]
    linked: float


@dataclass
class _Open:
    tag: str
    words: tuple[str, ...] = field(default=())


class BlockParser(HTMLParser):
    """Reads a page from start to end; every block element starts and ends a leaf. Missing end tags,
    unclosed inline elements and stray end tags are tolerated."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.link_chars, self.in_link, self.silent = 0, False, 0

    def _leaf(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                path = tuple(w for o in self.open if o.tag not in SILENT_TAGS for w in o.words)
                self.blocks.append(Block(text, path, min(1.0, self.link_chars / len(text))))
        self.parts, self.link_chars, self.in_link = [], 0, False

    def _pop(self, count: int) -> None:
        for o in self.open[count:]:
            self.silent -= o.tag in SILENT_TAGS
        del self.open[count:]

    def _last(self) -> str:
        return self.open[-1].tag if self.open else ""

    def handle_starttag(self, tag, attrs):
        if self._last() == "head" and tag not in IN_HEAD:
            self._pop(len(self.open) - 1)
        if self._last() == "svg" and tag in BLOCK_TAGS and tag not in SILENT_TAGS:
            self._pop(len(self.open) - 1)  # page elements end an unclosed drawing
        if tag == "a" and self.silent <= 0:
            self.in_link = True
        if tag == "br":
            self.parts.append(" ")
        if tag not in BLOCK_TAGS and tag not in SILENT_TAGS:
            return
        if self.silent <= 0 and tag not in INLINE_SILENT:
            self._leaf()
        if tag in VOID_TAGS:
            return
        kinds = CLOSES.get(tag, ())
        for i in range(len(self.open) - 1, -1, -1) if tag not in INLINE_SILENT else ():
            if self.open[i].tag in kinds or (self.open[i].tag == "p" and tag in INSIDE_P):
                self._pop(i)
                break
            if self.open[i].tag in LISTS or self.open[i].tag in SILENT_TAGS:
                break
        words = [tag]
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words += ["." + w for w in value.lower().replace("-", " ").replace("_", " ").split()]
            elif name in ("hidden", "aria-hidden"):
                words.append("." + name)
        self.open.append(_Open(tag, tuple(words)))
        self.silent += tag in SILENT_TAGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and self.open and self.open[-1].tag == tag and tag in ("svg", "object", "iframe", "foreignobject"):
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "a" and self.silent <= 0:
            self.in_link = False
        if tag not in BLOCK_TAGS and tag not in SILENT_TAGS:
            return
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == tag), len(self.open))
        if tag not in INLINE_SILENT and not any(o.tag in SILENT_TAGS for o in self.open[:at]):
            self._leaf()
        self._pop(at)

    def handle_data(self, data):
        if self._last() == "head" and data.strip():
            self._pop(len(self.open) - 1)
        if self.silent <= 0:
            self.parts.append(data)
            if self.in_link:
                self.link_chars += len(data.strip())


def page_blocks(html: str | None) -> list[Block]:
    """Leaf blocks in page order; none for null, empty or textless pages."""
    if not html:
        return []
    parser = BlockParser()
    parser.feed(html)
    parser.close()
    parser._leaf()
    return parser.blocks


@lru_cache(maxsize=65_536)
def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % buckets


@lru_cache(maxsize=16_384)
def _path_buckets(path: tuple[str, ...]) -> np.ndarray:
    return np.unique([_bucket(w, PATH_BUCKETS) for w in path] + [_bucket("last:" + path[-1], PATH_BUCKETS)] if path else [0])


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block: tag path, hashed words, and length, links, punctuation and place in the page."""
    x = np.zeros((len(blocks), WIDTH), np.float32)
    for i, block in enumerate(blocks):
        x[i, _path_buckets(block.path)] = 1.0
        words = block.text.split(" ")
        counts = np.bincount([_bucket(w, WORD_BUCKETS) for w in words], minlength=WORD_BUCKETS)
        x[i, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = counts / np.sqrt((counts * counts).sum())
        size = len(block.text)
        marks = sum(block.text.count(c) for c in ".,;:!?")
        x[i, -NUMBERS:] = (np.log1p(size) / 8, np.log1p(len(words)) / 6, block.linked, min(1.0, 10 * marks / size),
                           i / len(blocks), block.text[-1] in ".!?")
    return x
