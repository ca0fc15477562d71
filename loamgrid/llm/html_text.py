"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once, tag by tag, into a flat list of blocks. A block's features are its words and link density, those of the blocks
before and after it, whether it is a heading, what containers are open around it, and how much of the page lies in containers whose
names speak against them, so that words and links can overrule names. The tree is grown (Gini impurity) from the labelled table in
labelled_pages.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamgrid.llm.common import map_batches, texts
from loamgrid.llm.labelled_pages import pages

#: Fixed values of HTML: elements whose content is raw text, others whose content is no text, elements that begin and end a block.
RAW = frozenset("script style noscript template iframe textarea title".split())
SILENT = frozenset("svg object select audio video canvas math datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article aside button details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers that hold something else than the article, or the article.
APART = frozenset("nav footer aside form dialog menu button".split())
ARTICLE = frozenset("article main".split())
#: Words of a container's class, id or role: for what isn't the article, for the article, for layout around either, and words that
#: say of a container that it has such a part.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer gdpr header legal login "
    "masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related reply replies search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
ARTICLE_WORDS = frozenset("article articlebody content entry main maincontent post story".split())
LAYOUT_WORDS = frozenset("wrap wrapper container layout grid row inner outer page body site columns".split())
HAVING_WORDS = frozenset("has with without no is hide show toggle layout template page".split())

#: A tag without a stray quote or bracket; what begins otherwise is read by attribute. Each match ends before the next bracket.
PLAIN_TAG = re.compile(r"<(/?)([a-z][^\s/>]*+)((?:[^<>\"']*+(?:\"[^\"<>]*+\"|'[^'<>]*+'))*+[^<>\"']*+)>", re.I)
NAME = re.compile(r"[a-z][^\s/>]*+", re.I)
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+(=)\s*+)?")
VALUE = re.compile(r"[^\s>]*+")

FEATURES = ("apart", "named_apart", "in_article", "page_has_article", "page_apart", "words", "links", "words_before", "links_before", "words_after", "links_after", "heading")


@dataclass
class Block:
    text: str
    words: int
    links: float  # share of the words that are in links
    apart: bool  # in an element that is no article by its kind, or hidden
    named: bool  # in one that is none by its name
    in_article: bool
    heading: bool


class Reader:
    """Tags of a page in their order; work is linear in its length, as what is looked for in vain is looked for once."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.missing: set[str] = set()
        self.lowered: str | None = None

    def find(self, what: str, at: int) -> int:
        """Where `what` stands from `at` on, or -1; places are asked for in ascending order."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def closing(self, name: str, at: int) -> int:
        """Where the next closing tag of this name begins, or -1."""
        what = "</" + name
        if what in self.missing:
            return -1
        if self.lowered is None:  # letter by letter: lower() of the whole could change its length
            self.lowered = self.page.lower() if self.page.isascii() else self.page.translate(LOWER)
        found = self.lowered.find(what, at)
        while found >= 0 and self.lowered[found + len(what) : found + len(what) + 1] not in ENDS:
            found = self.lowered.find(what, found + 1)
        if found < 0:
            self.missing.add(what)
        return found

    def attributes(self, at: int) -> tuple[int, list[tuple[str, str]]]:
        """Where a tag ends whose name ends at `at` (-1: nowhere), and its attributes. Quotes open a value only after =; one that never
        closes is part of an unquoted value."""
        page, out = self.page, []
        while True:
            m = ATTRIBUTE.match(page, at)
            if not m:
                end = self.find(">", at)
                return (end + 1 if end >= 0 else -1), out
            at, value = m.end(), ""
            if m[2]:
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote in ("'", '"') else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    v = VALUE.match(page, at)
                    value, at = v[0], v.end()
            out.append((m[1].lower(), value))

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, list[tuple[str, str]], bool]]:
        """(begin, end, name, closes, attributes, whether it closes itself) of each tag; comments and the like have no name."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            after = page[at + 1 : at + 2]
            if after == "!" or after == "?":
                comment = page.startswith("<!--", at)
                end = self.find("-->", at + 4) if comment else self.find(">", at)
                end = len(page) if end < 0 else end + (3 if comment else 1)
                yield at, end, "", False, [], False
                at = end
                continue
            if m := PLAIN_TAG.match(page, at):
                begin, at, rest = at, m.end(), m[3]
                given = Reader(rest).attributes(0)[1] if "=" in rest or "hidden" in rest else []
                yield begin, at, m[2].lower(), bool(m[1]), given, rest.endswith("/") or m[2].endswith("/")
                continue
            closes = after == "/"
            m = NAME.match(page, at + 1 + closes)
            if not m:
                if closes and (end := self.find(">", at)) >= 0:  # </ before anything else is a comment
                    yield at, end + 1, "", False, [], False
                    at = end + 1
                else:
                    at += 1
                continue
            end, given = self.attributes(m.end())
            if end < 0:  # the tag never ends
                yield at, len(page), "", False, [], False
                return
            yield at, end, m[0].lower(), closes, given, page[end - 2] == "/"
            at = end


LOWER = {c: c + 32 for c in range(65, 91)}
ENDS = frozenset(["", ">", "/", " ", "\t", "\n", "\f", "\r"])


def spoken(names: str) -> tuple[bool, bool]:
    """(apart, article) by the names in a class, id or role. The last word of a name that isn't mere layout counts (post-comments); a
    name of layout around both kinds, and one that begins with what it has (has-sidebar), says nothing."""
    apart = article = False
    for name in names.lower().split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        if not words or (len(words) > 1 and words[0] in HAVING_WORDS):
            continue
        kinds = {w in APART_WORDS for w in words if w in APART_WORDS or w in ARTICLE_WORDS}
        heads = [w for w in words if w not in LAYOUT_WORDS]
        if not kinds or (len(kinds) == 2 and len(heads) < len(words)):
            continue
        said = [w for w in heads if w in APART_WORDS or w in ARTICLE_WORDS]
        last = said[-1] in APART_WORDS if said else False
        apart, article = apart or last, article or (bool(said) and not last)
    return apart, article


def _kind(name: str, given: list[tuple[str, str]], inside_article: bool) -> tuple[bool, bool, bool]:
    """(apart by its kind, apart by its name, article) of a container."""
    apart, article = name in APART or (name == "header" and not inside_article), name in ARTICLE
    named = False
    for key, value in given:
        if key in ("class", "id", "role"):
            against, for_it = spoken(value)
            named |= against
            article |= for_it
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*+:\s*+none", value, re.I)):
            apart = True
    return apart, named, article and not apart and not named


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in their order; blocks without a word are left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, apart, named, article, silent
    open_names: Counter = Counter()
    depth = [0, 0, 0, 0]  # how many open containers are apart, named, an article, silent
    parts: list[str] = []
    linked = at = 0
    in_link = heading = False

    def flush() -> None:
        nonlocal parts, linked
        if not parts:
            return
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = text.count(" ") + 1
            out.append(Block(text, n, min(1.0, linked / n), depth[0] > 0, depth[1] > 0, depth[2] > 0, heading))
        parts, linked = [], 0

    def shut(name: str) -> None:
        """Closes the innermost open container of this name and all in it."""
        while open_names[name]:
            last = stack.pop()
            open_names[last[0]] -= 1
            for i in range(4):
                depth[i] -= last[i + 1]
            if last[0] == name:
                return

    reader = Reader(page)
    skip = 0  # up to where raw text goes
    for begin, end, name, closes, given, alone in reader:
        if begin < skip:
            continue
        if begin > at and not depth[3]:
            text = page[at:begin]
            parts.append(text)
            if in_link:
                linked += len(html.unescape(text).split())
        at = end
        if name in RAW:
            if not closes and not alone:
                close = reader.closing(name, end)
                at = skip = close if close >= 0 else len(page)
        elif name in SILENT:
            if closes:
                if open_names[name]:
                    shut(name)
            elif not alone and reader.closing(name, end) >= 0:
                stack.append((name, False, False, False, True))
                open_names[name] += 1
                depth[3] += 1
        elif name == "a":
            in_link = not closes
        elif name in BLOCK:
            flush()
            if name in HEADING:
                heading = not closes
            if name in CONTAINER:
                if closes:
                    if open_names[name]:
                        shut(name)
                else:
                    kind = _kind(name, given, depth[2] > 0)
                    stack.append((name, *kind, False))
                    open_names[name] += 1
                    for i in range(3):
                        depth[i] += kind[i]
                in_link = False
        elif name in ("br", "img"):
            parts.append(" ")
    if not depth[3]:
        parts.append(page[at:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """(blocks, FEATURES); before the first and after the last block there are no words. page_apart: the share of the page's words
    outside apart elements that lie in containers apart by their names."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    own = np.array([(b.words, b.links) for b in found])
    none = np.zeros((1, 2))
    flags = np.array([(b.apart, b.named, b.in_article and not b.apart and not b.named, 0, 0, b.heading) for b in found], float)
    flags[:, 3] = flags[:, 2].any()
    other = own[:, 0] * (1 - flags[:, 0])
    flags[:, 4] = (other * flags[:, 1]).sum() / max(1.0, other.sum())
    return np.c_[flags[:, :5], own, np.r_[none, own[:-1]], np.r_[own[1:], none], flags[:, 5]]


class Tree:
    """Binary decision tree: (feature, threshold, left, right) or a leaf's class."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10) -> None:
        self.root = self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if depth == 0 or y.min() == y.max():
            return bool(y.mean() >= 0.5)
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                n, left = len(y), cut + 1
                p, q = c[cut] / left, (c[-1] - c[cut]) / (n - left)
                impurity = left * p * (1 - p) + (n - left) * q * (1 - q)
                i = int(impurity.argmin())
                if best is None or impurity[i] < best[0] - 1e-9:
                    best = (impurity[i], f, (v[cut[i]] + v[cut[i] + 1]) / 2)
        if best is None:
            return bool(y.mean() >= 0.5)
        _, f, t = best
        low = x[:, f] <= t
        return f, float(t), self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)

        def down(node, rows: np.ndarray) -> None:
            if isinstance(node, bool):
                out[rows] = node
            elif len(rows):
                low = x[rows, node[0]] <= node[1]
                down(node[2], rows[low])
                down(node[3], rows[~low])

        down(self.root, np.arange(len(x)))
        return out


def labelled() -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page in pages():
        found = blocks(page)
        x.append(features(found))
        y += [b.text[0] == "+" for b in found]
    return np.concatenate(x), np.array(y)


@functools.lru_cache(maxsize=1)
def tree() -> Tree:
    return Tree(*labelled())


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, k in zip(found, tree().predict(features(found)), strict=True) if k)


TEXT = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]


def extract(pages_table: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html); other columns are ignored.

    The text of null, empty or text-less html is the empty string. White space inside a block becomes one space, blocks are joined by
    a line feed. Rows that repeat are read as often. Pages of any length are read whole; work is linear in a page's length.
    """

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            got = [main_text(t) for t in texts(batch, "html")]
            return [pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())]

        return work

    return map_batches(pages_table.select("page_id", "url", "html"), start, TEXT, ["page_id", "url"])
