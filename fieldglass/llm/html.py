"""Main text of web pages, with site templates removed.

A page is read into a tree of elements. Every block element that would be output gets a hash of its subtree (tag,
class, id, text and children) and a context, a min-hash of the page's other output. Copies of a page repeat a block in
one context, near copies in few besides a leading one; a site's template repeats it in ever new ones. So Spark counts
contexts per host and hash, and a block is a template of its host if it stands in LEAST contexts (on a small host: in
FEW that make half of its pages) and these are at least half as many as the pages of its commonest context. A block of
under SHORT letters, such as a table's cell, must stand in SHARE of the host's pages in that sense; a block of mostly
links goes too if it is on that share of the pages in any context. Templates are deleted wherever they stand on the host, but never an
element that holds an article or main element: only its recurring children are. Blocks whose markup already says that
they are no content (a nav, a footer) are counted by pages, LEAST of them or on a small host FEW that make half of it.

What recurs on too few pages for that goes if its markup declares it to be no content: menus, headers, footers,
sidebars, forms, scripts and the like by tag, notices, adverts, reader comments and others by role, class or id
(NAMES). If the page has articles (or a main element), only they are read. `n_templates` counts the subtrees that were
deleted from a page because they recur.

Text of a block is one line: character references decoded, white space runs one space, trimmed; empty blocks are
left out. Null and empty html give an empty text. A page without a host shares the host "". Repeated rows are
extracted each (and count as pages); unclosed and stray tags end where HTML ends them; extra columns don't
matter; an empty table gives no rows.
Every step is linear in the page's length, unclosed tags and quotes included.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import cut, text_slices
from fieldglass.llm.urls import host

SHARE, LEAST, FEW, SHORT, BROADCAST_ROWS = 0.2, 10, 3, 25, 200_000
SHINGLE = 2  # words; near copies of short pages then share most
FEW_WORDS = 8  # so short a context is compared whole

# Element names of HTML.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: Elements that are never content.
DROPPED = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video nav header footer aside form button select "
    "option textarea input dialog menu title xmp noembed noframes search map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert status".split())
#: Words of class and id values that name what is no content.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification popup modal overlay newsletter subscribe subscription paywall menu menus nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager sidebar sidebars aside widget widgets related recommended share sharing social header masthead footer "
    "comment comments commentlist disqus reply replies respond toolbar skip login signup search".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that an open list item or paragraph outside them does not reach into.
FENCES = frozenset("article main section aside td th div body button".split())
ENDS_P = BLOCK - {"body", "head", "html", "option", "legend", "caption", "title", "td", "th", "tr", "tbody", "thead", "tfoot"}

_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>\"']*)>")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_OPEN = re.compile(r"<(?=[/!?A-Za-z])")
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BLANK = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "parent", "dropped", "main", "label", "parts", "kids", "hash", "letters", "linked", "holds")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent, self.main = tag, parent, tag in ("article", "main")
        self.dropped = tag in DROPPED
        self.label, self.parts, self.kids, self.hash, self.letters, self.linked, self.holds = "", [], [], None, 0, 0, False
        if attributes and "=" in attributes or "hidden" in attributes:
            for name, *values in _NAMED.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name in ("class", "id"):
                    words = set(_WORD.findall(_CAMEL.sub(" ", value).lower()))
                    self.dropped |= bool(words & NAMES) and tag not in ("html", "body")
                    self.label += f" {name}={value}"
                elif name == "role":
                    self.dropped |= value.lower() in ROLES
                    self.main |= value.lower() == "main"
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    self.dropped |= tag not in ("html", "body")


class Tags:
    """Where the tags of a page end."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.dead: set[int] = set()  # opening quotes from which no tag ends

    def _quoted(self, at: int) -> int:
        """Where the tag ends whose attributes begin at `at`: the first > outside quotes, -1 if there is none."""
        seen = []
        while (m := _MARK.search(self.page, at)) and m.start() not in self.dead:
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            if (mate := self.page.find(m[0], m.end())) < 0:
                break
            at = mate + 1
        self.dead.update(seen)
        return -1

    def other(self, at: int) -> tuple[int, str, str | None, str] | None:
        """(end, slash, name, attributes) of what begins with the < at `at` and is no tag of the plain form: a comment
        or the like has no name; None if it is text."""
        page = self.page
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return end + 3 if end >= 0 else len(page), "", None, ""
        if at > self.last:
            return None
        if page[at + 1] in "!?":
            return page.find(">", at) + 1, "", None, ""
        if m := _NAME.match(page, at):
            end = self._quoted(m.end())
            end = page.find(">", at) if end < 0 else end
            return end + 1, m[1], m[2], page[m.end() : end]
        return None


def parse(page: str) -> tuple[list[Element], list[tuple[Element, str | None]]]:
    """Elements in order of start, and the page as (element, text) in order; text None: a block begins or ends."""
    root = Element("#page", None, "")
    elements, flow, stack, at = [root], [], [root], 0
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places on the stack by tag
    fences: list[int] = []
    tags, seek = Tags(page), 0
    find, plain = page.find, _PLAIN.match

    def close(k: int) -> None:
        for e in stack[k:]:
            if e.tag in BLOCK:
                flow.append((e, None))
                break
        for e in stack[k:]:
            opened[e.tag].pop()
        while fences and fences[-1] >= k:
            fences.pop()
        del stack[k:]

    def top(some) -> int:
        return max((opened[x][-1] for x in some if opened[x]), default=0)

    while (start := find("<", seek)) >= 0:
        if start < tags.last and (m := plain(page, start)):
            stop, (end, tag, attributes) = m.end(), m.groups()
        elif found := tags.other(start):
            stop, end, tag, attributes = found
        else:
            seek = start + 1
            continue
        if start > at:
            flow.append((stack[-1], page[at:start]))
        at = seek = stop
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            if opened[tag]:
                close(opened[tag][-1])
            elif tag in BLOCK:
                flow.append((stack[-1], None))
            continue
        if tag in CLOSES:
            shut, fence = CLOSES[tag]
            k = max(top(shut), top("p") if tag in ENDS_P else 0)
            if k and k >= max(fences[-1] if fences else 0, top(fence)):
                close(k)
        elif tag in ENDS_P and opened["p"] and (not fences or opened["p"][-1] > fences[-1]):
            close(opened["p"][-1])
        element = Element(tag, stack[-1], attributes)
        elements.append(element)
        if tag in BLOCK:
            flow.append((element, None))
        if tag == "br":
            flow.append((stack[-1], " "))
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCK and tag not in RAW):
            continue
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = find(">", shut.end()) if shut else -1
            flow.append((element, page[at : shut.start() if stop >= 0 else len(page)]))
            at = seek = stop + 1 if stop >= 0 else len(page)
            continue
        opened[tag].append(len(stack))
        if tag in FENCES:
            fences.append(len(stack))
        stack.append(element)
    cut_off = _OPEN.search(page, at)  # a tag that the page's end cuts off is no text
    if (stop := cut_off.start() if cut_off else len(page)) > at:
        flow.append((stack[-1], page[at:stop]))
    return elements, flow


def _outline(elements: list[Element], flow: list[tuple[Element, str | None]]) -> None:
    """Fill in subtree hashes, letters and letters in links."""
    for element, piece in flow:
        if piece is not None and (said := _BLANK.sub(" ", piece).strip()):
            element.parts.append(said)
            element.letters += len(said)
    for element in reversed(elements):  # children start after their parents
        element.hash = xxhash.xxh64_intdigest("\x00".join([element.tag, element.label, *element.parts, "\x01", *reversed(element.kids)])) - (1 << 63)
        if element.tag == "a":
            element.linked = element.letters
        element.holds |= element.main
        if (up := element.parent) is not None and element.holds:
            up.holds = True
        if up is not None and (element.letters or element.tag in ("img", "input", "button")):
            up.kids.append(f"{element.hash}")
            up.letters += element.letters
            up.linked += element.linked


def _settle(elements: list[Element], templates: frozenset[int] | set[int] | None = None, deleted: list[Element] | None = None) -> tuple[bool, dict[Element, tuple[bool, bool]]]:
    """Whether the page has a main part; (inside it, dropped) of every element; deleted: takes the templates found."""
    state: dict[Element, tuple[bool, bool]] = {}
    some = False
    for e in elements:
        inside, dropped = state[e.parent] if e.parent is not None else (False, False)
        inside = inside or (e.main and not dropped and not e.dropped)
        if templates and not dropped and e.hash in templates and e.tag in BLOCK and not e.holds:
            dropped = True
            if deleted is not None:
                deleted.append(e)
        state[e] = inside, dropped or e.dropped
        some |= inside
    return some, state


def _least(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Least shingle hash of those that begin up to each word, and from each word on."""
    code = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.minimum.accumulate(h), np.minimum.accumulate(h[::-1])[::-1]


def subtree_contexts(page: str | None) -> dict[int, tuple[int, int]]:
    """Hashes of the page's block subtrees that could be templates, with (kind, context): 1 for short, 2 for links,
    4 for the outermost blocks that their markup calls no content."""
    if not page:
        return {}
    elements, flow = parse(page)
    _outline(elements, flow)
    some, state = _settle(elements)
    words: list[str] = []
    spans: dict[Element, tuple[int, int]] = {}
    for element, piece in flow:
        if piece is None:
            continue
        inside, dropped = state[element]
        if not dropped and (inside or not some) and (said := piece.split()):
            a = spans[element][0] if element in spans else len(words)
            words += said
            spans[element] = a, len(words)
    for element in reversed(elements):
        if element in spans and (up := element.parent) is not None:
            (a, z), (b, y) = spans[element], spans.get(up, spans[element])
            spans[up] = min(a, b), max(z, y)
    before, after = _least(words)
    out: dict[int, tuple[int, int]] = {}
    for e in elements:
        if e in spans and e.tag in BLOCK and e.letters and not e.holds and not state[e][1] and e.tag not in ("html", "body") and e.hash not in out:
            a, z = spans[e]
            rest = [int(x[i]) for x, i in ((before, a - SHINGLE), (after, z)) if 0 <= i < len(x)]
            context = min(rest) if rest and len(words) - z + a > FEW_WORDS else xxhash.xxh64_intdigest(" ".join(words[:a] + words[z:]).encode("utf-8", "replace"))
            out[e.hash] = (e.letters < SHORT) + 2 * (2 * e.linked >= e.letters), context - (1 << 63)
        elif e.dropped and e.tag in BLOCK and e.tag != "head" and e.letters and not e.holds and not state[e.parent][1]:
            out.setdefault(e.hash, (4, 0))
    return out


def read_page(page: str | None, templates: frozenset[int] | set[int] = frozenset()) -> tuple[str, int]:
    """The main text of a page, and how many template subtrees were deleted from it."""
    if not page:
        return "", 0
    elements, flow = parse(page)
    if templates:
        _outline(elements, flow)
    deleted: list[Element] = []
    some, state = _settle(elements, templates, deleted)
    blocks, current = [], []
    for element, piece in [*flow, (elements[0], None)]:
        if piece is None:
            if current and (said := _BLANK.sub(" ", entities.unescape("".join(current))).strip()):
                blocks.append(said)
            current = []
            continue
        inside, dropped = state[element]
        if not dropped and (inside or not some):
            current.append(piece)
    return "\n".join(blocks), len(deleted)


def main_text(page: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    return read_page(page, templates)[0]


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """host, hash of the subtrees that recur in many contexts of a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html", 8 << 20):
                rows: list[tuple] = []
                for name, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    rows.append((name, None, 0, 0))  # counts the page
                    rows += [(name, h, kind, context) for h, (kind, context) in subtree_contexts(page).items()]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "hash", "kind", "context"])

    named = pages.select(host(F.col("url")).alias("host"), "html")
    each = named.mapInArrow(run, "host string, hash long, kind long, context long").groupBy("host", "hash", "kind", "context").count()
    counts = each.groupBy("host", "hash", "kind").agg(F.sum("count").alias("pages"), F.count("*").alias("contexts"), F.max("count").alias("top"))
    counts = cut(counts.where(F.col("hash").isNull() | (F.col("contexts") >= FEW) | (F.col("pages") >= FEW)))  # read twice below
    sizes = counts.where("hash is null").select(F.col("host").alias("_host"), F.col("pages").alias("_pages"))
    many = counts.where("hash is not null").join(sizes, F.col("host") == F.col("_host"))
    short, linked = F.col("kind").bitwiseAND(1) == 1, F.col("kind").bitwiseAND(2) == 2
    enough = (F.col("contexts") >= least) | ((F.col("contexts") >= FEW) & (2 * F.col("contexts") >= F.col("_pages")))
    varied = enough & (2 * F.col("contexts") >= F.col("top")) & (~short | (F.col("contexts") >= F.col("_pages") * share))
    lists = linked & (F.col("pages") >= least) & (F.col("pages") >= F.col("_pages") * share)
    marked = (F.col("pages") >= least) | ((F.col("pages") >= FEW) & (2 * F.col("pages") >= F.col("_pages")))
    plain = F.col("kind") < 4
    return many.where((plain & (varied | lists)) | (~plain & marked)).select("host", "hash").distinct()


SCHEMA = "page_id long, url string, text string, n_chars long, n_templates long"


def extract(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_templates of every row; found: host and hash of the templates, already computed."""
    lists = found.groupBy("host").agg(F.collect_set("hash").alias("_templates")).select(F.col("host").alias("_host"), "_templates")
    if found.count() <= BROADCAST_ROWS:
        lists = F.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html", 8 << 20):
                done = [read_page(page, frozenset(hashes or ())) for hashes, page in zip(part.column("_templates").to_pylist(), part.column("html").to_pylist(), strict=True)]
                numbers = [pa.array([len(t) for t, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([t for t, _ in done], pa.string()), *numbers], names=["page_id", "url", "text", "n_chars", "n_templates"])

    own = pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("_own"))
    joined = own.join(lists, F.col("_own") == F.col("_host"), "left").select("page_id", "url", "html", "_templates")
    return joined.mapInArrow(run, SCHEMA)
