"""Main text of web pages by wrapper induction: pages of a host are aligned with one of them by simple tree matching."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.url_filter import host_of
from paperloom.llm.words import bound_batches
from paperloom.session import materialize

# Elements that begin and end a block, that have no content, and that hold raw text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
# Elements, words of class and id, and roles that are never main text.
DROPPED = set("head script style noscript template nav footer aside form button select textarea menu dialog iframe object svg canvas audio video title".split())
LABELS = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu "
    "modal nav navbar navigation newsletter notice pager pagination popup promo related share sharing sidebar social sponsored subscribe toolbar".split()
)
ROLES = set("alert banner complementary contentinfo dialog form menu navigation search".split())

# What may follow a label in a name of several parts (ad-box-2), and what, in front, says that there is something else inside.
LAYOUT = set("area bar block bottom box btn button buttons col column container group header inner item items left link links list outer panel right row section slot top unit widget wrap wrapper zone".split())
ABOUT = set("has hide is no not show with without".split())

#: A text is template where it lies right below one element of the reference in this share of the aligned pages, on MIN_CELLS of
#: 64 cells, by a hash of the whole page (eight different pages fill about seven): copies of one page fill one. On hosts of
#: fewer different pages it takes all of the aligned pages, and four cells.
MIN_SHARE, MIN_CELLS, FEW_CELLS = 0.5, 7, 4
#: Where more than this share of what a host's pages say would be template, the pages are near copies of one, which is their content.
MOST_TEMPLATE = 0.9
#: Products of child counts up to which all rows of a matching are kept; longer lists are halved, in linear memory.
WHOLE = 1 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSES_P = BLOCKS - {"html", "head", "body"}
_SELF_CLOSING = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes.strip():
        return False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    names = _CAMEL.sub("-", f"{found.get('class', '')} {found.get('id', '')}").lower().split()
    return any(map(_labelled, names)) or found.get("role", "").lower() in ROLES


@lru_cache(1 << 14)
def _labelled(name: str) -> bool:
    """Whether a class or id says that its element is no main text: a label (ad), a kind of one (site-footer) or a part of
    one (ad-box-2); not whatever contains one (related-work, menu-of-the-day, has-sidebar)."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
    if not parts or parts[0] in ABOUT:
        return False
    return parts[-1] in LABELS or parts[0] in LABELS and all(x in LAYOUT or x.isdigit() for x in parts[1:])


class Page:
    """Block elements in page order (depth, tag, dropped, in the article) and runs of text (element, text)."""

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str, bool, bool]] = []
        self.runs: list[tuple[int, str]] = []
        self._open: list[tuple[str, int, bool, bool, int, int]] = []  # tag, node (-1: inline), dropped, in the article, nearest node, depth
        self._tags: dict[str, int] = {}
        self._text: list[str] = []
        at, size = 0, len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            if not m:
                break
            self._add(source[at : m.start()])
            at = m.end()
            if m[1]:
                self._close(m[1].lower())
            elif m[2]:
                tag, attributes = m[2].lower(), m[3]
                self._begin(tag, attributes)
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(source, at)
                    at = end.start()
        self._add(source[at:])
        self._flush()

    def _add(self, text: str) -> None:
        if text and not (self._open and self._open[-1][2]):
            self._text.append(html.unescape(text))

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if text:
            self.runs.append((self._open[-1][4] if self._open else -1, text))

    def _pop_to(self, depth: int) -> None:
        gone = self._open[depth:]
        if any(x[1] >= 0 for x in gone):
            self._flush()
        for x in gone:
            self._tags[x[0]] -= 1
        del self._open[depth:]

    def _begin(self, tag: str, attributes: str) -> None:
        stops = _SELF_CLOSING.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
        if any(self._tags.get(x) for x in stops):
            for k in range(len(self._open) - 1, -1, -1):
                open_tag = self._open[k][0]
                if open_tag in stops:
                    self._pop_to(k)
                elif open_tag in BLOCKS:
                    break
        above = self._open[-1] if self._open else ("", -1, False, False, -1, 0)
        dropped = above[2] or _unwanted(tag, attributes, above[3])
        inside = above[3] or tag in ("article", "main")
        node, nearest, depth = -1, above[4], above[5]
        if tag in BLOCKS:
            self._flush()
            node = nearest = len(self.nodes)
            self.nodes.append((depth, tag, dropped, inside))
            depth += 1
        elif tag == "br" and not above[2]:
            self._text.append(" ")
        if tag not in EMPTY:
            self._open.append((tag, node, dropped, inside, nearest, depth))
            self._tags[tag] = self._tags.get(tag, 0) + 1

    def _close(self, tag: str) -> None:
        if not self._tags.get(tag):
            return
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                self._pop_to(k)
                return
            if tag not in BLOCKS and self._open[k][1] >= 0:
                return

    def parents(self) -> list[int]:
        """The element that holds each element, -1 for none."""
        path, found = [], []
        for n, (depth, *_) in enumerate(self.nodes):
            del path[depth:]
            found.append(path[-1] if path else -1)
            path.append(n)
        return found

    def shape(self) -> str:
        """The elements without their texts."""
        return ";".join(f"{d}{t}" for d, t, _, _ in self.nodes)

    def content(self) -> list[tuple[int, str]]:
        """Runs of the article, or of the page if it has none, outside dropped elements."""
        article = any(inside and not dropped for _, _, dropped, inside in self.nodes)
        keep = [not dropped and (inside or not article) for _, _, dropped, inside in self.nodes]
        return [(n, t) for n, t in self.runs if (keep[n] if n >= 0 else not article)]


class _Shapes:
    """Trees as numbers: equal subtrees have one number, so that they are compared once."""

    def __init__(self):
        self.known: dict[tuple[str, tuple[int, ...]], int] = {}
        self.tag: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []

    def add(self, shape: str) -> tuple[list[int], list[list[int]]]:
        """Number and children of each element, in page order; a root above them all comes first."""
        tags, kids, path = [""], [[]], [0]
        for part in shape.split(";") if shape else []:
            depth = int(re.match(r"\d+", part)[0])
            del path[depth + 1 :]
            kids[path[-1]].append(len(tags))
            path.append(len(tags))
            tags.append(part.lstrip("0123456789"))
            kids.append([])
        number = [0] * len(tags)
        for i in range(len(tags) - 1, -1, -1):
            name = (tags[i], tuple(number[k] for k in kids[i]))
            if name not in self.known:
                self.known[name] = len(self.tag)
                self.tag.append(name[0])
                self.kids.append(name[1])
                self.size.append(1 + sum(self.size[k] for k in name[1]))
            number[i] = self.known[name]
        return number, kids


def _rows(worth: np.ndarray) -> np.ndarray:
    """Best total of an ordered matching of the first i rows and j columns of `worth`."""
    n, m = worth.shape
    best = np.zeros((n + 1, m + 1), np.int64)
    for i in range(n):
        np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + worth[i]), out=best[i + 1, 1:])
    return best


def _last(value, x: list[int], y: list[int]) -> np.ndarray:
    """The last row of `_rows`, one row of memory at a time."""
    best = np.zeros(len(y) + 1, np.int64)
    for a in x:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + value(a, y)))
    return best


def _matching(value, x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of a best ordered matching of two lists of tree numbers."""
    low = 0
    while low < min(len(x), len(y)) and x[low] == y[low]:
        low += 1
    high = 0
    while high < min(len(x), len(y)) - low and x[-1 - high] == y[-1 - high]:
        high += 1
    # Equal subtrees at the ends are worth the most that either can be worth, so they match each other.
    pairs = [(i, i) for i in range(low)] + [(len(x) - 1 - i, len(y) - 1 - i) for i in range(high)]
    x, y = x[low : len(x) - high], y[low : len(y) - high]
    if x and y and len(x) * len(y) <= WHOLE:
        worth = np.array([value(a, y) for a in x])
        best, i, j = _rows(worth), len(x), len(y)
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((low + i, low + j))
    elif x and y:
        half = len(x) // 2
        if not half:
            worth = value(x[0], y)
            return pairs + ([(low, low + int(worth.argmax()))] if worth.max() > 0 else [])
        cut = int((_last(value, x[:half], y) + _last(value, x[half:][::-1], y[::-1])[::-1]).argmax())
        pairs += [(low + i, low + j) for i, j in _matching(value, x[:half], y[:cut])]
        pairs += [(low + half + i, low + cut + j) for i, j in _matching(value, x[half:], y[cut:])]
    return pairs


@lru_cache(4096)
def align(one: str, two: str) -> dict[int, int]:
    """Elements of the shape `two` by those of `one` that they match: simple tree matching.

    Roots match if their tags are equal; the value of a match is one plus the best matching, in order, of the children.
    Values are found children first, without recursion, so any depth will do.
    """
    s = _Shapes()
    (number_a, kids_a), (number_b, kids_b) = s.add(one), s.add(two)
    memo: dict[tuple[int, int], int] = {}

    def known(a: int, b: int) -> int | None:
        return s.size[a] if a == b else 0 if s.tag[a] != s.tag[b] else memo.get((a, b))

    def value(a: int, y: list[int]) -> np.ndarray:
        return np.array([known(a, b) for b in y], np.int64)

    todo = [(number_a[0], number_b[0])]
    while todo:
        a, b = todo[-1]
        if known(a, b) is not None:
            todo.pop()
            continue
        missing = [(x, y) for x in set(s.kids[a]) for y in set(s.kids[b]) if known(x, y) is None]
        if missing:
            todo += missing
            continue
        x, y = list(s.kids[a]), list(s.kids[b])
        memo[a, b] = 1 + sum(known(x[i], y[j]) for i, j in _matching(value, x, y))
        todo.pop()
    found, todo = {}, [(0, 0)]
    while todo:
        a, b = todo.pop()
        if number_a[a] == number_b[b]:
            found |= {a + k - 1: b + k - 1 for k in range(s.size[number_a[a]])}
            continue
        found[a - 1] = b - 1
        x, y = [number_a[k] for k in kids_a[a]], [number_b[k] for k in kids_b[b]]
        todo += [(kids_a[a][i], kids_b[b][j]) for i, j in _matching(value, x, y)]
    found.pop(-1, None)
    return found


def _best(shapes: list[str | None], page: Page) -> tuple[int, dict[int, int]]:
    """The reference that most elements of the page match, and the reference's elements by the page's."""
    shape, best = page.shape(), (0, {})
    for k, one in enumerate(shapes):
        if one is not None and (m := align(one, shape)) and len(m) > len(best[1]):
            best = k, m
    return best[0], {b: a for a, b in best[1].items()}


_SHAPES = "host string, shapes array<string>"
_TEXTS = "host string, ref int, node int, hash long, pages long, chars long, cells long"
_OUT = "page_id long, url string, text string, n_chars long"


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [[Page(x.as_py() or "").shape() for x in batch.column(c)] for c in ("first", "last")]
        shapes = [[a] if a == b else [a, b] for a, b in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(shapes, pa.list_(pa.string()))], names=["host", "shapes"])


def _places(page: Page, back: dict[int, int]) -> dict[int, tuple[int, int]]:
    """The place of each of the page's elements with text: the reference's element that matches its parent (-2: none above
    it), and a hash of its text. A parent's match does not shift with the number of its children, as their own would."""
    found: dict[int, list[str]] = {}
    for n, t in page.content():
        found.setdefault(n, []).append(t)
    above = page.parents()
    places = {n: (-2 if n < 0 or above[n] < 0 else back.get(above[n]), _crc("\n".join(t))) for n, t in found.items()}
    return {n: x for n, x in places.items() if x[0] is not None}


def _crc(text: str) -> int:
    return crc32(text.encode(errors="replace"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each element of a host's references and each text right below it in this batch: pages, characters, cells of pages.

    Element -1 stands for the whole page.
    """
    for batch in batches:
        got: dict[tuple[str, int, int, int], list[int]] = {}
        for host, shapes, source in zip(batch.column("host"), batch.column("shapes"), batch.column("html"), strict=True):
            page = Page(source.as_py() or "")
            ref, back = _best(shapes.as_py(), page)
            size: dict[tuple[int, int], int] = {}
            places, whole = _places(page, back), page.content()
            for n, t in whole:
                if n in places:
                    size[places[n]] = size.get(places[n], 0) + len(t)
            cell = 1 << (_crc("\n".join(t for _, t in whole)) & 63)
            for (n, h), k in [((-1, 0), sum(len(t) for _, t in whole)), *size.items()]:
                x = got.setdefault((host.as_py(), ref, n, h), [0, 0, 0])
                x[0], x[1], x[2] = x[0] + 1, x[1] + k, x[2] | cell
        cols = [[k[i] for k in got] for i in range(4)] + [[v[i] for v in got.values()] for i in range(2)]
        cells = np.array([v[2] for v in got.values()], np.uint64).view(np.int64)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array(cells)], names=[x.split()[0] for x in _TEXTS.split(", ")])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for shapes, template, source in zip(batch.column("shapes"), batch.column("template"), batch.column("html"), strict=True):
            page, constant = Page(source.as_py() or ""), set()
            wanted = {(x["ref"], x["node"], x["hash"]) for x in template.as_py() or ()}
            if wanted:
                ref, back = _best(shapes.as_py(), page)
                constant = {n for n, x in _places(page, back).items() if (ref, *x) in wanted}
            out.append("\n".join(t for n, t in page.content() if n not in constant))
        text = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text, pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def induce(pages: DataFrame) -> DataFrame:
    """host, shapes, template: each host's reference pages without texts, and the elements and texts that are template.

    The references are the host's pages, not empty, of the smallest and the largest hash. Every page is aligned with the
    one that fits it best, where the page is read; what is gathered are counts per host, element and text, pre-aggregated,
    so that a large host is no hot group. A host where template would be more than nine tenths of what its pages say has
    none: its pages are near copies of one.
    """
    order = F.struct(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), "html")
    some = pages.where(F.length("html") > 0)
    refs = some.groupBy("host").agg(F.min_by("html", order).alias("first"), F.max_by("html", order).alias("last"))
    refs = materialize(refs.mapInArrow(_shapes, _SHAPES), "references")
    seen = some.join(refs.withColumnRenamed("host", "_h"), F.col("host") == F.col("_h")).select("host", "shapes", "html")
    per = seen.mapInArrow(_texts, _TEXTS).groupBy("host", "ref", "node", "hash")
    per = materialize(per.agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.bit_or("cells").alias("cells")), "texts")
    whole = per.where("node = -1").select(F.col("host").alias("_h"), F.col("ref").alias("_r"), F.col("pages").alias("all"), F.col("chars").alias("total"))
    same = per.where("node <> -1").join(whole, (F.col("host") == F.col("_h")) & (F.col("ref") == F.col("_r")))
    usual = (F.col("pages") >= F.col("all") * MIN_SHARE) & (F.bit_count("cells") >= MIN_CELLS)
    same = same.where(usual | (F.col("pages") >= F.col("all")) & (F.bit_count("cells") >= FEW_CELLS))
    found = same.groupBy(F.col("host").alias("_h"), "ref").agg(F.collect_list(F.struct("ref", "node", "hash")).alias("one"), (F.sum("chars") <= F.first("total") * MOST_TEMPLATE).alias("ok"))
    found = found.where("ok").groupBy("_h").agg(F.flatten(F.collect_list("one")).alias("template"))
    return materialize(refs.join(found, F.col("host") == F.col("_h"), "left").drop("_h"), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of `pages` (page_id, url, html; others play no part).

    Null html and pages without main text give an empty text; pages of null or schemeless URLs form the host "". Repeated
    rows are pages each, but copies of one page are no evidence of a template. Elements may be nested to any depth and
    left open. An empty table gives an empty result.
    """
    bound_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = induce(pages).withColumnRenamed("host", "_h")
    return pages.join(wrappers, F.col("host") == F.col("_h"), "left").select("page_id", "url", "html", "shapes", "template").mapInArrow(_extract, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
