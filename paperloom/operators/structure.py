"""Documents from positioned text items: lines, page furniture, headings, sections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.session import bound_batches

#: Share of the pages on which furniture repeats, three pages at least, and share of a page's height at its edges.
REPEATS, MIN_PAGES, EDGE = 0.6, 3, 0.12
#: A heading's size against that of the body.
LARGER = 1.12
#: The items of a page, where a row is a page.
ITEMS = "array<struct<item: bigint, x: double, y: double, width: double, size: double, font: string, text: string>>"
_LINES = "doc_id long, page int, line int, raw string, x double, y double, size double, bold boolean"
_FLAT = ("doc_id", "page", "item", "x", "y", "width", "size", "bold", "text")
_BOLD = "bold|black|heavy|semib"


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.combine_chunks().to_numpy(zero_copy_only=False)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The items of whole pages as rows, from the top down, then from the left; those without a place or size are left out."""
    for batch in batches:
        pages, items = batch.column("items"), batch.column("items").flatten()
        part = dict(zip((f.name for f in items.type), items.flatten(), strict=True))
        placed = reduce(pc.and_, (part[c].is_valid() for c in ("x", "y", "size")))
        part = {c: v.filter(placed) for c, v in part.items()}
        row = _numbers(pc.list_parent_indices(pages).filter(placed))
        x, y, item = _numbers(part["x"]), _numbers(part["y"]), _numbers(part["item"].fill_null(np.iinfo(np.int64).min))
        at = pa.array(np.lexsort((item, x, np.where(np.isnan(y), -np.inf, -y), row)))
        font = part["font"].fill_null("").dictionary_encode()
        bold = pa.array([bool(re.search(_BOLD, f, re.IGNORECASE | re.ASCII)) for f in font.dictionary.to_pylist()], pa.bool_()).take(font.indices)
        own = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "page")]
        flat = [*own, pa.array(item), part["x"], part["y"], part["width"].fill_null(0.0), part["size"], bold, part["text"].fill_null("")]
        yield pa.table([c.take(at) for c in flat], names=list(_FLAT))


def _joined(t: pa.Table, first: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
    """The lines that begin at the rows `first` of `t`, numbered `line`, with their items from left to right."""
    size, item = (_numbers(t[c]) for c in ("size", "item"))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
    at = np.lexsort((item, -_numbers(t["y"]), _numbers(t["x"]), of))
    x, y, width, size = (_numbers(t[c])[at] for c in ("x", "y", "width", "size"))
    text = t["text"].combine_chunks().take(pa.array(at))
    said = np.concatenate([[0], np.cumsum(_numbers(pc.binary_length(text)) > 0)])
    with np.errstate(invalid="ignore"):
        gap = x - np.concatenate([[-np.inf], (x + width)[:-1]])
        wide = (gap > size * 0.18) | np.isnan(gap)
    blank = wide & (said[:-1] > said[first][of])
    parts = pc.binary_join_element_wise(pc.if_else(pa.array(blank), " ", ""), text, "")
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(t)), pa.int32()), parts), "")
    begin = t.select(["doc_id", "page"]).take(pa.array(first)).combine_chunks()
    bold = np.logical_or.reduceat(_numbers(t["bold"]), first)
    out = [begin["doc_id"].combine_chunks(), begin["page"].combine_chunks(), pa.array(line, pa.int32()), raw, np.fmin.reduceat(x, first), y[first], np.maximum.reduceat(size, first), bold]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out], names=["doc_id", "page", "line", "raw", "x", "y", "size", "bold"])


def _scan(tables: Iterator[pa.Table | pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of items that come page by page, from the top down, then from the left.

    What decides is the distance to the first item of the line, so this is a scan; the items of the line that is open go on
    to the next batch.
    """
    rest, number = None, 1
    for t in tables:
        t = t if isinstance(t, pa.Table) else pa.Table.from_batches([t])
        if not len(t):
            continue
        if rest is not None:
            t = pa.concat_tables([rest, t])
        doc, page, y = (_numbers(t[c]) for c in ("doc_id", "page", "y"))
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (page[1:] != page[:-1])])
        first, anchor = [], 0.0
        for i, (begins, at, most) in enumerate(zip(new.tolist(), y.tolist(), np.fmax(2.0, _numbers(t["size"]) * 0.5).tolist(), strict=True)):
            if begins or abs(anchor - at) > most:
                anchor = at
                first.append(i)
        first = np.array(first)
        k, begins = np.arange(len(first)), new[first]
        line = k - np.maximum.accumulate(np.where(begins, k, 0)) + 1 + np.where(np.cumsum(begins) == 1, number - 1, 0)
        rest, number = t.slice(first[-1]), int(line[-1])
        if len(first) > 1:
            yield _joined(t.slice(0, first[-1]), first[:-1], line[:-1])
    if rest is not None:
        yield _joined(rest, np.zeros(1, int), np.array([number]))


def lines(items: DataFrame) -> DataFrame:
    """doc_id, page, line (from 1, top down), text, x, y, size, bold: the lines that the items of each page make.

    items: doc_id, page, item (tells items of a page apart, and orders those in one place), x, y (upwards), width, size,
    font, text; or a row a page, with doc_id, page and `items`, an array of the rest as in ITEMS, which no shuffle parts.
    An item begins a line if it is further from the line's first one than half its size, 2 at least. Inside
    a line, items from left to right are parted by a blank where the gap is over .18 of the size. Lines of blanks only are
    left out. Null texts are empty; items without a place or size are left out. Items are scanned in sorted partitions and
    leave the scan as lines, so no page is gathered before its lines are known, and items travel once at most.
    """
    bound_batches(items.sparkSession)
    if "items" in items.columns:
        pages = items.where("doc_id IS NOT NULL AND page IS NOT NULL")
        pages = pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), F.col("items").cast(ITEMS))
        out = pages.mapInArrow(lambda batches: _scan(_spread(batches)), _LINES)
    else:
        known = items.where("doc_id IS NOT NULL AND page IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND size IS NOT NULL")
        slim = known.select(
            F.col("doc_id").cast("long"), F.col("page").cast("int"), F.coalesce(F.col("item").cast("long"), F.lit(-(1 << 63))).alias("item"), F.col("x").cast("double"), F.col("y").cast("double"),
            F.coalesce(F.col("width").cast("double"), F.lit(0.0)).alias("width"), F.col("size").cast("double"), F.coalesce(F.col("font").rlike(f"(?i){_BOLD}"), F.lit(False)).alias("bold"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        out = slim.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", F.desc("y"), "x", "item").mapInArrow(_scan, _LINES)
    # Asked of the text as it came: a condition on the repaired one would have it repaired twice.
    said = F.col("raw").rlike("[!-~]") | (F.length(T.repair(F.col("raw"), normal=True)) > 0)
    return out.where(said).select("doc_id", "page", "line", "x", "y", "size", "bold", T.repair(F.col("raw")).alias("text"))


def mask(text: Column) -> Column:
    """Comparison key of a repaired line with its numbers masked, as page numbers differ from page to page."""
    return F.regexp_replace(T.fold(text), r"\d+", "#")


def furniture(of: DataFrame, pages: DataFrame) -> DataFrame:
    """`of` (lines) plus `repeated`: page headers and footers, and whatever line reads like one.

    pages: doc_id, pages. A line is furniture if, numbers masked, it lies in the upper or lower EDGE of REPEATS of the pages,
    MIN_PAGES at least; documents of fewer pages have none.
    """
    page, line = Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id", "mask")
    top, span = F.max("y").over(page), F.max("y").over(page) - F.min("y").over(page)
    down = (top - F.col("y")) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    # Dealt by document once; all that follows stays there.
    masked = of.repartition("doc_id").withColumns({"mask": mask(F.col("text")), "down": down})
    masked = masked.join(pages.select("doc_id", F.col("pages").alias("_pages")), "doc_id", "left")
    edge = ((F.col("down") <= EDGE) | (F.col("down") >= 1 - EDGE)) & (F.length("mask") >= 2)
    # Of a page's equal lines at its edges one counts.
    masked = masked.withColumn("_edge", F.coalesce(edge, F.lit(False)))
    masked = masked.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "mask", "page").orderBy(F.desc("_edge"))))
    n = F.count(F.when(F.col("_edge") & (F.col("_k") == 1), 1)).over(line)
    often = (F.col("_pages") >= MIN_PAGES) & (n >= F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("_pages") * REPEATS)))
    return masked.withColumn("repeated", F.coalesce(often, F.lit(False))).drop("mask", "down", "_pages", "_edge", "_k")


def _bodies(of: DataFrame) -> DataFrame:
    """`of` plus body, as in `body_sizes`; windows over documents, so that lines dealt by document stay where they are."""
    s = of.withColumn("_size", F.floor(F.col("size") * 2 + 0.5) / 2)
    w = Window.partitionBy("doc_id", "_size")
    s = s.withColumns({"_n": F.sum(F.length("text")).over(w), "_at": F.min(F.struct("page", "line")).over(w)})
    rank = F.struct("_n", F.negative("_at.page").alias("p"), F.negative("_at.line").alias("l"))
    return s.withColumn("body", F.max_by("_size", rank).over(Window.partitionBy("doc_id"))).drop("_size", "_n", "_at")


def body_sizes(of: DataFrame) -> DataFrame:
    """doc_id, body: the size, to halves, that most characters of a document's lines have; the first seen on a tie."""
    return _bodies(of).groupBy("doc_id").agg(F.first("body").alias("body"))


def is_heading(text: Column, number: Column, title: Column, size: Column, bold: Column, body: Column) -> Column:
    """Whether a line is a heading, by its number, its looks and its length together.

    Numbered lines need no more than to be short; others must both stand out and be in capitals. Sentences, dotted lines of
    a table of contents and rows that begin with a date are none.
    """
    n = F.length(text)
    none = text.rlike("[.;,]$") & ~text.rlike(r"^\d") | text.rlike(r"\.{4,}") | text.rlike(r"^\d{1,2}[./]\d{1,2}[./]\d{4}")
    stands_out = (size >= body * LARGER) | (bold & (size >= body))
    capitals = (title == F.upper(F.translate(title, "iı", "İI"))) & (F.length(title) <= 70)
    numbered = F.coalesce(number.rlike(r"^\d"), F.lit(False))
    return n.between(3, 120) & ~none & (F.length(title) >= 3) & (numbered & (stands_out | capitals | (n <= 80)) | stands_out & capitals)


def headings(of: DataFrame) -> DataFrame:
    """Lines that are not `repeated`, in order (`ord`, from 1 in each document), with number, title and heading."""
    kept = of.where(~F.col("repeated"))
    h = T.heading_number(F.col("text"))
    kept = _bodies(kept).withColumns({"number": h["number"], "title": h["title"]})
    kept = kept.withColumn("heading", is_heading(F.col("text"), F.col("number"), F.col("title"), F.col("size"), F.col("bold"), F.col("body")))
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line")))


def last_pages(items: DataFrame) -> DataFrame:
    """doc_id, pages: the last page of each document that has an item."""
    some = items.where(F.size("items") > 0) if "items" in items.columns else items
    return some.groupBy("doc_id").agg(F.max("page").alias("pages"))


def outline(items: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The lines of `headings` that items make, with section: how many headings there are up to the line, 0 before the first.

    pages: doc_id, pages; where not given, the last page that has an item.
    """
    if pages is None:
        pages = last_pages(items)
    begun = F.sum(F.col("heading").cast("int")).over(Window.partitionBy("doc_id").orderBy("ord"))
    return headings(furniture(lines(items), pages)).withColumn("section", begun)


def sections(items: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, section (from 1), number, title, level, page, body, n_words of every heading of the documents that items make.

    pages as in `outline`. A section's body is the lines up to the next heading; what comes before the first heading is in
    none. Documents without headings have no sections.
    """
    found = outline(items, pages).where("section > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("ord", "text"))))
    of = lambda c: F.max(F.when(F.col("heading"), F.col(c))).alias(c)
    out = found.groupBy("doc_id", "section").agg(of("number"), of("title"), of("page"), F.array_join(F.transform(body, lambda x: x["text"]), "\n").alias("body"))
    out = out.withColumn("body", F.trim("body"))
    return out.select(
        "doc_id", "section", "number", "title", T.heading_level(F.col("number")).alias("level"), "page", "body", F.size(T.tokens(F.col("body"))).alias("n_words")
    )
