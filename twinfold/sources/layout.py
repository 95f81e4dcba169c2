"""Layout of pages: from positioned lines to kinded blocks.

lines: doc_id, page (from 0), line_no (reading order in the page), x0, y0, x1, y1, text, size. pages: doc_id, page, width,
height. Everything is grouped sums and windows; a document's constants are joined back to its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values that must be as they are for right results.
BAND, FREQUENT, SLOT_STEP, PURE_SLOT, HEAD_PAGES = 0.15, 0.25, 0.01, 0.8, 3
HEADING, FOOTNOTE, FOOTNOTE_FROM, INDENT, GAP, DEFAULT_PITCH = 1.1, 0.9, 0.6, 0.5, 1.5, 1.2
TWO_UP_PAGE, TWO_UP_DOCUMENT = 0.2, 0.6


def stray_spaces(glyphs: Column) -> Column:
    """Indices of spaces inside a ligature's glyph (array of c, origin_x, x0): the space starts more than a point before
    the origin of the glyph ahead, and the text so far ends in f, fi, fl (any case) or Th."""

    def stray(g: Column, i: Column) -> Column:
        ahead = F.array_join(F.transform(F.slice(glyphs, F.lit(1), i), lambda x: x["c"]), "")
        back = (i > 0) & (g["x0"] < F.get(glyphs, i - 1)["origin_x"] - 1)
        return (g["c"] == " ") & back & ahead.rlike(r"(?:(?i:fi|fl|f)|Th)$")

    return F.filter(F.transform(glyphs, lambda g, i: F.when(stray(g, i), i)), lambda i: i.isNotNull())


def logical_pages(lines: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, pages) with two-up scans cut into left and right pages, in reading order by (y0, x0).

    A page is two-up if each half has a fifth of its lines; a document, if so are three fifths of its landscape pages with
    text. Then every landscape page is two pages.
    """
    placed = lines.join(pages, ["doc_id", "page"])
    left = ((F.col("x0") + F.col("x1")) / 2 < F.col("width") / 2).cast("double")
    halves = placed.where("width > height").groupBy("doc_id", "page").agg(F.avg(left).alias("l"))
    two = halves.groupBy("doc_id").agg((F.avg(((F.col("l") >= TWO_UP_PAGE) & (1 - F.col("l") >= TWO_UP_PAGE)).cast("double")) >= TWO_UP_DOCUMENT).alias("two_up"))
    marked = pages.join(two, "doc_id", "left").withColumn("_cut", F.coalesce("two_up", F.lit(False)) & (F.col("width") > F.col("height")))
    order = Window.partitionBy("doc_id").orderBy("page")
    marked = marked.withColumn("_first", F.sum(F.when(F.col("_cut"), 2).otherwise(1)).over(order) - F.when(F.col("_cut"), 2).otherwise(1))
    halves_of = marked.select("doc_id", "page", "_cut", "_first", "width", "height", F.explode(F.when(F.col("_cut"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_half"))
    new_pages = halves_of.select("doc_id", (F.col("_first") + F.col("_half")).alias("page"), F.when(F.col("_cut"), F.col("width") / 2).otherwise(F.col("width")).alias("width"), "height")
    joined = lines.join(marked.select("doc_id", "page", "_cut", "_first", "width"), ["doc_id", "page"])
    right = F.col("_cut") & ((F.col("x0") + F.col("x1")) / 2 >= F.col("width") / 2)
    shift = F.when(right, F.col("width") / 2).otherwise(0.0)
    moved = joined.select("doc_id", (F.col("_first") + right.cast("int")).alias("page"), (F.col("x0") - shift).alias("x0"), "y0", (F.col("x1") - shift).alias("x1"), "y1", "text", "size")
    reading = Window.partitionBy("doc_id", "page").orderBy("y0", "x0")
    return moved.withColumn("line_no", F.row_number().over(reading) - 1), new_pages


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body: the size (one decimal) that most characters have; of equal ones the first seen."""
    sized = lines.groupBy("doc_id", F.round("size", 1).alias("s")).agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "line_no")).alias("first"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return sized.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("doc_id", F.col("s").alias("body"))


def classified(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines with body and kind: page_number, running_head, heading, footnote or paragraph, in this priority."""
    rows = lines.join(pages, ["doc_id", "page"]).join(body_size(lines), "doc_id")
    middle = (F.col("y0") + F.col("y1")) / 2
    rows = rows.withColumn("_band", F.when(middle <= BAND * F.col("height"), "top").when(middle >= (1 - BAND) * F.col("height"), "bottom"))
    rows = rows.withColumn("_number", F.col("text").rlike(T.PAGE_NUMBER)).withColumn("_small", F.col("size") <= F.col("body") + 0.5)
    rows = rows.withColumn("_size", F.rint("size")).withColumn("_slot", F.rint(middle / F.col("height") / SLOT_STEP))
    rows = rows.withColumn("_head", T.strip(F.lower(F.regexp_replace("text", r"\p{Nd}", ""))))
    count = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_pages"))
    banded = rows.where("_band is not null and _number and _small").groupBy("doc_id", "_band", "_size").agg(F.count_distinct("page").alias("n")).join(count, "doc_id").where(F.col("n") >= FREQUENT * F.col("_pages")).select("doc_id", "_band", "_size", F.lit(True).alias("_frequent"))
    free = F.col("_band").isNull() & F.col("_number") & F.col("_small")
    slots = rows.groupBy("doc_id", "_slot", "_size").agg(F.count_distinct(F.when(free, F.col("page"))).alias("n"), F.count_if(free).alias("k"), F.count(F.lit(1)).alias("every")).join(count, "doc_id")
    slots = slots.where((F.col("n") >= FREQUENT * F.col("_pages")) & (F.col("n") > 0) & (F.col("k") >= PURE_SLOT * F.col("every"))).select("doc_id", "_slot", "_size", F.lit(True).alias("_pure"))
    heads = rows.where("_band = 'top' and _head <> ''").groupBy("doc_id", "_head").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= HEAD_PAGES).select("doc_id", "_head", F.lit(True).alias("_runs"))
    rows = rows.join(banded, ["doc_id", "_band", "_size"], "left").join(slots, ["doc_id", "_slot", "_size"], "left").join(heads, ["doc_id", "_head"], "left")
    kind = (
        F.when(F.col("_number") & F.col("_frequent"), "page_number")
        .when(free & F.col("_pure"), "page_number")
        .when((F.col("_band") == "top") & F.col("_runs"), "running_head")
        .when((F.col("size") >= F.col("body") * HEADING) | F.col("text").rlike(T.CHAPTER_NUMBER), "heading")
        .when((F.col("size") <= F.col("body") * FOOTNOTE) & (middle >= FOOTNOTE_FROM * F.col("height")), "footnote")
        .otherwise("paragraph")
    )
    return rows.withColumn("kind", kind).select(*lines.columns, "body", "kind")


def margins(rows: DataFrame) -> DataFrame:
    """doc_id, page, margin: the smallest rounded x0 that recurs among the page's lines of body size, else the document's
    commonest."""
    body = rows.where(F.round("size", 1) == F.col("body")).withColumn("_x", F.rint("x0"))
    counted = body.groupBy("doc_id", "page", "_x").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    own = counted.where("n >= 2").groupBy("doc_id", "page").agg(F.min("_x").alias("_own"))
    every = counted.groupBy("doc_id", "_x").agg(F.sum("n").alias("n"), F.min(F.struct("page", "first")).alias("first"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    common = every.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("doc_id", F.col("_x").alias("_common"))
    return rows.select("doc_id", "page").distinct().join(own, ["doc_id", "page"], "left").join(common, "doc_id", "left").select("doc_id", "page", F.coalesce("_own", "_common").alias("margin"))


def pitch(rows: DataFrame) -> DataFrame:
    """doc_id, pitch: the median step between neighbouring lines of body size on a page."""
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    steps = rows.withColumn("_body", F.round("size", 1) == F.col("body")).withColumn("_last", F.lag(F.struct("y0", "_body")).over(order))
    found = steps.where("_body and _last._body and y0 > _last.y0").groupBy("doc_id").agg(F.median(F.col("y0") - F.col("_last.y0")).alias("pitch"))
    return rows.select("doc_id", "body").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("pitch", F.col("body") * DEFAULT_PITCH).alias("pitch"))


def assembled(rows: DataFrame) -> DataFrame:
    """classified lines with block_no: paragraphs stay open over lines of excluded kinds and page breaks until an indent, a
    gap or a heading; other kinds go together with their like on the same page; page numbers and running heads are alone."""
    doc = Window.partitionBy("doc_id").orderBy("page", "line_no")
    kind = Window.partitionBy("doc_id", "kind").orderBy("page", "line_no")
    placed = rows.join(margins(rows), ["doc_id", "page"]).join(pitch(rows), "doc_id")
    placed = placed.withColumn("_heads", F.sum((F.col("kind") == "heading").cast("int")).over(doc)).withColumn("_prev", F.lag(F.struct("page", "y0", "_heads")).over(kind)).withColumn("_before", F.lag(F.struct("page", "kind")).over(doc))
    indent = F.col("x0") - F.col("margin") >= INDENT * F.col("size")
    gap = (F.col("_prev.page") == F.col("page")) & (F.col("y0") - F.col("_prev.y0") > GAP * F.col("pitch"))
    opens = (
        F.when(F.col("_prev").isNull() | F.col("kind").isin("page_number", "running_head"), True)
        .when(F.col("kind") == "paragraph", indent | gap | (F.col("_prev._heads") != F.col("_heads")))
        .otherwise(F.coalesce((F.col("_before.kind") != F.col("kind")) | (F.col("_before.page") != F.col("page")), F.lit(True)))
    )
    counted = placed.withColumn("_open", opens.cast("long")).withColumn("_own", F.sum("_open").over(kind))
    first = counted.withColumn("_first", F.min(F.struct("page", "line_no")).over(Window.partitionBy("doc_id", "kind", "_own")))
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_first")).cast("long") - 1
    return first.withColumn("block_no", number).select(*rows.columns, "block_no")
