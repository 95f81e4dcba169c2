"""From uploaded bytes to kinded blocks: text and Word files, front and back matter, hyphens, odd glyphs, TSV and JSON."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

LONG_PARAGRAPH, NOTES_WORDS = 60, 6
PUA = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
SAMPLES, LEAST_OCCURRENCES, LEAST_VOTES, LEAD = 16, 8, 2, 2
ASKED_GLYPHS, ASKED_SAMPLES, ANSWER_VOTES = 50, 6, 3
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, extension and content of uploaded files; an unknown extension is an error where it is read."""
    read = spark.read.format("binaryFile").load(path).select("path", "content")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.when(extension.isin("txt", "docx", "pdf"), extension).otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), "path")))
    return read.withColumn("extension", known)


def decoded(content: Column) -> tuple[Column, Column]:
    """(text, warned) of a text file: UTF-8 without its mark, or Latin-1 with a warning."""
    good = F.is_valid_utf8(content.cast("string"))
    text = F.when(good, content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", ""), ~good


def text_blocks(texts: DataFrame) -> DataFrame:
    """doc_id, block_no (from 0), text of plain texts (doc_id, text).

    If a blank line stands between two filled ones, paragraphs are runs of filled lines, joined by a space; otherwise each
    line is a block. Lines are cut as Python's splitlines cuts them; blocks that come out empty are left out. All of it
    happens within the row.
    """
    lines = F.transform(T.text_lines(F.col("text")), T.strip)
    # Lines hold no line feed, so they can be joined by it and cut where there are several; blank ones at the ends go.
    body = F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")
    runs = F.when(F.contains("body", F.lit("\n\n")), F.split("body", "\n\n+", -1)).otherwise(F.split("body", "\n", -1))
    blocks = F.filter(F.transform(runs, lambda run: T.clean(F.replace(run, F.lit("\n"), F.lit(" ")))), lambda block: block != "")
    numbered = texts.select("doc_id", body.alias("body")).select("doc_id", F.posexplode(blocks).alias("block_no", "text"))
    return numbered.withColumn("block_no", F.col("block_no").cast("long"))


def docx_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(kind, text) of the paragraphs of a Word file that hold text; styles named Heading or Title make headings."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{WORD_NS}style"):
                name = style.find(f"{WORD_NS}name")
                names[style.get(f"{WORD_NS}styleId")] = "" if name is None else name.get(f"{WORD_NS}val") or ""
    out = []
    for paragraph in body.iter(f"{WORD_NS}p"):
        style = paragraph.find(f"{WORD_NS}pPr/{WORD_NS}pStyle")
        name = "" if style is None else names.get(style.get(f"{WORD_NS}val"), style.get(f"{WORD_NS}val") or "")
        text = "".join(x.text or "" if x.tag == f"{WORD_NS}t" else "\t" if x.tag == f"{WORD_NS}tab" else "\n" for x in paragraph.iter() if x.tag in (f"{WORD_NS}t", f"{WORD_NS}tab", f"{WORD_NS}br"))
        if text.strip():
            out.append(("heading" if name.lower().startswith(("heading", "title")) else "paragraph", text))
    return out


def docx_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_no, kind, text of Word files (doc_id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(d, k, kind, text) for d, c in zip(rows["doc_id"], rows["content"]) for k, (kind, text) in enumerate(docx_paragraphs(c))]
            yield pd.DataFrame(out, columns=["doc_id", "block_no", "kind", "text"])

    raw = docs.select("doc_id", "content").mapInPandas(run, "doc_id long, block_no long, kind string, text string")
    return raw.withColumn("text", T.clean(F.col("text"))).where("text <> ''")


def with_matter(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_no, kind, text, page) with front and back matter re-kinded.

    The body runs from the first chapter number or long paragraph to the last long paragraph. Publishing markers outside
    it draw the line: paragraphs up to the last one before the body, and from the first one (or notes heading) after it.
    A marker takes the rest of its page with it, a notes heading does not. Two or more markers make a colophon, which is
    no body however long.
    """
    doc = Window.partitionBy("doc_id")
    words = F.size(F.filter(F.split("text", rf"(?U){T.SPACE}+"), lambda w: w != ""))
    markers = F.lit(0)
    for m in T.MARKERS:
        markers = markers + F.contains("text", F.lit(m)).cast("int")
    is_paragraph = F.col("kind") == "paragraph"
    rows = blocks.withColumn("_marked", markers >= 1)
    rows = rows.withColumn("_body", is_paragraph & (words >= LONG_PARAGRAPH) & (markers < 2))
    rows = rows.withColumn("_notes", (F.col("kind") == "heading") & (words <= NOTES_WORDS) & F.col("text").rlike(T.NOTES_HEADING))
    chapter = (F.col("kind") == "heading") & F.col("text").rlike(T.CHAPTER_NUMBER)
    at = F.col("block_no")
    rows = rows.withColumn("_start", F.min(F.when(chapter | F.col("_body"), at)).over(doc)).withColumn("_end", F.max(F.when(F.col("_body"), at)).over(doc))
    rows = rows.withColumn("_front", F.max(F.when(F.col("_marked") & (at < F.col("_start")), F.struct("block_no", "page"))).over(doc))
    rows = rows.withColumn("_back", F.min(F.when((F.col("_marked") | F.col("_notes")) & (at > F.col("_end")), F.struct("block_no", "page", "_notes"))).over(doc))
    same = lambda edge: F.coalesce(F.col("page") == F.col(f"{edge}.page"), F.lit(False))
    front = is_paragraph & ((at <= F.col("_front.block_no")) | ((at < F.col("_start")) & same("_front")))
    reach = (at > F.col("_end")) & same("_back") & ~F.col("_back._notes")
    back = (is_paragraph & ((at >= F.col("_back.block_no")) | reach)) | (F.col("_notes") & (at >= F.col("_back.block_no")))
    kind = F.when(F.coalesce(back, F.lit(False)), "back_matter").when(F.coalesce(front, F.lit(False)), "front_matter").otherwise(F.col("kind"))
    return rows.withColumn("kind", kind).select(*blocks.columns)


def extracted(found: DataFrame) -> DataFrame:
    """doc_id, block_no, kind, text, page, excluded, warned of uploaded files (doc_id, path, content).

    The reader is chosen by the extension, in any case; another one is an error where it is read, and so is PDF, whose lines
    come from elsewhere (``layout``). Front and back matter is marked in all of them.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.when(extension.isin("txt", "docx"), extension).otherwise(F.raise_error(F.concat(F.lit("no reader for this file type: "), "path")))
    files_ = found.select("doc_id", "content", known.alias("extension"))
    text, warned = decoded(F.col("content"))
    plain = files_.where("extension = 'txt'").select("doc_id", text.alias("text"), warned.alias("warned"))
    from_text = text_blocks(plain).withColumn("kind", F.lit("paragraph")).join(plain.select("doc_id", "warned"), "doc_id")
    from_word = docx_blocks(files_.where("extension = 'docx'")).withColumn("warned", F.lit(False))
    blocks = from_text.unionByName(from_word).withColumn("page", F.lit(None).cast("long"))
    return with_matter(blocks.select("doc_id", "block_no", "kind", "text", "page", "warned")).withColumn("excluded", F.col("kind").isin(*T.EXCLUDED_KINDS))


def without_text(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id and path of files (doc_id, path) in which no included block was found: their import is refused."""
    return found.select("doc_id", "path").join(blocks.where("not excluded").select("doc_id"), "doc_id", "left_anti")


LETTER = r"\p{L}"


def lexicon(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, pairs, books) of a book's lines (doc_id, block_no, line_no, text): case-folded words and hyphen pairs seen
    inside lines, and whether the book marks its breaks with soft hyphens. Words that a line break may have cut, at a
    hyphen that ends a line and after it, do not count."""
    order = Window.partitionBy("doc_id", "block_no").orderBy("line_no")
    rows = lines.withColumn("text", T.strip(F.col("text"))).withColumn("_ends", F.col("text").rlike(f"{LETTER}[-­]$"))
    rows = rows.withColumn("_after", F.coalesce(F.lag("_ends").over(order), F.lit(False)))
    inner = F.when(F.col("_after"), F.regexp_replace("text", rf"^{LETTER}+(?:-{LETTER}+)*", "")).otherwise(F.col("text"))
    words = F.when(F.col("_after"), F.regexp_replace("text", rf"^{LETTER}+", "")).otherwise(F.col("text"))
    words = F.when(F.col("_ends"), F.regexp_replace(words, rf"{LETTER}+[-­]$", "")).otherwise(words)
    inner = F.when(F.col("_ends"), F.regexp_replace(inner, rf"{LETTER}+(?:-{LETTER}+)*[-­]$", "")).otherwise(inner)
    of_words = rows.select("doc_id", F.explode(F.regexp_extract_all(F.lower(words), F.lit(f"{LETTER}+"), F.lit(0))).alias("word")).distinct()
    chains = rows.select("doc_id", F.explode(F.regexp_extract_all(F.lower(inner), F.lit(rf"{LETTER}+(?:-{LETTER}+)+"), F.lit(0))).alias("chain")).select("doc_id", F.split("chain", "-").alias("p"))
    of_pairs = chains.select("doc_id", F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("z")).select("doc_id", "z.a", "z.b").distinct()
    books = rows.groupBy("doc_id").agg(F.bool_or(F.col("text").endswith("­")).alias("soft"))
    return of_words, of_pairs, books


def dehyphenated(lines: DataFrame) -> DataFrame:
    """doc_id, block_no, text: a block's lines joined. A soft hyphen vanishes; a hard one after a letter goes if the book's
    own spelling shows that it splits a word, else it stays and the lines meet; other lines are a space apart."""
    words, pairs, books = lexicon(lines)
    order = Window.partitionBy("doc_id", "block_no").orderBy("line_no")
    rows = lines.withColumn("text", T.strip(F.col("text"))).withColumn("_next", F.lead("text").over(order))
    hard = F.col("_next").isNotNull() & F.col("text").rlike(f"{LETTER}-$")
    rows = rows.withColumn("_a", F.when(hard, F.lower(F.regexp_extract("text", f"({LETTER}+)-$", 1)))).withColumn("_b", F.when(hard, F.lower(F.regexp_extract("_next", f"^{LETTER}+", 0))))
    known = rows.join(pairs.select("doc_id", F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_pair")), ["doc_id", "_a", "_b"], "left")
    known = known.withColumn("_ab", F.concat("_a", "_b")).join(words.select("doc_id", F.col("word").alias("_ab"), F.lit(True).alias("_word")), ["doc_id", "_ab"], "left").join(books, "doc_id", "left")
    splits = F.col("_pair").isNull() & (F.col("_b") != "") & F.when(F.col("soft"), F.col("_word").isNotNull()).otherwise(~F.col("_b").isin(*T.PARTICLES))
    piece = (
        F.when(F.col("_next").isNull(), F.col("text"))
        .when(F.col("text").endswith("­"), F.regexp_replace("text", "­$", ""))
        .when(F.col("_a").isNotNull() & splits, F.regexp_replace("text", "-$", ""))
        .when(F.col("_a").isNotNull(), F.col("text"))
        .otherwise(F.concat("text", F.lit(" ")))
    )
    joined = known.withColumn("_piece", piece).groupBy("doc_id", "block_no").agg(F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY line_no)").alias("text"))
    return joined.withColumn("text", F.replace("text", F.lit("­"), F.lit("")))


def glyph_places(texts: DataFrame) -> DataFrame:
    """doc_id, at (from 1), glyph, close and wide (three and forty characters around) of private-use characters.

    A text is cut once at its glyphs; what leaves the row are the glyphs with their neighbourhoods, so a text is not
    copied for each of them.
    """
    glyphs = F.regexp_extract_all("text", F.lit(PUA), F.lit(0))
    parts = F.transform(F.split("text", PUA, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(40)).alias("tail"), F.left(p, F.lit(40)).alias("head")))
    cut = texts.select("doc_id", glyphs.alias("glyphs"), parts.alias("parts")).where("size(glyphs) > 0")
    each = cut.select("doc_id", F.posexplode(F.arrays_zip("glyphs", "parts")).alias("k", "z")).select("doc_id", "k", F.col("z.glyphs").alias("glyph"), F.col("z.parts").alias("p"))
    text = Window.partitionBy("doc_id").orderBy("k")
    before = F.coalesce(F.sum(F.col("p.n") + 1).over(text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The forty characters on either side may hold other glyphs with their own stretches.
    around = lambda side: F.collect_list(F.struct("glyph", f"p.{side}")).over(text.rowsBetween(-40, 0) if side == "tail" else text.rowsBetween(1, 41))
    seen = each.withColumn("at", before + F.col("p.n") + 1).withColumn("_left", around("tail")).withColumn("_right", around("head"))
    left = F.concat(F.array_join(F.transform(F.slice("_left", F.lit(1), F.size("_left") - 1), lambda x: F.concat(x["tail"], F.coalesce(x["glyph"], F.lit("")))), ""), F.element_at("_left", -1)["tail"])
    right = F.array_join(F.transform("_right", lambda x: F.concat(x["head"], F.coalesce(x["glyph"], F.lit("")))), "")
    near = lambda k: F.concat(F.right(left, F.lit(k)), F.col("glyph"), F.left(right, F.lit(k)))
    return seen.where("glyph is not null").select("doc_id", F.col("at").cast("long").alias("at"), "glyph", near(3).alias("close"), near(40).alias("wide"))


def glyph_occurrences(texts: DataFrame) -> DataFrame:
    """doc_id, glyph, n and at most 16 samples (three characters around, forty around) of private-use characters."""
    glyph = Window.partitionBy("doc_id", "glyph")
    rows = glyph_places(texts).withColumn("k", F.row_number().over(glyph.orderBy("at"))).withColumn("n", F.count(F.lit(1)).over(glyph))
    return rows.groupBy("doc_id", "glyph").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= SAMPLES, F.struct("k", "close", "wide")))), lambda s: F.struct(s["close"].alias("close"), s["wide"].alias("wide"))).alias("samples"))


def leading(votes: DataFrame, least: int) -> DataFrame:
    """doc_id, glyph, reading: the reading (votes: doc_id, glyph, reading, at) of each glyph that has ``least`` votes or more
    and twice those of the next; of equal ones the first seen."""
    counted = votes.groupBy("doc_id", "glyph", "reading").agg(F.count(F.lit(1)).alias("v"), F.min("at").alias("first"))
    glyph = Window.partitionBy("doc_id", "glyph").orderBy(F.desc("v"), "first")
    ranked = counted.withColumn("_n", F.row_number().over(glyph)).withColumn("_next", F.coalesce(F.lead("v").over(glyph), F.lit(0)))
    return ranked.where((F.col("_n") == 1) & (F.col("v") >= least) & (F.col("v") >= LEAD * F.col("_next"))).select("doc_id", "glyph", "reading")


def voted(votes: DataFrame, occurrences: DataFrame, least: int = LEAST_OCCURRENCES, vetoes: DataFrame | None = None) -> DataFrame:
    """The ``leading`` reading of each glyph that occurs more than ``least`` times. vetoes (doc_id, glyph, good) are a second
    opinion on readings: only an explicit false takes one back."""
    won = leading(votes, LEAST_VOTES).join(occurrences.where(F.col("n") > least).select("doc_id", "glyph"), ["doc_id", "glyph"], "left_semi")
    return won if vetoes is None else won.join(vetoes.where("good = false").select("doc_id", "glyph"), ["doc_id", "glyph"], "left_anti")


def open_questions(occurrences: DataFrame, readings: DataFrame, most: int = ASKED_GLYPHS) -> DataFrame:
    """doc_id, glyph, n and samples (six at most) of the glyphs without a reading that a reader is asked about: the
    commonest of a document, as many as ``most``; the limit is the feature."""
    left = occurrences.join(readings.select("doc_id", "glyph"), ["doc_id", "glyph"], "left_anti")
    rank = Window.partitionBy("doc_id").orderBy(F.desc("n"), "glyph")
    return left.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= most).select("doc_id", "glyph", "n", F.slice("samples", 1, ASKED_SAMPLES).alias("samples"))


def filled(answers: DataFrame) -> DataFrame:
    """doc_id, glyph, reading from a reader's answers (doc_id, glyph, at, answer: JSON with ``reading``): one to four letters
    count as a vote, anything else does not; three votes and twice those of the next decide."""
    read = F.get_json_object("answer", "$.reading")
    votes = answers.select("doc_id", "glyph", "at", read.alias("reading")).where(F.col("reading").rlike(r"^\p{L}{1,4}$"))
    return leading(votes, ANSWER_VOTES)


def glyphs_replaced(texts: DataFrame, readings: DataFrame) -> DataFrame:
    """texts with each document's glyphs read; private-use characters without a reading become U+FFFD."""
    table = readings.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("glyph", "reading"))).alias("_map"))
    read = F.reduce(F.map_entries("_map"), F.col("text"), lambda t, e: F.replace(t, e["key"], e["value"]))
    return texts.join(table, "doc_id", "left").withColumn("text", F.regexp_replace(F.when(F.col("_map").isNull(), F.col("text")).otherwise(read), PUA, "�")).drop("_map")


def decisions(spark: SparkSession, path: str, columns: list[str], allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows of a tab-separated decision table without quotes, backslash escaping; a wrong header or value is an error."""
    read = spark.read.csv(path, sep="\t", quote="", escape="\\", header=True, enforceSchema=False)
    if read.columns != columns:
        raise ValueError(f"expected the columns {columns}, found {read.columns}")
    for name, values in allowed.items():
        read = read.withColumn(name, F.when(F.col(name).isin(*values), F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"{name} can't be "), F.coalesce(name, F.lit("empty"))))))
    return read


def gold_layer(texts: DataFrame) -> DataFrame:
    """layer_id, side, pos, text, bead of reference layers written as JSON (layer_id, json)."""
    schema = "format long, source array<array<string>>, target array<array<string>>, reviewed array<boolean>"
    parsed = texts.select("layer_id", F.from_json("json", schema).alias("g")).withColumn("g", F.when(F.col("g.format") == 1, F.col("g")).otherwise(F.raise_error(F.lit("unknown format of reference layer"))))
    side = lambda s: parsed.select("layer_id", F.lit(s).alias("side"), F.posexplode(f"g.{s}").alias("pos", "pair"))
    both = side("source").unionByName(side("target"))
    return both.select("layer_id", "side", F.col("pos").cast("long").alias("pos"), F.col("pair")[0].alias("text"), F.col("pair")[1].cast("long").alias("bead"))
