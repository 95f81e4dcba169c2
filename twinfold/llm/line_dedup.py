"""Line deduplication across documents, in DataFrame functions alone.

A line's key is the line without white space at its ends and with A-Z in lower case; a key counts if it has
``min_chars`` characters. Keys found in ``min_docs`` documents lose all their lines but those of the largest doc_id
that holds them. Only 128-bit hashes of keys travel. They are pre-aggregated, one row a key and task, to find the common
keys and their holders; the occurrences of common keys are then range-partitioned by hash, document (largest first) and
position and sorted within, so that a task streams each key's occurrences with the holder's first; as the range goes
on to document and position, a very common key spreads over many tasks, and each row carries its key's holder, so that
no task needs to see the whole key. The result is, for each document, a compressed bitmap of the lines to drop; texts
are not moved to find it. A bitmap belongs to doc_id and text together, so that texts that share a doc_id, or have none,
each lose their own lines.

Defined results: a null or empty text is one empty line, which never has a key; repeated rows count as documents of
their own, and rows that share the largest doc_id all keep their lines; rows whose doc_id is null count as documents
but hold a key only if no other does; an empty table gives an empty result; other columns, whatever their names, are
kept out of the result unless they are named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, same_row, text_key
from .quality_rules import let

MIN_CHARS, MIN_DOCS = 20, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the quicker built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _hashed(lines: DataFrame, line: str) -> DataFrame:
    key = F.btrim(F.col(line), F.lit(SPACE_CHARS))
    return lines.withColumn("_key", key).where(F.length("_key") >= MIN_CHARS).withColumn("h1", F.xxhash64("_key")).withColumn("h2", F.xxhash64(F.lit(7), F.col("_key"))).drop("_key", line)


def common_keys(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2 and holder (largest doc_id) of every key found in min_docs documents or more."""
    lines = F.array_distinct(F.transform(F.split(ascii_lower(F.col("text")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS))))
    each = docs.where("text is not null").select("doc_id", F.explode(lines).alias("line"))
    keys = _hashed(each, "line").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("holder"))
    return keys.where(F.col("docs") >= min_docs).select("h1", "h2", "holder")


def drop_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, t1, t2 (see ``text_key``) and drops: array of (word, bits), bit b of word w set if line 64 w + b goes; words without a drop are left out."""
    # Read from a table of its own, the join has a plain exchange on either side, and a common line's rows can be split.
    keys = cut(common_keys(docs, min_docs))
    each = docs.where("text is not null").select("doc_id", *text_key(), F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("pos", "line"))
    found = _hashed(each, "line").join(keys, ["h1", "h2"], "inner")
    # Hash ranges with a secondary sort: first occurrences (of the largest document) stream ahead of those that go.
    ordered = ("h1", "h2", F.desc("doc_id"), "pos")
    found = found.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    gone = found.where(~F.coalesce(F.col("doc_id") == F.col("holder"), F.col("doc_id").isNull() & F.col("holder").isNull()))
    dealt = gone.select("doc_id", "t1", "t2", F.expr("pos div 64").cast("int").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    bits = dealt.groupBy("doc_id", "t1", "t2", "word").agg(F.bit_or("bit").alias("bits"))
    return bits.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def dropped_positions(drops: Column) -> Column:
    """Line numbers that a bitmap drops, in order."""
    return F.flatten(F.transform(drops, lambda d: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(d["bits"], b) == 1), lambda b: d["word"] * 64 + b)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the carried columns, kept_text, n_lines and n_dropped of every row; a text without drops is passed on as it is."""
    rows = docs.select("doc_id", "text", *text_key(), F.struct(*carry).alias("carried") if carry else F.lit(None).alias("carried"))
    marked = bitmaps.select(F.col("doc_id").alias("p_doc"), F.col("t1").alias("p_t1"), F.col("t2").alias("p_t2"), "drops")
    joined = rows.join(marked, same_row(rows, marked), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    positions = dropped_positions(F.col("drops"))
    both = F.struct(F.split(text, "\n", -1).alias("lines"), positions.alias("gone"))
    kept = let(both, lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]), lambda i: s["lines"][i]), "\n"))
    count = F.reduce(F.col("drops"), F.lit(0).cast("long"), lambda acc, d: acc + F.bit_count(d["bits"]))
    return joined.select(
        "doc_id", "text", *(F.col(f"carried.{c}") for c in carry),
        F.when(F.col("drops").isNull(), text).otherwise(kept).alias("kept_text"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(count, F.lit(0).cast("long")).alias("n_dropped"),
    )
