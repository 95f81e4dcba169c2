"""Derived views of the alignment: unit ends, units, review progress, problems, excluded blocks.

All work within a book is windows over (project_id order by bead_pos), so that a book is sorted once. segs has
project_id, side, block_pos, seg_no, text, excluded, pos, bead_pos; beads has project_id, bead_pos, confidence,
review_level, n_source, n_target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RANKS = {"paragraph": 1, "turn": 2, "sentence": 3}
LOW_CONFIDENCE = 0.5


def block_speech(segs: DataFrame) -> DataFrame:
    """project_id, block_pos, speech of the included source blocks: does their first segment with text open dialogue?"""
    source = segs.where("side = 'source' and not excluded").withColumn("_blank", T.strip(F.col("text")) == "")
    first = F.min_by(T.is_speech(F.col("text")), F.when(~F.col("_blank"), F.col("seg_no")))
    return source.groupBy("project_id", "block_pos").agg(F.coalesce(first, F.lit(False)).alias("speech"))


def unit_ends(beads: DataFrame, segs: DataFrame) -> DataFrame:
    """project_id, bead_pos, turn_end, paragraph_end for the boundary after each bead."""
    source = segs.where("side = 'source' and not excluded and bead_pos is not null").join(block_speech(segs), ["project_id", "block_pos"])
    edges = source.groupBy("project_id", "bead_pos").agg(F.min("block_pos").alias("first_block"), F.max(F.struct("block_pos", "speech")).alias("last_block"))
    rows = beads.select("project_id", "bead_pos").join(edges, ["project_id", "bead_pos"], "left")
    book = Window.partitionBy("project_id").orderBy("bead_pos")
    before = F.last("last_block", ignorenulls=True).over(book.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("project_id").orderBy(F.desc("bead_pos"))
    after = F.last("first_block", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_before", before).withColumn("_after", after)
    outside = F.col("_before").isNull() | F.col("_after").isNull()
    paragraph = outside | (F.col("_before.block_pos") != F.col("_after"))
    return marked.select("project_id", "bead_pos", (paragraph | ~F.col("_before.speech")).alias("turn_end"), paragraph.alias("paragraph_end"))


def with_units(beads: DataFrame, segs: DataFrame, level: str) -> DataFrame:
    """beads with unit_no (from 0): the number of unit ends before the bead; a bead is a unit at sentence level."""
    book = Window.partitionBy("project_id").orderBy("bead_pos")
    if level == "sentence":
        return beads.withColumn("unit_no", F.row_number().over(book).cast("long") - 1)
    ends = unit_ends(beads, segs).select("project_id", "bead_pos", F.col(f"{level}_end").cast("long").alias("_end"))
    before = book.rowsBetween(Window.unboundedPreceding, -1)
    return beads.join(ends, ["project_id", "bead_pos"]).withColumn("unit_no", F.coalesce(F.sum("_end").over(before), F.lit(0))).drop("_end")


def bead_problem(multi: bool = False) -> Column:
    """Low confidence, a missing side or, if asked for, several segments on a side."""
    found = (F.col("confidence") < LOW_CONFIDENCE) | (F.col("n_source") == 0) | (F.col("n_target") == 0)
    return found | (F.col("n_source") > 1) | (F.col("n_target") > 1) if multi else found


def units(beads: DataFrame, segs: DataFrame, level: str, multi: bool = False) -> DataFrame:
    """Units of a level: first and last bead, least confidence, reviewed, problem."""
    return with_units(beads, segs, level).groupBy("project_id", "unit_no").agg(
        F.min("bead_pos").alias("first_bead"),
        F.max("bead_pos").alias("last_bead"),
        F.min("confidence").alias("confidence"),
        F.bool_and(F.col("review_level") >= RANKS[level]).alias("reviewed"),
        (~F.bool_and(F.col("review_level") >= RANKS[level]) & F.bool_or(bead_problem(multi))).alias("problem"),
    )


def unit_texts(beads: DataFrame, segs: DataFrame, level: str) -> DataFrame:
    """project_id, unit_no and both sides' text, segments in document order joined by a space."""
    numbered = with_units(beads, segs, level).select("project_id", "bead_pos", "unit_no")
    side = lambda s: F.expr(f"listagg(CASE WHEN side = '{s}' THEN text END, ' ') WITHIN GROUP (ORDER BY block_pos, seg_no)")
    return segs.where("bead_pos is not null").join(numbered, ["project_id", "bead_pos"]).groupBy("project_id", "unit_no").agg(side("source").alias("source"), side("target").alias("target"))


def progress(beads: DataFrame, segs: DataFrame, level: str = "turn") -> DataFrame:
    """project_id, units and reviewed units."""
    return units(beads, segs, level).groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("reviewed").alias("reviewed"))


def next_unit(found: DataFrame, wanted: Column, name: str) -> DataFrame:
    """For every unit, the next one for which wanted holds, else the first of the book (null if there is none)."""
    book = Window.partitionBy("project_id")
    number = F.when(wanted, F.col("unit_no"))
    later = F.min(number).over(book.orderBy(F.desc("unit_no")).rowsBetween(Window.unboundedPreceding, -1))
    return found.select("project_id", "unit_no", F.coalesce(later, F.min(number).over(book)).alias(name))


def excluded_places(segs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Excluded blocks with after_bead: the last bead before them on their side (null at the start)."""
    last = segs.groupBy("project_id", "side", "block_pos").agg(F.max("bead_pos").alias("_bead"))
    order = Window.partitionBy("project_id", "side").orderBy("block_pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.join(last, ["project_id", "side", "block_pos"], "left").withColumn("after_bead", F.last("_bead", ignorenulls=True).over(order))
    return placed.where("excluded").select("project_id", "side", "block_pos", "kind", "after_bead")


def coarse_points(segs: DataFrame) -> DataFrame:
    """Source segments at which a bead crosses a block break: where a coarse split may be made."""
    order = Window.partitionBy("project_id", "bead_pos").orderBy("block_pos", "seg_no")
    source = segs.where("side = 'source' and bead_pos is not null").withColumn("_last", F.lag("block_pos").over(order))
    return source.where("_last <> block_pos").select("project_id", "bead_pos", "block_pos", "seg_no")
