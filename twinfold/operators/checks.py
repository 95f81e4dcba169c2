"""Invariants of a book, each as the rows that break it. beads are told apart by bead_id; ord is their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def i1(segs: DataFrame) -> DataFrame:
    """Segments with a bead in an excluded block, or without one in an included block."""
    return segs.where(F.col("excluded") == F.col("bead_id").isNotNull()).select("project_id", F.concat(F.lit("I1: segment "), F.col("seg_id").cast("string")).alias("message"))


def i2(segs: DataFrame, beads: DataFrame) -> DataFrame:
    """Segments whose bead is of another book (or of none)."""
    own = beads.select("bead_id", F.col("project_id").alias("_other"))
    return segs.where("bead_id is not null").join(own, "bead_id", "left").where("_other is null or _other <> project_id").select("project_id", F.concat(F.lit("I2: segment "), F.col("seg_id").cast("string")).alias("message"))


def i3(segs: DataFrame, beads: DataFrame) -> DataFrame:
    """Beads without a segment."""
    return beads.join(segs.where("bead_id is not null").select("bead_id"), "bead_id", "left_anti").select("project_id", F.concat(F.lit("I3: bead "), F.col("bead_id").cast("string")).alias("message"))


def i4(segs: DataFrame, beads: DataFrame) -> DataFrame:
    """Included segments whose bead comes before that of the segment before them on their side."""
    order = Window.partitionBy("project_id", "side").orderBy("block_ord", "seg_ord", "seg_id")
    placed = segs.where("not excluded and bead_id is not null").join(beads.select("bead_id", F.col("ord").alias("bead_ord")), "bead_id")
    return placed.withColumn("_last", F.lag("bead_ord").over(order)).where("_last > bead_ord").select("project_id", F.concat(F.lit("I4: segment "), F.col("seg_id").cast("string")).alias("message"))


def i5(segs: DataFrame, beads: DataFrame) -> DataFrame:
    """Negative positions of beads, blocks and segments."""
    bead = beads.where("ord < 0").select("project_id", F.concat(F.lit("I5: bead "), F.col("bead_id").cast("string")).alias("message"))
    block = segs.where("block_ord < 0").select("project_id", F.concat(F.lit("I5: block "), F.col("block_id").cast("string")).alias("message")).distinct()
    segment = segs.where("seg_ord < 0").select("project_id", F.concat(F.lit("I5: segment "), F.col("seg_id").cast("string")).alias("message"))
    return bead.unionByName(block).unionByName(segment)


def report(segs: DataFrame, beads: DataFrame) -> DataFrame:
    """All violations, with the invariant's code first in the message."""
    return reduce(DataFrame.unionByName, [i1(segs), i2(segs, beads), i3(segs, beads), i4(segs, beads), i5(segs, beads)])
