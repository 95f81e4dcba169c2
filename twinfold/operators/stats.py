"""Counts over books: import statistics, bead shapes, the library list, runs with their warnings, level migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .levels import LOW_CONFIDENCE, progress


def import_stats(blocks: DataFrame, segs: DataFrame, beads: DataFrame) -> DataFrame:
    """One row a book: blocks, excluded blocks, segments by side, beads, one-sided and low-confidence beads."""
    of_blocks = blocks.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if("excluded").alias("n_excluded"))
    side = lambda s: F.count_if((F.col("side") == s) & ~F.col("excluded"))
    of_segs = segs.groupBy("project_id").agg(side("source").alias("source_segments"), side("target").alias("target_segments"))
    of_beads = beads.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_beads"),
        F.count_if((F.col("n_source") == 0) | (F.col("n_target") == 0)).alias("one_sided"),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence"),
    )
    return of_blocks.join(of_segs, "project_id", "left").join(of_beads, "project_id", "left").na.fill(0)


def bead_shapes(beads: DataFrame) -> DataFrame:
    """shape (source:target segments) and its beads over the library."""
    return beads.groupBy(F.concat_ws(":", F.col("n_source").cast("string"), F.col("n_target").cast("string")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def library_list(beads: DataFrame, segs: DataFrame) -> DataFrame:
    """One row a book: beads, sentence-reviewed beads, turns, reviewed turns."""
    counts = beads.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_beads"), F.count_if(F.col("review_level") == 3).alias("n_reviewed"))
    turns = progress(beads, segs).select("project_id", F.col("total").alias("turns"), F.col("reviewed").alias("turns_reviewed"))
    return counts.join(turns, "project_id")


def runs_with_warnings(runs: DataFrame, warnings: DataFrame) -> DataFrame:
    """run_id, kind and its warnings in order, as a nested list; newest run first is an order for the reader."""
    nested = warnings.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("warning_id", "message"))), lambda w: w["message"]).alias("warnings"))
    return runs.join(nested, "run_id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def migrated_level(reviewed: Column) -> Column:
    """Review level of a row or snapshot that only had a reviewed flag."""
    return F.when(reviewed, 3).otherwise(0)


def side_stats(blocks: DataFrame, segs: DataFrame) -> DataFrame:
    """One row a book and side: last page (null: none), blocks by kind, excluded blocks, included segments."""
    side = ["project_id", "side"]
    by_kind = blocks.groupBy(*side, "kind").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("page"), F.count_if("excluded").alias("out"))
    of_blocks = by_kind.groupBy(*side).agg(F.max("page").alias("pages"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("blocks"), F.sum("out").alias("excluded_blocks"))
    of_segs = segs.groupBy(*side).agg(F.count_if(~F.col("excluded")).alias("segments"))
    return of_blocks.join(of_segs, side, "left").withColumn("segments", F.coalesce("segments", F.lit(0)))


def book_shapes(beads: DataFrame) -> DataFrame:
    """project_id and its beads by shape, as a map."""
    each = beads.groupBy("project_id", F.concat_ws(":", F.col("n_source").cast("string"), F.col("n_target").cast("string")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("shape", "n")))).alias("shapes"))


def migrated_changes(changes: Column) -> Column:
    """A change log's snapshots (array of table, id, before, after; the last two are maps or null) with levels for flags."""

    def row(values: Column) -> Column:
        level = F.when(F.lower(values["reviewed"]).isin("1", "true"), "3").otherwise("0")
        rest = F.map_filter(values, lambda k, _: k != "reviewed")
        return F.when(F.map_contains_key(values, "reviewed"), F.map_concat(rest, F.create_map(F.lit("review_level"), level))).otherwise(values)

    return F.transform(changes, lambda c: F.struct(c["table"].alias("table"), c["id"].alias("id"), row(c["before"]).alias("before"), row(c["after"]).alias("after")))
