"""Keeping books: loading, appending, deleting, versions on disk, whole-book documents, reference layers as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .edits import GAP
from .export import LEVELS

KEPT_VERSIONS = 10


def loaded(blocks: DataFrame, gap: int = GAP) -> DataFrame:
    """blocks (project_id, side, block_no) with ord = gap x place in their document."""
    place = F.row_number().over(Window.partitionBy("project_id", "side").orderBy("block_no"))
    return blocks.withColumn("ord", (place.cast("long") - 1) * gap)


def appended(beads: DataFrame, new: DataFrame, gap: int = GAP) -> DataFrame:
    """new beads (project_id, n: their order) with ord after the book's last, a gap apart."""
    last = beads.groupBy("project_id").agg(F.max("ord").alias("_last"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("n")).cast("long")
    return new.withColumn("_k", place).join(last, "project_id", "left").withColumn("ord", F.coalesce(F.col("_last") + F.col("_k") * gap, (F.col("_k") - 1) * gap)).drop("_k", "_last")


def without_books(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """A table without the rows of deleted books; applied to each table of a library it is the cascade."""
    return table.join(deleted.select("project_id"), "project_id", "left_anti")


def kept_versions(versions: DataFrame, keep: int = KEPT_VERSIONS) -> DataFrame:
    """The newest versions (library, version) of each library by name; a second one of the same moment has -2 at its end."""
    newest = Window.partitionBy("library").orderBy(F.desc("version"))
    return versions.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, version: str) -> None:
    """Write all tables of a version; readers take a version only when its last file, _COMPLETE, is there."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").write.parquet(f"{folder}/{version}/_COMPLETE")


def has_work(segs: DataFrame, beads: DataFrame) -> DataFrame:
    """project_id, marked, edited: books with review marks or edited texts, on which no transfer may run."""
    marked = beads.groupBy("project_id").agg(F.bool_or(F.col("review_level") > 0).alias("marked"))
    edited = segs.groupBy("project_id").agg(F.bool_or(F.col("text") != F.col("original_text")).alias("edited"))
    return marked.join(edited, "project_id", "full").select("project_id", F.coalesce("marked", F.lit(False)).alias("marked"), F.coalesce("edited", F.lit(False)).alias("edited"))


def book_documents(segs: DataFrame, beads: DataFrame) -> DataFrame:
    """The whole-book read model: project_id and beads in order, each with its level's name and both sides' texts."""
    texts = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("block_pos", "seg_no", "text")))), lambda x: x["text"]).alias(s)
    sides = segs.where("bead_pos is not null").groupBy("project_id", "bead_pos").agg(texts("source"), texts("target"))
    rows = beads.join(sides, ["project_id", "bead_pos"]).withColumn("level", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("review_level") + 1))
    return rows.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("bead_pos", "confidence", "method", "level", "source", "target"))).alias("beads"))


def gold_json(segs: DataFrame, beads: DataFrame) -> DataFrame:
    """layer_id and a reference layer as JSON for books whose every bead is reviewed; the others are refused (json null)."""
    number = beads.withColumn("bead", F.row_number().over(Window.partitionBy("project_id").orderBy("bead_pos")) - 1)
    placed = segs.join(number.select("project_id", "bead_pos", "bead"), ["project_id", "bead_pos"], "left")
    pair = F.concat(F.lit("["), F.substring(F.to_json(F.array("text")), F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit(","), F.coalesce(F.col("bead").cast("string"), F.lit("null")), F.lit("]"))
    side = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("block_pos", "seg_no", "pair")))), lambda x: x["pair"]), ",")
    sides = placed.withColumn("pair", pair).groupBy("project_id").agg(side("source").alias("_s"), side("target").alias("_t"))
    marks = number.groupBy("project_id").agg(F.bool_and(F.col("review_level") > 0).alias("_all"), F.array_join(F.transform(F.array_sort(F.collect_list("bead")), lambda _: F.lit("true")), ",").alias("_r"))
    text = F.format_string('{"format":1,"source":[%s],"target":[%s],"reviewed":[%s]}', "_s", "_t", "_r")
    return sides.join(marks, "project_id").select(F.col("project_id").alias("layer_id"), F.when(F.col("_all"), text).alias("json"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated rows with a header, without quotes, backslash escaping."""
    df.write.csv(path, sep="\t", quote="", escape="\\", header=True)


def scale_library(spark: SparkSession, books: int, beads: int, words: int = 20_000, per_paragraph: int = 10) -> DataFrame:
    """Segments of a made-up library of one-to-one beads, for timing searches; words are drawn by hashes."""
    rows = spark.range(books * beads * 2).select(F.expr(f"id div {beads * 2}").alias("project_id"), F.expr(f"(id % {beads * 2}) div 2").alias("bead_pos"), F.when(F.col("id") % 2 == 0, "source").otherwise("target").alias("side"), "id")
    word: Column = F.transform(F.sequence(F.lit(0), F.pmod(F.xxhash64("id"), F.lit(12)).cast("int") + 5), lambda k: F.concat(F.element_at(F.array(*map(F.lit, "de la mo ri sta ve cho pu ge no".split())), F.pmod(F.xxhash64("id", k), F.lit(10)).cast("int") + 1), F.conv(F.pmod(F.xxhash64("id", k, F.lit(1)), F.lit(words)).cast("string"), 10, 36)))
    return rows.select("project_id", "side", F.expr(f"bead_pos div {per_paragraph}").alias("block_pos"), (F.col("bead_pos") % per_paragraph).cast("int").alias("seg_no"), F.array_join(word, " ").alias("text"), "bead_pos")
