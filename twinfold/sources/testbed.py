"""A parallel library made from flat tables: conversations become books with blocks, segments and beads.

User turns are the source side and assistant turns the target side; system turns are excluded front matter of the
source. Lines are blocks, sentences are segments. Beads zip the segments of both sides in order; where the book's id is
odd, two source segments go with one target segment. Confidence and review levels are arithmetic on ids, so that any
SQL engine can make the same library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search
from .stored import stored

GAP = 1024


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, side, block_pos (from 1), ord, kind, excluded, text; every third source block opens dialogue."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = rows.select(F.col("conv_id").alias("project_id"), "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("text", T.clean(F.col("line"))).where("text <> ''").withColumn("side", F.when(F.col("role") == "assistant", "target").otherwise("source"))
    order = Window.partitionBy("project_id", "side").orderBy("turn", "line_no")
    placed = lines.withColumn("block_pos", F.row_number().over(order).cast("long"))
    excluded = F.col("role") == "system"
    speech = ~excluded & (F.col("side") == "source") & ((F.col("block_pos") + F.col("project_id")) % 3 == 0)
    return placed.select(
        "project_id", "side", "block_pos", ((F.col("block_pos") - 1) * GAP).alias("ord"),
        F.when(excluded, "front_matter").otherwise("paragraph").alias("kind"), excluded.alias("excluded"),
        F.when(speech, F.concat(F.lit("— "), F.col("text"))).otherwise(F.col("text")).alias("text"),
    )


def segments(of_blocks: DataFrame) -> DataFrame:
    """blocks cut into sentences: seg_no in the block (from 0), pos among the side's included segments (null: excluded)."""
    cut = of_blocks.select("project_id", "side", "block_pos", "kind", "excluded", F.posexplode(T.sentences(F.col("text"))).alias("seg_no", "text"))
    order = Window.partitionBy("project_id", "side", "excluded").orderBy("block_pos", "seg_no")
    return cut.withColumn("pos", F.when(~F.col("excluded"), F.row_number().over(order).cast("long") - 1))


def zipped(of_segments: DataFrame) -> DataFrame:
    """segments with bead_pos (from 0; null where excluded): the ordinal zip."""
    source = F.expr("pos div (1 + project_id % 2)")
    return of_segments.withColumn("bead_pos", F.when(F.col("side") == "source", source).otherwise(F.col("pos")))


def beads(with_beads: DataFrame) -> DataFrame:
    """project_id, bead_pos, n_source, n_target, confidence, review_level, method."""
    count = lambda side: F.sum((F.col("side") == side).cast("long"))
    found = with_beads.where("bead_pos is not null").groupBy("project_id", "bead_pos").agg(count("source").alias("n_source"), count("target").alias("n_target"))
    return found.select("*", confidence().alias("confidence"), review_level().alias("review_level"), F.lit("length").alias("method"))


def confidence() -> Column:
    return F.pmod(F.col("bead_pos") * 37 + F.col("project_id") * 11, F.lit(100)) / 100


def review_level() -> Column:
    return F.pmod(F.col("bead_pos") * 7 + F.col("project_id") * 3, F.lit(4)).cast("int")


class Library:
    """The tables of a library, written once in the shared folder and read from there, books in order."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.source = spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")
        folder = stored(spark, "library", self.source, lambda f: self._write(sf_dir, f))
        self.blocks, self.segments, self.beads = (spark.read.parquet(f"{folder}/{name}") for name in ("blocks", "segments", "beads"))

    def _write(self, sf_dir: str, folder: str) -> None:
        by_book = lambda df, *order: df.repartitionByRange("project_id").sortWithinPartitions("project_id", *order)
        by_book(blocks(self.spark, sf_dir), "side", "block_pos").write.parquet(f"{folder}/blocks")
        of_segments = zipped(segments(self.spark.read.parquet(f"{folder}/blocks")))
        by_book(of_segments, "side", "block_pos", "seg_no").write.parquet(f"{folder}/segments")
        by_book(beads(self.spark.read.parquet(f"{folder}/segments")), "bead_pos").write.parquet(f"{folder}/beads")

    @property
    def index(self) -> DataFrame:
        """The search index, written once like the tables."""
        folder = stored(self.spark, "index", self.source, lambda f: search.write_index(search.bead_tokens(search.bead_texts(self.segments)), f))
        return search.read_index(self.spark, folder)


#: The same library for an engine with RE2 expressions (no look-around), as common table expressions.
SQL = r"""
lines AS (
  SELECT conv_id AS project_id, turn, role, u.line_no, u.line
  FROM conversations, UNNEST(string_split(text, chr(10))) WITH ORDINALITY AS u(line, line_no)
), cleaned AS (
  SELECT *, CASE WHEN role = 'assistant' THEN 'target' ELSE 'source' END AS side,
    trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(line, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'),
      '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+', ' ', 'g'), '[\s\p{Z}\x85]+', ' ', 'g')) AS body
  FROM lines
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, side ORDER BY turn, line_no) AS block_pos FROM cleaned WHERE body <> ''
), blocks AS (
  SELECT project_id, side, block_pos, (block_pos - 1) * 1024 AS ord, CASE WHEN role = 'system' THEN 'front_matter' ELSE 'paragraph' END AS kind,
    role = 'system' AS excluded,
    CASE WHEN role <> 'system' AND side = 'source' AND (block_pos + project_id) % 3 = 0 THEN '— ' || body ELSE body END AS text
  FROM placed
), marked AS (
  SELECT *, regexp_replace(regexp_replace(text,
      '([.?!…]+(?:[\s\p{Z}]*[»”"’)\]])*)([\s\p{Z}]+(?:[«“"(—–][\s\p{Z}]*|-[\s\p{Z}]+)*\p{Lu})', '\1' || chr(1) || '\2', 'g'),
      '((?:^|[^\p{L}.])\.*(?:@ABBR@|\p{Lu})\.(?:[\s\p{Z}]*[»”"’)\]])*)\x01', '\1', 'g') AS m
  FROM blocks
), pieces AS (
  SELECT project_id, side, block_pos, kind, excluded, trim(u.p) AS text, u.i - 1 AS seg_no
  FROM marked, UNNEST(list_filter(string_split(m, chr(1)), lambda x: trim(x) <> '')) WITH ORDINALITY AS u(p, i)
), segments AS (
  SELECT *, CASE WHEN NOT excluded THEN row_number() OVER (PARTITION BY project_id, side, excluded ORDER BY block_pos, seg_no) - 1 END AS pos FROM pieces
), zipped AS (
  SELECT *, CASE WHEN side = 'source' THEN pos // (1 + project_id % 2) ELSE pos END AS bead_pos FROM segments
), beads AS (
  SELECT project_id, bead_pos, sum((side = 'source')::INT)::BIGINT AS n_source, sum((side = 'target')::INT)::BIGINT AS n_target,
    ((bead_pos * 37 + project_id * 11) % 100) / 100.0::DOUBLE AS confidence, ((bead_pos * 7 + project_id * 3) % 4)::INT AS review_level, 'length' AS method
  FROM zipped WHERE bead_pos IS NOT NULL GROUP BY project_id, bead_pos
)
""".replace("@ABBR@", "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS))
