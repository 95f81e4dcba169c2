"""Registered queries for keeping books and repairing reference layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export, repair, store
from ..sources.testbed import Library
from .correction_queries import KEYS, long_keys, segs
from .queries import documents, query


@query("SELECT project_id, side, block_pos, (row_number() OVER (PARTITION BY project_id, side ORDER BY block_pos) - 1) * 1024 AS ord FROM blocks")
def load_blocks(lib: Library):
    return store.loaded(lib.blocks.select("project_id", "side", "block_pos", (F.col("block_pos") * 3 + F.col("block_pos") % 2 * 2).alias("block_no"))).drop("block_no")


@query("SELECT b.project_id, b.bead_pos AS n, (SELECT max(bead_pos) FROM beads x WHERE x.project_id = b.project_id) * 1024 + row_number() OVER (PARTITION BY project_id ORDER BY bead_pos) * 1024 AS ord FROM beads b")
def append_beads(lib: Library):
    return store.appended(lib.beads.select("project_id", (F.col("bead_pos") * 1024).alias("ord")), lib.beads.select("project_id", F.col("bead_pos").alias("n")))


@query("SELECT project_id, bead_pos FROM beads WHERE project_id % 3 <> 0")
def delete_books(lib: Library):
    return store.without_books(lib.beads.select("project_id", "bead_pos"), lib.blocks.where("project_id % 3 = 0").select("project_id").distinct())


@query("SELECT library, version FROM (SELECT *, row_number() OVER (PARTITION BY library ORDER BY version DESC) AS k FROM (SELECT doc_id % 20 AS library, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id, '%Y%m%d-%H%M%S') AS version FROM documents)) WHERE k <= 10", library=False)
def kept_versions(spark, d):
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60), "yyyyMMdd-HHmmss")
    return store.kept_versions(documents(spark, d).select((F.col("doc_id") % 20).alias("library"), at.alias("version")))


@query("SELECT project_id, bool_or(review_level > 0) AS marked, project_id % 2 = 0 AND EXISTS (FROM zipped z WHERE z.project_id = b.project_id AND pos = 1) AS edited FROM beads b GROUP BY project_id")
def work_done(lib: Library):
    edited = segs(lib).join(lib.segments.select(*KEYS, "pos"), KEYS).withColumn("text", F.when((F.col("project_id") % 2 == 0) & (F.col("pos") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return store.has_work(edited, lib.beads).join(lib.beads.select("project_id").distinct(), "project_id", "left_semi")


@query("""SELECT b.project_id, b.bead_pos, CASE review_level WHEN 0 THEN 'none' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'turn' ELSE 'sentence' END AS level,
  coalesce((SELECT list(text ORDER BY block_pos, seg_no) FROM zipped z WHERE z.project_id = b.project_id AND z.bead_pos = b.bead_pos AND side = 'source'), []) AS source, coalesce((SELECT list(text ORDER BY block_pos, seg_no) FROM zipped z WHERE z.project_id = b.project_id AND z.bead_pos = b.bead_pos AND side = 'target'), []) AS target FROM beads b""")
def book_documents(lib: Library):
    return store.book_documents(lib.segments, lib.beads).select("project_id", F.explode("beads").alias("b")).select("project_id", "b.bead_pos", "b.level", "b.source", "b.target")


@query(r"""SELECT doc_id, regexp_replace(split_part(text, chr(10), 1) || ': a/b?', '[\\/:*?"<>|]', '_', 'g') AS name FROM documents""", library=False)
def file_names(spark, d):
    return documents(spark, d).select("doc_id", export.file_name(F.concat(F.split("text", "\n").getItem(0), F.lit(": a/b?"))).alias("name"))


@query("""SELECT z.project_id AS layer_id, z.side, row_number() OVER (PARTITION BY z.project_id, z.side ORDER BY block_pos, seg_no) - 1 AS pos, text, bead_pos AS bead FROM zipped z
WHERE EXISTS (FROM beads b WHERE b.project_id = z.project_id)""")
def gold_layer_roundtrip(lib: Library):
    from ..sources import ingest

    texts = store.gold_json(lib.segments, lib.beads.withColumn("review_level", F.lit(3)))
    return ingest.gold_layer(texts.where("json is not null"))


@query(r""", made AS (SELECT project_id, side, block_pos, seg_no, text, string_split(text, ' ') AS w FROM (SELECT project_id, side, block_pos, seg_no, replace(text, 'pf', 'pf ') AS text FROM zipped))
SELECT project_id, side, block_pos, seg_no, list_sum(list_transform(w[1 : u.i], lambda x: len(x)))::BIGINT + u.i - 1 AS offset FROM made, UNNEST(range(1, len(w))) AS u(i)
WHERE regexp_matches(w[u.i], '([fF]|[fF][iIlL]|Th)$') AND regexp_matches(w[u.i + 1], '^\p{L}')""")
def gap_candidates(lib: Library):
    made = segs(lib).withColumn("text", F.replace("text", F.lit("pf"), F.lit("pf ")))
    return long_keys(repair.gap_candidates(made))


@query(r"SELECT project_id, side, block_pos, seg_no, regexp_replace(replace(text, 'pf', 'pf '), '([fF]|[fF][iIlL]|Th) (\p{L})', '\1\2', 'g') AS text FROM zipped")
def gaps_closed(lib: Library):
    made = segs(lib).withColumn("text", F.replace("text", F.lit("pf"), F.lit("pf ")))
    return long_keys(repair.gaps_closed(made, repair.gap_candidates(made).withColumn("decision", F.lit("join"))).select(*KEYS, "text"))
