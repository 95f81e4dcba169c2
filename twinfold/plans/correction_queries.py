"""Registered queries for corrections, history, alignment and scores. Each book gets one command, by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, edits, history, quality
from ..operators import levels as L
from ..operators import search
from ..sources.stored import stored
from ..sources.testbed import Library
from .queries import UNITS, query

KEYS = ["project_id", "side", "block_pos", "seg_no"]


def segs(lib: Library) -> DataFrame:
    return lib.segments.select(*KEYS, "text", F.col("text").alias("original_text"), "kind", "excluded", F.col("bead_pos"))


def long_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("seg_no", F.col("seg_no").cast("long"))


def one_bead(lib: Library) -> DataFrame:
    """One command a book: project_id, bead_pos, side."""
    side = F.when(F.col("project_id") % 2 == 0, "source").otherwise("target")
    return lib.beads.where("bead_pos = 1 + project_id % 3").select("project_id", "bead_pos", side.alias("side"))


MOVED = """, cmd AS (SELECT project_id, bead_pos, CASE WHEN project_id % 2 = 0 THEN 'source' ELSE 'target' END AS side FROM beads WHERE bead_pos = 1 + project_id % 3),
mv AS (SELECT z.*, CASE WHEN c.bead_pos IS NOT NULL AND row_number() OVER (PARTITION BY z.project_id, z.bead_pos, z.side ORDER BY z.block_pos {0}, z.seg_no {0}) = 1
  AND EXISTS (FROM beads b WHERE b.project_id = z.project_id AND b.bead_pos = z.bead_pos {1}) THEN z.bead_pos {1} ELSE z.bead_pos END AS now
  FROM zipped z LEFT JOIN cmd c USING (project_id, bead_pos, side))
"""


@query(MOVED.format("", "- 1") + "SELECT project_id, side, block_pos, seg_no, now AS bead_pos FROM mv")
def move_first(lib):
    return long_keys(edits.moved(segs(lib), lib.beads, one_bead(lib), forward=False).select(*KEYS, "bead_pos"))


@query(MOVED.format("DESC", "+ 1") + "SELECT project_id, side, block_pos, seg_no, now AS bead_pos FROM mv")
def move_last(lib):
    return long_keys(edits.moved(segs(lib), lib.beads, one_bead(lib), forward=True).select(*KEYS, "bead_pos"))


@query(MOVED.format("", "- 1") + """, hit AS (SELECT DISTINCT project_id, unnest([bead_pos, now]) AS bead_pos FROM mv WHERE now <> bead_pos)
SELECT project_id, bead_pos, CASE WHEN h.bead_pos IS NULL THEN confidence ELSE 1.0 END AS confidence, CASE WHEN h.bead_pos IS NULL THEN method ELSE 'manual' END AS method, review_level
FROM beads b LEFT JOIN hit h USING (project_id, bead_pos) WHERE EXISTS (FROM mv WHERE mv.project_id = b.project_id AND mv.now = b.bead_pos)""")
def move_first_beads(lib):
    before = segs(lib)
    return edits.after_move(lib.beads, before, edits.moved(before, lib.beads, one_bead(lib), forward=False)).select("project_id", "bead_pos", "confidence", "method", "review_level")


MERGED = """, cmd AS (SELECT b.project_id, b.bead_pos FROM beads b JOIN beads n ON n.project_id = b.project_id AND n.bead_pos = b.bead_pos + 1 WHERE b.bead_pos = 1 + b.project_id % 3)
"""


@query(MERGED + """SELECT b.project_id, b.bead_pos, CASE WHEN c.bead_pos IS NULL THEN b.confidence ELSE 1.0 END AS confidence, CASE WHEN c.bead_pos IS NULL THEN b.method ELSE 'manual' END AS method,
  CASE WHEN c.bead_pos IS NULL THEN b.review_level ELSE least(b.review_level, n.review_level) END AS review_level
FROM beads b LEFT JOIN cmd c USING (project_id, bead_pos) LEFT JOIN beads n ON n.project_id = b.project_id AND n.bead_pos = b.bead_pos + 1
WHERE NOT EXISTS (FROM cmd x WHERE x.project_id = b.project_id AND x.bead_pos = b.bead_pos - 1)""")
def merge_next(lib):
    return edits.merged(segs(lib), lib.beads, one_bead(lib))[1].select("project_id", "bead_pos", "confidence", "method", "review_level")


@query(MERGED + "SELECT project_id, side, block_pos, seg_no, CASE WHEN c.bead_pos IS NULL THEN z.bead_pos ELSE z.bead_pos - 1 END AS bead_pos FROM (SELECT *, bead_pos - 1 AS b1 FROM zipped) z LEFT JOIN (SELECT project_id AS p, bead_pos FROM cmd) c ON c.p = z.project_id AND c.bead_pos = z.b1")
def merge_next_segments(lib):
    return long_keys(edits.merged(segs(lib), lib.beads, one_bead(lib))[0].select(*KEYS, "bead_pos"))


SPLIT = """, s1 AS (SELECT *, coalesce(bead_pos = 1 + project_id % 3 AND side = 'source' AND row_number() OVER (PARTITION BY project_id, bead_pos, side ORDER BY block_pos, seg_no) >= 2, false) AS goes FROM zipped),
one AS (SELECT project_id, side, block_pos, seg_no, bead_pos + CASE WHEN goes AND bool_or(goes) OVER b AND bool_or(NOT goes) OVER b AND bead_pos IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END AS bead_pos FROM s1 WINDOW b AS (PARTITION BY project_id, bead_pos)),
s2 AS (SELECT *, coalesce(bead_pos = 1 + project_id % 3 AND side = 'target' AND row_number() OVER (PARTITION BY project_id, bead_pos, side ORDER BY block_pos, seg_no) >= 1, false) AS goes FROM one),
ahead AS (SELECT project_id, bead_pos, lead(bead_pos, 1, bead_pos + 1) OVER (PARTITION BY project_id ORDER BY bead_pos) AS ahead FROM (SELECT DISTINCT project_id, bead_pos FROM one WHERE bead_pos IS NOT NULL)),
two AS (SELECT project_id, side, block_pos, seg_no, CASE WHEN goes AND bool_or(goes) OVER b AND bool_or(NOT goes) OVER b THEN (bead_pos + ahead) / 2 ELSE bead_pos END AS bead_pos FROM s2 LEFT JOIN ahead USING (project_id, bead_pos) WINDOW b AS (PARTITION BY project_id, bead_pos))
"""


def split_commands(lib: Library, source_at: int | None, target_at: int | None) -> DataFrame:
    return one_bead(lib).select("project_id", "bead_pos", F.lit(source_at).cast("int").alias("source_at"), F.lit(target_at).cast("int").alias("target_at"))


def split_twice(lib: Library) -> tuple[DataFrame, DataFrame]:
    """The commanded bead loses its source segments from the second on, then what is left of it its target segments."""
    return edits.bead_split(*edits.bead_split(segs(lib), lib.beads, split_commands(lib, 2, None)), split_commands(lib, None, 1))


@query(SPLIT + "SELECT * FROM one")
def split_bead(lib):
    return long_keys(edits.bead_split(segs(lib), lib.beads, split_commands(lib, 2, None))[0].select(*KEYS, "bead_pos"))


@query(SPLIT + "SELECT * FROM two")
def split_bead_twice(lib):
    return long_keys(split_twice(lib)[0].select(*KEYS, "bead_pos"))


@query(SPLIT + """SELECT project_id, bead_pos, CASE WHEN was = bead_pos AND NOT hit THEN confidence ELSE 1.0 END AS confidence, CASE WHEN was = bead_pos AND NOT hit THEN method ELSE 'manual' END AS method, review_level
FROM (SELECT DISTINCT project_id, bead_pos, floor(bead_pos)::BIGINT AS was, bool_or(bead_pos <> floor(bead_pos)) OVER (PARTITION BY project_id, floor(bead_pos)) AS hit FROM two WHERE bead_pos IS NOT NULL) t
JOIN (SELECT project_id, bead_pos AS was, confidence, method, review_level FROM beads) b USING (project_id, was)""")
def split_bead_twice_beads(lib):
    return split_twice(lib)[1].select("project_id", "bead_pos", "confidence", "method", "review_level")


@query(SPLIT + "SELECT project_id, side, block_pos, seg_no, CASE WHEN bead_pos IS NOT NULL THEN dense_rank() OVER (PARTITION BY project_id, bead_pos IS NULL ORDER BY bead_pos) - 1 END AS bead_pos FROM two")
def whole_positions(lib):
    return long_keys(edits.whole_positions(*split_twice(lib))[0].select(*KEYS, "bead_pos"))


@query(UNITS + SPLIT + """, b2 AS (SELECT DISTINCT project_id, bead_pos, dense_rank() OVER (PARTITION BY project_id ORDER BY bead_pos) AS at FROM two WHERE bead_pos IS NOT NULL),
h AS (SELECT * FROM b2 WHERE bead_pos <> floor(bead_pos))
SELECT h.project_id, h.bead_pos AS hit, x.bead_pos FROM h JOIN b2 x ON x.project_id = h.project_id AND x.at BETWEEN h.at - 1 AND h.at + 1""")
def context_after_split(lib):
    """The hits count as reviewed sentences, so that each is its own core."""
    made, beads = split_twice(lib)
    beads = beads.withColumn("review_level", F.lit(3)).withColumn("n_source", F.lit(1)).withColumn("n_target", F.lit(1))
    return search.context(beads.where("bead_pos <> floor(bead_pos)"), beads, made, around=1).select("project_id", "hit", "bead_pos")


@query("""SELECT project_id, bead_pos, CASE WHEN bead_pos % 4 = 1 THEN greatest(review_level, 2) WHEN bead_pos % 4 = 2 THEN least(review_level, 1) ELSE review_level END AS review_level FROM beads""")
def set_review(lib):
    commands = lib.beads.where("bead_pos % 4 in (1, 2)").select("project_id", "bead_pos", F.lit(2).alias("rank"), (F.col("bead_pos") % 4 == 1).alias("mark"))
    return edits.reviewed(lib.beads, commands).select("project_id", "bead_pos", "review_level")


@query("SELECT project_id, side, block_pos, seg_no, CASE WHEN pos % 3 = 1 THEN reverse(text) ELSE text END AS text, text AS original_text FROM zipped")
def edit_text(lib):
    commands = lib.segments.where("pos % 3 in (1, 2)").select(*KEYS, F.when(F.col("pos") % 3 == 1, F.reverse("text")).otherwise("  ").alias("new_text"))
    return long_keys(edits.text_edited(segs(lib), commands).select(*KEYS, "text", "original_text"))


@query("SELECT project_id, side, block_pos, seg_no, CASE WHEN pos % 2 = 1 THEN text ELSE reverse(text) END AS text FROM zipped")
def restore_original(lib):
    edited = segs(lib).withColumn("text", F.reverse("text"))
    return long_keys(edits.originals_restored(edited, lib.segments.where("pos % 2 = 1").select(*KEYS)).select(*KEYS, "text"))


@query("""SELECT project_id, side, block_pos, row_number() OVER (PARTITION BY project_id, side, block_pos ORDER BY seg_no, k) - 1 AS seg_no, t AS text, t AS original_text, bead_pos FROM (
  SELECT *, unnest(CASE WHEN pos % 4 = 1 AND trim(text[:7]) <> '' AND trim(text[8:]) <> '' THEN [{'k': 0, 't': trim(text[:7])}, {'k': 1, 't': trim(text[8:])}] ELSE [{'k': 0, 't': text}] END, recursive := true) FROM (SELECT project_id, side, block_pos, seg_no, bead_pos, pos, text FROM zipped))""")
def split_segment(lib):
    commands = lib.segments.where("pos % 4 = 1").select(*KEYS, F.lit(7).alias("at"))
    return long_keys(edits.segment_split(segs(lib), commands).select(*KEYS, "text", "original_text", "bead_pos"))


@query("""SELECT project_id, side, block_pos, seg_no, CASE WHEN pos % 2 = 0 AND nt IS NOT NULL AND NOT excluded THEN text || ' ' || nt ELSE text END AS text FROM (
  SELECT *, lead(text) OVER w AS nt, lag(pos) OVER w AS lp FROM zipped WINDOW w AS (PARTITION BY project_id, side, block_pos ORDER BY seg_no)) WHERE NOT coalesce(lp % 2 = 0, false)""")
def join_next(lib):
    commands = lib.segments.where("pos % 2 = 0").select(*KEYS)
    return long_keys(edits.segments_joined(segs(lib), commands)[0].select(*KEYS, "text"))


@query("""SELECT DISTINCT project_id, bead_pos AS from_bead, nb AS to_bead FROM (SELECT *, lead(bead_pos) OVER w AS nb FROM zipped WINDOW w AS (PARTITION BY project_id, side, block_pos ORDER BY seg_no)) WHERE pos % 2 = 0 AND bead_pos <> nb""")
def join_next_merges(lib):
    return edits.segments_joined(segs(lib), lib.segments.where("pos % 2 = 0").select(*KEYS))[1].distinct()


@query("""SELECT b.project_id, b.bead_pos, CASE WHEN m THEN 1.0 ELSE confidence END AS confidence, CASE WHEN m THEN 'manual' ELSE method END AS method, CASE WHEN m THEN lowest ELSE review_level END AS review_level FROM (
  SELECT *, bead_pos = 1 AND n > 1 AS m FROM (SELECT *, count(*) FILTER (bead_pos BETWEEN 1 AND 3) OVER (PARTITION BY project_id) AS n, min(review_level) FILTER (bead_pos BETWEEN 1 AND 3) OVER (PARTITION BY project_id) AS lowest FROM beads)) b WHERE bead_pos NOT IN (2, 3)""")
def merge_range(lib):
    merges = lib.beads.where("bead_pos = 1").select("project_id", F.lit(1).cast("long").alias("from_bead"), F.lit(3).cast("long").alias("to_bead"))
    return edits.range_merged(segs(lib), lib.beads, merges)[1].select("project_id", "bead_pos", "confidence", "method", "review_level")


EXCLUDED = ", cut AS (SELECT *, block_pos = 2 + project_id % 2 AND side = 'source' OR excluded AS gone FROM zipped)"


@query(EXCLUDED + " SELECT project_id, side, block_pos, seg_no, gone AS excluded, CASE WHEN NOT gone THEN bead_pos END AS bead_pos FROM cut")
def exclude_block(lib):
    blocks = lib.blocks.where("block_pos = 2 + project_id % 2 and side = 'source'").select("project_id", "side", "block_pos")
    return long_keys(edits.blocks_excluded(segs(lib), lib.beads, blocks)[0].select(*KEYS, "excluded", "bead_pos"))


@query(EXCLUDED + " SELECT project_id, bead_pos, confidence, method, review_level FROM beads b WHERE EXISTS (FROM cut WHERE NOT gone AND cut.project_id = b.project_id AND cut.bead_pos = b.bead_pos)")
def exclude_block_beads(lib):
    blocks = lib.blocks.where("block_pos = 2 + project_id % 2 and side = 'source'").select("project_id", "side", "block_pos")
    return edits.blocks_excluded(segs(lib), lib.beads, blocks)[1].select("project_id", "bead_pos", "confidence", "method", "review_level")


@query(""", x AS (SELECT *, last_value(bead_pos IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, first_value(bead_pos IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af FROM zipped WINDOW w AS (PARTITION BY project_id, side ORDER BY block_pos, seg_no)),
y AS (SELECT *, excluded AND coalesce(bf = af, false) AS shares, coalesce(bf::DOUBLE, -1) AS start FROM x),
n AS (SELECT project_id, start, count(*) AS n FROM (SELECT DISTINCT project_id, start, side, block_pos FROM y WHERE excluded AND NOT shares) GROUP BY ALL)
SELECT project_id, side, block_pos, seg_no, false AS excluded, CASE WHEN shares THEN bf::DOUBLE WHEN excluded THEN start + dense_rank() OVER (PARTITION BY project_id, excluded, shares, start ORDER BY side, block_pos) / (n + 1)::DOUBLE ELSE bead_pos::DOUBLE END AS bead_pos
FROM y LEFT JOIN n USING (project_id, start)""")
def include_block(lib):
    blocks = lib.blocks.where("excluded").select("project_id", "side", "block_pos")
    return long_keys(edits.blocks_included(segs(lib), lib.beads, blocks)[0].select(*KEYS, "excluded", "bead_pos"))


@query("""SELECT DISTINCT z.project_id, z.side, z.block_pos FROM zipped z JOIN (SELECT project_id, side, max(block_pos) AS b FROM zipped WHERE bead_pos = 1 + project_id % 3 AND side = CASE WHEN project_id % 2 = 0 THEN 'source' ELSE 'target' END GROUP BY ALL) c
USING (project_id, side) WHERE z.block_pos <= c.b AND NOT excluded""")
def exclude_range(lib):
    return edits.range_blocks(segs(lib), one_bead(lib).withColumn("to", F.lit("start")), exclude=True)


@query("""SELECT DISTINCT z.project_id, z.side, z.block_pos FROM zipped z JOIN (SELECT DISTINCT project_id, 'source' AS side FROM zipped WHERE bead_pos = 0 AND side = 'source') c
USING (project_id, side) WHERE excluded AND z.block_pos <= (SELECT max(block_pos) FROM zipped y WHERE y.project_id = z.project_id AND y.side = 'source' AND y.bead_pos = 0)""")
def include_range(lib):
    commands = lib.beads.where("bead_pos = 0").select("project_id", "bead_pos", F.lit("source").alias("side"), F.lit("start").alias("to"))
    return edits.range_blocks(segs(lib), commands, exclude=False)


@query("""SELECT DISTINCT project_id, reason FROM (
  SELECT project_id, 'other segments: ' || side AS reason FROM zipped WHERE pos IS NOT NULL AND pos % 10 = 9 AND project_id % 4 = 1
  UNION ALL SELECT project_id, 'unknown method' FROM zipped WHERE pos IS NOT NULL AND project_id % 4 = 2
  UNION ALL SELECT project_id, 'confidence out of range' FROM zipped WHERE pos IS NOT NULL AND project_id % 4 = 3)""")
def replace_run_refusals(lib):
    old = lib.segments.where("pos is not null").select("project_id", "side", F.struct("block_pos", "seg_no").alias("seg_id"), F.col("pos").alias("at"))
    new = old.where("not (at % 10 = 9 and project_id % 4 = 1)").withColumn("method", F.when(F.col("project_id") % 4 == 2, "guess").otherwise("manual")).withColumn("confidence", F.when(F.col("project_id") % 4 == 3, 1.5).otherwise(0.5))
    return edits.refusals_of_run(old, new)


@query("SELECT project_id, bead_pos, (row_number() OVER (PARTITION BY project_id ORDER BY bead_pos) - 1) * 1024 AS ord FROM beads")
def renumber(lib):
    # Places with gaps of one and five.
    placed = lib.beads.withColumn("at", F.col("bead_pos") * 3 + F.col("bead_pos") % 2 * 2)
    return edits.renumber(placed, ["project_id"], "at").select("project_id", "bead_pos", F.col("ord").cast("long").alias("ord"))


@query("SELECT project_id, bead_pos, CASE WHEN n IS NULL THEN bead_pos * 3 + 1024 WHEN n * 3 - bead_pos * 3 > 1 THEN (n * 3 + bead_pos * 3) // 2 END AS mid FROM (SELECT *, lead(bead_pos) OVER (PARTITION BY project_id ORDER BY bead_pos) AS n FROM beads)")
def order_midpoints(lib):
    after = F.lead("bead_pos").over(Window.partitionBy("project_id").orderBy("bead_pos"))
    return lib.beads.withColumn("n", after).select("project_id", "bead_pos", edits.midpoint(F.col("bead_pos") * 3, F.col("n") * 3).alias("mid"))


# History --------------------------------------------------------------------------------------------------------

ACTION = "CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END"
FOLD = f"""WITH RECURSIVE log AS (SELECT user_id, event_id, {ACTION} AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS done, []::BIGINT[] AS undone FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT f.user_id, log.k,
    CASE WHEN action = 'edit' THEN list_append(done, event_id) WHEN action = 'undo' AND len(done) > 0 THEN done[:-2] WHEN action = 'redo' AND len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END,
    CASE WHEN action = 'edit' THEN [] WHEN action = 'undo' AND len(done) > 0 THEN list_append(undone, done[-1]) WHEN action = 'redo' AND len(undone) > 0 THEN undone[:-2] ELSE undone END
  FROM f JOIN log ON log.user_id = f.user_id AND log.k = f.k + 1),
folded AS (SELECT user_id AS project_id, done, undone FROM f WHERE (user_id, k) IN (SELECT (user_id, max(k)) FROM log GROUP BY user_id))
"""


def event_log(spark, d) -> DataFrame:
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("op"), action.alias("action"), "value", "event_type")


@query(FOLD + "SELECT * FROM folded", library=False)
def history_fold(spark, d):
    return history.folded(event_log(spark, d))


@query(FOLD + "SELECT project_id, len(done) > 0 AS can_undo, len(undone) > 0 AS can_redo FROM folded", library=False)
def history_flags(spark, d):
    return history.flags(history.folded(event_log(spark, d)))


@query(FOLD + """, act AS (SELECT e.user_id AS project_id, event_id % 8 AS row_id, event_id, value FROM events e JOIN folded f ON f.project_id = e.user_id AND list_contains(f.done, e.event_id)),
last AS (SELECT project_id, row_id, arg_max(CASE WHEN event_id % 5 = 0 THEN -1 ELSE value END, event_id) AS v FROM act GROUP BY ALL),
base AS (SELECT DISTINCT user_id AS project_id, 3::BIGINT AS row_id, 0.5 AS value FROM events)
SELECT project_id, row_id, CASE WHEN v IS NOT NULL THEN v ELSE value END AS value FROM base FULL JOIN last USING (project_id, row_id) WHERE coalesce(v, 0) <> -1""", library=False)
def history_state(spark, d):
    log = event_log(spark, d)
    changes = history.active(log, history.folded(log)).select("project_id", (F.col("op") % 8).alias("row_id"), "seq", F.when(F.col("op") % 5 != 0, F.col("value")).alias("after"))
    base = log.select("project_id").distinct().select("project_id", F.lit(3).cast("long").alias("row_id"), F.lit(0.5).alias("value"))
    return history.state(base, changes)


@query("SELECT user_id AS project_id, event_id // 10 AS op, event_id % 3 AS row_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL", library=False)
def history_undo_rows(spark, d):
    return history.reverted(event_log(spark, d).select("project_id", F.expr("op div 10").alias("op"), (F.col("op") % 3).alias("row_id"), "seq", F.col("value").alias("before")))


@query("SELECT user_id AS project_id, event_id // 10 AS op, event_id % 3 AS row_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL", library=False)
def history_redo_rows(spark, d):
    return history.reapplied(event_log(spark, d).select("project_id", F.expr("op div 10").alias("op"), (F.col("op") % 3).alias("row_id"), "seq", F.col("value").alias("after")))


# Alignment ------------------------------------------------------------------------------------------------------


@query("SELECT project_id, count(*) AS n_segments, count(*) AS n_placed, true AS in_order FROM zipped WHERE pos IS NOT NULL GROUP BY ALL")
def align_coverage(lib):
    found = align.aligned(lib.segments)
    order = Window.partitionBy("project_id", "side").orderBy("pos")
    steps = found.withColumn("_ok", F.coalesce(F.col("bead_pos") - F.lag("bead_pos").over(order) >= 0, F.lit(True))).groupBy("project_id").agg(F.count_distinct("side", "pos").alias("n_placed"), F.bool_and("_ok").alias("in_order"))
    return lib.segments.where("pos is not null").groupBy("project_id").agg(F.count(F.lit(1)).alias("n_segments")).join(steps, "project_id", "left")


@query()
def align_shapes(lib):
    count = lambda s: F.count_if(F.col("side") == s)
    beads = align.aligned(lib.segments).groupBy("project_id", "bead_pos").agg(count("source").alias("n_source"), count("target").alias("n_target"))
    return beads.groupBy("n_source", "n_target").agg(F.count(F.lit(1)).alias("n"))


HEADED = "SELECT *, CASE WHEN (block_pos + project_id) % 4 = 0 THEN 'heading' ELSE 'paragraph' END AS k FROM zipped WHERE pos IS NOT NULL"


@query(f"""SELECT project_id, side, pos, bead_pos + (n >= 2 AND pos = last AND k = 'heading' AND bead_pos < e)::INT AS bead_pos FROM (
  SELECT *, count(*) OVER b AS n, max(pos) OVER b AS last, max(bead_pos) OVER (PARTITION BY project_id) AS e FROM ({HEADED}) WINDOW b AS (PARTITION BY project_id, side, bead_pos))""")
def headings_open(lib):
    made = lib.segments.where("pos is not null").withColumn("kind", F.when((F.col("block_pos") + F.col("project_id")) % 4 == 0, "heading").otherwise("paragraph"))
    return align.headings_open(made.select("project_id", "side", "pos", "kind", "bead_pos")).select("project_id", "side", "pos", "bead_pos")


# Scores ---------------------------------------------------------------------------------------------------------

LAYERS = r""", counted AS (SELECT project_id, side, block_pos, bead_pos, excluded, text, translate(regexp_replace(text, '[\s\p{Z}]', '', 'g'), '-' || chr(173), '') AS t,
    row_number() OVER (PARTITION BY project_id, side ORDER BY block_pos, seg_no) - 1 AS ap FROM zipped),
sp AS (SELECT project_id, side, ap, bead_pos AS gold, length(t) AS length, coalesce(sum(length(t)) OVER (PARTITION BY project_id, side ORDER BY ap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    CASE WHEN NOT out THEN k // 2 END AS predicted FROM (
  SELECT *, (block_pos + project_id) % 11 = 5 AS out, row_number() OVER (PARTITION BY project_id, side, (block_pos + project_id) % 11 = 5 ORDER BY ap) - 1 AS k FROM counted)),
shared AS (SELECT project_id, side, gold, predicted, sum(length)::BIGINT AS n FROM sp WHERE length > 0 GROUP BY ALL),
com AS (FROM shared WHERE gold IS NOT NULL AND predicted IS NOT NULL),
g_ends AS (SELECT project_id, bead, sum(s) OVER w AS s, sum(t) OVER w AS t FROM (SELECT project_id, gold AS bead, coalesce(sum(n) FILTER (side = 'source'), 0) AS s, coalesce(sum(n) FILTER (side = 'target'), 0) AS t FROM com GROUP BY ALL) WINDOW w AS (PARTITION BY project_id ORDER BY bead)),
p_ends AS (SELECT project_id, bead, sum(s) OVER w AS s, sum(t) OVER w AS t FROM (SELECT project_id, predicted AS bead, coalesce(sum(n) FILTER (side = 'source'), 0) AS s, coalesce(sum(n) FILTER (side = 'target'), 0) AS t FROM com GROUP BY ALL) WINDOW w AS (PARTITION BY project_id ORDER BY bead)),
tot AS (SELECT project_id, max(s) AS ms, max(t) AS mt FROM g_ends GROUP BY ALL),
g_set AS (SELECT DISTINCT project_id, s, t FROM g_ends JOIN tot USING (project_id) WHERE NOT (s = 0 AND t = 0) AND NOT (s = ms AND t = mt)),
p_set AS (SELECT DISTINCT project_id, s, t FROM p_ends JOIN tot USING (project_id) WHERE NOT (s = 0 AND t = 0) AND NOT (s = ms AND t = mt))
"""


def layers(lib: Library) -> tuple[DataFrame, DataFrame]:
    """(reference, prediction): the zip, and pairs of segments in order with other blocks left out."""
    at = F.row_number().over(Window.partitionBy("project_id", "side").orderBy("block_pos", "seg_no")).cast("long") - 1
    rows = lib.segments.withColumn("at", at)
    gold = rows.select("project_id", "side", F.col("at").alias("pos"), "text", F.col("bead_pos").alias("bead"))
    out = (F.col("block_pos") + F.col("project_id")) % 11 == 5
    k = F.row_number().over(Window.partitionBy("project_id", "side", out).orderBy("at")).cast("long") - 1
    predicted = rows.withColumn("_k", k).withColumn("_out", out).select("project_id", "side", F.col("at").alias("pos"), "text", F.when(~F.col("_out"), F.expr("_k div 2")).alias("bead"))
    return gold, predicted


def shared(lib: Library) -> DataFrame:
    """What the two layers share: written once, as all scores read it several times."""

    def write(folder: str) -> None:
        gold, predicted = layers(lib)
        quality.overlaps(quality.spans(gold), quality.spans(predicted)).write.parquet(folder)

    return lib.spark.read.parquet(stored(lib.spark, "overlaps", lib.source, write))


@query(LAYERS + "SELECT project_id, side, ap AS pos, start, length FROM sp WHERE length > 0")
def char_spans(lib):
    return quality.spans(layers(lib)[0]).select("project_id", "side", "pos", "start", "length")


@query("SELECT DISTINCT project_id, side, true AS same FROM zipped")
def same_text(lib):
    return quality.same_text(*layers(lib))


@query(LAYERS + "SELECT project_id, side, gold, predicted, n FROM shared")
def common_characters(lib):
    return shared(lib).groupBy("project_id", "side", "gold", "predicted").agg(F.sum("n").alias("n"))


@query(LAYERS + """, x AS (SELECT project_id, coalesce(sum(n) FILTER (gold IS NULL AND predicted IS NULL), 0) AS b, coalesce(sum(n) FILTER (gold IS NULL), 0) AS g, coalesce(sum(n) FILTER (predicted IS NULL), 0) AS p FROM shared GROUP BY ALL),
y AS (SELECT project_id, CASE WHEN p > 0 THEN b / p WHEN g = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN g > 0 THEN b / g WHEN p = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall FROM x)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM y""")
def score_exclusion(lib):
    return quality.exclusion_score(shared(lib))


@query(LAYERS + """, x AS (SELECT project_id, (SELECT count(*) FROM g_set g WHERE g.project_id = b.project_id) AS n_gold, (SELECT count(*) FROM p_set p WHERE p.project_id = b.project_id) AS n_predicted,
  (SELECT count(*) FROM g_set g JOIN p_set p USING (project_id, s, t) WHERE g.project_id = b.project_id) AS hits FROM (SELECT DISTINCT project_id FROM beads) b),
y AS (SELECT *, CASE WHEN n_predicted > 0 THEN hits / n_predicted WHEN n_gold = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN n_gold > 0 THEN hits / n_gold WHEN n_predicted = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall FROM x)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM y""")
def score_alignment(lib):
    s = shared(lib)
    gold, predicted = (quality.inner_boundaries(quality.boundaries(s, x)) for x in ("gold", "predicted"))
    return quality.alignment_score(gold, predicted, lib.beads.select("project_id").distinct())


@query(LAYERS + """, pts AS (SELECT project_id, s, t FROM g_ends UNION SELECT project_id, 0, 0 FROM tot UNION SELECT project_id, ms, mt FROM tot),
iv AS (SELECT project_id, s, t, lead(s) OVER w AS s2, lead(t) OVER w AS t2 FROM pts WINDOW w AS (PARTITION BY project_id ORDER BY s, t))
SELECT p.project_id, p.s, p.t, CASE WHEN EXISTS (FROM g_set g WHERE g.project_id = p.project_id AND g.s = p.s AND g.t = p.t) THEN 'gold'
  WHEN EXISTS (FROM iv WHERE iv.project_id = p.project_id AND (iv.s, iv.t) <= (p.s, p.t) AND (p.s, p.t) < (iv.s2, iv.t2) AND p.s BETWEEN iv.s AND iv.s2 AND p.t BETWEEN iv.t AND iv.t2) THEN 'inside' ELSE 'elsewhere' END AS place FROM p_set p""")
def score_coarse(lib):
    s = shared(lib)
    ends, own = quality.boundaries(s, "gold"), quality.boundaries(s, "predicted")
    return quality.coarse_places(ends, quality.inner_boundaries(ends), quality.inner_boundaries(own))


@query(LAYERS + """, m AS (SELECT e.project_id, e.bead, e.bead - row_number() OVER (PARTITION BY e.project_id ORDER BY e.bead) AS run FROM g_ends e SEMI JOIN g_set USING (project_id, s, t) ANTI JOIN p_set USING (project_id, s, t))
SELECT project_id, min(bead) AS first_bead, max(bead) AS last_bead FROM m GROUP BY project_id, run""")
def missed_runs(lib):
    s = shared(lib)
    return quality.missed_runs(quality.boundaries(s, "gold"), quality.inner_boundaries(quality.boundaries(s, "predicted")))


@query(LAYERS + UNITS + """SELECT project_id, unit_no, first_bead, last_bead FROM turns t
WHERE EXISTS (FROM g_ends e WHERE e.project_id = t.project_id AND e.bead BETWEEN t.first_bead AND t.last_bead)
  AND NOT EXISTS (FROM g_ends e JOIN beads b ON b.project_id = e.project_id AND b.bead_pos = e.bead WHERE e.project_id = t.project_id AND e.bead BETWEEN t.first_bead AND t.last_bead AND b.review_level = 0)""")
def transfer_plan(lib):
    s = shared(lib)
    ends = quality.boundaries(s, "gold")
    turns = L.units(lib.beads, lib.segments, "turn")
    marks = lib.beads.select("project_id", F.col("bead_pos").alias("bead"), (F.col("review_level") > 0).alias("reviewed"))
    return quality.transferable(turns, ends, ends, marks)


@query("""SELECT z.project_id, z.side, z.block_pos, z.seg_no, z.bead_pos + 1 AS bead_pos FROM zipped z JOIN (SELECT project_id, min(sha1(text)[:12]) AS f FROM zipped WHERE pos IS NOT NULL GROUP BY ALL) USING (project_id) WHERE sha1(text)[:12] = f AND pos IS NOT NULL""")
def fingerprint_moves(lib):
    rows = lib.segments.where("pos is not null").withColumn("f", quality.fingerprint(F.col("text")))
    chosen = rows.groupBy("project_id").agg(F.min("f").alias("f"))
    return long_keys(rows.join(chosen, ["project_id", "f"]).select(*KEYS, (F.col("bead_pos") + 1).alias("bead_pos")))


@query("SELECT project_id, count(*) AS n_touched FROM (SELECT DISTINCT project_id, unnest([bead_pos, bead_pos + 1]) AS b FROM zipped WHERE pos % 6 = 0) GROUP BY ALL")
def index_touched(lib):
    changes = lib.segments.where("pos % 6 = 0").select("project_id", F.col("bead_pos").alias("before_bead"), (F.col("bead_pos") + 1).alias("after_bead"))
    return search.touched(changes).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_touched"))


@query("SELECT side, sum((regexp_matches(trim(text), '^[—–«-]'))::INT)::BIGINT AS n_speech, count(*) AS n FROM zipped GROUP BY side")
def speech_segments(lib):
    return lib.segments.groupBy("side").agg(F.count_if(T.is_speech(F.col("text"))).alias("n_speech"), F.count(F.lit(1)).alias("n"))
