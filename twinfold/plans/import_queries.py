"""Registered queries for imports from files, statistics by side, scores by side and level, transfers, placement, recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import align, edits, history, quality, stats
from ..operators import levels as L
from ..sources import ingest
from ..sources.testbed import Library
from .correction_queries import ACTION, KEYS, LAYERS, layers, long_keys, segs, shared
from .queries import UNITS, query

# Files: each side of a book is a text file of its blocks; every seventh book has a target of front matter alone.


def files(lib: Library) -> DataFrame:
    """doc_id, project_id, side, path, content."""
    lines = F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY block_pos)")
    sides = lib.blocks.groupBy("project_id", "side").agg(lines.alias("text")).withColumn("text", F.when((F.col("project_id") % 7 == 3) & (F.col("side") == "target"), F.lit("ISBN 1")).otherwise(F.col("text")))
    path = F.concat(F.lit("/in/"), F.col("project_id").cast("string"), F.lit("."), "side", F.when(F.col("project_id") % 2 == 0, ".TXT").otherwise(".txt"))
    return sides.select((F.col("project_id") * 2 + (F.col("side") == "target").cast("long")).alias("doc_id"), "project_id", "side", path.alias("path"), F.col("text").cast("binary").alias("content"))


@query("SELECT project_id * 2 + (side = 'target')::INT AS doc_id, block_pos - 1 AS block_no, 'paragraph' AS kind, text, false AS excluded FROM blocks")
def extract_files(lib):
    found = files(lib).where("not (project_id % 7 = 3 and side = 'target')")
    whole = files(lib).where("project_id % 7 = 3 and side = 'target'").select("doc_id", "project_id", "side", "path").join(lib.blocks.where("side = 'target'").groupBy("project_id").agg(F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY block_pos)").cast("binary").alias("content")), "project_id")
    return ingest.extracted(found.unionByName(whole)).select("doc_id", "block_no", "kind", "text", "excluded")


@query("SELECT DISTINCT project_id * 2 + 1 AS doc_id, '/in/' || project_id || '.target' || CASE WHEN project_id % 2 = 0 THEN '.TXT' ELSE '.txt' END AS path FROM blocks WHERE project_id % 7 = 3 AND side = 'target'")
def no_text_found(lib):
    found = files(lib).withColumn("content", F.when((F.col("project_id") % 7 == 3) & (F.col("side") == "target"), F.lit(" \n\t").cast("binary")).otherwise(F.col("content")))
    return ingest.without_text(found, ingest.extracted(found))


@query("""SELECT project_id, side, seg_no, block_pos, text, pos FROM (SELECT project_id, side, seg_no, block_pos - 1 AS block_pos, text, row_number() OVER (PARTITION BY project_id, side ORDER BY block_pos, seg_no) - 1 AS pos FROM zipped) WHERE project_id % 7 <> 3""")
def import_segments(lib):
    """From files to an aligned book: segments of all books that are not refused; system turns are body text in a file."""
    return imported(lib)[0].select("project_id", "side", F.col("seg_no").cast("long").alias("seg_no"), "block_pos", "text", "pos")


@query("""SELECT project_id, count(*) AS n_segments, true AS tiled, true AS ordered, true AS methods FROM zipped WHERE project_id % 7 <> 3 GROUP BY ALL""")
def import_beads(lib):
    """Every segment of an imported book is in one bead, beads without a gap, in order on both sides."""
    made, beads = imported(lib)
    order = Window.partitionBy("project_id", "side").orderBy("pos")
    steps = made.withColumn("_ok", F.coalesce(F.col("bead_pos") >= F.lag("bead_pos").over(order), F.col("bead_pos").isNotNull()))
    of_segs = steps.groupBy("project_id").agg(F.count("bead_pos").alias("n_segments"), F.bool_and("_ok").alias("ordered"))
    of_beads = beads.groupBy("project_id").agg((F.max("bead_pos") + 1 == F.count(F.lit(1))).alias("tiled"), F.bool_and((F.col("method") == "length") & F.col("confidence").between(0, 1) & (F.col("review_level") == 0)).alias("methods"))
    return of_segs.join(of_beads, "project_id").select("project_id", "n_segments", "tiled", "ordered", "methods")


def imported(lib: Library) -> tuple[DataFrame, DataFrame]:
    found = files(lib)
    blocks = ingest.extracted(found).join(found.select("doc_id", "project_id", "side", "path"), "doc_id")
    refused = found.where("project_id % 7 = 3").select("project_id").distinct()
    return align.built(blocks.join(refused, "project_id", "left_anti"))


# Statistics -----------------------------------------------------------------------------------------------------


def paged_blocks(lib: Library) -> DataFrame:
    return lib.blocks.withColumn("page", F.expr("block_pos div 8"))


@query("""SELECT * FROM (SELECT project_id, side, max(block_pos // 8) AS pages, count(*) FILTER (excluded) AS excluded_blocks FROM blocks GROUP BY ALL) JOIN (SELECT project_id, side, count(*) FILTER (NOT excluded) AS segments FROM zipped GROUP BY ALL) USING (project_id, side)""")
def import_stats_sides(lib):
    return stats.side_stats(paged_blocks(lib), lib.segments).drop("blocks")


@query("SELECT project_id, side, kind, count(*) AS n FROM blocks GROUP BY ALL")
def import_stats_kinds(lib):
    return stats.side_stats(paged_blocks(lib), lib.segments).select("project_id", "side", F.explode("blocks").alias("kind", "n"))


@query("SELECT project_id, n_source || ':' || n_target AS shape, count(*) AS n FROM beads GROUP BY ALL")
def import_stats_shapes(lib):
    return stats.book_shapes(lib.beads).select("project_id", F.explode("shapes").alias("shape", "n"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN '3' ELSE '0' END AS before_level, CASE WHEN toxic = 1 THEN '3' ELSE '0' END AS after_level, 'beads' AS other FROM labels", library=False)
def migrate_snapshots(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held = lambda flag: F.create_map(F.lit("ord"), F.lit("1"), F.lit("reviewed"), flag)
    log = F.array(F.struct(F.lit("beads").alias("table"), F.col("doc_id").alias("id"), held(F.col("quality").cast("string")).alias("before"), held(F.when(F.col("toxic") == 1, "true").otherwise("false")).alias("after")), F.struct(F.lit("blocks").alias("table"), F.col("doc_id").alias("id"), F.create_map(F.lit("kind"), F.lit("beads")).alias("before"), F.lit(None).cast("map<string,string>").alias("after")))
    made = stats.migrated_changes(log)
    return labels.select("doc_id", made[0]["before"]["review_level"].alias("before_level"), made[0]["after"]["review_level"].alias("after_level"), made[1]["before"]["kind"].alias("other"))


# Scores ---------------------------------------------------------------------------------------------------------


@query(LAYERS + """, x AS (SELECT project_id, side, coalesce(sum(n) FILTER (gold IS NULL AND predicted IS NULL), 0) AS b, coalesce(sum(n) FILTER (gold IS NULL), 0) AS g, coalesce(sum(n) FILTER (predicted IS NULL), 0) AS p FROM shared GROUP BY ALL),
y AS (SELECT project_id, side, CASE WHEN p > 0 THEN b / p WHEN g = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN g > 0 THEN b / g WHEN p = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall FROM x)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM y""")
def score_exclusion_sides(lib):
    return quality.exclusion_score(shared(lib), by_side=True)


LEVELS = LAYERS + """, ch AS (SELECT sp.project_id, c.block_pos AS block, row_number() OVER (PARTITION BY sp.project_id ORDER BY sp.start + u.k) AS r
  FROM sp JOIN counted c USING (project_id, side, ap), UNNEST(range(0, sp.length)) AS u(k) WHERE sp.side = 'source' AND gold IS NOT NULL AND predicted IS NOT NULL),
opens AS (SELECT project_id, block_pos AS block, regexp_matches(trim(arg_min(text, ap)), '^[—–«-]') AS speech FROM counted WHERE side = 'source' GROUP BY ALL),
ends_of AS (SELECT 'gold' AS layer, * FROM g_set UNION ALL SELECT 'predicted', * FROM p_set),
placed_at AS (SELECT ends_of.*, a.block AS a, b.block AS b, coalesce(o.speech, false) AS speech FROM ends_of LEFT JOIN ch a ON a.project_id = ends_of.project_id AND a.r = ends_of.s LEFT JOIN ch b ON b.project_id = ends_of.project_id AND b.r = ends_of.s + 1
  LEFT JOIN opens o ON o.project_id = ends_of.project_id AND o.block = a.block),
kept AS (SELECT layer, project_id, s, t, 'paragraph' AS level FROM placed_at WHERE a <> b UNION ALL SELECT layer, project_id, s, t, 'turn' FROM placed_at WHERE a IS NULL OR b IS NULL OR a <> b OR NOT speech)
"""


@query(LEVELS + "SELECT * FROM kept")
def boundary_levels(lib):
    gold, predicted = layers(lib)
    blocks = lib.segments.withColumn("pos", F.row_number().over(Window.partitionBy("project_id", "side").orderBy("block_pos", "seg_no")).cast("long") - 1).select("project_id", "side", "pos", F.col("block_pos").alias("block"))
    layer = predicted.join(blocks, ["project_id", "side", "pos"])
    common = quality.overlaps(quality.spans(gold), quality.spans(layer))
    sets = (quality.inner_boundaries(quality.boundaries(common, x)).withColumn("layer", F.lit(x)) for x in ("gold", "predicted"))
    found = quality.levels_of(next(sets).unionByName(next(sets)), common, quality.block_openers(layer))
    names = F.filter(F.array(F.when(F.col("turn"), "turn"), F.when(F.col("paragraph"), "paragraph")), lambda x: x.isNotNull())
    return found.select("layer", "project_id", "s", "t", F.explode(names).alias("level"))


# Transfers ------------------------------------------------------------------------------------------------------

# Of the reference's segments some are corrected: in spacing, in letters, to nothing; the fresh book is the same text, and
# some of its segments were edited or have the correction already.
CORRECTED = """, rows AS (SELECT project_id, side, row_number() OVER (PARTITION BY project_id, side ORDER BY block_pos, seg_no) - 1 AS pos, text FROM zipped),
gl AS (SELECT *, CASE pos % 6 WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', 'e ') WHEN 2 THEN text || 'x' WHEN 3 THEN ' ' WHEN 4 THEN text || 'y' ELSE text || 'z' END AS corrected,
  CASE WHEN pos % 6 = 2 AND pos % 4 = 2 THEN text || '!' ELSE text END AS fresh_text FROM rows)
"""


def corrections(lib: Library) -> tuple[DataFrame, DataFrame]:
    """(reference, fresh book)."""
    rows = lib.segments.withColumn("pos", F.row_number().over(Window.partitionBy("project_id", "side").orderBy("block_pos", "seg_no")).cast("long") - 1)
    k = F.col("pos") % 6
    corrected = F.when(k == 0, F.col("text")).when(k == 1, F.replace("text", F.lit("e"), F.lit("e "))).when(k == 2, F.concat("text", F.lit("x"))).when(k == 3, F.lit(" ")).when(k == 4, F.concat("text", F.lit("y"))).otherwise(F.concat("text", F.lit("z")))
    gold = rows.select("project_id", "side", "pos", F.col("text").alias("original"), corrected.alias("corrected"))
    edited = F.when((k == 2) & (F.col("pos") % 4 == 2), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return gold, rows.select("project_id", "side", "pos", edited.alias("text"), F.col("text").alias("original"))


@query(CORRECTED + r"""SELECT project_id, side, pos, corrected, CASE WHEN pos % 6 = 1 THEN 'spacing' WHEN pos % 6 = 3 THEN CASE WHEN regexp_matches(text, '[^\s\p{Z}\x{AD}-]') THEN 'unplaced' ELSE 'spacing' END WHEN fresh_text = text AND regexp_matches(text, '[^\s\p{Z}\x{AD}-]') THEN 'applied' ELSE 'unplaced' END AS outcome FROM gl WHERE corrected <> text""")
def transfer_edits(lib):
    return quality.edits_by_span(*corrections(lib)).select("project_id", "side", "pos", "corrected", "outcome")


@query(CORRECTED + r"""SELECT project_id, side, pos, CASE WHEN project_id % 3 <> 0 AND pos % 6 IN (2, 4, 5) AND fresh_text = text AND regexp_matches(text, '[^\s\p{Z}\x{AD}-]') THEN corrected ELSE text END AS text FROM gl""")
def transfer_applied(lib):
    """Every third book has review marks and is refused."""
    gold, fresh = corrections(lib)
    rows = fresh.withColumn("text", F.col("original"))
    no_turns = L.units(lib.beads, lib.segments, "turn").limit(0)
    worked = lib.beads.select("project_id").distinct().select("project_id", (F.col("project_id") % 3 == 0).alias("marked"), F.lit(False).alias("edited"))
    return quality.transferred(rows, lib.beads, no_turns, quality.edits_by_span(gold, fresh), worked)[0].select("project_id", "side", "pos", "text")


@query(LAYERS + UNITS + """, ok AS (SELECT project_id, first_bead, last_bead FROM turns WHERE unit_no % 2 = 0 AND project_id % 3 <> 0)
SELECT b.project_id, b.bead_pos, CASE WHEN EXISTS (FROM ok WHERE ok.project_id = b.project_id AND b.bead_pos BETWEEN first_bead AND last_bead) THEN greatest(review_level, 2) ELSE review_level END AS review_level FROM beads b""")
def transfer_marks(lib):
    rows = lib.segments.select("project_id", "side", "pos", "text")
    turns = L.units(lib.beads, lib.segments, "turn").where("unit_no % 2 = 0")
    worked = lib.beads.select("project_id").distinct().select("project_id", (F.col("project_id") % 3 == 0).alias("marked"), F.lit(False).alias("edited"))
    none = quality.edits_by_span(*corrections(lib)).limit(0)
    return quality.transferred(rows, lib.beads, turns, none, worked)[1].select("project_id", "bead_pos", "review_level")


# Replaced runs and places ---------------------------------------------------------------------------------------


@query("""SELECT z.project_id, z.side, z.block_pos, z.seg_no, CASE WHEN z.bead_pos BETWEEN 1 AND 2 AND project_id % 2 = 0 THEN hi.e * (CASE WHEN side = 'source' OR h.sides = 1 THEN 1 ELSE 2 END) / (1 + h.sides)::DOUBLE ELSE z.bead_pos END AS bead_pos
FROM zipped z LEFT JOIN (SELECT project_id, coalesce(min(bead_pos) FILTER (bead_pos > 2), 3)::DOUBLE AS e FROM beads GROUP BY ALL) hi USING (project_id)
LEFT JOIN (SELECT project_id, count(DISTINCT side) AS sides FROM zipped WHERE bead_pos BETWEEN 1 AND 2 GROUP BY ALL) h USING (project_id)""")
def replace_run(lib):
    """Beads 1 and 2 become one of the source's segments and one of the target's; in odd books the new beads are refused."""
    inside = lib.segments.where("bead_pos between 1 and 2")
    new = inside.select(*KEYS, (F.col("side") == "target").cast("int").alias("n"), F.lit(0.5).alias("confidence"), F.when(F.col("project_id") % 2 == 0, "manual").otherwise("guess").alias("method"))
    runs = inside.select("project_id").distinct().select("project_id", F.lit(1).alias("first"), F.lit(2).alias("last"))
    return long_keys(edits.run_replaced(segs(lib), lib.beads.select("project_id", "bead_pos", "confidence", "method", "review_level"), runs, new)[0].select(*KEYS, F.col("bead_pos").cast("double").alias("bead_pos")))


PLACES = """, sib AS (SELECT project_id AS parent, bead_pos * 4 AS ord FROM beads), cmd AS (SELECT project_id AS parent, CASE WHEN project_id % 3 = 0 THEN NULL ELSE 4 * (project_id % 3) END AS after, 2 + project_id % 4 AS n FROM (SELECT DISTINCT project_id FROM beads)),
x AS (SELECT c.*, (SELECT max(ord) FROM sib s WHERE s.parent = c.parent AND s.ord <= c.after) AS a, (SELECT min(ord) FROM sib s WHERE s.parent = c.parent AND (c.after IS NULL OR s.ord > c.after)) AS b, (SELECT count(*) FROM sib s WHERE s.parent = c.parent AND s.ord <= c.after) AS i FROM cmd c),
y AS (SELECT *, b IS NOT NULL AND b - coalesce(a, -1) < n + 1 AS tight FROM x)
"""


def place_commands(lib: Library) -> tuple[DataFrame, DataFrame]:
    siblings = lib.beads.select(F.col("project_id").alias("parent"), (F.col("bead_pos") * 4).alias("ord"))
    after = F.when(F.col("parent") % 3 != 0, 4 * (F.col("parent") % 3))
    return siblings, siblings.select("parent").distinct().select("parent", after.alias("after"), (2 + F.col("parent") % 4).alias("n"))


@query(PLACES + """SELECT parent, u.k, CASE WHEN tight THEN (i + u.k + 1) * 1024 WHEN b IS NOT NULL THEN coalesce(a, -1) + (u.k + 1) * (b - coalesce(a, -1)) // (n + 1) WHEN a IS NOT NULL THEN a + (u.k + 1) * 1024 ELSE u.k * 1024 END AS ord FROM y, UNNEST(range(0, n)) AS u(k)""")
def places_for_new(lib):
    return edits.places_after(*place_commands(lib))[1]


@query(PLACES + """SELECT s.parent, s.ord, CASE WHEN tight THEN (row_number() OVER (PARTITION BY s.parent ORDER BY s.ord) + CASE WHEN s.ord <= y.after THEN 0 ELSE n END) * 1024 ELSE s.ord END AS to FROM sib s JOIN y USING (parent)""")
def places_of_siblings(lib):
    return edits.places_after(*place_commands(lib))[0]


# History --------------------------------------------------------------------------------------------------------

RECORDS = f"""WITH RECURSIVE log AS (SELECT user_id, event_id, {ACTION} AS action, event_id % 3 AS kind, event_id % 11 <> 0 AS changes, event_id % 2 = 0 AS joins, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, 0::BIGINT AS k, []::STRUCT(op BIGINT, kind BIGINT, seqs BIGINT[])[] AS done, []::STRUCT(op BIGINT, kind BIGINT, seqs BIGINT[])[] AS undone FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT f.user_id, log.k,
    CASE WHEN action = 'edit' AND NOT changes THEN done WHEN action = 'edit' AND joins AND len(done) > 0 AND done[-1].kind = log.kind THEN list_append(done[:-2], {{'op': done[-1].op, 'kind': done[-1].kind, 'seqs': list_append(done[-1].seqs, event_id)}})
      WHEN action = 'edit' THEN list_append(done, {{'op': event_id, 'kind': log.kind, 'seqs': [event_id]}}) WHEN action = 'undo' AND len(done) > 0 THEN done[:-2] WHEN action = 'redo' AND len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END,
    CASE WHEN action = 'edit' AND changes THEN [] WHEN action = 'undo' AND len(done) > 0 THEN list_append(undone, done[-1]) WHEN action = 'redo' AND len(undone) > 0 THEN undone[:-2] ELSE undone END
  FROM f JOIN log ON log.user_id = f.user_id AND log.k = f.k + 1),
folded AS (SELECT user_id AS project_id, done, undone FROM f WHERE (user_id, k) IN (SELECT (user_id, max(k)) FROM log GROUP BY user_id))
SELECT project_id, o.op, o.kind::VARCHAR AS kind, o.seqs, undone FROM (SELECT project_id, unnest(done) AS o, false AS undone FROM folded UNION ALL SELECT project_id, unnest(undone), true FROM folded)"""


@query(RECORDS, library=False)
def history_recorded(spark, d):
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    log = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 3).cast("string").alias("kind"), (F.col("event_id") % 11).alias("n_changes"), (F.col("event_id") % 2 == 0).alias("coalesce"))
    return history.recorded(log)
