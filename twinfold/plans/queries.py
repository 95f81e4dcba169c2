"""Registered queries over the driver's tables, one or more for each operator, with their SQL where SQL can say it.

Queries on books use the library of ``sources.testbed``; those on running text use ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, checks, edits, export, history, levels, quality, search, stats
from ..sources import ingest, layout
from ..sources.stored import spread
from ..sources.testbed import SQL, Library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, library: bool = True):
    """Register a query; with library, its SQL may use the library's tables."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = (lambda spark, d: f(Library(spark, d))) if library else f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {SQL} {sql}" if library else sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


DOC_LINES = "SELECT doc_id, lang, u.i - 1 AS n, u.line FROM documents, UNNEST(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)"
TRIMMED = r"trim(regexp_replace(line, '[\s\p{Z}\x85]+', ' ', 'g'))"


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+', ' ', 'g'), '[\s\p{Z}\x85]+', ' ', 'g')) AS clean FROM documents", library=False)
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", T.clean(F.col("text")).alias("clean"))


@query(rf"""WITH l AS (SELECT *, {TRIMMED} AS t FROM ({DOC_LINES})), r AS (SELECT *, bool_or(t = '') OVER (PARTITION BY doc_id) AS spaced,
  sum((t = '')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS para FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS block_no, body AS text FROM (
  SELECT doc_id, CASE WHEN spaced THEN para ELSE n END AS k, trim(regexp_replace(regexp_replace(string_agg(t, ' ' ORDER BY n), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), ' +', ' ', 'g')) AS body
  FROM r WHERE t <> '' GROUP BY ALL)""", library=False)
def blocks_from_lines(spark, d):
    return ingest.text_blocks(documents(spark, d))


SENTENCES = SQL[SQL.index("marked AS (") : SQL.index("), segments AS")].replace("project_id, side, block_pos, kind, excluded", "doc_id, n").replace("FROM blocks", "FROM doc_lines")


@query(rf"""WITH doc_lines AS (SELECT doc_id, n, {TRIMMED} AS text FROM ({DOC_LINES}) WHERE {TRIMMED} <> ''), {SENTENCES}) SELECT doc_id, n, seg_no, text FROM pieces""", library=False)
def sentences(spark, d):
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    kept = lines.withColumn("text", F.btrim(F.regexp_replace("line", rf"(?U){T.SPACE}+", " "))).where("text <> ''")
    return kept.select("doc_id", F.col("n").cast("long").alias("n"), F.posexplode(T.sentences(F.col("text"))).alias("seg_no", "text")).withColumn("seg_no", F.col("seg_no").cast("long"))


@query(rf"""WITH doc_lines AS (SELECT doc_id, n, {TRIMMED} AS text FROM ({DOC_LINES}) WHERE {TRIMMED} <> ''), {SENTENCES})
SELECT lang, count(*) AS n_sentences, sum(length(pieces.text))::BIGINT AS n_chars FROM pieces JOIN documents USING (doc_id) GROUP BY lang""", library=False)
def sentences_per_lang(spark, d):
    lines = documents(spark, d).select("lang", F.explode(F.split("text", "\n", -1)).alias("line"))
    kept = lines.withColumn("text", F.btrim(F.regexp_replace("line", rf"(?U){T.SPACE}+", " "))).where("text <> ''")
    return kept.select("lang", F.explode(T.sentences(F.col("text"))).alias("s")).groupBy("lang").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("s")).cast("long").alias("n_chars"))


@query(SQL[SQL.index("lines AS") : SQL.index("FROM blocks\n), pieces")].replace("text,\n      '([.?!…]+", "replace(text, '. ', '. Dr. '),\n      '([.?!…]+") + SQL[SQL.index("FROM blocks\n), pieces") :] + " SELECT project_id, side, block_pos, seg_no, text FROM pieces")
def sentence_abbreviations(lib):
    made = lib.blocks.withColumn("text", F.replace("text", F.lit(". "), F.lit(". Dr. ")))
    return made.select("project_id", "side", "block_pos", F.posexplode(T.sentences(F.col("text"))).alias("seg_no", "text")).withColumn("seg_no", F.col("seg_no").cast("long"))


ORACLES["sentence_abbreviations"] = ORACLES["sentence_abbreviations"].replace(f"WITH {SQL} ", "WITH ", 1)


@query(r"""SELECT project_id, side, pos, list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+')[2:], lambda w: regexp_matches(w, '^\p{Lu}')), regexp_extract_all(text, '\p{Nd}+')))) AS anchors
FROM zipped WHERE pos IS NOT NULL""")
def anchor_tokens(lib):
    return lib.segments.where("pos is not null").select("project_id", "side", "pos", T.anchor_tokens(F.col("text")).alias("anchors"))


# Search ---------------------------------------------------------------------------------------------------------

FOLDED = "strip_accents(lower(replace(replace(replace(replace({0}, 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE')))"
BEAD_TEXT = """, bead_text AS (
  SELECT project_id, bead_pos, coalesce(string_agg(text, ' ' ORDER BY block_pos, seg_no) FILTER (side = 'source'), '') AS source,
    coalesce(string_agg(text, ' ' ORDER BY block_pos, seg_no) FILTER (side = 'target'), '') AS target
  FROM zipped WHERE bead_pos IS NOT NULL GROUP BY ALL), toks AS (
  SELECT project_id, bead_pos, side, u.token, u.i - 1 AS pos FROM (
    SELECT project_id, bead_pos, 'source' AS side, source AS t FROM bead_text UNION ALL SELECT project_id, bead_pos, 'target', target FROM bead_text),
    UNNEST(regexp_extract_all(""" + FOLDED.format("t") + r""", '[\p{L}\p{N}\p{M}]+')) WITH ORDINALITY AS u(token, i))
"""


@query(f"{BEAD_TEXT} SELECT * FROM bead_text")
def bead_text(lib):
    return search.bead_texts(lib.segments)


@query(f"{BEAD_TEXT} SELECT project_id, bead_pos, side, pos, token FROM toks")
def fold_tokens(lib):
    return search.bead_tokens(search.bead_texts(lib.segments)).withColumn("pos", F.col("pos").cast("long"))


@query(f"{BEAD_TEXT} SELECT project_id, bead_pos, side, pos, token FROM toks")
def stored_index(lib):
    return lib.index.select("project_id", F.col("bead_pos").cast("long").alias("bead_pos"), "side", F.col("pos").cast("long").alias("pos"), "token")


@query(f"{BEAD_TEXT} SELECT DISTINCT project_id, bead_pos FROM toks WHERE token LIKE 'd%'")
def search_prefix(lib):
    return search.matching(lib.index, "d")


@query(f"{BEAD_TEXT} SELECT DISTINCT project_id, bead_pos FROM toks WHERE token = 'die' AND side = 'target'")
def search_whole(lib):
    return search.matching(lib.index, "Die", side="target", whole_words=True)


@query(f"{BEAD_TEXT} SELECT DISTINCT a.project_id, a.bead_pos FROM toks a JOIN toks b ON a.project_id = b.project_id AND a.bead_pos = b.bead_pos AND a.side = b.side AND b.pos = a.pos + 1 WHERE a.token LIKE 'de%' AND b.token LIKE 'l%'")
def search_phrase(lib):
    return search.matching(lib.index, '"de l"')


@query(f"{BEAD_TEXT} SELECT DISTINCT a.project_id, a.bead_pos FROM toks a JOIN toks b ON a.project_id = b.project_id AND a.bead_pos = b.bead_pos AND a.side = b.side WHERE a.token LIKE 'und%' AND b.token LIKE 'e%'")
def search_either_side(lib):
    return search.matching(lib.index, "UND é", side="either")


@query(f"{BEAD_TEXT} SELECT project_id, count(DISTINCT bead_pos) AS n FROM toks WHERE token LIKE 'th%' GROUP BY project_id")
def search_counts(lib):
    return search.counts(search.matching(lib.index, "th"))


@query(f"""{BEAD_TEXT} SELECT project_id, bead_pos, updated_at, title FROM (
  SELECT DISTINCT project_id, bead_pos, project_id % 7 AS updated_at, 'conv ' || project_id AS title FROM toks WHERE token LIKE 'e%')
ORDER BY updated_at DESC, title, project_id, bead_pos LIMIT 50 OFFSET 20""")
def search_page(lib):
    books = lib.beads.select("project_id").distinct().select("project_id", (F.col("project_id") % 7).alias("updated_at"), F.concat(F.lit("conv "), F.col("project_id").cast("string")).alias("title"))
    return search.page(search.matching(lib.index, "e"), books, limit=50, offset=20).select("project_id", "bead_pos", "updated_at", "title")


@query(f"""{BEAD_TEXT}, parts AS (SELECT project_id, bead_pos, u.p, u.i - 1 AS k FROM bead_text, UNNEST(regexp_extract_all(source, '[\\p{{L}}\\p{{N}}\\p{{M}}]+|[^\\p{{L}}\\p{{N}}\\p{{M}}]+')) WITH ORDINALITY AS u(p, i))
SELECT project_id, bead_pos, k, p AS text, starts_with({FOLDED.format('p')}, 'en') AS match FROM parts""")
def highlight_spans(lib):
    spans = search.bead_texts(lib.segments).select("project_id", "bead_pos", F.posexplode(search.highlights(F.col("source"), ["en"])).alias("k", "s"))
    return spans.select("project_id", "bead_pos", F.col("k").cast("long").alias("k"), "s.text", "s.match")


@query("SELECT project_id, bead_pos, row_number() OVER (PARTITION BY project_id ORDER BY bead_pos) AS position FROM beads")
def bead_position(lib):
    return search.positions(lib.beads)


# Levels ---------------------------------------------------------------------------------------------------------

UNITS = r""", src AS (SELECT *, bead_pos AS b FROM zipped WHERE side = 'source' AND pos IS NOT NULL),
speech AS (SELECT project_id, block_pos, regexp_matches(trim(min_by(text, seg_no)), '^[—–«-]') AS speech FROM src WHERE trim(text) <> '' GROUP BY ALL),
ends AS (
  SELECT p.project_id, p.bead_pos, coalesce(x.block_pos <> y.block_pos, true) AS paragraph_end,
    coalesce(x.block_pos <> y.block_pos, true) OR NOT s.speech AS turn_end
  FROM (SELECT project_id, bead_pos, sum(n_source) OVER (PARTITION BY project_id ORDER BY bead_pos) AS p FROM beads) p
  LEFT JOIN src x ON x.project_id = p.project_id AND x.pos = p.p - 1 LEFT JOIN src y ON y.project_id = p.project_id AND y.pos = p.p
  LEFT JOIN speech s ON s.project_id = x.project_id AND s.block_pos = x.block_pos),
numbered AS (SELECT b.*, turn_end, paragraph_end,
    coalesce(sum(turn_end::INT) OVER w, 0)::BIGINT AS turn_no, coalesce(sum(paragraph_end::INT) OVER w, 0)::BIGINT AS paragraph_no
  FROM beads b JOIN ends USING (project_id, bead_pos) WINDOW w AS (PARTITION BY project_id ORDER BY bead_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
turns AS (SELECT project_id, turn_no AS unit_no, min(bead_pos) AS first_bead, max(bead_pos) AS last_bead, min(confidence) AS confidence, bool_and(review_level >= 2) AS reviewed,
    NOT bool_and(review_level >= 2) AND bool_or(confidence < 0.5 OR n_source = 0 OR n_target = 0) AS problem FROM numbered GROUP BY ALL)
"""


@query(f"{UNITS} SELECT project_id, bead_pos, turn_end, paragraph_end FROM ends")
def unit_ends(lib):
    return levels.unit_ends(lib.beads, lib.segments)


@query(f"{UNITS} SELECT * FROM turns")
def units_turn(lib):
    return levels.units(lib.beads, lib.segments, "turn")


@query(f"""{UNITS} SELECT project_id, paragraph_no AS unit_no, min(bead_pos) AS first_bead, max(bead_pos) AS last_bead, min(confidence) AS confidence, bool_and(review_level >= 1) AS reviewed,
  NOT bool_and(review_level >= 1) AND bool_or(confidence < 0.5 OR n_source <> 1 OR n_target <> 1) AS problem FROM numbered GROUP BY ALL""")
def units_paragraph(lib):
    return levels.units(lib.beads, lib.segments, "paragraph", multi=True)


@query(f"""{UNITS} SELECT z.project_id, n.turn_no AS unit_no, string_agg(text, ' ' ORDER BY block_pos, seg_no) FILTER (side = 'source') AS source, string_agg(text, ' ' ORDER BY block_pos, seg_no) FILTER (side = 'target') AS target
FROM zipped z JOIN numbered n USING (project_id, bead_pos) GROUP BY ALL""")
def unit_texts(lib):
    return levels.unit_texts(lib.beads, lib.segments, "turn")


@query(f"{UNITS} SELECT project_id, count(*) AS total, count(*) FILTER (reviewed) AS reviewed FROM turns GROUP BY ALL")
def turn_progress(lib):
    return levels.progress(lib.beads, lib.segments)


@query(f"{UNITS} SELECT project_id, unit_no, first_bead FROM turns WHERE problem")
def problem_units(lib):
    return levels.units(lib.beads, lib.segments, "turn").where("problem").select("project_id", "unit_no", "first_bead")


@query(f"""{UNITS} SELECT project_id, unit_no, coalesce((SELECT min(unit_no) FROM turns b WHERE b.project_id = a.project_id AND problem AND b.unit_no > a.unit_no),
  (SELECT min(unit_no) FROM turns b WHERE b.project_id = a.project_id AND problem)) AS next_problem FROM turns a""")
def next_problem(lib):
    return levels.next_unit(levels.units(lib.beads, lib.segments, "turn"), F.col("problem"), "next_problem")


@query("""SELECT b.project_id, b.side, b.block_pos, b.kind, (SELECT max(bead_pos) FROM zipped z WHERE z.project_id = b.project_id AND z.side = b.side AND z.block_pos < b.block_pos) AS after_bead
FROM (SELECT * FROM blocks WHERE excluded) b""")
def excluded_after_bead(lib):
    return levels.excluded_places(lib.segments, lib.blocks)


@query("""SELECT project_id, bead_pos, block_pos, seg_no FROM (SELECT *, lag(block_pos) OVER (PARTITION BY project_id, bead_pos ORDER BY block_pos, seg_no) AS l FROM zipped WHERE side = 'source' AND bead_pos IS NOT NULL) WHERE l <> block_pos""")
def coarse_split_points(lib):
    return levels.coarse_points(lib.segments).withColumn("seg_no", F.col("seg_no").cast("long"))


@query(f"""{UNITS}, hits AS (SELECT project_id, bead_pos AS hit, turn_no, review_level FROM numbered WHERE bead_pos % 5 = 2),
spans AS (SELECT h.project_id, h.hit, CASE WHEN h.review_level < 3 THEN t.first_bead ELSE h.hit END AS a, CASE WHEN h.review_level < 3 THEN t.last_bead ELSE h.hit END AS b FROM hits h JOIN turns t ON t.project_id = h.project_id AND t.unit_no = h.turn_no)
SELECT s.project_id, s.hit, x.bead_pos, x.bead_pos BETWEEN s.a AND s.b AS in_turn FROM spans s JOIN beads x ON x.project_id = s.project_id AND x.bead_pos BETWEEN s.a - 2 AND s.b + 2""")
def context_turn(lib):
    return search.context(lib.beads.where("bead_pos % 5 = 2"), lib.beads, lib.segments)


# Statistics, export ---------------------------------------------------------------------------------------------

@query("""SELECT b.*, coalesce(source_segments, 0) AS source_segments, coalesce(target_segments, 0) AS target_segments, coalesce(n_beads, 0) AS n_beads, coalesce(one_sided, 0) AS one_sided, coalesce(low_confidence, 0) AS low_confidence
FROM (SELECT project_id, count(*) AS n_blocks, count(*) FILTER (excluded) AS n_excluded FROM blocks GROUP BY ALL) b
LEFT JOIN (SELECT project_id, count(*) FILTER (side = 'source' AND NOT excluded) AS source_segments, count(*) FILTER (side = 'target' AND NOT excluded) AS target_segments FROM zipped GROUP BY ALL) USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n_beads, count(*) FILTER (n_source = 0 OR n_target = 0) AS one_sided, count(*) FILTER (confidence < 0.5) AS low_confidence FROM beads GROUP BY ALL) USING (project_id)""")
def import_stats(lib):
    return stats.import_stats(lib.blocks, lib.segments, lib.beads)


@query("SELECT n_source || ':' || n_target AS shape, count(*) AS n FROM beads GROUP BY ALL")
def bead_shapes(lib):
    return stats.bead_shapes(lib.beads)


@query(f"""{UNITS} SELECT * FROM (SELECT project_id, count(*) AS n_beads, count(*) FILTER (review_level = 3) AS n_reviewed FROM beads GROUP BY ALL)
JOIN (SELECT project_id, count(*) AS turns, count(*) FILTER (reviewed) AS turns_reviewed FROM turns GROUP BY ALL) USING (project_id)""")
def library_list(lib):
    return stats.library_list(lib.beads, lib.segments)


@query("""SELECT user_id AS run_id, kind, coalesce((SELECT list(event_type ORDER BY event_id) FROM events w WHERE w.user_id = r.user_id AND w.event_type IN ('error', 'signup')), []) AS warnings
FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'import' ELSE 'align' END AS kind FROM events) r""", library=False)
def runs_warnings(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    runs = events.select(F.col("user_id").alias("run_id"), F.when(F.col("user_id") % 2 == 0, "import").otherwise("align").alias("kind")).distinct()
    return stats.runs_with_warnings(runs, events.where("event_type in ('error', 'signup')").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("warning_id"), F.col("event_type").alias("message")))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 3 ELSE 0 END AS review_level FROM labels", library=False)
def migrate_levels(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", stats.migrated_level(F.col("quality") == 1).alias("review_level"))


@query("""SELECT project_id, side, chr(65279) || string_agg(text, chr(10) || chr(10) ORDER BY block_pos) || chr(10) AS edition FROM (
  SELECT project_id, side, block_pos, string_agg(text, ' ' ORDER BY seg_no) AS text FROM zipped WHERE NOT excluded GROUP BY ALL) GROUP BY ALL""")
def edition_text(lib):
    return export.edition_text(lib.segments)


def bundled(lib: Library) -> DataFrame:
    """Bundles of the library, zipped and read again; every third segment was edited."""
    segs = lib.segments.withColumn("original_text", F.when(F.col("pos") % 3 == 1, F.reverse("text")).otherwise(F.col("text"))).withColumn("page", F.expr("block_pos div 8"))
    books = lib.blocks.select("project_id").distinct()
    name = F.concat(F.lit("conv "), F.col("project_id").cast("string"))
    told = books.select("project_id", name.alias("title"), F.lit("en").alias("source_lang"), F.lit(None).cast("string").alias("target_lang"), F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-02").alias("updated_at"))
    files = lib.blocks.select("project_id", "side").distinct().withColumn("filename", F.concat(name, F.lit("."), "side")).withColumn("format", F.lit("txt"))
    warnings = F.when(F.col("project_id") % 2 == 0, F.array(F.struct(F.lit(None).cast("string").alias("side"), F.lit("even").alias("message")))).otherwise(F.array().cast("array<struct<side:string,message:string>>"))
    run = lambda kind, at: books.select("project_id", F.lit(kind).alias("kind"), F.lit(at).alias("created_at"), F.lit("1").alias("app_version"), F.lit('{"beads":1}').alias("stats"), warnings.alias("warnings"))
    made = export.bundles(segs, lib.beads, told, files, run("align", "2024-01-03").unionByName(run("import", "2024-01-02")), "1", "2024-02-01")
    return export.read_bundles(export.zipped_bundles(made))


@query("SELECT project_id, side, kind, excluded, block_pos // 8 AS page, seg_no, text, CASE WHEN pos % 3 = 1 THEN reverse(text) ELSE text END AS original_text, bead_pos AS bead FROM zipped")
def bundle_roundtrip(lib):
    segs, _ = export.restored(bundled(lib))
    return segs.select("project_id", "side", "kind", "excluded", "page", F.col("seg_no").cast("long").alias("seg_no"), "text", "original_text", "bead")


@query("SELECT project_id, bead_pos AS bead, confidence, method, review_level FROM beads")
def bundle_beads(lib):
    return export.restored(bundled(lib))[1].withColumn("bead", F.col("bead").cast("long"))


@query("""SELECT DISTINCT project_id, 'conv ' || project_id || CASE WHEN project_id % 5 = 0 THEN ' (restored 2024-03-01)' ELSE '' END AS title, 'en' AS source_lang, NULL::VARCHAR AS target_lang, '2024-01-01' AS created_at, '2024-03-01 10:00' AS updated_at FROM blocks""")
def bundle_books(lib):
    titles = lib.blocks.where("project_id % 5 = 0").select(F.concat(F.lit("conv "), F.col("project_id").cast("string")).alias("title"))
    return export.restored_books(bundled(lib), titles, "2024-03-01", "2024-03-01 10:00")


@query("""SELECT project_id, r.run, r.kind, r.created_at, CASE WHEN project_id % 2 = 0 THEN 1 ELSE 0 END AS n_warnings FROM (SELECT DISTINCT project_id FROM blocks), (VALUES (0, 'import', '2024-01-02'), (1, 'align', '2024-01-03')) AS r(run, kind, created_at)""")
def bundle_runs(lib):
    return export.restored_runs(bundled(lib)).select("project_id", "run", "kind", "created_at", F.size("warnings").alias("n_warnings"))


@query("SELECT DISTINCT project_id, side, kind, block_pos - 1 AS block_no, string_agg(text, ' ' ORDER BY seg_no) OVER (PARTITION BY project_id, side, block_pos ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS text FROM zipped WHERE NOT excluded AND side = 'target'")
def docx_roundtrip(lib):
    files = export.edition_docx(lib.segments.where("side = 'target'")).select(F.col("project_id").alias("doc_id"), "content")
    return ingest.docx_blocks(files).select(F.col("doc_id").alias("project_id"), F.lit("target").alias("side"), "kind", "block_no", "text")


# Invariants -----------------------------------------------------------------------------------------------------

BROKEN = """, s0 AS (SELECT project_id, side, excluded, project_id * 1000000 + (side = 'target')::INT * 500000 + block_pos * 1000 + seg_no AS seg_id, block_pos, seg_no, bead_pos FROM zipped),
s1 AS (SELECT project_id, side, excluded, seg_id, seg_id // 1000 AS block_id, CASE WHEN (seg_id // 1000) % 31 = 2 THEN -1 ELSE block_pos * 1024 END AS block_ord, CASE WHEN seg_id % 37 = 5 THEN -5 ELSE seg_no * 1024 END AS seg_ord,
  CASE WHEN excluded THEN CASE WHEN seg_id % 5 = 0 THEN project_id * 10000 END WHEN seg_id % 17 = 0 THEN NULL ELSE project_id * 10000 + bead_pos + CASE WHEN seg_id % 23 = 1 THEN 10000 WHEN seg_id % 19 = 3 THEN 1 ELSE 0 END END AS bead_id FROM s0),
b1 AS (SELECT project_id, project_id * 10000 + bead_pos AS bead_id, CASE WHEN (project_id * 10000 + bead_pos) % 29 = 3 THEN -3 ELSE bead_pos * 1024 END AS ord FROM beads),
bad AS (
  SELECT project_id, 'I1: segment ' || seg_id AS message FROM s1 WHERE excluded = (bead_id IS NOT NULL)
  UNION ALL SELECT s.project_id, 'I2: segment ' || seg_id FROM s1 s LEFT JOIN b1 b USING (bead_id) WHERE bead_id IS NOT NULL AND b.project_id IS DISTINCT FROM s.project_id
  UNION ALL SELECT project_id, 'I3: bead ' || bead_id FROM b1 WHERE bead_id NOT IN (SELECT bead_id FROM s1 WHERE bead_id IS NOT NULL)
  UNION ALL SELECT project_id, 'I4: segment ' || seg_id FROM (SELECT s.project_id, seg_id, b.ord, lag(b.ord) OVER (PARTITION BY s.project_id, side ORDER BY block_ord, seg_ord, seg_id) AS l FROM s1 s JOIN b1 b USING (bead_id) WHERE NOT excluded) WHERE l > ord
  UNION ALL SELECT project_id, 'I5: bead ' || bead_id FROM b1 WHERE ord < 0
  UNION ALL SELECT DISTINCT project_id, 'I5: block ' || block_id FROM s1 WHERE block_ord < 0
  UNION ALL SELECT project_id, 'I5: segment ' || seg_id FROM s1 WHERE seg_ord < 0)
"""


def broken(lib: Library) -> tuple[DataFrame, DataFrame]:
    """Segments and beads with ids, damaged here and there by arithmetic."""
    seg = F.col("project_id") * 1_000_000 + (F.col("side") == "target").cast("long") * 500_000 + F.col("block_pos") * 1000 + F.col("seg_no")
    s = lib.segments.withColumn("seg_id", seg).withColumn("block_id", F.expr("seg_id div 1000"))
    off = F.when(F.col("seg_id") % 23 == 1, 10000).when(F.col("seg_id") % 19 == 3, 1).otherwise(0)
    own = F.when(F.col("excluded"), F.when(F.col("seg_id") % 5 == 0, F.col("project_id") * 10000)).when(F.col("seg_id") % 17 == 0, None).otherwise(F.col("project_id") * 10000 + F.col("bead_pos") + off)
    s = s.select("project_id", "side", "excluded", "seg_id", "block_id", F.when(F.col("block_id") % 31 == 2, -1).otherwise(F.col("block_pos") * 1024).alias("block_ord"), F.when(F.col("seg_id") % 37 == 5, -5).otherwise(F.col("seg_no") * 1024).alias("seg_ord"), own.alias("bead_id"))
    b = lib.beads.select("project_id", (F.col("project_id") * 10000 + F.col("bead_pos")).alias("bead_id"), "bead_pos")
    return s, b.select("project_id", "bead_id", F.when(F.col("bead_id") % 29 == 3, -3).otherwise(F.col("bead_pos") * 1024).alias("ord"))


for _code in ("i1", "i2", "i3", "i4", "i5"):

    def _invariant(lib: Library, code: str = _code) -> DataFrame:
        return checks.report(*broken(lib)).where(F.col("message").startswith(code.upper()))

    _invariant.__name__ = f"invariants_{_code}"
    query(f"{BROKEN} SELECT * FROM bad WHERE starts_with(message, '{_code.upper()}')")(_invariant)


@query(f"{BROKEN} SELECT * FROM bad")
def check_report(lib):
    return checks.report(*broken(lib))
