"""Registered queries for ingest and layout on ``documents``: lines are blocks or printed lines, damage is arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality
from ..sources import ingest, layout
from .queries import DOC_LINES, TRIMMED, documents, query

# Front and back matter: the first and the last block of some documents get publishing markers, some open with a
# chapter number and some end with a notes heading.
MATTER_BLOCKS = rf"""WITH base AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS block_no, count(*) OVER (PARTITION BY doc_id) AS nb, {TRIMMED} AS body FROM ({DOC_LINES}) WHERE {TRIMMED} <> ''),
b AS (SELECT doc_id, block_no, CASE WHEN doc_id % 3 = 0 AND block_no = 1 OR doc_id % 4 = 1 AND block_no = nb - 2 THEN 'heading' ELSE 'paragraph' END AS kind,
  CASE WHEN doc_id % 3 = 0 AND block_no = 1 THEN 'XII' WHEN doc_id % 4 = 1 AND block_no = nb - 2 THEN 'Notes' WHEN block_no = 0 AND doc_id % 2 = 0 THEN body || ' ISBN 1' WHEN block_no = nb - 1 AND doc_id % 5 = 0 THEN body || ' Copyright ©' ELSE body END AS text,
  block_no // 3 AS page FROM base),
"""


def matter_blocks(spark, d) -> DataFrame:
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    rows = lines.withColumn("body", F.btrim(F.regexp_replace("line", rf"(?U){T.SPACE}+", " "))).where("body <> ''")
    doc = Window.partitionBy("doc_id")
    rows = rows.withColumn("block_no", F.row_number().over(doc.orderBy("n")).cast("long") - 1).withColumn("nb", F.count(F.lit(1)).over(doc))
    chapter, notes = (F.col("doc_id") % 3 == 0) & (F.col("block_no") == 1), (F.col("doc_id") % 4 == 1) & (F.col("block_no") == F.col("nb") - 2)
    text = F.when(chapter, "XII").when(notes, "Notes").when((F.col("block_no") == 0) & (F.col("doc_id") % 2 == 0), F.concat("body", F.lit(" ISBN 1"))).when((F.col("block_no") == F.col("nb") - 1) & (F.col("doc_id") % 5 == 0), F.concat("body", F.lit(" Copyright ©"))).otherwise(F.col("body"))
    return rows.select("doc_id", "block_no", F.when(chapter | notes, "heading").otherwise("paragraph").alias("kind"), text.alias("text"), F.expr("block_no div 3").alias("page"))


MARKS = " + ".join("contains(text, '{}')::INT".format(m.replace("'", "''")) for m in T.MARKERS)


@query(MATTER_BLOCKS + rf"""f AS (SELECT *, {MARKS} AS m, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS w FROM b),
g AS (SELECT *, m >= 1 AS marked, kind = 'paragraph' AND w >= 60 AND m < 2 AS body, kind = 'heading' AND w <= 6 AND regexp_matches(text, '(?i)^\s*(notes?|nota)\b') AS notes FROM f),
s AS (SELECT doc_id, min(block_no) FILTER (body OR kind = 'heading' AND regexp_matches(text, '^\s*([0-9]+|[IVXLC]+)\s*$')) AS st, max(block_no) FILTER (body) AS en FROM g GROUP BY doc_id),
fm AS (SELECT g.doc_id, max(block_no) AS lm FROM g JOIN s USING (doc_id) WHERE marked AND block_no < st GROUP BY g.doc_id),
bm AS (SELECT g.doc_id, min(block_no) AS f1 FROM g JOIN s USING (doc_id) WHERE (marked OR notes) AND block_no > en GROUP BY g.doc_id)
SELECT g.doc_id, g.block_no, CASE
  WHEN g.block_no >= bm.f1 AND (g.kind = 'paragraph' OR g.notes) OR g.kind = 'paragraph' AND g.block_no > s.en AND g.page = y.page AND NOT y.notes THEN 'back_matter'
  WHEN g.kind = 'paragraph' AND (g.block_no <= fm.lm OR g.block_no < s.st AND g.page = x.page) THEN 'front_matter' ELSE g.kind END AS kind
FROM g LEFT JOIN s USING (doc_id) LEFT JOIN fm USING (doc_id) LEFT JOIN bm USING (doc_id) LEFT JOIN g x ON x.doc_id = g.doc_id AND x.block_no = fm.lm LEFT JOIN g y ON y.doc_id = g.doc_id AND y.block_no = bm.f1""", library=False)
def matter_marks(spark, d):
    return ingest.with_matter(matter_blocks(spark, d)).select("doc_id", "block_no", "kind")


@query(f"SELECT kind, kind IN ({', '.join(repr(k) for k in T.EXCLUDED_KINDS)}) AS excluded, count(*) AS n FROM (" + "SELECT CASE doc_id % 6 WHEN 0 THEN 'footnote' WHEN 1 THEN 'heading' WHEN 2 THEN 'page_number' WHEN 3 THEN 'running_head' WHEN 4 THEN 'back_matter' ELSE 'paragraph' END AS kind FROM documents) GROUP BY kind", library=False)
def excluded_kinds(spark, d):
    names = F.array(*map(F.lit, ("footnote", "heading", "page_number", "running_head", "back_matter", "paragraph")))
    kinds = documents(spark, d).select(F.get(names, (F.col("doc_id") % 6).cast("int")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("excluded", F.col("kind").isin(*T.EXCLUDED_KINDS))


# Hyphens: every block's text is set in lines of three words; some lines are cut inside their last word.
PRINTED = rf"""WITH base AS (SELECT doc_id, n AS block_no, list_filter(string_split({TRIMMED}, ' '), lambda w: w <> '') AS w FROM ({DOC_LINES}) WHERE {TRIMMED} <> ''),
pl AS (SELECT doc_id, block_no, u.k AS line_no, array_to_string(w[u.k * 3 + 1 : u.k * 3 + 3], ' ') AS t, w[u.k * 3 + 4] AS nw FROM base, UNNEST(range(0, (len(w) + 2) // 3)) AS u(k)),
cutl AS (SELECT *, (doc_id + block_no + line_no) % 5 = 0 AND nw IS NOT NULL AND regexp_matches(nw, '^\p{{L}}{{4,}}') AS c FROM pl),
lines AS (SELECT doc_id, block_no, line_no, CASE WHEN lag(c) OVER o THEN t2 ELSE t END || CASE WHEN c THEN ' ' || nw[:2] || CASE WHEN doc_id % 2 = 0 THEN chr(173) ELSE '-' END ELSE '' END AS text
  FROM (SELECT *, t[3:] AS t2 FROM cutl) WINDOW o AS (PARTITION BY doc_id, block_no ORDER BY line_no)),
"""


def printed(spark, d) -> DataFrame:
    rows = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_no", "line")).withColumn("block_no", F.col("block_no").cast("long"))
    # Dealt out by document before it is cut up: windows over lines and what is counted by document need no other exchange.
    rows = rows.repartition("doc_id")
    words = F.filter(F.split(F.btrim(F.regexp_replace("line", rf"(?U){T.SPACE}+", " ")), " "), lambda w: w != "")
    rows = rows.withColumn("w", words).where("size(w) > 0")
    each = rows.select("doc_id", "block_no", "w", F.explode(F.sequence(F.lit(0), F.expr("(size(w) + 2) div 3 - 1").cast("int"))).alias("line_no"))
    each = each.select("doc_id", "block_no", F.col("line_no").cast("long").alias("line_no"), F.array_join(F.slice("w", F.col("line_no") * 3 + 1, F.lit(3)), " ").alias("t"), F.get("w", F.col("line_no") * 3 + 3).alias("nw"))
    cut = F.coalesce(((F.col("doc_id") + F.col("block_no") + F.col("line_no")) % 5 == 0) & F.col("nw").rlike(r"^\p{L}{4,}"), F.lit(False))
    each = each.withColumn("c", cut)
    was = F.coalesce(F.lag("c").over(Window.partitionBy("doc_id", "block_no").orderBy("line_no")), F.lit(False))
    hyphen = F.when(F.col("doc_id") % 2 == 0, "­").otherwise("-")
    text = F.concat(F.when(was, F.substring("t", 3, 1 << 20)).otherwise(F.col("t")), F.when(F.col("c"), F.concat(F.lit(" "), F.substring("nw", 1, 2), hyphen)).otherwise(""))
    return each.select("doc_id", "block_no", "line_no", text.alias("text"))


LEXICON = r"""e AS (SELECT *, regexp_matches(trim(text), '\p{L}[-\x{AD}]$') AS ends, coalesce(lag(regexp_matches(trim(text), '\p{L}[-\x{AD}]$')) OVER (PARTITION BY doc_id, block_no ORDER BY line_no), false) AS aft FROM lines),
ww AS (SELECT doc_id, unnest(regexp_extract_all(lower(CASE WHEN ends THEN regexp_replace(h, '\p{L}+[-\x{AD}]$', '') ELSE h END), '\p{L}+')) AS word FROM (SELECT *, CASE WHEN aft THEN regexp_replace(trim(text), '^\p{L}+', '') ELSE trim(text) END AS h FROM e)),
words AS (SELECT DISTINCT doc_id, word FROM ww)
"""


@query(PRINTED + LEXICON + "SELECT * FROM words", library=False)
def dehyphenate_lexicon(spark, d):
    return ingest.lexicon(printed(spark, d))[0]


@query(PRINTED + LEXICON + rf""", pp AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN ends THEN regexp_replace(h, '\p{{L}}+(-\p{{L}}+)*[-\x{{AD}}]$', '') ELSE h END), '\p{{L}}+(?:-\p{{L}}+)+') AS chains FROM (SELECT *, CASE WHEN aft THEN regexp_replace(trim(text), '^\p{{L}}+(-\p{{L}}+)*', '') ELSE trim(text) END AS h FROM e)),
pairs AS (SELECT DISTINCT doc_id, p[i] AS a, p[i + 1] AS b FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM (SELECT doc_id, string_split(unnest(chains), '-') AS p FROM pp))),
books AS (SELECT doc_id, bool_or(ends_with(trim(text), chr(173))) AS soft FROM lines GROUP BY doc_id),
hy AS (SELECT doc_id, block_no, line_no, trim(text) AS t, lead(trim(text)) OVER (PARTITION BY doc_id, block_no ORDER BY line_no) AS nx FROM lines),
ab AS (SELECT *, nx IS NOT NULL AND regexp_matches(t, '\p{{L}}-$') AS hard, lower(regexp_extract(t, '(\p{{L}}+)-$', 1)) AS a, lower(regexp_extract(nx, '^\p{{L}}+')) AS b FROM hy),
pc AS (SELECT doc_id, block_no, line_no, CASE WHEN nx IS NULL THEN t WHEN ends_with(t, chr(173)) THEN t[:-2] WHEN NOT hard THEN t || ' '
  WHEN b <> '' AND (doc_id, a, b) NOT IN (SELECT (doc_id, a, b) FROM pairs) AND CASE WHEN soft THEN (doc_id, a || b) IN (SELECT (doc_id, word) FROM words) ELSE b NOT IN ({', '.join(f"'{w}'" for w in sorted(T.PARTICLES))}) END THEN t[:-2] ELSE t END AS piece FROM ab JOIN books USING (doc_id))
SELECT doc_id, block_no, replace(string_agg(piece, '' ORDER BY line_no), chr(173), '') AS text FROM pc GROUP BY ALL""", library=False)
def dehyphenate_soft(spark, d):
    return ingest.dehyphenated(printed(spark, d))


# Glyphs: some letters become private-use characters.
GLYPHED = "replace(replace(text, 'qu', chr(57345)), 'th', chr(57346))"


def glyphed(spark, d) -> DataFrame:
    return documents(spark, d).withColumn("text", F.replace(F.replace("text", F.lit("qu"), F.lit("")), F.lit("th"), F.lit("")))


@query(f"""WITH g AS (SELECT doc_id, {GLYPHED} AS text FROM documents), o AS (SELECT doc_id, text, u.c, u.i FROM g, UNNEST(string_split(text, '')) WITH ORDINALITY AS u(c, i) WHERE u.c IN (chr(57345), chr(57346)))
SELECT doc_id, c AS glyph, count(*) AS n, list(text[greatest(i - 3, 1) : i + 3] ORDER BY i)[:16] AS close FROM o GROUP BY ALL""", library=False)
def glyph_scan(spark, d):
    return ingest.glyph_occurrences(glyphed(spark, d)).select("doc_id", "glyph", "n", F.transform("samples", lambda s: s["close"]).alias("close"))


VOTES = f"""WITH o AS (SELECT doc_id, u.c AS glyph, u.i FROM (SELECT doc_id, {GLYPHED} AS text FROM documents), UNNEST(string_split(text, '')) WITH ORDINALITY AS u(c, i) WHERE u.c IN (chr(57345), chr(57346))),
v AS (SELECT *, CASE WHEN i % 3 = 0 THEN 'x' WHEN glyph = chr(57345) THEN 'qu' ELSE 'th' END AS reading FROM o),
c AS (SELECT doc_id, glyph, reading, count(*) AS n, min(i) AS f FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(n) OVER w, 0) AS nx FROM c WINDOW w AS (PARTITION BY doc_id, glyph ORDER BY n DESC, f)),
won AS (SELECT doc_id, glyph, reading FROM r WHERE k = 1 AND n >= 2 AND n >= 2 * nx AND (SELECT count(*) FROM o WHERE o.doc_id = r.doc_id AND o.glyph = r.glyph) > 8)
"""


def readings(spark, d) -> DataFrame:
    found = glyphed(spark, d).select("doc_id", F.posexplode(F.split("text", "")).alias("p", "glyph")).where(F.col("glyph").isin("", "")).withColumn("at", F.col("p") + 1)
    votes = found.withColumn("reading", F.when(F.col("at") % 3 == 0, "x").when(F.col("glyph") == "", "qu").otherwise("th"))
    return ingest.voted(votes, ingest.glyph_occurrences(glyphed(spark, d)))


@query(VOTES + "SELECT * FROM won", library=False)
def glyph_vote(spark, d):
    return readings(spark, d)


@query(VOTES + """SELECT doc_id, replace(replace(t, chr(57345), coalesce((SELECT reading FROM won w WHERE w.doc_id = g.doc_id AND glyph = chr(57345)), chr(65533))), chr(57346), coalesce((SELECT reading FROM won w WHERE w.doc_id = g.doc_id AND glyph = chr(57346)), chr(65533))) AS text
FROM (SELECT doc_id, """ + GLYPHED + " AS t FROM documents) g", library=False)
def glyphs_applied(spark, d):
    return ingest.glyphs_replaced(glyphed(spark, d).select("doc_id", "text"), readings(spark, d)).select("doc_id", "text")


ANSWERS = f"""WITH o AS (SELECT doc_id, u.c AS glyph, u.i FROM (SELECT doc_id, {GLYPHED} AS text FROM documents), UNNEST(string_split(text, '')) WITH ORDINALITY AS u(c, i) WHERE u.c IN (chr(57345), chr(57346))),
v AS (SELECT *, CASE WHEN glyph = chr(57345) THEN 'qu' ELSE 'th' END AS reading FROM o WHERE i % 4 <> 0 UNION ALL SELECT *, 'x' FROM o WHERE i % 4 = 0 AND i % 8 <> 0),
c AS (SELECT doc_id, glyph, reading, count(*) AS n, min(i) AS f FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(n) OVER w, 0) AS nx FROM c WINDOW w AS (PARTITION BY doc_id, glyph ORDER BY n DESC, f))
"""


@query(ANSWERS + "SELECT doc_id, glyph, reading FROM r WHERE k = 1 AND n >= 3 AND n >= 2 * nx", library=False)
def glyph_fill(spark, d):
    """A reader's answers for each occurrence: letters, now and then other letters, and now and then no letters at all."""
    places = ingest.glyph_places(glyphed(spark, d))
    right = F.when(F.col("glyph") == "\ue001", "qu").otherwise("th")
    answer = F.when(F.col("at") % 8 == 0, "not sure 1").when(F.col("at") % 4 == 0, "x").otherwise(right)
    return ingest.filled(places.select("doc_id", "glyph", "at", F.to_json(F.struct(answer.alias("reading"))).alias("answer")))


@query(VOTES + """, n AS (SELECT doc_id, glyph, count(*) AS n FROM o GROUP BY ALL), lft AS (SELECT * FROM n ANTI JOIN won USING (doc_id, glyph))
SELECT doc_id, glyph, n, least(n, 6) AS n_samples FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, glyph) AS k FROM lft) WHERE k <= 1""", library=False)
def glyph_questions(spark, d):
    found = ingest.glyph_occurrences(glyphed(spark, d))
    return ingest.open_questions(found, readings(spark, d), most=1).select("doc_id", "glyph", "n", F.size("samples").cast("long").alias("n_samples"))


@query(VOTES + "SELECT * FROM won WHERE doc_id % 3 <> 1", library=False)
def glyph_veto(spark, d):
    found = glyphed(spark, d)
    places = ingest.glyph_places(found)
    votes = places.withColumn("reading", F.when(F.col("at") % 3 == 0, "x").when(F.col("glyph") == "\ue001", "qu").otherwise("th"))
    vetoes = places.select("doc_id", "glyph", F.when(F.col("doc_id") % 3 == 1, False).when(F.col("doc_id") % 3 == 2, True).alias("good")).distinct()
    return ingest.voted(votes, ingest.glyph_occurrences(found), vetoes=vetoes)


# Pages: each line of a document is a printed line; sizes and places are arithmetic on line numbers.
PAGED = rf"""WITH raw AS (SELECT doc_id, n, {TRIMMED} AS body FROM ({DOC_LINES}) WHERE {TRIMMED} <> ''),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS k FROM raw),
pg AS (SELECT doc_id, (k // 8)::INT AS page, k % 8 AS l, body FROM num),
lines AS (SELECT doc_id, page, l::INT AS line_no, CASE WHEN (l + doc_id) % 5 = 2 THEN 60.0 ELSE 50.0 END::DOUBLE AS x0, CASE l WHEN 0 THEN 20 WHEN 7 THEN 760 ELSE 100 + l * 14 + CASE WHEN l = 5 THEN 400 ELSE 0 END END::DOUBLE AS y0,
  CASE l WHEN 0 THEN 30 WHEN 7 THEN 770 ELSE 110 + l * 14 + CASE WHEN l = 5 THEN 400 ELSE 0 END END::DOUBLE AS y1, CASE WHEN l = 0 THEN 'Book ' || doc_id WHEN l = 7 THEN '' || (page + 1) ELSE body END AS text,
  CASE WHEN l = 1 AND page % 3 = 0 THEN 14.0 WHEN l = 5 THEN 8.0 ELSE 10.0 END::DOUBLE AS size FROM pg)
"""


def paged(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("body", F.btrim(F.regexp_replace("line", rf"(?U){T.SPACE}+", " "))).where("body <> ''")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1).withColumn("page", F.expr("k div 8").cast("int")).withColumn("l", (F.col("k") % 8).cast("int"))
    y0 = F.when(F.col("l") == 0, 20).when(F.col("l") == 7, 760).otherwise(100 + F.col("l") * 14 + F.when(F.col("l") == 5, 400).otherwise(0)).cast("double")
    text = F.when(F.col("l") == 0, F.concat(F.lit("Book "), F.col("doc_id").cast("string"))).when(F.col("l") == 7, (F.col("page") + 1).cast("string")).otherwise(F.col("body"))
    size = F.when((F.col("l") == 1) & (F.col("page") % 3 == 0), 14.0).when(F.col("l") == 5, 8.0).otherwise(10.0)
    lines = rows.select("doc_id", "page", F.col("l").alias("line_no"), F.when((F.col("l") + F.col("doc_id")) % 5 == 2, 60.0).otherwise(50.0).alias("x0"), y0.alias("y0"), F.lit(500.0).alias("x1"), (y0 + 10).alias("y1"), text.alias("text"), size.alias("size"))
    return lines, lines.select("doc_id", "page").distinct().withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))


@query(PAGED + "SELECT doc_id, arg_max(size, (c, -f)) AS body FROM (SELECT doc_id, size, sum(length(text)) AS c, min(page * 1000 + line_no) AS f FROM lines GROUP BY ALL) GROUP BY doc_id", library=False)
def layout_body_size(spark, d):
    return layout.body_size(paged(spark, d)[0])


CLASSIFIED = r""", bs AS (SELECT doc_id, arg_max(size, (c, -f)) AS body FROM (SELECT doc_id, size, sum(length(text)) AS c, min(page * 1000 + line_no) AS f FROM lines GROUP BY ALL) GROUP BY doc_id),
x AS (SELECT l.*, body, CASE WHEN (y0 + y1) / 2 <= 120 THEN 'top' WHEN (y0 + y1) / 2 >= 680 THEN 'bottom' END AS band, regexp_matches(text, '(?i)^\s*([0-9]+|[ivxlcdm]+)\s*$') AS num, size <= body + 0.5 AS small,
  round_even(size, 0) AS rs, round_even((y0 + y1) / 2 / 800.0 / 0.01, 0) AS slot, trim(regexp_replace(lower(text), '\p{Nd}', '', 'g')) AS head, (SELECT count(DISTINCT page) FROM lines p WHERE p.doc_id = l.doc_id) AS np FROM lines l JOIN bs USING (doc_id)),
fq AS (SELECT doc_id, band, rs FROM x WHERE band IS NOT NULL AND num AND small GROUP BY doc_id, band, rs HAVING count(DISTINCT page) >= 0.25 * any_value(np)),
sl AS (SELECT doc_id, slot, rs FROM x GROUP BY doc_id, slot, rs HAVING count(DISTINCT page) FILTER (band IS NULL AND num AND small) >= greatest(0.25 * any_value(np), 1) AND count(*) FILTER (band IS NULL AND num AND small) >= 0.8 * count(*)),
hd AS (SELECT doc_id, head FROM x WHERE band = 'top' AND head <> '' GROUP BY doc_id, head HAVING count(DISTINCT page) >= 3),
k AS (SELECT x.*, CASE WHEN num AND fq.doc_id IS NOT NULL THEN 'page_number' WHEN x.band IS NULL AND num AND small AND sl.doc_id IS NOT NULL THEN 'page_number' WHEN x.band = 'top' AND hd.doc_id IS NOT NULL THEN 'running_head'
  WHEN size >= body * 1.1 OR regexp_matches(text, '^\s*([0-9]+|[IVXLC]+)\s*$') THEN 'heading' WHEN size <= body * 0.9 AND (y0 + y1) / 2 >= 480 THEN 'footnote' ELSE 'paragraph' END AS kind
  FROM x LEFT JOIN fq USING (doc_id, band, rs) LEFT JOIN sl USING (doc_id, slot, rs) LEFT JOIN hd USING (doc_id, head))
"""


@query(PAGED + CLASSIFIED + "SELECT doc_id, page, line_no, kind FROM k", library=False)
def layout_classes(spark, d):
    return layout.classified(*paged(spark, d)).select("doc_id", "page", "line_no", "kind")


@query(PAGED + CLASSIFIED + """, m AS (SELECT doc_id, page, x0, count(*) AS c FROM k WHERE size = body GROUP BY ALL)
SELECT doc_id, page, coalesce((SELECT min(x0) FROM m WHERE m.doc_id = p.doc_id AND m.page = p.page AND c >= 2), (SELECT arg_max(x0, (c, -f)) FROM (SELECT x0, count(*) AS c, min(page * 1000 + line_no) AS f FROM k WHERE k.doc_id = p.doc_id AND size = body GROUP BY x0))) AS margin FROM (SELECT DISTINCT doc_id, page FROM k) p""", library=False)
def layout_margins(spark, d):
    return layout.margins(layout.classified(*paged(spark, d)))


@query(library=False)
def layout_blocks(spark, d):
    return layout.assembled(layout.classified(*paged(spark, d))).select("doc_id", "page", "line_no", "kind", "block_no")


# Ligatures: every line of a text, with a space put after fi, fl and Th inside words.
@query(r"""WITH b AS (SELECT unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT real, n FROM (SELECT false AS real, sum(len(regexp_extract_all(t, '(fi|fl|Th)\p{L}')))::BIGINT AS n FROM b UNION ALL SELECT true, sum(len(list_filter(range(1, len(w)), lambda i: regexp_matches(w[i], '(f|fi|fl|Th)$') AND regexp_matches(w[i + 1], '^\p{L}'))))::BIGINT FROM (SELECT string_split(t, ' ') AS w FROM b)) WHERE n > 0""", library=False)
def ligature_score(spark, d):
    rows = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "corrected")).withColumn("original", F.regexp_replace("corrected", r"(fi|fl|Th)(?=\p{L})", "$1 "))
    segs = rows.select(F.col("doc_id").alias("project_id"), F.lit("source").alias("side"), F.col("pos").cast("long").alias("pos"), "original", "corrected")
    return quality.ligature_gaps(segs).groupBy("real").agg(F.count(F.lit(1)).alias("n"))
