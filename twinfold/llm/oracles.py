"""SQL (DuckDB) for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

ORACLES = {
    "op2_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, u.i, w[u.i] AS a, w[u.i + 1] AS b, w[u.i + 2] AS c FROM d, UNNEST(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(ln.lines, 0) AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
r AS (SELECT source, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 100 * n_symbols > 10 * n_words, 100 * n_dup_lines > 30 * n_lines]) AS bad FROM f),
h AS (SELECT source, rule, count(*) AS docs, sum(bad::INT)::BIGINT AS failures FROM r GROUP BY source, rule),
t AS (SELECT rule, sum(docs) AS n, sum(failures) AS f, count(*) AS h, sum(failures * failures / docs) AS ff, sum(docs::DOUBLE * docs) AS nn FROM h GROUP BY rule),
v AS (SELECT rule, f / n AS mean, ((ff - f * f / n) - (f / n) * (1 - f / n) * (h - 1)) / nullif(n - nn / n - (h - 1), 0) AS var FROM t),
p AS (SELECT rule, mean, coalesce(CASE WHEN var > 0 AND mean * (1 - mean) > var THEN mean * (1 - mean) / var - 1 WHEN var >= mean * (1 - mean) THEN 1e-3 ELSE 1e6 END, 1e6) AS strength FROM v),
host AS (SELECT source, max((mean * strength + failures) / (strength + docs)) AS rate FROM h JOIN p USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate < 0.5 AS kept
FROM f JOIN host ON f.source IS NOT DISTINCT FROM host.source""",
    "op3_mixing": r"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || md5('20:' || coalesce(doc_id::VARCHAR, ''))[:15])::BIGINT AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
k AS (SELECT *, row_number() OVER r AS n, (sum(source_size) OVER () - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST)),
a AS (SELECT *, min(n) FILTER (cap > level * weight) OVER () AS first FROM k),
t AS (SELECT source, source_size, greatest(ceil(source_size / 32), 1)::BIGINT AS b, CASE WHEN n >= first THEN max(level) FILTER (n = first) OVER () * weight ELSE cap::DOUBLE END AS target FROM a),
house AS (SELECT h.i AS shard, (h.i * greatest(1, round_even(total / 32.0, 0))::BIGINT) // 16 AS seats FROM (SELECT sum(size) AS total FROM z), UNNEST(range(0, 17)) AS h(i)),
won AS (SELECT source, row_number() OVER (ORDER BY target / (2 * u.k + 1) DESC, source NULLS LAST, u.k) AS rn FROM t, UNNEST(range(0, 3 * b + 2)) AS u(k) WHERE target > 0),
ends AS (SELECT t.source, b, shard, least(count(rn) FILTER (rn <= seats), 3 * b) AS c FROM t CROSS JOIN house LEFT JOIN won ON won.source IS NOT DISTINCT FROM t.source GROUP BY t.source, b, shard),
q AS (SELECT source, b, shard, c AS c0, lead(c) OVER o AS c1, max(c) OVER (PARTITION BY source) // b AS p, max(c) OVER (PARTITION BY source) % b AS rest FROM ends WINDOW o AS (PARTITION BY source ORDER BY shard)),
l AS (SELECT *, least(greatest(c0 - p * b, 0), rest) AS l0, least(greatest(c1 - p * b, 0), rest) AS l1 FROM q WHERE c1 IS NOT NULL),
h AS (SELECT *, (b::HUGEINT * l0 // greatest(rest, 1))::BIGINT AS low, (b::HUGEINT * l1 // greatest(rest, 1))::BIGINT AS high FROM l),
f AS (SELECT *, low + ('0x' || md5('20:' || coalesce(source, 'null') || ':' || shard)[:15])::BIGINT % greatest(high - low, 1) AS st FROM h),
runs AS (SELECT source, greatest(c0, u.i * b) - u.i * b AS a, least(c1, (u.i + 1) * b, p * b) - u.i * b AS z FROM f, UNNEST(range(0, 3)) AS u(i)
  UNION ALL SELECT source, st, least(st + l1 - l0, high) FROM f UNION ALL SELECT source, low, low + greatest(st + l1 - l0 - high, 0) FROM f),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o % greatest(1, (c + 4095) // 4096), o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM (SELECT *, count(*) OVER () AS c FROM z)),
got AS (SELECT doc_id, st, sum(least(z * 32, st + size) - greatest(a * 32, st)) AS taken FROM placed JOIN runs ON placed.source IS NOT DISTINCT FROM runs.source AND a * 32 < st + size AND z * 32 > st AND a < z GROUP BY doc_id, st)
SELECT placed.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed JOIN t ON placed.source IS NOT DISTINCT FROM t.source LEFT JOIN got ON got.doc_id IS NOT DISTINCT FROM placed.doc_id AND got.st = placed.st AND size > 0""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, u.i, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents, UNNEST(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(line, i)),
k AS (SELECT key, max(doc_id) AS holder FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, holder IS NOT NULL AND doc_id <> holder AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
}
