"""Rows that earlier versions lost: documents without doc_id in the pipeline, rows of two blocks of one size in the join."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from twinfold.llm import mixing, near_join

from .data import DOCS, rows


def test_pipeline_keeps_rows_without_id(spark, tmp_path):
    start = rows()
    # With the words turned round they are near to no other document.
    extra = [(None, " ".join(text.split()[::-1]) + f" and nobody named number {i}", *rest) for i, (_, text, *rest) in enumerate(start[:6])]
    spark.createDataFrame(start + extra + extra[:1], DOCS).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if k == 3:
            expected = Counter()
            # The same rows under ids of their own rank like the null ones only by size, so the copies' words are compared.
            for r in mixing.mix(docs)[0].where("doc_id is null").collect():
                expected[r.source] += r["size"] * r.copies
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs.collect())
    # extra[0] is there twice: of equal rows one stays.
    assert [sum(r.doc_id is None for r in stage) for stage in out[:3]] == [7, 7, 6]
    alone = [r for r in out[3] if r.doc_id is None]
    got = Counter()
    for r in alone:
        got[r.source] += len(r.text.split())
    assert alone and got == +expected
    assert {(r.text, r.lang, r.source) for r in alone} <= {(r.text, r.lang, r.source) for r in out[2] if r.doc_id is None}
    assert sum(r.doc_id is None and r.start == 0 for r in out[4]) == len(alone)


def test_stages_tell_rows_apart(spark):
    """Repeated and null ids, equal rows and clashing columns in each stage."""
    a, u, q, n = (" ".join(f"{x}word{'xyz'[i % 3]}{chr(97 + i % 23)}" for i in range(60)) for x in "augn")
    made = [(1, a), (5, a), (5, u), (7, q), (7, q), (None, n), (None, n), (None, a), (8, ""), (9, None), (9, u + "\n" + n)]
    docs = spark.createDataFrame([(d, t, "en", "host", len(t or "")) for d, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'clash' AS t1", "1 AS copies", "2 AS size", "3 AS label", "4 AS _v", "5 AS p_doc", "6 AS score")
    one = corpus_pipeline.keep_one_of_each_class(spark, docs, "")
    assert one.columns == list(corpus_pipeline.COLUMNS)
    assert Counter((r.doc_id, r.text) for r in one.collect()) == Counter([(1, a), (5, u), (7, q), (None, n), (8, ""), (9, None), (9, u + "\n" + n)])
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_common_lines(spark, docs, "").collect()) == Counter(
        # a is held by 5, n by 9, the largest ids that have them; u and q are in two documents or rows only
        [(1, ""), (5, a), (5, u), (7, q), (7, q), (None, ""), (None, ""), (None, ""), (8, ""), (9, None), (9, u + "\n" + n)]
    )
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == Counter((d, t) for d, t in made if t)  # one source: its target is its size
    assert corpus_pipeline.keep_languages(spark, docs, "").count() == 9
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, "").collect()} == {1, 5, 7, 8, 9, None}


@pytest.mark.parametrize("k", range(5))
def test_empty_stages(spark, k):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[k][1](spark, empty, "").count() == 0


def test_blocks_of_one_size_are_joined_whole():
    """Row 0 is near all of the right block; row 1 is near row 3 alone and not near row 0."""
    values = np.array([[1, 1, 1, 1, 1], [1, 1, 3, 2, 1], [1, 1, 1, 1, 2], [1, 1, 1, 2, 1]], np.uint16)
    found = near_join.join_bucket(np.array([0, 1]), np.array([2, 3]), values, [(5, 4)])
    assert {found.root(x) for x in range(4)} == {0}
