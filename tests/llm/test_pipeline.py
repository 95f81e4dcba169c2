"""The pipeline's stages against brute force on the small table."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline

from .data import DOCS, WORD, rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    spark.createDataFrame(rows(), DOCS).select(*corpus_pipeline.COLUMNS).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append([tuple(r) for r in docs.collect()])
    return str(folder), out


def test_columns_and_steps(spark, stages):
    folder, out = stages
    for k in range(4):
        assert tuple(spark.read.parquet(f"{folder}/{k}").columns) == corpus_pipeline.COLUMNS
    start = rows()
    assert {d for d, *_ in out[0]} == {d for d, text, *_ in start if any(c.isalpha() for c in text or "")}
    texts = {d: t for d, t, *_ in out[1]}
    shared = "this very line is found in many documents of the set"
    holders = [d for d, t in texts.items() if any(x.strip().lower() == shared for x in t.split("\n"))]
    assert len(holders) == 1 and len(out[1]) == len(out[0])
    assert all(n == len(t) for _, t, _, _, n in out[1])


def test_one_of_each_class_stays(stages):
    _, out = stages
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t, *_ in out[2] if (w := WORD.findall(t))}
    for d in sets:
        for e in sets:
            assert d >= e or 5 * len(sets[d] & sets[e]) < 4 * len(sets[d] | sets[e])
    gone = {d for d, *_ in out[1]} - {d for d, *_ in out[2]}
    assert gone and all(any(e < d for e in sets) for d in gone)


def test_mix_and_pack(stages):
    _, out = stages
    copies = Counter(d for d, *_ in out[3])
    assert max(copies.values()) <= 3 and set(copies) <= {d for d, *_ in out[2]}
    ends, starts = Counter(), Counter()
    for doc, start, length, _, _, total, *_ in out[4]:
        starts[doc] += start == 0
        ends[doc] += start + length == total
    rows_of = Counter(d for d, *_ in out[3])
    assert starts == rows_of == ends


def test_run(spark, stages):
    folder, out = stages
    got = corpus_pipeline.run(spark, folder)
    assert Counter(r.doc_id for r in got.collect() if r.start == 0) == Counter(r[0] for r in out[4] if r[1] == 0)
