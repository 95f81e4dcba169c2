"""Single operators on small made-up books."""

from __future__ import annotations

import io
import json
import math
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from twinfold.functions import text as T
from twinfold.operators import align, edits, export, history, quality, repair, search, store
from twinfold.sources import ingest, layout
from twinfold.streaming import history as streamed

SENTENCES = [
    ("Elle arriva. Personne ne parlait.", ["Elle arriva.", "Personne ne parlait."]),
    ("« Viens ! » dit-il. Puis rien.", ["« Viens ! » dit-il.", "Puis rien."]),
    ("M. Durand et le Dr. Roux sortirent. Enfin!", ["M. Durand et le Dr. Roux sortirent.", "Enfin!"]),
    ("Il signor J. Neri tacque… Poi rise.", ["Il signor J. Neri tacque…", "Poi rise."]),
    ("Vraiment ?! — Oui. (Non.) Bien", ["Vraiment ?!", "— Oui.", "(Non.)", "Bien"]),
    ("Il vit 3 chats. 4 chiens aussi.", ["Il vit 3 chats. 4 chiens aussi."]),
    ("Chapitre un. Ⓐ suit. Ⅳ. Fin", ["Chapitre un.", "Ⓐ suit.", "Ⅳ. Fin"]),
    ("La Sig.ra Bianchi, cf. Roma. Addio", ["La Sig.ra Bianchi, cf. Roma.", "Addio"]),
    ("Fin ! Début ? Suite.", ["Fin !", "Début ?", "Suite."]),
    ("   ", ["   "]),
]


def test_sentences(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "i long, t string")
    got = {r.i: list(r.s) for r in frame.select("i", T.sentences(F.col("t")).alias("s")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(SENTENCES)}


def test_text_functions(spark):
    frame = spark.createDataFrame([("ﬁn\u0007 \t du  «jour» œuf-Éte",)], "t string")
    row = frame.select(T.clean(F.col("t")).alias("c"), T.fold(F.col("t")).alias("f"), T.scored_text(F.lit("a-b ­ c")).alias("s"), T.is_speech(F.lit("  — oui")).alias("y"), T.is_speech(F.lit("non")).alias("n")).first()
    assert row.c == "fin du «jour» œuf-Éte" and row.s == "abc" and row.y and not row.n
    assert row.f.endswith("oeuf-ete")


def slow_align(source, target):
    """The same cost over the whole grid, cell by cell."""
    def tokens(s):
        w = re.findall(r"\w+", s)
        return {x for x in w[1:] if x[0].isupper()} | set(re.findall(r"\d+", s))

    ls, lt = [len(re.sub(r"\s", "", s)) for s in source], [len(re.sub(r"\s", "", s)) for s in target]
    ratio = sum(lt) / sum(ls) if source and target and sum(ls) else 1.0

    def cost(i, j, ds, dt, p):
        c = -math.log(p)
        if ds and dt:
            a, b = max(1, sum(ls[i - ds : i])), sum(lt[j - dt : j])
            c -= math.log(max(1e-12, math.erfc(abs(b - a * ratio) / math.sqrt(a * 6.8) / math.sqrt(2))))
            c -= 1.5 * min(3, len(set().union(*map(tokens, source[i - ds : i])) & set().union(*map(tokens, target[j - dt : j]))))
        return c

    best = {(0, 0): (0.0, None)}
    for i in range(len(source) + 1):
        for j in range(len(target) + 1):
            for ds, dt, p in align.MOVES:
                if (i - ds, j - dt) in best and i >= ds and j >= dt:
                    c = best[i - ds, j - dt][0] + cost(i, j, ds, dt, p)
                    if (i, j) not in best or c < best[i, j][0] - 1e-12:
                        best[i, j] = (c, (ds, dt))
    return best[len(source), len(target)][0]


@pytest.mark.parametrize("seed", range(12))
def test_aligner_tiles_and_is_optimal(seed):
    rng = random.Random(seed)
    made = lambda n: [" ".join(rng.choice(["mot", "Rome", "12", "pierre", "Anna"]) for _ in range(rng.randint(1, 12))) for _ in range(n)]
    source, target = made(rng.randint(0, 14)), made(rng.randint(0, 14))
    beads = align.align(source, target)
    assert [i for s, _, _ in beads for i in s] == list(range(len(source)))
    assert [j for _, t, _ in beads for j in t] == list(range(len(target)))
    assert all(0 <= c <= 1 and 1 <= len(s) + len(t) <= 4 for s, t, c in beads)
    s, t = align.Side.of(source), align.Side.of(target)
    path, _ = align._run(s, t, align.BAND)
    assert math.isclose(sum(c for *_, c in path), slow_align(source, target), abs_tol=1e-9)


def test_narrow_band_equals_wide():
    rng = random.Random(7)
    source = ["x" * rng.randint(10, 90) for _ in range(300)]
    target = [s[: len(s) - 3] for s in source]
    s, t = align.Side.of(source), align.Side.of(target)
    assert align._run(s, t, 40)[0] == align._run(s, t, 400)[0]


def test_search_parse():
    assert search.parse('désœuvr "L\'homme NEAR" -- *') == [["desoeuvr"], ["l", "homme", "near"]]
    assert search.parse("«» …") == []


def test_search_never_splits_sides(spark):
    segs = spark.createDataFrame([(1, 0, "source", 0, 0, "alpha beta"), (1, 0, "target", 0, 0, "gamma alpha"), (1, 1, "source", 1, 0, "beta gamma")], "project_id long, bead_pos long, side string, block_pos long, seg_no int, text string")
    index = search.bead_tokens(search.bead_texts(segs))
    found = lambda *a, **k: sorted(r.bead_pos for r in search.matching(index, *a, **k).collect())
    assert found("beta gamma") == [1] and found("alpha gamma") == [0] and found('"alpha beta"') == [0] and found('"beta alpha"') == []
    assert found("gam", whole_words=True) == [] and found("alpha", side="target") == [0] and found("«»") == []
    with pytest.raises(ValueError):
        search.matching(index, "x", side="both")


def test_refreshed_index_equals_a_new_one(spark):
    made = [(p, k // 2, s, k, 0, f"mot{k} {s} page{p}") for p in (1, 2) for s in ("source", "target") for k in range(6)]
    schema = "project_id long, bead_pos long, side string, block_pos long, seg_no int, text string"
    old = spark.createDataFrame(made, schema)
    new = spark.createDataFrame([(p, b + (k == 2), s, k, n, t + (" neuf" if k == 2 else "")) for p, b, s, k, n, t in made], schema)
    index = search.bead_tokens(search.bead_texts(old))
    changes = old.where("block_pos = 2").select("project_id", F.col("bead_pos").alias("before_bead"), (F.col("bead_pos") + 1).alias("after_bead"))
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(search.refreshed(index, changes, new)) == rows(search.bead_tokens(search.bead_texts(new)).select(*index.columns))


def test_history_fold_and_stream(spark, tmp_path):
    rng = random.Random(3)
    log = [(rng.randint(1, 3), k, k, rng.choice(["edit", "edit", "undo", "redo"])) for k in range(200)]
    want = {}
    for p, _, op, action in log:
        want[p] = streamed.step(*want.get(p, ([], [])), op, action)
    frame = spark.createDataFrame(log, "project_id long, seq long, op long, action string")
    assert {r.project_id: (list(r.done), list(r.undone)) for r in history.folded(frame).collect()} == want
    for k in range(4):
        frame.where(F.col("seq").between(k * 50, k * 50 + 49)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/log")
    query = streamed.folded_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.project_id for r in spark.table("folded").collect()} == set(want)


def test_history_state_keeps_deletions(spark):
    base = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "project_id long, row_id long, value string")
    changes = spark.createDataFrame([(1, 1, 1, "x"), (1, 2, 2, None), (1, 4, 3, "new"), (1, 1, 4, "y")], "project_id long, row_id long, seq long, after string")
    assert sorted((r.row_id, r.value) for r in history.state(base, changes).collect()) == [(1, "y"), (3, "c"), (4, "new")]


def test_split_maps_to_the_original():
    assert edits.original_offset("le chat noir", "le chat noir", 7) == 7
    assert edits.original_offset("le gros chat noir", "le chat noir", 12) == 7


def test_include_joins_the_bead_around(spark):
    segs = spark.createDataFrame([(1, "source", 1, 0, "a", "a", "paragraph", False, 0.0), (1, "source", 2, 0, "b", "b", "footnote", True, None), (1, "source", 3, 0, "c", "c", "paragraph", False, 0.0), (1, "source", 4, 0, "d", "d", "other", True, None)], "project_id long, side string, block_pos long, seg_no int, text string, original_text string, kind string, excluded boolean, bead_pos double")
    beads = spark.createDataFrame([(1, 0.0, 0.9, "length", 2)], "project_id long, bead_pos double, confidence double, method string, review_level int")
    blocks = segs.where("excluded").select("project_id", "side", "block_pos")
    new_segs, new_beads = edits.blocks_included(segs, beads, blocks)
    got = {r.block_pos: r.bead_pos for r in new_segs.collect()}
    assert got[2] == 0.0 and got[4] > 0.0
    assert sorted((r.confidence, r.method) for r in new_beads.collect()) == [(0.0, "manual"), (0.9, "length")]


def test_txt_blocks(spark):
    made = [(1, "one\ntwo\n\nthree four\n"), (2, "\n\none\ntwo\r\n"), (3, "")]
    got = [tuple(r) for r in ingest.text_blocks(spark.createDataFrame(made, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 0, "one two"), (1, 1, "three four"), (2, 0, "one"), (2, 1, "two")]


def test_files_and_encodings(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("﻿été".encode())
    (tmp_path / "b.txt").write_bytes("été".encode("latin-1"))
    text, warned = ingest.decoded(F.col("content"))
    got = sorted((r.t, r.w) for r in ingest.files(spark, str(tmp_path)).select(text.alias("t"), warned.alias("w")).collect())
    assert got == [("été", False), ("été", True)]
    (tmp_path / "c.epub").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported"):
        ingest.files(spark, str(tmp_path)).select("extension").collect()


def test_docx(spark):
    content = export.docx_bytes([("heading", "I"), ("paragraph", "Un & deux"), ("paragraph", " ")])
    got = [(r.block_no, r.kind, r.text) for r in ingest.docx_blocks(spark.createDataFrame([(1, bytearray(content))], "doc_id long, content binary")).collect()]
    assert got == [(0, "heading", "I"), (1, "paragraph", "Un & deux")]


def test_bundle_errors(spark):
    def zipped(name, text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, text)
        return bytearray(out.getvalue())

    segment = {"text": "t", "original_text": "t", "bead": 0}
    book = {"format": "parallel-book", "version": 2, "book": {"title": "A"}, "documents": [{"side": "source", "blocks": [{"kind": "other", "excluded": False, "page": None, "segments": [segment]}]}], "beads": [{"confidence": 1, "method": "manual", "review_level": "turn"}]}

    def changed(change) -> str:
        made = json.loads(json.dumps(book))
        change(made)
        return json.dumps(made)

    refused = {
        "not a bundle: BadZipFile": bytearray(b"no zip"),
        "not a bundle: KeyError": zipped("other.json", "{}"),
        "not a bundle of this kind": zipped("bundle.json", '{"format": "x"}'),
        "version True is not known": zipped("bundle.json", changed(lambda b: b.update(version=True))),
        "documents.source.blocks[0].segments[0].bead is out of range": zipped("bundle.json", changed(lambda b: b["documents"][0]["blocks"][0]["segments"][0].update(bead=3))),
        "documents[0].blocks[0].excluded must be true or false": zipped("bundle.json", changed(lambda b: b["documents"][0]["blocks"][0].update(excluded=1))),
        "documents[0].blocks[0].segments[0].bead must be a whole number or null": zipped("bundle.json", changed(lambda b: b["documents"][0]["blocks"][0]["segments"][0].update(bead=True))),
        "beads must be a list": zipped("bundle.json", changed(lambda b: b.pop("beads"))),
        "beads[0].review_level can't be 'all'": zipped("bundle.json", changed(lambda b: b["beads"][0].update(review_level="all"))),
        "book.title must be a text": zipped("bundle.json", changed(lambda b: b["book"].update(title=None))),
    }
    made = [*enumerate(refused.values()), (90, zipped("bundle.json", json.dumps(book)))]
    first = changed(lambda b: (b.update(version=1), b["beads"][0].pop("review_level"), b["beads"][0].update(reviewed=True)))
    read = export.read_bundles(spark.createDataFrame([*made, (91, zipped("bundle.json", first))], "project_id long, content binary"))
    assert {r.project_id: r.error for r in read.where("error is not null").collect()} == dict(enumerate(refused))
    segs, beads = export.restored(read)
    assert {(r.project_id, r.review_level) for r in beads.collect()} == {(90, 2), (91, 3)}
    assert segs.count() == 2 and export.bad_references(segs, beads).count() == 0
    assert [r.title for r in export.restored_books(read, spark.createDataFrame([("A",)], "title string"), "2024-03-01", "now").collect()] == ["A (restored 2024-03-01)"] * 2


def test_disposition(spark):
    told = spark.createDataFrame([("Été: 1/2",)], "title string").select(export.disposition(F.col("title"), ".zip").alias("h")).first().h
    assert told == "attachment; filename=\"_t__ 1_2.zip\"; filename*=UTF-8''%C3%89t%C3%A9_%201_2.zip"


def test_replaced_run_and_places(spark):
    """Unknown methods and other segments are refused; a run at the book's edge; no room between siblings."""
    keys = "project_id long, side string, block_pos long, seg_no long, text string, original_text string, excluded boolean, bead_pos double"
    made = spark.createDataFrame([(p, s, 1, k, f"{s}{k}", f"{s}{k}", False, float(k)) for p in (1, 2, 3) for s in ("source", "target") for k in range(3)], keys)
    beads = spark.createDataFrame([(p, float(k), 0.5, "length", 2) for p in (1, 2, 3) for k in range(3)], "project_id long, bead_pos double, confidence double, method string, review_level int")
    runs = spark.createDataFrame([(p, 1, 2) for p in (1, 2, 3)], "project_id long, first int, last int")
    new = [(1, "source", 1, 1, 0, 1.0, "manual"), (1, "source", 1, 2, 0, 1.0, "manual"), (1, "target", 1, 1, 0, 1.0, "manual"), (1, "target", 1, 2, 1, 0.9, "manual")]
    new += [(2, *r[1:]) for r in new[:3]] + [(3, *r[1:6], "guess") for r in new]
    segs, after, refused = edits.run_replaced(made, beads, runs, spark.createDataFrame(new, "project_id long, side string, block_pos long, seg_no long, n int, confidence double, method string"))
    assert {r.project_id for r in refused.collect()} == {2, 3}
    got = {(r.project_id, r.bead_pos): (r.confidence, r.method, r.review_level) for r in after.collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 0.0): (0.5, "length", 2), (1, 1.0): (1.0, "manual", 0), (1, 2.0): (0.9, "manual", 0)} and len(got) == 9
    assert sorted((r.side, r.seg_no, r.bead_pos) for r in segs.where("project_id = 1").collect()) == [("source", 0, 0.0), ("source", 1, 1.0), ("source", 2, 1.0), ("target", 0, 0.0), ("target", 1, 1.0), ("target", 2, 2.0)]


def test_phrase_highlights(spark):
    text = spark.createDataFrame([("Un deux, un-deux trois UN",)], "text string")
    spans = text.select(search.highlights(F.col("text"), ["un", "de"]).alias("s")).first().s
    assert [x.text for x in spans if x.match] == ["Un", "deux", "un", "deux"] and "".join(x.text for x in spans) == "Un deux, un-deux trois UN"
    assert [x.text for x in text.select(search.highlights(F.col("text"), ["un", "deux", "trois"], whole_words=True).alias("s")).first().s if x.match] == ["un", "deux", "trois"]


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "token string, project_id long, bead_pos long, side string, pos int")
    search.write_index(none, f"{tmp_path}/i")
    assert search.matching(search.read_index(spark, f"{tmp_path}/i"), '"a b" c').count() == 0


def test_tables_of_decisions(spark, tmp_path):
    (tmp_path / "d.tsv").write_text('side\tdecision\tnote\nsource\tjoin\t"quoted\ntarget\tkeep\t\n')
    read = ingest.decisions(spark, f"{tmp_path}/d.tsv", ["side", "decision", "note"], {"decision": ("join", "keep")})
    assert [r.note for r in read.collect()] == ['"quoted', None]
    with pytest.raises(ValueError):
        ingest.decisions(spark, f"{tmp_path}/d.tsv", ["side"], {})
    with pytest.raises(Exception, match="decision"):
        ingest.decisions(spark, f"{tmp_path}/d.tsv", ["side", "decision", "note"], {"decision": ("join",)}).collect()


def test_gold_layer(spark):
    text = '{"format": 1, "source": [["a", 0], ["b", null]], "target": [["c", 0]], "reviewed": [true]}'
    got = sorted(tuple(r)[1:] for r in ingest.gold_layer(spark.createDataFrame([(1, text)], "layer_id long, json string")).collect())
    assert got == [("source", 0, "a", 0), ("source", 1, "b", None), ("target", 0, "c", 0)]


def test_hyphens(spark):
    hard = [(1, 0, 0, "il vit la mai-"), (1, 0, 1, "son et dit-"), (1, 0, 2, "il encore porte-"), (1, 0, 3, "clef puis"), (1, 1, 0, "le porte-clef ici")]
    soft = [(2, 0, 0, "la mai­"), (2, 0, 1, "son un vis-"), (2, 0, 2, "age et sous-"), (2, 0, 3, "main"), (2, 1, 0, "ce visage là")]
    got = {(r.doc_id, r.block_no): r.text for r in ingest.dehyphenated(spark.createDataFrame(hard + soft, "doc_id long, block_no long, line_no long, text string")).collect()}
    assert got == {(1, 0): "il vit la maison et dit-il encore porte-clef puis", (1, 1): "le porte-clef ici", (2, 0): "la maison un visage et sous-main", (2, 1): "ce visage là"}


def test_two_up_pages(spark):
    lines = [(1, 0, k, 10.0 if k % 2 else 310.0, 20.0 + k // 2 * 12, 290.0 if k % 2 else 590.0, 30.0 + k // 2 * 12, f"l{k}", 10.0) for k in range(10)] + [(1, 1, 0, 10.0, 20.0, 90.0, 30.0, "portrait", 10.0)]
    pages = spark.createDataFrame([(1, 0, 600.0, 400.0), (1, 1, 400.0, 600.0)], "doc_id long, page int, width double, height double")
    got, sizes = layout.logical_pages(spark.createDataFrame(lines, "doc_id long, page int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, size double"), pages)
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.page, r.line_no)):
        by.setdefault(r.page, []).append(r.text)
    assert by == {0: [f"l{k}" for k in range(1, 10, 2)], 1: [f"l{k}" for k in range(0, 10, 2)], 2: ["portrait"]}
    assert sorted((r.page, r.width) for r in sizes.collect()) == [(0, 300.0), (1, 300.0), (2, 400.0)]


def test_stray_spaces(spark):
    glyphs = [("f", 0.0, 0.0), ("i", 3.0, 3.0), (" ", 1.0, 1.0), ("n", 6.0, 6.0), (" ", 9.0, 9.0)]
    frame = spark.createDataFrame([(glyphs,)], "g array<struct<c:string,origin_x:double,x0:double>>")
    assert list(frame.select(layout.stray_spaces(F.col("g")).alias("s")).first().s) == [2]


def test_paragraphs_run_over_pages(spark):
    rows = [(1, 0, 0, 50.0, 100.0, "start", 10.0, "paragraph"), (1, 0, 1, 50.0, 112.0, "more", 10.0, "paragraph"), (1, 0, 2, 50.0, 124.0, "same", 10.0, "paragraph"), (1, 0, 3, 50.0, 700.0, "3", 10.0, "page_number"), (1, 1, 0, 50.0, 100.0, "goes on", 10.0, "paragraph"), (1, 1, 1, 60.0, 112.0, "indent", 10.0, "paragraph"), (1, 1, 2, 50.0, 124.0, "Title", 14.0, "heading"), (1, 1, 3, 50.0, 136.0, "after", 10.0, "paragraph"), (1, 1, 4, 50.0, 190.0, "gap", 10.0, "paragraph")]
    frame = spark.createDataFrame(rows, "doc_id long, page int, line_no int, x0 double, y0 double, text string, size double, kind string").withColumn("body", F.lit(10.0))
    got = {r.text: r.block_no for r in layout.assembled(frame).collect()}
    assert got == {"start": 0, "more": 0, "same": 0, "goes on": 0, "3": 1, "indent": 2, "Title": 3, "after": 4, "gap": 5}


def test_empty_sets_score(spark):
    none = spark.createDataFrame([], "project_id long, s long, t long")
    some = spark.createDataFrame([(1, 2, 3)], "project_id long, s long, t long")
    books = spark.createDataFrame([(1,)], "project_id long")
    assert tuple(quality.alignment_score(none, none, books).first())[4:] == (1.0, 1.0, 1.0)
    assert tuple(quality.alignment_score(some, none, books).first())[4:] == (0.0, 0.0, 0.0)


def test_rebase_moves_merges_and_cuts(spark):
    gold = [(1, "source", 0, 0, "First part", "First part", 0, False), (1, "source", 1, 1, "12", "12", 1, False), (1, "source", 2, 2, "goes on.", "goes on.", 2, False), (1, "source", 3, 3, "One. Two.", "One. Two.", 3, False)]
    fresh = [(1, "source", 0, "First part goes on.", False), (1, "source", 1, "12", True), (1, "source", 2, "One.", False), (1, "source", 3, "Two.", False)]
    g = spark.createDataFrame(gold, "project_id long, side string, block long, pos long, text string, original string, bead long, excluded boolean")
    f = spark.createDataFrame(fresh, "project_id long, side string, block long, text string, excluded boolean")
    made = repair.rebased(g, f)
    got = [(r.block, r.text, r.bead, r.excluded) for r in made.orderBy("pos").collect()]
    assert got == [(0, "First part", 0, False), (0, "goes on.", 2, False), (1, "12", None, True), (2, "One.", 3, False), (3, " Two.", 3, False)]
    assert [r.bead for r in repair.checked_rebase(g, made).collect()] == [1]
    with pytest.raises(ValueError, match="not in the reference"):
        repair.rebase_side([], [{"text": "x", "excluded": False}])


def test_decisions_must_be_complete(spark):
    segs = spark.createDataFrame([(1, "source", 0, 0, "fi lms et Th e of all")], "project_id long, side string, block_pos long, seg_no long, text string")
    found = repair.gap_candidates(segs)
    assert sorted(r.offset for r in found.collect()) == [2, 12, 17]
    decisions = found.where("offset < 15").withColumn("decision", F.lit("join"))
    assert [r.offset for r in repair.undecided(found, decisions).collect()] == [17]
    assert repair.gaps_closed(segs, decisions).first().text == "films et The of all"


def test_versions(spark, tmp_path):
    store.publish(spark, {"t": spark.range(3)}, str(tmp_path), "20240101-120000")
    assert (tmp_path / "20240101-120000" / "_COMPLETE").is_dir()
    made = spark.createDataFrame([("a", f"2024-{k:02}") for k in range(12)] + [("a", "2024-11-2")], "library string, version string")
    assert sorted(r.version for r in store.kept_versions(made).collect())[0] == "2024-03"


def test_scale_library(spark):
    made = store.scale_library(spark, 3, 20)
    assert made.count() == 120 and made.select("project_id", "bead_pos").distinct().count() == 60


def test_dropped_ligatures(spark):
    words = spark.createDataFrame([("lm", 1), ("film", 4), ("other", 1)], "word string, n long")
    assert [tuple(r) for r in repair.dropped_ligatures(words).select("word", "repair").collect()] == [("lm", "film")]
