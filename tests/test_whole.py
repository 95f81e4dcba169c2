"""Queries read every line, block and document of their tables: small tables, results by brute force."""

from __future__ import annotations

import re
from collections import defaultdict

import duckdb
import pytest

from twinfold.functions import text as T
from twinfold.plans import ORACLES, QUERIES

LETTERS = r"[^\W\d_]"


def documents(spark, folder, rows):
    """(folder, what SQL finds there) for documents (doc_id, text)."""
    spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")

    def sql(name):
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        return c.execute(ORACLES[name]).fetchall()

    return str(folder), sql


def printed(rows):
    """Lines of three words of every block; some are cut in their last word, even documents by a soft hyphen."""
    out = defaultdict(list)
    for doc, text in rows:
        for block, line in enumerate(text.split("\n")):
            words, cut = line.split(), False
            for k in range(0, len(words), 3):
                t = " ".join(words[k : k + 3])
                t = t[2:] if cut else t
                following = words[k + 3] if k + 3 < len(words) else ""
                cut = (doc + block + k // 3) % 5 == 0 and bool(re.match(LETTERS + "{4}", following))
                out[doc, block].append(t + (f" {following[:2]}" + ("\xad" if doc % 2 == 0 else "-") if cut else ""))
    return out


def spelling(lines):
    """Words and hyphen pairs of each document, without what a line's end may have cut."""
    words, pairs = defaultdict(set), defaultdict(set)
    for (doc, _), block in lines.items():
        after = False
        for t in block:
            ends = bool(re.search(LETTERS + "[-\xad]$", t))
            w = re.sub(f"^{LETTERS}+", "", t) if after else t
            w = re.sub(f"{LETTERS}+[-\xad]$", "", w) if ends else w
            words[doc] |= set(re.findall(f"{LETTERS}+", w.lower()))
            p = re.sub(f"^{LETTERS}+(-{LETTERS}+)*", "", t) if after else t
            p = re.sub(f"{LETTERS}+(-{LETTERS}+)*[-\xad]$", "", p) if ends else p
            for chain in re.findall(f"{LETTERS}+(?:-{LETTERS}+)+", p.lower()):
                pairs[doc] |= set(zip(chain.split("-"), chain.split("-")[1:]))
            after = ends
    return words, pairs


LONG = [(d, "\n".join(f"line{'abcdefghijkl'[n]} opens quietly before another sentence about harbours and mountains" for n in range(12))) for d in (10, 11)]


def test_lexicon_reads_every_line(spark, tmp_path):
    folder, sql = documents(spark, tmp_path, LONG)
    words, _ = spelling(printed(LONG))
    brute = {(d, w) for d in words for w in words[d]}
    assert {(d, "linel") for d in (10, 11)} <= brute
    assert {(r.doc_id, r.word) for r in QUERIES["dehyphenate_lexicon"](spark, folder).collect()} == brute == set(sql("dehyphenate_lexicon"))


def rejoined(lines):
    """Blocks with their breaks taken back: by soft hyphens, by the document's own spelling, by particles."""
    words, pairs = spelling(lines)
    soft = {doc for (doc, _), block in lines.items() if any(t.endswith("\xad") for t in block)}
    out = {}
    for (doc, block), ts in lines.items():
        text = ""
        for t, following in zip(ts, [*ts[1:], None]):
            a, b = re.search(f"({LETTERS}+)-$", t), following is not None and re.match(f"{LETTERS}+", following)
            if following is None:
                text += t
            elif t.endswith("\xad"):
                text += t[:-1]
            elif not a:
                text += t + " "
            else:
                one, two = a[1].lower(), b[0].lower() if b else ""
                known = one + two in words[doc] if doc in soft else two not in T.PARTICLES
                text += t[:-1] if two and (one, two) not in pairs[doc] and known else t
        if ts:
            out[doc, block] = text.replace("\xad", "")
    return out


def test_breaks_of_every_document(spark, tmp_path):
    particle, spelt = sorted(T.PARTICLES)[0], "one two well-known three four five"
    kept = "\n".join([f"first second third- {particle} more words here", f"and so well- known to everybody hereabouts", spelt, "one two third- rateable goods are sold"])
    rows = [*LONG, (3, kept), (4, kept + "\nsoft\xad hyphens in here"), (5, kept), (6, kept.replace("third- ", "third-\xad "))]
    lines = printed(rows)
    hard = {(d, b) for (d, b), ts in lines.items() if any(re.search(LETTERS + "-$", t) for t in ts[:-1])}
    assert {d for d, _ in hard} >= {3, 4, 5, 11}
    folder, sql = documents(spark, tmp_path, rows)
    brute = rejoined(lines)
    got = {(r.doc_id, r.block_no): r.text for r in QUERIES["dehyphenate_soft"](spark, folder).collect()}
    assert got == brute == {(d, b): t for d, b, t in sql("dehyphenate_soft")}
    assert {d for d, _ in got} == {d for d, _ in rows}
    assert "well-known to" in got[3, 1] and f"third-{particle}" in got[3, 0] and "thirdrateable" in got[5, 3]


def test_ligatures_of_every_line(spark, tmp_path):
    rows = [(1, "no gaps here\nThe final flower of five\nchef in love"), (2, "first\n\nThis finds chef and Th at"), (3, "The flag")]
    folder, sql = documents(spark, tmp_path, rows)
    lines = [line for _, text in rows for line in text.split("\n")]
    slips = sum(len(re.findall(rf"(?:fi|fl|Th)(?={LETTERS})", line)) for line in lines)
    real = sum(len(re.findall(rf"(?<=f) (?={LETTERS})|(?<=Th) (?={LETTERS})", line)) for line in lines)
    brute = {(False, slips), (True, real)}
    assert {(r.real, r.n) for r in QUERIES["ligature_score"](spark, folder).collect()} == brute == set(sql("ligature_score"))


def test_all_blocks_and_beads_of_a_book(spark, tmp_path):
    """Two excluded blocks at the start and two inside beads that span them; no row is left out."""
    turns = [(1, 0, "system", "First rule\nSecond rule. It goes on"), (1, 1, "user", "One here"), (1, 2, "system", "Third rule"), (1, 3, "user", "Two here\nThree here"), (1, 4, "system", "Fourth rule"), (1, 5, "user", "Four here\nFive here"), (1, 6, "assistant", "Un ici\nDeux ici\nTrois ici\nQuatre ici")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    run = lambda name: [r.asDict() for r in QUERIES[name](spark, str(tmp_path)).collect()]

    def sql(name):
        found = c.execute(ORACLES[name])
        return [dict(zip([d[0] for d in found.description], r)) for r in found.fetchall()]

    key = lambda r: sorted(r.items())
    for name in ("include_block", "load_blocks", "append_beads", "renumber"):
        assert sorted(run(name), key=key) == sorted(sql(name), key=key)
    source = {(r["block_pos"], r["seg_no"]): (r["excluded"], r["bead_pos"]) for r in run("include_block") if r["side"] == "source"}
    k = 1 / 3  # two new beads divide the way to the first one
    beads = {1: -1 + k, 2: -1 + 2 * k, 3: 0.0, 4: 0.0, 5: 0.0, 6: 1.0, 7: 1.0, 8: 1.0, 9: 2.0}
    assert source == {(b, s): (False, at) for b, at in beads.items() for s in range(2 if b == 2 else 1)}
    assert [r["ord"] for r in sorted(run("load_blocks"), key=lambda r: (r["side"], r["block_pos"]))] == [n * 1024 for n in range(9)] + [n * 1024 for n in range(4)]
    assert sorted(r["ord"] for r in run("append_beads")) == [(3 + n) * 1024 for n in range(1, 5)]
    assert sorted((r["bead_pos"], r["ord"]) for r in run("renumber")) == [(n, n * 1024) for n in range(4)]
