"""Each operator against a brute-force version on a small table of awkward cases, and on an empty table."""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.llm import ann, language_id, line_dedup, mixing, near_join, packing, quality_rules, sharding, toxicity, warc
from twinfold.llm.components import components
from twinfold.llm.queries import tokenizer

from .data import DOCS, WORD, rows


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_rules(docs, data):
    got = sorted(map(tuple, quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()))
    want = []
    for d, text, *_ in data:
        w, covered = WORD.findall(text or ""), set()
        count = Counter(zip(w, w[1:], w[2:]))
        for i in range(len(w) - 2):
            if count[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == sorted(want)


def test_quality_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short text"
    made = [(i, good if i % 10 else bad, "good") for i in range(100)] + [(100 + i, bad if i % 10 else good, "bad") for i in range(100)] + [(300, good, None)]
    judged = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()}
    assert judged[1].kept and judged[300].kept and not judged[0].kept
    assert not judged[110].base_failed and not judged[110].kept and judged[110].host_rate > 0.5


def test_quality_rules_by_host(spark):
    """A rule that fails no document by itself fails its host, and with it the host's other documents; nulls and clashes."""
    good = " ".join(f"w{i}" for i in range(60))
    lines = "\n".join(["the same line here"] + [" ".join(f"v{k}x{i}" for i in range(20)) for k in range(4)] + ["the same line here"] * 3)
    made = [(i, good + (" #" * 20 if i % 8 else ""), "signs") for i in range(80)] + [(100 + i, lines if i % 8 else good, "lines") for i in range(80)] + [(200 + i, good, "good") for i in range(200)] + [(None, None, None), (None, "", None), (900, good, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").selectExpr("*", "1 AS n_lines", "'clash' AS docs", "2 AS short", "3 AS host_rate", "4 AS w")
    judged = quality_rules.judge(docs).collect()
    assert len(judged) == len(made) and not any(r.base_failed for r in judged if r.source)
    assert {r.kept for r in judged if r.source in ("signs", "lines")} == {False} and {r.kept for r in judged if r.source == "good"} == {True}
    assert sum(r.base_failed for r in judged if r.source is None) == 2
    assert quality_rules.host_rates(quality_rules.measure(docs).limit(0)).count() == 0


def test_mixing(docs, data):
    mixed, quotas = mixing.mix(docs, block=8, shards=4)
    got = mixed.collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for d, text, _, source, *_ in data:
        sizes[source] += len(WORD.findall(text or ""))
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
    assert len(got) == len(data)
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want, capped = {}, set()
    while True:
        free = [s for s in sizes if s not in capped]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        want = {s: 3 * sizes[s] if s in capped else level * weight[s] for s in sizes}
        if not over:
            break
        capped |= over
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - want[s]) <= 24
    again, _ = mixing.mix(docs.repartition(5), block=8, shards=4)
    assert Counter((r.doc_id, r.taken, str(r.parts)) for r in got) == Counter((r.doc_id, r.taken, str(r.parts)) for r in again.collect())


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_quotas_decide_blocks(docs, shards):
    """Each shard takes exactly its quota of whole blocks from a source (the stream's last block may be shorter)."""
    block = 8
    mixed, quotas = mixing.mix(docs, block=block, shards=shards)
    taken, quota, size = Counter(), Counter(), {}
    for r in mixed.collect():
        assert r.taken == sum(p.taken for p in r.parts) and (r["size"] or not r["copies"]) and r["copies"] <= 3
        size[r.source] = r.source_size
        for p in r.parts:
            taken[r.source, p.shard] += p.taken
    for r in quotas.collect():
        assert r.blocks >= 0
        quota[r.source, r.shard] = r.blocks
    assert set(taken) <= set(quota) and sum(quota.values()) == max(1, round(sum(size.values()) / block))
    for key, blocks in quota.items():
        short = -size[key[0]] % block  # what the last block lacks
        assert taken[key] in {block * blocks - short * k for k in range(4)}
    if shards == 16:
        assert len({k for _, k in taken}) == 16


def test_mixing_many_sources(spark):
    """Targets against the definition where many sources are small; some fill up only after others."""
    rng = np.random.default_rng(7)
    made = [(f"h{i:03d}", int(n)) for i, n in enumerate(np.minimum(3000, rng.pareto(0.6, 120) * 5 + 1))]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(made, "source string, size long")).collect()}
    weight = {s: k % 3 + 1 for k, (s, _) in enumerate(made)}
    cap = {s: 3 * n for s, n in made}
    low, high = 0.0, 3e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap[s], mid * weight[s]) for s in cap) < sum(n for _, n in made) else (low, mid)
    assert all(got[s].weight == weight[s] and math.isclose(got[s].target, min(cap[s], low * weight[s]), rel_tol=1e-9) for s in cap)
    assert 0 < sum(got[s].target == cap[s] for s in cap) < len(cap)


@pytest.mark.parametrize("house", [1, 7, 100, 12345])
def test_sainte_lague(spark, house):
    targets = [("a", 5.0), ("b", 100.0), ("c", 31.5), (None, 0.0), ("d", 900.25)]
    made = spark.createDataFrame(targets, "source string, target double")
    got = {r.source: r.seats for r in mixing.seats(made, [house]).collect()}
    won = Counter()
    for _ in range(house):
        best = max((s for s in targets), key=lambda s: (s[1] / (2 * won[s[0]] + 1), -ord((s[0] or "z")[0])))
        won[best[0]] += 1
    assert got == {s: won[s] for s, _ in targets}


def test_language_id(spark, docs, data):
    model = language_id.language_model(docs, tokenizer("piece_bpe_32k.model"))
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    right = [by[d].lang_pred == lang for d, text, lang, *_ in data[:60]]
    assert sum(right) >= 57
    for d, text, *_ in data:
        assert (by[d].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= by[d].score <= 1
    words = ["river", "été", "a", "unbelievably", "zzz"]
    assert np.allclose(model.runs(words), [model.word(w) for w in words])
    assert np.isfinite(model.word("abc" * 3000)).all()


def test_forward_sums_all_segmentations():
    model = language_id.LanguageModel(["x"], {"a": 0, "b": 1, "ab": 2, "aba": 3}, np.array([[0.2], [0.3], [0.4], [0.1], [1e-7]]), np.zeros(1))
    # a.b.a, ab.a, aba
    assert math.isclose(math.exp(model.word("aba")[0]), 0.2 * 0.3 * 0.2 + 0.4 * 0.2 + 0.1)


def cuttings(word: str, pieces: list[str]) -> list[list[str]]:
    """All ways of cutting a word into pieces; a letter that is no piece stands for itself."""
    if not word:
        return [[]]
    heads = {word[:n] for n in range(1, len(word) + 1) if word[:n] in pieces} | ({word[0]} - set(pieces))
    return [[head, *rest] for head in heads for rest in cuttings(word[len(head) :], pieces)]


def test_expectation_maximisation_against_enumeration():
    pieces = ["a", "ab", "aba", "b", "ba", "bab", "c", "ca"]
    words = {"abab": 3, "babaca": 2, "cab": 5, "aba": 7, "xab": 1, "c": 2}
    begin = np.array([8.0 ** (len(p) - 1) for p in pieces])
    p = dict(zip(pieces, begin / (begin.sum() + 1)))
    for _ in range(4):
        p["x"] = 1e-7
        expected = dict.fromkeys(pieces, 0.05)
        for word, n in words.items():
            ways = cuttings(word, pieces)
            chance = [math.prod(p[x] for x in way) for way in ways]
            for way, c in zip(ways, chance):
                for x in way:
                    if x != "x":
                        expected[x] += n * c / sum(chance)
        p = {x: e / sum(expected.values()) for x, e in expected.items()}
    model = language_id.train({"l": words}, pieces, rounds=3)
    assert np.allclose(model.prob[:-1, 0], [p[x] for x in pieces], rtol=1e-9)
    p["x"] = 1e-7
    for word in ["abacab", "xx", "bab", "caba"]:
        want = math.log(sum(math.prod(p[x] for x in way) for way in cuttings(word, pieces)))
        assert math.isclose(model.word(word)[0], want) and math.isclose(model.runs([word, "a"])[0, 0], want)


def test_language_rows(spark):
    """Numerals and marks are no letters; letters beyond the basic plane are; null ids, repeats and clashing columns."""
    made = [(1, "the stone river light is green", "en"), (4, "la rivière est très belle", "fr")] * 3 + [(None, "½ ² ① ٣ _ ́", "en"), (7, "𝒳 ½", "fr"), (7, None, "fr"), (None, "the river", "en")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'clash' AS lang_pred", "2 AS _text", "3 AS _h")
    model = language_id.train(language_id.sample_words(docs), language_id.piece_list(tokenizer("piece_bpe_32k.model")))
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(made) and Counter((r.doc_id, r.lang_pred) for r in got) == Counter({(1, "en"): 3, (4, "fr"): 3, (None, "und"): 1, (7, got[7].lang_pred): 1, (7, "und"): 1, (None, "en"): 1})
    assert got[7].lang_pred != "und" and all(r.score == 0 for r in got if r.lang_pred == "und")
    sample = language_id.sample_words(docs, docs_each=1)
    assert sum(sample["fr"].values()) in (1, 5) and set(sample) == {"en", "fr"}


def test_language_without_training(docs, empty):
    model = language_id.language_model(empty, tokenizer("piece_bpe_32k.model"))
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"und"}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 20))
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 20)) * 0.4).astype(np.float32)
    x[300:420] = x[300]  # copies
    made = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    made += [(2000, None), (2050, [0.0] * 20), (2100, [float("nan")] * 20), (2150, [None] * 20), (2200, [1.0, 2.0]), (None, [1.0] * 20)]
    vectors = ann.usable(spark.createDataFrame(made, "vec_id long, embedding array<float>").withColumn("list", F.lit("clash")))
    got = defaultdict(list)
    for r in ann.search(vectors, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = total = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(sc - s[v]) < 1e-12 for _, v, sc in found)
        hits += len({v for _, v, _ in found} & set(best.tolist()))
        total += 5
    assert set(got) == set(range(0, 900, 50)) and hits / total >= 0.9
    assert [v for _, v, _ in sorted(got[300])] == [301, 302, 303, 304, 305]
    few = ann.search(ann.usable(spark.createDataFrame(made[:3], "vec_id long, embedding array<float>")), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(ann.usable(none), F.col("vec_id") == 0).collect() == []


def test_codes_decide_what_is_scored(spark):
    """Asymmetric tables against decoded vectors; a query scores its ``rerank`` nearest codes over all lists it visits."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24))
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.fit(ann.usable(frame), 600, parts=6, codes=16, lists=9, probes=9)
    unit = index.pad(x)
    near, code = index.encode(unit)
    decoded = index.coarse[near] + np.concatenate([book[code[:, p]] for p, book in enumerate(index.books)], axis=1)
    for at in range(9):
        mine = near == at
        assert np.allclose(index.distances(unit[:7], at, code[mine]), ((unit[:7, None] - decoded[mine][None]) ** 2).sum(axis=2))
    assert (np.sum(((unit[:40, None] - decoded[None]) ** 2).sum(axis=2) <= index.bounds(unit[:40], 30)[:, None], axis=1) >= 30).all()
    got = defaultdict(set)
    for r in ann.search(ann.usable(frame), F.col("vec_id") % 50 == 0, k=5, index=index, rerank=30).collect():
        got[r.query_id].add(r.vec_id)
    for q in range(0, 600, 50):
        distance = ((unit[q] - decoded) ** 2).sum(axis=1)
        distance[q] = np.inf
        best = np.argsort(distance, kind="stable")[:30]
        score = unit @ unit[q]
        assert got[q] == set(best[np.argsort(-score[best], kind="stable")[:5]].tolist())


def test_toxicity(spark):
    made = [(i, ("you are a stupid idiot " if i % 5 == 0 else "you are a kind friend ") + " ".join(f"w{(i * 7 + k) % 50}" for k in range(30)), int(i % 5 == 0)) for i in range(400)]
    labelled = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.train(labelled.where("doc_id < 300"))
    got = {r.doc_id: r.score for r in toxicity.score(labelled.union(spark.createDataFrame([(900, None, 0), (901, "", 0)], labelled.schema)), model).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(300, 400))
    assert 0 <= got[900] == got[901] < 0.3
    assert len(model.at) < 2000  # the penalty leaves a sparse model
    blank = toxicity.train(labelled.limit(0))
    assert {r.score for r in toxicity.score(labelled, blank).collect()} == {0.5}


def test_ftrl_step_by_step(spark):
    """Weights of the trained model against the published update rule, written out coordinate by coordinate."""
    texts = ["you stupid fool", "kind words here", "stupid stupid words", "", "a fool", None, "kind kind fool words"] * 6
    made = [(i, t, int("stupid" in (t or "") or i % 9 == 0)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    order = [r.doc_id for r in frame.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").collect()]
    rows = [(sorted({int(x) for x in toxicity.features(made[i][1], toxicity.WordHashes(), 12)}), made[i][2]) for i in order]
    z, n, positive = defaultdict(float), defaultdict(float), sum(y for _, y in rows)
    base = math.log((positive + 0.5) / (len(rows) - positive + 0.5))

    def weight(i) -> float:
        l1 = 0.0 if i == "intercept" else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for x, y in rows:
            x = [*x, "intercept"]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-base - sum(w.values()))) - y
            for i in x:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    model = toxicity.train(frame, bits=12, epochs=3)
    assert dict(zip(model.at.tolist(), np.round(model.weight, 9))) == {i: round(weight(i), 9) for i in z if i != "intercept" and weight(i)}
    assert math.isclose(model.bias, base + weight("intercept")) and len(model.at) > 3
    scores = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    for i, text, _ in made:
        total = model.bias + sum(weight(x) for x in {int(x) for x in toxicity.features(text, toxicity.WordHashes(), 12)})
        assert math.isclose(scores[i], 1 / (1 + math.exp(-total)))


def test_toxicity_rows(spark):
    """Null ids, repeated rows and labels, empty texts and tables, clashing columns."""
    docs = spark.createDataFrame([(1, "you stupid fool"), (1, "a kind word"), (2, "kind"), (None, "stupid"), (3, ""), (4, None), (2, "kind")], "doc_id long, text string").selectExpr("*", "'clash' AS score", "'clash' AS toxic", "1 AS predicted")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    sample = toxicity.labelled(docs, labels)
    assert Counter((r.doc_id, r.text, r.toxic) for r in sample.collect()) == Counter([(1, "you stupid fool", 1), (1, "a kind word", 1), (2, "kind", 0), (2, "kind", 0)])
    model = toxicity.train(sample)
    got = toxicity.score(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 1, 2, 2, 3, 4, None]) and all(0 < r.score < 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(toxicity.labelled(docs.limit(0), labels))).collect()} == {0.5}


def test_line_dedup(docs, data):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    held, copies = defaultdict(list), []
    for d, text, *_ in data:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(d)
    want = []
    for d, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 3 or d == max(held[key(x)])]
        want.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    done = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs))
    got = [tuple(r) for r in done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 10


def test_line_dedup_many_lines(spark):
    line = "a line that is common to three documents"
    text = "\n".join(line if i % 3 else f"own {i}" for i in range(1000))
    found = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.apply_bitmaps(found, line_dedup.drop_bitmaps(found)).collect()}
    assert got == {0: (1000, 666), 1: (1000, 666), 2: (1000, 666), 3: (1000, 0)}


def test_line_dedup_of_shared_ids(spark):
    """Texts under one doc_id, or under none, lose their own lines only; clashing columns do not matter."""
    common = "A line that is common to many documents"
    made = [(1, f"{common}\nkeep this"), (1, "a line of this text alone\nother"), (2, common), (3, f"x\n{common}"), (None, f"{common}\nfirst without a name"), (None, "one more text\nthat has no name at all"), (1, f"{common}\nkeep this")]
    docs = spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "'clash' AS drops", "1 AS n_lines", "2 AS n_dropped", "'' AS kept_text", "3 AS t1", "4 AS carried", "5 AS m_doc")
    got = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs), ("m_doc",))
    assert got.columns == ["doc_id", "text", "m_doc", "kept_text", "n_lines", "n_dropped"]
    want = [(1, "keep this", 1), (1, "a line of this text alone\nother", 0), (2, "", 1), (3, f"x\n{common}", 0), (None, "first without a name", 1), (None, "one more text\nthat has no name at all", 0), (1, "keep this", 1)]
    assert sorted((str(r.doc_id), r.kept_text, r.n_dropped) for r in got.collect()) == sorted((str(d), *x) for d, *x in want)


def brute_near(made: list[tuple]) -> list[tuple]:
    """(doc_id, class_id, n_links) of every row; each is a document of its own."""
    sets, by = [], defaultdict(list)
    for _, text, *_ in made:
        w = WORD.findall(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for d, e in combinations(range(len(made)), 2):
        if sets[d] and sets[e] and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]):
            by[d].append(e)
            by[e].append(d)
    label = {}
    for d in range(len(made)):
        todo, members = [d], []
        while todo:
            u = todo.pop()
            if u not in label:
                label[u] = d
                members.append(u)
                todo += by[u]
        least = min((made[u][0] for u in members if made[u][0] is not None), default=None)
        label |= dict.fromkeys(members, least)
    return [(row[0], label[d], len(by[d])) for d, row in enumerate(made)]


def test_near_join(docs, data):
    got = [(r.doc_id, r.class_id, r.n_links) for r in near_join.near_duplicates(docs).collect()]
    assert sorted(got) == sorted(brute_near(data)) and sum(1 for *_, n in got if n) >= 6


def test_near_join_of_shared_ids(spark):
    """Rows that share a doc_id, or have none, are documents of their own; each class is named by one of its rows."""
    a, b = (" ".join(f"{x}{i}" for i in range(90)) for x in "ab")
    made = [(1, a), (1, b), (2, a), (3, b), (4, a + " word"), (7, "q"), (7, "q"), (None, a), (None, "of its own"), (None, None), (5, ""), (None, "of  its own")]
    frame = spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "'clash' AS rep", "1 AS first", "2 AS t1", "3 AS cluster", "4 AS values")
    found = near_join.near_duplicates(frame).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in found), key=repr) == sorted(brute_near(made), key=repr)
    heads = {(r.p_doc, r.p_t1, r.p_t2) for r in found}
    assert len(heads) == 6 and heads <= {(r.doc_id, r.t1, r.t2) for r in found}  # a, b, q, the text without id, and the two empty ones


def test_near_join_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    made = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(40)] + [(100, " ".join(f"y{i}" for i in range(80)))]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    run = lambda: sorted(map(tuple, near_join.near_duplicates(frame).select("doc_id", "class_id", "copy_of", "n_links").collect()))
    whole = run()
    monkeypatch.setattr(near_join, "BUCKET_ROWS", 7)
    monkeypatch.setattr(near_join, "CLUSTER_ROWS", 9)
    assert run() == whole
    assert whole[0][1] == 0 and whole[0][3] == 39 and whole[-1][3] == 0


def test_bayes_table():
    steps = near_join.least_matches(40, 20, 0.8, 1e-5)
    n, need = steps[0]
    tail = lambda m: sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
    assert tail(need) >= 1e-5 > tail(need - 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 200: 100, 150: 100}


def test_sharding(docs, data):
    got = sharding.shard(docs, shards=5).collect()
    assert len(got) == len(data)
    where, slots, load = {}, defaultdict(list), Counter()
    text = defaultdict(list)
    for d, t, *_ in data:
        text[d].append(t)
    for r in got:
        t = text[r.doc_id][0]
        assert r.size == len((t or "").encode()) + 16
        assert where.setdefault(t, r.shard) == r.shard  # equal texts stay together
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(load) == set(range(5))


def test_sharding_balance(spark):
    made = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.pmod(F.xxhash64("id"), F.lit(97)) + 1).cast("int")).alias("t")).select("doc_id", F.concat("t", F.col("doc_id").cast("string")).alias("text"))
    load = [r["sum(size)"] for r in sharding.shard(made, shards=12).groupBy("shard").sum("size").collect()]
    assert len(load) == 12 and max(load) / min(load) < 1.05


def brute_tree(groups: list[tuple], shards: int, first: int = 0, whole: list[int] | None = None) -> dict:
    """Shard of each group (weight, (size, id, hash), key): exact weighted quantiles along the widest dimension."""
    if shards == 1 or not groups:
        return {key: first for _, _, key in groups}
    spans = [max(at[d] for _, at, _ in groups) - min(at[d] for _, at, _ in groups) for d in range(3)]
    whole = whole or [max(1, x) for x in spans]
    d = max(range(3), key=lambda k: spans[k] / whole[k])
    half = shards // 2
    total, goal = 0, sum(w for w, *_ in groups) * half / shards
    for v in sorted({at[d] for _, at, _ in groups}):
        here = sum(w for w, at, _ in groups if at[d] == v)
        if total + here >= goal or v == max(at[d] for _, at, _ in groups):
            break
        total += here
    at = v if abs(total + here - goal) <= abs(total - goal) else v - 1
    left, right = [g for g in groups if g[1][d] <= at], [g for g in groups if g[1][d] > at]
    return brute_tree(left, half, first, whole) | brute_tree(right, shards - half, first + half, whole)


@pytest.mark.parametrize("wide", [False, True])
def test_sharding_equals_brute_tree(spark, wide):
    spread = F.xxhash64("id") if wide else F.col("id")
    made = spark.range(700).select(spread.alias("doc_id"), F.concat_ws(" ", F.repeat(F.lit("ab"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("int")), (F.col("id") % 650).cast("string")).alias("text"), F.lit("clash").alias("node"), F.lit("clash").alias("weight"), F.lit("clash").alias("shard"))
    made = made.unionByName(spark.createDataFrame([(None, "no id", "", "", ""), (-(1 << 63), "least", "", "", ""), ((1 << 63) - 1 if wide else 9, None, "", "", "")], "doc_id long, text string, node string, weight string, shard string"))
    got = {(r.doc_id, r.g1): r for r in sharding.shard(made, shards=11, slack=0).collect()}
    by: dict = {}
    for (doc, g1), r in got.items():
        weight, size, least = by.get(g1, (0, 0, None))
        by[g1] = weight + r["size"], r["size"], doc if least is None else least if doc is None else min(least, doc)
    ids = [0 if v[2] is None else v[2] for v in by.values()]
    shift = max(0, (max(ids) - min(ids)).bit_length() - 62)
    assert shift == 2
    want = brute_tree([(w, (size, (least or 0) >> shift, g1 >> 24), g1) for g1, (w, size, least) in by.items()], 11)
    assert len(got) == 703 and {g1: r.shard for (_, g1), r in got.items()} == want


def test_packing(spark, docs, data):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    want = Counter(tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, *_ in data)
    pieces = packing.pack_documents(docs, path, seq_len=64, cut_price=3).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length
        by[p.doc_id].append((p.start, ids.tolist(), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    texts = Counter(d for d, *_ in data)
    for d, found in by.items():
        if texts[d] == 1:
            ids = [i for _, part, _ in sorted(found, key=lambda x: x[0]) for i in part]
            assert tuple(ids) in want and {t for *_, t in found} == {len(ids)}
    padded = 0
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 64
        padded += 0 if end & (end - 1) == 0 else 64 - end
    assert padded == 0 and sum(p.length for p in pieces) == sum(len(k) * n for k, n in want.items())


def brute_packing(lengths: list[int], size: int, price: int) -> tuple[list, Counter]:
    """(document, start, length, fill it met) of every piece up to the end of the rows, and the open windows by fill."""
    cost = lambda fills, cuts: 16 * sum(n * n for n in fills.values()) + sum(fills.values()) ** 2 + 16 * price * cuts
    fills, out = Counter(), []
    for doc, length in enumerate(lengths):
        at = length - length % size
        while at < length:
            rest, options = length - at, []
            for h in [*sorted(h for h in fills if fills[h]), 0]:  # of equal choices the first
                after, head = Counter(fills), min(size - h, rest)
                if h:
                    after[h] -= 1
                if h + head < size:
                    after[h + head] += 1
                if head < rest:
                    after[rest - head] += 1  # the tail, as if it opened a window
                options.append((cost(after, head < rest), h, head))
            _, h, head = min(options, key=lambda o: o[0])
            out.append((doc, at, head, h))
            if h:
                fills[h] -= 1
            if h + head < size:
                fills[h + head] += 1
            at += head
    return out, +fills


@pytest.mark.parametrize(("price", "seed"), [(0, 1), (1, 2), (5, 3), (63, 4)])
def test_packing_places_like_brute_force(price, seed):
    rng = np.random.default_rng(seed)
    lengths = [int(n) for n in rng.choice([rng.integers(1, 40), 17, 20, 33, 3], 60)] + [int(n) for n in rng.integers(1, 90, 300)]
    size, packer, met = 32, packing.Packer(32, price), []
    choose = packer.choose
    packer.choose = lambda rest, *more: met.append((rest, choose(rest, *more))) or met[-1][1]
    closed = [p for doc, n in enumerate(lengths) for p in packer.add(doc, np.arange(n, dtype=np.uint32))]
    want, fills = brute_packing(lengths, size, price)
    assert [(rest, h) for rest, h in met] == [((lengths[d] - at), h) for d, at, _, h in want]
    assert {h: int(n) for h, n in enumerate(packer.level) if n} == dict(fills) and packer.open == sum(fills.values()) <= 8 * (price + 1) + 1
    pieces = closed + list(packer.close())
    held = defaultdict(list)
    for doc, start, ids, total, _, _ in pieces:
        assert total == lengths[doc]
        held[doc].append((start, ids.tolist()))
    assert all([i for _, part in sorted(held[d]) for i in part] == list(range(n)) for d, n in enumerate(lengths))
    windows = Counter()
    for *_, ids, _, sequence, offset in sorted(pieces, key=lambda p: (p[4], p[5])):
        assert offset == windows[sequence]
        windows[sequence] += len(ids)
    assert all(n == size or n & (n - 1) == 0 for n in windows.values()) and sum(n < size for n in windows.values()) <= 5


@pytest.mark.parametrize("length", [1, 1023, 1024, 1025, 1100, 2047])
def test_packing_memory_is_bounded(length):
    packer = packing.Packer(2048)
    for d in range(3000):
        for _ in packer.add(d, np.zeros(length, np.uint32)):
            pass
        assert packer.open <= 8 * (packing.CUT_PRICE + 1) + 1


def test_word_tokenizer_equals_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    plain, quick = Tokenizer.from_file(path), packing.WordTokenizer(path, limit=5)
    texts = ["Hello,", "New; words! Of, every? kind. And: Plain", "", " ", "It's, well... DON'T!? 12ab", "İstanbul ΣΑΣ á é,x", "a\x1cb\x85c d", "x y", "<|endoftext|>hi<|startoftext|>", "日本 ﬁ ñandú. Ünder,", "ok." * 50]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in quick.many(texts)] == want
    for least in (1, 3):
        quick = packing.WordTokenizer(path, limit=500)
        for _ in range(3):
            assert [x.tolist() for x in quick.many(texts)] == want
            quick.forget(least)
        assert [quick.ids(t).tolist() for t in texts] == want


def test_warc(spark, tmp_path):
    html = ["<p>one</p>", "<p>two</p>", "<p>one</p>", None, "", "é" * 700_000 + "\r\n\r\nWARC/1.1\r\n", "<p>one</p>"]
    made = [(10 + i, f"http://h.example/{i}?q=a b\n", h) for i, h in enumerate(html)] + [(None, None, "<p>one</p>"), (10, "http://again.example", "<p>one</p>")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").withColumn("size", F.lit("clash")).repartition(3)
    manifest = warc.write_archives(warc.chunk_rows(pages, chunk_bytes=100_000), f"file://{tmp_path}/w")
    chunks = warc.read_archives(manifest, chunk_bytes=200_000)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in chunks.where("last").collect()), key=repr)
    first = {}
    for p, _, h in made:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in made:
        body = (h or "").encode()
        revisit = p is not None and p != first[h or ""]
        want.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert got == sorted(want, key=repr)
    big = sorted((r.chunk_no, bytes(r.data)) for r in chunks.where("page_id = 15").collect())
    assert b"".join(x for _, x in big) == html[5].encode() and len(big) == 8
    assert chunks.where("not intact").count() == 0
    small = warc.read_archives(warc.write_archives(warc.chunk_rows(pages, min_bytes=1000), f"file://{tmp_path}/x"), payload=False)
    assert small.where("record_type = 'revisit'").count() == 0
    assert warc.read_archives(warc.write_archives(warc.chunk_rows(pages.limit(0)), f"file://{tmp_path}/y")).count() == 0


def test_empty_tables(empty):
    path = tokenizer("word_bpe_49k.json")
    assert quality_rules.judge(empty).count() == 0
    assert mixing.mix(empty)[0].count() == 0
    assert line_dedup.apply_bitmaps(empty, line_dedup.drop_bitmaps(empty)).count() == 0
    assert near_join.near_duplicates(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert packing.pack_documents(empty, path).count() == 0


def test_null_ids(spark):
    made = spark.createDataFrame([(None, "some words that are here and there " * 20, "en", "a"), (1, "some words that are here and there " * 20, "en", "a"), (None, None, None, None)], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(1))
    assert quality_rules.judge(made).count() == 3
    assert mixing.mix(made)[0].count() == 3
    assert line_dedup.apply_bitmaps(made, line_dedup.drop_bitmaps(made)).count() == 3
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in near_join.near_duplicates(made).collect()) == [("1", "1", 1), ("None", "1", 1), ("None", "None", 0)]
    assert sharding.shard(made, shards=2).count() == 3
    assert packing.pack_documents(made, tokenizer("word_bpe_49k.json")).count() >= 3
