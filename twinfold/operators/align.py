"""Sentence alignment by length and anchors: a banded dynamic program for each book, books in parallel."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values that must be as they are for right results: moves (source, target, probability) in the order of ties.
MOVES = ((1, 1, 0.89), (1, 0, 0.005), (0, 1, 0.005), (2, 1, 0.045), (1, 2, 0.045), (2, 2, 0.011))
VARIANCE, BAND, EDGE, ANCHOR_BONUS, ANCHOR_CAP = 6.8, 100, 10, 1.5, 3


@dataclass
class Side:
    lengths: np.ndarray
    anchors: list[frozenset[str]]

    @classmethod
    def of(cls, texts: list[str]) -> Side:
        words = [re.findall(r"\w+", t) for t in texts]
        numbers = [re.findall(r"\d+", t) for t in texts]
        return cls(np.array([len(re.sub(r"\s+", "", t)) for t in texts], float), [frozenset([w for w in ws[1:] if w[0].isupper()] + ns) for ws, ns in zip(words, numbers)])


def _paired(side: Side, k: int) -> tuple[np.ndarray, list[frozenset[str]]]:
    """Lengths and anchors of the k segments that end at each index (index 0 is before the first)."""
    n = len(side.lengths)
    sums = np.concatenate([[0.0], np.cumsum(side.lengths)])
    lengths = np.full(n + 1, np.nan)
    lengths[k:] = sums[k:] - sums[: n + 1 - k]
    joined = [frozenset()] * k + [frozenset().union(*side.anchors[i - k : i]) for i in range(k, n + 1)]
    return lengths, joined


_erfc = np.frompyfunc(math.erfc, 1, 1)


def move_costs(source: Side, target: Side, low: np.ndarray, high: np.ndarray) -> list[list[np.ndarray]]:
    """For each row of the band and each move, the cost of the move that ends in each of the row's cells."""
    total = source.lengths.sum()
    ratio = target.lengths.sum() / total if len(source.lengths) and len(target.lengths) and total else 1.0
    s, t = {k: _paired(source, k) for k in (1, 2)}, {k: _paired(target, k) for k in (1, 2)}
    where: dict[int, dict[str, list[int]]] = {k: {} for k in (1, 2)}
    for k in (1, 2):
        for j, anchors in enumerate(t[k][1]):
            for a in anchors:
                where[k].setdefault(a, []).append(j)
    rows = []
    for i in range(len(low)):
        a, b, row = int(low[i]), int(high[i]), []
        for ds, dt, p in MOVES:
            cost = np.full(b - a + 1, -math.log(p))
            if ds and dt and i >= ds:
                ls = max(s[ds][0][i], 1.0)
                lt = t[dt][0][a : b + 1]
                delta = np.abs(lt - ls * ratio) / math.sqrt(ls * VARIANCE) / math.sqrt(2)
                known = ~np.isnan(delta)
                cost[known] -= np.log(np.maximum(1e-12, _erfc(delta[known]).astype(float)))
                shared = np.zeros(b - a + 1)
                for anchor in s[ds][1][i]:
                    for j in where[dt].get(anchor, ()):
                        if a <= j <= b:
                            shared[j - a] += 1
                cost -= ANCHOR_BONUS * np.minimum(ANCHOR_CAP, shared)
            row.append(cost)
        rows.append(row)
    return rows


def _run(source: Side, target: Side, width: float) -> tuple[list[tuple[int, int, float]], bool]:
    """Path as (end of source, end of target, cost of the move), and whether it runs along an edge of the band."""
    n, m = len(source.lengths), len(target.lengths)
    rows = np.arange(n + 1)
    if n and m:
        centre = rows * m / n
        low, high = np.maximum(0, np.ceil(centre - width)).astype(int), np.minimum(m, np.floor(centre + width)).astype(int)
    else:
        low, high = np.zeros(n + 1, int), np.full(n + 1, m)
    costs = move_costs(source, target, low, high)
    best: list[np.ndarray] = []
    back: list[np.ndarray] = []
    for i in range(n + 1):
        a, b = int(low[i]), int(high[i])
        here, step = np.full(b - a + 1, np.inf), np.full(b - a + 1, -1)
        if i == 0 and a == 0:
            here[0] = 0.0
        ranked = []
        for k, (ds, dt, _) in enumerate(MOVES):
            if not ds or i < ds:
                continue
            came = np.full(b - a + 1, np.inf)
            pa, pb = int(low[i - ds]), int(high[i - ds])
            x, y = max(a, pa + dt), min(b, pb + dt)
            if x <= y:
                came[x - a : y - a + 1] = best[i - ds][x - dt - pa : y - dt - pa + 1] + costs[i][k][x - a : y - a + 1]
            ranked.append((k, came))
        # Moves from rows above, in the order of ties; the move along the row ranks third and needs a scan.
        flat = next(k for k, (ds, _, _) in enumerate(MOVES) if not ds)
        for k, came in ranked:
            better = came < here
            here[better], step[better] = came[better], k
        price, cells, steps = costs[i][flat].tolist(), here.tolist(), step.tolist()
        for j in range(1, b - a + 1):
            along = cells[j - 1] + price[j]
            if along < cells[j] or (along == cells[j] and steps[j] > flat and along < math.inf):
                cells[j], steps[j] = along, flat
        best.append(np.array(cells))
        back.append(np.array(steps))
    path, near, i, j = [], False, n, m
    while True:
        a, b = int(low[i]), int(high[i])
        near |= (a > 0 and j - a < EDGE) or (b < m and b - j < EDGE)
        if not (i or j):
            return path[::-1], near
        k = int(back[i][j - a])
        path.append((i, j, float(costs[i][k][j - a])))
        i, j = i - MOVES[k][0], j - MOVES[k][1]


def align(source: list[str], target: list[str]) -> list[tuple[list[int], list[int], float]]:
    """Beads (source indices, target indices, confidence) that tile both sides in order."""
    s, t = Side.of(source), Side.of(target)
    path, near = _run(s, t, BAND)
    if near and len(source) != len(target):
        path, _ = _run(s, t, BAND + abs(len(target) - len(source)))
    beads, a, b = [], 0, 0
    for i, j, cost in path:
        beads.append((list(range(a, i)), list(range(b, j)), round(math.exp(-max(0.0, cost + math.log(MOVES[0][2])) / 4), 3)))
        a, b = i, j
    return beads


def aligned(segs: DataFrame) -> DataFrame:
    """project_id, side, pos, bead_pos, confidence for the included segments of every book (pos from 0 on each side)."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = {s: rows[rows["side"] == s].sort_values("pos") for s in ("source", "target")}
        out = []
        for k, (source, target, confidence) in enumerate(align(*(list(sides[s]["text"]) for s in ("source", "target")))):
            for side, indices in (("source", source), ("target", target)):
                out += [(key[0], side, int(sides[side]["pos"].iloc[x]), k, confidence) for x in indices]
        return pd.DataFrame(out, columns=["project_id", "side", "pos", "bead_pos", "confidence"])

    return segs.where("not excluded").select("project_id", "side", "pos", "text").groupBy("project_id").applyInPandas(one, "project_id long, side string, pos long, bead_pos long, confidence double")


def headings_open(segs: DataFrame) -> DataFrame:
    """segs (project_id, side, pos, kind, bead_pos) with each heading that ends a side of several segments moved to the
    next bead; decided on the beads as they were, the last bead of a book is left alone."""
    book, side = Window.partitionBy("project_id"), Window.partitionBy("project_id", "side", "bead_pos")
    marked = segs.withColumn("_n", F.count(F.lit(1)).over(side)).withColumn("_last", F.max("pos").over(side)).withColumn("_end", F.max("bead_pos").over(book))
    goes = (F.col("_n") >= 2) & (F.col("pos") == F.col("_last")) & (F.col("kind") == "heading") & (F.col("bead_pos") < F.col("_end"))
    return marked.withColumn("bead_pos", F.col("bead_pos") + goes.cast("long")).drop("_n", "_last", "_end")


def realigned(segs: DataFrame, runs: DataFrame) -> DataFrame:
    """The beads of a run (project_id, from_bead, to_bead) aligned anew: as ``aligned``, bead_pos from from_bead on; books
    whose beads come out as they were are left out."""
    inside = segs.join(runs, "project_id").where("bead_pos between from_bead and to_bead")
    fresh = aligned(inside.withColumn("excluded", F.lit(False))).join(runs.select("project_id", "from_bead"), "project_id").withColumn("bead_pos", F.col("bead_pos") + F.col("from_bead")).drop("from_bead")
    old = inside.select("project_id", "side", "pos", F.col("bead_pos").alias("_old"))
    number = F.dense_rank().over(Window.partitionBy("project_id").orderBy("_old"))
    new_number = F.dense_rank().over(Window.partitionBy("project_id").orderBy("bead_pos"))
    changed = fresh.join(old, ["project_id", "side", "pos"]).withColumn("_a", number).withColumn("_b", new_number).where("_a <> _b").select("project_id").distinct()
    return fresh.join(changed, "project_id", "left_semi")


def built(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segs, beads) of new books from their blocks (project_id, side, block_no, kind, text, excluded): sentences, an alignment
    of the included ones by length, headings at the head of their beads; nothing is reviewed."""
    cut = blocks.select("project_id", "side", F.col("block_no").alias("block_pos"), "kind", "excluded", F.posexplode(T.sentences(F.col("text"))).alias("seg_no", "text"))
    order = Window.partitionBy("project_id", "side", "excluded").orderBy("block_pos", "seg_no")
    segs = cut.withColumn("pos", F.when(~F.col("excluded"), F.row_number().over(order).cast("long") - 1))
    placed = aligned(segs)
    opened = headings_open(placed.join(segs.select("project_id", "side", "pos", "kind"), ["project_id", "side", "pos"]))
    beads = placed.groupBy("project_id", "bead_pos").agg(F.first("confidence").alias("confidence"), F.lit("length").alias("method"), F.lit(0).alias("review_level"))
    kept = beads.join(opened.select("project_id", "bead_pos"), ["project_id", "bead_pos"], "left_semi")
    with_beads = segs.join(opened.select("project_id", "side", "pos", "bead_pos"), ["project_id", "side", "pos"], "left")
    return with_beads.withColumn("original_text", F.col("text")), kept
