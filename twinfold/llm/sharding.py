"""Sharding by a k-d tree over metadata, with splits at distributed weighted medians.

Equal texts form one group and stay together. A group's coordinates are its text's size, its smallest doc_id and a hash
of the text; its weight is its bytes. The root stands for all shards; each node is split along the dimension in which
its groups spread widest, at the weighted quantile that gives either side its share of the node's shards, until a leaf
is one shard of about the target bytes. All nodes of a level are split together: quantiles are found by histograms of
``BINS`` cells, refined until a cell's edge is within ``SLACK`` of the wanted weight or a cell holds one value, so that
the driver sees at most nodes x cells numbers. The tree is kept on the driver (it has fewer nodes than shards) and is
evaluated on a group as nested comparisons, so that no level is written. A group that alone weighs as much as a shard
gets one to itself first; there are fewer of them than shards.

Defined results: a null text has size 16 and no text, all null texts are one group; repeated rows are separate rows of
one group; an empty table gives an empty result; a group without any doc_id has coordinate 0 there; doc_ids may be any
64-bit numbers: where they span more than 2^62, their two or fewer lowest bits are left out of the coordinate, so that
differences cannot overflow; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, running_before

SHARDS, OVERHEAD, BINS, SLACK = 40, 16, 2048, 2e-4
DIMENSIONS = ("d_size", "d_id", "d_hash")


def groups(docs: DataFrame) -> DataFrame:
    """One row for each different text: its hashes, rows, weight and coordinates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), "text").alias("g1"),
        F.xxhash64(F.lit(7), F.col("text").isNull(), "text").alias("g2"),
    )
    return rows


@dataclass
class Node:
    """A box of the tree: its first shard, how many shards it stands for and, once split, at which value of which dimension."""

    first: int
    shards: int
    dimension: str = ""
    at: int = 0
    below: Node | None = None
    above: Node | None = None

    def place(self) -> Column:
        """The first shard of the leaf that a group is in."""
        if self.below is None or self.above is None:
            return F.lit(self.first)
        return F.when(F.col(self.dimension) <= self.at, self.below.place()).otherwise(self.above.place())


def _pick(nodes: dict[int, Node], of) -> Column:
    """of(node) for the node that a row is in."""
    return F.element_at(F.create_map(*(x for n in sorted(nodes) for x in (F.lit(n), of(n)))), F.col("node"))


def _split_points(atoms: DataFrame, nodes: dict[int, Node], goal: dict[int, float], low: dict[int, int], high: dict[int, int], slack: float) -> dict[int, int]:
    """For each node, the largest coordinate that goes left: the weighted quantile, found by narrowing histograms.

    Values before ``low`` weigh ``below``; cells are ``step`` wide, and the one that the goal falls into is looked at
    again, unless one of its edges is near enough to the goal.
    """
    low, high, below, cuts = dict(low), dict(high), dict.fromkeys(nodes, 0), {}
    while live := {n: node for n, node in nodes.items() if n not in cuts}:
        step = {n: max(1, -(-(high[n] - low[n] + 1) // BINS)) for n in live}
        bound = lambda of: _pick(live, lambda n: F.lit(of[n]).cast("long"))  # noqa: B023, E731
        valued = atoms.where(F.col("node").isin(sorted(live))).withColumn("_v", _pick(live, lambda n: F.col(live[n].dimension)))  # noqa: B023
        inside = valued.where((F.col("_v") >= bound(low)) & (F.col("_v") <= bound(high))).withColumn("_from", F.col("_v") - bound(low)).withColumn("_step", bound(step))
        found: dict[int, list[tuple[int, int]]] = {n: [] for n in live}
        for n, c, weight in inside.groupBy("node", F.expr("_from div _step").alias("cell")).agg(F.sum("weight").alias("weight")).collect():
            found[n].append((c, weight))
        for n in live:
            total, cells = below[n], sorted(found[n])
            for i, (c, weight) in enumerate(cells):
                if total + weight >= goal[n] or i == len(cells) - 1:
                    break
                total += weight
            start, before, after = low[n] + c * step[n], abs(total - goal[n]), abs(total + weight - goal[n])
            if step[n] == 1 or min(before, after) <= slack * goal[n]:
                # All of the cell goes to the side that leaves the smaller error.
                cuts[n] = start + step[n] - 1 if after <= before else start - 1
            else:
                below[n], low[n], high[n] = total, start, min(high[n], start + step[n] - 1)
    return cuts


def _heavy(atoms: DataFrame, total: int, shards: int) -> dict[tuple[int, int], int]:
    """Shard of each group as heavy as a shard: taken out heaviest first, while each outweighs the others' share."""
    alone: dict[tuple[int, int], int] = {}
    left, over = total, shards
    for g1, g2, weight in atoms.where(F.col("weight") * shards >= total).orderBy(F.desc("weight"), "g1", "g2").limit(shards).select("g1", "g2", "weight").collect():
        if over > 1 and weight * over >= left:
            over -= 1
            left -= weight
            alone[(g1, g2)] = over
    return alone


def _grow(atoms: DataFrame, shards: int, slack: float) -> Node:
    """The tree over atoms (coordinates and weight)."""
    root, whole = Node(0, shards), {}
    level = {0: root}
    while level := {n: node for n, node in level.items() if node.shards > 1}:
        live = atoms.withColumn("node", root.place()).where(F.col("node").isin(sorted(level)))
        ends = [f(d).alias(f"{d}_{k}") for d in DIMENSIONS for k, f in (("min", F.min), ("max", F.max))]
        stats = {r["node"]: r for r in live.groupBy("node").agg(F.sum("weight").alias("w"), *ends).collect()}
        whole = whole or {d: max(1, r[f"{d}_max"] - r[f"{d}_min"]) for r in stats.values() for d in DIMENSIONS}
        level = {n: level[n] for n in sorted(stats)}  # a box without groups is left as it is
        for n, r in stats.items():
            level[n].dimension = max(DIMENSIONS, key=lambda d: (r[f"{d}_max"] - r[f"{d}_min"]) / whole[d])  # noqa: B023
        low, high = ({n: stats[n][f"{level[n].dimension}_{end}"] for n in level} for end in ("min", "max"))
        goal = {n: stats[n]["w"] * (node.shards // 2) / node.shards for n, node in level.items()}
        below = {}
        for n, at in _split_points(live, level, goal, low, high, slack).items():
            node, half = level[n], level[n].shards // 2
            node.at, node.below, node.above = at, Node(n, half), Node(n + half, node.shards - half)
            below |= {n: node.below, n + half: node.above}
        level = below
    return root


def shard(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, g1, g2 (hashes of the text), shard and slot of every row."""
    rows = cut(groups(docs))
    weights = F.sum("size").alias("weight"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("d_size"), F.coalesce(F.min("doc_id"), F.lit(0)).alias("d_id")
    atoms = cut(rows.groupBy("g1", "g2").agg(*weights).withColumn("d_hash", F.shiftright("g1", 24)))
    found = atoms.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w"), F.min("d_id").alias("low"), F.max("d_id").alias("high"), F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()
    if found["n"]:
        atoms = atoms.withColumn("d_id", F.shiftright("d_id", max(0, (found["high"] - found["low"]).bit_length() - 62)))
    alone = _heavy(atoms, found["w"], shards)
    home = F.lit(None).cast("int")
    for (g1, g2), at in alone.items():
        home = F.when((F.col("g1") == g1) & (F.col("g2") == g2), F.lit(at)).otherwise(home)
    tree = _grow(atoms.where(home.isNull()), shards - len(alone), slack)
    placed = rows.join(atoms.select("g1", "g2", F.coalesce(home, tree.place()).cast("int").alias("shard")), ["g1", "g2"], "inner")
    return running_before(placed, ["shard"], [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_crc32")], F.xxhash64("doc_id"), F.lit(1), found["n"], "slot")
