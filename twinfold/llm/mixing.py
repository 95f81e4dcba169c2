"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions alone.

The target of each source comes from its weight; no target exceeds ``most`` times the source's size, and what is cut
off is shared out again by weight (water-filling). A source's documents, in a seeded order, are one stream of words cut
into equal blocks. The whole mix is a number of blocks; sources win them by the highest quotients target / (2k + 1).
Since the method is house-monotone, the seats within growing houses give each shard an integer quota for each source.

The quotas decide the blocks. A source's seats, counted over the shards, first run through all its blocks, as often as
they suffice for a whole pass; a shard gets the stretch of the pass that its seats fall on. What is left is chosen
shard by shard: the blocks are divided among the shards in proportion to their quotas, and each takes its quota from its
own part, as a run that starts at a seeded block and wraps around. So a document's share is its overlap with a few
intervals (at most ``most`` + 3 for each shard, less those that miss its bucket), and no block is ever listed.

A hot source is never gathered: running sums go through hashed buckets (see ``running_before``), and what is counted
by source is pre-aggregated. Sources themselves may be many: their ranks are found by sorts over all tasks.

Defined results: a null text has size 0 and is never taken; sources sort by code point and null comes last; every row
is a document of its own, also where doc_ids repeat or are null; an empty table gives an empty result; other columns
are ignored unless they are named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, running_before, words

#: Words of a block; shards that get quotas; how often a source may be repeated; seed of the orders.
BLOCK, SHARDS, MOST, SEED = 32, 16, 3, 20


def seeded(doc_id: Column, seed: int = SEED) -> Column:
    """60 bits of a hash of seed and doc_id that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def div(a: Column, b: Column) -> Column:
    """Whole quotient of numbers that are not negative."""
    return F.call_function("div", a, b)


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, docs, weight and target of every source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = numbered(totals, [F.col("source").asc_nulls_last()], "_n")
    weighed = cut(ranked.withColumn("weight", ((F.col("_n") - 1) % 3 + 1).cast("long")).withColumn("cap", most * F.col("source_size")).drop("_n"))
    # Sources whose cap is below their share are full; the rest share what these leave, which may fill up more of them.
    every = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.sum("weight").alias("weight")).first()
    level, full = 0.0, -1
    while every["size"]:
        below = F.col("cap") <= F.lit(level) * F.col("weight")
        now = weighed.agg(F.count_if(below).alias("n"), F.coalesce(F.sum(F.when(below, F.col("cap"))), F.lit(0)).alias("cap"), F.coalesce(F.sum(F.when(below, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if now["n"] == full:
            break
        full, level = now["n"], (every["size"] - now["cap"]) / (every["weight"] - now["weight"])
    share = F.lit(level) * F.col("weight")
    return weighed.withColumn("target", F.when(F.col("cap") <= share, F.col("cap").cast("double")).otherwise(share)).drop("cap")


def seats(sources: DataFrame, houses: list[int]) -> DataFrame:
    """Seats of every source in every house (source, house, seats): Sainte-Laguë without listing all quotients.

    Seats are target / divisor, rounded, for a divisor between those of a house with S more and with S fewer seats
    (S sources); only the quotients between the two roundings, some 3 S a house, compete for what is left.
    """
    every = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("target"), F.count(F.lit(1)).alias("n")).first()
    t, n, sure = max(every["target"], 1e-9), every["n"], F.col("target") > 0
    grid = sources.select("source", "target", F.explode(F.array(*(F.lit(h).cast("long") for h in sorted(set(houses))))).alias("house"))
    near = cut(grid.select(
        "source", "target", "house",
        F.greatest(F.floor(F.col("target") * (F.col("house") - n) / t + 0.5) - 1, F.lit(0)).cast("long").alias("least"),
        F.ceil(F.col("target") * (F.col("house") + n) / t + 0.5).cast("long").alias("greatest"),
    ))
    taken = near.groupBy("house").agg(F.sum("least").alias("taken"))  # a row a house
    tried = near.where(sure).select("source", "house", F.explode(F.sequence("least", "greatest")).alias("k"), "target").withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    best = numbered(tried, [F.col("quotient").desc(), F.col("source").asc_nulls_last(), F.col("k")], "_n", "house")
    won = best.join(F.broadcast(taken), "house").where(F.col("_n") <= F.col("house") - F.col("taken")).groupBy("source", "house").agg(F.count(F.lit(1)).alias("more"))
    a, b = near.alias("a"), won.alias("b")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.house") == F.col("b.house"))
    return a.join(b, same, "left").select("a.source", "a.house", (F.col("a.least") + F.coalesce("b.more", F.lit(0))).alias("seats"))


def runs(shards: int, block: int, most: int, seed: int) -> Column:
    """The runs of a source's words that its shards take, as an array of (shard, from, to).

    Reads source, blocks and ends: the seats of the source within the houses before and after each shard.
    """
    blocks, ends = F.col("blocks"), F.col("ends")
    seats_in_all = ends[shards]
    passes = div(seats_in_all, blocks)
    rest = seats_in_all - passes * blocks

    def run(shard: Column, start: Column, end: Column) -> Column:
        return F.struct(shard.cast("int").alias("shard"), (start * block).cast("long").alias("from"), (end * block).cast("long").alias("to"))

    def of(k: Column) -> Column:
        # Seats k won in whole passes, then in the last one, which takes some of the blocks.
        whole = [F.struct((F.greatest(ends[k], p * blocks) - p * blocks).alias("a"), (F.least(ends[k + 1], (p + 1) * blocks, passes * blocks) - p * blocks).alias("b")) for p in range(most)]
        last = [F.least(F.greatest(c - passes * blocks, F.lit(0)), rest) for c in (ends[k], ends[k + 1])]
        wide = lambda x: x.cast("decimal(19,0)")
        low, high = (div(wide(blocks) * wide(c), wide(F.greatest(rest, F.lit(1)))) for c in last)
        start = low + F.pmod(seeded(F.concat(F.coalesce("source", F.lit("null")), F.lit(":"), k.cast("string")), seed), F.greatest(high - low, F.lit(1)))
        over = start + last[1] - last[0]
        return F.array(*(run(k, w["a"], w["b"]) for w in whole), run(k, start, F.least(over, high)), run(k, low, low + F.greatest(over - high, F.lit(0))))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), of)), lambda r: r["to"] > r["from"])


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, most: int = MOST, seed: int = SEED, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, quotas): doc_id, source, size, source_size, target, taken, parts, copies and carry of every row; source, shard, blocks.

    taken counts the words that the mix takes from a document, repeats included; parts says how many of them each
    shard takes, run by run; copies is how many runs hold the document's middle word, which is how often a mix of whole
    documents takes it.
    """
    size = F.size(words(F.col("text"))).cast("long").alias("size")
    rows = docs.select("doc_id", "source", size, seeded(docs["doc_id"], seed).alias("order"), *((F.struct(*carry).alias("carried"),) if carry else ()))
    sizes = cut(rows.drop("carried"))
    found = sizes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    sources = cut(targets(sizes, most))
    total = max(1, round(found["size"] / block))
    houses = [i * total // shards for i in range(shards + 1)]
    by_house = seats(sources, houses).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("house", "seats"))).alias("won")).withColumnRenamed("source", "_source")  # a map of shards + 1 entries
    blocks = F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long").alias("blocks")
    known = sources.join(by_house, sources["source"].eqNullSafe(by_house["_source"])).select("source", "source_size", "target", blocks, "won")
    ends = F.array(*(F.least(F.element_at("won", F.lit(h).cast("long")), most * F.col("blocks")) for h in houses))
    plan = cut(known.select("source", "source_size", "target", "blocks", ends.alias("ends")))
    quotas = plan.select("source", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "ends").select("source", "shard", (F.col("ends")[F.col("shard") + 1] - F.col("ends")[F.col("shard")]).alias("blocks"))
    plan = plan.select("source", "source_size", "target", runs(shards, block, most, seed).alias("runs"))
    met = lambda start, end: {"runs": F.filter("runs", lambda r: (r["from"] < end) & (r["to"] > start))}
    placed = running_before(rows if carry else sizes, ["source"], [F.col("order"), F.col("doc_id"), F.col("size")], F.col("order"), F.col("size"), found["rows"], "start", attach=plan, narrow=met)
    middle, end = F.col("start") + F.floor(F.col("size") / 2), F.col("start") + F.col("size")
    overlap = lambda r: F.struct(r["shard"].alias("shard"), (F.least(r["to"], end) - F.greatest(r["from"], F.col("start"))).alias("taken"))
    parts = F.filter(F.transform("runs", overlap), lambda p: p["taken"] > 0)
    copies = F.when(F.col("size") > 0, F.size(F.filter("runs", lambda r: (r["from"] <= middle) & (middle < r["to"])))).otherwise(0)
    mixed = placed.withColumn("parts", parts).withColumn("copies", copies)
    taken = F.reduce("parts", F.lit(0).cast("long"), lambda n, p: n + p["taken"]).alias("taken")
    return mixed.select("doc_id", "source", "size", "source_size", "target", taken, "parts", "copies", *(F.col(f"carried.{c}") for c in carry)), quotas
