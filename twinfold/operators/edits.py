"""Corrections of the alignment as functions of state: each takes a table of commands, one a book at most, and returns
the new rows. Refused commands change nothing and are returned with their reason by ``refusals``.

segs: project_id, side, block_pos, seg_no, text, original_text, excluded, bead_pos. beads: project_id, bead_pos (order),
confidence, method, review_level. New beads take positions halfway to the next bead, so that any number of commands can
follow one another; ``whole_positions`` makes them whole again. Each function takes the commands of many books at once;
commands that see one another's results are given to it in turn.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

GAP = 1024
METHODS = ("anchor", "length", "embedding", "llm", "manual")


def moved(segs: DataFrame, beads: DataFrame, commands: DataFrame, forward: bool) -> DataFrame:
    """segs after moving, in each commanded bead (project_id, bead_pos, side), the first segment of the side to the bead
    before, or with forward the last one to the bead after; a bead at the book's edge keeps its segment."""
    book = Window.partitionBy("project_id").orderBy("bead_pos")
    near = beads.select("project_id", "bead_pos", (F.lead if forward else F.lag)("bead_pos").over(book).alias("_to"))
    wanted = commands.select("project_id", "bead_pos", "side").join(near, ["project_id", "bead_pos"]).where("_to is not null")
    order = Window.partitionBy("project_id", "bead_pos", "side").orderBy(*((F.desc("block_pos"), F.desc("seg_no")) if forward else ("block_pos", "seg_no")))
    ranked = segs.withColumn("_n", F.row_number().over(order)).join(wanted, ["project_id", "bead_pos", "side"], "left")
    return ranked.withColumn("bead_pos", F.when((F.col("_n") == 1) & F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("bead_pos"))).drop("_n", "_to").select(*segs.columns)


def after_move(beads: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """beads after segments moved: beads that gave or took are manual at full confidence, empty ones are gone."""
    keys = ["project_id", "side", "block_pos", "seg_no"]
    was = before.where("bead_pos is not null").select(*keys, F.col("bead_pos").alias("_was"))
    changed = after.join(was, keys).where("bead_pos <> _was")
    hit = changed.select("project_id", F.explode(F.array("bead_pos", "_was")).alias("bead_pos")).distinct().withColumn("_hit", F.lit(True))
    kept = beads.join(after.where("bead_pos is not null").select("project_id", "bead_pos"), ["project_id", "bead_pos"], "left_semi")
    return manual(kept.join(hit, ["project_id", "bead_pos"], "left"), F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit").select(*beads.columns)


def manual(beads: DataFrame, where: Column) -> DataFrame:
    return beads.withColumn("method", F.when(where, "manual").otherwise(F.col("method"))).withColumn("confidence", F.when(where, 1.0).otherwise(F.col("confidence")))


def merged(segs: DataFrame, beads: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segs, beads) after merging each commanded bead (project_id, bead_pos) with the next; the lower review counts."""
    book = Window.partitionBy("project_id").orderBy("bead_pos")
    wanted = commands.select("project_id", "bead_pos", F.lit(True).alias("_first"))
    marked = beads.join(wanted, ["project_id", "bead_pos"], "left")
    first = F.coalesce(F.col("_first"), F.lit(False)) & F.lead("bead_pos").over(book).isNotNull()
    marked = marked.withColumn("_joins", first)
    marked = marked.withColumn("_into", F.when(F.lag("_joins").over(book), F.lag("bead_pos").over(book))).withColumn("_least", F.least("review_level", F.lead("review_level").over(book)))
    new_beads = manual(marked.where("_into is null").withColumn("review_level", F.when(F.col("_joins"), F.col("_least")).otherwise(F.col("review_level"))), F.col("_joins")).select(*beads.columns)
    into = marked.where("_into is not null").select("project_id", "bead_pos", "_into")
    new_segs = segs.join(into, ["project_id", "bead_pos"], "left").withColumn("bead_pos", F.coalesce("_into", "bead_pos")).select(*segs.columns)
    return new_segs, new_beads


def next_position(beads: DataFrame) -> DataFrame:
    """project_id, bead_pos (double) and _next: the book's next bead, or one position further where there is none."""
    at = F.col("bead_pos").cast("double")
    book = Window.partitionBy("project_id").orderBy("bead_pos")
    return beads.select("project_id", at.alias("bead_pos")).withColumn("_next", F.coalesce(F.lead("bead_pos").over(book), F.col("bead_pos") + 1))


def bead_split(segs: DataFrame, beads: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segs, beads) after splitting each commanded bead (project_id, bead_pos, source_at, target_at): segments from the
    given ordinal of their side in the bead on (null: none) go to a new bead halfway to the next one."""
    order = Window.partitionBy("project_id", "bead_pos", "side").orderBy("block_pos", "seg_no")
    at = segs.withColumn("bead_pos", F.col("bead_pos").cast("double"))
    wanted = commands.withColumn("bead_pos", F.col("bead_pos").cast("double")).join(next_position(beads), ["project_id", "bead_pos"])
    placed = at.withColumn("_n", F.row_number().over(order)).join(wanted, ["project_id", "bead_pos"], "left")
    goes = F.coalesce(F.col("_n") >= F.when(F.col("side") == "source", F.col("source_at")).otherwise(F.col("target_at")), F.lit(False))
    bead = Window.partitionBy("project_id", "bead_pos")
    placed = placed.withColumn("_goes", goes).withColumn("_able", F.bool_or("_goes").over(bead) & F.bool_or(~F.col("_goes")).over(bead))
    placed = placed.withColumn("_to", F.when(F.col("_goes") & F.col("_able") & F.col("bead_pos").isNotNull(), (F.col("bead_pos") + F.col("_next")) / 2))
    new_segs = placed.withColumn("bead_pos", F.coalesce("_to", "bead_pos")).select(*segs.columns)
    cut = placed.where("_to is not null").select("project_id", "bead_pos", "_to").distinct()
    old = manual(beads.withColumn("bead_pos", F.col("bead_pos").cast("double")).join(cut, ["project_id", "bead_pos"], "left"), F.col("_to").isNotNull())
    return new_segs, old.unionByName(old.where("_to is not null").withColumn("bead_pos", F.col("_to"))).select(*beads.columns)


def whole_positions(segs: DataFrame, beads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segs, beads) with bead_pos the bead's place in its book, from 0."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("bead_pos")).cast("long") - 1
    numbered = beads.withColumn("_place", place)
    places = numbered.select("project_id", "bead_pos", "_place")
    new_segs = segs.join(places, ["project_id", "bead_pos"], "left").withColumn("bead_pos", F.col("_place")).select(*segs.columns)
    return new_segs, numbered.withColumn("bead_pos", F.col("_place")).select(*beads.columns)


def reviewed(beads: DataFrame, commands: DataFrame) -> DataFrame:
    """beads after marking (mark true) or clearing commanded beads (project_id, bead_pos, rank, mark) at a level."""
    joined = beads.join(commands.select("project_id", "bead_pos", "rank", "mark"), ["project_id", "bead_pos"], "left")
    level = F.when(F.col("mark"), F.greatest("review_level", "rank")).when(~F.col("mark"), F.least(F.col("review_level"), F.col("rank") - 1)).otherwise(F.col("review_level"))
    return joined.withColumn("review_level", level.cast("int")).select(*beads.columns)


def text_edited(segs: DataFrame, commands: DataFrame) -> DataFrame:
    """segs with new texts (project_id, side, block_pos, seg_no, new_text); blank ones are refused, originals stay."""
    keys = ["project_id", "side", "block_pos", "seg_no"]
    joined = segs.join(commands.select(*keys, "new_text"), keys, "left")
    able = F.col("new_text").isNotNull() & (T.strip(F.col("new_text")) != "")
    return joined.withColumn("text", F.when(able, F.col("new_text")).otherwise(F.col("text"))).select(*segs.columns)


def originals_restored(segs: DataFrame, commands: DataFrame) -> DataFrame:
    """segs with commanded ones back at their original text, unless that is blank."""
    keys = ["project_id", "side", "block_pos", "seg_no"]
    joined = segs.join(commands.select(*keys, F.lit(True).alias("_back")), keys, "left")
    able = F.coalesce(F.col("_back"), F.lit(False)) & (T.strip(F.col("original_text")) != "")
    return joined.withColumn("text", F.when(able, F.col("original_text")).otherwise(F.col("text"))).select(*segs.columns)


def original_offset(text: str, original: str, at: int) -> int:
    """Where offset ``at`` of an edited text lies in its original, by matching blocks of the two."""
    if text == original:
        return at
    for a, b, n in difflib.SequenceMatcher(None, text, original, autojunk=False).get_matching_blocks():
        if at <= a:
            return b
        if at < a + n:
            return b + at - a
    return len(original)


def segment_split(segs: DataFrame, commands: DataFrame) -> DataFrame:
    """segs with commanded ones (keys, at) cut in two at a character offset; both parts keep the bead. A cut that would
    leave a blank part is refused. New seg_no are positions in the block."""
    keys = ["project_id", "side", "block_pos", "seg_no"]
    joined = segs.join(commands.select(*keys, "at"), keys, "left")
    able = F.col("at").isNotNull() & (T.strip(F.substring(F.col("text"), F.lit(1), F.col("at").cast("int"))) != "") & (T.strip(F.substring(F.col("text"), F.col("at").cast("int") + 1, F.lit(1 << 30))) != "")
    plain = joined.where(~F.coalesce(able, F.lit(False))).withColumn("_part", F.lit(0)).drop("at")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                at = int(row.pop("at"))
                to = original_offset(row["text"], row["original_text"], at)
                for k, (t, o) in enumerate(((row["text"][:at], row["original_text"][:to]), (row["text"][at:], row["original_text"][to:]))):
                    out.append(row | {"text": t.strip(), "original_text": o.strip(), "_part": k})
            yield pd.DataFrame(out, columns=[*rows.columns.drop("at"), "_part"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema if f.name != "_part") + ", _part int"
    split = joined.where(able).mapInPandas(cut, schema)
    order = Window.partitionBy("project_id", "side", "block_pos").orderBy("seg_no", "_part")
    return plain.unionByName(split).withColumn("seg_no", F.row_number().over(order) - 1).select(*segs.columns)


def segments_joined(segs: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segs, merges) after joining commanded segments with the next of their block, one space between. merges has the
    bead ranges (project_id, from_bead, to_bead) that become one bead."""
    keys = ["project_id", "side", "block_pos", "seg_no"]
    block = Window.partitionBy("project_id", "side", "block_pos").orderBy("seg_no")
    joined = segs.join(commands.select(*keys, F.lit(True).alias("_c")), keys, "left")
    joined = joined.withColumn("_joins", F.coalesce(F.col("_c"), F.lit(False)) & F.lead("seg_no").over(block).isNotNull())
    joined = joined.withColumn("_gone", F.coalesce(F.lag("_joins").over(block), F.lit(False))).withColumn("_next_bead", F.lead("bead_pos").over(block))
    for c in ("text", "original_text"):
        joined = joined.withColumn(f"_{c}", F.concat_ws(" ", F.col(c), F.lead(c).over(block)))
    merges = joined.where("_joins and bead_pos <> _next_bead").select("project_id", F.col("bead_pos").alias("from_bead"), F.col("_next_bead").alias("to_bead"))
    kept = joined.where("not _gone")
    for c in ("text", "original_text"):
        kept = kept.withColumn(c, F.when(F.col("_joins"), F.col(f"_{c}")).otherwise(F.col(c)))
    return kept.select(*segs.columns), merges


def range_merged(segs: DataFrame, beads: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segs, beads) with every bead of a range (project_id, from_bead, to_bead) made one, the first of it."""
    into = beads.select("project_id", "bead_pos").join(merges, "project_id").where("bead_pos > from_bead and bead_pos <= to_bead").select("project_id", "bead_pos", F.col("from_bead").alias("_into"))
    new_segs = segs.join(into, ["project_id", "bead_pos"], "left").withColumn("bead_pos", F.coalesce("_into", "bead_pos")).select(*segs.columns)
    grouped = beads.join(into, ["project_id", "bead_pos"], "left").withColumn("_to", F.coalesce("_into", "bead_pos"))
    whole = Window.partitionBy("project_id", "_to")
    grouped = grouped.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("review_level", F.min("review_level").over(whole))
    return new_segs, manual(grouped.where("_into is null"), F.col("_n") > 1).select(*beads.columns)


def blocks_excluded(segs: DataFrame, beads: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segs, beads) without the commanded blocks (project_id, side, block_pos) in the alignment; emptied beads go, the
    others keep their method, confidence and review."""
    wanted = blocks.select("project_id", "side", "block_pos", F.lit(True).alias("_out"))
    out = F.coalesce(F.col("_out"), F.lit(False))
    new_segs = segs.join(wanted, ["project_id", "side", "block_pos"], "left").withColumn("excluded", F.col("excluded") | out).withColumn("bead_pos", F.when(~out, F.col("bead_pos"))).select(*segs.columns)
    return new_segs, beads.join(new_segs.where("bead_pos is not null").select("project_id", "bead_pos"), ["project_id", "bead_pos"], "left_semi")


def blocks_included(segs: DataFrame, beads: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segs, beads) with the commanded excluded blocks back: into the bead that the segments before and after them on
    their side share, else into a new unreviewed bead after the one before. Neighbouring commanded blocks are taken in
    document order, each seeing the one before: those of one gap share its bead where both ends do, and otherwise each
    gets a bead of its own, in order. New beads divide the way to the book's next bead evenly."""
    wanted = blocks.select("project_id", "side", "block_pos", F.lit(True).alias("_in"))
    joined = segs.withColumn("bead_pos", F.col("bead_pos").cast("double")).join(wanted, ["project_id", "side", "block_pos"], "left").withColumn("_in", F.coalesce(F.col("_in"), F.lit(False)) & F.col("excluded"))
    order = Window.partitionBy("project_id", "side").orderBy("block_pos", "seg_no")
    before = F.last("bead_pos", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("project_id", "side").orderBy(F.desc("block_pos"), F.desc("seg_no"))
    after = F.last("bead_pos", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    joined = joined.withColumn("_before", before).withColumn("_after", after)
    own = joined.where("_in").select("project_id", "side", "block_pos", "_before", "_after").distinct()
    shares = F.coalesce(F.col("_before") == F.col("_after"), F.lit(False))
    # A gap at the book's beginning ends at its first bead and begins one position earlier.
    firsts = beads.groupBy("project_id").agg(F.min(F.col("bead_pos").cast("double")).alias("_first"))
    ends = next_position(beads).withColumnRenamed("bead_pos", "_before")
    fresh = own.where(~shares).join(ends, ["project_id", "_before"], "left").join(firsts, "project_id", "left")
    fresh = fresh.withColumn("_from", F.coalesce("_before", F.col("_first") - 1, F.lit(-1.0))).withColumn("_next", F.coalesce("_next", "_first", F.lit(0.0)))
    gap = Window.partitionBy("project_id", "_from")
    step = F.row_number().over(gap.orderBy("side", "block_pos")) / (F.count(F.lit(1)).over(gap) + 1)
    fresh = fresh.withColumn("_bead", F.col("_from") + (F.col("_next") - F.col("_from")) * step)
    placed = own.where(shares).withColumn("_bead", F.col("_before")).select("project_id", "side", "block_pos", "_bead").unionByName(fresh.select("project_id", "side", "block_pos", "_bead"))
    new_segs = joined.drop("_before", "_after").join(placed, ["project_id", "side", "block_pos"], "left")
    new_segs = new_segs.withColumn("excluded", F.col("excluded") & ~F.col("_in")).withColumn("bead_pos", F.when(F.col("_in"), F.col("_bead")).otherwise(F.col("bead_pos"))).select(*segs.columns)
    new = fresh.select("project_id", F.col("_bead").alias("bead_pos"), F.lit(0.0).alias("confidence"), F.lit("manual").alias("method"), F.lit(0).alias("review_level"))
    return new_segs, beads.withColumn("bead_pos", F.col("bead_pos").cast("double")).select("project_id", "bead_pos", "confidence", "method", "review_level").unionByName(new)


def range_blocks(segs: DataFrame, commands: DataFrame, exclude: bool) -> DataFrame:
    """Blocks (project_id, side, block_pos) from the book's start up to the block of the bead's last segment on the side
    (to = start), or from that of its first to the end (to = end); commands: project_id, bead_pos, side, to. An include
    leaves layout kinds out."""
    bounds = segs.join(commands, ["project_id", "bead_pos", "side"]).groupBy("project_id", "side", "to").agg(F.min("block_pos").alias("_a"), F.max("block_pos").alias("_b"))
    blocks = segs.select("project_id", "side", "block_pos", "kind", "excluded").distinct().join(bounds, ["project_id", "side"])
    inside = F.when(F.col("to") == "start", F.col("block_pos") <= F.col("_b")).otherwise(F.col("block_pos") >= F.col("_a"))
    found = blocks.where(inside & (F.col("excluded") != F.lit(exclude)))
    return (found if exclude else found.where(~F.col("kind").isin(*T.LAYOUT_KINDS))).select("project_id", "side", "block_pos")


def refusals_of_run(old: DataFrame, new: DataFrame) -> DataFrame:
    """Why a run of new beads can't replace old ones (project_id, reason). Both: project_id, side, seg_id, at (order), and
    new also confidence and method: it must cover the same segments in the same order, with known methods and
    confidences from 0 to 1."""
    line = lambda x, name: x.groupBy("project_id", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "seg_id"))), lambda s: s["seg_id"]).alias(name))
    differ = line(old, "a").join(line(new, "b"), ["project_id", "side"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("project_id", F.concat(F.lit("other segments: "), "side").alias("reason"))
    odd = new.where(~F.col("method").isin(*METHODS)).select("project_id", F.lit("unknown method").alias("reason"))
    out = new.where("confidence < 0 or confidence > 1").select("project_id", F.lit("confidence out of range").alias("reason"))
    return differ.unionByName(odd).unionByName(out).distinct()


def renumber(rows: DataFrame, parents: list[str], order: str, gap: int = GAP) -> DataFrame:
    """rows with ord = gap x place among their siblings, in order."""
    return rows.withColumn("ord", (F.row_number().over(Window.partitionBy(*parents).orderBy(order)) - 1) * gap)


def midpoint(before: Column, after: Column, gap: int = GAP) -> Column:
    """A whole position between two neighbours (null: none); null where there is no room and siblings need new numbers."""
    middle = F.expr("0") + F.floor((before + after) / 2)
    return F.when(before.isNull() & after.isNull(), F.lit(0)).when(after.isNull(), before + gap).when(before.isNull(), F.when(after > 0, F.floor(after / 2))).otherwise(F.when(after - before > 1, middle)).cast("long")


def run_replaced(segs: DataFrame, beads: DataFrame, runs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segs, beads, refusals) after replacing a run of beads of a book (runs: project_id, first, last) by new unreviewed
    ones (new: project_id, side, block_pos, seg_no, n: order of the new bead, confidence, method). New beads divide the way
    from the bead before the run to the one after it evenly. A book whose new beads do not cover the run's segments, on
    either side in their order, with known methods and confidences from 0 to 1, is refused and stays as it was."""
    keys = ["project_id", "side", "block_pos", "seg_no"]
    inside = segs.join(runs, "project_id").where("bead_pos between first and last")
    place = lambda by: F.row_number().over(Window.partitionBy("project_id", "side").orderBy(*by, "block_pos", "seg_no")).alias("at")
    seg_id = F.struct("block_pos", "seg_no").alias("seg_id")
    refused = refusals_of_run(inside.select("project_id", "side", seg_id, place([])), new.select("project_id", "side", seg_id, place(["n"]), "method", "confidence"))
    able = new.join(refused.select("project_id").distinct(), "project_id", "left_anti")
    taken = runs.join(able.select("project_id").distinct(), "project_id", "left_semi")
    at = F.col("bead_pos").cast("double")
    every = beads.join(taken, "project_id")
    edges = every.groupBy("project_id", "first", "last").agg(F.max(F.when(F.col("bead_pos") < F.col("first"), at)).alias("_a"), F.min(F.when(F.col("bead_pos") > F.col("last"), at)).alias("_b"))
    edges = edges.select("project_id", F.coalesce("_a", F.col("first") - 1.0).alias("_a"), F.coalesce("_b", F.col("last") + 1.0).alias("_b"))
    book = Window.partitionBy("project_id")
    fresh = able.groupBy("project_id", "n").agg(F.first("confidence").alias("confidence"), F.first("method").alias("method"))
    fresh = fresh.withColumn("_k", F.row_number().over(book.orderBy("n")) / (F.count(F.lit(1)).over(book) + 1)).join(edges, "project_id").withColumn("bead_pos", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_k"))
    to = able.select(*keys, "n").join(fresh.select("project_id", "n", F.col("bead_pos").alias("_to")), ["project_id", "n"]).drop("n")
    new_segs = segs.join(to, keys, "left").withColumn("bead_pos", F.coalesce("_to", at)).select(*segs.columns)
    old = beads.join(taken, "project_id", "left").where("first is null or bead_pos < first or bead_pos > last").withColumn("bead_pos", at)
    names = ["project_id", "bead_pos", "confidence", "method", "review_level"]
    return new_segs, old.select(*names).unionByName(fresh.withColumn("review_level", F.lit(0)).select(*names)), refused


def places_after(siblings: DataFrame, commands: DataFrame, gap: int = GAP) -> tuple[DataFrame, DataFrame]:
    """(siblings, new) with whole places for many new rows at once. siblings: parent, ord; commands, one a parent: parent,
    after (ord of the row they follow, null: before all), n (how many). new: parent, k (from 0), ord. Where there is no room
    the siblings are spread a gap apart once, the later ones n gaps further on: siblings keeps old ord and its new one (to).
    """
    parent = Window.partitionBy("parent")
    rows = siblings.join(commands, "parent", "left").withColumn("_i", F.row_number().over(parent.orderBy("ord")).cast("long"))
    first = F.coalesce(F.col("ord") <= F.col("after"), F.lit(False))
    edges = rows.groupBy("parent").agg(F.max(F.when(first, F.col("ord"))).alias("_a"), F.min(F.when(~first, F.col("ord"))).alias("_b"), F.max(F.when(first, F.col("_i"))).alias("_before"))
    asked = commands.join(edges, "parent", "left")
    low = F.coalesce("_a", F.lit(-1).cast("long"))
    tight = F.col("_b").isNotNull() & (F.col("_b") - low < F.col("n") + 1)
    asked = asked.withColumn("_tight", tight)
    spread = rows.join(asked.where("_tight").select("parent", F.lit(True).alias("_tight")), "parent", "left")
    to = F.when(F.col("_tight"), (F.col("_i") + F.when(first, 0).otherwise(F.col("n"))) * gap).otherwise(F.col("ord"))
    each = asked.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    step = F.col("k") + 1
    place = (
        F.when(F.col("_tight"), (F.coalesce("_before", F.lit(0)) + step) * gap)
        .when(F.col("_b").isNotNull(), low + F.floor(step * (F.col("_b") - low) / (F.col("n") + 1)))
        .when(F.col("_a").isNotNull(), F.col("_a") + step * gap)
        .otherwise(F.col("k") * gap)
    )
    return spread.select("parent", "ord", to.cast("long").alias("to")), each.select("parent", F.col("k").cast("long").alias("k"), place.cast("long").alias("ord"))
