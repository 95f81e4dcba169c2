"""Scores of an alignment against a reference layer, on spans instead of characters.

A layer has project_id, side, pos (order on the side), text, bead (null: excluded) and, for levels, block. A segment
is the span [start, start + length) of its side's counted characters (white space and hyphens do not count); what two
layers share is an overlap of spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def spans(layer: DataFrame) -> DataFrame:
    """layer with start and length in counted characters, rows without any left out."""
    order = Window.partitionBy("project_id", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sized = layer.withColumn("length", F.length(T.scored_text(F.col("text"))).cast("long"))
    return sized.withColumn("start", F.coalesce(F.sum("length").over(order), F.lit(0))).where("length > 0").drop("text")


def same_text(a: DataFrame, b: DataFrame) -> DataFrame:
    """project_id, side, same: does the counted text of two layers agree? A side that one lacks does not."""
    whole = lambda x, name: x.groupBy("project_id", "side").agg(F.sha2(F.expr("listagg(t, '') WITHIN GROUP (ORDER BY pos)"), 256).alias(name))
    counted = lambda x: x.select("project_id", "side", "pos", T.scored_text(F.col("text")).alias("t"))
    return whole(counted(a), "a").join(whole(counted(b), "b"), ["project_id", "side"], "full").select("project_id", "side", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def overlaps(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """project_id, side, at, gold, predicted (beads, null: excluded), n: characters that two segments share, from ``at``
    on; where the predicted layer has a block column, also the block they are in.

    Cut points of both layers are merged on each side; between two neighbouring cuts each layer has one segment, found
    by carrying its last start forward. This is linear where an interval join would compare neighbours. The scores read
    the result several times, so it should be written first.
    """
    block = "block" in predicted.columns
    held = lambda x, k: F.struct("bead", F.col("block").cast("long").alias("block")) if block and k == "p" else F.struct("bead", F.lit(None).cast("long").alias("block"))
    mark = lambda x, k: x.select("project_id", "side", F.col("start").alias("at"), F.lit(k).alias("layer"), held(x, k).alias("seg"))
    ends = gold.groupBy("project_id", "side").agg(F.max(F.col("start") + F.col("length")).alias("at"))
    points = mark(gold, "g").unionByName(mark(predicted, "p")).groupBy("project_id", "side", "at").agg(F.max(F.when(F.col("layer") == "g", F.col("seg"))).alias("g"), F.max(F.when(F.col("layer") == "p", F.col("seg"))).alias("p"))
    points = points.unionByName(ends.withColumn("g", F.lit(None).cast("struct<bead:bigint,block:bigint>")).withColumn("p", F.lit(None).cast("struct<bead:bigint,block:bigint>")))
    order = Window.partitionBy("project_id", "side").orderBy("at")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    cut = points.select("project_id", "side", "at", (F.lead("at").over(order) - F.col("at")).alias("n"), F.last("g", ignorenulls=True).over(past).alias("g"), F.last("p", ignorenulls=True).over(past).alias("p"))
    return cut.where("n > 0").select("project_id", "side", "at", F.col("g.bead").alias("gold"), F.col("p.bead").alias("predicted"), "n", *([F.col("p.block").alias("block")] if block else []))


def ratio(hits: Column, total: Column, other: Column) -> Column:
    """hits / total; of two empty sets 1, of one 0."""
    return F.when(total > 0, F.try_divide(hits.cast("double"), total)).when(other == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def exclusion_score(shared: DataFrame, by_side: bool = False) -> DataFrame:
    """project_id (and side), precision, recall, f1 of excluded characters; without by_side both sides together."""
    keys = ["project_id", "side"] if by_side else ["project_id"]
    out = shared.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("gold").isNull() & F.col("predicted").isNull(), F.col("n"))), F.lit(0)).alias("both"),
        F.coalesce(F.sum(F.when(F.col("gold").isNull(), F.col("n"))), F.lit(0)).alias("g"),
        F.coalesce(F.sum(F.when(F.col("predicted").isNull(), F.col("n"))), F.lit(0)).alias("p"),
    )
    scored = out.withColumn("precision", ratio(F.col("both"), F.col("p"), F.col("g"))).withColumn("recall", ratio(F.col("both"), F.col("g"), F.col("p")))
    return scored.select(*keys, "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"))


def boundaries(shared: DataFrame, layer: str) -> DataFrame:
    """project_id, bead, s, t: common characters of either side up to and including each bead of a layer."""
    common = shared.where("gold is not null and predicted is not null")
    side = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("n"))), F.lit(0))
    sums = common.groupBy("project_id", F.col(layer).alias("bead")).agg(side("source").alias("_s"), side("target").alias("_t"))
    order = Window.partitionBy("project_id").orderBy("bead").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("project_id", "bead", F.sum("_s").over(order).alias("s"), F.sum("_t").over(order).alias("t"))


def inner_boundaries(ends: DataFrame) -> DataFrame:
    """The set of boundaries without the edges of the book."""
    book = Window.partitionBy("project_id")
    edged = ends.withColumn("_s", F.max("s").over(book)).withColumn("_t", F.max("t").over(book))
    return edged.where("not (s = 0 and t = 0) and not (s = _s and t = _t)").select("project_id", "s", "t").distinct()


def alignment_score(gold_set: DataFrame, predicted_set: DataFrame, books: DataFrame) -> DataFrame:
    """project_id, n_gold, n_predicted, hits, precision, recall, f1 of boundary sets."""
    both = gold_set.withColumn("g", F.lit(1)).join(predicted_set.withColumn("p", F.lit(1)), ["project_id", "s", "t"], "full")
    sums = both.groupBy("project_id").agg(F.count("g").alias("n_gold"), F.count("p").alias("n_predicted"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("hits"))
    out = books.select("project_id").join(sums, "project_id", "left").na.fill(0)
    out = out.withColumn("precision", ratio(F.col("hits"), F.col("n_predicted"), F.col("n_gold"))).withColumn("recall", ratio(F.col("hits"), F.col("n_gold"), F.col("n_predicted")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def coarse_places(gold_ends: DataFrame, gold_set: DataFrame, predicted_set: DataFrame) -> DataFrame:
    """project_id, s, t, place of every predicted boundary: gold, inside (one gold interval on both sides) or elsewhere.

    The enclosing interval is found as of (s, t): gold points and predicted ones are merged in order, and the last gold
    point before and the next after are carried to each predicted one.
    """
    book = Window.partitionBy("project_id")
    last = gold_ends.groupBy("project_id").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    first = last.select("project_id", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    points = gold_ends.select("project_id", "s", "t").unionByName(last).unionByName(first).distinct().withColumn("kind", F.lit(0))
    every = points.unionByName(predicted_set.withColumn("kind", F.lit(1)))
    order = book.orderBy("s", "t", "kind")
    point = F.when(F.col("kind") == 0, F.struct("s", "t"))
    before = F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = book.orderBy(F.desc("s"), F.desc("t"), F.desc("kind"))  # a frame that grows is one pass, one that shrinks is not
    after = F.last(point, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    placed = every.withColumn("_a", before).withColumn("_b", after).where("kind = 1")
    inside = F.col("s").between(F.col("_a.s"), F.col("_b.s")) & F.col("t").between(F.col("_a.t"), F.col("_b.t"))
    known = placed.join(gold_set.withColumn("_gold", F.lit(True)), ["project_id", "s", "t"], "left")
    return known.select("project_id", "s", "t", F.when(F.col("_gold"), "gold").when(F.coalesce(inside, F.lit(False)), "inside").otherwise("elsewhere").alias("place"))


def missed_runs(gold_ends: DataFrame, predicted_set: DataFrame) -> DataFrame:
    """project_id, first_bead, last_bead of runs of gold beads whose ends were not predicted (edges do not count)."""
    inner = inner_boundaries(gold_ends)
    missed = gold_ends.join(inner, ["project_id", "s", "t"], "left_semi").join(predicted_set, ["project_id", "s", "t"], "left_anti")
    island = F.col("bead") - F.row_number().over(Window.partitionBy("project_id").orderBy("bead"))
    return missed.withColumn("_run", island).groupBy("project_id", "_run").agg(F.min("bead").alias("first_bead"), F.max("bead").alias("last_bead")).drop("_run")


def fingerprint(text: Column) -> Column:
    """First twelve hex digits of a segment's SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, 12)


def transferable(units: DataFrame, gold_ends: DataFrame, own_ends: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Turns (project_id, unit_no, first_bead, last_bead) of a fresh book whose marks can be taken from gold.

    Both edges must be gold boundaries, the turn must hold common characters, and all gold beads in it be reviewed
    (reviewed: project_id, bead, reviewed). Unreviewed gold beads up to a boundary are a running sum, so that a turn
    needs two look-ups.
    """
    order = Window.partitionBy("project_id").orderBy("bead").rowsBetween(Window.unboundedPreceding, 0)
    flags = gold_ends.join(reviewed, ["project_id", "bead"]).withColumn("open", F.sum((~F.col("reviewed")).cast("long")).over(order))
    at = flags.groupBy("project_id", "s", "t").agg(F.max("open").alias("open"))
    zero = at.select("project_id").distinct().select("project_id", *(F.lit(0).cast("long").alias(c) for c in ("s", "t", "open")))
    at = at.where("not (s = 0 and t = 0)").unionByName(zero)
    # A unit's edge is the fresh book's last boundary up to its last bead.
    every = own_ends.select("project_id", "bead", F.struct("s", "t").alias("_end"), F.lit(None).cast("long").alias("unit_no"), F.lit(None).cast("long").alias("first_bead"))
    every = every.unionByName(units.select("project_id", F.col("last_bead").alias("bead"), F.lit(None).cast("struct<s:bigint,t:bigint>").alias("_end"), "unit_no", "first_bead"))
    past = Window.partitionBy("project_id").orderBy("bead", F.col("unit_no").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ends = every.withColumn("_at", F.last("_end", ignorenulls=True).over(past)).where("unit_no is not null")
    ends = ends.select("project_id", "unit_no", "first_bead", F.col("bead").alias("last_bead"), F.coalesce("_at.s", F.lit(0)).alias("s"), F.coalesce("_at.t", F.lit(0)).alias("t"))
    step = Window.partitionBy("project_id").orderBy("unit_no")
    edges = ends.withColumn("s0", F.coalesce(F.lag("s").over(step), F.lit(0))).withColumn("t0", F.coalesce(F.lag("t").over(step), F.lit(0))).where("s <> s0 or t <> t0")
    a = at.select("project_id", F.col("s").alias("s0"), F.col("t").alias("t0"), F.col("open").alias("open0"))
    return edges.join(a, ["project_id", "s0", "t0"]).join(at, ["project_id", "s", "t"]).where("open = open0").select("project_id", "unit_no", "first_bead", "last_bead")


def ligature_gaps(segs: DataFrame) -> DataFrame:
    """Spaces after an f-ligature or Th inside a segment: project_id, side, pos, at (characters before), real.

    original and corrected are two texts of a segment; a gap that the corrected text keeps is real, else it is a slip.
    Each text becomes one sign for each character that is no white space, saying whether a gap or a space follows it; the
    two are laid side by side, so the work grows with the text's length, whatever the number of gaps.
    """

    def signs(text: Column, followed: str) -> Column:
        plain = F.translate(F.regexp_replace(text, rf"(?U)(?! ){T.SPACE}", ""), "\u0001", "0")
        marked = F.regexp_replace(F.regexp_replace(plain, followed, "\u0001"), "[^\u0001 ]", "0")
        return F.split(F.translate(marked, "\u0001 ", "1"), "")

    gap, space = r"(?:f|(?<=f)[il]|(?<=T)h)(?= \p{L})", "[^ ](?= )"
    pairs = F.arrays_zip(signs(F.col("original"), gap).alias("gap"), signs(F.col("corrected"), space).alias("space"))
    found = F.transform(pairs, lambda z, i: F.when(z["gap"] == "1", F.struct((i + 1).cast("long").alias("at"), F.coalesce(z["space"] == "1", F.lit(False)).alias("real"))))
    return segs.select("project_id", "side", "pos", F.explode(F.filter(found, lambda g: g.isNotNull())).alias("g")).select("project_id", "side", "pos", "g.at", "g.real")


def block_openers(layer: DataFrame) -> DataFrame:
    """project_id, block, speech: does the first segment of a source block open dialogue?"""
    return layer.where("side = 'source'").groupBy("project_id", "block").agg(F.min_by(T.is_speech(F.col("text")), "pos").alias("speech"))


def levels_of(bounds: DataFrame, shared: DataFrame, openers: DataFrame) -> DataFrame:
    """Boundaries (project_id, s, t, any others) with turn and paragraph: does one count there? At turn level those do that
    are not inside a block of speech, at paragraph level those between two blocks; at sentence level all do. shared:
    ``overlaps`` with blocks.

    The common source characters are runs of one block; the run that ends at or holds a boundary's last character is
    found by carrying runs back over the boundaries, all in one order.
    """
    order = Window.partitionBy("project_id").orderBy("at")
    runs = shared.where("side = 'source' and gold is not null and predicted is not null").select("project_id", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), "block", F.lead("block").over(order).alias("next"))
    run = runs.select("project_id", "s", F.struct(F.col("s").alias("end"), "block", "next").alias("_run"))
    asked = bounds.select("project_id", "s", F.struct(*bounds.columns).alias("_bound"))
    back = Window.partitionBy("project_id").orderBy(F.desc("s"), F.col("_run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = run.unionByName(asked, allowMissingColumns=True).withColumn("_run", F.last("_run", ignorenulls=True).over(back)).where("_bound is not null")
    own = openers.select(F.col("project_id").alias("_book"), F.col("block").alias("_block"), "speech")
    placed = placed.withColumn("_in", F.col("_run.block")).join(own, (F.col("_in") == F.col("_block")) & (F.col("project_id") == F.col("_book")), "left")
    edge = F.col("_run").isNull() | (F.col("s") == 0) | ((F.col("s") == F.col("_run.end")) & F.col("_run.next").isNull())
    breaks = F.coalesce((F.col("s") == F.col("_run.end")) & (F.col("_run.next") != F.col("_run.block")), F.lit(False))
    return placed.select("_bound.*", (edge | breaks | ~F.coalesce("speech", F.lit(False))).alias("turn"), (~edge & breaks).alias("paragraph"))


def edits_by_span(gold: DataFrame, fresh: DataFrame) -> DataFrame:
    """What becomes of each corrected segment of a reference layer (project_id, side, pos, original, corrected) on a fresh
    book (project_id, side, pos, text, original): project_id, side, pos, at (the fresh segment of the very same counted
    characters, null: none), corrected, outcome.

    Corrections of spacing alone are counted (spacing, or spacing_matched where the fresh segment has it already) and never
    applied; others are applied where the fresh text is the reference's original, already there, or unplaced.
    """
    order = Window.partitionBy("project_id", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)

    def placed(x: DataFrame) -> DataFrame:
        sized = x.withColumn("_size", F.length(T.scored_text(F.col("original"))).cast("long"))
        return sized.withColumn("_start", F.coalesce(F.sum("_size").over(order), F.lit(0)))

    own = placed(fresh).where("_size > 0").select("project_id", "side", "_start", "_size", F.col("pos").alias("at"), F.col("text").alias("_text"), F.col("original").alias("_original"))
    met = placed(gold).where("corrected <> original").join(own, ["project_id", "side", "_start", "_size"], "left")
    spacing = T.scored_text(F.col("corrected")) == T.scored_text(F.col("original"))
    same = F.coalesce(F.col("_original") == F.col("corrected"), F.lit(False))
    outcome = (
        F.when(spacing, F.when(same, "spacing_matched").otherwise("spacing"))
        .when((T.strip(F.col("corrected")) == "") | F.col("at").isNull(), "unplaced")
        .when(same, "already")
        .when(F.col("_text") == F.col("original"), "applied")
        .otherwise("unplaced")
    )
    return met.select("project_id", "side", "pos", "at", "corrected", outcome.alias("outcome"))


def transferred(segs: DataFrame, beads: DataFrame, turns: DataFrame, edits: DataFrame, worked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segs, beads) after a transfer: beads of the turns (``transferable``) are marked at turn level, applied edits
    (``edits_by_span``, by pos) are written. Books with work done (project_id, marked, edited) are refused as a whole."""
    able = lambda x: x.join(worked.where("marked or edited").select("project_id"), "project_id", "left_anti")
    inside = beads.join(able(turns).select("project_id", "first_bead", "last_bead"), "project_id").where("bead_pos between first_bead and last_bead").select("project_id", "bead_pos", F.lit(True).alias("_mark"))
    marked = beads.join(inside, ["project_id", "bead_pos"], "left").withColumn("review_level", F.when(F.col("_mark"), F.greatest("review_level", F.lit(2))).otherwise(F.col("review_level")))
    written = able(edits.where("outcome = 'applied'")).select("project_id", "side", F.col("at").alias("pos"), "corrected")
    edited = segs.join(written, ["project_id", "side", "pos"], "left").withColumn("text", F.coalesce("corrected", "text"))
    return edited.select(*segs.columns), marked.select(*beads.columns)
