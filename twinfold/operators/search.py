"""Search over beads: prefix, whole-word and phrase queries on folded text, with counts, pages, highlights, context.

The index is one row per token and bead side (token, project_id, bead_pos, side, pos). ``write_index`` keeps it in folders
by the token's first characters and sorts each by token, so that a query lists only the folders its tokens can be in
and reads only the row groups whose range of tokens they fall into. Phrases join the rows of their tokens on consecutive
positions, so that a query reads only the rows of its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .levels import with_units

SIDES = ("source", "target", "either")


def bead_texts(segs: DataFrame) -> DataFrame:
    """project_id, bead_pos, source, target: each side's segments in document order joined by a space."""
    side = lambda s: F.coalesce(F.expr(f"listagg(CASE WHEN side = '{s}' THEN text END, ' ') WITHIN GROUP (ORDER BY block_pos, seg_no)"), F.lit(""))
    return segs.where("bead_pos is not null").groupBy("project_id", "bead_pos").agg(side("source").alias("source"), side("target").alias("target"))


def bead_tokens(texts: DataFrame) -> DataFrame:
    """The positional index: token, project_id, bead_pos, side, pos."""
    sides = texts.select("project_id", "bead_pos", F.explode(F.map_from_arrays(F.array(F.lit("source"), F.lit("target")), F.array("source", "target"))).alias("side", "text"))
    return sides.select("project_id", "bead_pos", "side", F.posexplode(T.tokens(T.fold(F.col("text")))).alias("pos", "token"))


def head(token: Column, letters: int) -> Column:
    """Folder of a token: its first characters, what is no letter from a to z or digit as _; at most 37 ** letters."""
    return F.rpad(F.regexp_replace(F.substring(token, 1, letters), "[^a-z0-9]", "_"), letters, "_")


def write_index(tokens: DataFrame, folder: str, letters: int = 1) -> None:
    """Keep an index as ``bead_tokens`` gives it: sorted over all tasks, so that a very common token spreads over many.

    Folders are by the first ``letters`` characters; two suit libraries of thousands of files.
    """
    order = (f"head{letters}", "token", "project_id", "bead_pos", "side", "pos")
    rows = tokens.withColumn(order[0], head(F.col("token"), letters))
    rows.limit(0).write.parquet(f"{folder}/schema")  # an index may be empty
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(order[0]).parquet(f"{folder}/tokens")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """A kept index; ``head1`` (or head2 ...) is its folder column."""
    return spark.read.schema(spark.read.parquet(f"{folder}/schema").schema).parquet(f"{folder}/tokens")


def parse(query: str) -> list[list[str]]:
    """Phrases of folded tokens: quoted stretches and other words; what has no letter or digit is left out."""
    fold = str.maketrans(*T.fold_table())
    out = []
    for quoted, word in re.findall(r'"([^"]*)"|(\S+)', query):
        text = quoted or word
        for one, several in T.SEARCH_LIGATURES.items():
            text = text.replace(one, several)
        if found := re.findall(r"[^\W_]+", text.lower().translate(fold)):
            out.append(found)
    return out


def matching(index: DataFrame, query: str, side: str = "either", whole_words: bool = False) -> DataFrame:
    """project_id, bead_pos of the beads where all phrases are on one side (on the side asked for, or on either)."""
    if side not in SIDES:
        raise ValueError(f"side must be one of {SIDES}, not {side!r}")
    phrases = parse(query)
    if not phrases:
        return index.select("project_id", "bead_pos").limit(0)
    rows = index if side == "either" else index.where(F.col("side") == side)

    folders = [c for c in index.columns if re.fullmatch(r"head\d", c)]

    def hit(token: str) -> Column:
        found = F.col("token") == token if whole_words else F.col("token").startswith(token)
        for c in folders:
            letters = int(c[4:])
            first = re.sub("[^a-z0-9]", "_", token[:letters])
            found &= F.col(c) == first.ljust(letters, "_") if whole_words or len(first) == letters else F.col(c).startswith(first)
        return found

    keys = ["project_id", "bead_pos", "side"]
    found = None
    for phrase in phrases:
        steps = [rows.where(hit(t)).select(*keys, (F.col("pos") - k).alias("at")) for k, t in enumerate(phrase)]
        beads = reduce(lambda a, b: a.join(b, [*keys, "at"], "left_semi"), steps).select(*keys)
        found = beads if found is None else found.join(beads, keys, "left_semi")
    return found.select("project_id", "bead_pos").distinct()


def counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


def page(matches: DataFrame, books: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Matches in library order (latest update, title, then place in the book); the limit is the feature."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset 0 or more")
    return matches.join(books, "project_id").orderBy(F.desc("updated_at"), "title", "project_id", "bead_pos").offset(offset).limit(limit)


def positions(beads: DataFrame) -> DataFrame:
    """project_id, bead_pos and the bead's place in its book, from 1."""
    return beads.select("project_id", "bead_pos", F.row_number().over(Window.partitionBy("project_id").orderBy("bead_pos")).cast("long").alias("position"))


def highlights(text: Column, phrase: list[str], whole_words: bool = False) -> Column:
    """text as (text, match) spans, the words of every finding of the phrase marked; a ligature is never cut.

    The display text is cut into words and the stretches between them. A word is marked when it is the k-th of some run
    of words whose folded forms start with (or are) the tokens of the phrase, one after another; findings may overlap.
    """
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+"), F.lit(0))
    is_word = lambda p: p.rlike(r"^[\p{L}\p{N}\p{M}]")
    hit = lambda p, token: T.fold(p) == token if whole_words else T.fold(p).startswith(token)
    if len(phrase) == 1:
        return F.transform(parts, lambda p: F.struct(p.alias("text"), hit(p, phrase[0]).alias("match")))
    # Words and what stands between them alternate, so the next word is two parts on.
    each = F.element_at(F.transform(F.array(parts), lambda ps: F.transform(ps, lambda p, i: F.struct(p.alias("text"), F.array(*(F.coalesce(is_word(p) & hit(p, token), F.lit(False)) for token in phrase)).alias("fits")))), 1)
    runs = lambda xs, i: [_all(F.coalesce(F.get(xs, i + 2 * (j - k))["fits"][j], F.lit(False)) for j in range(len(phrase))) for k in range(len(phrase))]
    return F.element_at(F.transform(F.array(each), lambda xs: F.transform(xs, lambda x, i: F.struct(x["text"].alias("text"), reduce(lambda a, b: a | b, runs(xs, i)).alias("match")))), 1)


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def context(hits: DataFrame, beads: DataFrame, segs: DataFrame, around: int = 2) -> DataFrame:
    """For every hit: the beads around it, in_turn marking those of its turn; below sentence level the turn is the core.

    Neighbours are counted by place in the book, so bead_pos may be any number that orders the beads.
    """
    if not 1 <= around <= 10:
        raise ValueError("around must be 1 to 10")
    units = with_units(beads, segs, "turn").select("project_id", "bead_pos", "unit_no", "review_level")
    placed = units.withColumn("_at", F.row_number().over(Window.partitionBy("project_id").orderBy("bead_pos")))
    turn = Window.partitionBy("project_id", "unit_no")
    placed = placed.withColumn("_first", F.min("_at").over(turn)).withColumn("_last", F.max("_at").over(turn))
    whole = F.col("review_level") < 3
    asked = placed.join(hits.select("project_id", "bead_pos"), ["project_id", "bead_pos"], "left_semi")
    asked = asked.select("project_id", F.col("bead_pos").alias("hit"), F.when(whole, F.col("_first")).otherwise(F.col("_at")).alias("a"), F.when(whole, F.col("_last")).otherwise(F.col("_at")).alias("b"))
    near = asked.select("project_id", "hit", "a", "b", F.explode(F.sequence(F.col("a") - around, F.col("b") + around)).alias("_at"))
    return near.join(placed.select("project_id", "_at", "bead_pos"), ["project_id", "_at"]).select("project_id", "hit", "bead_pos", F.col("_at").between(F.col("a"), F.col("b")).alias("in_turn"))


def touched(changes: DataFrame) -> DataFrame:
    """Beads whose index rows a change log makes stale: those its segments leave or enter."""
    each = changes.select("project_id", F.explode(F.array("before_bead", "after_bead")).alias("bead_pos"))
    return each.where("bead_pos is not null").distinct()


def refreshed(index: DataFrame, changes: DataFrame, segs: DataFrame) -> DataFrame:
    """The index after changes: rows of touched beads made anew from segs, all others kept."""
    stale = touched(changes)
    kept = index.join(stale, ["project_id", "bead_pos"], "left_anti")
    fresh = bead_tokens(bead_texts(segs.join(stale, ["project_id", "bead_pos"], "left_semi")))
    for c in (c for c in index.columns if re.fullmatch(r"head\d", c)):
        fresh = fresh.withColumn(c, head(F.col("token"), int(c[4:])))
    return kept.unionByName(fresh.select(*index.columns))
