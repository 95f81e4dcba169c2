"""Repairing reference layers: ligature gaps by decisions, and a layer set into a new block structure."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ingest import LETTER
from ..functions import text as T

KEYS = ["project_id", "side", "block_pos", "seg_no"]
DECISIONS = ("join", "keep", "doubtful")
PAGE_NUMBER_DIGITS = 3


def gap_candidates(segs: DataFrame) -> DataFrame:
    """KEYS and offset (from 0) of white space after f, fi, fl (any case) or Th and before a letter."""
    parts = F.split("text", rf"(?<=[fF]|[fF][iI]|[fF][lL]|Th) (?={LETTER})", -1)
    each = segs.select(*KEYS, F.posexplode(parts).alias("k", "part"), (F.size(parts) - 1).alias("n"))
    order = Window.partitionBy(*KEYS).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("offset", (F.sum(F.length("part")).over(order) + F.col("k")).cast("long")).where("k < n").select(*KEYS, "offset")


def undecided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates without exactly one decision, and decisions on what is no candidate, with their count (0: none)."""
    counted = decisions.groupBy(*KEYS, "offset").agg(F.count(F.lit(1)).alias("n"))
    both = candidates.withColumn("_c", F.lit(True)).join(counted, [*KEYS, "offset"], "full")
    return both.where("_c is null or n is null or n <> 1").select(*KEYS, "offset", F.coalesce("n", F.lit(0)).alias("n"))


def gaps_closed(segs: DataFrame, decisions: DataFrame) -> DataFrame:
    """segs with the gaps decided ``join`` closed; nothing but one white-space character a gap is taken out."""
    cuts = decisions.where("decision = 'join'").groupBy(*KEYS).agg(F.array_sort(F.collect_list("offset")).alias("_cuts"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cuts", lambda o: o + 1))
    ends = F.concat(F.col("_cuts"), F.array(F.length("text").cast("long")))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))), "")
    return segs.join(cuts, KEYS, "left").withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(kept)).select(*segs.columns)


def dropped_ligatures(words: DataFrame) -> DataFrame:
    """word, repair: words (word, n) seen once that become a word seen oftener when fi, fl or ff is put back somewhere."""
    rare = words.where("n = 1").select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    tried = rare.select("word", "at", F.explode(F.array(*map(F.lit, ("fi", "fl", "ff")))).alias("lig"))
    made = tried.select("word", F.concat(F.substring(F.col("word"), F.lit(1), F.col("at")), "lig", F.substring(F.col("word"), F.col("at") + 1, F.length("word"))).alias("repair"))
    return made.join(words.where("n > 1").select(F.col("word").alias("repair")), "repair", "left_semi").distinct()


def _bare(text: str) -> str:
    return re.sub(r"[\s\-­]+", "", text)


def rebase_side(gold: list[dict], fresh: list[dict]) -> list[dict]:
    """Gold segments (block, text, original, bead, excluded) set into fresh blocks (text, excluded), in fresh order.

    What is left of the gold blocks is a list; each fresh block takes from it, in order, every block that its text goes on
    with, passing over those that belong elsewhere, and may take only the head of the last one. A segment is cut inside
    only where its text is unedited. A gold block of up to three digits in beads, whole in a block that the fresh layer
    excludes, leaves its beads. Parts of which some are excluded and others not make no block: that is an error.
    """
    waiting: list[list[dict]] = []
    for row in gold:
        if waiting and waiting[-1][0]["block"] == row["block"]:
            waiting[-1].append(dict(row))
        else:
            waiting.append([dict(row)])
    out = []
    for number, block in enumerate(fresh):
        left, taken, at = _bare(block["text"]), [], 0
        while left:
            if at >= len(waiting):
                raise ValueError(f"block {number}: {len(left)} characters are not in the reference layer")
            have = "".join(_bare(s["original"]) for s in waiting[at])
            if have and left.startswith(have):
                taken.append(waiting.pop(at))
                left = left[len(have) :]
            elif have.startswith(left):
                head, need = [], len(left)
                while need:
                    s = waiting[at][0]
                    size = len(_bare(s["original"]))
                    if size <= need:
                        head.append(waiting[at].pop(0))
                        need -= size
                        continue
                    if s["text"] != s["original"]:
                        raise ValueError(f"block {number}: the cut falls inside an edited segment")
                    cut = next(i for i in range(1, len(s["original"]) + 1) if len(_bare(s["original"][:i])) == need)
                    head.append(s | {"text": s["text"][:cut], "original": s["original"][:cut]})
                    waiting[at][0] = s | {"text": s["text"][cut:], "original": s["original"][cut:]}
                    need = 0
                taken.append(head)
                left = ""
            else:
                at += 1
        if len({s["excluded"] for part in taken for s in part}) > 1:
            raise ValueError(f"block {number}: some of its parts are excluded in the reference layer and others are not")
        digits = "".join(s["text"] for part in taken for s in part).strip()
        number_left = len(taken) == 1 and block["excluded"] and not taken[0][0]["excluded"] and re.fullmatch(rf"[0-9]{{1,{PAGE_NUMBER_DIGITS}}}", re.sub(r"\s", "", digits))
        excluded = True if number_left else taken[0][0]["excluded"] if taken else block["excluded"]
        for part in taken:
            out += [s | {"block": number, "excluded": excluded, "bead": None if number_left else s["bead"]} for s in part]
    if any(_bare(s["original"]) for part in waiting for s in part):
        raise ValueError(f"{len(waiting)} blocks of the reference layer are not in the extraction")
    return out


def rebased(gold: DataFrame, fresh: DataFrame) -> DataFrame:
    """gold (project_id, side, block, pos, text, original, bead, excluded) in the block structure of fresh (project_id,
    side, block, text, excluded); one side of a book a group."""
    schema = "project_id long, side string, block long, pos long, text string, original string, bead long, excluded boolean"

    def one(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        rows = [r | {"bead": None if pd.isna(r["bead"]) else int(r["bead"])} for r in old.sort_values("pos").to_dict("records")]
        made = rebase_side(rows, new.sort_values("block").to_dict("records"))
        return pd.DataFrame([(key[0], key[1], s["block"], k, s["text"], s["original"], s["bead"], s["excluded"]) for k, s in enumerate(made)], columns=[c.split()[0] for c in schema.split(", ")]).astype({"bead": "Int64"})

    keys = ("project_id", "side")
    return gold.groupBy(*keys).cogroup(fresh.groupBy(*keys)).applyInPandas(one, schema)


def checked_rebase(gold: DataFrame, made: DataFrame) -> DataFrame:
    """project_id, side, bead of beads whose text is no longer what it was (none: the rebase is sound)."""
    whole = lambda x, name: x.where("bead is not null").groupBy("project_id", "side", "bead").agg(F.sha2(F.expr("listagg(t, '') WITHIN GROUP (ORDER BY pos)"), 256).alias(name))
    bare = lambda x: x.withColumn("t", T.spaceless(F.col("text")))
    a, b = whole(bare(gold), "a"), whole(bare(made), "b")
    return a.join(b, ["project_id", "side", "bead"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("project_id", "side", "bead")
