"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. ORACLE_SQL is None: scores over all segmentations,
similarity classes and tokenisation are not SQL; tests/llm/test_pipeline.py checks the stages against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import language_id, line_dedup, mixing, near_join, packing
from twinfold.llm.common import cut, same_row, shared_dir, table, text_key
from twinfold.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language is accepted from this posterior probability on.
MIN_LANGUAGE_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised; those without letters (or text) or without a clear language go.

    Rows are judged one by one, whatever their doc_id; an empty table stays empty.
    """
    model = language_id.language_model(docs, tokenizer("piece_bpe_32k.model"))
    found = language_id.identify(docs, model, carry=COLUMNS[1:])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that a later document holds for them; n_chars follows the text.

    Rows that share a doc_id, or have none, lose their own lines only; a null text stays null.
    """
    done = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs), carry=COLUMNS[2:])
    changed = F.col("n_dropped") > 0
    return done.select("doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that of the least doc_id (nulls last).

    Every row is a document, also where doc_ids repeat or are null; of rows equal in doc_id and text one stays, the
    least by lang, source and n_chars. Documents without words are near to nothing and stay.
    """
    near = near_join.near_duplicates(docs)
    chosen = F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("t1") == F.col("p_t1")) & (F.col("t2") == F.col("p_t2"))
    fate = cut(near.groupBy(*(F.col(c).alias(f"p_{c.removesuffix('_id')}") for c in ("doc_id", "t1", "t2"))).agg(F.count(F.lit(1)).alias("n"), F.first(chosen).alias("chosen")))
    rows, gone, repeated = docs.select(*COLUMNS, *text_key()), fate.where("not chosen"), fate.where("chosen and n > 1")
    kept = rows.join(gone, same_row(rows, gone), "left_anti")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    alone, several = (kept.join(repeated, same_row(kept, repeated), how) for how in ("left_anti", "left_semi"))
    least = several.groupBy("doc_id", "t1", "t2").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r"))
    return alone.select(*COLUMNS).unionByName(least.select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix's runs of blocks hold its middle word.

    A row travels through the mix itself, so repeated and null doc_ids are documents like others; documents without
    words are never taken.
    """
    mixed, _ = mixing.mix(docs, carry=("text", "lang", "n_chars"))
    return mixed.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids; every row, with or without doc_id, is packed."""
    pieces = packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard_join", keep_one_of_each_class),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
