"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words: the six ASCII white-space characters, nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+", -1), "")


def text_key() -> list[Column]:
    """Two hashes that name a row together with doc_id: rows equal in doc_id and text fare alike, all others are told apart."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), F.col("text")).alias("t2")]


def same_row(a: DataFrame, b: DataFrame, prefix: str = "p_") -> Column:
    """Rows of a (doc_id, t1, t2) and b (the same, with a prefix) that ``text_key`` does not tell apart; ids may be null."""
    return a["doc_id"].eqNullSafe(b[f"{prefix}doc"]) & (a["t1"] == b[f"{prefix}t1"]) & (a["t2"] == b[f"{prefix}t2"])


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; in local mode alone a temporary one stands in where none is set."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="twinfold-")
    atexit.register(shutil.rmtree, made, True)
    context.setCheckpointDir(f"file://{made}")
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared folder, from where any executor can read it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column], name: str, within: str | None = None) -> DataFrame:
    """Add ``name``: a row's number, from 1, in an order (of the rows equal in ``within``, which is not null).

    The rows are sorted over all tasks; how many come before a task's is summed from one row a task and group.
    """
    keys = [F.col(within)] if within else []
    ordered = cut(df.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))  # task number and place
    parts = ordered.groupBy(F.shiftright("_at", 33).alias("_task"), *keys).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_task", *(k.alias("_within") for k in keys), (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low") + 1).alias("_start"))
    same = (F.shiftright(ordered["_at"], 33) == starts["_task"]) & (ordered[within] == starts["_within"] if within else F.lit(True))
    return ordered.join(F.broadcast(starts), same).select(*df.columns, (F.col("_at") + F.col("_start")).alias(name))  # a row a task and group


def running_before(df: DataFrame, keys: list[str], order: list[Column], spread: Column, weight: Column, rows: int, name: str, attach: DataFrame | None = None, narrow: Callable[[Column, Column], dict[str, Column]] | None = None, per_bucket: int = 4096) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows of the same keys that come earlier.

    The order is (bucket, order) with bucket = spread modulo rows / per_bucket, so that no task ever holds all
    rows of a hot key: rows are summed within their bucket, bucket totals are summed over the buckets of a key,
    and the two parts are added. Keys may be null. ``attach`` has columns for each key: they reach the rows through the
    bucket totals, so that no join puts a key's rows into one task; ``narrow`` may replace some of them by what a
    bucket needs, given the sums before and after it.
    """
    buckets = max(1, -(-rows // per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets))).withColumn("_weight", weight.cast("long"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_total"))
    over = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_b"), "_total", F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_start"))
    if attach is not None:
        own = attach.withColumnsRenamed({k: f"_a{i}" for i, k in enumerate(keys)})
        known = [starts[f"_k{i}"].eqNullSafe(own[f"_a{i}"]) for i in range(len(keys))]
        starts = starts.join(own, known, "inner").drop(*(f"_a{i}" for i in range(len(keys))))
        starts = starts.withColumns(narrow(F.col("_start"), F.col("_start") + F.col("_total")) if narrow else {})
    starts = starts.drop("_total")
    dealt = dealt.withColumn("_within", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    same = [dealt[k].eqNullSafe(starts[f"_k{i}"]) for i, k in enumerate(keys)] + [dealt["_bucket"] == starts["_b"]]
    joined = dealt.join(starts, same, "inner")
    return joined.withColumn(name, F.col("_start") + F.col("_within")).drop("_bucket", "_weight", "_within", "_start", "_b", *(f"_k{i}" for i in range(len(keys))))


#: Characters at which Python's str.split cuts though they are no separators of words here.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_ASCII_SPACE = re.compile("[ \t-\r]+")


def split_words(text: str | None) -> list[str]:
    """The words of a text, as ``words`` cuts them."""
    if not text:
        return []
    return [w for w in _ASCII_SPACE.split(text) if w] if _OTHER_SPACE.search(text) else text.split()


def by_group(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows that are equal in the first ``keys`` columns (integers, not null), from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)
