"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

1. Centroids and codebooks are fitted by k-means to a hash-ordered sample; every row is then assigned to its nearest
   centroid and its residual encoded. Lists grow with the square root of the rows.
2. A query visits the lists of its nearest centroids. Asymmetric tables give its distance to each code there; a block
   of a list returns the query's best ``RERANK`` by these distances, less those that are beyond the distance which, by
   the sample, more than ``RERANK`` rows of the whole table come within.
3. Of all that a query's lists returned, the best ``RERANK`` by distance are kept, whatever their lists, and only these
   are scored exactly, on the original vectors. So the codes decide what is looked at, in lists of any size.

Lists are dealt out in blocks of bounded size, so that one with many like vectors is no single task. The search itself
moves codes; vectors move once to be scored, together with one copy of a query's vector for each block it has rows in.

Of equal vectors only the k + 1 with the smallest vec_id can be among k nearest (one may be the query itself); the
search leaves the others out before it ranks codes, which loses no result and keeps copies from filling the ranks.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, and neither do those
whose length differs from the commonest one (the smaller of equally common ones); null vec_ids take no part; of rows
with equal vec_id and equal vectors one counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, cut

#: Rows that centroids and codebooks are fitted to, and rows a list where those are more (beyond 25 million rows);
#: sub-quantisers and their codes; exact scores for each query; rows of a block.
SAMPLE, SAMPLE_A_LIST, PARTS, CODES, RERANK, BLOCK_ROWS = 20_000, 8, 16, 256, 256, 4096
#: Share of the sample's neighbours that the visited lists must hold.
REACH = 0.98


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (size["d"] if size else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids; empty ones are reseeded at the rows that are farthest off."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        near, dist = nearest(x, c)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        heads = np.flatnonzero(np.diff(near[order], prepend=-1))
        c[near[order][heads]] = np.add.reduceat(x[order], heads, axis=0) / count[near[order][heads]][:, None]
        if (empty := np.flatnonzero(count == 0)).size:
            c[empty] = x[np.argsort(-dist, kind="stable")[: empty.size]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, the nearest centroid of each row."""
    at, dist = np.empty(len(x), np.int64), np.empty(len(x))
    square = (c * c).sum(axis=1)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048]
        d = square[None, :] - 2 * part @ c.T
        at[i : i + 2048] = d.argmin(axis=1)
        dist[i : i + 2048] = d.min(axis=1) + (part * part).sum(axis=1)
    return at, dist


@dataclass
class Index:
    """coarse: lists x d; books: parts x codes x d / parts (the vectors padded to a multiple of parts).

    ``sample`` holds the sample's vectors as their codes give them back, ``share`` its part of all rows, and ``sizes``
    the rows of each list once they are known.
    """

    coarse: np.ndarray
    books: np.ndarray
    probes: int
    sample: np.ndarray
    share: float = 1.0
    sizes: np.ndarray | None = None

    def pad(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors with zeros up to the codebooks' length."""
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.pad(x, ((0, 0), (0, self.coarse.shape[1] - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of padded vectors."""
        near, _ = nearest(x, self.coarse)
        residual = (x - self.coarse[near]).reshape(len(x), len(self.books), -1)
        return near, np.stack([nearest(residual[:, p], book)[0] for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def blocks(self, at: np.ndarray) -> np.ndarray:
        return -(-self.sizes[at] // BLOCK_ROWS)

    def distances(self, x: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
        """Squared distance of each of x (padded) to each code of list ``at``, by asymmetric tables."""
        rest = (x - self.coarse[at]).reshape(len(x), len(self.books), -1)
        total = np.zeros((len(x), len(code)))
        for p, book in enumerate(self.books):
            table = (rest[:, p] ** 2).sum(axis=1)[:, None] - 2 * rest[:, p] @ book.T + (book * book).sum(axis=1)[None, :]
            total += table[:, code[:, p]]
        return total

    def bounds(self, x: np.ndarray, wanted: int) -> np.ndarray:
        """For each of x, a distance that ``wanted`` coded rows come within, by the sample (4 deviations to be safe)."""
        expected = wanted * self.share
        rank = int(expected + 4 * expected**0.5 + 5)
        if rank >= len(self.sample):
            return np.full(len(x), np.inf)
        distance = (self.sample * self.sample).sum(axis=1)[None, :] - 2 * x @ self.sample.T
        return np.partition(distance, rank, axis=1)[:, rank] + (x * x).sum(axis=1) + 1e-5


def fit(rows: DataFrame, total: int, sample: int = SAMPLE, parts: int = PARTS, codes: int = CODES, lists: int | None = None, probes: int | None = None) -> Index:
    """An index without rows; probes is measured on the sample."""
    lists = lists or max(1, round(total**0.5 / 2))
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, SAMPLE_A_LIST * lists)).select("embedding").collect()
    x = np.array([r[0] for r in got], float)
    width = -(-x.shape[1] // parts) * parts
    index = Index(np.zeros((1, width)), np.zeros((parts, 1, width // parts)), 1, x[:0], len(got) / total)
    x = index.pad(x)
    index.coarse = kmeans(x, lists)
    near, _ = nearest(x, index.coarse)
    index.probes = min(len(index.coarse), probes or probes_for(x, near, index.coarse))
    some = (x - index.coarse[near]).reshape(len(x), parts, -1)[:8000]
    index.books = np.stack([np.pad(c := kmeans(some[:, p], codes, rounds=6), ((0, codes - len(c)), (0, 0)), mode="edge") for p in range(parts)])
    near, code = index.encode(x)
    index.sample = index.coarse[near] + np.concatenate([book[code[:, p]] for p, book in enumerate(index.books)], axis=1)
    return index


def probes_for(x: np.ndarray, near: np.ndarray, coarse: np.ndarray, k: int = 5, queries: int = 400, reach: float = REACH) -> int:
    """Lists to visit so that ``reach`` of the k nearest in the sample are met; on all rows neighbours are closer still."""
    asked = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(np.int64)
    distance = (coarse * coarse).sum(axis=1)[None, :] - 2 * x[asked] @ coarse.T
    place = np.argsort(np.argsort(distance, axis=1, kind="stable"), axis=1, kind="stable")
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -2
    best = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    ranks = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(reach * len(ranks)))]) + 1 if len(ranks) else 1


def assign(rows: DataFrame, index: Index) -> DataFrame:
    """The index's rows: vec_id, embedding, list and code."""
    shared = rows.sparkSession.sparkContext.broadcast(index)  # lists and sample grow with the square root of the rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
                near, code = shared.value.encode(shared.value.pad(x))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "embedding", "list", "code"])

    return rows.mapInArrow(run, "vec_id long, embedding array<double>, list int, code binary")


def probe(queries: DataFrame, index: Index, rerank: int) -> DataFrame:
    """query_id, list, block, bound and vector (padded, 32-bit) for each block of a list that a query visits.

    A query visits ``probes`` lists, and more where these hold fewer rows than are to be scored exactly.
    """
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                x = m.pad(np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(part.num_rows, -1))
                lists = np.argsort((m.coarse * m.coarse).sum(axis=1)[None, :] - 2 * x @ m.coarse.T, axis=1, kind="stable")
                rows_before = np.cumsum(m.sizes[lists], axis=1) - m.sizes[lists]
                visited = (np.arange(lists.shape[1])[None, :] < m.probes) | (rows_before <= rerank)
                asked, place = np.nonzero(visited & (m.sizes[lists] > 0))
                at = lists[asked, place]
                blocks = m.blocks(at)
                take = np.repeat(np.arange(len(at)), blocks)
                block = np.arange(len(take)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                of = pa.array(asked[take])
                bound, vector = pa.array(m.bounds(x, rerank)), pa.array([v.astype(np.float32).tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), pa.array(at[take].astype(np.int32)), pa.array(block.astype(np.int32)), bound.take(of), vector.take(of)], names=["query_id", "list", "block", "bound", "vector"])

    return queries.mapInArrow(run, "query_id long, list int, block int, bound double, vector binary")


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q with each row of x in double precision; equal rows get equal numbers."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def scan(entries: DataFrame, visits: DataFrame, index: Index, rerank: int) -> DataFrame:
    """query_id, list, block, vec_id and distance of the best codes of each visited block.

    entries: list, block, vec_id, code; visits: as ``probe`` gives them.
    """
    shared = entries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for (at, block), group in by_group(batches, 2):
            ids, mine = group["vec_id"].to_numpy(), np.flatnonzero(group["vector"].is_null().to_numpy())
            asked = np.flatnonzero(group["vector"].is_valid().to_numpy())
            if not len(mine) or not len(asked):
                continue
            mine = mine[np.argsort(ids[mine], kind="stable")]
            code = np.frombuffer(b"".join(group["code"].take(pa.array(mine)).to_pylist()), np.uint8).reshape(len(mine), -1)
            for first in range(0, len(asked), 64):
                some = asked[first : first + 64]
                x = np.frombuffer(b"".join(group["vector"].take(pa.array(some)).to_pylist()), np.float32).reshape(len(some), -1).astype(float)
                distance = m.distances(x, at, code)
                distance[ids[some][:, None] == ids[mine][None, :]] = np.inf
                bound = group["bound"].take(pa.array(some)).to_numpy()
                if len(mine) > rerank:
                    bound = np.minimum(bound, np.partition(distance, rerank, axis=1)[:, rerank])
                of, best = np.nonzero((distance <= bound[:, None]) & np.isfinite(distance))
                n = len(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some][of]), pa.array(np.full(n, at, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(ids[mine][best]), pa.array(distance[of, best])],
                    names=["query_id", "list", "block", "vec_id", "distance"],
                )

    null = lambda kind: F.lit(None).cast(kind)
    coded = entries.select("list", "block", "vec_id", "code", null("double").alias("bound"), null("binary").alias("vector"))
    asking = visits.select("list", "block", F.col("query_id").alias("vec_id"), null("binary").alias("code"), "bound", "vector")
    return coded.unionByName(asking).repartition("list", "block").sortWithinPartitions("list", "block").mapInArrow(run, "query_id long, list int, block int, vec_id long, distance double")


def scored(entries: DataFrame, asks: DataFrame) -> DataFrame:
    """query_id, vec_id and exact score of each row that a query asks for.

    entries: list, block, vec_id, embedding; asks: list, block, query_id, embedding (the query's) and ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches, 2):
            ids, mine = group["vec_id"].to_numpy(), np.flatnonzero(group["ids"].is_null().to_numpy())
            asked = np.flatnonzero(group["ids"].is_valid().to_numpy())
            if not len(mine) or not len(asked):
                continue
            x = group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            mine = mine[np.argsort(ids[mine], kind="stable")]
            for q, wanted in zip(asked.tolist(), group["ids"].take(pa.array(asked)).to_pylist()):
                # Several rows may share a vec_id.
                low, high = (np.searchsorted(ids[mine], np.unique(wanted), side=side) for side in ("left", "right"))
                rows = mine[np.concatenate([np.arange(a, b) for a, b in zip(low, high)])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), ids[q])), pa.array(ids[rows]), pa.array(cosines(x[q], x[rows]))], names=["query_id", "vec_id", "score"])

    null = F.lit(None).cast("array<long>")
    kept = entries.select("list", "block", "vec_id", "embedding", null.alias("ids"))
    asking = asks.select("list", "block", F.col("query_id").alias("vec_id"), "embedding", "ids")
    return kept.unionByName(asking).repartition("list", "block").sortWithinPartitions("list", "block").mapInArrow(run, "query_id long, vec_id long, score double")


def search(rows: DataFrame, is_query: Column, k: int = 5, index: Index | None = None, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of all other rows; rows as ``usable`` gives them."""
    spark = rows.sparkSession
    rows = cut(rows.dropDuplicates(["vec_id", "embedding"]))
    # k + 1 of each set of equal vectors; the limit works before the shuffle too.
    copies = Window.partitionBy(F.xxhash64("embedding"), F.xxhash64(F.lit(7), F.col("embedding"))).orderBy("vec_id")
    able = cut(rows.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n"))
    total = able.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = index or fit(able, total)
    indexed = cut(assign(able, index))
    index.sizes = np.zeros(len(index.coarse), np.int64)
    for at, n in indexed.groupBy("list").count().collect():  # a number a list
        index.sizes[at] = n
    per_list = F.element_at(F.lit(index.blocks(np.arange(len(index.sizes))).tolist()), F.col("list") + 1)
    entries = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), per_list).cast("int"))
    queries = rows.where(is_query)
    found = scan(entries, probe(queries, index, rerank), index, rerank).distinct()
    nearest_codes = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    best = found.withColumn("_n", F.row_number().over(nearest_codes)).where(F.col("_n") <= rerank)
    asks = best.groupBy("query_id", "list", "block").agg(F.collect_list("vec_id").alias("ids"))  # rerank at most
    asks = asks.join(queries.withColumnRenamed("vec_id", "query_id"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored(entries, asks).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
