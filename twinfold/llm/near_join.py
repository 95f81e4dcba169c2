"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. One pass over the texts gives each document a hash of its word sequence, MinHash values and a hash for each band of
   them. Documents with equal word sequences form a class; the rest works on one representative of each.
2. Representatives that share a band's bucket are candidates. Their MinHash values are compared a stretch at a time;
   with a uniform prior, the number of matches so far gives the posterior probability that the similarity reaches
   the threshold, and a pair is dropped once that falls below ``TOLERANCE``. What survives joins candidate clusters.
   A pair of which both are in one cluster already needs no comparison.
3. Inside each cluster all pairs are verified exactly on the shingles of whole texts, by inverted lists. Tasks return
   counts and union-find roots, never pairs.

Copies of one text, however many, are one representative. Buckets and clusters beyond a block are dealt out as pairs
of blocks, so that no task holds more than two; nothing is capped. Shingles are 64-bit hashes.

Defined results: every row is a document of its own, whatever its doc_id; a text of one to four words has one shingle,
all its words; a text without words has none, links to nothing and is a class of its own; class_id and copy_of are the
least doc_id of the class and of the copies, null if none of them has one, so classes are told apart by the row that
stands for them (``p_doc``, ``p_t1``, ``p_t2``); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, cut, same_row, split_words, text_key
from .components import components

SPAN, THRESHOLD = 5, (4, 5)
BANDS, ROWS, STRETCH, TOLERANCE = 35, 4, 20, 1e-5
BUCKET_ROWS, CLUSTER_ROWS, CLUSTER_SHINGLES = 4096, 2048, 4_000_000
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


def shingles(words: list[str], hashes: WordHash) -> np.ndarray:
    """Hashes of the five-word windows, with repeats."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(SPAN, len(words))
    if not span:
        return h
    n = len(words) - span + 1
    g = np.full(n, span, np.uint64)
    for k in range(span):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    g = (g ^ (g >> np.uint64(31))) * _MIX
    return g ^ (g >> np.uint64(29))


def minhash_constants(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)


def minhash(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        np.minimum(least, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=least)
    return least


def least_matches(count: int, stretch: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped), by the posterior of a uniform prior.

    After n values and m matches the similarity is Beta(m + 1, n - m + 1), and the probability that it reaches t is
    that of at most m successes in n + 1 draws of chance t.
    """
    out = []
    for n in range(stretch, count + 1, stretch):
        total, m = 0.0, 0
        while total < tolerance:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            m += 1
        out.append((n, m - 1))
    return out


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def survivors(one: np.ndarray, others: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of others that incremental comparison with one does not drop."""
    live, matches, done = np.arange(len(others)), np.zeros(len(others), np.int64), 0
    for n, need in steps:
        matches = matches + (others[live, done:n] == one[done:n]).sum(axis=1)
        keep = matches >= need
        live, matches, done = live[keep], matches[keep], n
        if not len(live):
            break
    return live


def join_bucket(left: np.ndarray, right: np.ndarray, values: np.ndarray, steps: list[tuple[int, int]], same: bool = False) -> Union:
    """Union-find over the rows of values: each of left is compared with those of right that it isn't joined to yet; same
    says that both are one block, which is done once all its rows are joined."""
    found = Union(len(values))
    for i in left.tolist():
        # Rows already joined with i through earlier ones need no comparison.
        rest = right if i == left[0] else np.array([j for j in right.tolist() if found.root(j) != found.root(i)], np.int64)
        rest = rest[rest != i]
        for j in rest[survivors(values[i], values[rest], steps)].tolist():
            found.join(i, j)
        if same and len({found.root(x) for x in right.tolist()}) == 1:
            break
    return found


def features(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, k1, k2 (hash of the word sequence), grams (windows), values (16 bits of each MinHash), bands."""
    count = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, (a, b) = WordHash(), minhash_constants(count)
        odd = np.random.default_rng(5).integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            if len(hashes) > 500_000:
                hashes.clear()
            keys, grams, values, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = split_words(text)
                keys.append(xxhash.xxh3_128_digest(" ".join(found).encode("utf-8", "surrogatepass")))
                g = shingles(found, hashes)
                grams.append(len(g))
                if len(g):
                    least = minhash(g, a, b)
                    values.append(least.astype(np.uint16).tobytes())
                    mixed = (least.reshape(BANDS, ROWS).astype(np.uint64) * odd).sum(axis=1)
                    bands.append((mixed ^ (mixed >> np.uint64(30))) * _MIX)
                else:
                    values.append(b"")
                    bands.append(np.zeros(0, np.uint64))
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2) if keys else np.zeros((0, 2), np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            flat = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
            made = [pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(grams, pa.int64()), pa.array(values, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *made], names=["doc_id", "t1", "t2", "k1", "k2", "grams", "values", "bands"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"], *text_key()).mapInArrow(run, "doc_id long, t1 long, t2 long, k1 long, k2 long, grams long, values binary, bands array<long>")


def candidate_edges(reps: DataFrame) -> DataFrame:
    """Edges (u, v) of candidate clusters among representatives (rep, values, bands)."""
    steps = least_matches(BANDS * ROWS, STRETCH, THRESHOLD[0] / THRESHOLD[1], TOLERANCE)
    rows = reps.select("rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inside = rows.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BUCKET_ROWS).cast("int"))
    # Only representatives in a shared bucket need their MinHash values.
    inside = inside.join(reps.select("rep", "values"), "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = dealt(inside.withColumn("own", own), "key").select("key", "pa", "pb", "own", "rep", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, a, b), group in by_group(batches, 3):
            own, rep = group["own"].to_numpy(), group["rep"].to_numpy()
            order = np.argsort(rep, kind="stable")
            own, rep = own[order], rep[order]
            values = np.frombuffer(b"".join(group["values"].to_pylist()), np.uint16).reshape(len(rep), -1)[order]
            left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
            if len(left) and len(right) and len(rep) > 1:
                found = join_bucket(left, right, values, steps, bool(a == b))
                roots = np.array([found.root(x) for x in range(len(rep))])
                at = np.flatnonzero(roots != np.arange(len(rep)))
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[roots[at]])], names=["u", "v"])

    return pairs.repartition("key", "pa", "pb").sortWithinPartitions("key", "pa", "pb").mapInArrow(run, "u long, v long").where("u <> v")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, own, blocks) once for each pair of blocks (pa <= pb) that their block is in; one block is one pair."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("_other", other).withColumn("pa", F.least("own", "_other")).withColumn("pb", F.greatest("own", "_other")).drop("_other")


def linked(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of left, those of right with a Jaccard similarity at the threshold or above; exact, by inverted lists."""
    p, q = THRESHOLD
    size = np.array([len(g) for g in grams])
    flat = np.concatenate([grams[j] for j in right])
    owner = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i in left.tolist():
        a, b = np.searchsorted(flat, grams[i]), np.searchsorted(flat, grams[i], side="right")
        count = b - a
        ends = np.cumsum(count)
        met = owner[np.repeat(a - (ends - count), count) + np.arange(ends[-1])]
        both = np.bincount(met, minlength=len(right))
        yield i, right[q * both >= p * (size[i] + size[right] - both)]


def verified(members: DataFrame) -> DataFrame:
    """rep, root, link_docs for each block pair of clusters (cluster, pa, pb, own, rep, copies, text).

    A representative whose doc_id and text several rows share may come more than once; it counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for (_, a, b), group in by_group(batches, 3):
            if len(hashes) > 300_000:
                hashes.clear()
            rep, once = np.unique(group["rep"].to_numpy(), return_index=True)
            own, copies = (group[c].to_numpy()[once] for c in ("own", "copies"))
            grams = [np.unique(shingles(split_words(t), hashes)) for t in group["text"].take(pa.array(once)).to_pylist()]
            left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
            if not len(left) or not len(right):
                continue
            found, links = Union(len(rep)), np.zeros(len(rep), np.int64)
            for i, js in linked(grams, left, right):
                js = js[js != i]
                links[i] += copies[js].sum()
                if a != b:
                    links[js] += copies[i]
                for j in js.tolist():
                    found.join(i, j)
            roots = np.array([found.root(x) for x in range(len(rep))])
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[roots[at]]), pa.array(links[at])], names=["rep", "root", "link_docs"])

    dealt_out = members.select("cluster", "pa", "pb", "own", "rep", "copies", "text").repartition("cluster", "pa", "pb").sortWithinPartitions("cluster", "pa", "pb")
    return dealt_out.mapInArrow(run, "rep long, root long, link_docs long")


def representatives(found: DataFrame) -> DataFrame:
    """One row for each different word sequence of ``features``: rep (its number), first (is its doc_id null, doc_id, t1, t2), copies and what its words decide.

    Copies are summed before they travel, so a text of very many copies is one row of each task.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc"), "t1", "t2")
    decided = (F.first(c).alias(c) for c in ("grams", "values", "bands"))
    classes = found.where("grams > 0").groupBy("k1", "k2").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), *decided)
    return cut(classes.withColumn("rep", F.monotonically_increasing_id()))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, class_id, copy_of, n_links and p_doc, p_t1, p_t2 of every row of docs.

    class_id is the least doc_id of the documents that links connect, copy_of the least doc_id with the same words in
    the same order, n_links the number of other documents at the threshold or above, copies included. The p columns
    name the row that stands for the class: the least of its rows by doc_id (nulls last), t1 and t2.
    """
    found = cut(features(docs))
    reps = representatives(found)
    clusters = components(candidate_edges(reps.select("rep", "values", "bands"))).withColumnsRenamed({"label": "cluster", "node": "rep"})
    sized = reps.select("rep", "first", "copies", "grams").join(clusters, "rep")
    sizes = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CLUSTER_ROWS), F.ceil(F.sum("grams") / CLUSTER_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("own")
    placed = sized.join(sizes, "cluster").select("cluster", "rep", "copies", own, "blocks", F.col("first.doc").alias("p_doc"), F.col("first.t1").alias("p_t1"), F.col("first.t2").alias("p_t2"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", *text_key())
    texts = rows.join(placed, same_row(rows, placed)).select("cluster", "rep", "copies", "own", "blocks", "text")
    checked = cut(verified(dealt(texts, "cluster")))
    linked_to = components(checked.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
    links = checked.groupBy("rep").agg(F.sum("link_docs").alias("link_docs"))
    named = reps.select("rep", "k1", "k2", "first", "copies").join(links, "rep", "left").join(linked_to, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    each = named.join(heads, "label").select("k1", "k2", F.col("first.doc").alias("copy_of"), "head", (F.col("copies") - 1 + F.coalesce("link_docs", F.lit(0))).alias("n_links"))
    base = found.select("doc_id", "t1", "t2", "grams", F.when(F.col("grams") > 0, F.col("k1")).alias("k1"), "k2")
    joined, alone = base.join(each, ["k1", "k2"], "left"), F.col("grams") == 0
    return joined.select(
        "doc_id", "t1", "t2",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc")).alias("p_doc"),
        F.when(alone, F.col("t1")).otherwise(F.col("head.t1")).alias("p_t1"),
        F.when(alone, F.col("t2")).otherwise(F.col("head.t2")).alias("p_t2"),
    )
