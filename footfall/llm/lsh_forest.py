"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives a vector a long hash string: the signs of its products with random directions. A tree is
the array of these strings in sorted order, so that the vectors below any prefix lie side by side. A query
descends in every tree to its longest matching prefix, then ascends in all trees at once, one hash digit
after the other, until the vectors below its prefixes are as many as wanted; these are scored exactly.

Largest inner products are sought: vectors of a shard get one more component that lifts them all to the
same length, after which the angle orders them as the inner product does.

Rows go to shards by a hash of their id, each shard builds its forest in memory of bounded size, and query
blocks meet every shard. The nearest of each shard are merged by a top-k that combines before the shuffle.
Every row is indexed, equal vectors of a shard once; nothing limits the partners of a query but k.

On vectors without any structure (the hardest case, see the README) a share of about a third of a shard is
looked at for a recall above 0.9; `wanted` is that number.

Defined results: vectors that are null, all zero, of another length than most, or hold null or non-finite
components take no part, neither as queries nor as candidates; equal scores go to the smaller id; repeated
ids are rows of their own, except that a query's own id is never its candidate; with fewer candidates than
k all are returned; an empty table gives an empty table; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 32
# Small shards are searched more thoroughly: the ascent goes on to this many places at least.
LEAST_WANTED = 4_000
SCORED = "query_id long, vec_id long, score double"


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0.0)
    rows = table.select("vec_id", vector.alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some)


def common_length(rows: DataFrame) -> int:
    """The most frequent vector length, the smaller of equals; 0 for an empty table."""
    lengths = rows.groupBy(F.size("embedding").alias("length")).count()
    found = lengths.orderBy(F.desc("count"), "length").first()
    return found["length"] if found else 0


class Forest:
    """Sorted hash strings of some vectors, one array for each tree."""

    def __init__(self, vectors: np.ndarray, trees: int, seed: int):
        self.vectors = vectors
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * HASH_BITS)).astype(np.float32)
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        lift = np.sqrt(np.maximum(norms.max() - norms, 0)).astype(np.float32)
        codes = self._hash(np.column_stack([vectors, lift]))
        self.order = np.argsort(codes, axis=0, kind="stable").T  # a row for each tree
        self.sorted = np.take_along_axis(codes.T, self.order, axis=1)

    def _hash(self, lifted: np.ndarray) -> np.ndarray:
        """Hash strings as numbers, first digit highest; a column for each tree."""
        trees = self.planes.shape[1] // HASH_BITS
        out = np.empty((len(lifted), trees), np.uint32)
        weights = (np.uint32(1) << np.arange(HASH_BITS - 1, -1, -1, dtype=np.uint32)).astype(np.uint32)
        for tree in range(trees):
            signs = lifted @ self.planes[:, tree * HASH_BITS : (tree + 1) * HASH_BITS] > 0
            out[:, tree] = (signs * weights).sum(axis=1, dtype=np.uint32)
        return out

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query the vectors below the prefixes at which the ascent ends."""
        codes = self._hash(np.column_stack([queries, np.zeros(len(queries), np.float32)]))
        trees, n = self.sorted.shape
        low = np.zeros((trees, len(queries)), np.int64)
        high = np.full((trees, len(queries)), n, np.int64)
        climbing = np.arange(len(queries))
        for depth in range(HASH_BITS, 0, -1):
            if not len(climbing):
                break
            shift = np.uint64(HASH_BITS - depth)
            first = (codes[climbing].astype(np.uint64) >> shift) << shift
            last = first + (np.uint64(1) << shift) - np.uint64(1)
            found = np.zeros(len(climbing), np.int64)
            for tree in range(trees):
                low[tree, climbing] = np.searchsorted(self.sorted[tree], first[:, tree].astype(np.uint32), "left")
                high[tree, climbing] = np.searchsorted(self.sorted[tree], last[:, tree].astype(np.uint32), "right")
                found += high[tree, climbing] - low[tree, climbing]
            climbing = climbing[found < wanted]
        # Those that still climb have reached the roots: everything is a candidate.
        low[:, climbing], high[:, climbing] = 0, n
        seen = np.zeros(n, bool)
        for q in range(len(queries)):
            seen[:] = False
            for tree in range(trees):
                seen[self.order[tree, low[tree, q] : high[tree, q]]] = True
            yield np.flatnonzero(seen)


def search_shard(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, trees: int, wanted: float, seed: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of each query's k nearest among the candidates of one shard."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    distinct, group = np.unique(vectors, axis=0, return_inverse=True)
    group = group.reshape(-1)
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest of a query.
    by_group = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[by_group], np.arange(len(distinct) + 1))
    rounded = distinct.astype(np.float32)
    forest = Forest(rounded, trees, seed)
    asked = queries.astype(np.float32)
    number = max(int(np.ceil(wanted * len(distinct))), LEAST_WANTED)
    for q, near in enumerate(forest.candidates(asked, number)):
        if len(near) > 8 * k:
            # Rounded products leave a wide margin of the best, which are then scored in full precision.
            rough = rounded[near] @ asked[q]
            near = near[np.argpartition(-rough, 8 * k)[: 8 * k]]
        members = np.concatenate([by_group[starts[g] : min(starts[g + 1], starts[g] + k + 1)] for g in near])
        members = members[ids[members] != query_ids[q]]
        scores = vectors[members] @ queries[q]
        best = np.lexsort((ids[members], -scores))[:k]
        yield query_ids[q], ids[members][best], scores[best]


def nearest(
    table: DataFrame,
    every: int = 20,
    k: int = 20,
    trees: int = 96,
    wanted: float = 0.75,
    shard_rows: int = 16_384,
    block_rows: int = 4_096,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    `wanted` is the number of places below the prefixes, counted in each tree, at which the ascent ends,
    as a multiple of the shard's distinct vectors.
    """
    rows = valid_vectors(table)
    length = common_length(rows)
    rows = rows.filter(F.size("embedding") == length)
    count = rows.count()
    shards = max(1, -(-count // shard_rows))
    blocks = max(1, -(-count // (every * block_rows)))
    spread = F.xxhash64("vec_id", "embedding")
    data = rows.select(
        F.pmod(spread, F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "vec_id",
        "embedding",
    )
    asked = rows.filter(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("embedding", "vec_id"), F.lit(blocks)).cast("int").alias("block"),
        "vec_id",
        "embedding",
    )

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        parts = [np.asarray(chunk.flatten()) for chunk in column.chunks]
        return (np.concatenate(parts) if parts else np.zeros(0)).reshape(-1, length)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = search_shard(
                left.column("vec_id").to_numpy(), matrix(left.column("embedding")),
                right.column("vec_id").to_numpy(), matrix(right.column("embedding")), k, trees, wanted, seed,
            )
        parts = [(np.full(len(ids), query), ids, scores) for query, ids, scores in found]
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else empty
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    found = data.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, SCORED)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_query(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
