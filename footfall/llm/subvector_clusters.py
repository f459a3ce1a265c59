"""Centroid clustering over losslessly dictionary-encoded subvectors.

Vectors become whole numbers, floor(scale * x), and are cut into shards of bounded size where they lie. In a
shard every block of dimensions has a dictionary of its distinct subvectors, and a vector is the codes of its
blocks; nothing is lost. Blocks begin with one dimension, and neighbours become one block while the shard has
few distinct pairs of their subvectors for its number of vectors, so copies and coarse vectors get wide blocks.

In each round a shard computes the exact distance of every distinct subvector to every centroid once; a
vector's distance is the sum of the partial distances its codes point to. What a task gives back is one row
per centroid: how many vectors it got and the sums of their components, again from counts of codes. Spark adds
these up. Rounds need no shuffle of vectors; what is broadcast is the centroids.

All arithmetic is on 64-bit integers, so results depend on no order. Ties go to the centroid of the smaller number;
a centroid without vectors stays as it is.

Defined results: vectors that are null, of another length than `dims`, or hold null or non-finite components
take no part; repeated ids are vectors of their own, a null id is the text "null" in the seeded order; of
equal places in that order the lesser vector comes first; fewer vectors than `k` give so many centroids; an
empty table gives an empty table; other columns are ignored, whatever their names. A component of MOST or more
after scaling has no exact distance in 64 bits: the job then ends with an error that says so.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import stored

SHARD_ROWS = 16_384
# Neighbouring blocks become one while that leaves this share of a shard's vectors as distinct subvectors.
WIDEST_SHARE = 0.125
# 64 squared differences of numbers below this fit 64 bits.
MOST = 1 << 27
ENCODED = "ids array<bigint>, starts array<int>, entries array<array<int>>, codes array<array<int>>"


def whole_numbers(table: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and numbers (array<int>) of the vectors that take part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select("vec_id", vector.alias("embedding")).filter((F.size("embedding") == dims) & finite)
    too_large = F.exists("embedding", lambda x: F.abs(x * scale) >= float(MOST))
    numbers = F.transform("embedding", lambda x: F.floor(x * scale).cast("int"))
    refused = F.raise_error(F.lit(f"a component times {scale} is {MOST} or more")).cast("array<int>")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(too_large, refused).otherwise(numbers).alias("numbers"))


class Shard:
    """Some vectors as dictionaries of subvectors (`entries`, from dimension `starts` on) and codes into them."""

    def __init__(self, starts: list[int], entries: list[np.ndarray], codes: list[np.ndarray]):
        self.starts, self.entries, self.codes = starts, entries, codes

    @classmethod
    def encode(cls, vectors: np.ndarray) -> "Shard":
        blocks = []
        for at in range(vectors.shape[1]):
            values, codes = np.unique(vectors[:, at], return_inverse=True)
            blocks.append((at, values[:, None], codes.reshape(-1)))
        most, merged = int(WIDEST_SHARE * len(vectors)), True
        while merged and len(blocks) > 1:
            merged, wider, k = False, [], 0
            while k < len(blocks):
                if k + 1 < len(blocks):
                    (at, left, a), (_, right, b) = blocks[k], blocks[k + 1]
                    pairs, codes = np.unique(a * len(right) + b, return_inverse=True)
                    if len(pairs) <= max(1, most):
                        entries = np.hstack([left[pairs // len(right)], right[pairs % len(right)]])
                        wider.append((at, entries, codes.reshape(-1)))
                        merged, k = True, k + 2
                        continue
                wider.append(blocks[k])
                k += 1
            blocks = wider
        starts, entries, codes = zip(*blocks)
        return cls(list(starts), [e.astype(np.int64) for e in entries], list(codes))

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distance of every vector to every centroid."""
        total = np.zeros((len(self.codes[0]), len(centroids)), np.int64)
        for start, entries, codes in zip(self.starts, self.entries, self.codes):
            part = centroids[:, start : start + entries.shape[1]]
            total += ((entries[:, None, :] - part[None]) ** 2).sum(axis=2)[codes]
        return total

    def sums(self, clusters: np.ndarray, k: int) -> np.ndarray:
        """Componentwise sums of the vectors of each cluster."""
        out = []
        for entries, codes in zip(self.entries, self.codes):
            counts = np.bincount(codes * k + clusters, minlength=len(entries) * k).reshape(len(entries), k)
            out.append(counts.T @ entries)
        return np.hstack(out)


def encoded(numbers: DataFrame, dims: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per shard; vectors stay in the task that read them."""

    def shard(ids: list, vectors: list) -> pa.RecordBatch:
        found = Shard.encode(np.concatenate(vectors))
        columns = {
            "ids": pa.array([[i for part in ids for i in part.to_pylist()]], pa.list_(pa.int64())),
            "starts": pa.array([found.starts], pa.list_(pa.int32())),
            "entries": _nested([e.reshape(-1) for e in found.entries]),
            "codes": _nested(found.codes),
        }
        return pa.RecordBatch.from_pydict(columns)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, rows = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, shard_rows):
                piece = batch.slice(start, shard_rows)
                if rows + piece.num_rows > shard_rows:
                    yield shard(ids, vectors)
                    ids, vectors, rows = [], [], 0
                ids.append(piece.column("vec_id"))
                vectors.append(np.asarray(piece.column("numbers").flatten()).reshape(-1, dims))
                rows += piece.num_rows
        if rows:
            yield shard(ids, vectors)

    return stored(numbers.mapInArrow(encode, ENCODED), "subvectors")


def _nested(arrays: list[np.ndarray]) -> pa.Array:
    """One row: a list of lists."""
    bounds = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    inner = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(arrays).astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array([0, len(arrays)], pa.int32()), inner)


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Shard]]:
    for k in range(batch.num_rows):
        codes = [np.asarray(c.values) for c in batch.column("codes")[k]]
        entries = [np.asarray(e.values).astype(np.int64) for e in batch.column("entries")[k]]
        # Every entry has a code that points to it.
        entries = [e.reshape(int(c.max()) + 1, -1) for e, c in zip(entries, codes)]
        yield batch.column("ids")[k].values, Shard(batch.column("starts")[k].as_py(), entries, codes)


def totals(shards: DataFrame, centroids: np.ndarray) -> list:
    """cluster, n, distance, sums of the vectors nearest to each centroid."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, shard in _shards(batch):
                distance = shard.distances(centroids)
                clusters = distance.argmin(axis=1)
                n += np.bincount(clusters, minlength=k)
                np.add.at(far, clusters, distance[np.arange(len(clusters)), clusters])
                sums += shard.sums(clusters, k)
        rows = np.flatnonzero(n)
        columns = [pa.array(rows, pa.int32()), pa.array(n[rows]), pa.array(far[rows]), pa.array(list(sums[rows]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "distance", "sums"])

    found = shards.mapInArrow(add, "cluster int, n bigint, distance bigint, sums array<bigint>")
    each = F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums")
    return found.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("distance").alias("distance"), each).collect()


def first_centroids(numbers: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids come first in the seeded order."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    first = numbers.select(F.sha2(key, 256).alias("place"), "numbers").orderBy("place", "numbers").limit(k)
    return np.array([row["numbers"] for row in first.collect()], np.int64)


def clusters(
    table: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, cluster_size of every vector that takes part."""
    spark = table.sparkSession
    numbers = whole_numbers(table, dims, scale)
    centroids = first_centroids(numbers, k, seed)
    facts = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, cluster_size bigint"
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id bigint, distance bigint, {facts}").select("vec_id", "cluster", "distance", *[f.split()[0] for f in facts.split(", ")[1:]])
    shards = encoded(numbers, dims, shard_rows)
    for _ in range(rounds):
        for row in totals(shards, centroids):
            # Floor division of whole numbers, also below zero.
            centroids[row["cluster"]] = np.array(row["sums"], np.int64) // row["n"]
    last = totals(shards, centroids)
    inertia = sum(row["distance"] for row in last)
    described = spark.createDataFrame([(row["cluster"], row["distance"], inertia, ",".join(map(str, centroids[row["cluster"]].tolist())), row["n"]) for row in last], facts)
    described = described.withColumn("centroid_sha256", F.sha2("centroid_sha256", 256))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, shard in _shards(batch):
                distance = shard.distances(centroids)
                nearest = distance.argmin(axis=1)
                columns = [ids, pa.array(nearest, pa.int32()), pa.array(distance[np.arange(len(nearest)), nearest])]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    assigned = shards.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint")
    # k rows at most.
    joined = assigned.join(F.broadcast(described), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")


def clusters_query(spark, sf_dir: str) -> DataFrame:
    """All vectors of 64 components, 8 centroids, 10 rounds."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def clusters_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same rounds, written out one after the other."""

    def assigned(n: int) -> str:
        return f"""
far{n} AS (
  SELECT row, c.cluster, CAST(sum((p.v - c.v) * (p.v - c.v)) AS BIGINT) AS distance
  FROM parts p JOIN c{n} c ON p.dim = c.dim GROUP BY row, c.cluster),
near{n} AS MATERIALIZED (
  SELECT row, cluster, distance FROM far{n} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)"""

    steps = []
    for n in range(rounds):
        steps.append(assigned(n))
        steps.append(f"""
sums{n} AS (
  SELECT cluster, dim, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM parts JOIN near{n} USING (row) GROUP BY cluster, dim),
c{n + 1} AS MATERIALIZED (
  SELECT cluster, dim, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{n} LEFT JOIN sums{n} USING (cluster, dim))""")
    finite = "len([x for x in embedding if x IS NOT NULL AND isfinite(x)])"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id,
         [CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT) for x in embedding] AS numbers
  FROM embeddings WHERE len(embedding) = {dims} AND {finite} = {dims}),
parts AS MATERIALIZED (
  SELECT row, unnest(range(1, {dims + 1})) AS dim, unnest(numbers) AS v FROM kept),
first AS (
  SELECT numbers, row_number() OVER (ORDER BY place, numbers) - 1 AS cluster FROM (
    SELECT numbers, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS place FROM kept)
  QUALIFY cluster < {k}),
c0 AS MATERIALIZED (SELECT cluster, unnest(range(1, {dims + 1})) AS dim, unnest(numbers) AS v FROM first),
{",".join(steps)},
{assigned(rounds)},
named AS (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256,
       count(*) OVER (PARTITION BY cluster) AS cluster_size
FROM near{rounds} JOIN kept USING (row) JOIN named USING (cluster)
"""


CLUSTERS_SQL = clusters_sql()
