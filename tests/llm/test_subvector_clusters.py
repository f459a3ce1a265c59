import hashlib

import numpy as np
import pytest

from footfall.llm import subvector_clusters
from footfall.llm.subvector_clusters import Shard


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return frame.selectExpr("*", "1 AS cluster", "2 AS distance", "'x' AS numbers", "'y' AS codes")


def plain(vectors, ids, k=8, rounds=10, dims=64):
    """Lloyd's rounds with Python's whole numbers."""
    rows = []
    for i, v in zip(ids, vectors):
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            rows.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    place = lambda row: (hashlib.sha256(f"3:{'null' if row[0] is None else row[0]}".encode()).hexdigest(), row[1])
    centroids = [list(v) for _, v in sorted(rows, key=place)[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in rows]
        if turn == rounds:
            break
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(rows, near) if m == n]
            if own:
                centroids[n] = [sum(column) // len(own) for column in zip(*own)]
    inertia = sum(d for d, _ in near)
    by = {n: sum(d for d, m in near if m == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, by[n], inertia, sha[n]) for (i, _), (d, n) in zip(rows, near)), key=str)


def found(frame):
    return sorted((tuple(r)[:6] for r in frame.collect()), key=str)


@pytest.mark.parametrize("shard_rows", [16_384, 37])
def test_equals_plain_rounds(spark, shard_rows):
    vectors = np.random.default_rng(5).standard_normal((150, 64)) * 0.2
    vectors[50:80] = vectors[50]
    vectors[100:130] = np.round(vectors[100:130])
    ids = [*range(140), *range(10)]
    got = found(subvector_clusters.clusters(table(spark, vectors, ids).repartition(3), shard_rows=shard_rows))
    assert got == plain(vectors, ids)


def test_rows_that_take_no_part(spark):
    good = np.random.default_rng(6).standard_normal((5, 64))
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63]
    vectors, ids = [*good, *bad, [0.0] * 64], [1, 2, None, 2, 5, *range(20, 27), 30]
    got = found(subvector_clusters.clusters(table(spark, vectors, ids)))
    assert got == plain(vectors, ids) and len(got) == 6


def test_empty_table(spark):
    empty = subvector_clusters.clusters(table(spark, [[0.0] * 64]).limit(0))
    full = subvector_clusters.clusters(table(spark, [[0.0] * 64]))
    assert empty.collect() == [] and empty.dtypes == full.dtypes


def test_component_beyond_64_bits_is_refused(spark):
    with pytest.raises(Exception, match="a component times 1024"):
        subvector_clusters.clusters(table(spark, [[1e9] * 64])).collect()


def test_encoding_loses_nothing():
    rng = np.random.default_rng(7)
    for vectors in (rng.integers(-(2**27) + 1, 2**27, (300, 9)), rng.integers(-2, 2, (300, 9)), np.full((300, 9), -3), rng.integers(0, 9, (1, 9))):
        shard = Shard.encode(vectors)
        assert np.array_equal(np.hstack([e[c] for e, c in zip(shard.entries, shard.codes)]), vectors)
        centroids = vectors[: min(4, len(vectors))]
        wanted = ((vectors[:, None].astype(object) - centroids[None].astype(object)) ** 2).sum(axis=2)
        assert np.array_equal(shard.distances(centroids).astype(object), wanted)
        clusters = np.arange(len(vectors)) % 3
        assert np.array_equal(shard.sums(clusters, 3), np.array([vectors[clusters == c].sum(axis=0) for c in range(3)]))


def test_copies_share_wide_blocks():
    assert len(Shard.encode(np.tile([[1, 2, 3, 4]], (1000, 1))).starts) == 1
    assert len(Shard.encode(np.random.default_rng(8).integers(0, 1000, (1000, 8))).starts) == 8
