import numpy as np
import pytest

from footfall.llm import lsh_forest


def table(spark, vectors, ids=None):
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS query_id", "2 AS score", "'x' AS shard")


def brute(vectors, ids, every, k):
    wanted = {}
    vectors = np.asarray(vectors, np.float32).astype(float)
    for q, query in enumerate(vectors):
        if ids[q] % every == 0:
            scored = sorted((-(float(query @ v)), i) for i, v in zip(ids, vectors) if i != ids[q])
            wanted[ids[q]] = scored[:k]
    return wanted


@pytest.mark.parametrize("shard_rows", [16_384, 400])
def test_recall_on_unstructured_vectors(spark, shard_rows):
    vectors = np.random.default_rng(2).standard_normal((1500, 32))
    vectors *= np.linspace(0.5, 1.5, 1500)[:, None]
    found = lsh_forest.nearest(table(spark, vectors), shard_rows=shard_rows, block_rows=40).collect()
    wanted = brute(vectors, list(range(1500)), 20, 20)
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(wanted)
    hits = [len({r["vec_id"] for r in by[q]} & {i for _, i in wanted[q]}) / 20 for q in wanted]
    assert np.mean(hits) >= 0.9
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        exact = np.float32(vectors).astype(float)
        assert all(abs(r["score"] - exact[r["vec_id"]] @ exact[q]) < 1e-9 for r in rows)


def test_equal_vectors_and_ties(spark):
    """A third of the rows are one vector: the smallest ids come first, and others are still found."""
    rng = np.random.default_rng(4)
    vectors = [np.ones(8) if k % 3 == 0 else rng.standard_normal(8) for k in range(300)]
    found = lsh_forest.nearest(table(spark, vectors), every=20, k=5, shard_rows=70)
    wanted = brute(vectors, list(range(300)), 20, 5)
    for q, rows in wanted.items():
        got = [(r["rank"], r["vec_id"]) for r in found.filter(f"query_id = {q}").orderBy("rank").collect()]
        assert got == [(n + 1, i) for n, (_, i) in enumerate(rows)]


def test_rows_that_take_no_part(spark):
    vectors = [[1, 0], [0, 1], None, [0, 0], [None, 1], [float("nan"), 1], [float("inf"), 1], [1, 2, 3], [], [1, 1], [-1, 0]]
    found = lsh_forest.nearest(table(spark, vectors, [0, 1, 2, 3, 20, 40, 60, 80, 100, 120, 7]), k=20).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in by.items()} == {
        0: [(1, 120, 1.0), (2, 1, 0.0), (3, 7, -1.0)],
        120: [(1, 0, 1.0), (2, 1, 1.0), (3, 7, -1.0)],
    }


def test_empty_and_alone(spark):
    assert lsh_forest.nearest(table(spark, [[1.0, 2.0]]).limit(0)).collect() == []
    assert lsh_forest.nearest(table(spark, [[1.0, 2.0]])).collect() == []


def test_longest_prefixes_are_found():
    """Every candidate shares at least as long a prefix with the query as any vector left out, in some tree."""
    vectors = np.random.default_rng(6).standard_normal((200, 6)).astype(np.float32)
    forest = lsh_forest.Forest(vectors, 1, 3)
    codes = np.empty(200, np.uint32)
    codes[forest.order[0]] = forest.sorted[0]
    for query, found in zip(vectors[:10], forest.candidates(vectors[:10], 15)):
        own = forest._hash(np.append(query, np.float32(0))[None])[0, 0]
        shared = 32 - np.array([int(own ^ c).bit_length() for c in codes])
        assert len(found) >= 15 and shared[found].min() > np.delete(shared, found).max(initial=-1)
