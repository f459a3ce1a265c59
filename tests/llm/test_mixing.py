import re

import pytest
from pyspark.sql import functions as F

from footfall.llm import mixing
from tests.llm.data import AWKWARD, SCHEMA, documents, prose

CLASH = ["size", "taken", "target", "part", "copies", "place", "_bucket", "weight", "ordinal", "_source"]


def plain_targets(sizes, weights, total, epochs):
    """Share by weight, clamp, share what is left again, until nobody is above."""
    full = {}
    while True:
        left = total - sum(full.values())
        open_weight = sum(w for s, w in weights.items() if s not in full)
        targets = {s: full.get(s, left * w / open_weight if open_weight else 0) for s, w in weights.items()}
        over = [s for s in targets if s not in full and targets[s] >= epochs * sizes[s]]
        if not over:
            return targets
        full.update({s: epochs * sizes[s] for s in over})


def rows_of(n=120):
    return [(k, prose(k, 5 + k % 40), "en", f"src{k % 7 if k % 3 else 0}", 0) for k in range(n)]


def expected(rows, share=1.5, epochs=2.0):
    count = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weights = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    return sizes, plain_targets(sizes, weights, share * sum(sizes.values()), epochs)


@pytest.mark.parametrize("rows", [rows_of(), AWKWARD, rows_of() + AWKWARD])
def test_targets_and_words(spark, rows):
    found = mixing.mix(documents(spark, rows, CLASH)).collect()
    assert len(found) == len(rows)
    sizes, targets = expected(rows)
    for source in sizes:
        own = [r for r in found if r["source"] == source]
        assert {r["source_size"] for r in own} == {sizes[source]}
        assert all(abs(r["target"] - targets[source]) < 1e-6 * max(1, targets[source]) for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[source]) <= 1
        assert sum(0 < r["part"] < r["size"] for r in own) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = documents(spark, rows_of())
    first = sorted(mixing.mix(docs).collect())
    assert first == sorted(mixing.mix(docs.repartition(7, "text")).collect())
    assert first != sorted(mixing.mix(docs, seed=8).collect())


def test_many_sources_are_joined_in_shares(spark, monkeypatch):
    docs = documents(spark, rows_of() + AWKWARD)
    first = sorted(mixing.mix(docs).collect(), key=str)
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert first == sorted(mixing.mix(docs).collect(), key=str)


def test_named_weights_and_too_little_text(spark):
    docs = documents(spark, rows_of())
    weights = spark.createDataFrame([("src0", 1.0), ("src1", 0.0), ("src9", 5.0)], "source string, weight double")
    found = mixing.mix(docs, share=0.1, weights=weights).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert {r["source"] for r in found if r["n"]} == {"src0"}
    everything = mixing.mix(docs, share=9.0, max_epochs=3.0)
    assert everything.filter("taken != 3 * size").isEmpty()


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_reruns_agree_where_ids_repeat(spark):
    """Rows of one id follow each other by size, whatever order they come in."""
    rows = [(1, prose(k, 3 + k), "en", "src0", 0) for k in range(12)] + [(None, prose(k, 20 + k), "en", "src0", 0) for k in range(5)]
    found = set()
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        taken = mixing.mix(documents(spark, order).repartition(3), share=0.7, carry=("text",))
        found.add(str(sorted(map(str, taken.select("doc_id", "size", "taken", "text").collect()))))
    assert len(found) == 1
