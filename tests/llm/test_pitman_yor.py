import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from footfall.llm import common, pitman_yor
from footfall.llm.common import fold
from tests.llm.data import AWKWARD, SCHEMA, documents, prose

CLASH = ["token", "n", "context", "score", "key", "copies", "base"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(n=150):
    """Every other word is decided by the one before it, so contexts help."""
    found = []
    for k in range(n):
        words = prose(k, 30).split()
        text = " ".join(w if j % 2 else f"{w} After_{w[:2]}" for j, w in enumerate(words))
        found.append((k, text, "en", "s", 0))
    return found


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def scored(spark, table, **options):
    docs = documents(spark, table, CLASH).withColumn("held_out", fold("doc_id", 7) == 2)
    dishes, model = pitman_yor.train(docs.filter(~F.col("held_out")), **options)
    return pitman_yor.score(docs, dishes, model, head=40), dishes, model


def test_base_scores_and_counts(spark):
    table = rows() + AWKWARD
    found = scored(spark, table)[0].collect()
    assert len(found) == len(table)
    train = Counter(t for row in table if row[0] is None or zlib.crc32(str(row[0]).encode()) % 7 != 2 for t in tokens(row[1]))
    total, distinct = sum(train.values()), len(train)
    texts = {}
    for row in table:
        texts.setdefault(row[0], []).append(row[1])
    for r in found:
        words = tokens(texts[r["doc_id"]][0])
        assert r["train_tokens"] == total and r["n_tokens"] == len(words)
        assert r["n_known"] == sum(train[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in words), rel=1e-9)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["score"] < 0


def test_held_out_text_is_predicted_better_than_by_the_base(spark):
    found = [r for r in scored(spark, rows())[0].collect() if r["held_out"]]
    assert found and np.mean([r["score"] > r["base_score"] for r in found]) > 0.95


def test_probabilities_add_up_to_one(spark):
    """After every context, over all known tokens and one unknown, in each sample and on average."""
    _, dishes, model = scored(spark, rows(40), contexts=6)
    predicted = pitman_yor.predictive(dishes, model, pitman_yor.BURN_IN).collect()
    kept = model.totals[pitman_yor.BURN_IN + 1 :]
    shares = np.column_stack([model.passed_on(t) for t in kept])
    unknown = np.array([float(model.parent_probability(0, 0, t)) for t in kept])
    assert np.allclose(sum(np.array(r["parent"]) for r in predicted) + unknown, 1)
    for context in range(len(model.frequent)):
        total = (shares[context] * unknown).mean()
        for r in predicted:
            own = dict(zip(r["contexts"], r["extra"])).get(context, 0.0)
            total += (shares[context] * np.array(r["parent"])).mean() + own
        assert total == pytest.approx(1)


def test_every_context_has_a_restaurant(spark):
    """Of 300 words that decide the next one, all are learned, however many are as frequent; scores against a plain sum."""
    table = [(k, " ".join(f"c{w} d{w}" for w in range(k % 10, 300, 10)), "en", "s", 0) for k in range(80)]
    # Fold 2 is held out: one document with the words that follow, one with the same words changed around.
    one, two = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    table += [(one, "c7 d7 c207 d207 c291 d291", "en", "s", 0), (two, "c7 d207 c207 d291 c291 d7", "en", "s", 0)]
    found, _, model = scored(spark, table)
    score = {r["doc_id"]: r["score"] for r in found.collect()}
    assert score[one] > score[two] + 6 * 0.5
    assert model.contexts.count() == len({w for row in table[:80] if zlib.crc32(str(row[0]).encode()) % 7 != 2 for w in tokens(row[1])})
    # What a restaurant gives its own cells and passes on add up to one, and so do the parent's probabilities.
    parents = {r["token"]: [r[f"parent_{k}"] for k in range(3)] for r in model.by_token().collect()}
    assert np.allclose(np.sum(list(parents.values()), axis=0) + model.unknown(), 1)
    own, cells = Counter(), {}
    for r in model.often().unionByName(model.once()).collect():
        own[r["context"]] += r["own"]
        cells[r["context"], r["token"]] = r["own"]
    shares = {r["context"]: (r["scale"], [r[f"passed_{k}"] for k in range(3)]) for r in model.by_context().collect()}
    assert all(own[c] / scale + np.mean(passed) == pytest.approx(1) for c, (scale, passed) in shares.items())
    for doc in (one, two):
        codes, hashes, _ = pitman_yor.tokens(pa.array([row[1] for row in table if row[0] == doc]))
        total = 0.0
        for before, token in zip(hashes[np.concatenate([[0], codes[:-1]])].tolist(), hashes[codes].tolist()):
            scale, passed = shares[before]
            total += math.log10(cells.get((before, token), 0.0) / scale + np.mean(np.array(passed) * parents[token]))
        assert score[doc] == pytest.approx(total)


def test_seating_bounds_and_tables():
    n = np.array([0, 1, 2, 50, 5000, 10_000_000])
    key = np.arange(6, dtype=np.uint64) * np.uint64(977)
    ones = np.ones(6)
    tables = pitman_yor.seat(n, 5.0 * ones, 0.3 * ones, 0.5, key)
    assert tables[0] == 0 and tables[1] == 1 and (tables <= n).all() and (np.diff(tables) >= 0).all()
    assert (pitman_yor.seat(n, 5.0 * ones, 0.3 * ones, 0.5, key) == tables).all()
    # Against seating one by one with another generator: the same mean number of tables.
    rng, many = np.random.default_rng(1), []
    for _ in range(300):
        t = 1
        for i in range(1, 200):
            weight = (5.0 + 0.5 * t) * 0.3
            t += rng.random() < weight / (weight + i - 0.5 * t)
        many.append(t)
    keys = np.arange(3000, dtype=np.uint64) * np.uint64(7919)
    drawn = pitman_yor.seat(np.full(3000, 200), np.full(3000, 5.0), np.full(3000, 0.3), 0.5, keys)
    assert abs(drawn.mean() - np.mean(many)) < 0.25


def test_the_same_scores_whatever_the_partitions(spark):
    table = rows(40)
    first = sorted(scored(spark, table)[0].collect(), key=str)
    docs = documents(spark, table).withColumn("held_out", fold("doc_id", 7) == 2).repartition(7, "text")
    dishes, model = pitman_yor.train(docs.filter(~F.col("held_out")))
    again = sorted(pitman_yor.score(docs, dishes, model, head=3).collect(), key=str)
    assert [r["doc_id"] for r in first] == [r["doc_id"] for r in again]
    assert all(a["score"] == pytest.approx(b["score"], rel=1e-5) for a, b in zip(first, again))


def test_empty_and_untrained(spark):
    assert scored(spark, [])[0].collect() == []
    held = [(k, prose(k, 5), "en", "s", 0) for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    found = scored(spark, held)[0].collect()
    assert len(found) == 3 and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in found)
    assert spark.createDataFrame([], SCHEMA).count() == 0


def test_tokens():
    codes, hashes, bounds = pitman_yor.tokens(pa.array(["A b a", None, "", " x\t"]))
    assert bounds.tolist() == [0, 4, 5, 6, 8]
    assert codes[[3, 4, 5, 7]].tolist() == [0, 0, 0, 0] and codes[0] == codes[2] != codes[1]
    assert len(set(hashes.tolist())) == len(hashes) == 4


def test_tokens_of_a_piece_of_a_batch():
    """`slices` hands on parts of an array, whose text begins somewhere inside its buffers."""
    texts = pa.array([f"Long Text {k} before " * 50 + prose(k, 20) for k in range(40)])
    for part, whole in zip(pitman_yor.tokens(texts.slice(25, 3)), pitman_yor.tokens(pa.array(texts.slice(25, 3).to_pylist()))):
        assert part.tolist() == whole.tolist()


def by_row(found):
    return sorted(found.collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"]))


def test_the_same_scores_however_many_blocks_and_passes(spark, monkeypatch):
    table = rows(60) + AWKWARD
    one = by_row(scored(spark, table)[0])
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(pitman_yor, "PASSES", 3)
    found, _, model = scored(spark, table)
    several = by_row(found)
    assert model.blocks > 3 and model.counted.count() > 1 and len(one) == len(several) == len(table)
    for a, b in zip(one, several):
        assert [a[c] for c in ("doc_id", "held_out", "n_tokens", "n_known")] == [b[c] for c in ("doc_id", "held_out", "n_tokens", "n_known")]
        assert a["score"] == pytest.approx(b["score"], rel=1e-9) and a["base_score"] == pytest.approx(b["base_score"], rel=1e-9)


def test_only_what_is_still_read_stays_on_disk(spark, tmp_path, monkeypatch):
    """Of all sweeps one state stays, and of the whole query its scores."""

    def tables(folder):
        monkeypatch.setattr(common, "shared_dir", lambda spark: str(folder))
        return lambda: sorted(x.name.partition("-")[0] for x in (folder / "llm").iterdir())

    stays = tables(tmp_path / "trained")
    pitman_yor.train(documents(spark, rows(20)))
    assert stays() == ["cells", "state"]
    stays = tables(tmp_path / "scored")
    documents(spark, rows(20)).write.parquet(f"{tmp_path}/documents.parquet")
    assert pitman_yor.scoring_query(spark, str(tmp_path)).count() == 20
    assert stays() == ["scores"]
