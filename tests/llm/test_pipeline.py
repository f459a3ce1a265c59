import random

import pytest

import corpus_pipeline as pipeline
from footfall.llm.common import stored
from tests.llm.data import SCHEMA, edited, prose

PASSAGE = prose(4242, 25)


def rows():
    found = [(k, ". ".join(prose(20 * k + j, 12) for j in range(6)) + ".", "en", f"src{k % 3}", 1) for k in range(400)]
    for k in range(40):  # bad text of the kinds the classifier meets in the given tables
        text = prose(60_000 + k, 60)
        found.append((1000 + k, [text.upper().replace(" ", "!! "), text.replace(" ", "$$$ ")][k % 2], "en", "src0", 1))
    found += [(2000 + k, found[k][1], "en", "src1", 1) for k in range(20)]
    found += [(2100 + k, edited(found[30 + k][1], 1, k), "en", "src1", 1) for k in range(20)]
    found += [(2200 + k, f"{prose(70_000 + k, 30)}. {PASSAGE}. {prose(71_000 + k, 30)}.", "en", "src2", 1) for k in range(10)]
    found += [(2300 + k, f"{prose(72_000 + k, 40)}. Write to me{k}@mail.example.org now. {prose(73_000 + k, 20)}.", "en", "src2", 1) for k in range(10)]
    found += [(2400, None, None, None, None), (2401, "", "en", "src0", 0), (None, prose(9, 60), "en", "src0", 0), (2402, prose(9, 40_000), "en", None, 0)]
    random.Random(1).shuffle(found)
    return found


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "'x' AS size", "1 AS node").write.parquet(f"{root}/documents.parquet")
    labels = [(k, int(k < 400), 0) for k in range(0, 400, 2)] + [(1000 + k, 0, 0) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_every_stage_takes_effect(spark, folder):
    docs = pipeline.documents(spark, folder)
    kept = []
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "stage")
        kept.append({r["doc_id"]: r for r in docs.collect()})
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    quality, unique, clean, private, mix = kept
    assert sum(1000 + k in quality for k in range(40)) <= 8 and sum(k in quality for k in range(400)) >= 390
    assert all((2000 + k in unique) + (k in unique) <= 1 for k in range(20))
    assert sum((2100 + k in unique) + (30 + k in unique) <= 1 for k in range(20)) == 20
    assert set(unique) >= {k for k in range(50, 400) if k in quality}
    assert not any(2200 + k in clean for k in range(10)) and set(clean) == {k for k in unique if k is None or not 2200 <= k < 2210}
    assert set(private) == set(clean)
    for k in range(2300, 2310):
        assert k not in private or "<EMAIL>" in private[k]["text"] and "@" not in private[k]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in private.values() if r["text"] is not None)
    assert set(mix) <= set(private) and all(0 < r["taken"] <= 2 * r["size"] for r in mix.values())


def test_run_gives_the_last_stage(spark, folder):
    found = pipeline.run(spark, folder)
    assert {"doc_id", "text", "copies", "part", "taken"} <= set(found.columns) and found.count() > 100


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


AWKWARD = [
    (None, f"{prose(80_001, 30)}. {PASSAGE}. {prose(80_002, 30)}.", "en", "src0", 1),
    (None, prose(80_003, 90), "en", "src0", 1),
    (None, edited(prose(80_003, 90), 1, 5), "en", "src1", 1),
    (None, prose(80_004, 90), "en", None, 1),
    (5, f"{prose(80_005, 30)}. {PASSAGE}. {prose(80_006, 30)}.", "en", "src0", 1),
    (5, prose(80_007, 90), "en", "src0", 1),
    (6, prose(80_008, 90), "en", "src0", 1),
    (6, prose(80_008, 90), "en", "src0", 1),
    (7, edited(prose(80_008, 90), 1, 6), "en", "src0", 1),
    (8, None, "en", "src0", 1),
    (None, None, "en", "src0", 1),
    (9, prose(80_007, 90), "en", "src1", 1),
]


def kept(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_null_and_repeated_ids(spark, folder):
    """Rows are judged by their own text: near copies and benchmark items without an id, two texts under one id."""
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    unique = pipeline.one_of_each(spark, docs, folder)
    assert kept(unique) == sorted({(i, t) for i, t, *_ in [AWKWARD[k] for k in (0, 3, 4, 5, 6, 9, 10)]} | {min((r for r in kept(unique) if r[0] is None and r[1] in (AWKWARD[1][1], AWKWARD[2][1])), key=str)}, key=str)
    clean = pipeline.without_benchmark(spark, docs, folder)
    assert kept(clean) == sorted(((i, t) for k, (i, t, *_) in enumerate(AWKWARD) if k not in (0, 4)), key=str)


def test_every_row_of_the_mix_has_its_own_answer(spark, folder):
    from footfall.llm import mixing

    docs = spark.createDataFrame(AWKWARD * 2, SCHEMA)
    found = pipeline.mixed(spark, docs, folder)
    alone = mixing.mix(docs).filter("taken > 0")
    answers = lambda frame: sorted(map(str, frame.select("doc_id", "source", "size", "target", "taken").collect()))
    assert answers(found) == answers(alone)
    texts = {t for _, t, *_ in AWKWARD}
    assert all(r["text"] in texts and r["size"] == len(r["text"].split()) for r in found.collect())
