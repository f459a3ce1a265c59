import os
import zlib

import numpy as np
import pytest

from footfall.llm import quality
from tests.llm.data import AWKWARD, SCHEMA, batch, documents, prose

CLASH = ["_place", "row", "features"]
SF_DIR = "/root/testdata/sf0.1"


def rows(n=1600):
    found = []
    for k in range(n):
        text = ". ".join(prose(20 * k + j, 12) for j in range(6)) + "."
        if k % 8 == 0:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", " | "), text.replace(" ", "$$$ "), (prose(k, 2) + " ") * 40][k // 8 % 4]
        found.append((k, text, "en", "s", 0))
    return found


def test_bad_text_is_found_without_bad_examples(spark):
    docs = documents(spark, rows())
    trusted = spark.createDataFrame([(k,) for k in range(1600) if k % 8 and k % 3 == 0], "doc_id long")
    model = quality.train(docs, trusted)
    assert 0.75 <= model.prior <= 0.98
    found = {r["doc_id"]: r["accepted"] for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    good, bad = [found[k] for k in range(1600) if k % 8], [found[k] for k in range(1600) if k % 8 == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.2


@pytest.mark.skipif(not os.path.isdir(SF_DIR) and not os.path.exists(SF_DIR), reason="test tables are not here")
def test_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    found = [r for r in quality.quality_query(spark, SF_DIR).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in found)
    right = [r["predicted"] == labels[r["doc_id"]] for r in found]
    clean = [r["predicted"] for r in found if labels[r["doc_id"]] == 1]
    assert np.mean(right) >= 0.97 and np.mean(clean) >= 0.98


def test_prior_of_a_mixture():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, 4000)
    for share in (0.3, 0.6, 0.9):
        unlabelled = np.concatenate([rng.normal(2, 1, int(6000 * share)), rng.normal(-2, 1, int(6000 * (1 - share)))])
        assert abs(quality.estimate_prior(positive, unlabelled) - share) < 0.08


def test_the_same_model_whatever_the_partitions(spark):
    docs = documents(spark, rows(80))
    trusted = docs.filter("doc_id % 8 != 0").select("doc_id")
    one, two = quality.train(docs, trusted), quality.train(docs.repartition(5, "text"), trusted)
    assert (one.weights == two.weights).all()


def test_features_do_not_depend_on_company():
    texts = [r[1] for r in AWKWARD]
    together = quality.features(batch(texts))
    assert np.isfinite(together).all()
    for k, text in enumerate(texts):
        assert np.allclose(quality.features(batch([text]))[0], together[k])


def test_awkward_rows(spark):
    docs = documents(spark, rows(80))
    model = quality.train(docs, docs.filter("doc_id % 8 != 0").select("doc_id"))
    found = quality.score(documents(spark, AWKWARD, CLASH), model).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r["quality_score"] <= 1 for r in found)
    assert quality.score(spark.createDataFrame([], SCHEMA), model).collect() == []
    untrained = quality.train(docs, docs.limit(0).select("doc_id"))
    assert {r["quality_score"] for r in quality.score(docs, untrained).collect()} == {0.5}
