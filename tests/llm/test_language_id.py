import pytest
from pyspark.sql import functions as F

from footfall.llm import language_id
from footfall.llm.common import fold
from tests.llm.data import AWKWARD, SCHEMA, documents

CLASH = ["lang_pred", "score", "_rank", "_place", "_share"]
SYLLABLES = {
    "en": "the and ing tion er of th wh ow".split(),
    "de": "der und ung sch ich keit ein au pf".split(),
    "fr": "eau oux aux ment que ion ai tre é".split(),
    "es": "ción ado ña que ez llo ue os ra".split(),
    "xx": "zzu qqo kki vvu".split(),
}


def rows(per_language=60, words=30):
    found = []
    for lang, syllables in SYLLABLES.items():
        for k in range(per_language):
            text = " ".join(syllables[(k * 7 + w * w) % len(syllables)] + syllables[(k + 3 * w) % len(syllables)] for w in range(words))
            found.append((len(found), text.upper() if k % 9 == 0 else text, lang, "s", 0))
    return found


def test_held_out_documents(spark):
    docs = documents(spark, rows(), CLASH).withColumn("held_out", fold("doc_id", 4) == 2)
    found = language_id.identify(docs, language_id.train(docs.filter(~F.col("held_out")), per_language=30))
    truth = {r[0]: r[2] for r in rows()}
    held = [r for r in found.collect() if r["held_out"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_families_come_first(spark):
    model = language_id.train(documents(spark, rows(20)))
    assert model.families == {"germanic": ["de", "en"], "other": ["xx"], "romance": ["es", "fr"]}
    assert [(d.first, d.second) for d in model.language_duels["romance"]] == [("es", "fr")]
    assert len(model.family_duels) == 3


def test_the_same_model_whatever_the_partitions(spark):
    docs = documents(spark, rows(20))
    one, two = language_id.train(docs), language_id.train(docs.repartition(5, "text"))
    assert (one.family_duels[0].weights == two.family_duels[0].weights).all()


def test_awkward_rows(spark):
    model = language_id.train(documents(spark, rows(20)))
    docs = documents(spark, AWKWARD, CLASH).withColumn("held_out", F.lit(True))
    found = language_id.identify(docs, model).collect()
    assert len(found) == len(AWKWARD)
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert und == {9001, 9002, 9003, 9004} and all(r["score"] == 0 for r in found if r["doc_id"] in und)
    assert language_id.identify(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("languages, expected", [((), ("und", 0.0)), (("fr",), ("fr", 1.0))])
def test_no_or_one_language(spark, languages, expected):
    docs = documents(spark, [r for r in rows(5) if r[2] in languages]) if languages else spark.createDataFrame([], SCHEMA)
    asked = documents(spark, [(1, "un texte", None, None, 0)]).withColumn("held_out", F.lit(False))
    row = language_id.identify(asked, language_id.train(docs)).first()
    assert (row["lang_pred"], row["score"]) == expected
