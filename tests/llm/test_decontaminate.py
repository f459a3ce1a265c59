import random

import numpy as np
import pyarrow as pa
import pytest

from footfall.llm import decontaminate
from footfall.llm.common import hashed_words
from tests.llm.data import AWKWARD, SCHEMA, documents, edited, prose

CLASH = ["item_id", "edits", "words", "first_word", "_words"]


def distance(a, b):
    previous = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        current = [i]
        for j in range(1, len(b) + 1):
            current.append(min(previous[j - 1] + (a[i - 1] != b[j - 1]), previous[j] + 1, current[j - 1] + 1))
        previous = current
    return previous[-1]


def test_least_edits_against_every_stretch():
    rng = np.random.default_rng(5)
    for _ in range(150):
        item, text = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(0, 12))
        edits, first, words = decontaminate.least_edits(item, text)
        every = [distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1)]
        assert edits == min(every) == distance(item, text[first : first + words])


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "'y' AS edits")


ITEMS = [(k, prose(7000 + k, 3 + 3 * k)) for k in range(20)]


@pytest.mark.parametrize("rate, least", [(0.0, 1.0), (0.1, 0.95), (0.19, 0.9)])
def test_recall(spark, rate, least):
    rows, wanted = [], set()
    for k, (item, text) in enumerate(ITEMS[4:]):
        for copy in range(4):
            changed = edited(text, int(rate * len(text.split())), 50 * k + copy)
            doc = 100 * item + copy
            rows.append((doc, f"{prose(doc, 5 + 11 * copy)} {changed}. {prose(doc + 7, 30 * copy)}", "en", "s", 0))
            wanted.add((doc, item))
    found = decontaminate.matches(documents(spark, rows, CLASH), benchmark(spark, ITEMS)).collect()
    assert len(wanted & {(r["doc_id"], r["item_id"]) for r in found}) >= least * len(wanted)
    assert {(r["doc_id"], r["item_id"]) for r in found} <= wanted
    assert all(r["edits"] <= 0.2 * len(dict(ITEMS)[r["item_id"]].split()) for r in found)


@pytest.mark.parametrize("rate", [0.1, 0.19])
def test_recall_of_long_items(spark, rate):
    items = [(10 * n + k, prose(9000 + n + k, n)) for n in (31, 63, 127, 255, 350, 800, 1023) for k in range(6)]
    rows = [
        (k, f"{prose(k, 17)} {edited(text, int(rate * len(text.split())), k)}. {prose(k + 1, 40)}", "en", "s", 0)
        for k, (_, text) in enumerate(items)
    ]
    wanted = {(k, item) for k, (item, _) in enumerate(items)}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(documents(spark, rows), benchmark(spark, items)).collect()}
    assert found <= wanted
    for size in (63, 127, 255, 350, 800, 1023):
        assert {pair for pair in wanted if pair[1] // 10 == size} <= found
    assert len(found) >= 0.95 * len(wanted)


def test_an_item_that_repeats_itself(spark):
    """Its windows look alike; it is found, and in time, also with edits and away from where a window begins."""
    item = "again and " * 400 + prose(3, 40)
    text = f"{prose(4, 13)} {edited(item, 60, 5)} {prose(6, 9)}"
    found = decontaminate.matches(documents(spark, [(1, text, "", "", 0), (2, "and again " * 3000, "", "", 0)]), benchmark(spark, [(5, item)])).collect()
    assert (1, 5) in {(r["doc_id"], r["item_id"]) for r in found} and min(r["edits"] for r in found) <= 60


def test_missing_words_never_exceed_the_edits():
    rng = np.random.default_rng(6)
    for _ in range(200):
        item, text = rng.integers(0, 5, rng.integers(1, 9)), rng.integers(0, 5, rng.integers(0, 14))
        assert decontaminate.missing_words(item, text) <= decontaminate.least_edits(item, text)[0]


def test_where_and_how_far(spark):
    item = prose(1, 20)
    words = item.split()
    text = f"{prose(2, 10)} {' '.join(words[:9] + ['other'] + words[10:])} {prose(3, 10)}"
    row = decontaminate.matches(documents(spark, [(1, text, "", "", 0)]), benchmark(spark, [(5, item)])).first()
    assert tuple(row) == (1, 5, 1, 10, 20)


def test_case_and_punctuation_do_not_matter(spark):
    item = prose(1, 20)
    text = f"“{item.upper().replace(' ', ', ')}!”"
    assert decontaminate.matches(documents(spark, [(1, text, "", "", 0)]), benchmark(spark, [(5, item)])).first()["edits"] == 0


def test_clean_documents_and_awkward_rows(spark):
    rows = AWKWARD + [(k, prose(k, 200), "en", "s", 0) for k in range(60)]
    items = ITEMS + [(90, None), (91, ""), (92, "two words"), (None, prose(5, 9)), (93, "z" * 50_000)]
    assert decontaminate.matches(documents(spark, rows, CLASH), benchmark(spark, items)).isEmpty()
    assert decontaminate.matches(spark.createDataFrame([], SCHEMA), benchmark(spark, items)).isEmpty()
    assert decontaminate.matches(documents(spark), benchmark(spark, ITEMS).limit(0)).isEmpty()


def test_repeated_rows_and_many_groups(spark, monkeypatch):
    item = prose(1, 20)
    docs = documents(spark, [(1, item, "", "", 0), (1, item, "", "", 0), (2, item, "", "", 0)])
    items = benchmark(spark, [(5, item), (6, item), *ITEMS[9:]])
    first = sorted(decontaminate.matches(docs, items).collect())
    assert [(r["doc_id"], r["item_id"]) for r in first] == [(1, 5), (1, 5), (1, 6), (1, 6), (2, 5), (2, 6)]
    monkeypatch.setattr(decontaminate, "MAX_GROUP_WORDS", 60)
    assert first == sorted(decontaminate.matches(docs, items).collect())


def test_words():
    chosen = random.Random(1)
    texts = [None, "", "a"] + ["".join(chosen.choice("aB1 .éÉ-“«ß日。\n") for _ in range(chosen.randrange(25))) for _ in range(300)]
    hashes, bounds = hashed_words(pa.array(texts))
    seen = {}
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        assert len(words) == b - a
        assert all(seen.setdefault(h, w) == w for h, w in zip(hashes[a:b].tolist(), words))
    assert len(set(seen.values())) == len(seen)
