import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from footfall.llm import lexical_search
from tests.llm.data import AWKWARD, WORDS, documents, prose


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' AS term", "1 AS times", "2 AS doc_id")


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(lexical_search.TERM, lowered)


def plain(docs, asked, k=20):
    held = [(row[0], terms(row[1])) for row in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    texts = {}
    for item, text in set(asked):
        texts.setdefault(item, []).extend(terms(text))
    out = []
    for item, wanted in texts.items():
        scored = []
        for i, t in held:
            m, score = 100 - 25 + (25 * len(t) * n) // total, 0
            for term in wanted:
                if tf := t.count(term):
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += w * ((10**9 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def check(spark, docs, asked, k=20):
    table = documents(spark, docs, clash=("n", "terms", "times", "item_id", "term")).repartition(3)
    found = lexical_search.ranked(table, items(spark, asked), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == plain(docs, asked, k)
    return got


ASKED = [(1, prose(7)), (2, "日本語 text One WORD"), (3, None), (4, "!!!"), (5, "nothing there"), (6, "one one one word")]


def test_awkward_rows(spark):
    more = [(9001, prose(9), None, None, 1), (None, prose(8), None, None, 1), (None, prose(10), None, None, 1)]
    assert check(spark, AWKWARD + more, ASKED + [(6, "word of " + prose(3)), (6, "one one one word"), (None, prose(8)), (None, prose(2))])


@pytest.mark.parametrize("shard_docs", [16_384, 50])
def test_equals_plain_scores(spark, monkeypatch, shard_docs):
    """Skewed words, a third of the documents equal, items of up to 150 words (more than 64 different ones)."""
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard_docs)
    chosen = random.Random(4)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    text = lambda n: " ".join(chosen.choices(WORDS, weights, k=n))
    docs = [(k, "the hot text " + WORDS[0] if k % 3 == 0 else text(chosen.randrange(1, 60)), "en", "s", 1) for k in range(600)]
    asked = [(k, text(chosen.choice([1, 3, 12, 150]))) for k in range(25)] + [(30, " ".join(WORDS[:100])), (31, "the hot text")]
    check(spark, docs, asked, 7)


def test_item_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "GROUP_TERMS", 40)
    docs = [(k, prose(k, 30), "en", "s", 1) for k in range(60)]
    check(spark, docs, [(k, prose(100 + k, 12)) for k in range(9)])


def test_empty_tables(spark):
    assert check(spark, AWKWARD, ASKED[2:4]) == []
    assert lexical_search.ranked(documents(spark).limit(0), items(spark, ASKED)).collect() == []
    assert lexical_search.ranked(documents(spark), items(spark, ASKED).limit(0)).collect() == []


def test_masks_below_the_kth_score_are_left_out(monkeypatch):
    """Documents with one frequent term are never scored once documents with a rare one fill the ranks."""
    terms_, ends = [], [0]
    for k in range(1000):
        terms_ += [0, 1] if k < 40 else [0]
        ends.append(len(terms_))
    shard = lexical_search.Shard(pa.array(range(1000)), np.full(1000, 10), np.array(terms_), np.ones(len(terms_), np.int64), np.array(ends), (1000, 10_000))
    looked, add = [], lexical_search.Best.add
    monkeypatch.setattr(lexical_search.Best, "add", lambda self, s, i, u: (looked.append(len(s)), add(self, s, i, u))[1])
    best = lexical_search.Best(20)
    shard.search([(0, 5), (1, 3000)], best)
    assert best.ids.tolist() == list(range(20)) and sum(looked) <= 64


def test_terms():
    texts = ["A1-ñÉ\x00b c", None, "", "x_y", "tail "]
    found, bounds = lexical_search.terms_of(pa.array(texts))
    assert [found.to_pylist()[a:b] for a, b in zip(bounds, bounds[1:])] == [terms(t) for t in texts]
    piece, cut = lexical_search.terms_of(pa.array(["first", *texts])[1:])
    assert piece.to_pylist() == found.to_pylist() and cut.tolist() == bounds.tolist()
