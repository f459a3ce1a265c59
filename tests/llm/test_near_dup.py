import numpy as np
import pyarrow as pa
import pytest

from footfall.llm import bag_minhash, near_dup
from footfall.llm.components import components
from tests.llm.data import AWKWARD, SCHEMA, documents, edited, prose

CLASH = ["node", "buckets", "bucket", "label", "class_id", "leader", "size", "_low"]


def bag_of(text):
    hashes, bounds = near_dup.hashed_words(pa.array([text], pa.string()))
    owner, shingles, counts = bag_minhash.bags(*bag_minhash.shingle_hashes(hashes, bounds))
    return shingles, counts


def test_similarity_by_hand():
    # "a b c d e a b c d e": 6 shingles, of which "a b c d e" is there twice.
    one, two = bag_of("a b c d e a b c d e"), bag_of("A, b c d e!")
    assert bag_minhash.similarity(*one, *two) == pytest.approx(1 / 6)
    assert sorted(one[1].tolist()) == [1, 1, 1, 1, 2]


def test_signatures_are_unbiased_for_multisets():
    rng = np.random.default_rng(3)
    m, errors = 512, []
    for _ in range(40):
        keys = rng.integers(1, 1 << 62, 60).astype(np.uint64)
        a, b = rng.integers(0, 12, 60), rng.integers(0, 12, 60)
        b = np.where(rng.random(60) < 0.6, a, b)
        owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        found = bag_minhash.signatures(owner, np.concatenate([keys[a > 0], keys[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, m)
        errors.append((found[0] == found[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.035


def test_signatures_do_not_depend_on_company():
    hashes, counts = bag_of(prose(1))
    alone = bag_minhash.signatures(np.zeros(len(hashes), np.int64), hashes, counts, 1, 64)
    more_hashes, more_counts = bag_of(prose(2))
    owner = np.repeat([0, 1], [len(more_hashes), len(hashes)])
    both = bag_minhash.signatures(owner, np.concatenate([more_hashes, hashes]), np.concatenate([more_counts, counts]), 2, 64)
    assert (both[1] == alone[0]).all()


def plain_classes(rows, threshold=0.8):
    """Connected components of all links, by comparing everything with everything."""
    bags = [bag_of(text) if text else None for _, text, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if rows[x][1] is None or rows[y][1] is None:
                continue
            if rows[x][1] == rows[y][1] or (bags[x] and bags[y] and bag_minhash.similarity(*bags[x], *bags[y]) >= threshold):
                parent[max(find(x), find(y))] = min(find(x), find(y))
    groups = {}
    for x in range(len(rows)):
        groups.setdefault(find(x), []).append(rows[x][0])
    return sorted((sorted(g, key=str) for g in groups.values()), key=str)


def found_classes(frame):
    groups = {}
    for row in frame.collect():
        groups.setdefault(row["class_id"], []).append(row["doc_id"])
    return sorted((sorted(g, key=str) for g in groups.values()), key=str)


def near_copies():
    """Groups of near copies at every distance from a base, chains of edits, exact copies, unrelated texts."""
    rows, n = [], 0
    for base in range(3):
        text = prose(base, 90)
        for k in range(40):
            rows.append((n, edited(text, k % 6, 1000 * base + k), "en", "s", 0))
            n += 1
        for _ in range(5):
            rows.append((n, text, "en", "s", 0))
            n += 1
    chain = prose(77, 90)
    for k in range(8):
        rows.append((n, chain, "en", "s", 0))
        chain, n = edited(chain, 1, k), n + 1
    return rows + [(n + k, prose(300 + k, 40), "en", "s", 0) for k in range(30)]


@pytest.mark.parametrize("small", [32, 2])
def test_classes_against_all_pairs(spark, small):
    """With small = 2 nearly every bucket counts as a large one."""
    rows = near_copies()
    found = near_dup.near_duplicates(documents(spark, rows, CLASH), bands=40, rows=4, small=small)
    assert found_classes(found) == plain_classes(rows)


def test_a_hot_group_at_the_registered_bands(spark):
    """A group of 250 near copies, strays that share parts of it, at 20 bands of 5 rows and the registered sizes."""
    text = prose(5, 120)
    rows = [(k, edited(text, k % 3, 50 + k), "en", "s", 0) for k in range(250)]
    rows += [(1000 + k, edited(text, 18 + k % 6, 900 + k), "en", "s", 0) for k in range(60)]
    rows += [(2000 + k, text[: 60 * (k + 1)] + " " + prose(600 + k, 60), "en", "s", 0) for k in range(8)]
    rows += [(None, edited(text, 1, 4000), "en", "s", 0), (None, edited(prose(9, 70), 1, 4001), "en", "s", 0), (None, prose(9, 70), "en", "s", 0)]
    found = near_dup.near_duplicates(documents(spark, rows))
    wanted = plain_classes([(-k if i is None else i, *rest) for k, (i, *rest) in enumerate(rows)])
    # A pair at the threshold may meet in no bucket (probability 0.0004 at 0.8), so no class may be too large ...
    classes = [{i for i in group if i is not None} for group in found_classes(found)]
    parts = [{i for i in group if i >= 0} for group in wanted]
    assert all(any(c <= w for w in parts) for c in classes)
    # ... and the hot one is found whole.
    assert max(map(len, classes)) == max(map(len, parts)) >= 250


def test_pairs_of_one_component_are_not_joined(spark, monkeypatch):
    """All members of the hot bucket are linked by its leader, so no pair of them is measured again."""
    asked, measure = [], near_dup.measure
    monkeypatch.setattr(near_dup, "measure", lambda pairs, bags: (asked.append(pairs), measure(pairs, bags))[1])
    text = prose(5, 120)
    rows = [(k, edited(text, k % 3, 50 + k), "en", "s", 0) for k in range(120)]
    found = near_dup.near_duplicates(documents(spark, rows))
    assert len(found_classes(found)) == 1
    assert asked[1].count() == 0


def test_awkward_rows(spark):
    rows = AWKWARD + [(9101, "", "en", "s", 0), (9102, "!!! ...", "en", "s", 0), (9103, "two words", "en", "s", 0), (9104, "Two WORDS.", "en", "s", 0)]
    found = near_dup.near_duplicates(documents(spark, rows, CLASH))
    assert found.count() == len(rows)
    classes = {r["doc_id"]: r["class_id"] for r in found.collect()}
    assert classes[9002] == classes[9101] == 9002 and classes[9004] == classes[9102] == 9004
    assert classes[9103] == classes[9104] == 9103 and classes[9001] == 9001 and classes[9003] == 9003
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 100), (100, 200), (300, 300)], "a long, b long")
    found = {r["node"]: r["label"] for r in components(links).collect()}
    assert found == {k: 0 for k in range(61)} | {100: 100, 200: 100}
