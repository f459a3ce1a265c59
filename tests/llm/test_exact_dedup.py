import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from footfall.llm import exact_dedup
from tests.llm.data import AWKWARD, documents, prose


def brute(rows):
    """(id, keep_id, size, sha) of each row, and how many of each group's rows with the kept id there are."""
    groups = defaultdict(list)
    for row in rows:
        groups[hashlib.sha256((row[1] or "").encode()).hexdigest()].append(row[0])
    out = []
    for sha, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named) if named else None
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=str)


def check(spark, rows):
    found = exact_dedup.exact_groups(documents(spark, rows, clash=("digest", "id", "row", "kept", "size", "code")))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    found = found.collect()
    assert sorted([(r[0], r[1], r[2], r[4]) for r in found], key=str) == brute(rows)
    kept = defaultdict(list)
    for r in found:
        if r["kept"]:
            kept[r["text_sha256"]].append(r["doc_id"])
    # Exactly one row of each text stays, the one with the largest id.
    assert {r["text_sha256"]: [r["keep_id"]] for r in found} == kept
    return found


def test_awkward_rows(spark):
    check(spark, AWKWARD + [(None, None, None, None, None), (None, prose(8), "en", "s", 1), (9100, " " + prose(7), "en", "s", 1)])


def test_hot_texts_among_many(spark):
    rows = [(k, "the same text", "en", "src0", 13) for k in range(700)] + [(k, None if k % 2 else "", "en", "src0", 0) for k in range(700, 1000)]
    rows += [(k, prose(k % 800, 5), "en", "src1", 1) for k in range(1000, 2100)]
    rows += [(5000, "the same text", "en", "src0", 13)] * 3
    check(spark, rows)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(documents(spark).limit(0)).collect() == []


def test_empty_partitions(spark):
    before = {key: spark.conf.get(key, None) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, [(k, "hot" if k % 3 else f"text {k}", None, None, 1) for k in range(90)])
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_normalised_text(spark):
    rows = [(1, "A  b", None, None, 1), (2, "a b", None, None, 1), (3, "c", None, None, 1)]
    text = F.lower(F.regexp_replace("text", r"\s+", " "))
    found = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(documents(spark, rows), text=text).collect()}
    assert found == {1: (2, False), 2: (2, True), 3: (3, True)}


def test_summary_names_the_frequent(spark):
    """Digests above the summary's error are named whatever the order and however many others there are."""
    rows = spark.range(200_000, numPartitions=7).select(
        F.sha2(F.when(F.col("id") % 50 == 0, "a").when(F.col("id") % 99 == 1, "b").otherwise(F.col("id").cast("string")), 256).alias("digest")
    )
    named = {r["code"] for r in exact_dedup.frequent(rows).collect()}
    hot = rows.groupBy("digest").count().filter("count > 1").select(F.xxhash64("digest")).collect()
    assert len(hot) == 2 and named >= {r[0] for r in hot} and len(named) <= exact_dedup.MOST_HEAVY


def test_no_python_and_frequent_rows_are_not_shuffled(spark):
    rows = [(k, "hot" if k % 3 else f"text {k}", None, None, 1) for k in range(600)]
    found = exact_dedup.exact_groups(documents(spark, rows))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    # The hot side is a broadcast join; only the side without hot rows is dealt out by digest.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
