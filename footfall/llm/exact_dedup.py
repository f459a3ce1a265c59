"""Exact duplicates by a heavy-hitter split.

Each text is reduced to its SHA-256 once. Misra-Gries summaries of the digests (Spark's frequent-items
sketch; one for each task, merged over groups of tasks and then into one) name the digests that may hold a
large share of all rows. Their exact counts and winners are counted by a sum that combines inside each map
task; this table of at most MOST_HEAVY rows is broadcast, so that rows of frequent digests are settled on the
map side and never shuffled. Every other digest holds too few rows to be hot, and its rows meet by an
ordinary shuffle of (digest, id). DataFrame functions only.

A summary of COUNTERS counters misses no digest above 3.5 / COUNTERS of all rows (0.09 %). One that it misses
below that is only shuffled like the rest: results do not depend on what the summary finds.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays, null ids come
last; of rows equal in both, one stays; an empty table gives an empty table; texts are hashed whole, however
long; other columns are ignored, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import checkpointed, documents, stored

COUNTERS = 4096
MOST_HEAVY = 1000
# Summaries of tasks merge in so many groups before they become one.
MERGE_GROUPS = 256


def digests(docs: DataFrame, id_column: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(id, digest, row) of every row, computed once; `row` tells rows apart that are equal in both."""
    text = F.col("text") if text is None else text
    digest = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
    rows = docs.select(F.col(id_column).alias("id"), digest.alias("digest"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def frequent(rows: DataFrame) -> DataFrame:
    """(code): 64-bit hashes of the digests that a Misra-Gries summary names, MOST_HEAVY at most."""
    codes = rows.select(F.xxhash64("digest").alias("code"))
    group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("group")
    summaries = codes.groupBy(group).agg(F.expr(f"approx_top_k_accumulate(code, {COUNTERS})").alias("summary"))
    # Without a key, an empty partition would give a summary of nothing, which Spark cannot merge.
    whole = summaries.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(summary, {COUNTERS})").alias("summary"))
    named = F.expr(f"approx_top_k_estimate(summary, {MOST_HEAVY})")
    return whole.select(F.explode(named).alias("item")).select(F.col("item.item").alias("code"))


def _winner() -> Column:
    """The row that stays: the largest id, then the first of equal rows."""
    return F.max(F.struct("id", (-F.col("row")).alias("place")))


def heavy(rows: DataFrame) -> DataFrame:
    """(digest, size, winner) of the frequent digests, counted exactly."""
    named = F.broadcast(frequent(rows))
    found = rows.withColumn("code", F.xxhash64("digest")).join(named, "code", "left_semi")
    counted = found.groupBy("digest").agg(F.count("*").alias("size"), _winner().alias("winner"))
    return checkpointed(counted.filter(F.col("size") > 1))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: Column | None = None) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of every row.

    `text` is the normalised text by which rows are compared; by default the column of that name as it is.
    """
    rows = digests(docs, id_column, text)
    same = Window.partitionBy("digest")
    few = F.broadcast(heavy(rows))
    hot, rest = rows.join(few, "digest"), rows.join(few.select("digest"), "digest", "left_anti")
    settled = rest.withColumns({"size": F.count("*").over(same), "winner": _winner().over(same)})
    columns = ["id", "digest", "row", "size", "winner"]
    settled = settled.select(*columns).unionByName(hot.select(*columns))
    return settled.select(
        F.col("id").alias(id_column),
        F.col("winner.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == -F.col("winner.place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_query(spark, sf_dir: str) -> DataFrame:
    """All documents, texts compared as they are."""
    return exact_groups(documents(spark, sf_dir))


EXACT_SQL = """
WITH rows AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER same = 1 AS kept, text_sha256
FROM rows WINDOW same AS (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST)
"""
