"""Mix sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Each source has a weight and may be repeated at most `max_epochs` times. The wanted total is shared by
weight; what a source cannot take beyond its cap is shared among the others by weight, until no source is
above its cap. A source then gives whole repetitions of all its documents, and a fraction of one more:
its documents in a seeded order, up to the word at which the target is reached, so that only one document
of a source is taken in part. Rows that share an id follow each other by size, so that reruns agree.
DataFrame functions only.

Defined results: a null or empty text has size 0 and nothing is taken of it; a null source is a source of
its own, last in order; repeated rows are documents of their own; an empty table gives an empty table;
other columns are ignored. If the caps do not add up to the total, every source is taken to its cap.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import checkpointed, ordinals, stored

WORD = r"[^\x20\x09-\x0D]+"
# The seeded order is summed in buckets of its first hexadecimal digits, so that no window holds a source.
BUCKET_DIGITS = 4
MAX_BROADCAST_SOURCES = 100_000
SALTS = 32


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, the place of each document in the seeded order, and columns to be carried along."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return docs.select("doc_id", "source", word_count("text").alias("size"), key.alias("place"), *carry)


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """Give sources in code-point order, null last, the weights of a repeating cycle."""
    numbered = ordinals(sources, [F.col("source").asc_nulls_last()])
    weights = F.array(*[F.lit(float(x)) for x in cycle])
    return numbered.withColumn("weight", F.element_at(weights, (F.col("ordinal") % len(cycle) + 1).cast("int"))).drop("ordinal")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add each source's target; `sources` has source, source_size and weight.

    The common level (words for each unit of weight) only rises from round to round, and each round is
    an aggregate over the sources; it ends when no further source is at its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, full = 0.0, -1
    while True:
        at_cap = cap <= F.col("weight") * F.lit(level)
        now = sources.agg(
            F.count(F.when(at_cap, 1)).alias("full"),
            F.sum(F.when(at_cap, cap).otherwise(0.0)).alias("used"),
            F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if now["full"] == full or not now["open"]:
            break
        full, level = now["full"], (total - now["used"]) / now["open"]
    if full >= 0 and not now["open"]:
        level = float("inf")
    target = F.least(cap, F.when(F.lit(level == float("inf")), cap).otherwise(F.col("weight") * F.lit(level)))
    return sources.withColumn("target", target)


def mix(
    docs: DataFrame,
    share: float = 1.5,
    max_epochs: float = 2.0,
    cycle: tuple[int, ...] = (3, 1, 2),
    weights: DataFrame | None = None,
    seed: int = 7,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole repetitions), part (words of one more), taken.

    Other columns may be carried along, so that each row keeps its own answer.

    `weights` (source, weight) may name the weights; a source it does not name gets none. Otherwise they
    repeat `cycle` over the sources in code-point order.
    """
    sized = stored(sizes(docs, seed, carry), "sized")
    totals = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    if weights is None:
        weighted = cyclic_weights(totals, cycle)
    else:
        named = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        weighted = totals.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        weighted = weighted.fillna(0.0, ["weight"])
    weighted = checkpointed(weighted)
    words = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    targets = water_fill(weighted, share * words, max_epochs)
    wanted = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("_copies", whole)
    targets = checkpointed(targets.withColumn("_rest", wanted - F.col("_copies") * F.col("source_size")))

    bucket = F.conv(F.substring("place", 1, BUCKET_DIGITS), 16, 10).cast("long")
    sized = sized.withColumn("_bucket", bucket)
    sums = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_in"))
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(running), F.lit(0)))
    # The bucket in which the rest of a source is reached; there is one where the rest is above 0.
    edge = _by_source(sums, targets.select("source", "_rest")).filter(
        (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_in") >= F.col("_rest"))
    )
    edge = checkpointed(edge.select("source", F.col("_bucket").alias("_edge"), F.col("_before").alias("_start")))
    targets = checkpointed(_by_source(targets, edge, "left"))

    placed = _by_source(sized, targets.drop("weight"), "left")
    at_edge = F.col("_bucket").eqNullSafe(F.col("_edge"))
    order = ["place", "doc_id", "size", *([F.xxhash64(*carry)] if carry else [])]
    within = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - before))
    edges = placed.filter(at_edge).withColumn("part", left)
    others = placed.filter(~at_edge).withColumn("part", F.when(F.col("_bucket") < F.col("_edge"), F.col("size")).otherwise(F.lit(0)))
    taken = F.col("_copies") * F.col("size") + F.col("part")
    return edges.unionByName(others).select(
        "doc_id", "source", "size", "source_size", "target", F.col("_copies").alias("copies"), "part", taken.alias("taken"), *carry
    )


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, nulls alike, to a checkpointed table with one row per source.

    A table of up to MAX_BROADCAST_SOURCES rows is broadcast; beyond, its rows repeat in SALTS shares over
    which the rows of a hot source are spread.
    """
    right = right.withColumnRenamed("source", "_source")
    same = left["source"].eqNullSafe(right["_source"])
    if right.count() <= MAX_BROADCAST_SOURCES:
        return left.join(F.broadcast(right), same, how).drop("_source")
    right = right.withColumn("_right_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    return left.join(right, same & (F.col("_salt") == F.col("_right_salt")), how).drop("_source", "_salt", "_right_salt")


def mixing_query(spark, sf_dir: str) -> DataFrame:
    """All documents, 150 % of their words, weights 3, 1, 2, at most 2 repetitions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         source_size * 2.0::DOUBLE AS cap FROM sources),
ordered AS (
  SELECT *, sum(cap) OVER w AS used, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
           ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS open
  FROM weighted WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
total AS (SELECT sum(source_size) * 1.5::DOUBLE AS t, sum(weight) AS w FROM weighted),
levels AS (
  SELECT t / w AS level FROM total
  UNION ALL SELECT (t - used) / open FROM ordered, total WHERE open > 0),
level AS (
  SELECT min(level) AS level FROM levels, total
  WHERE abs((SELECT sum(least(cap, weight * level)) FROM weighted) - t) <= 1e-9 * t),
targets AS (
  SELECT source, source_size, least(cap, weight * level) AS target FROM weighted, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT d.*, p.source_size, p.target, p.whole, CAST(round(target) AS BIGINT) - whole * source_size AS rest,
         coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken,
       CAST(whole AS BIGINT) AS copies, CAST(greatest(0, least(size, rest - before)) AS BIGINT) AS part
FROM placed"""
