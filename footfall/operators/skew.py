"""Joins to a keyed lookup that stay balanced when one key holds most of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys with fewer rows than this fit one task; hotter ones are cut into shares of this size.
ROWS_PER_SHARE = 1_000_000
# Shares grow with the total beyond this many of them, so that fewer keys than this can be hot.
MOST_SHARES = 1024


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str,
    key_counts: DataFrame | None = None,
    rows_per_share: int = ROWS_PER_SHARE,
) -> DataFrame:
    """Join (inner, left, left_semi) facts to a lookup with few rows per key, cutting hot keys into shares.

    Hot keys are found by counting: those with more rows than a share. A share is `rows_per_share` rows, or
    1/MOST_SHARES of all rows where that is more, so fewer than MOST_SHARES keys are hot whatever the data,
    and every key beyond a share is cut. Their rows spread over shares by a hash of the whole row, and only
    their lookup rows repeat per share. Facts should hold no more than a few equal rows. `key_counts`
    (key, n) may be given where the counts are at hand.
    """
    counts = key_counts if key_counts is not None else facts.groupBy(key).agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(rows_per_share), F.ceil(counts.agg(F.sum("n")).scalar() / MOST_SHARES))
    hot = counts.filter(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("_shares"))
    # Fewer than MOST_SHARES rows, so both broadcasts are bounded.
    hot = F.broadcast(hot)
    shares = F.coalesce("_shares", F.lit(1))
    row_hash = F.xxhash64(*[F.col(name) for name in facts.columns])
    salted = (
        facts.join(hot, key, "left")
        .withColumn("_share", F.pmod(row_hash, shares).cast("int"))
        .drop("_shares")
    )
    repeated = (
        lookup.join(hot, key, "left")
        .withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
        .drop("_shares")
    )
    return salted.join(repeated, [key, "_share"], how).drop("_share")
