"""Forgetting visits older than the retention period."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.fixed_values import RETENTION_DAYS
from footfall.functions.times import day_of, days_before, instant, utc
from footfall.schemas import PARTITION_COLUMN
from footfall.settings import parse_retention_days
from footfall.sources.files import exists
from footfall.sources.versions import KEEP_REPLACED, manifest_to_write_by
from footfall.sources.visits_table import read_visits, replace_days


def cutoff(now: datetime, days: int = RETENTION_DAYS) -> Column:
    return days_before(instant(now), parse_retention_days(days))


def retained(visits: DataFrame, now: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Visits at or after the cutoff; whole older days are not read where the table has days."""
    limit = cutoff(now, days)
    kept = F.col("visited_at") >= limit
    if PARTITION_COLUMN in visits.columns:
        kept = (F.col(PARTITION_COLUMN) >= day_of(limit)) & kept
    return visits.filter(kept)


def retention_counts(visits: DataFrame, now: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """One row: how many visits the cutoff keeps and deletes."""
    old = F.col("visited_at") < cutoff(now, days)
    return visits.agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("deleted"))


def prune(
    spark: SparkSession, path: str, now: datetime, days: int = RETENTION_DAYS, keep: timedelta = KEEP_REPLACED
) -> int:
    """Delete visits before the cutoff from the table; the number of rows deleted.

    Older days are forgotten whole, the boundary day is replaced by a copy without its old rows, and all of it counts
    from one moment on. Their files go when they have not counted for the time `keep`, with the next upkeep
    or insert after it.
    """
    if not exists(spark, path):
        return 0
    limit = cutoff(now, days)
    manifest_to_write_by(spark, path)
    boundary_day = (utc(now) - timedelta(days=days)).date()
    day = F.col(PARTITION_COLUMN)
    visits = read_visits(spark, path)
    # Whole days are counted without reading a column, and only one row per day comes back.
    whole_days = visits.filter(day < F.lit(boundary_day)).groupBy(day).agg(F.count("*").alias("n")).collect()
    on_boundary = visits.filter(day == F.lit(boundary_day))
    removed_there, left_there = on_boundary.agg(
        F.count_if(F.col("visited_at") < limit), F.count_if(F.col("visited_at") >= limit)
    ).first()
    changed: dict = {row[PARTITION_COLUMN]: None for row in whole_days}
    if removed_there:
        changed[boundary_day] = on_boundary.filter(F.col("visited_at") >= limit) if left_there else None
    if changed:
        replace_days(spark, path, changed, keep)
    return sum(row["n"] for row in whole_days) + removed_there
