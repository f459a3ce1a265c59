"""The visits table: Parquet partitioned by UTC day, one row per key, one writer at a time.

Which files of a day count is said by the table's manifest (see `versions`): days are rewritten and forgotten
beside what is read, so no step of it can lose or double a visit.
"""

from collections.abc import Iterable
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.times import day_of
from footfall.operators.visits import as_visits, not_stored
from footfall.schemas import PARTITION_COLUMN, STORED_VISIT, VERSION_COLUMN, VISIT_KEY
from footfall.session import MOST_VALUES_PUSHED, prepare
from footfall.sources.files import children, exists, total_bytes
from footfall.sources.summaries import is_summarised, refresh
from footfall.sources.versions import (
    KEEP_REPLACED,
    commit,
    day_folder,
    day_names,
    manifest_to_write_by,
    read_manifest,
    sweep,
    version_of_day,
)

# A lookup of stored keys asks for at most this many ranges of time; the nearest ones become one.
MOST_RANGES = 100
# Batches of up to so many visits ask the table for their own visitors only.
MOST_VISITORS_ASKED = MOST_VALUES_PUSHED
# Files say which visitors they may hold, so that such a batch opens few row groups; the rate of false alarms.
_VISITOR_FILTER = {"parquet.bloom.filter.enabled#ip_hash": "true", "parquet.bloom.filter.fpp#ip_hash": "0.01"}
_VERSIONED = T.StructType([*STORED_VISIT.fields, T.StructField(VERSION_COLUMN, T.IntegerType())])


def read_visits(spark: SparkSession, path: str, days: Iterable[date] | None = None) -> DataFrame:
    """All stored visits, or those of some days; files older than a column read it back as null.

    With `days` only their folders are listed. Every day is read in the version that counts at this moment.
    """
    prepare(spark)
    if days is None:
        folders = [path] if exists(spark, path) else []
    else:
        there = set(day_names(spark, path))
        folders = [day_folder(path, day) for day in days if str(day) in there]
    if not folders:
        return spark.createDataFrame([], STORED_VISIT)
    manifest = read_manifest(spark, path)
    if manifest is None:
        return spark.read.schema(STORED_VISIT).option("basePath", path).parquet(*folders)
    versions = spark.read.schema(_VERSIONED).option("basePath", path).parquet(*folders)
    return versions.filter(F.col(VERSION_COLUMN) == version_of_day(manifest)).drop(VERSION_COLUMN)


def append_visits(visits: DataFrame, path: str) -> None:
    """Append without looking for duplicates (see insert_if_absent).

    Rebalancing gives each day few files; a day far larger than the rest is split over tasks. Rows in
    order of time let readers skip row groups outside the hours they ask for.
    """
    version = version_of_day(manifest_to_write_by(visits.sparkSession, path))
    balanced = visits.select(*STORED_VISIT.fieldNames()).hint("rebalance", PARTITION_COLUMN)
    versioned = balanced.withColumn(VERSION_COLUMN, version)
    ordered = versioned.sortWithinPartitions(PARTITION_COLUMN, VERSION_COLUMN, "visited_at")
    ordered.write.options(**_VISITOR_FILTER).mode("append").partitionBy(PARTITION_COLUMN, VERSION_COLUMN).parquet(path)


def time_ranges(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """At most `most` ranges that cover some spans, by closing the smallest gaps between them."""
    spans = sorted(spans)
    gaps = sorted(range(1, len(spans)), key=lambda n: spans[n][0] - spans[n - 1][1], reverse=True)
    starts = sorted([0, *gaps[: most - 1]]) if spans else []
    ends = [*starts[1:], len(spans)]
    return [(spans[a][0], max(last for _, last in spans[a:b])) for a, b in zip(starts, ends)]


def day_spans(visits: DataFrame) -> list[Row]:
    """The days that some visits touch, each with its first and last time in microseconds and its number of visits."""
    at = F.col("visited_at")
    ends = [F.unix_micros(F.min(at)).alias("first"), F.unix_micros(F.max(at)).alias("last")]
    return visits.groupBy(day_of(at).alias("day")).agg(*ends, F.count("*").alias("visits")).collect()


def stored_keys(spark: SparkSession, path: str, visits: DataFrame, spans: list[Row] | None = None) -> DataFrame:
    """Keys stored within the times that some visits cover (`spans`, where they are known).

    Only the days they touch are read, and of those only the row groups that reach into their hours and, where the
    visits are few, may hold one of their visitors.
    """
    day, at = F.col(PARTITION_COLUMN), F.col("visited_at")
    spans = day_spans(visits) if spans is None else spans
    if not spans:
        return read_visits(spark, path, []).select(*VISIT_KEY)
    # A few late visits must not widen the hours asked of the other days.
    ranges = time_ranges([(span["first"], span["last"]) for span in spans], MOST_RANGES)
    hours = [at.between(*[F.timestamp_micros(F.lit(end)) for end in span]) for span in ranges]
    days = sorted(span["day"] for span in spans)
    covered = day.isin(days) & reduce(or_, hours)
    if sum(span["visits"] for span in spans) <= MOST_VISITORS_ASKED:
        covered = covered & F.col("ip_hash").isin([row.ip_hash for row in visits.select("ip_hash").distinct().collect()])
    return read_visits(spark, path, days).filter(covered).select(*VISIT_KEY)


def insert_if_absent(spark: SparkSession, visits: DataFrame, path: str, complete=as_visits) -> None:
    """Append the visits whose key is not stored yet; what is stored first stays.

    `visits` holds one row per key. `complete` turns the ones to be stored into stored columns, so
    that lookups are not spent on copies of what is there already. Running it again with the same
    visits, after a failure at any point, adds nothing twice. A table that has summaries keeps them.
    """
    if not exists(spark, path):
        append_visits(complete(visits), path)
        return
    # Before anything is read: a table older than versions is adopted, which moves its files.
    manifest_to_write_by(spark, path)
    sweep(spark, path)
    visits = visits.persist()
    try:
        spans = day_spans(visits)
        fresh = not_stored(visits, stored_keys(spark, path, visits, spans))
        # Lookups read their tables whatever the number of visits; none are made where nothing is new.
        if complete is as_visits or not fresh.isEmpty():
            append_visits(complete(fresh), path)
            if is_summarised(spark, path):
                refresh(spark, path, [span["day"] for span in spans])
    finally:
        visits.unpersist()


def replace_days(
    spark: SparkSession, path: str, days: dict[date, DataFrame | None], keep: timedelta = KEEP_REPLACED
) -> None:
    """Put other rows in the place of those of some days, all at once; None in the place of a day forgets it.

    New rows are written beside the ones they replace and count from the moment the manifest names them. What
    they replace is removed by a later `sweep`, when it has not counted for the time `keep`.
    """
    manifest = manifest_to_write_by(spark, path)
    changes = {str(day): manifest.version(day) + 1 for day in days}
    for day, visits in days.items():
        # What a run that was cut short has left under this version does not count.
        if visits is not None:
            balanced = visits.drop(PARTITION_COLUMN).hint("rebalance").sortWithinPartitions("visited_at")
            balanced.write.options(**_VISITOR_FILTER).mode("overwrite").parquet(day_folder(path, day, changes[str(day)]))
    commit(spark, path, manifest, changes)
    sweep(spark, path, keep)


def compact(
    spark: SparkSession, path: str, most_files: int = 16, keep: timedelta = KEEP_REPLACED
) -> list[date]:
    """Rewrite the days that consist of more than `most_files` files, as streams leave them; those days.

    A day is rewritten in files of the size adaptive execution aims at, in order of time. Days whose files
    would not become fewer are left alone.
    """
    rewritten = []
    manifest = manifest_to_write_by(spark, path) if exists(spark, path) else None
    for name in day_names(spark, path):
        folder = day_folder(path, name, manifest.version(name))
        files = [file for file in children(spark, folder) if file.startswith("part-")]
        day = date.fromisoformat(name)
        if len(files) > most_files and spark_files(spark, folder) < len(files):
            replace_days(spark, path, {day: read_visits(spark, path, [day])}, keep)
            rewritten.append(day)
    return rewritten


def spark_files(spark: SparkSession, folder: str) -> int:
    """How many files of the advisory size hold a folder's bytes."""
    advisory = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    )
    return 1 + total_bytes(spark, folder) // advisory
