"""From kept requests to visits, one per key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.device import with_device
from footfall.functions.privacy import ip_hash
from footfall.functions.text import non_empty
from footfall.functions.times import day_of
from footfall.schemas import PARTITION_COLUMN, VISIT, VISIT_COLUMNS, VISIT_KEY


def describe(requests: DataFrame, salt: str) -> DataFrame:
    """Everything about a visit that its own request tells; the address stays until it is located."""
    return with_device(requests).select(
        F.col("host").alias("site"),
        "path",
        "engaged",
        "browser",
        "os",
        "device_kind",
        ip_hash(F.col("remote_ip"), salt).alias("ip_hash"),
        non_empty(F.col("referrer")).alias("referrer"),
        F.col("at").alias("visited_at"),
        "remote_ip",
    )


def as_visits(located: DataFrame) -> DataFrame:
    """The stored columns and their day; lookups that were not made are null, the address is gone."""

    def column(name: str) -> Column:
        if name in located.columns:
            return F.col(name)
        return F.lit(None).cast(VISIT[name].dataType).alias(name)

    return located.select(*[column(name) for name in VISIT_COLUMNS]).withColumn(
        PARTITION_COLUMN, day_of(F.col("visited_at"))
    )


def one_per_key(visits: DataFrame, first: str | None = None) -> DataFrame:
    """Keep one visit per key: an engaged one first, then the least by the remaining columns.

    Where visits have an order, `first` names its column and the first visit is kept. A minimum over a struct
    combines before the shuffle, so any number of copies of one line leaves each task as a single row.
    """
    others = [name for name in visits.columns if name not in (*VISIT_KEY, "engaged", first)]
    order = [] if first is None else [first]
    least = F.min(F.struct(*order, (~F.col("engaged")).alias("only_looked"), *others))
    merged = visits.groupBy(*VISIT_KEY).agg(least.alias("first"))
    columns = {name: F.col(name) for name in VISIT_KEY} | {name: F.col(f"first.{name}") for name in [*order, *others]}
    columns["engaged"] = ~F.col("first.only_looked")
    return merged.select(*[columns[name].alias(name) for name in visits.columns])


def not_stored(visits: DataFrame, stored: DataFrame) -> DataFrame:
    """Visits whose key the table does not hold; both sides have one row per key.

    Looking up which of these keys are stored first lets a small batch be broadcast against a large
    table; a plain anti join would shuffle the table's keys for every batch.
    """
    already = stored.select(*VISIT_KEY).join(visits.select(*VISIT_KEY), VISIT_KEY, "left_semi")
    return visits.join(already, VISIT_KEY, "left_anti")
