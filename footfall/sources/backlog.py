"""Backlog files: visits waiting for the table, one JSON object per line, in the order in which they were written."""

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.documents import visit_document
from footfall.operators.visits import as_visits, one_per_key
from footfall.schemas import BACKLOG, VISIT_COLUMNS
from footfall.sources.files import exists, remove_file_named
from footfall.sources.visits_table import insert_if_absent

_RENAMED = {"device_kind": "kind", "ip_hash": "ipHash", "visited_at": "at", "org_domain": "orgDomain"}

# What every visit has; a line without one of these is no visit.
REQUIRED = ("site", "path", "engaged", "browser", "os", "kind", "ipHash", "at")
_CORRUPT = "_corrupt"
# When a line was written, in microseconds; lines from elsewhere have the time of their file.
WRITTEN = "seq"


@dataclass(frozen=True)
class Backlog:
    """What one listing of a backlog holds: every reading of it, and its removal, is about the same files."""

    lines: DataFrame | None
    files: list[str]

    @classmethod
    def listed(cls, spark: SparkSession, path: str) -> "Backlog":
        if not exists(spark, path):
            return cls(None, [])
        text = spark.read.option("lineSep", "\n").text(path)
        lines = text.select("value", F.unix_micros("_metadata.file_modification_time").alias("_changed"))
        schema = T.StructType([*BACKLOG.fields, T.StructField(WRITTEN, T.LongType()), T.StructField(_CORRUPT, T.StringType())])
        read = lines.filter(F.trim("value") != "").withColumn("visit", F.from_json("value", schema, {"columnNameOfCorruptRecord": _CORRUPT}))
        complete = F.col(f"visit.{_CORRUPT}").isNull()
        for name in REQUIRED:
            complete = complete & F.col(f"visit.{name}").isNotNull()
        return cls(read.withColumn("whole", F.coalesce(complete, F.lit(False))), text.inputFiles())

    def visits(self) -> DataFrame | None:
        """Waiting visits and when they were written (`seq`); lines that are no whole visit are left out."""
        if self.lines is None:
            return None
        written = F.coalesce(f"visit.{WRITTEN}", "_changed").alias("_written")
        return self.lines.filter("whole").select("visit.*", written).select(*_from_backlog(), F.col("_written").alias(WRITTEN))

    def bad_lines(self) -> DataFrame | None:
        """Lines that are no whole visit, as they are."""
        return None if self.lines is None else self.lines.filter(~F.col("whole")).select("value")


def read_backlog(spark: SparkSession, path: str) -> DataFrame:
    """Waiting visits; a field that may be missing and is, is null; no file means no visits.

    Lines that are no whole visit are left out; see `bad_lines`.
    """
    waiting = Backlog.listed(spark, path).visits()
    if waiting is None:
        return as_visits(spark.createDataFrame([], BACKLOG).select(*_from_backlog()))
    return as_visits(waiting)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a backlog that are no whole visit, as they are."""
    found = Backlog.listed(spark, path).bad_lines()
    return spark.createDataFrame([], "value string") if found is None else found


def _from_backlog() -> list[Column]:
    columns = []
    for name in VISIT_COLUMNS:
        source = F.col(_RENAMED.get(name, name))
        columns.append((F.timestamp_millis(source) if name == "visited_at" else source).alias(name))
    return columns


def backlog_lines(visits: DataFrame, written: int | None = None) -> DataFrame:
    """One JSON object per visit; with the time of writing, if it is given, as the last field."""
    fields = {}
    for name in VISIT_COLUMNS:
        fields[_RENAMED.get(name, name)] = F.unix_millis(name) if name == "visited_at" else F.col(name)
    if written is not None:
        fields[WRITTEN] = F.lit(written)
    return visits.select(visit_document(fields).alias("value"))


def write_backlog(visits: DataFrame, path: str) -> None:
    """Add visits to a backlog, after those that wait already."""
    backlog_lines(visits, time.time_ns() // 1000).write.mode("append").text(path)


def replay_backlog(
    spark: SparkSession, backlog: str, table: str, visits: DataFrame | None = None, bad: str | None = None
) -> None:
    """Store everything waiting, together with new visits if any, and then clear what was read.

    Of several visits with one key the one written first is stored; new visits come last. Lines that are no whole visit
    are first kept in `bad`, by default a folder beside the backlog. A failure leaves the backlog whole; a later replay
    stores only what is still missing. What is added meanwhile waits for the next replay.
    """
    listed = Backlog.listed(spark, backlog)
    queue = listed.visits()
    if visits is not None:
        new = as_visits(visits).select(*VISIT_COLUMNS, F.lit(2**63 - 1).alias(WRITTEN))
        queue = new if queue is None else queue.unionByName(new)
    if queue is not None:
        insert_if_absent(spark, one_per_key(queue, first=WRITTEN).drop(WRITTEN), table)
    torn = listed.bad_lines()
    if torn is not None and not torn.isEmpty():
        torn.write.mode("append").text(bad or f"{backlog.rstrip('/')}-bad")
    for file in listed.files:
        remove_file_named(spark, file)
