"""Access logs to the visits table, as a batch."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.times import instant
from footfall.operators.geo import Prepared, locate
from footfall.operators.reports import Report, Watch
from footfall.operators.requests import UNSTORABLE, judge, kept_of, kept_requests, unstorable
from footfall.operators.visits import as_visits, describe, one_per_key
from footfall.session import sized_shuffles, whole_plans
from footfall.settings import Settings
from footfall.sources.access_log import clean_lines, parse_lines, read_lines
from footfall.sources.files import file_groups
from footfall.sources.visits_table import insert_if_absent

# Text of the files ingested at once: some 1,600 shuffle partitions. More goes in several groups.
MOST_GROUP_BYTES = 4 * 2**40


@dataclass(frozen=True)
class Lookups:
    """Tables an address is looked up in; those left out leave their columns null.

    `prepared` (sources.lookups) takes the place of the others.
    """

    city: DataFrame | None = None
    asn: DataFrame | None = None
    ptr: DataFrame | None = None
    prepared: Prepared | None = None

    def locate(self, visits: DataFrame) -> DataFrame:
        return locate(visits, self.city, self.asn, self.ptr, prepared=self.prepared)


def requests_from_lines(lines: DataFrame, settings: Settings) -> DataFrame:
    return kept_requests(parse_lines(clean_lines(lines)), settings.internal_proxies)


def visits_from_lines(lines: DataFrame, settings: Settings, lookups: Lookups = Lookups()) -> DataFrame:
    """Visits of some log lines as a plan of their own, without a table."""
    return as_visits(lookups.locate(one_per_key(describe(requests_from_lines(lines, settings), settings.salt))))


def ingest_lines(
    lines: DataFrame,
    table: str,
    settings: Settings,
    lookups: Lookups = Lookups(),
    since: datetime | None = None,
    rejected: str | None = None,
    size: int | None = None,
) -> Report:
    """Store the visits among some log lines, and say what was read and left out.

    Copies of what is stored are dropped before any lookup. Requests that cannot be stored go to `rejected`, where
    that is named; the folder is overwritten. Everything comes from one pass over the lines: counts are
    observed while visits are stored, and what both writers need is kept, parsed, in between. `size` is the
    size of the files behind the lines, if it is known.
    """
    spark, watch = lines.sparkSession, Watch()
    judged = watch.judged(judge(parse_lines(clean_lines(watch.lines(lines))), settings.internal_proxies))

    def complete(fresh: DataFrame) -> DataFrame:
        return as_visits(lookups.locate(fresh))

    def store(judged: DataFrame) -> None:
        requests = kept_of(judged)
        if since is not None:
            requests = requests.filter(requests["at"] >= instant(since))
        with whole_plans(spark):
            insert_if_absent(spark, one_per_key(describe(requests, settings.salt)), table, complete)

    if rejected is None:
        store(judged)
        return watch.report(size)
    # Most lines are neither kept nor rejected.
    judged = judged.filter(F.col("drop_reason").isNull() | F.col("drop_reason").isin(*UNSTORABLE)).persist()
    try:
        store(judged)
        unstorable(judged).write.mode("overwrite").json(rejected)
        return watch.report(size)
    finally:
        judged.unpersist()


def ingest_files(
    spark: SparkSession,
    paths: str | list[str],
    table: str,
    settings: Settings,
    lookups: Lookups = Lookups(),
    rejected: str | None = None,
    most_bytes: int = MOST_GROUP_BYTES,
) -> Report:
    """Store the visits of some log files, in groups of bounded size, and say what was read and left out.

    Requests that cannot be stored go to `rejected`, a folder of this run's own, where one is named.
    """
    report = Report()
    for number, (files, size) in enumerate(file_groups(spark, paths, most_bytes) or [(paths, 0)]):
        lines = read_lines(spark, files)
        folder = None if rejected is None else f"{rejected}/group={number}"
        with sized_shuffles(spark, size):
            report = report.plus(ingest_lines(lines, table, settings, lookups, rejected=folder, size=size))
    return report
