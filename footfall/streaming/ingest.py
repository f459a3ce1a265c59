"""Access logs to the visits table, as a stream over closed log segments.

The file source sees new files, not the growth of one: rotate the log and move each closed segment
into the watched directory. Which segments were consumed is in the query's checkpoint, so a restart
goes on where the last run stopped. A micro-batch that failed runs again whole; the table takes each
visit once, so neither that nor a segment delivered twice, however late, adds anything.

Spark's file source leaves out files older than `maxFileAge` before the newest it has seen; its default, a
week, would lose late shipments without a word. Here the age is a parameter that is beyond any lateness by
default. Consumed segments can be archived, which keeps the list of files seen short.
"""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from footfall.operators.reports import Report
from footfall.plans.ingest import Lookups, ingest_lines
from footfall.session import prepare, sized_shuffles
from footfall.settings import Settings
from footfall.sources.access_log import stream_lines
from footfall.sources.files import planned_bytes

# Most new segments one micro-batch takes, so that catching up runs in bounded steps.
MAX_FILES_PER_TRIGGER = 1000
# How much older than the newest segment another one may be, by the time it was last changed.
MAX_FILE_AGE = "36500d"


def store_batch(
    table: str,
    settings: Settings,
    lookups: Callable[[SparkSession], Lookups],
    since: datetime | None = None,
    rejected: str | None = None,
    on_report: Callable[[int, Report], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """What happens to the lines of one micro-batch."""

    def store(lines: DataFrame, batch_id: int) -> None:
        spark, size = lines.sparkSession, planned_bytes(lines)
        # Overwriting the batch's own folder keeps a repeated batch from adding rows twice.
        folder = None if rejected is None else f"{rejected}/batch={batch_id}"
        with sized_shuffles(spark, size):
            report = ingest_lines(lines, table, settings, lookups(spark), since, folder, size)
        if on_report is not None:
            on_report(batch_id, report)

    return store


def start_ingest(
    spark: SparkSession,
    segments: str,
    table: str,
    checkpoint: str,
    settings: Settings,
    lookups: Callable[[SparkSession], Lookups] = lambda spark: Lookups(),
    since: datetime | None = None,
    rejected: str | None = None,
    max_files: int = MAX_FILES_PER_TRIGGER,
    max_bytes: int | None = None,
    trigger: dict | None = None,
    max_file_age: str = MAX_FILE_AGE,
    archive: str | None = None,
    on_report: Callable[[int, Report], None] | None = None,
) -> StreamingQuery:
    """Start storing visits from segments as they arrive; by default until all present are stored.

    `checkpoint` is a folder of its own for this stream, on storage that outlives the session.
    `lookups` is called for each batch, so lookup tables may be replaced while the stream runs.
    `since` leaves out older requests, for a first start beside logs whose history is not wanted.
    A micro-batch takes at most `max_files` segments, or `max_bytes` of them if that is given.
    Consumed segments move to the folder `archive` where one is named. `on_report` is told what each
    micro-batch read and left out.
    """
    prepare(spark)
    options = {"maxFilesPerTrigger": max_files} if max_bytes is None else {"maxBytesPerTrigger": max_bytes}
    options["maxFileAge"] = max_file_age
    if archive is not None:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive}
    return (
        stream_lines(spark.readStream.options(**options), segments)
        .writeStream.foreachBatch(store_batch(table, settings, lookups, since, rejected, on_report))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
