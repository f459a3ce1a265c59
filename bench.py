"""Time the headline queries, the better of two runs each; prints one JSON line.

Queries start from the access-log files or, where they ask the visits table, from the table. Writing
the files is not timed; preparing the lookup tables is the `prepare_lookups` step, and ingesting the files into a new
table with prepared lookups the `ingest` step.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from checks import standin
from checks.queries import QUERIES
from footfall.plans.ingest import ingest_lines
from footfall.sources.lookups import write_prepared

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2

HEADLINE = [
    "parse_access_log",
    "drop_reasons",
    "kept_requests",
    "visits_dedupe",
    "geo_enrich",
    "org_domain_join",
    "visits_from_log",
    "visits_per_day_from_lines",
    "insert_if_absent",
    "stream_ingest",
    "visits_per_day",
    "top_countries",
    "top_referrers",
    "engaged_rate",
    "stat_tiles",
    "rollups_document",
    "rollups_stored",
    "recent_visits",
    "recent_engaged",
    "recent_engaged_stored",
    "geo_dense",
    "visitor_ordinal",
    "display_rows",
    "retained",
    "retention_prune",
    "backlog_roundtrip",
    "backlog_replay",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("footfall-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(run) -> float:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            runs.append(time.perf_counter() - start)
        return round(min(runs), 3)

    def ingest() -> None:
        lookups = standin.lookups(spark, SF_DIR)
        ingest_lines(standin.log_lines(spark, SF_DIR), standin.new_folder(spark, "bench"), standin.SETTINGS, lookups)

    def prepare_lookups() -> None:
        tables = [made(spark, SF_DIR) for made in (standin.city_ranges, standin.asn_ranges, standin.ptr_table)]
        write_prepared(spark, standin.new_folder(spark, "bench-lookups"), *tables)

    lines = standin.log_lines(spark, SF_DIR).count()
    visits = standin.stored_visits(spark, SF_DIR).count()
    seconds = {"prepare_lookups": timed(prepare_lookups), "ingest": timed(ingest)}
    for name in HEADLINE:
        seconds[name] = timed(lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())

    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "log_lines": lines,
                "visits": visits,
                "ingest_lines_per_sec": round(lines / seconds["ingest"]),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
