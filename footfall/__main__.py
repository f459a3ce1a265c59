"""Jobs for spark-submit: prepare-lookups, ingest, stream, summarise, prune, compact, visits, rollups.

    spark-submit ... footfall prepare-lookups --lookups DIR [--city-blocks CSV... --city-locations CSV] [--asn-blocks CSV...] [--ptr DIR]
    spark-submit ... footfall ingest --table TABLE [--lookups DIR] LOG...

The salt, internal proxies and retention days come from IP_HASH_SALT, INTERNAL_PROXY_IPS and
RETENTION_DAYS. The PTR table is a Parquet folder.
"""

import argparse
import json
import os
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from footfall.operators.listing import list_stored_visits, visit_documents
from footfall.operators.retention import prune
from footfall.operators.rollups import stored_rollups_document
from footfall.plans.ingest import Lookups, ingest_files
from footfall.session import prepare
from footfall.settings import Settings
from footfall.sources.lookups import read_asn_ranges, read_city_ranges, read_prepared, read_ptr_table, write_prepared
from footfall.sources.summaries import refresh
from footfall.sources.visits_table import compact
from footfall.streaming.ingest import MAX_FILE_AGE, start_ingest


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="footfall")
    jobs = parser.add_subparsers(dest="job", required=True)
    job = jobs.add_parser("prepare-lookups")
    job.add_argument("--lookups", required=True)
    job.add_argument("--city-blocks", nargs="+")
    job.add_argument("--city-locations")
    job.add_argument("--asn-blocks", nargs="+")
    job.add_argument("--ptr")
    for name in ("ingest", "stream", "summarise", "prune", "compact", "visits", "rollups"):
        job = jobs.add_parser(name)
        job.add_argument("--table", required=True)
        if name in ("ingest", "stream"):
            job.add_argument("--lookups")
            job.add_argument("--rejected")
        if name == "ingest":
            job.add_argument("logs", nargs="+")
        if name == "stream":
            job.add_argument("--checkpoint", required=True)
            job.add_argument("--archive")
            job.add_argument("--max-file-age", default=MAX_FILE_AGE)
            job.add_argument("segments")
        if name == "visits":
            job.add_argument("--limit")
            job.add_argument("--visitors")
    return parser.parse_args(argv)


def _lookups(spark: SparkSession, args: argparse.Namespace) -> Lookups:
    return Lookups(prepared=read_prepared(spark, args.lookups)) if args.lookups else Lookups()


def _prepare_lookups(spark: SparkSession, args: argparse.Namespace) -> None:
    city = read_city_ranges(spark, args.city_blocks, args.city_locations) if args.city_blocks else None
    asn = read_asn_ranges(spark, args.asn_blocks) if args.asn_blocks else None
    ptr = read_ptr_table(spark, args.ptr) if args.ptr else None
    write_prepared(spark, args.lookups, city, asn, ptr)


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    args = _arguments(argv)
    prepare(spark)
    if args.job == "prepare-lookups":
        _prepare_lookups(spark, args)
    elif args.job == "ingest":
        settings = Settings.from_env(os.environ)
        report = ingest_files(spark, args.logs, args.table, settings, _lookups(spark, args), args.rejected)
        print(json.dumps(asdict(report)))
    elif args.job == "stream":
        query = start_ingest(
            spark,
            args.segments,
            args.table,
            args.checkpoint,
            Settings.from_env(os.environ),
            lambda session: _lookups(session, args),
            rejected=args.rejected,
            max_file_age=args.max_file_age,
            archive=args.archive,
            on_report=lambda batch, report: print(json.dumps({"batch": batch, **asdict(report)})),
        )
        query.awaitTermination()
    elif args.job == "prune":
        days = Settings.from_env(os.environ).retention_days
        print(prune(spark, args.table, datetime.now(timezone.utc), days))
    elif args.job == "summarise":
        print(refresh(spark, args.table))
    elif args.job == "compact":
        for day in compact(spark, args.table):
            print(day)
    elif args.job == "visits":
        listed = list_stored_visits(spark, args.table, args.limit, args.visitors)
        for row in visit_documents(listed).orderBy("row").collect():
            print(row.document)
    else:
        print(stored_rollups_document(spark, args.table, datetime.now(timezone.utc)).first().document)


if __name__ == "__main__":
    run(SparkSession.builder.appName("footfall").getOrCreate())
