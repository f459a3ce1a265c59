"""Files with statistics, compaction, torn backlog lines, hot keys without a cap."""

import datetime as dt

import pyarrow.parquet as pq
import pytest
from conftest import line
from pyspark.sql import functions as F

from footfall.operators import skew
from footfall.operators.reports import consumed_per_file
from footfall.operators.visits import as_visits
from footfall.plans.ingest import ingest_files
from footfall.settings import Settings
from footfall.sources.access_log import read_lines
from footfall.sources.backlog import read_backlog, replay_backlog, write_backlog
from footfall.sources.visits_table import append_visits, compact, insert_if_absent, read_visits, stored_keys, time_ranges

SETTINGS = Settings("grains-for-checks-and-tests-only")


def paths(visits):
    return sorted(row.path for row in visits.collect())


def test_times_have_statistics_and_row_groups_are_skipped(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    hours = visits(*[{"path": f"/{n:04}", "at": f"2026-07-02T{n // 60:02}:{n % 60:02}:00Z"} for n in range(1200)])
    spark.conf.set("parquet.block.row.count.limit", "100")
    try:
        append_visits(hours.coalesce(1), path)
    finally:
        spark.conf.unset("parquet.block.row.count.limit")
    for file in (tmp_path / "t").rglob("*.parquet"):
        footer = pq.ParquetFile(file).metadata
        column = footer.schema.names.index("visited_at")
        statistics = [footer.row_group(n).column(column).statistics for n in range(footer.num_row_groups)]
        assert all(s.has_min_max and s.min <= s.max for s in statistics)
    batch = visits({"at": "2026-07-02T03:00:00Z"}, {"at": "2026-07-02T03:04:00Z"})
    assert stored_keys(spark, path, batch).count() == 5


def rows_scanned(frame):
    """Rows that the scans of a plan handed on, after its row groups were chosen."""
    frame.collect()
    plan, found = frame._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.getClass().getSimpleName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "FileSourceScan" in node.getClass().getSimpleName():
            found.append(node.metrics().apply("numOutputRows").value())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children()
        for n in range(children.size()):
            walk(children.apply(n))

    walk(plan)
    return sum(found)


@pytest.mark.parametrize("visitors", [2, 60])
def test_a_batch_of_late_visits_skips_row_groups_inside_its_hours(spark, visits, tmp_path, visitors):
    """Every row group reaches into the hours of the batch and holds many different visitors."""
    path = str(tmp_path / "t")
    sample = visits({}).drop("path", "ip_hash", "visited_at", "visit_day")
    many = spark.range(4000).select(
        F.concat(F.lit("/"), F.col("id")).alias("path"),
        F.sha2(F.col("id").cast("string"), 256).alias("ip_hash"),
        F.timestamp_seconds(F.lit(1782000000) + F.col("id") % 3).alias("visited_at"),
        *[F.lit(value).cast(sample.schema[name].dataType).alias(name) for name, value in sample.first().asDict().items()],
    )
    spark.conf.set("parquet.block.row.count.limit", "200")
    # As in large row groups, visitors are too many for a dictionary.
    spark.conf.set("parquet.enable.dictionary", "false")
    try:
        append_visits(as_visits(many).coalesce(1), path)
    finally:
        spark.conf.unset("parquet.block.row.count.limit")
        spark.conf.unset("parquet.enable.dictionary")
    # The first of these visitors is known with another path, the last with the same; the others are new.
    known = many.filter("id = 1234").withColumn("path", F.lit("/late")).unionByName(many.filter("id = 77"))
    new = many.limit(visitors - 2).withColumn("ip_hash", F.concat(F.lit("new"), "ip_hash"))
    late = as_visits(known.unionByName(new))
    keys = stored_keys(spark, path, late)
    assert sorted(row.path for row in keys.collect()) == ["/1234", "/77"]
    # 20 row groups of 200 visits; at a rate of 1 %, 60 visitors raise a false alarm in about half of them.
    assert rows_scanned(keys) <= (600 if visitors == 2 else 3000) < rows_scanned(read_visits(spark, path).select("path"))
    insert_if_absent(spark, late, path)
    assert read_visits(spark, path).count() == 4000 + visitors - 1


def test_tables_with_old_timestamps_are_still_read(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    visits({"path": "/old"}).write.partitionBy("visit_day").parquet(path)
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    append_visits(visits({"path": "/new"}), path)
    assert paths(read_visits(spark, path).filter("visited_at >= '2000-01-01'")) == ["/new", "/old"]


def test_ranges_close_the_smallest_gaps():
    spans = [(0, 1), (5, 6), (100, 101), (103, 110), (500, 501)]
    assert time_ranges(spans, 10) == spans
    assert time_ranges(spans, 3) == [(0, 6), (100, 110), (500, 501)]
    assert time_ranges(spans, 1) == [(0, 501)]
    assert time_ranges([], 3) == []


def test_compaction_makes_fewer_files_of_the_same_rows(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    for n in range(6):
        append_visits(visits({"path": f"/{n}"}, {"path": f"/late{n}", "at": "2025-01-01T00:00:00Z"}), path)
    append_visits(visits({"path": "/alone", "at": "2025-02-01T00:00:00Z"}), path)
    before = sorted(map(str, read_visits(spark, path).collect()))
    days = [dt.date(2025, 1, 1), dt.date(2025, 2, 1), dt.date(2026, 7, 11)]
    assert compact(spark, path, most_files=4) == [days[0], days[2]]
    assert sorted(map(str, read_visits(spark, path).collect())) == before
    assert [len(read_visits(spark, path, [day]).select("_metadata.file_path").distinct().collect()) for day in days] == [1, 1, 1]
    assert compact(spark, path, most_files=4) == []


def test_torn_backlog_lines_are_kept_aside(spark, visits, tmp_path):
    backlog, table = str(tmp_path / "waiting visits"), str(tmp_path / "t")
    write_backlog(visits({"path": "/a"}), backlog)
    (tmp_path / "waiting visits" / "part-torn.txt").write_text('{"site":"a.example","path":"/torn","enga\n{"path":"/no-site"}\n\n')
    for _ in range(2):
        replay_backlog(spark, backlog, table, visits({"path": "/new"}))
    assert paths(read_visits(spark, table)) == ["/a", "/new"]
    assert read_backlog(spark, backlog).isEmpty() and not list((tmp_path / "waiting visits").glob("part-*"))
    kept = spark.read.text(f"{backlog}-bad").collect()
    assert sorted(row.value for row in kept) == ['{"path":"/no-site"}', '{"site":"a.example","path":"/torn","enga']


def test_long_values_are_stored_and_others_are_written_apart(spark, tmp_path):
    folder = tmp_path / "logs, old"
    folder.mkdir()
    referrer = "https://news.example/" + "x" * 600
    headers = '{"User-Agent":["Firefox/1"],"Referer":["' + referrer + '"]}'
    (folder / "a.log").write_text(line(headers=headers[1:-1]) + "\n" + line(uri="?x") + "\n")
    table, rejected = str(tmp_path / "t"), str(tmp_path / "rejected")
    ingest_files(spark, [str(folder / "a.log")], table, SETTINGS, rejected=rejected)
    assert [row.referrer for row in read_visits(spark, table).collect()] == [referrer]
    assert [row.drop_reason for row in spark.read.json(rejected).collect()] == ["empty_path"]


def test_files_go_in_groups(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"{n}.log").write_text(line(uri=f"/{n}") + "\n")
    ingest_files(spark, str(tmp_path / "*.log"), str(tmp_path / "t"), SETTINGS, most_bytes=1000)
    assert paths(read_visits(spark, str(tmp_path / "t"))) == [f"/{n}" for n in range(5)]


def test_a_file_without_a_final_newline_has_no_byte_too_many(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\ntwo")
    (tmp_path / "b.log").write_bytes(b"one\ntwo\n")
    found = {row.file[-5:]: (row["lines"], row.bytes) for row in consumed_per_file(read_lines(spark, str(tmp_path))).collect()}
    assert found == {"a.log": (2, 7), "b.log": (2, 8)}


def test_every_key_beyond_a_share_is_cut(spark):
    facts = spark.range(0, 60_000).select((F.col("id") % 600).cast("string").alias("k"), "id")
    lookup = spark.range(0, 600).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    found = skew.salted_join(facts, lookup, "k", "left", rows_per_share=10)
    assert found.count() == 60_000 and found.filter("v != CAST(k AS long) * 2").isEmpty()
    assert skew.MOST_SHARES >= 600
