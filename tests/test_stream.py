import os
import time
from datetime import datetime

import pytest
from conftest import line

from footfall.plans.ingest import Lookups, ingest_lines
from footfall.settings import Settings
from footfall.sources.lookups import network_ranges
from footfall.sources.visits_table import read_visits
from footfall.streaming import ingest as streaming

SETTINGS = Settings("grains-for-checks-and-tests-only")


class Site:
    """A watched directory, a table and a checkpoint."""

    def __init__(self, spark, root):
        self.spark = spark
        self.segments = root / "segments"
        self.segments.mkdir()
        self.root = root
        self.table = str(root / "table")

    def deliver(self, name, *texts, end="\n"):
        whole = self.root / f"{name}.part"
        whole.write_text("\n".join(texts) + end)
        os.rename(whole, self.segments / name)

    def run(self, **options):
        query = streaming.start_ingest(
            self.spark, str(self.segments), self.table, str(self.root / "checkpoint"), SETTINGS, **options
        )
        query.awaitTermination()
        return query

    def paths(self):
        return sorted(row.path for row in read_visits(self.spark, self.table).collect())


@pytest.fixture
def site(spark, tmp_path):
    return Site(spark, tmp_path)


def test_segments_are_stored_once_across_restarts(site):
    site.deliver("one.log", line(uri="/a"), line(uri="/b"))
    site.run()
    assert site.paths() == ["/a", "/b"]
    site.deliver("two.log", line(uri="/c"))
    site.run()
    assert site.paths() == ["/a", "/b", "/c"]
    files = set(os.listdir(site.table))
    assert site.run().lastProgress is None or set(os.listdir(site.table)) == files


def test_a_segment_delivered_twice_adds_nothing(site):
    site.deliver("one.log", line(uri="/a"), line(uri="/b"))
    site.run()
    site.deliver("one-again.log", line(uri="/a"), line(uri="/b"), line(uri="/c"))
    site.run()
    assert site.paths() == ["/a", "/b", "/c"]


def test_late_visits_are_taken_and_known_when_seen_again(site):
    site.deliver("new.log", line(uri="/new"))
    site.run()
    for name in ("late.log", "late-again.log"):
        site.deliver(name, line(uri="/late", ts="1700000000.5"))
        site.run()
    assert site.paths() == ["/late", "/new"]


def test_a_segment_that_was_changed_long_ago_is_taken(site):
    """A moved file keeps its time, so a late shipment looks old beside a live log."""
    site.deliver("new.log", line(uri="/new"))
    site.run()
    site.deliver("old.log", line(uri="/old"))
    month_ago = time.time() - 30 * 86400
    os.utime(site.segments / "old.log", (month_ago, month_ago))
    site.run()
    assert site.paths() == ["/new", "/old"]


def test_consumed_segments_are_archived(site, tmp_path):
    for name in ("a", "b"):
        site.deliver(f"{name}.log", line(uri=f"/{name}"))
        site.run(archive=str(tmp_path / "archive"))
    assert site.paths() == ["/a", "/b"]
    assert list((tmp_path / "archive").rglob("a.log"))


def test_bad_lines_never_stop_the_stream(site):
    site.deliver("one.log", "no object", line(uri="/a"), "{", line(ts="1e300"), "", line(uri="/b")[:-20], end="")
    site.run()
    assert site.paths() == ["/a"]


def test_catching_up_in_bounded_steps(site):
    for n in range(5):
        site.deliver(f"{n}.log", line(uri=f"/{n}"))
    query = site.run(max_files=2)
    assert site.paths() == [f"/{n}" for n in range(5)]
    assert query.lastProgress["batchId"] == 2


def test_steps_bounded_by_bytes(site):
    for n in range(3):
        site.deliver(f"{n}.log", line(uri=f"/{n}"))
    query = site.run(max_bytes=1000)
    assert site.paths() == ["/0", "/1", "/2"]
    assert query.lastProgress["batchId"] >= 1


def test_no_history_on_a_first_run(site):
    site.deliver("one.log", line(uri="/old", ts="1700000000"), line(uri="/new"))
    site.run(since=datetime(2025, 1, 1))
    assert site.paths() == ["/new"]


def test_an_outage_of_the_table_loses_nothing(site, monkeypatch):
    site.deliver("one.log", line(uri="/a"), line(uri="/b"))
    real = streaming.ingest_lines

    def unavailable(*_, **__):
        raise OSError("table unavailable")

    monkeypatch.setattr(streaming, "ingest_lines", unavailable)
    with pytest.raises(Exception, match="table unavailable"):
        site.run()
    monkeypatch.setattr(streaming, "ingest_lines", real)
    site.deliver("two.log", line(uri="/c"))
    site.run()
    assert site.paths() == ["/a", "/b", "/c"]


def test_a_batch_that_failed_after_storing_is_repeated_without_copies(site, monkeypatch):
    site.deliver("one.log", line(uri="/a"), line(uri="/b"))
    real = streaming.ingest_lines

    def store_and_fail(*args, **kwargs):
        real(*args, **kwargs)
        raise OSError("lost after the append")

    monkeypatch.setattr(streaming, "ingest_lines", store_and_fail)
    with pytest.raises(Exception, match="lost after the append"):
        site.run()
    monkeypatch.setattr(streaming, "ingest_lines", real)
    site.run()
    assert site.paths() == ["/a", "/b"]


def test_unstorable_requests_are_kept_apart(site, spark, tmp_path):
    site.deliver("one.log", line(uri="/a"), line(uri="?x"), line(ts="1e300"))
    site.run(rejected=str(tmp_path / "rejected"))
    found = spark.read.json(str(tmp_path / "rejected"))
    assert sorted(row.drop_reason for row in found.collect()) == ["empty_path", "time_out_of_range"]
    assert site.paths() == ["/a"]


def test_lookups_are_read_for_each_batch(site):
    countries = iter(["Sweden", "Norway"])

    def lookups(session):
        rows = [("203.0.113.0/24", next(countries), None)]
        return Lookups(city=network_ranges(session.createDataFrame(rows, "network string, country string, city string")))

    for name in ("a", "b"):
        site.deliver(f"{name}.log", line(uri=f"/{name}"))
        site.run(lookups=lookups)
    assert {row.path: row.country for row in read_visits(site.spark, site.table).collect()} == {"/a": "Sweden", "/b": "Norway"}


def test_stream_and_batch_store_the_same(site, lines, tmp_path):
    texts = [line(uri=f"/{n % 7}", ts=str(1760000000 + n % 5)) for n in range(40)]
    site.deliver("one.log", *texts)
    site.run()
    ingest_lines(lines(*texts), str(tmp_path / "batch"), SETTINGS)
    batch = read_visits(site.spark, str(tmp_path / "batch"))
    streamed = read_visits(site.spark, site.table)
    assert sorted(map(str, batch.collect())) == sorted(map(str, streamed.collect()))
