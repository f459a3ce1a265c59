import os
import random
from datetime import date, datetime, timedelta

import pytest
from conftest import SAMPLE, line
from pyspark.sql import functions as F


from footfall.operators.retention import prune, retained, retention_counts
from footfall.operators.visits import one_per_key
from footfall.plans.ingest import Lookups, ingest_files, visits_from_lines
from footfall.schemas import STORED_VISIT, VISIT_COLUMNS
from footfall.settings import Settings
from footfall.sources.backlog import backlog_lines, read_backlog, replay_backlog, write_backlog
from footfall.sources.lookups import network_ranges
from footfall.sources.visits_table import append_visits, insert_if_absent, read_visits

SETTINGS = Settings("grains-for-checks-and-tests-only")
NOW = datetime(2026, 7, 11, 10)


def paths(visits):
    return sorted(row.path for row in visits.collect())


def test_a_kept_line_becomes_a_visit(spark, lines):
    networks = spark.createDataFrame([("203.0.113.0/24", "Sweden", "Örebro")], "network string, country string, city string")
    ptr = spark.createDataFrame([("203.0.113.7", "line-9.cable.example.")], "client_ip string, ptr_host string")
    found = visits_from_lines(lines(line()), SETTINGS, Lookups(city=network_ranges(networks), ptr=ptr))
    row = found.withColumn("at", F.unix_millis("visited_at")).first()
    assert found.columns == STORED_VISIT.fieldNames()
    assert (row.site, row.path, row.engaged, row.country, row.city) == ("store.example", "/", False, "Sweden", "Örebro")
    assert (row.asn, row.org, row.org_domain) == (None, None, "cable.example")
    assert (row.browser, row.os, row.device_kind, row.referrer) == ("Chrome", "Windows", "DESKTOP", "https://github.com/x")
    assert (len(row.ip_hash), row["at"], row.visit_day) == (64, 1760000000250, date(2025, 10, 9))


def test_filtered_and_unparseable_lines_give_nothing(lines):
    sent = lines(line(uri="/healthz"), line(status="404"), line(headers='"User-Agent":["Googlebot/2.1"]'), "no object", line(uri="?x"))
    assert visits_from_lines(sent, SETTINGS).count() == 0


def test_an_empty_referrer_is_none(lines):
    found = visits_from_lines(lines(line(headers='"Referer":[""]')), SETTINGS)
    assert found.first().referrer is None


def test_copies_collapse_and_the_kept_one_does_not_depend_on_order(spark, visits):
    same = [{"engaged": False, "browser": "Firefox"}, {"engaged": True, "browser": "Safari"}, {"engaged": True, "browser": "Edge"}]
    for order in (same, same[::-1]):
        found = one_per_key(visits(*order, *order))
        assert [(row.engaged, row.browser) for row in found.collect()] == [(True, "Edge")]
        assert found.columns == STORED_VISIT.fieldNames()


@pytest.mark.parametrize("other", [{"site": "b"}, {"path": "/b"}, {"ip_hash": "b" * 64}, {"at": "2026-07-11T10:00:00.001Z"}])
def test_another_key_is_another_visit(visits, other):
    assert one_per_key(visits({}, other)).count() == 2


def test_table_roundtrip(spark, visits, tmp_path):
    nothing_known = {name: None for name in ("country", "city", "asn", "org", "referrer", "org_domain")}
    stored = visits({}, nothing_known | {"path": "/x", "engaged": True})
    append_visits(stored, str(tmp_path / "t"))
    found = read_visits(spark, str(tmp_path / "t"))
    assert sorted(map(str, found.select(stored.columns).collect())) == sorted(map(str, stored.collect()))


def test_a_table_that_does_not_exist_yet_is_empty(spark, tmp_path):
    found = read_visits(spark, str(tmp_path / "none"))
    assert found.count() == 0 and found.columns == STORED_VISIT.fieldNames()


def test_files_older_than_a_column(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    visits({}).drop("org_domain").write.partitionBy("visit_day").parquet(path)
    append_visits(visits({"path": "/new"}), path)
    assert {row.path: row.org_domain for row in read_visits(spark, path).collect()} == {"/": None, "/new": "cable.example"}


def test_what_is_stored_first_stays(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    insert_if_absent(spark, visits({"browser": "Safari"}), path)
    insert_if_absent(spark, visits({"engaged": True}, {"path": "/b"}, {"path": "/c", "at": "2025-01-01T00:00:00Z"}), path)
    insert_if_absent(spark, visits({"engaged": True}, {"path": "/b"}), path)
    found = {row.path: (row.engaged, row.browser) for row in read_visits(spark, path).collect()}
    assert found == {"/": (False, "Safari"), "/b": (False, "Chrome"), "/c": (False, "Chrome")}
    assert read_visits(spark, path).count() == 3


def test_a_batch_of_many_days(spark, visits, tmp_path, monkeypatch):
    monkeypatch.setattr("footfall.sources.visits_table.MOST_RANGES", 3)
    path = str(tmp_path / "t")
    batch = visits(*[{"path": f"/{n}", "at": f"2026-07-{n:02}T23:59:59.999Z"} for n in range(1, 10)])
    for _ in range(2):
        insert_if_absent(spark, batch, path)
    assert read_visits(spark, path).count() == 9


def test_ingest_of_files_twice(spark, tmp_path):
    (tmp_path / "a.log").write_text(line() + "\n" + line(uri="/b") + "\n")
    (tmp_path / "b.log").write_text(line() + "\n" + line(uri="/c") + "\nbroken\n")
    table = str(tmp_path / "t")
    files = [str(tmp_path / "a.log"), str(tmp_path / "b.log")]
    for _ in range(2):
        ingest_files(spark, files, table, SETTINGS)
    assert paths(read_visits(spark, table)) == ["/", "/b", "/c"]


def test_lookups_are_spent_on_new_visits_only(spark, lines, tmp_path):
    asked = []

    def complete(fresh):
        asked.append(fresh.count())
        return fresh

    table = str(tmp_path / "t")
    found = one_per_key(visits_from_lines(lines(line(), line(uri="/b")), SETTINGS))
    insert_if_absent(spark, found, table, complete)
    insert_if_absent(spark, found, table, complete)
    assert asked == [2]


def test_a_failed_append_is_made_good_by_running_again(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    both = visits({"path": "/a"}, {"path": "/b"})
    append_visits(both.filter("path = '/a'"), path)  # what a broken run may leave behind
    insert_if_absent(spark, both, path)
    assert paths(read_visits(spark, path)) == ["/a", "/b"]


def test_random_batches_against_a_plain_dictionary(spark, visits, tmp_path):
    """First stored wins; within a batch an engaged visit, then the least by the other columns."""
    rng = random.Random(3)
    path, stored = str(tmp_path / "t"), {}
    for _ in range(4):
        batch = [
            {
                "path": f"/{rng.randrange(6)}",
                "ip_hash": f"v{rng.randrange(3)}",
                "at": f"2026-07-{rng.randrange(1, 5):02}T10:00:00Z",
                "engaged": rng.random() < 0.3,
                "browser": rng.choice(["Chrome", "Edge", "Safari"]),
            }
            for _ in range(60)
        ]
        insert_if_absent(spark, one_per_key(visits(*batch)), path)
        for row in sorted(batch, key=lambda row: (not row["engaged"], row["browser"])):
            first = (row["path"], row["ip_hash"], row["at"])
            stored.setdefault(first, (row["engaged"], row["browser"]))
    found = read_visits(spark, path).collect()
    assert len(found) == len(stored)
    assert {
        (row.path, row.ip_hash, row.visit_day.isoformat() + "T10:00:00Z"): (row.engaged, row.browser) for row in found
    } == stored


# Retention


def test_cutoff_is_exact(visits):
    ages = {"/old": "2026-04-12T09:59:59.999Z", "/edge": "2026-04-12T10:00:00Z", "/new": "2026-07-11T09:00:00Z"}
    stored = visits(*[{"path": path, "at": at} for path, at in ages.items()])
    assert paths(retained(stored, NOW)) == ["/edge", "/new"]
    assert tuple(retention_counts(stored, NOW).first()) == (2, 1)
    assert paths(retained(stored.drop("visit_day"), NOW)) == ["/edge", "/new"]


def test_prune(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    at = {
        "/100-days": "2026-04-02T10:00:00Z",
        "/101-days": "2026-04-01T10:00:00Z",
        "/before": "2026-04-12T09:00:00Z",
        "/after": "2026-04-12T10:00:00Z",
        "/new": "2026-07-11T09:00:00Z",
    }
    append_visits(visits(*[{"path": name, "at": moment} for name, moment in at.items()]), path)
    assert prune(spark, path, NOW, keep=timedelta(0)) == 3
    assert paths(read_visits(spark, path)) == ["/after", "/new"]
    assert sorted(p.name for p in (tmp_path / "t").glob("visit_day=*")) == ["visit_day=2026-04-12", "visit_day=2026-07-11"]
    assert prune(spark, path, NOW) == 0
    assert paths(read_visits(spark, path)) == ["/after", "/new"]


def test_prune_empties_a_boundary_day_and_a_table(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    append_visits(visits({"at": "2026-04-12T09:00:00Z"}), path)
    assert prune(spark, path, NOW) == 1
    assert read_visits(spark, path).count() == 0
    assert prune(spark, str(tmp_path / "none"), NOW) == 0


def test_prune_refuses_a_senseless_period(spark, tmp_path):
    with pytest.raises(ValueError):
        prune(spark, str(tmp_path), NOW, 0)


# Backlog


def test_backlog_lines(visits):
    nothing_known = {name: None for name in ("country", "city", "asn", "org", "referrer", "org_domain")}
    found = [row.value for row in backlog_lines(visits({"path": "/a"}, nothing_known)).collect()]
    assert found[0] == (
        '{"site":"guide.example","path":"/a","engaged":false,"country":"Sweden","city":"Örebro","asn":64510,'
        '"org":"Lake Networks","browser":"Chrome","os":"Windows","kind":"DESKTOP","ipHash":"' + "a" * 64 + '",'
        '"referrer":"https://github.com/x","at":1783764000000,"orgDomain":"cable.example"}'
    )
    assert '"country":null,"city":null,"org":null,' in found[1] and "asn" not in found[1]


def test_backlog_roundtrip(spark, visits, tmp_path):
    path = str(tmp_path / "backlog")
    waiting = visits({}, {"country": None, "city": None, "asn": None, "org": None, "referrer": None, "engaged": True, "path": "/x"})
    write_backlog(waiting, path)
    assert sorted(map(str, read_backlog(spark, path).collect())) == sorted(map(str, waiting.collect()))


def test_backlog_written_elsewhere(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text(
        '{"site":"s","path":"/","engaged":true,"country":null,"browser":"Chrome","os":"other","kind":"DESKTOP","ipHash":"h","at":1783764000500}\n\n'
    )
    row = read_backlog(spark, str(tmp_path / "b.jsonl")).first()
    assert (row.site, row.engaged, row.country, row.asn, row.org_domain, row.visit_day) == ("s", True, None, None, None, date(2026, 7, 11))
    assert read_backlog(spark, str(tmp_path / "none")).count() == 0


def test_replay_stores_what_is_missing_and_clears(spark, visits, tmp_path):
    backlog, table = str(tmp_path / "backlog"), str(tmp_path / "t")
    write_backlog(visits({"path": "/a"}), backlog)
    write_backlog(visits({"path": "/b"}, {"path": "/a"}), backlog)
    append_visits(visits({"path": "/a", "browser": "Safari"}), table)  # half of an earlier replay
    replay_backlog(spark, backlog, table, visits({"path": "/c"}))
    assert {row.path: row.browser for row in read_visits(spark, table).collect()} == {"/a": "Safari", "/b": "Chrome", "/c": "Chrome"}
    assert read_backlog(spark, backlog).count() == 0
    replay_backlog(spark, backlog, table)
    assert read_visits(spark, table).count() == 3


def test_of_conflicting_copies_the_first_written_is_stored(spark, visits, tmp_path):
    backlog, table = str(tmp_path / "backlog"), str(tmp_path / "t")
    write_backlog(visits({"path": "/a", "browser": "Safari"}, {"path": "/b", "browser": "Opera"}), backlog)
    write_backlog(visits({"path": "/a", "browser": "Chrome", "engaged": True}), backlog)
    # A line from elsewhere has no number; it is as old as its file.
    foreign = [row.value for row in backlog_lines(visits({"path": "/b", "browser": "Edge"}, {"path": "/c", "browser": "Edge"})).collect()]
    (tmp_path / "backlog" / "old.jsonl").write_text("\n".join(foreign) + "\n")
    os.utime(tmp_path / "backlog" / "old.jsonl", (1, 1))
    new = visits(*[{"path": path, "browser": "Firefox"} for path in ("/a", "/c", "/d")])
    replay_backlog(spark, backlog, table, new)
    found = {row.path: (row.browser, row.engaged) for row in read_visits(spark, table).collect()}
    assert found == {"/a": ("Safari", False), "/b": ("Edge", False), "/c": ("Edge", False), "/d": ("Firefox", False)}


def test_a_file_added_during_a_replay_survives(spark, visits, tmp_path, monkeypatch):
    from footfall.sources import backlog as module

    backlog, table = str(tmp_path / "backlog"), str(tmp_path / "t")
    write_backlog(visits({"path": "/a"}), backlog)
    real = module.insert_if_absent

    def meanwhile(*args):
        real(*args)
        write_backlog(visits({"path": "/b"}), backlog)
        (tmp_path / "backlog" / "part-torn.txt").write_text("{torn\n")

    monkeypatch.setattr(module, "insert_if_absent", meanwhile)
    replay_backlog(spark, backlog, table)
    monkeypatch.undo()
    assert paths(read_visits(spark, table)) == ["/a"] and not (tmp_path / "backlog-bad").exists()
    assert paths(read_backlog(spark, backlog)) == ["/b"]
    replay_backlog(spark, backlog, table)
    assert paths(read_visits(spark, table)) == ["/a", "/b"]
    assert [row.value for row in spark.read.text(f"{backlog}-bad").collect()] == ["{torn"]


def test_a_failed_replay_keeps_the_backlog(spark, visits, tmp_path, monkeypatch):
    backlog, table = str(tmp_path / "backlog"), str(tmp_path / "t")
    write_backlog(visits({"path": "/a"}, {"path": "/b"}), backlog)

    def fail(*_):
        raise OSError("table unavailable")

    monkeypatch.setattr("footfall.sources.visits_table.append_visits", fail)
    with pytest.raises(OSError):
        replay_backlog(spark, backlog, table)
    monkeypatch.undo()
    assert read_backlog(spark, backlog).count() == 2
    replay_backlog(spark, backlog, table)
    assert paths(read_visits(spark, table)) == ["/a", "/b"]


def test_sample_covers_every_column():
    assert set(SAMPLE) == set(VISIT_COLUMNS) - {"visited_at"} | {"at"}

