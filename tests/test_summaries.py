"""Summaries beside the visits: the same answers as a scan, whatever happened to the table, without reading it."""

import random
from datetime import datetime, timedelta

import pytest

from footfall.operators import listing, rollups
from footfall.operators.retention import prune
from footfall.sources import summaries
from footfall.sources.summaries import is_summarised, read_counts, read_engaged, refresh
from footfall.sources.visits_table import append_visits, compact, insert_if_absent, read_visits

NOW = datetime(2026, 7, 11, 10)
AT_ONCE = timedelta(0)


def scanned(spark, path, now=NOW):
    return rollups.rollups_document(read_visits(spark, path), now).first().document


def stored(spark, path, now=NOW):
    return rollups.stored_rollups_document(spark, path, now).first().document


def random_batch(rng, turn, now=NOW):
    def row(k):
        return {
            "path": f"/{turn}-{k}",
            "at": (now - timedelta(minutes=rng.randrange(0, 60 * 24 * 40))).isoformat() + "Z",
            "country": rng.choice(["Sweden", "Norway", "Chile", None, "Peru", ""]),
            "referrer": rng.choice([None, *[f"https://{n}.example" for n in range(14)]]),
            "engaged": rng.random() < 0.2,
            "ip_hash": f"v{rng.randrange(40)}",
        }

    return [row(k) for k in range(25)]


def spoil(tmp_path, but=()):
    """Overwrite files of visits, so that reading any of them fails; days in `but` stay."""
    spoiled = 0
    for day in (tmp_path / "t").glob("visit_day=*"):
        if day.name[len("visit_day=") :] not in but:
            for file in day.rglob("*.parquet"):
                (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
                file.write_bytes(b"spoiled")
                spoiled += 1
    assert spoiled


def test_random_work_gives_what_a_scan_gives(spark, visits, tmp_path, monkeypatch):
    rng, path = random.Random(5), str(tmp_path / "t")
    for turn in range(9):
        now = NOW + timedelta(hours=7 * turn)
        act = "insert" if turn < 2 else rng.choice(["insert", "insert", "prune", "compact"])
        if act == "insert":
            with monkeypatch.context() as patch:
                if rng.random() < 0.4:
                    # Stored, but the run ends before or while the new files are summarised.
                    kind = rng.choice(["_counts", "_engaged"])
                    patch.setattr(summaries, kind, lambda visits: (_ for _ in ()).throw(OSError("the driver is gone")))
                try:
                    insert_if_absent(spark, visits(*random_batch(rng, turn, now)), path)
                except OSError:
                    pass
        elif act == "prune":
            prune(spark, path, now, 20, keep=AT_ONCE)
        else:
            compact(spark, path, 1, keep=AT_ONCE)
        if turn == 1:
            assert not is_summarised(spark, path)
            assert refresh(spark, path) > 0 and is_summarised(spark, path)
        assert stored(spark, path, now) == scanned(spark, path, now), (turn, act)
        found = read_engaged(spark, path).distinct()
        assert sorted(found.collect()) == sorted(listing.engaged_visitors(read_visits(spark, path)).collect())
        wanted = listing.recent_of_engaged(read_visits(spark, path), 30).collect()
        assert listing.stored_recent_of_engaged(spark, path, 30).collect() == wanted
    refresh(spark, path)
    assert refresh(spark, path) == 0
    assert stored(spark, path, now) == scanned(spark, path, now)


def test_rollups_read_one_day_of_visits_at_most(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    append_visits(visits(*random_batch(random.Random(1), 0), {"path": "/cut", "at": "2026-06-11T12:00:00Z"}, {"path": "/before", "at": "2026-06-11T09:00:00Z"}), path)
    refresh(spark, path)
    midnight = datetime(2026, 7, 11)
    wanted, at_midnight = scanned(spark, path), scanned(spark, path, midnight)
    assert '"day":"2026-06-11"' in wanted
    spoil(tmp_path, but=["2026-06-11"])
    assert stored(spark, path) == wanted
    spoil(tmp_path)
    assert stored(spark, path, midnight) == at_midnight


def test_engaged_listing_reads_the_days_it_lists(spark, visits, tmp_path):
    """Who engaged long ago is known from the summaries."""
    path = str(tmp_path / "t")
    old = [{"path": f"/old{n}", "at": f"2026-05-{n + 1:02}T00:00:00Z", "ip_hash": f"v{n}", "engaged": True} for n in range(20)]
    new = [{"path": f"/new{n}", "at": f"2026-07-{9 + n % 2:02}T00:{n:02}:00Z", "ip_hash": f"v{n}", "engaged": n % 3 == 0} for n in range(40)]
    append_visits(visits(*old, *new), path)
    refresh(spark, path)
    wanted = listing.recent_of_engaged(read_visits(spark, path), 5).collect()
    spoil(tmp_path, but=["2026-07-10", "2026-07-09"])
    assert listing.stored_recent_of_engaged(spark, path, 5).collect() == wanted and len(wanted) == 5


def test_a_hot_visitor_is_cut_into_shares(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    hot = [{"path": f"/hot{n}", "at": f"2026-07-10T00:{n % 60:02}:00Z", "ip_hash": "hot", "engaged": n == 0} for n in range(120)]
    append_visits(visits(*hot, *[{"path": f"/{n}", "ip_hash": f"v{n}"} for n in range(30)]), path)
    refresh(spark, path)
    found = listing.stored_recent_of_engaged(spark, path, 100, rows_per_share=10)
    assert found.collect() == listing.recent_of_engaged(read_visits(spark, path), 100).collect()
    assert {row.ip_hash for row in found.collect()} == {"hot"}


def test_a_table_without_summaries_or_visits(spark, visits, tmp_path):
    none, bare = str(tmp_path / "none"), str(tmp_path / "bare")
    assert refresh(spark, none) == 0 and read_counts(spark, none).isEmpty() and read_engaged(spark, none).isEmpty()
    assert stored(spark, none) == '{"engagedRate":0.0,"visitsPerDay":[],"topCountries":[],"topReferrers":[]}'
    append_visits(visits({"engaged": True}), bare)
    assert stored(spark, bare) == scanned(spark, bare)
    prune(spark, bare, NOW + timedelta(days=400), keep=AT_ONCE)
    assert stored(spark, bare) == scanned(spark, bare) == stored(spark, none)


def test_a_forgotten_day_leaves_no_summary(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    append_visits(visits({"at": "2026-01-01T00:00:00Z", "country": "Chile"}, {}), path)
    refresh(spark, path)
    prune(spark, path, NOW, keep=AT_ONCE)
    assert len(list((tmp_path / "t" / "_summaries" / "counts").glob("visit_day=*/version=*"))) == 1
    insert_if_absent(spark, visits({"at": "2026-01-01T00:00:00Z", "country": "Peru"}), path)
    assert sorted(row.country for row in read_counts(spark, path).collect()) == ["Peru", "Sweden"]


def test_one_scan_for_all_rollups(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    append_visits(visits({}, {"path": "/b"}), path)
    found = rollups.rollups(read_visits(spark, path), NOW)
    found.collect()
    text = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("FileScan parquet") == 1 and "WindowGroupLimit" in text


@pytest.mark.parametrize("kind", ["engaged", "counts"])
def test_summaries_cut_short_are_made_good(spark, visits, tmp_path, monkeypatch, kind):
    path = str(tmp_path / "t")
    append_visits(visits({"engaged": True}, {"path": "/b"}), path)
    with monkeypatch.context() as patch:
        patch.setattr(summaries, f"_{kind}", lambda visits: (_ for _ in ()).throw(OSError("the driver is gone")))
        with pytest.raises(OSError):
            refresh(spark, path)
    assert stored(spark, path) == scanned(spark, path)
    assert refresh(spark, path) > 0
    assert stored(spark, path) == scanned(spark, path) and read_engaged(spark, path).distinct().count() == 1
