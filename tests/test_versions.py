"""Days in versions: no step of a swap loses or doubles a visit, readers see one version whole."""

import random
from datetime import date, datetime, timedelta

import pytest

from footfall.operators.retention import prune
from footfall.sources import versions, visits_table
from footfall.sources.versions import read_manifest, sweep
from footfall.sources.visits_table import append_visits, compact, insert_if_absent, read_visits

NOW = datetime(2026, 7, 11, 10)
AT_ONCE = timedelta(0)


def paths(frame):
    return sorted(row.path for row in frame.collect())


def failing(monkeypatch, module, name, nth=1):
    """The nth call of a step fails before it does anything."""
    real, calls = getattr(module, name), []

    def step(*args):
        calls.append(args)
        if len(calls) == nth:
            raise OSError("the driver is gone")
        return real(*args)

    monkeypatch.setattr(module, name, step)


STEPS = [(visits_table, "commit", 1), (versions, "write_text", 1), (versions, "rename", 1), (versions, "remove", 1), (versions, "remove", 2), (versions, "write_text", 2)]


@pytest.mark.parametrize(("module", "step", "nth"), STEPS)
@pytest.mark.parametrize("upkeep", ["prune", "compact"])
def test_a_swap_cut_short_and_a_late_visit(spark, visits, tmp_path, monkeypatch, module, step, nth, upkeep):
    """Ten visits are kept of the day that is rewritten; one more comes after the failure."""
    path = str(tmp_path / "t")
    for n in range(10):
        append_visits(visits({"path": f"/{n}", "at": f"2026-04-12T1{n % 2}:30:00Z"}), path)
    append_visits(visits({"path": "/old", "at": "2026-04-12T09:00:00Z"}, {"path": "/older", "at": "2026-04-01T09:00:00Z"}), path)

    def run():
        return prune(spark, path, NOW, keep=AT_ONCE) if upkeep == "prune" else compact(spark, path, 1, keep=AT_ONCE)

    with monkeypatch.context() as broken:
        failing(broken, module, step, nth)
        try:
            run()
        except OSError:
            pass
    before = paths(read_visits(spark, path))
    assert before in ([f"/{n}" for n in range(10)], sorted([*[f"/{n}" for n in range(10)], "/old", "/older"]))
    insert_if_absent(spark, visits({"path": "/late", "at": "2026-04-12T23:00:00Z"}, {"path": "/3", "at": "2026-04-12T11:30:00Z"}), path)
    assert paths(read_visits(spark, path)) == sorted([*before, "/late"])
    run()
    prune(spark, path, NOW, keep=AT_ONCE)
    assert paths(read_visits(spark, path)) == [*[f"/{n}" for n in range(10)], "/late"]
    assert prune(spark, path, NOW) == 0


def test_a_reader_during_a_swap_sees_one_version_whole(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        append_visits(visits({"path": f"/{n}", "at": f"2026-04-12T{n + 8:02}:00:00Z"}), path)
    early = read_visits(spark, path)
    assert prune(spark, path, NOW) == 2
    late = read_visits(spark, path)
    append_visits(visits({"path": "/late", "at": "2026-04-12T12:00:00Z"}), path)
    compact(spark, path, most_files=1)
    assert paths(early) == ["/0", "/1", "/2", "/3"]
    assert paths(late) == ["/2", "/3"]
    assert paths(read_visits(spark, path)) == ["/2", "/3", "/late"]
    sweep(spark, path, AT_ONCE)
    assert len(list((tmp_path / "t").glob("visit_day=*/version=*"))) == 1
    assert paths(read_visits(spark, path)) == ["/2", "/3", "/late"]


def test_a_forgotten_day_takes_visits_again(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    append_visits(visits({"path": "/a", "at": "2026-01-01T00:00:00Z"}, {"path": "/now"}), path)
    assert prune(spark, path, NOW) == 1
    insert_if_absent(spark, visits({"path": "/b", "at": "2026-01-01T00:00:00Z"}), path)
    assert paths(read_visits(spark, path)) == ["/b", "/now"]
    assert paths(read_visits(spark, path, [date(2026, 1, 1), date(2026, 1, 2)])) == ["/b"]
    assert prune(spark, path, NOW, keep=AT_ONCE) == 1
    assert sorted(p.name for p in (tmp_path / "t").glob("visit_day=*")) == ["visit_day=2026-07-11"]
    # Nothing is left of the day, so it begins anew.
    assert read_manifest(spark, path).current == {}
    insert_if_absent(spark, visits({"path": "/c", "at": "2026-01-01T00:00:00Z"}), path)
    assert paths(read_visits(spark, path)) == ["/c", "/now"]


def test_a_table_older_than_versions_is_read_and_adopted(spark, visits, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    visits({"path": "/a"}, {"path": "/b", "at": "2026-07-10T00:00:00Z"}).write.partitionBy("visit_day").parquet(path)
    assert paths(read_visits(spark, path)) == ["/a", "/b"]
    with monkeypatch.context() as broken:
        failing(broken, versions, "rename", 2)
        with pytest.raises(OSError):
            append_visits(visits({"path": "/c"}), path)
    append_visits(visits({"path": "/c"}), path)
    assert paths(read_visits(spark, path)) == ["/a", "/b", "/c"]


@pytest.mark.parametrize("work", ["insert", "prune", "compact"])
def test_work_on_a_table_older_than_versions(spark, visits, tmp_path, work):
    path = str(tmp_path / "t")
    for n in range(3):
        visits({"path": f"/{n}"}, {"path": f"/old{n}", "at": "2026-04-01T00:00:00Z"}).write.mode("append").partitionBy("visit_day").parquet(path)
    kept = ["/0", "/1", "/2", "/old0", "/old1", "/old2"]
    if work == "insert":
        insert_if_absent(spark, visits({"path": "/1"}, {"path": "/new"}), path)
        kept = sorted([*kept, "/new"])
    elif work == "prune":
        assert prune(spark, path, NOW) == 3
        kept = kept[:3]
    else:
        assert compact(spark, path, most_files=1) == [date(2026, 4, 1), date(2026, 7, 11)]
    assert paths(read_visits(spark, path)) == kept


def test_a_second_writer_is_refused(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    append_visits(visits({"path": "/a"}), path)
    seen = versions.manifest_to_write_by(spark, path)
    versions.commit(spark, path, seen, {"2026-07-11": 1})
    with pytest.raises(OSError, match="another writer"):
        versions.commit(spark, path, seen, {"2026-07-11": 1})


def test_only_the_last_manifests_stay(spark, visits, tmp_path):
    path = str(tmp_path / "t")
    for n in range(8):
        append_visits(visits({"path": f"/{n}a"}, {"path": f"/{n}b"}), path)
        append_visits(visits({"path": f"/{n}c"}), path)
        compact(spark, path, most_files=1, keep=AT_ONCE)
    assert len(list((tmp_path / "t" / "_versions").glob("*.json"))) <= versions.EARLIER_MANIFESTS + 2
    assert read_visits(spark, path).count() == 24


def test_random_work_with_failures_against_a_plain_set(spark, visits, tmp_path, monkeypatch):
    rng, path, held = random.Random(11), str(tmp_path / "t"), {}
    for turn in range(24):
        now = NOW + timedelta(hours=6 * turn)
        act = rng.choice(["insert", "insert", "prune", "compact"])
        broken = rng.random() < 0.4
        with monkeypatch.context() as patch:
            if broken:
                failing(patch, versions, rng.choice(["write_text", "rename", "remove"]), rng.randrange(1, 4))
            try:
                if act == "insert":
                    ages = [timedelta(hours=rng.randrange(0, 60)) for _ in range(4)]
                    batch = [{"path": f"/{turn}-{k}", "at": (now - age).isoformat() + "Z"} for k, age in enumerate(ages)]
                    insert_if_absent(spark, visits(*batch), path)
                    held |= {row["path"]: now - age for row, age in zip(batch, ages)}
                elif act == "prune":
                    prune(spark, path, now, 1, keep=AT_ONCE)
                else:
                    compact(spark, path, 1, keep=AT_ONCE)
            except OSError:
                if act == "insert":
                    insert_if_absent(spark, visits(*batch), path)
                    held |= {row["path"]: now - age for row, age in zip(batch, ages)}
        if act == "prune":
            prune(spark, path, now, 1, keep=AT_ONCE)
            held = {name: at for name, at in held.items() if at >= now - timedelta(days=1)}
        assert paths(read_visits(spark, path)) == sorted(held), (turn, act, broken)
