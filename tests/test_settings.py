import pytest

from footfall.session import INITIAL_PARTITIONS, shared_dir, shuffle_partitions, sized_shuffles
from footfall.settings import Settings, parse_limit, parse_list, parse_log_paths, parse_retention_days, parse_visitors

SALT = "0123456789abcdef"


@pytest.mark.parametrize("raw, expected", [(None, 50), ("1", 1), ("500", 500), (7, 7)])
def test_limit(raw, expected):
    assert parse_limit(raw) == expected


@pytest.mark.parametrize("raw", ["zero", "", "0", "501", 9999, "-1", "1.5", "1_0", " 5 ", 5.9, True, "٥"])
def test_wrong_limit(raw):
    with pytest.raises(ValueError):
        parse_limit(raw)


def test_visitors():
    assert parse_visitors(None) is None and parse_visitors("engaged") == "engaged"
    for raw in ("everyone", "", "Engaged"):
        with pytest.raises(ValueError):
            parse_visitors(raw)


@pytest.mark.parametrize("raw, expected", [(None, 90), ("30", 30), (1, 1)])
def test_retention_days(raw, expected):
    assert parse_retention_days(raw) == expected


@pytest.mark.parametrize("raw", ["0", "-5", "ninety", ""])
def test_wrong_retention_days(raw):
    with pytest.raises(ValueError):
        parse_retention_days(raw)


def test_lists():
    assert parse_list(" 10.0.0.1, ,10.0.0.2,") == ["10.0.0.1", "10.0.0.2"]
    assert parse_list(None) == [] and parse_list("") == []
    assert parse_log_paths("/a.log, /b.log") == ["/a.log", "/b.log"]
    for raw in (None, "", " , "):
        with pytest.raises(ValueError):
            parse_log_paths(raw)


def test_settings_from_env():
    found = Settings.from_env({"IP_HASH_SALT": SALT, "INTERNAL_PROXY_IPS": "10.0.0.1, 10.0.0.2", "RETENTION_DAYS": "30"})
    assert found == Settings(SALT, frozenset({"10.0.0.1", "10.0.0.2"}), 30)
    assert Settings.from_env({"IP_HASH_SALT": SALT}) == Settings(SALT, frozenset(), 90)
    for env in ({}, {"IP_HASH_SALT": " "}, {"IP_HASH_SALT": SALT[:-1]}, {"IP_HASH_SALT": SALT, "RETENTION_DAYS": "0"}):
        with pytest.raises(ValueError):
            Settings.from_env(env)


def test_shuffles_grow_with_the_input(spark):
    assert shuffle_partitions(spark, 0) == 4
    with sized_shuffles(spark, 4 * 2**40) as partitions:
        assert 1000 < partitions < 2000 and spark.conf.get(INITIAL_PARTITIONS) == str(partitions)
    assert spark.conf.get(INITIAL_PARTITIONS, None) is None
    spark.conf.set(INITIAL_PARTITIONS, "7")
    try:
        with sized_shuffles(spark, 0):
            pass
        assert spark.conf.get(INITIAL_PARTITIONS) == "7"
    finally:
        spark.conf.unset(INITIAL_PARTITIONS)


def test_a_local_session_has_a_folder_of_its_own(spark):
    assert shared_dir(spark) == shared_dir(spark)
