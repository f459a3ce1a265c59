import os
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from footfall.schemas import VISIT  # noqa: E402
from footfall.session import prepare  # noqa: E402

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("footfall-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "1000")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


def millis(moment: str) -> int:
    """Epoch milliseconds of an ISO moment in UTC."""
    at = datetime.fromisoformat(moment.replace("Z", "+00:00"))
    return (at - EPOCH) // timedelta(milliseconds=1)


SAMPLE = {
    "site": "guide.example",
    "path": "/",
    "engaged": False,
    "country": "Sweden",
    "city": "Örebro",
    "asn": 64510,
    "org": "Lake Networks",
    "browser": "Chrome",
    "os": "Windows",
    "device_kind": "DESKTOP",
    "ip_hash": "a" * 64,
    "referrer": "https://github.com/x",
    "at": "2026-07-11T10:00:00Z",
    "org_domain": "cable.example",
}


def make_visits(spark, *changes):
    """Stored visits like the sample, each with its own changes; `at` is an ISO moment."""
    from footfall.operators.visits import as_visits

    rows = []
    for change in changes:
        row = SAMPLE | change
        rows.append(tuple(millis(row["at"]) if f.name == "visited_at" else row[f.name] for f in VISIT))
    schema = ", ".join(
        f"{f.name} {'bigint' if f.name == 'visited_at' else f.dataType.simpleString()}" for f in VISIT
    )
    found = spark.createDataFrame(rows, schema)
    return as_visits(found.withColumn("visited_at", F.timestamp_millis("visited_at")))


@pytest.fixture
def visits(spark):
    return lambda *changes: make_visits(spark, *changes)


UA = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/133.0.0.0 Safari/537.36"


def line(
    ts="1760000000.25",
    status="200",
    method="GET",
    uri="/",
    host="store.example",
    address='"remote_ip":"203.0.113.7","client_ip":"203.0.113.7"',
    headers=f'"User-Agent":["{UA}"],"Referer":["https://github.com/x"]',
):
    """One access-log line."""
    return (
        f'{{"level":"info","ts":{ts},"msg":"handled request","request":{{{address},"proto":"HTTP/2.0",'
        f'"method":"{method}","host":"{host}","uri":"{uri}","headers":{{{headers}}}}},'
        f'"bytes_read":0,"duration":0.000123,"size":2326,"status":{status}}}'
    )


@pytest.fixture
def lines(spark):
    return lambda *texts: spark.createDataFrame([(text,) for text in texts], "value string")
