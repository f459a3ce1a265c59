import hashlib
import ipaddress

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footfall.functions.device import with_device
from footfall.functions.net import registrable_domain, reverse_name, with_ip_key
from footfall.functions.privacy import ip_hash
from footfall.functions.times import iso_instant

SALT = "grains-for-checks-and-tests-only"


@pytest.fixture
def apply(spark):
    def run(function, values):
        found = spark.createDataFrame([(value,) for value in values], "x string").select(function(F.col("x")).alias("y"))
        return [row.y for row in found.collect()]

    return run


@pytest.mark.parametrize(
    "agent, expected",
    [
        ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/133.0.0.0 Safari/537.36", ("Chrome", "Windows", "DESKTOP")),
        ("Mozilla/5.0 (Windows NT 10.0) Chrome/133.0.0.0 Safari/537.36 Edg/133.0.3065.92", ("Edge", "Windows", "DESKTOP")),
        ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 Version/18.3 Safari/605.1.15", ("Safari", "macOS", "DESKTOP")),
        ("Mozilla/5.0 (iPhone; CPU iPhone OS 18_3 like Mac OS X) Version/18.3 Mobile/15E148 Safari/604.1", ("Safari", "iOS", "MOBILE")),
        ("Mozilla/5.0 (Linux; Android 15; Pixel 9) AppleWebKit/537.36 Chrome/133.0.0.0 Mobile Safari/537.36", ("Chrome", "Android", "MOBILE")),
        ("Mozilla/5.0 (X11; Linux x86_64; rv:135.0) Gecko/20100101 Firefox/135.0", ("Firefox", "Linux", "DESKTOP")),
        ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", ("bot", "other", "BOT")),
        ("curl/8.11.1", ("bot", "other", "BOT")),
        ("python on Windows", ("bot", "Windows", "BOT")),
        ("Opera/9.80", ("Opera", "other", "DESKTOP")),
        ("CriOS/99 iPad", ("Chrome", "iOS", "MOBILE")),
        ("SamsungBrowser/25 Chrome/121 Android", ("Samsung Internet", "Android", "MOBILE")),
        ("", ("unknown", "unknown", "UNKNOWN")),
        (" \t  ", ("unknown", "unknown", "UNKNOWN")),
        ("something", ("other", "other", "DESKTOP")),
    ],
)
def test_device(spark, agent, expected):
    found = with_device(spark.createDataFrame([(agent,)], "user_agent string")).first()
    assert (found.browser, found.os, found.device_kind) == expected


def test_hash(apply):
    found = apply(lambda x: ip_hash(x, SALT), ["203.0.113.7", "2001:db8::1"])
    assert found == [hashlib.sha256((SALT + a).encode()).hexdigest() for a in ("203.0.113.7", "2001:db8::1")]
    assert apply(lambda x: ip_hash(x, "another-salt-of-length"), ["203.0.113.7"])[0] != found[0]
    with pytest.raises(ValueError):
        ip_hash(F.col("x"), "short")


@pytest.mark.parametrize(
    "host, domain",
    [
        ("line-7-north.cable.example.", "cable.example"),
        ("resolver.example", "resolver.example"),
        ("smtp.bakery.co.uk", "bakery.co.uk"),
        ("a.b.bakery.CO.UK..", "bakery.co.uk"),
        (" x.example.com\t", "example.com"),
        ("a..b", "a.b"),
        ("co.uk", None),
        ("localhost", None),
        ("two words.example.net", None),
        ("é.com", None),
        ("", None),
        ("...", None),
    ],
)
def test_registrable_domain(apply, host, domain):
    assert apply(registrable_domain, [host]) == [domain]


def keys(spark, addresses):
    rows = [(i, address) for i, address in enumerate(addresses)]
    found = with_ip_key(spark.createDataFrame(rows, "i int, remote_ip string")).orderBy("i")
    return [(row.ip_key, row.arpa) for row in found.withColumn("arpa", reverse_name(F.col("ip_key"))).collect()]


def expected_key(address):
    parsed = ipaddress.ip_address(address)
    mapped = getattr(parsed, "ipv4_mapped", None)
    parsed = mapped or parsed
    return parsed.packed.hex(), parsed.reverse_pointer


def test_addresses(spark):
    literals = [
        "203.0.113.7", "0.0.0.0", "255.255.255.255", "2001:db8::1", "2001:DB8:0:0::A", "::", "::1", "1::", "1:2:3:4:5:6:7:8",
        "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:1.2.3.4", "::1.2.3.4", "64:ff9b::203.0.113.7", "fe80::1:0:0:1",
    ]
    assert keys(spark, literals) == [expected_key(a) for a in literals]


def test_what_is_no_address(spark):
    others = [
        "example.com", "not an ip", "", "1.2.3", "1.2.3.4.5", "256.1.1.1", "1.2.3.999", "1::2::3", "1:2:3", "12345::", "::g", ":::",
        ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1:2:3:4:5:6:7:8::", "1:2:3:4:5:6:7:8:9", "::1.2.3.400", "[::1]", "fe80::1%eth0", "1.2.3.4:80",
    ]
    assert keys(spark, others) == [(None, None)] * len(others)


def test_leading_zeros_are_decimal(spark):
    assert keys(spark, ["010.001.1.1"]) == [("0a010101", "1.1.1.10.in-addr.arpa")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.ip_addresses(v=4), st.ip_addresses(v=6)), min_size=20, max_size=40))
def test_any_address(spark, addresses):
    texts = [str(a) for a in addresses] + [a.exploded for a in addresses]
    assert keys(spark, texts) == [expected_key(t) for t in texts]


@pytest.mark.parametrize(
    "ms, text", [(1783764000000, "2026-07-11T10:00:00Z"), (1783764000500, "2026-07-11T10:00:00.500Z"), (1783764000007, "2026-07-11T10:00:00.007Z")]
)
def test_iso_instant(spark, ms, text):
    assert spark.range(1).select(iso_instant(F.timestamp_millis(F.lit(ms)))).first()[0] == text
