import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from footfall.functions.net import with_ip_key
from footfall.operators.geo import locate, ptr_ranges, range_lookup
from footfall.operators.skew import salted_join
from footfall.sources.lookups import network_ranges, numeric_ranges, read_asn_ranges, read_city_ranges, read_prepared, write_prepared


def addresses(spark, *texts):
    return spark.createDataFrame([(text,) for text in texts], "remote_ip string")


@pytest.fixture
def city(spark):
    rows = [
        ("198.51.100.112/28", "Sweden", "Örebro"),
        ("192.0.2.216/29", "United Kingdom", "Bath"),
        ("2001:220::/32", "South Korea", None),
    ]
    return network_ranges(spark.createDataFrame(rows, "network string, country string, city string"))


@pytest.fixture
def asn(spark):
    rows = [("100.64.0.0/11", 64500, "Coast Telecom"), ("198.51.0.0/17", 64510, "Lake Networks")]
    return network_ranges(spark.createDataFrame(rows, "network string, asn bigint, org string"))


def test_fields_resolve_independently(spark, city, asn):
    sent = addresses(spark, "198.51.100.128", "198.51.100.120", "100.64.0.1", "192.0.2.216", "10.0.0.150", "not-an-ip", "2001:220::7")
    found = {row.remote_ip: (row.country, row.city, row.asn, row.org) for row in locate(sent, city, asn).collect()}
    assert found == {
        "198.51.100.128": (None, None, 64510, "Lake Networks"),
        "198.51.100.120": ("Sweden", "Örebro", 64510, "Lake Networks"),
        "100.64.0.1": (None, None, 64500, "Coast Telecom"),
        "192.0.2.216": ("United Kingdom", "Bath", None, None),
        "10.0.0.150": (None, None, None, None),
        "not-an-ip": (None, None, None, None),
        "2001:220::7": ("South Korea", None, None, None),
    }


def test_every_row_stays_once(spark, city, asn):
    sent = addresses(spark, *["198.51.100.120"] * 5, *["nowhere"] * 3).withColumn("n", F.monotonically_increasing_id())
    assert locate(sent, city, asn).count() == 8


@pytest.mark.parametrize("network", ["0.0.0.0/0", "::/0", "128.0.0.0/1", "10.0.0.0/8", "10.1.2.3/32", "::ffff:10.0.0.0/104", "2000::/3", "2001:db8::/29"])
def test_network_ends(spark, network):
    found = network_ranges(spark.createDataFrame([(network,)], "network string")).first()
    if network.startswith("::ffff:"):
        network = "10.0.0.0/8"
    parsed = ipaddress.ip_network(network)
    assert (found.lo, found.hi) == (parsed[0].packed.hex(), parsed[-1].packed.hex())


def test_networks_that_are_none_are_dropped(spark):
    rows = [("x/8",), ("10.0.0.0/33",), ("10.0.0.0/x",), ("2001:db8::/129",), ("10.0.0.0/-1",)]
    assert network_ranges(spark.createDataFrame(rows, "network string")).count() == 0


def disjoint_ranges(rng, space, width, count):
    """Ranges of very different sizes that do not overlap, cut at random points of a space."""
    start, size = space
    points = sorted({start + rng.randrange(size) for _ in range(count)} | {start + rng.randrange(min(size, 5000)) for _ in range(count)})
    return [(a, b - 1 if rng.random() < 0.7 else a + (b - a) // 2, f"r{a}") for a, b in zip(points, points[1:]) if b - 1 >= a + (b - a) // 2]


@pytest.mark.parametrize("family, space", [(4, (0, 2**32)), (4, (203 * 2**24, 2**12)), (6, (0x2001 << 112, 2**112)), (6, (0, 2**128))])
def test_against_brute_force(spark, family, space):
    rng = random.Random(7)
    width = 8 if family == 4 else 32
    make = ipaddress.IPv4Address if family == 4 else ipaddress.IPv6Address
    ranges = disjoint_ranges(rng, space, width, 60)
    probes = {lo for lo, _, _ in ranges} | {hi for _, hi, _ in ranges} | {hi + 1 for _, hi, _ in ranges if hi + 1 < 2 ** (width * 4)}
    probes |= {space[0] + rng.randrange(space[1]) for _ in range(200)}
    table = spark.createDataFrame([(f"{lo:0{width}x}", f"{hi:0{width}x}", name) for lo, hi, name in ranges], "lo string, hi string, country string")
    asked = with_ip_key(addresses(spark, *[str(make(p)) for p in probes if not (family == 6 and make(p).ipv4_mapped)]))
    found = {row.remote_ip: row.country for row in range_lookup(asked, [(table, ["country"])]).collect()}
    assert found == {str(make(p)): name for p in probes for lo, hi, name in ranges if lo <= p <= hi}


def test_narrowest_of_nested_networks(spark):
    rows = [("10.0.0.0/8", "wide"), ("10.1.0.0/16", "middle"), ("10.1.0.0/24", "narrow"), ("0.0.0.0/0", "everything")]
    table = network_ranges(spark.createDataFrame(rows, "network string, country string"))
    asked = with_ip_key(addresses(spark, "10.1.0.9", "10.1.1.9", "10.2.0.9", "11.0.0.1"))
    found = {row.remote_ip: row.country for row in range_lookup(asked, [(table, ["country"])]).collect()}
    assert found == {"10.1.0.9": "narrow", "10.1.1.9": "middle", "10.2.0.9": "wide", "11.0.0.1": "everything"}


def test_copies_of_a_range_count_once(spark):
    rows = [("10.0.0.0/8", "a", "x")] * 500 + [("10.0.0.0/8", "b", "w")]
    table = network_ranges(spark.createDataFrame(rows, "network string, country string, city string"))
    found = locate(addresses(spark, "10.0.0.1", "10.0.0.1", "10.0.0.2"), table)
    assert sorted(tuple(row) for row in found.collect()) == [("10.0.0.1", "a", "x")] * 2 + [("10.0.0.2", "a", "x")]


def test_numeric_ranges(spark):
    rows = [(7, 3405774848), (-1, 5), (9, 8), (5, 2**32), (None, 5)]
    found = [tuple(row) for row in numeric_ranges(spark.createDataFrame(rows, "lo bigint, hi bigint")).collect()]
    assert found == [("00000007", "cb000000")]


def test_ptr_domains_join_by_address_not_by_spelling(spark):
    rows = [("2001:DB8::1", "a.example.com."), ("203.0.113.7", "line-4.cable.example"), ("203.0.113.7", "zz.other.net"), ("name", "x.y.z")]
    ptr = spark.createDataFrame(rows, "client_ip string, ptr_host string")
    assert ptr_ranges(ptr).count() == 2
    found = locate(addresses(spark, "2001:db8:0::1", "203.0.113.7", "203.0.113.8", "name"), ptr=ptr)
    assert {row.remote_ip: row.org_domain for row in found.collect()} == {
        "2001:db8:0::1": "example.com",
        "203.0.113.7": "cable.example",
        "203.0.113.8": None,
        "name": None,
    }


def test_published_csv_files(spark, tmp_path):
    (tmp_path / "v4.csv").write_text(
        "network,geoname_id,registered_country_geoname_id,represented_country_geoname_id,is_anonymous_proxy,"
        "is_satellite_provider,postal_code,latitude,longitude,accuracy_radius,is_anycast\n"
        "198.51.100.112/28,1000001,1000000,,0,0,,58.4,15.6,76,\n10.0.0.0/8,,1000000,,0,0,,,,,\n"
    )
    (tmp_path / "v6.csv").write_text("network,geoname_id\n2001:220::/32,1835841\n")
    (tmp_path / "locations.csv").write_text(
        "geoname_id,locale_code,continent_code,continent_name,country_iso_code,country_name,subdivision_1_iso_code,"
        "subdivision_1_name,subdivision_2_iso_code,subdivision_2_name,city_name,metro_code,time_zone,is_in_european_union\n"
        '1000001,en,EU,Europe,SE,Sweden,E,"Närke, County",,,Örebro,,Europe/Stockholm,1\n'
        '1835841,en,AS,Asia,KR,"South Korea",,,,,,,Asia/Seoul,0\n'
    )
    (tmp_path / "asn.csv").write_text('network,autonomous_system_number,autonomous_system_organization\n100.64.0.0/11,64500,"Coast ""Telecom"" Ltd"\n')
    city = read_city_ranges(spark, [str(tmp_path / "v4.csv"), str(tmp_path / "v6.csv")], str(tmp_path / "locations.csv"))
    assert sorted(tuple(row) for row in city.collect()) == [
        ("20010220" + "0" * 24, "20010220" + "f" * 24, "South Korea", None),
        ("c6336470", "c633647f", "Sweden", "Örebro"),
    ]
    assert [tuple(row) for row in read_asn_ranges(spark, str(tmp_path / "asn.csv")).collect()] == [("64400000", "645fffff", 64500, 'Coast "Telecom" Ltd')]


@pytest.mark.parametrize("how", ["left", "left_semi", "inner"])
def test_a_hot_key_is_cut_and_nothing_changes(spark, how):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("key"))
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("unused", 4)], "key string, value int")
    found = salted_join(facts, lookup, "key", how, rows_per_share=100)
    plain = facts.join(lookup, "key", how)
    assert sorted(tuple(r) for r in found.select(plain.columns).collect()) == sorted(tuple(r) for r in plain.collect())


def test_a_hot_key_lands_in_many_partitions(spark):
    facts = spark.range(4000).select("id", F.lit("hot").alias("key"))
    lookup = spark.createDataFrame([("hot", 1)], "key string, value int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = salted_join(facts, lookup, "key", "left", rows_per_share=100)
        sizes = [row["count"] for row in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and len(sizes) == 4


def test_prepared_tables_answer_the_same(spark, tmp_path):
    """Nested and disjoint networks of many lengths, IPv4 and IPv6, with and without PTR records."""
    chosen = random.Random(5)
    networks = [(f"10.{chosen.randrange(4)}.{chosen.randrange(256)}.0/{chosen.choice([9, 14, 17, 24, 29])}", f"c{n}", f"t{n}") for n in range(60)]
    networks += [("2001:db8::/32", "six", None), ("2001:db8:1::/48", "nested", "x")]
    city = network_ranges(spark.createDataFrame(networks, "network string, country string, city string"))
    asn = network_ranges(spark.createDataFrame([("10.0.0.0/8", 64500, "a"), ("10.1.0.0/16", 64501, "b")], "network string, asn long, org string"))
    ptr = spark.createDataFrame([("10.1.2.3", "a.cable.example."), ("2001:db8::1", "b.example")], "client_ip string, ptr_host string")
    sent = [f"10.{chosen.randrange(5)}.{chosen.randrange(256)}.{chosen.randrange(256)}" for _ in range(300)]
    asked = addresses(spark, *sent, "10.1.2.3", "2001:db8::1", "2001:db8:1::9", "11.0.0.1", "nowhere")
    write_prepared(spark, str(tmp_path / "lookups"), city, asn, ptr)
    prepared = read_prepared(spark, str(tmp_path / "lookups"))
    assert set(prepared.widths) < set(range(2, 34, 2))
    fields = ["remote_ip", "country", "city", "asn", "org", "org_domain"]
    plain = locate(asked, city, asn, ptr).select(*fields).collect()
    assert sorted(map(str, locate(asked, prepared=prepared).select(*fields).collect())) == sorted(map(str, plain))
    write_prepared(spark, str(tmp_path / "none"))
    nothing = locate(asked, prepared=read_prepared(spark, str(tmp_path / "none")))
    assert nothing.count() == asked.count() and nothing.filter("country IS NOT NULL OR org_domain IS NOT NULL").isEmpty()


def test_lookups_are_replaced_while_a_batch_runs(spark, tmp_path):
    """A batch keeps the tables it began with; one that begins later has the new ones; a torn preparation does not count."""
    path = str(tmp_path / "lookups")
    asked = spark.createDataFrame([("10.0.0.1",)], "remote_ip string")

    def city(name):
        return network_ranges(spark.createDataFrame([("10.0.0.0/8", name, name)], "network string, country string, city string"))

    write_prepared(spark, path, city("first"))
    running = locate(asked, prepared=read_prepared(spark, path))
    write_prepared(spark, path, city("second"))
    torn = tmp_path / "lookups" / "prepared-99999999999999999999"
    torn.mkdir()
    assert [row.country for row in running.collect()] == ["first"]
    assert [row.country for row in locate(asked, prepared=read_prepared(spark, path)).collect()] == ["second"]
    torn.rmdir()
    for name in ("third", "fourth", "fifth"):
        write_prepared(spark, path, city(name))
    assert len(list((tmp_path / "lookups").glob("prepared-*"))) == 3
    assert [row.city for row in locate(asked, prepared=read_prepared(spark, path)).collect()] == ["fifth"]
