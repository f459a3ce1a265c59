"""Lookup tables: network ranges and PTR records as DataFrames, and all of them prepared as one table."""

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.net import with_ip_key
from footfall.functions.once import evaluate_once
from footfall.operators.geo import Prepared, keyed_ranges, lookup_tables
from footfall.sources.files import children, exists, remove, write_text

_CITY_BLOCKS = (
    "network string, geoname_id string, registered_country_geoname_id string, "
    "represented_country_geoname_id string, is_anonymous_proxy string, is_satellite_provider string, "
    "postal_code string, latitude string, longitude string, accuracy_radius string, is_anycast string"
)
_CITY_LOCATIONS = (
    "geoname_id string, locale_code string, continent_code string, continent_name string, "
    "country_iso_code string, country_name string, subdivision_1_iso_code string, "
    "subdivision_1_name string, subdivision_2_iso_code string, subdivision_2_name string, "
    "city_name string, metro_code string, time_zone string, is_in_european_union string"
)
_ASN_BLOCKS = "network string, autonomous_system_number bigint, autonomous_system_organization string"


def _read_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("escape", '"').csv(paths)


def _masked(key: Column, bits: Column, fill: str) -> Column:
    """A key with every bit after the first `bits` cleared (fill 0) or set (fill f)."""
    whole = F.floor(bits / 4).cast("int")
    partial = (bits % 4).cast("int")
    digit = F.conv(F.substring(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.element_at(F.array(*[F.lit(n) for n in (16, 8, 4, 2)]), partial + 1)
    cleared = F.floor(digit / step) * step
    edge = F.lower(F.hex((cleared if fill == "0" else cleared + step - 1).cast("bigint")))
    head = F.concat(F.substring(key, F.lit(1), whole), F.when(partial > 0, edge).otherwise(F.lit("")))
    return F.rpad(head, F.length(key), F.lit(fill))


def network_ranges(blocks: DataFrame, network: str = "network") -> DataFrame:
    """Replace a CIDR column by lo and hi keys (see with_ip_key); rows without a valid one are dropped."""
    address = F.substring_index(network, "/", 1)
    bits = F.substring_index(network, "/", -1).try_cast("int")
    keyed = with_ip_key(blocks.withColumn("_address", address).withColumn("_bits", bits), "_address", "_key")
    # An IPv4-mapped network counts its bits from the IPv6 start.
    mapped = F.col("_address").contains(":") & (F.length("_key") == 8)
    keyed = keyed.withColumn("_bits", F.when(mapped, F.col("_bits") - 96).otherwise(F.col("_bits")))
    valid = F.col("_key").isNotNull() & F.col("_bits").between(0, F.length("_key") * 4)
    key, length = F.col("_key"), F.col("_bits")
    ends = evaluate_once(lo=_masked(key, length, "0"), hi=_masked(key, length, "f"))
    return keyed.filter(valid).select(ends, *[name for name in blocks.columns if name != network])


def numeric_ranges(ranges: DataFrame) -> DataFrame:
    """Replace IPv4 lo and hi given as numbers by keys; rows that are no such range are dropped."""
    ranges = ranges.filter("lo BETWEEN 0 AND hi AND hi <= 4294967295")
    for end in ("lo", "hi"):
        ranges = ranges.withColumn(end, F.lpad(F.lower(F.hex(F.col(end).cast("bigint"))), 8, "0"))
    return ranges


def read_city_ranges(spark: SparkSession, blocks: str | list[str], locations: str) -> DataFrame:
    """(lo, hi, country, city) from the published CSV blocks (IPv4 and IPv6) and their locations."""
    places = _read_csv(spark, locations, _CITY_LOCATIONS).select(
        "geoname_id", F.col("country_name").alias("country"), F.col("city_name").alias("city")
    )
    networks = _read_csv(spark, blocks, _CITY_BLOCKS).select("network", "geoname_id")
    return network_ranges(networks).join(places, "geoname_id").select("lo", "hi", "country", "city")


def read_asn_ranges(spark: SparkSession, blocks: str | list[str]) -> DataFrame:
    """(lo, hi, asn, org) from the published CSV blocks."""
    networks = _read_csv(spark, blocks, _ASN_BLOCKS).select(
        "network",
        F.col("autonomous_system_number").alias("asn"),
        F.col("autonomous_system_organization").alias("org"),
    )
    return network_ranges(networks)


def read_ptr_table(spark: SparkSession, path: str) -> DataFrame:
    """(client_ip, ptr_host) records resolved beforehand; nothing is looked up while a job runs."""
    return spark.read.schema("client_ip string, ptr_host string").parquet(path)


_EMPTY = ("lo string, hi string, country string, city string", "lo string, hi string, asn bigint, org string", "client_ip string, ptr_host string")
_PREPARED = (
    "bucket string, lo string, hi string, table int, f0 struct<country: string, city: string>, "
    "f1 struct<asn: bigint, org: string>, f2 struct<org_domain: string>, width int"
)


# Each preparation has a folder of its own; the last one that is complete counts.
_PREPARATION, _COMPLETE = "prepared-", "_complete"
# Preparations that stay beside the last, for batches that began with one of them.
EARLIER_PREPARATIONS = 2


def write_prepared(
    spark: SparkSession, path: str, city: DataFrame | None = None, asn: DataFrame | None = None, ptr: DataFrame | None = None
) -> None:
    """Store the tables as they are probed, once, so that no batch has to group and cut the ranges again.

    They are written beside what was prepared before and count from the moment they are complete: a batch that runs
    meanwhile keeps the tables it began with. The table is partitioned by the length of the prefix, so that
    the lengths that occur are its folders.
    """
    given = [spark.createDataFrame([], schema) if table is None else table for table, schema in zip((city, asn, ptr), _EMPTY)]
    keyed = keyed_ranges(lookup_tables(*given)).withColumn("width", F.length("bucket"))
    ordered = keyed.repartition("width", F.substring("bucket", 1, 4)).sortWithinPartitions("width", "bucket")
    folder = f"{path}/{_PREPARATION}{time.time_ns():020}"
    ordered.write.partitionBy("width").parquet(folder)
    write_text(spark, f"{folder}/{_COMPLETE}", "")
    for name in _preparations(spark, path)[: -1 - EARLIER_PREPARATIONS]:
        remove(spark, f"{path}/{name}")



def _preparations(spark: SparkSession, path: str) -> list[str]:
    """Complete preparations, the oldest first."""
    names = [name for name in children(spark, path) if name.startswith(_PREPARATION)]
    return [name for name in names if exists(spark, f"{path}/{name}/{_COMPLETE}")]


def read_prepared(spark: SparkSession, path: str) -> Prepared:
    """What write_prepared stored last; nothing but the names of its folders is read."""
    complete = _preparations(spark, path)
    folder = f"{path}/{complete[-1]}" if complete else path
    widths = sorted(int(name.split("=")[1]) for name in children(spark, folder) if name.startswith("width="))
    return Prepared(spark.read.schema(_PREPARED).parquet(folder).drop("width"), widths)
