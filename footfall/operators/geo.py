"""Where an address is and whose network it belongs to: range joins without address-range pairs."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.net import registrable_domain, with_ip_key
from footfall.functions.once import evaluate_once
from footfall.operators.skew import ROWS_PER_SHARE, salted_join

# Keys are cut at whole bytes, two hex digits each.
_WIDTHS = "sequence(2, length(ip_key), 2)"
# What each table tells, in the order in which a prepared table numbers them.
CITY, ASN, PTR = ["country", "city"], ["asn", "org"], ["org_domain"]


@dataclass(frozen=True)
class Prepared:
    """Keyed ranges of all three tables, computed beforehand, and the prefix lengths that occur."""

    ranges: DataFrame
    widths: list[int]


def _bucketed(ranges: DataFrame) -> DataFrame:
    """Each range under the byte prefixes it covers, at the one length where those number at most 256.

    Ranges of a table do not overlap, so a prefix meets at most three of them (one across each of
    its ends, or one that covers it): however dense the table, an address is compared with only a few.
    """
    shared = "2 * size(filter(sequence(2, length(lo), 2), width -> substring(lo, 1, width) = substring(hi, 1, width)))"
    steps = {
        "_stem": "substring(lo, 1, _shared)",
        "_low": "substring(lo, _shared + 1)",
        "_high": "substring(hi, _shared + 1)",
        "_whole": "_shared > 0 AND trim(TRAILING '0' FROM _low) = '' AND trim(TRAILING 'f' FROM _high) = ''",
        "_bytes": """sequence(CAST(conv(substring(_low, 1, 2), 16, 10) AS int),
            CAST(conv(substring(_high, 1, 2), 16, 10) AS int))""",
        "_below": "transform(_bytes, byte -> concat(_stem, lpad(lower(hex(byte)), 2, '0')))",
    }
    stepwise = ranges.select("*", evaluate_once(_shared=F.expr(shared)))
    stepwise = stepwise.select("*", *[F.expr(step).alias(name) for name, step in steps.items()])
    covered = evaluate_once(_covered=F.expr("CASE WHEN _whole THEN array(_stem) ELSE _below END"))
    return stepwise.select(*ranges.columns, covered).select(*ranges.columns, F.explode("_covered").alias("bucket"))


def _narrowness() -> Column:
    """Of nested ranges the narrowest starts last, and of those with one start it ends first."""
    return F.struct("lo", F.translate("hi", "0123456789abcdef", "fedcba9876543210"))


def keyed_ranges(tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """All ranges under the prefixes they are probed by: bucket, lo, hi, table, and f0, f1, ... with the fields."""
    sides = []
    for number, (ranges, fields) in enumerate(tables):
        known = [F.lit(None).cast(_struct_type(other, names)).alias(f"f{n}") for n, (other, names) in enumerate(tables)]
        known[number] = F.struct(*fields).alias(f"f{number}")
        sides.append(_bucketed(ranges).select("bucket", "lo", "hi", F.lit(number).alias("table"), *known))
    return reduce(DataFrame.unionByName, sides)


def range_lookup(addresses: DataFrame, tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """(remote_ip, *fields of every table) for each distinct keyed address that some range holds."""
    return probe(addresses, keyed_ranges(tables), [fields for _, fields in tables])


def probe(addresses: DataFrame, ranges: DataFrame, fields: list[list[str]], widths: list[int] | None = None) -> DataFrame:
    """Look addresses up in keyed ranges.

    Each table answers for itself; where its ranges nest, the narrowest wins. All tables are probed at
    once, at the prefix lengths that occur in them if those are known. A prefix that most addresses share
    is a skewed join key with a handful of ranges: adaptive execution splits its addresses over tasks.
    """
    lengths = _WIDTHS if widths is None else f"filter(array({', '.join(map(str, widths))}), width -> width <= length(ip_key))"
    prefixes = F.expr(f"transform({lengths}, width -> substring(ip_key, 1, width))")
    probes = addresses.filter(F.col("ip_key").isNotNull()).select("remote_ip", "ip_key", F.explode(prefixes).alias("bucket"))
    inside = probes.join(ranges, "bucket").filter(
        F.col("ip_key").between(F.col("lo"), F.col("hi")) & (F.length("ip_key") == F.length("lo"))
    )
    best = [
        F.max_by(F.col(f"f{n}"), F.when(F.col("table") == n, _narrowness())).alias(f"f{n}") for n in range(len(fields))
    ]
    found = inside.groupBy("remote_ip").agg(*best)
    return found.select("remote_ip", *[f"f{n}.{name}" for n, names in enumerate(fields) for name in names])


def _struct_type(df: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, df.schema[name].dataType) for name in names])


def one_per_range(ranges: DataFrame, fields: list[str]) -> DataFrame:
    """Copies of a range would each be compared with every address in it; the least row stands for all."""
    merged = ranges.groupBy("lo", "hi").agg(F.min(F.struct(*fields)).alias("least"))
    return merged.select("lo", "hi", "least.*")


def ptr_ranges(ptr: DataFrame) -> DataFrame:
    """PTR records as ranges of one address each: (lo, hi, org_domain), never the host name.

    Of several records for one address the least host name counts.
    """
    keyed = with_ip_key(ptr, "client_ip").filter(F.col("ip_key").isNotNull())
    one_each = keyed.groupBy("ip_key").agg(F.min("ptr_host").alias("ptr_host"))
    return one_each.select(
        F.col("ip_key").alias("lo"), F.col("ip_key").alias("hi"), registrable_domain(F.col("ptr_host")).alias("org_domain")
    )


def lookup_tables(
    city: DataFrame | None = None, asn: DataFrame | None = None, ptr: DataFrame | None = None
) -> list[tuple[DataFrame, list[str]]]:
    """The tables that are given, each with one row per range."""
    tables = []
    for ranges, fields in ((city, CITY), (asn, ASN)):
        if ranges is not None:
            tables.append((one_per_range(ranges, fields), fields))
    if ptr is not None:
        tables.append((ptr_ranges(ptr), PTR))
    return tables


def locate(
    requests: DataFrame,
    city: DataFrame | None = None,
    asn: DataFrame | None = None,
    ptr: DataFrame | None = None,
    rows_per_share: int = ROWS_PER_SHARE,
    prepared: Prepared | None = None,
) -> DataFrame:
    """Add country, city, asn, org and org_domain (as far as tables are given) by remote_ip.

    Lookups run once per distinct address; addresses no table covers keep their row with nulls. Prepared
    tables take the place of the others.
    """
    tables = [] if prepared is not None else lookup_tables(city, asn, ptr)
    if not tables and prepared is None:
        return requests
    counts = requests.groupBy("remote_ip").agg(F.count("*").alias("n"))
    # The counts are always positive; naming them lets both uses of the counts share one shuffle.
    addresses = with_ip_key(counts.filter("n > 0").select("remote_ip"))
    if prepared is not None:
        found = probe(addresses, prepared.ranges, [CITY, ASN, PTR], prepared.widths)
    else:
        found = range_lookup(addresses, tables)
    return salted_join(requests, found, "remote_ip", "left", counts, rows_per_share)
