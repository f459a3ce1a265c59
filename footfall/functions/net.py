"""IP literals as fixed-width keys, reverse-lookup names and registrable domains."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.fixed_values import TWO_PART_SUFFIXES
from footfall.functions.once import evaluate_once
from footfall.functions.text import trim_blanks

_QUAD = r"(?:\A|:)(\d{1,3}(?:[.]\d{1,3}){3})\z"
_IPV6_SHAPE = r"\A(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:\z)(?:[0-9a-f]{0,4}:)*[0-9a-f]{0,4}\z"
_MAPPED_PREFIX = "0" * 20 + "ffff"


def with_ip_key(df: DataFrame, address: str = "remote_ip", key: str = "ip_key") -> DataFrame:
    """Add an IP literal as fixed-width hex: keys of one family sort as the addresses do.

    IPv4 gives 8 digits (IPv4-mapped IPv6 too), IPv6 gives 32, anything else null. Names are never
    resolved.
    """
    # Each step may name the ones before it.
    steps = {
        "_text": f"lower({address})",
        "_quad": f"regexp_extract(_text, r'{_QUAD}', 1)",
        "_octets": "transform(split(_quad, '[.]'), octet -> try_cast(octet AS int))",
        "_v4": """CASE WHEN _quad != '' AND forall(_octets, octet -> octet <= 255)
            THEN array_join(transform(_octets, octet -> lpad(lower(hex(octet)), 2, '0')), '') END""",
        # An embedded IPv4 tail becomes the two groups it stands for.
        "_v6": r"""CASE WHEN length(_text) > 45 THEN NULL
            WHEN contains(_text, ':') AND _quad = '' THEN _text
            WHEN contains(_text, ':') THEN concat(
                regexp_replace(_text, r'\d+[.][\d.]+\z', ''), substring(_v4, 1, 4), ':', substring(_v4, 5, 4)) END""",
        "_groups": "filter(split(_v6, ':'), part -> part != '')",
        "_well_formed": f"""_v6 RLIKE r'{_IPV6_SHAPE}'
            AND CASE WHEN contains(_v6, '::') THEN size(_groups) <= 7 ELSE size(_groups) = 8 END""",
        # "::" becomes the zero groups it stands for.
        "_spelled_out": "CASE WHEN _well_formed THEN replace(_v6, '::', concat(':', repeat('0:', 8 - size(_groups)))) END",
        "_all": "filter(split(_spelled_out, ':'), part -> part != '')",
        "_digits": "array_join(transform(_all, part -> lpad(part, 4, '0')), '')",
    }
    stepwise = df.select("*", *[F.expr(step).alias(name) for name, step in steps.items()])
    found = F.expr(
        f"""CASE WHEN NOT contains(_text, ':') THEN _v4
            WHEN startswith(_digits, '{_MAPPED_PREFIX}') THEN substring(_digits, 25, 8) ELSE _digits END"""
    )
    return stepwise.select(*df.columns, evaluate_once(**{key: found}))


def reverse_name(key: Column) -> Column:
    """The name a reverse lookup of an address would ask for, from its key; null without one."""
    octets = [F.conv(F.substring(key, start, 2), 16, 10) for start in (7, 5, 3, 1)]
    nibbles = F.rtrim(F.regexp_replace(F.reverse(key), "(.)", "$1."), F.lit("."))
    return F.when(F.length(key) == 8, F.concat(F.concat_ws(".", *octets), F.lit(".in-addr.arpa"))).when(
        F.length(key) == 32, F.concat(nibbles, F.lit(".ip6.arpa"))
    )


def registrable_domain(host: Column) -> Column:
    """The last two labels of a host name, three under a two-part public suffix, else null."""
    bare = F.lower(F.regexp_replace(trim_blanks(host), r"[.]+\z", ""))
    labels = F.filter(F.split(bare, "[.]"), lambda label: label != "")
    valid = (F.size(labels) >= 2) & F.forall(labels, lambda label: label.rlike(r"\A[a-z0-9_-]+\z"))
    last_two = F.array_join(F.slice(labels, -2, 2), ".")
    last_three = F.array_join(F.slice(labels, -3, 3), ".")
    return F.when(valid & ~last_two.isin(TWO_PART_SUFFIXES), last_two).when(
        valid & (F.size(labels) >= 3), last_three
    )
