"""Which requests count as visits, and why the others do not."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.fixed_values import API_PREFIX, ASSET_SUFFIXES, PROBE_PATHS, SCAN_TOKENS
from footfall.functions.device import is_bot
from footfall.functions.text import contains_any_ignoring_case, ends_with_any


# Why a line is left out, in the order in which the reasons are tried.
UNSTORABLE = ("empty_path", "time_out_of_range")
REASONS = ("not_a_request", "internal_proxy", "status", "bot", "scan", "noise", "post_outside_api", "method", *UNSTORABLE)


def is_scan_hit(path: Column, referrer: Column) -> Column:
    return contains_any_ignoring_case(path, SCAN_TOKENS) | F.coalesce(
        contains_any_ignoring_case(referrer, SCAN_TOKENS), F.lit(False)
    )


def is_asset(path: Column) -> Column:
    return ends_with_any(path, ASSET_SUFFIXES)


def is_noise(path: Column) -> Column:
    return path.isin(PROBE_PATHS) | path.startswith(API_PREFIX) | is_asset(path)


def is_engaged(method: Column, path: Column) -> Column:
    """A POST under the API prefix shows interaction, not just a look."""
    return (method == "POST") & path.startswith(API_PREFIX)


def drop_reason(internal_proxies: Iterable[str] = ()) -> Column:
    """Why a parsed line is not a visit, null when it is. The first reason that holds is given."""
    path, method = F.col("path"), F.col("method")
    reason = F.when(~F.col("conforming"), "not_a_request")
    proxies = sorted(internal_proxies)
    if proxies:
        reason = reason.when(F.col("remote_ip").isin(proxies), "internal_proxy")
    return (
        reason.when(~F.col("status").between(200, 299), "status")
        .when(is_bot(F.col("user_agent")), "bot")
        .when(is_scan_hit(path, F.col("referrer")), "scan")
        .when((method == "GET") & is_noise(path), "noise")
        .when((method == "POST") & ~path.startswith(API_PREFIX), "post_outside_api")
        .when(~method.isin("GET", "POST"), "method")
        .when(path == "", "empty_path")
        .when(F.col("at").isNull(), "time_out_of_range")
    )


def judge(parsed: DataFrame, internal_proxies: Iterable[str] = ()) -> DataFrame:
    return parsed.withColumn("drop_reason", drop_reason(internal_proxies))


def kept_requests(parsed: DataFrame, internal_proxies: Iterable[str] = ()) -> DataFrame:
    """The requests worth recording, marked engaged or not."""
    return kept_of(judge(parsed, internal_proxies))


def kept_of(judged: DataFrame) -> DataFrame:
    kept = judged.filter(F.col("drop_reason").isNull())
    return kept.withColumn("engaged", is_engaged(F.col("method"), F.col("path"))).drop("conforming", "drop_reason")


def unstorable(judged: DataFrame) -> DataFrame:
    """Requests that pass the filter but cannot be stored, without their address."""
    return judged.filter(F.col("drop_reason").isin(*UNSTORABLE)).drop("remote_ip", "conforming")
