"""Counts over the visits table."""

from datetime import datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.fixed_values import LATEST_DAYS, ROLLUP_DAYS, ROLLUP_TOP_N
from footfall.functions.documents import json_document
from footfall.functions.times import day_of, days_before, instant, utc
from footfall.schemas import PARTITION_COLUMN
from footfall.sources.summaries import read_counts
from footfall.sources.visits_table import read_visits

_GROUPED = ["country", "referrer"]
# What a row of the grouping sets is about, by the columns it is not grouped by: day, country, referrer from the left.
_PARTS = {0b011: "day", 0b101: "country", 0b110: "referrer", 0b111: "rate"}


def in_window(visits: DataFrame, now: datetime, days: int = ROLLUP_DAYS) -> DataFrame:
    """Visits of the last `days` times 24 hours; the first day is cut mid-way."""
    start = days_before(instant(now), days)
    inside = F.col("visited_at") >= start
    if PARTITION_COLUMN in visits.columns:
        inside = (F.col(PARTITION_COLUMN) >= day_of(start)) & inside
    return visits.filter(inside)


def day_counts(visits: DataFrame, now: datetime, days: int = ROLLUP_DAYS) -> DataFrame:
    """Visits and engaged visits per day; a day without visits has no row."""
    day = F.col(PARTITION_COLUMN) if PARTITION_COLUMN in visits.columns else day_of(F.col("visited_at"))
    return (
        in_window(visits, now, days)
        .groupBy(day.alias("visit_day"))
        .agg(F.count("*").alias("visits"), F.count_if("engaged").alias("engaged"))
    )


def visits_per_day(visits: DataFrame, now: datetime, days: int = ROLLUP_DAYS) -> DataFrame:
    return day_counts(visits, now, days).orderBy("visit_day")


def latest_days(visits: DataFrame, now: datetime, count: int = LATEST_DAYS) -> DataFrame:
    return day_counts(visits, now).orderBy(F.desc("visit_day")).limit(count)


def top_labels(visits: DataFrame, column: str, n: int = ROLLUP_TOP_N) -> DataFrame:
    """The most frequent known values of a column; ties go to the lesser label."""
    return (
        visits.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("label"))
        .agg(F.count("*").alias("visits"))
        .orderBy(F.desc("visits"), "label")
        .limit(n)
    )


def top_countries(visits: DataFrame, n: int = ROLLUP_TOP_N) -> DataFrame:
    return top_labels(visits, "country", n)


def top_referrers(visits: DataFrame, n: int = ROLLUP_TOP_N) -> DataFrame:
    return top_labels(visits, "referrer", n)


def _rate(engaged: Column, visits: Column) -> Column:
    return F.coalesce(F.try_divide(engaged, visits), F.lit(0.0))


def engaged_rate(visits: DataFrame) -> DataFrame:
    """One row: the share of engaged visits, 0 when there are none."""
    return visits.agg(_rate(F.count_if("engaged"), F.count("*")).alias("engaged_rate"))


def stat_tiles(visits: DataFrame, now: datetime) -> DataFrame:
    """One row: visits in the window, visits today, engaged percentage and top country.

    One pass: counts per country first, then their sums over the few countries there are.
    """
    in_days = F.col("visited_at") >= days_before(instant(now), ROLLUP_DAYS)
    today = day_of(F.col("visited_at")) == F.lit(utc(now).date())
    per_country = visits.groupBy("country").agg(
        F.count("*").alias("all"),
        F.count_if("engaged").alias("engaged"),
        F.count_if(in_days).alias("in_days"),
        F.count_if(in_days & today).alias("today"),
    )
    # Most visits first, then the lesser label: the greatest rank is the least of the negated counts.
    top = F.min(F.when(F.col("country").isNotNull(), F.struct((-F.col("all")).alias("rank"), "country")))
    percent = F.floor(_rate(F.sum("engaged"), F.sum("all")) * 100 + 0.5).cast("int")
    return per_country.agg(
        F.coalesce(F.sum("in_days"), F.lit(0)).alias("visits_30d"),
        F.coalesce(F.sum("today"), F.lit(0)).alias("today"),
        percent.alias("engaged_pct"),
        F.coalesce(top["country"], F.lit("—")).alias("top_country"),
    )


def facts(visits: DataFrame, now: datetime, days: int = ROLLUP_DAYS) -> DataFrame:
    """What rollups add up: day, country, referrer, engaged, n visits, of which `inside` are in the window."""
    day = F.col(PARTITION_COLUMN) if PARTITION_COLUMN in visits.columns else day_of(F.col("visited_at"))
    inside = (F.col("visited_at") >= days_before(instant(now), days)).cast("long")
    return visits.select(day.alias("day"), *_GROUPED, "engaged", F.lit(1).cast("long").alias("n"), inside.alias("inside"))


def stored_facts(spark: SparkSession, path: str, now: datetime, days: int = ROLLUP_DAYS) -> DataFrame:
    """The same of a table, from its summaries; visits are read of at most the one day that the window cuts."""
    start = utc(now) - timedelta(days=days)
    first = start.date()
    counts = read_counts(spark, path)
    whole = F.col(PARTITION_COLUMN) > F.lit(first)
    if start.time() == time(0):
        whole = F.col(PARTITION_COLUMN) >= F.lit(first)
    inside = F.when(whole, F.col("visits")).otherwise(0).cast("long")
    found = counts.select(F.col(PARTITION_COLUMN).alias("day"), *_GROUPED, "engaged", F.col("visits").alias("n"), inside.alias("inside"))
    if start.time() == time(0):
        return found
    cut = facts(in_window(read_visits(spark, path, [first]), now, days), now, days)
    return found.unionByName(cut.withColumn("n", F.lit(0).cast("long")))


def rollups(visits: DataFrame, now: datetime, days: int = ROLLUP_DAYS) -> DataFrame:
    """One row: engaged rate, visits per day and the top labels, each list in its order."""
    return rollups_of(facts(visits, now, days), days)


def rollups_of(facts: DataFrame, days: int = ROLLUP_DAYS) -> DataFrame:
    """All rollups in one pass: one aggregation by day, by country, by referrer and over everything.

    Ranks are cut inside each task before the few best rows of a list meet.
    """
    sums = [F.sum(F.when(F.col("engaged"), F.col(name)).otherwise(0)).alias(f"{name}_engaged") for name in ("n", "inside")]
    part = F.element_at(F.create_map(*[F.lit(x) for pair in _PARTS.items() for x in pair]), F.grouping_id().cast("int"))
    grouped = facts.groupingSets([["day"], ["country"], ["referrer"], []], "day", *_GROUPED).agg(
        part.alias("part"), F.sum("n").alias("n"), F.sum("inside").alias("inside"), *sums
    )
    is_day = F.col("part") == "day"
    label = F.when(is_day, F.date_format("day", "yyyy-MM-dd")).otherwise(F.coalesce(*_GROUPED))
    known = (is_day & (F.col("inside") > 0)) | (F.col("part") == "rate") | (F.col("part").isin(*_GROUPED) & label.isNotNull() & (F.col("n") > 0))
    order = [F.when(is_day, 0).otherwise(-F.col("n")), F.col("label")]
    # A window of some days touches one day more.
    most = max(ROLLUP_TOP_N, days + 1)
    placed = grouped.withColumn("label", label).filter(known)
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order))).filter(F.col("place") <= most)

    def in_order(part: str, *fields: Column) -> Column:
        rows = F.collect_list(F.when(F.col("part") == part, F.struct("place", F.struct(*fields).alias("row"))))
        listed = rows if part == "day" else F.filter(rows, lambda placed: placed["place"] <= ROLLUP_TOP_N)
        return F.transform(F.array_sort(listed), lambda placed: placed["row"])

    label_fields = [F.col("label"), F.col("n").alias("visits")]
    day_fields = [F.col("label").alias("day"), F.col("inside").alias("visits"), F.col("inside_engaged").alias("engaged")]
    rate = F.max(F.when(F.col("part") == "rate", _rate(F.col("n_engaged"), F.col("n"))))
    return placed.agg(
        F.coalesce(rate, F.lit(0.0)).alias("engagedRate"),
        in_order("day", *day_fields).alias("visitsPerDay"),
        in_order("country", *label_fields).alias("topCountries"),
        in_order("referrer", *label_fields).alias("topReferrers"),
    )


def rollups_document(visits: DataFrame, now: datetime, days: int = ROLLUP_DAYS) -> DataFrame:
    """The rollups as one JSON document."""
    return _document(rollups(visits, now, days))


def stored_rollups_document(spark: SparkSession, path: str, now: datetime, days: int = ROLLUP_DAYS) -> DataFrame:
    """The same document of a table, from its summaries."""
    return _document(rollups_of(stored_facts(spark, path, now, days), days))


def _document(bundle: DataFrame) -> DataFrame:
    return bundle.select(json_document({name: F.col(name) for name in bundle.columns}).alias("document"))
