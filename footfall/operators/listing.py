"""Lists of recent visits and how they are shown."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.fixed_values import SCAN_TOKENS
from footfall.functions.documents import visit_document
from footfall.functions.text import contains_any, non_empty
from footfall.functions.times import MIN_MILLIS, iso_instant
from footfall.operators.skew import ROWS_PER_SHARE, salted_join
from footfall.schemas import PARTITION_COLUMN, VISIT_COLUMNS
from footfall.settings import parse_limit, parse_visitors
from footfall.sources.summaries import read_counts, read_engaged
from footfall.sources.visits_table import read_visits

def _newest_first() -> list:
    return [F.desc("visited_at"), F.asc("site"), F.asc("path"), F.asc("ip_hash")]


def recent(visits: DataFrame, limit: int) -> DataFrame:
    """The newest visits. Of a table with days, only the newest time that holds enough is read."""
    return _newest(_recent_enough(visits, visits, limit), limit)


def _newest(visits: DataFrame, limit: int) -> DataFrame:
    return visits.orderBy(*_newest_first()).limit(limit).select(*VISIT_COLUMNS)


def _recent_enough(visits: DataFrame, counted: DataFrame, limit: int) -> DataFrame:
    """The newest days and minutes of a table that together hold `limit` of the counted visits, else all.

    Counting per day reads at most a flag per row, counting per minute the times of those days.
    """
    if PARTITION_COLUMN not in visits.columns:
        return visits
    # Plain comparisons with a subquery, so that they reach the partitions and the row groups.
    year_one = F.make_date(*[F.lit(1)] * 3)
    in_days = F.col(PARTITION_COLUMN) >= _reached(_per_step(counted, F.col(PARTITION_COLUMN)), limit, year_one).scalar()
    return _since_minute(visits, counted, in_days, limit)


def _since_minute(visits: DataFrame, counted: DataFrame, in_days: Column, limit: int) -> DataFrame:
    """Of some days, the newest minutes that together hold `limit` of the counted visits, else all."""
    per_minute = _per_step(counted.filter(in_days), F.date_trunc("minute", "visited_at"))
    first_minute = _reached(per_minute, limit, F.timestamp_millis(F.lit(MIN_MILLIS)))
    return visits.filter(in_days & (F.col("visited_at") >= first_minute.scalar()))


def _per_step(counted: DataFrame, step: Column) -> DataFrame:
    return counted.groupBy(step.alias("step")).agg(F.count("*").alias("n"))


def _reached(per_step: DataFrame, limit: int, otherwise: Column) -> DataFrame:
    """One value: the latest step (day, minute) from which on there are `limit` rows, if there are so many.

    The window runs over one row per step: days, or at most `limit` minutes and those of one day.
    """
    through = F.sum("n").over(Window.orderBy(F.desc("step")))
    reached = per_step.withColumn("through", through).filter(F.col("through") >= limit)
    return reached.agg(F.coalesce(F.max("step"), otherwise).alias("start"))


def engaged_visitors(visits: DataFrame) -> DataFrame:
    return visits.filter("engaged").select("ip_hash").distinct()


def visits_of_engaged(
    visits: DataFrame, among: DataFrame | None = None, rows_per_share: int = ROWS_PER_SHARE
) -> DataFrame:
    """Every visit of a visitor who ever engaged, also those where they only looked.

    `among` names the visits to choose from when these are not all.
    """
    chosen = visits if among is None else among
    return salted_join(chosen, engaged_visitors(visits), "ip_hash", "left_semi", rows_per_share=rows_per_share)


def recent_of_engaged(visits: DataFrame, limit: int, rows_per_share: int = ROWS_PER_SHARE) -> DataFrame:
    """The newest visits of visitors who ever engaged.

    A time that holds `limit` engaged visits holds at least as many visits of such visitors, so only
    that time is joined; who engaged is still asked of all days.
    """
    newest = _recent_enough(visits, visits.filter("engaged"), limit)
    return _newest(visits_of_engaged(visits, newest, rows_per_share), limit)


def stored_recent_of_engaged(spark: SparkSession, path: str, limit: int, rows_per_share: int = ROWS_PER_SHARE) -> DataFrame:
    """The same of a table, from its summaries: visits are read of the listing's days only.

    The days are found by their counts, and of everyone who ever engaged only those are kept who visited
    in the time that is listed.
    """
    visits, day = read_visits(spark, path), F.col(PARTITION_COLUMN)
    per_day = read_counts(spark, path).filter("engaged").groupBy(day.alias("step")).agg(F.sum("visits").alias("n"))
    in_days = day >= _reached(per_day, limit, F.make_date(*[F.lit(1)] * 3)).scalar()
    newest = _since_minute(visits, visits.filter("engaged"), in_days, limit)
    engaged = read_engaged(spark, path).join(newest.select("ip_hash").distinct(), "ip_hash", "left_semi").distinct()
    return _newest(salted_join(newest, engaged, "ip_hash", "left_semi", rows_per_share=rows_per_share), limit)


def number_visitors(listed: DataFrame) -> DataFrame:
    """Number the rows of one listing, and its visitors by first appearance, and drop the hash.

    Only ever applied to a listing, at most 500 rows, so the window over all of it is small.
    """
    in_order = Window.orderBy(*_newest_first())
    placed = listed.withColumn("row", F.row_number().over(in_order))
    placed = placed.withColumn("_first", F.min("row").over(Window.partitionBy("ip_hash")))
    numbered = placed.withColumn("visitor", F.dense_rank().over(Window.orderBy("_first")))
    return numbered.drop("_first", "ip_hash")


def list_visits(visits: DataFrame, limit: str | int | None = None, visitors: str | None = None) -> DataFrame:
    """The newest visits, of everyone or of "engaged" visitors, ready to be shown."""
    count = parse_limit(limit)
    listed = recent(visits, count) if parse_visitors(visitors) is None else recent_of_engaged(visits, count)
    return present(number_visitors(listed))


def list_stored_visits(
    spark: SparkSession, path: str, limit: str | int | None = None, visitors: str | None = None
) -> DataFrame:
    """The same of a table, from its summaries where they help."""
    count = parse_limit(limit)
    if parse_visitors(visitors) is None:
        return present(number_visitors(recent(read_visits(spark, path), count)))
    return present(number_visitors(stored_recent_of_engaged(spark, path, count)))


def present(numbered: DataFrame) -> DataFrame:
    """Listing columns under the names they are shown by; never the address hash."""
    return numbered.select(
        "row",
        "visitor",
        "site",
        "path",
        "engaged",
        "country",
        "city",
        "asn",
        "org",
        F.col("org_domain").alias("orgDomain"),
        "browser",
        "os",
        F.col("device_kind").alias("kind"),
        "referrer",
        "visited_at",
    )


def visit_documents(presented: DataFrame) -> DataFrame:
    """One JSON object per listed visit; numbered in the order of the listing."""
    fields = {name: F.col(name) for name in presented.columns if name not in ("row", "visited_at")}
    fields["at"] = iso_instant(F.col("visited_at"))
    order = Window.orderBy("row")
    return presented.select(F.row_number().over(order).alias("row"), visit_document(fields).alias("document"))


def hide_own(listed: DataFrame, city: str, org: str) -> DataFrame:
    """Leave out visits from one's own city and network."""
    same_city = F.lower(F.coalesce("city", F.lit(""))) == city.lower()
    same_org = F.lower(F.coalesce("org", F.lit(""))).contains(org.lower())
    return listed.filter(~(same_city & same_org))


def hide_scan_noise(listed: DataFrame) -> DataFrame:
    """Leave out scan hits stored before the ingest filter knew them."""
    noise = contains_any(F.lower("path"), SCAN_TOKENS)
    referred = F.coalesce(contains_any(F.lower("referrer"), SCAN_TOKENS), F.lit(False))
    return listed.filter(~(noise | referred))


def filter_listing(listed: DataFrame, own: tuple[str, str] | None = None, scan_noise: bool = False) -> DataFrame:
    """What a viewer chose to leave out of a listing: own visits by (city, org), stored scan noise."""
    if own is not None:
        listed = hide_own(listed, *own)
    return hide_scan_noise(listed) if scan_noise else listed


def display_rows(presented: DataFrame, site_suffix: str = "") -> DataFrame:
    """A listing as the nine text columns of the visits table."""
    at = presented["visited_at"]
    place = F.concat_ws(", ", non_empty(F.col("city")), non_empty(F.col("country")))
    network = F.coalesce(
        non_empty(F.col("org")),
        F.when(F.col("asn") != 0, F.concat(F.lit("AS"), F.col("asn").cast("string"))),
        F.lit("?"),
    )
    return presented.select(
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.concat(F.lit("#"), F.col("visitor").cast("string")).alias("visitor"),
        _without_first(F.col("site"), site_suffix).alias("site"),
        "path",
        F.coalesce(non_empty(place), F.lit("?")).alias("location"),
        F.concat_ws(" · ", network, non_empty(F.col("orgDomain"))).alias("network"),
        F.concat_ws(" / ", "browser", "os", F.lower("kind")).alias("client"),
        F.coalesce("referrer", F.lit("")).alias("referrer"),
        F.when(F.col("engaged"), "yes").otherwise("").alias("engaged"),
    )


def _without_first(text, part: str):
    """Text without the first occurrence of a part."""
    if not part:
        return text
    start = F.instr(text, part)
    rest = F.call_function("substring", text, start + len(part))
    return F.when(start > 0, F.concat(F.call_function("substring", text, F.lit(1), start - 1), rest)).otherwise(text)
