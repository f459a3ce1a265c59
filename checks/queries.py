"""Every registered query: (spark, sf_dir) -> DataFrame over the whole given tables."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import standin
from checks.standin import NOW, SALT, SETTINGS
from footfall.functions.device import with_device
from footfall.functions.net import registrable_domain, reverse_name, with_ip_key
from footfall.functions.privacy import ip_hash
from footfall.operators import geo, listing, reports, requests, retention, rollups, visits
from footfall.plans.ingest import ingest_files, ingest_lines, requests_from_lines, visits_from_lines
from footfall.session import prepare
from footfall.sources.access_log import clean_lines, conforming_requests, parse_lines
from footfall.sources.backlog import backlog_lines, read_backlog, replay_backlog, write_backlog
from footfall.sources.lookups import network_ranges, numeric_ranges, read_asn_ranges, read_city_ranges
from footfall.sources.summaries import refresh
from footfall.sources.visits_table import append_visits, compact, read_visits
from footfall.sources.visits_table import insert_if_absent as insert_visits
from footfall.streaming.ingest import start_ingest

_DESCRIBED = ("site", "path", "engaged", "browser", "os", "device_kind", "ip_hash", "referrer")
OWN_CITY, OWN_ORG = "europe", "org nation_"


def _at_ms():
    return F.unix_millis("visited_at").alias("at_ms")


def _conforming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conforming_requests(parse_lines(clean_lines(standin.log_lines(spark, sf_dir))))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits.describe(requests_from_lines(standin.log_lines(spark, sf_dir), SETTINGS), SALT)


def parse_access_log(spark, sf_dir):
    found = _conforming(spark, sf_dir)
    return found.select(*[name for name in found.columns if name != "at"], F.unix_millis("at").alias("at_ms"))


def drop_reasons(spark, sf_dir):
    return reports.drop_reasons(standin.log_lines(spark, sf_dir), SETTINGS.internal_proxies)


def kept_requests(spark, sf_dir):
    kept = requests_from_lines(standin.log_lines(spark, sf_dir), SETTINGS)
    return kept.select("host", "path", "engaged", "remote_ip", F.unix_millis("at").alias("at_ms"))


def hashed_addresses(spark, sf_dir):
    addresses = _conforming(spark, sf_dir).select("remote_ip").distinct()
    return addresses.select("remote_ip", ip_hash(F.col("remote_ip"), SALT).alias("ip_hash"))


def device_class(spark, sf_dir):
    agents = _conforming(spark, sf_dir).groupBy("user_agent").agg(F.count("*").alias("requests"))
    return with_device(agents)


def _page_hosts(spark, sf_dir):
    # Hosts under example.org stand in for hosts under a two-part public suffix.
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    host = F.replace(host, F.lit("example.org"), F.lit("co.uk"))
    return standin.table(spark, sf_dir, "pages").select("url", host.alias("host"))


def registrable_domains(spark, sf_dir):
    return _page_hosts(prepare(spark), sf_dir).select("url", "host", registrable_domain(F.col("host")).alias("org_domain"))


def reverse_names(spark, sf_dir):
    addresses = _conforming(spark, sf_dir).select("remote_ip").distinct()
    return with_ip_key(addresses).select("remote_ip", reverse_name(F.col("ip_key")).alias("arpa"))


def _as_ipv6(address):
    """The same addresses as IPv6 literals in short form, inside 2001:db8:1::/48."""
    octets = F.split(address, "[.]")
    third, last = (F.lower(F.hex(octets[n].cast("bigint"))) for n in (2, 3))
    return F.concat(F.lit("2001:DB8:1::"), third, F.lit(":"), last)


def reverse_names_ipv6(spark, sf_dir):
    addresses = _conforming(spark, sf_dir).select(_as_ipv6(F.col("remote_ip")).alias("remote_ip")).distinct()
    return with_ip_key(addresses).select("remote_ip", reverse_name(F.col("ip_key")).alias("arpa"))


def path_strip_pages(spark, sf_dir):
    # Some pages stand in for assets and for scan hits.
    uri = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    uri = F.replace(F.replace(uri, F.lit(".html"), F.lit(".js")), F.lit("/de/"), F.lit("/WP-Admin/"))
    paths = standin.table(prepare(spark), sf_dir, "pages").select("url", F.substring_index(uri, "?", 1).alias("path"))
    none = F.lit(None).cast("string")
    return paths.select(
        "url",
        "path",
        requests.is_scan_hit(F.col("path"), none).alias("is_scan"),
        requests.is_asset(F.col("path")).alias("is_asset"),
    )


def visits_dedupe(spark, sf_dir):
    """Copies of a request differ in their referrer."""
    return visits.one_per_key(_described(spark, sf_dir)).select(*_DESCRIBED, _at_ms())


def insert_if_absent(spark, sf_dir):
    """The first half of the month is stored, then the whole log is delivered again."""
    sent = standin.deliveries(spark, sf_dir)
    path = standin.new_folder(spark, "insert")
    ingest_lines(standin.as_lines(sent.filter("at_ms < 1705363200000")), path, SETTINGS)
    ingest_lines(standin.as_lines(sent), path, SETTINGS)
    return read_visits(spark, path).select(*_DESCRIBED, _at_ms())


def ingest_report(spark, sf_dir):
    """Reasons as an ingest reports them, from the pass in which it stores the visits."""
    report = ingest_files(spark, standin.log_files(prepare(spark), sf_dir), standin.new_folder(spark, "reported"), SETTINGS)
    return spark.createDataFrame(sorted(report.reasons.items()), "drop_reason string, lines bigint")


def rejected_requests(spark, sf_dir):
    """Requests that an ingest could not store."""
    rejected = standin.new_folder(spark, "rejected")
    ingest_files(spark, standin.log_files(prepare(spark), sf_dir), standin.new_folder(spark, "others"), SETTINGS, rejected=rejected)
    schema = "drop_reason string, host string, path string, method string, status int"
    return spark.read.schema(schema).json(f"{rejected}/*")


def stream_ingest(spark, sf_dir):
    """The log as closed segments, consumed as a stream of several batches into a table.

    Files were filled at random, so most second deliveries come in another batch than the first.
    """
    path = standin.new_folder(spark, "streamed")
    query = start_ingest(
        spark,
        standin.log_files(prepare(spark), sf_dir),
        path,
        standin.new_folder(spark, "offsets"),
        SETTINGS,
        lambda session: standin.lookups(session, sf_dir),
        max_files=3,
    )
    query.awaitTermination()
    stored = read_visits(spark, path)
    return stored.select("site", "path", "engaged", "ip_hash", "country", "asn", "org_domain", _at_ms())


def stream_late_segment(spark, sf_dir):
    """Half of the log is streamed; the other half arrives in segments last changed 30 days before."""
    sent = standin.deliveries(spark, sf_dir)
    segments, path = standin.new_folder(spark, "segments"), standin.new_folder(spark, "late")
    offsets = standin.new_folder(spark, "offsets")
    for half, days_old in ((0, 0), (1, 30)):
        standin.deliver(standin.as_lines(sent.filter(F.col("event_id") % 2 == half)), segments, days_old)
        start_ingest(spark, segments, path, offsets, SETTINGS).awaitTermination()
    return read_visits(spark, path).select("site", "path", "engaged", "ip_hash", _at_ms())


def stream_since(spark, sf_dir):
    """A first start that leaves out what happened before the middle of the month, after which it takes all that is new."""
    sent = standin.deliveries(spark, sf_dir)
    segments, path = standin.new_folder(spark, "segments"), standin.new_folder(spark, "since")
    offsets, start = standin.new_folder(spark, "offsets"), datetime(2024, 1, 16)
    for half in (0, 1):
        standin.deliver(standin.as_lines(sent.filter(F.col("event_id") % 2 == half)), segments, 0)
        start_ingest(spark, segments, path, offsets, SETTINGS, since=start if half == 0 else None).awaitTermination()
    return read_visits(spark, path).select("site", "path", "engaged", "ip_hash", _at_ms())


def added_column(spark, sf_dir):
    """A table whose older days were written before there were organisation domains, and versions of days."""
    found, path = standin.stored_visits(spark, sf_dir), standin.new_folder(spark, "older")
    older = found.filter("visit_day < DATE '2024-01-16'").drop("org_domain")
    older.write.partitionBy("visit_day").parquet(path)
    insert_visits(spark, found, path)
    return _comparable(read_visits(spark, path))


def geo_csv_ranges(spark, sf_dir):
    """Every address of the log against networks read from CSV text."""
    addresses = _conforming(spark, sf_dir).select("remote_ip").distinct()
    blocks, places, networks = standin.network_csv(spark, sf_dir)
    found = geo.locate(addresses, read_city_ranges(spark, blocks, places), read_asn_ranges(spark, networks))
    return found.select("remote_ip", "country", "city", "asn", "org")


def geo_dense(spark, sf_dir):
    """Thousands of ranges that nest, overlap and lie apart, and an address for each event."""
    events = standin.table(prepare(spark), sf_dir, "events")
    number = F.expr(standin.DENSE_ADDRESS_SQL).alias("n")
    parts = [F.expr(f"floor(n / {size}) % 256").cast("int").cast("string") for size in (65536, 256, 1)]
    addresses = events.select(number).distinct().select(F.concat_ws(".", F.lit("10"), *parts).alias("remote_ip"))
    ranges = numeric_ranges(spark.sql(standin.DENSE_SQL, events=events))
    return geo.locate(addresses, ranges).select("remote_ip", "country", "city")


def _located(spark, sf_dir, *fields, city=False, asn=False, ptr=False):
    found = geo.locate(
        visits.one_per_key(_described(spark, sf_dir)),
        standin.city_ranges(spark, sf_dir) if city else None,
        standin.asn_ranges(spark, sf_dir) if asn else None,
        standin.ptr_table(spark, sf_dir) if ptr else None,
    )
    return found.select("site", "ip_hash", _at_ms(), *fields)


def geo_city_join(spark, sf_dir):
    return _located(spark, sf_dir, "country", "city", city=True)


def geo_asn_join(spark, sf_dir):
    return _located(spark, sf_dir, "asn", "org", asn=True)


def geo_enrich(spark, sf_dir):
    return _located(spark, sf_dir, "country", "city", "asn", "org", city=True, asn=True)


def org_domain_join(spark, sf_dir):
    return _located(spark, sf_dir, "org_domain", ptr=True)


def geo_ipv6_networks(spark, sf_dir):
    """IPv6 addresses in CIDR networks: per nation a /125, inside one /48 for all."""
    addresses = _conforming(spark, sf_dir).groupBy(_as_ipv6(F.col("remote_ip")).alias("remote_ip"))
    addresses = addresses.agg(F.count("*").alias("requests"))
    nation = standin.table(spark, sf_dir, "nation")
    start = F.lower(F.hex((F.col("n_nationkey") * 8).cast("bigint")))
    per_nation = nation.select(
        F.concat(F.lit("2001:db8:1:0::"), F.lit("0:"), start, F.lit("/125")).alias("network"),
        F.col("n_name").alias("country"),
        F.lit(None).cast("string").alias("city"),
    )
    everyone = nation.filter("n_nationkey = 0").select(
        F.lit("2001:db8:1::/48").alias("network"), F.lit("elsewhere").alias("country"), F.lit("anywhere").alias("city")
    )
    return geo.locate(addresses, network_ranges(per_nation.unionByName(everyone)))


def visits_from_log(spark, sf_dir):
    """The whole way from lines to complete visits."""
    found = visits_from_lines(standin.log_lines(spark, sf_dir), SETTINGS, standin.lookups(spark, sf_dir))
    return _comparable(found)


def _comparable(found: DataFrame) -> DataFrame:
    return found.select(*[name for name in visits.VISIT_COLUMNS if name != "visited_at"], _at_ms())


def _shown(found: DataFrame) -> DataFrame:
    return _comparable(found).drop("ip_hash")


def visits_per_day_from_lines(spark, sf_dir):
    found = visits.one_per_key(_described(spark, sf_dir))
    return rollups.visits_per_day(found, NOW)


def visits_per_day(spark, sf_dir):
    return rollups.visits_per_day(standin.stored_visits(spark, sf_dir), NOW)


def latest_days(spark, sf_dir):
    return rollups.latest_days(standin.stored_visits(spark, sf_dir), NOW)


def top_countries(spark, sf_dir):
    return rollups.top_countries(standin.stored_visits(spark, sf_dir))


def top_referrers(spark, sf_dir):
    return rollups.top_referrers(standin.stored_visits(spark, sf_dir))


def engaged_rate(spark, sf_dir):
    return rollups.engaged_rate(standin.stored_visits(spark, sf_dir))


def engaged_rate_empty(spark, sf_dir):
    """Before the log begins there is no visit, and the rate is still one row."""
    return rollups.engaged_rate(standin.stored_visits(spark, sf_dir).filter("visit_day < DATE '2024-01-01'"))


def stat_tiles(spark, sf_dir):
    return rollups.stat_tiles(standin.stored_visits(spark, sf_dir), NOW)


def rollups_document(spark, sf_dir):
    return rollups.rollups_document(standin.stored_visits(spark, sf_dir), NOW)


def rollups_stored(spark, sf_dir):
    """From the summaries of a table that was filled in two steps, pruned and compacted; over 20 days."""
    found, path = standin.stored_visits(spark, sf_dir), standin.new_folder(spark, "summarised")
    append_visits(found.filter("visit_day < DATE '2024-01-16'"), path)
    refresh(spark, path)
    insert_visits(spark, found, path)
    retention.prune(spark, path, NOW, 25)
    compact(spark, path, most_files=1)
    return rollups.stored_rollups_document(spark, path, NOW, 20)


def recent_engaged_stored(spark, sf_dir):
    """From the summaries of the table, those of its files that have none yet made on the way."""
    return _shown(listing.stored_recent_of_engaged(spark, standin.stored_path(prepare(spark), sf_dir), 50))


def hot_visitor(spark, sf_dir):
    """Nearly a third of all visits are one visitor's; that visitor's are cut into shares."""
    found, path = standin.stored_visits(spark, sf_dir), standin.new_folder(spark, "hot")
    one = F.when(F.col("ip_hash") < "5", "hot").otherwise(F.col("ip_hash"))
    append_visits(found.withColumn("ip_hash", one), path)
    return _comparable(listing.stored_recent_of_engaged(spark, path, 500, rows_per_share=50))


def recent_visits(spark, sf_dir):
    return _shown(listing.recent(standin.stored_visits(spark, sf_dir), 50))


def engaged_visitors(spark, sf_dir):
    return listing.engaged_visitors(standin.stored_visits(spark, sf_dir))


def visits_of_engaged(spark, sf_dir):
    found = listing.visits_of_engaged(standin.stored_visits(spark, sf_dir))
    return found.select("site", "path", "engaged", "ip_hash", _at_ms())


def recent_engaged(spark, sf_dir):
    return _shown(listing.recent_of_engaged(standin.stored_visits(spark, sf_dir), 50))


def visitor_ordinal(spark, sf_dir):
    listed = listing.list_visits(standin.stored_visits(spark, sf_dir), 500)
    return listed.select(F.col("visitor").cast("bigint").alias("visitor"), "site", "path", _at_ms())


def visit_documents(spark, sf_dir):
    listed = listing.list_visits(standin.stored_visits(spark, sf_dir), 500, "engaged")
    found = listing.visit_documents(listed)
    return found.select(F.col("row").cast("bigint").alias("row"), "document")


def hide_self(spark, sf_dir):
    found = listing.hide_own(standin.stored_visits(spark, sf_dir), OWN_CITY, OWN_ORG)
    return found.select("site", "path", "city", "org", _at_ms())


def hide_scan_noise(spark, sf_dir):
    """Over all requests, as a history stored before scans were filtered."""
    found = listing.hide_scan_noise(_conforming(spark, sf_dir))
    return found.select("host", "path", "referrer", F.unix_millis("at").alias("at_ms"))


def display_rows(spark, sf_dir):
    listed = listing.list_visits(standin.stored_visits(spark, sf_dir), 500)
    return listing.display_rows(listed, ".example")


def filtered_listing(spark, sf_dir):
    """Filters apply to the listed rows; visitor numbers and the limit come first."""
    listed = listing.list_visits(standin.stored_visits(spark, sf_dir), 500)
    shown = listing.filter_listing(listed, (OWN_CITY, OWN_ORG), scan_noise=True)
    return shown.select(F.col("visitor").cast("bigint").alias("visitor"), "site", "path", _at_ms())


def retention_counts(spark, sf_dir):
    return retention.retention_counts(standin.stored_visits(spark, sf_dir), NOW, 7)


def retained(spark, sf_dir):
    found = retention.retained(standin.stored_visits(spark, sf_dir), NOW, 7)
    return found.select("site", "path", "ip_hash", _at_ms())


def retention_prune(spark, sf_dir):
    """What is left in a table after pruning it on disk."""
    path = standin.new_folder(spark, "pruned")
    append_visits(standin.stored_visits(spark, sf_dir), path)
    retention.prune(spark, path, NOW, 7)
    return read_visits(spark, path).select("site", "path", "ip_hash", _at_ms())


def rows_deleted(spark, sf_dir):
    """What pruning a table on disk deleted: what it says, and the rows that are gone."""
    path = standin.new_folder(spark, "deleted")
    before = standin.stored_visits(spark, sf_dir)
    append_visits(before, path)
    said = retention.prune(spark, path, NOW, 7)
    counted = before.select(F.lit(1).alias("n")).union(read_visits(spark, path).select(F.lit(-1)))
    return counted.agg(F.sum("n").alias("deleted"), (F.sum("n") == F.lit(said)).alias("as_said"))


def backlog_roundtrip(spark, sf_dir):
    path = standin.new_folder(spark, "backlog")
    write_backlog(standin.stored_visits(spark, sf_dir), path)
    return _shown(read_backlog(spark, path))


def backlog_replay(spark, sf_dir):
    """Engaged visits are stored already. Those of even days wait in a backlog together with the engaged ones,
    and every line is there a second time, torn; those of odd days come with the replay. It runs twice."""
    found = standin.stored_visits(spark, sf_dir)
    backlog, path = standin.new_folder(spark, "waiting visits"), standin.new_folder(spark, "replayed")
    append_visits(found.filter("engaged"), path)
    odd = F.dayofmonth("visited_at") % 2 == 1
    waiting = found.filter(~odd | F.col("engaged"))
    write_backlog(waiting, backlog)
    half = F.substring("value", F.lit(1), F.ceil(F.length("value") / 2).cast("int"))
    backlog_lines(waiting).select(half).write.mode("append").text(backlog)
    # Later copies that say something else: what was written first counts.
    write_backlog(waiting.withColumns({"browser": F.lit("other"), "city": F.lit("Aa"), "engaged": F.lit(True)}), backlog)
    for _ in range(2):
        replay_backlog(spark, backlog, path, found.filter(odd))
    return _comparable(read_visits(spark, path))


def consumed_lines(spark, sf_dir):
    """Lines over all files of the log, and whether each file's lines account for all its bytes."""
    lines = standin.log_lines(spark, sf_dir)
    file, size = F.col("_metadata.file_path").alias("file"), F.max("_metadata.file_size").alias("size")
    consumed = reports.consumed_per_file(lines).join(lines.groupBy(file).agg(size), "file")
    return consumed.agg(F.sum("lines").alias("lines"), F.bool_and(F.col("bytes") == F.col("size")).alias("all_bytes"))


QUERIES = {
    "parse_access_log": parse_access_log,
    "consumed_lines": consumed_lines,
    "drop_reasons": drop_reasons,
    "ingest_report": ingest_report,
    "rejected_requests": rejected_requests,
    "kept_requests": kept_requests,
    "ip_hash": hashed_addresses,
    "device_class": device_class,
    "registrable_domain": registrable_domains,
    "reverse_name": reverse_names,
    "reverse_name_ipv6": reverse_names_ipv6,
    "path_strip_pages": path_strip_pages,
    "visits_dedupe": visits_dedupe,
    "insert_if_absent": insert_if_absent,
    "stream_ingest": stream_ingest,
    "stream_late_segment": stream_late_segment,
    "stream_since": stream_since,
    "added_column": added_column,
    "geo_csv_ranges": geo_csv_ranges,
    "geo_city_join": geo_city_join,
    "geo_asn_join": geo_asn_join,
    "geo_enrich": geo_enrich,
    "geo_dense": geo_dense,
    "geo_ipv6_networks": geo_ipv6_networks,
    "org_domain_join": org_domain_join,
    "visits_from_log": visits_from_log,
    "visits_per_day_from_lines": visits_per_day_from_lines,
    "visits_per_day": visits_per_day,
    "latest_days": latest_days,
    "top_countries": top_countries,
    "top_referrers": top_referrers,
    "engaged_rate": engaged_rate,
    "engaged_rate_empty": engaged_rate_empty,
    "stat_tiles": stat_tiles,
    "rollups_document": rollups_document,
    "rollups_stored": rollups_stored,
    "recent_engaged_stored": recent_engaged_stored,
    "hot_visitor": hot_visitor,
    "recent_visits": recent_visits,
    "engaged_visitors": engaged_visitors,
    "visits_of_engaged": visits_of_engaged,
    "recent_engaged": recent_engaged,
    "visitor_ordinal": visitor_ordinal,
    "visit_documents": visit_documents,
    "hide_self": hide_self,
    "hide_scan_noise": hide_scan_noise,
    "filtered_listing": filtered_listing,
    "display_rows": display_rows,
    "retention": retention_counts,
    "retained": retained,
    "retention_prune": retention_prune,
    "rows_deleted": rows_deleted,
    "backlog_roundtrip": backlog_roundtrip,
    "backlog_replay": backlog_replay,
}
