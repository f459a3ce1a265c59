"""For each registered query, SQL that answers it from the given tables without reading any JSON."""

from checks.standin import (
    AGAIN_SQL,
    ASN_SQL,
    CITY_SQL,
    DENSE_ADDRESS_SQL,
    DENSE_SQL,
    PTR_SQL,
    REQUESTS_SQL,
    SALT,
    WITHOUT_PATH_SQL,
)

_BOTS = (
    "(bot|crawler|spider|slurp|curl|wget|python|go-http-client|java/|httpclient|okhttp|libwww|scrapy"
    "|headlesschrome|phantomjs|lighthouse|pingdom|uptime|monitor)"
)
_SCANS = "(wp-login|wp-admin|wp-content|wp-json|wp-includes|xmlrpc[.]php|wordpress)"
_ASSETS = "[.](css|js|ico|png|svg|jpg|webp|map|woff|woff2|txt|xml)$"

# Milliseconds are floored: epoch_ms would round. The log carries them as fractional seconds.
_DUCKDB_MILLIS = "CAST(trunc((CAST(epoch_us(ts) // 1000 AS DOUBLE) / 1000) * 1000.0) AS BIGINT)"

_WITH = f"""
WITH standin AS ({REQUESTS_SQL.format(millis=_DUCKDB_MILLIS, events="events")}),
raw AS (SELECT * FROM standin UNION ALL {AGAIN_SQL.format(requests="standin")} UNION ALL {WITHOUT_PATH_SQL.format(requests="standin")}),
judged AS (
  SELECT *, split_part(uri, '?', 1) AS path,
    CASE WHEN client_ip IN ('203.0.0.13') THEN 'internal_proxy'
      WHEN status NOT BETWEEN 200 AND 299 THEN 'status'
      WHEN regexp_matches(lower(user_agent), '{_BOTS}') THEN 'bot'
      WHEN regexp_matches(lower(split_part(uri, '?', 1)), '{_SCANS}')
        OR regexp_matches(lower(coalesce(referrer, '')), '{_SCANS}') THEN 'scan'
      WHEN method = 'GET' AND (split_part(uri, '?', 1) IN ('/healthz', '/readyz') OR starts_with(uri, '/api')
        OR regexp_matches(split_part(uri, '?', 1), '{_ASSETS}')) THEN 'noise'
      WHEN method = 'POST' AND NOT starts_with(uri, '/api') THEN 'post_outside_api'
      WHEN method NOT IN ('GET', 'POST') THEN 'method'
      WHEN starts_with(uri, '?') THEN 'empty_path' END AS drop_reason
  FROM raw),
described AS (
  SELECT host AS site, path, (method = 'POST') AS engaged, sha256('{SALT}' || client_ip) AS ip_hash,
    nullif(referrer, '') AS referrer, at_ms, user_id, event_id, client_ip,
    3405774848 + CAST(split_part(client_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(client_ip, '.', 4) AS BIGINT) AS ip_num
  FROM judged WHERE drop_reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY host, path, client_ip, at_ms ORDER BY nullif(referrer, '') NULLS FIRST) = 1),
city AS ({CITY_SQL.format(nation="nation", region="region")}),
asns AS ({ASN_SQL.format(nation="nation")}),
ptr AS ({PTR_SQL.format(events="events")}),
agents AS (
  SELECT * FROM (VALUES
    (0, 'Chrome', 'Windows', 'DESKTOP'), (1, 'Edge', 'Windows', 'DESKTOP'), (2, 'Safari', 'macOS', 'DESKTOP'),
    (3, 'Safari', 'iOS', 'MOBILE'), (4, 'Chrome', 'Android', 'MOBILE'), (5, 'Firefox', 'Linux', 'DESKTOP'),
    (6, 'Samsung Internet', 'Android', 'MOBILE'), (7, 'unknown', 'unknown', 'UNKNOWN'), (8, 'bot', 'other', 'BOT'),
    (9, 'Opera', 'Windows', 'DESKTOP')) AS t(agent, browser, os, device_kind)),
visits AS (
  SELECT site, path, engaged, country, city, asn, org, browser, os, device_kind, ip_hash, referrer, at_ms,
    CASE ptr_host WHEN 'smtp.bakery.co.uk' THEN 'bakery.co.uk' WHEN 'resolver.example' THEN 'resolver.example'
      WHEN 'localhost' THEN NULL ELSE CASE WHEN ptr_host IS NOT NULL THEN 'cable.example' END END AS org_domain,
    make_timestamp(at_ms * 1000) AS visited_at, CAST(make_timestamp(at_ms * 1000) AS DATE) AS visit_day
  FROM described
    LEFT JOIN city ON ip_num BETWEEN city.lo AND city.hi
    LEFT JOIN asns ON ip_num BETWEEN asns.lo AND asns.hi
    LEFT JOIN ptr ON described.client_ip = ptr.client_ip
    JOIN agents ON user_id % 10 = agent)
"""

_NOW = "TIMESTAMP '2024-01-31 12:00:00'"
_NEWEST = "ORDER BY at_ms DESC, site, path, ip_hash"
_ALL = "site, path, engaged, country, city, asn, org, browser, os, device_kind, ip_hash, referrer, org_domain, at_ms"
_SHOWN = _ALL.replace("ip_hash, ", "")
_ENGAGED = "SELECT * FROM visits WHERE ip_hash IN (SELECT ip_hash FROM visits WHERE engaged)"
_PER_DAY = f"""SELECT visit_day, count(*) AS visits, CAST(sum(CAST(engaged AS INTEGER)) AS BIGINT) AS engaged
  FROM visits WHERE visited_at >= {_NOW} - INTERVAL 720 HOUR GROUP BY visit_day"""
_TOP = "SELECT {0} AS label, count(*) AS visits FROM visits WHERE {0} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
_RATE = "SELECT coalesce(avg(CAST(engaged AS INTEGER)), 0.0) AS engaged_rate FROM visits"


def _rollups(visits: str, hours: int) -> str:
    """The document of all rollups of some visits."""
    top = "SELECT {0} AS label, count(*) AS visits FROM seen WHERE {0} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
    listed = "(SELECT list({{'label': label, 'visits': visits}} ORDER BY visits DESC, label) FROM {0})"
    return f""", seen AS (SELECT * FROM {visits.replace("{_NOW}", _NOW)}),
days AS (SELECT visit_day, count(*) AS visits, CAST(sum(CAST(engaged AS INTEGER)) AS BIGINT) AS engaged
  FROM seen WHERE visited_at >= {_NOW} - INTERVAL {hours} HOUR GROUP BY visit_day),
countries AS ({top.format("country")}), referrers AS ({top.format("referrer")})
SELECT CAST(to_json({{'engagedRate': (SELECT coalesce(avg(CAST(engaged AS INTEGER)), 0.0) FROM seen),
  'visitsPerDay': (SELECT list({{'day': strftime(visit_day, '%Y-%m-%d'), 'visits': visits, 'engaged': engaged}}
    ORDER BY visit_day) FROM days),
  'topCountries': {listed.format("countries")}, 'topReferrers': {listed.format("referrers")}
}}) AS VARCHAR) AS document"""


def _numbered(listed: str) -> str:
    """A listing with visitor numbers by first appearance."""
    return f"""listed AS ({listed}),
placed AS (SELECT *, row_number() OVER ({_NEWEST}) AS place FROM listed),
numbered AS (
  SELECT placed.*, visitor FROM placed JOIN (
    SELECT ip_hash, row_number() OVER (ORDER BY min(place)) AS visitor FROM placed GROUP BY ip_hash) USING (ip_hash))"""


def _iso(ms: str) -> str:
    whole = f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S')"
    return f"{whole} || CASE WHEN {ms} % 1000 = 0 THEN '' ELSE '.' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0') END || 'Z'"


def _document(with_asn: bool) -> str:
    asn = "'asn': asn, " if with_asn else ""
    return (
        "CAST(to_json({'visitor': visitor, 'site': site, 'path': path, 'engaged': engaged, 'country': country, "
        f"'city': city, {asn}'org': org, 'orgDomain': org_domain, 'browser': browser, 'os': os, "
        f"'kind': device_kind, 'referrer': referrer, 'at': {_iso('at_ms')}}}) AS VARCHAR)"
    )


_THIRD = "CAST(split_part(client_ip, '.', 3) AS BIGINT)"
_LAST = "CAST(split_part(client_ip, '.', 4) AS BIGINT)"
_IPV6 = f"'2001:DB8:1::' || lower(to_hex({_THIRD})) || ':' || lower(to_hex({_LAST}))"

_REASONS = """SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS lines FROM judged GROUP BY 1
UNION ALL SELECT 'not_a_request', count(*) FROM standin WHERE event_id % 23 = 0 HAVING count(*) > 0
UNION ALL SELECT 'time_out_of_range', count(*) FROM standin WHERE event_id % 41 = 0 HAVING count(*) > 0"""
_DESCRIBED = "site, path, engaged, browser, os, device_kind, ip_hash, referrer, at_ms"

ORACLES = {
    "parse_access_log": "SELECT host, method, split_part(uri, '?', 1) AS path, status, client_ip AS remote_ip, "
    "referrer, user_agent, at_ms FROM raw",
    "consumed_lines": """SELECT (SELECT count(*) FROM raw) + count(*) FILTER (event_id % 23 = 0)
  + count(*) FILTER (event_id % 41 = 0) + count(*) FILTER (event_id % 43 = 0) AS lines, true AS all_bytes FROM standin""",
    "drop_reasons": _REASONS,
    "ingest_report": _REASONS,
    "kept_requests": "SELECT host, path, (method = 'POST') AS engaged, client_ip AS remote_ip, at_ms "
    "FROM judged WHERE drop_reason IS NULL",
    "ip_hash": f"SELECT DISTINCT client_ip AS remote_ip, sha256('{SALT}' || client_ip) AS ip_hash FROM raw",
    "device_class": "SELECT user_agent, browser, os, device_kind, count(*) AS requests "
    "FROM raw JOIN agents ON user_id % 10 = agent GROUP BY ALL",
    "registrable_domain": """, hosts AS (
  SELECT url, replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), 'example.org', 'co.uk') AS host FROM pages),
parts AS (SELECT *, string_split(host, '.') AS labels FROM hosts)
SELECT url, host, CASE WHEN labels[-2] || '.' || labels[-1] = 'co.uk'
  THEN CASE WHEN len(labels) >= 3 THEN labels[-3] || '.co.uk' END ELSE labels[-2] || '.' || labels[-1] END AS org_domain
FROM parts""",
    "reverse_name": "SELECT DISTINCT client_ip AS remote_ip, "
    "array_to_string(list_reverse(string_split(client_ip, '.')), '.') || '.in-addr.arpa' AS arpa FROM raw",
    "reverse_name_ipv6": f"""SELECT DISTINCT {_IPV6} AS remote_ip, array_to_string(list_reverse(string_split(
  '20010db80001000000000000' || lpad(lower(to_hex({_THIRD})), 4, '0') || lpad(lower(to_hex({_LAST})), 4, '0'), '')), '.')
  || '.ip6.arpa' AS arpa FROM raw""",
    "path_strip_pages": f""", paths AS (SELECT url, split_part(replace(replace(
  regexp_replace(url, '^[a-z]+://[^/]*', ''), '.html', '.js'), '/de/', '/WP-Admin/'), '?', 1) AS path FROM pages)
SELECT url, path, regexp_matches(lower(path), '{_SCANS}') AS is_scan, regexp_matches(path, '{_ASSETS}') AS is_asset
FROM paths""",
    "visits_dedupe": f"SELECT {_DESCRIBED} FROM visits",
    "insert_if_absent": f"SELECT {_DESCRIBED} FROM visits",
    "rejected_requests": """SELECT drop_reason, host, path, method, status FROM judged WHERE drop_reason = 'empty_path'
UNION ALL SELECT 'time_out_of_range', host, '/', 'GET', 200 FROM standin WHERE event_id % 41 = 0""",
    "stream_ingest": "SELECT site, path, engaged, ip_hash, country, asn, org_domain, at_ms FROM visits",
    "stream_late_segment": "SELECT site, path, engaged, ip_hash, at_ms FROM visits",
    "stream_since": f"""SELECT site, path, engaged, ip_hash, at_ms FROM visits JOIN described USING (site, path, ip_hash, at_ms, engaged)
WHERE event_id % 2 = 1 OR visited_at >= TIMESTAMP '2024-01-16'""",
    "added_column": f"""SELECT {_ALL.replace("org_domain", "CASE WHEN visit_day >= DATE '2024-01-16' THEN org_domain END AS org_domain")}
FROM visits""",
    "geo_csv_ranges": f"""SELECT DISTINCT client_ip AS remote_ip, n_name AS country, r_name AS city,
  CASE WHEN n_nationkey % 2 = 0 AND {_LAST} % 8 < 4 THEN 64512 + CAST(n_nationkey AS BIGINT) END AS asn,
  CASE WHEN n_nationkey % 2 = 0 AND {_LAST} % 8 < 4 THEN 'Org "' || n_name || '", Ltd' END AS org
FROM raw LEFT JOIN nation ON {_THIRD} * 256 + {_LAST} BETWEEN n_nationkey * 8 AND n_nationkey * 8 + 7
  LEFT JOIN region ON n_regionkey = r_regionkey""",
    "geo_city_join": "SELECT site, ip_hash, at_ms, country, city FROM visits",
    "geo_asn_join": "SELECT site, ip_hash, at_ms, asn, org FROM visits",
    "geo_enrich": "SELECT site, ip_hash, at_ms, country, city, asn, org FROM visits",
    "geo_ipv6_networks": f"""SELECT {_IPV6} AS remote_ip,
  CASE WHEN {_THIRD} = 0 AND {_LAST} < 200 THEN 'NATION_' || ({_LAST} // 8) ELSE 'elsewhere' END AS country,
  CASE WHEN {_THIRD} = 0 AND {_LAST} < 200 THEN NULL ELSE 'anywhere' END AS city, count(*) AS requests
FROM raw GROUP BY 1, 2, 3""",
    "geo_dense": f""", dense AS ({DENSE_SQL.format(events="events")}),
asked AS (SELECT DISTINCT {DENSE_ADDRESS_SQL} AS n FROM events),
inside AS (
  SELECT n, country, city FROM asked JOIN dense ON n BETWEEN lo AND hi
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY lo DESC, hi, country, city) = 1)
SELECT '10.' || (n // 65536) % 256 || '.' || (n // 256) % 256 || '.' || n % 256 AS remote_ip, country, city
FROM asked LEFT JOIN inside USING (n)""",
    "org_domain_join": "SELECT site, ip_hash, at_ms, org_domain FROM visits",
    "visits_from_log": f"SELECT {_ALL} FROM visits",
    "visits_per_day_from_lines": _PER_DAY,
    "visits_per_day": _PER_DAY,
    "latest_days": _PER_DAY + " ORDER BY visit_day DESC LIMIT 10",
    "top_countries": _TOP.format("country"),
    "top_referrers": _TOP.format("referrer"),
    "engaged_rate": _RATE,
    "engaged_rate_empty": f"{_RATE} WHERE visit_day < DATE '2024-01-01'",
    "stat_tiles": f"""SELECT
  (SELECT count(*) FROM visits WHERE visited_at >= {_NOW} - INTERVAL 720 HOUR) AS visits_30d,
  (SELECT count(*) FROM visits WHERE visit_day = DATE '2024-01-31') AS today,
  (SELECT CAST(floor(engaged_rate * 100 + 0.5) AS INTEGER) FROM ({_RATE})) AS engaged_pct,
  coalesce((SELECT label FROM ({_TOP.format("country")}) LIMIT 1), '—') AS top_country""",
    "rollups_stored": _rollups("(SELECT * FROM visits WHERE visited_at >= {_NOW} - INTERVAL 600 HOUR)", 480),
    "recent_engaged_stored": f"SELECT {_SHOWN} FROM ({_ENGAGED} {_NEWEST} LIMIT 50)",
    "hot_visitor": f""", hot AS (SELECT * REPLACE (CASE WHEN ip_hash < '5' THEN 'hot' ELSE ip_hash END AS ip_hash) FROM visits)
SELECT {_ALL} FROM hot WHERE ip_hash IN (SELECT ip_hash FROM hot WHERE engaged) {_NEWEST} LIMIT 500""",
    "rollups_document": _rollups("visits", 720),
    "recent_visits": f"SELECT {_SHOWN} FROM (SELECT * FROM visits {_NEWEST} LIMIT 50)",
    "engaged_visitors": "SELECT DISTINCT ip_hash FROM visits WHERE engaged",
    "visits_of_engaged": f"SELECT site, path, engaged, ip_hash, at_ms FROM ({_ENGAGED})",
    "recent_engaged": f"SELECT {_SHOWN} FROM ({_ENGAGED} {_NEWEST} LIMIT 50)",
    "visitor_ordinal": f", {_numbered(f'SELECT * FROM visits {_NEWEST} LIMIT 500')} "
    "SELECT visitor, site, path, at_ms FROM numbered",
    "visit_documents": f", {_numbered(f'{_ENGAGED} {_NEWEST} LIMIT 500')} "
    f"SELECT place AS row, CASE WHEN asn IS NULL THEN {_document(False)} ELSE {_document(True)} END AS document "
    "FROM numbered",
    "hide_self": "SELECT site, path, city, org, at_ms FROM visits "
    "WHERE NOT (lower(coalesce(city, '')) = 'europe' AND lower(coalesce(org, '')) LIKE '%org nation\\_%' ESCAPE '\\')",
    "hide_scan_noise": f"""SELECT host, path, referrer, at_ms FROM judged
  WHERE NOT regexp_matches(lower(path), '{_SCANS}') AND NOT regexp_matches(lower(coalesce(referrer, '')), '{_SCANS}')""",
    "filtered_listing": f", {_numbered(f'SELECT * FROM visits {_NEWEST} LIMIT 500')} "
    "SELECT visitor, site, path, at_ms FROM numbered "
    "WHERE NOT (lower(coalesce(city, '')) = 'europe' AND contains(lower(coalesce(org, '')), 'org nation_')) "
    f"AND NOT regexp_matches(lower(path), '{_SCANS}') AND NOT regexp_matches(lower(coalesce(referrer, '')), '{_SCANS}')",
    "display_rows": f""", {_numbered(f'SELECT * FROM visits {_NEWEST} LIMIT 500')}
SELECT strftime(visited_at, '%Y-%m-%d %H:%M:%S') AS time, '#' || visitor AS visitor, replace(site, '.example', '') AS site,
  path, coalesce(nullif(concat_ws(', ', city, country), ''), '?') AS location,
  concat_ws(' · ', coalesce(org, 'AS' || asn, '?'), org_domain) AS network,
  browser || ' / ' || os || ' / ' || lower(device_kind) AS client, coalesce(referrer, '') AS referrer,
  CASE WHEN engaged THEN 'yes' ELSE '' END AS engaged FROM numbered""",
    "retention": f"""SELECT count(*) FILTER (visited_at >= {_NOW} - INTERVAL 168 HOUR) AS kept,
  count(*) FILTER (visited_at < {_NOW} - INTERVAL 168 HOUR) AS deleted FROM visits""",
    "retained": f"SELECT site, path, ip_hash, at_ms FROM visits WHERE visited_at >= {_NOW} - INTERVAL 168 HOUR",
    "retention_prune": f"SELECT site, path, ip_hash, at_ms FROM visits WHERE visited_at >= {_NOW} - INTERVAL 168 HOUR",
    "rows_deleted": f"SELECT count(*) AS deleted, true AS as_said FROM visits WHERE visited_at < {_NOW} - INTERVAL 168 HOUR",
    "backlog_roundtrip": f"SELECT {_SHOWN} FROM visits",
    "backlog_replay": f"SELECT {_ALL} FROM visits",
}

ORACLES = {name: (_WITH.rstrip() + "\n" + sql.lstrip()) for name, sql in ORACLES.items()}
