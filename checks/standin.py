"""An access log, network ranges and PTR records made from the given tables.

The log is not only well-formed lines: a tenth of the requests is delivered twice, the second time in another spelling
of the same request (repeated keys, other key orders, a relay's address) and for some of them with another referrer;
requests without a path, times beyond the calendar, lines that hold no request and blank ones lie among them.
"""

import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.once import evaluate_once
from footfall.plans.ingest import Lookups, ingest_lines
from footfall.session import prepare, shared_dir
from footfall.settings import Settings
from footfall.sources.access_log import read_lines
from footfall.sources.files import children, total_bytes
from footfall.sources.lookups import numeric_ranges, read_prepared, write_prepared
from footfall.sources.visits_table import read_visits

NOW = datetime(2024, 1, 31, 12)
SALT = "grains-for-checks-and-tests-only"
SETTINGS = Settings(salt=SALT, internal_proxies=frozenset(["203.0.0.13"]))

# One request per event; the same text runs in both engines but for the milliseconds.
REQUESTS_SQL = """
SELECT event_id, user_id,
  CASE event_id % 3 WHEN 0 THEN 'guide.example' WHEN 1 THEN 'store.example' ELSE 'forum.example' END AS host,
  CASE WHEN event_type IN ('purchase','signup') AND user_id % 4 = 1 THEN 'POST'
       WHEN event_id % 29 = 0 THEN 'HEAD' ELSE 'GET' END AS method,
  CASE WHEN event_type = 'purchase' AND user_id % 4 = 1 THEN '/api/order'
       WHEN event_type = 'signup' AND user_id % 4 = 1 AND event_id % 7 = 0 THEN '/login'
       WHEN event_type = 'signup' AND user_id % 4 = 1 THEN '/api/report?x=1'
       WHEN event_id % 11 = 0 THEN '/app.css'
       WHEN event_id % 13 = 0 THEN '/healthz'
       WHEN event_id % 17 = 0 THEN '/WP-login.php'
       WHEN event_id % 19 = 0 THEN '/api/report'
       WHEN event_type = 'click' THEN '/summary?from=3&to=9' ELSE '/' END AS uri,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 404 ELSE 200 END AS status,
  '203.0.' || CAST(CAST(floor(user_id / 256) AS BIGINT) AS VARCHAR(20)) || '.' || CAST(user_id % 256 AS VARCHAR(20)) AS client_ip,
  CASE user_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'https://social.example/feed' WHEN 2 THEN 'https://jobs.example'
       WHEN 3 THEN 'https://news.example/item' WHEN 4 THEN '' ELSE 'https://blog.example//WordPress/' END AS referrer,
  CASE user_id % 10
    WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/133.0.0.0 Safari/537.36'
    WHEN 1 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/133.0.0.0 Safari/537.36 Edg/133.0.3065.92'
    WHEN 2 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 Version/18.3 Safari/605.1.15'
    WHEN 3 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 18_3 like Mac OS X) AppleWebKit/605.1.15 Version/18.3 Mobile/15E148 Safari/604.1'
    WHEN 4 THEN 'Mozilla/5.0 (Linux; Android 15; Pixel 9) AppleWebKit/537.36 Chrome/133.0.0.0 Mobile Safari/537.36'
    WHEN 5 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:135.0) Gecko/20100101 Firefox/135.0'
    WHEN 6 THEN 'Mozilla/5.0 (Linux; Android 15) SamsungBrowser/27.0 Chrome/125.0.0.0 Mobile Safari/537.36'
    WHEN 7 THEN '' WHEN 8 THEN 'curl/8.11.1' ELSE 'Opera/9.80 (Windows NT 6.1)' END AS user_agent,
  {millis} AS at_ms
FROM {events}
"""
SPARK_MILLIS = "unix_millis(CAST(ts AS TIMESTAMP))"

# Second deliveries, some with another referrer, and requests without a path.
AGAIN_SQL = """
SELECT event_id, user_id, host, method, uri, status, client_ip,
  CASE event_id % 60 WHEN 0 THEN 'https://aaa.example/first' WHEN 20 THEN 'https://zzz.example/last'
    WHEN 40 THEN NULL ELSE referrer END AS referrer, user_agent, at_ms
FROM {requests} WHERE event_id % 10 = 0
"""
WITHOUT_PATH_SQL = """
SELECT event_id, CAST(5 AS BIGINT) AS user_id, 'guide.example' AS host, 'GET' AS method, '?q=1' AS uri, 200 AS status,
  '203.0.0.5' AS client_ip, NULL AS referrer, 'Mozilla/5.0 (X11; Linux x86_64; rv:135.0) Gecko/20100101 Firefox/135.0' AS user_agent, at_ms
FROM {requests} WHERE event_id % 37 = 0
"""

# 203.0.0.0 as a number; ranges cover 7 of 8 addresses (cities) and 6 of 8 (networks).
CITY_SQL = """
SELECT 3405774848 + n_nationkey * 8 AS lo, 3405774848 + n_nationkey * 8 + 6 AS hi, n_name AS country, r_name AS city
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""
ASN_SQL = """
SELECT 3405774848 + n_nationkey * 8 AS lo, 3405774848 + n_nationkey * 8 + 5 AS hi,
  CAST(64512 + n_nationkey AS BIGINT) AS asn, 'Org ' || n_name AS org
FROM {nation} WHERE n_nationkey % 2 = 0
"""
# 10.0.0.0 as a number; an address for each event, and ranges that nest, overlap and lie apart.
DENSE_ADDRESS_SQL = "167772160 + (event_id * 7919) % 1048576"
DENSE_SQL = """
SELECT 167772160 + event_id * 16 AS lo, 167772160 + event_id * 16 + 11 AS hi, 'block' AS country,
  CAST(event_id AS VARCHAR(20)) AS city FROM {events}
UNION ALL SELECT 167772160 + event_id * 16 + 3, 167772160 + event_id * 16 + 3 + event_id % 5, 'inner', CAST(event_id AS VARCHAR(20))
FROM {events} WHERE event_id % 3 = 0
UNION ALL SELECT 167772160 + event_id * 16 + 5, 167772160 + event_id * 16 + 30, 'across', CAST(event_id AS VARCHAR(20))
FROM {events} WHERE event_id % 7 = 0
UNION ALL SELECT 167772160 + event_id * 16, 167772160 + event_id * 16 + 1499, 'wide', CAST(event_id AS VARCHAR(20))
FROM {events} WHERE event_id % 64 = 0
UNION ALL SELECT 167772160, 167772160 + 800000, 'all', 'everyone' FROM {events} WHERE event_id % 64 = 0
"""
PTR_SQL = """
SELECT DISTINCT
  '203.0.' || CAST(CAST(floor(user_id / 256) AS BIGINT) AS VARCHAR(20)) || '.' || CAST(user_id % 256 AS VARCHAR(20)) AS client_ip,
  CASE user_id % 4 WHEN 0 THEN 'host-' || CAST(user_id AS VARCHAR(20)) || '.cable.example.' WHEN 1 THEN 'smtp.bakery.co.uk'
    WHEN 2 THEN 'resolver.example' ELSE 'localhost' END AS ptr_host
FROM {events} WHERE (user_id % 256) % 7 <> 0
"""

# Files and tables made for an application, by (application, input folder, what).
_paths: dict[tuple[str, str, str], str] = {}


# Bytes of stored events for each task that makes requests of them.
BYTES_PER_TASK = 4 * 2**20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests are made of, over enough tasks however few row groups hold it.

    A line is some twenty times as long as its event, so events are moved before lines are made of them.
    """
    parts = max(spark.sparkContext.defaultParallelism, total_bytes(spark, f"{sf_dir}/events.parquet") // BYTES_PER_TASK)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type").repartition(parts, "event_id", "user_id", "ts")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request as fields, with its event id and the number of its delivery (3: those without a path)."""
    prepare(spark)
    events = spread_events(spark, sf_dir)
    once = spark.sql(REQUESTS_SQL.format(millis=SPARK_MILLIS, events="{events}"), events=events)
    again = spark.sql(AGAIN_SQL, requests=once)
    without_path = spark.sql(WITHOUT_PATH_SQL, requests=once)
    sent = [frame.withColumn("delivery", F.lit(n)) for n, frame in enumerate((once, again, without_path), 1)]
    return sent[0].unionByName(sent[1]).unionByName(sent[2])


def as_lines(requests: DataFrame) -> DataFrame:
    """Requests as JSON access-log lines; a second delivery in another spelling."""
    second = F.col("delivery") == 2
    # Behind a relay, or without a field of its own for the client.
    relayed = F.when(second, F.lit("10.1.1.1")).otherwise(F.col("client_ip"))
    alone = ~second & (F.col("event_id") % 7 == 0)
    line = F.struct(
        F.lit("info").alias("level"),
        (F.col("at_ms").cast("double") / 1000).alias("ts"),
        F.lit("http.log.access.log0").alias("logger"),
        F.lit("handled request").alias("msg"),
        F.struct(
            relayed.alias("remote_ip"),
            F.lit("51716").alias("remote_port"),
            F.when(~alone, F.col("client_ip")).alias("client_ip"),
            F.lit("HTTP/2.0").alias("proto"),
            "method",
            "host",
            "uri",
            F.struct(
                F.array("user_agent", F.lit("decoy")).alias("User-Agent"),
                F.when(F.col("referrer").isNotNull(), F.array("referrer")).alias("Referer"),
            ).alias("headers"),
        ).alias("request"),
        F.lit(0.000123).alias("duration"),
        F.lit(2326).alias("size"),
        "status",
    )
    written = requests.select("event_id", "delivery", evaluate_once(value=F.to_json(line)))
    return written.select(F.when(F.col("delivery") == 2, _respelt()).otherwise(F.col("value")).alias("value"))


def _respelt():
    """The same request in one of six spellings."""
    text, rest = F.col("value"), F.substring("value", F.lit(2), F.length("value"))
    spelt = F.when(F.col("event_id") % 60 == 10, F.concat(F.lit('{"request":5,'), rest))
    for remainder, prefix in ((20, '{"status":"x","ts":"y",'), (30, '{"request":{"host":"decoy.example","method":"PUT"},')):
        spelt = spelt.when(F.col("event_id") % 60 == remainder, F.concat(F.lit(prefix), rest))
    doubled = F.replace(text, F.lit('"host":"'), F.lit('"host":12,"host":"'))
    headers = F.lit('"headers":7,"headers":{"Accept":["text/html"],"User-Agent":"decoy",')
    spelt = spelt.when(F.col("event_id") % 60 == 40, F.replace(doubled, F.lit('"headers":{'), headers))
    escaped = F.replace(text, F.lit('"request":'), F.lit('"requ\\u0065st":'))
    return spelt.when(F.col("event_id") % 60 == 50, F.concat(escaped, F.lit(" and more\r"))).otherwise(F.concat(F.lit(" "), text))


# How a line can fail to hold a request, as changes of a good line.
BROKEN = [
    lambda text: F.substring(text, F.lit(1), F.ceil(F.length(text) / 2).cast("int")),
    lambda text: F.replace(text, F.lit('"'), F.lit("'")),
    lambda text: F.regexp_replace(text, '"status":[0-9]+', '"status":"200"'),
    lambda text: F.regexp_replace(text, '"status":[0-9]+', '"status":200,"status":null'),
    lambda text: F.regexp_replace(text, '"ts":[0-9.E]+', '"ts":"1706700000"'),
    lambda text: F.regexp_replace(text, '"host":"[^"]*"', '"host":12'),
    lambda text: F.regexp_replace(text, '"uri":"[^"]*",', ""),
    lambda text: F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"request":"none"}')),
    lambda text: F.concat(F.lit("["), text, F.lit("]")),
    lambda text: F.lit("server started"),
    lambda text: F.lit("null"),
    lambda text: F.lit('{"level":"warn","ts":1706700000.25,"msg":"shutting down"}'),
]


def odd_lines(requests: DataFrame) -> DataFrame:
    """Lines without a request, with a time beyond the calendar, and blank ones."""
    once = requests.filter("delivery = 1")
    good = as_lines(once.filter("event_id % 41 = 0").withColumns({
        "method": F.lit("GET"), "uri": F.lit("/"), "status": F.lit(200), "client_ip": F.lit("198.51.100.1"),
        "referrer": F.lit(None).cast("string"), "user_agent": F.lit("Opera/9.80 (Windows NT 6.1)"),
    }))
    beyond = good.select(F.regexp_replace("value", '"ts":[0-9.E]+', '"ts":1e300').alias("value"))
    blank = once.filter("event_id % 43 = 0").select(F.when(F.col("event_id") % 2 == 0, "").otherwise(" \t\r").alias("value"))
    found = beyond.unionByName(blank)
    for kind, change in enumerate(BROKEN):
        chosen = as_lines(once.filter((F.col("event_id") % 23 == 0) & (F.floor(F.col("event_id") / 23) % len(BROKEN) == kind)))
        found = found.unionByName(chosen.select(change(F.col("value")).alias("value")))
    return found


def dealt(lines: DataFrame) -> DataFrame:
    """Lines at random over as many files as there are cores.

    By their hash: dealing rows out in turn would sort all text in every task first, and spill it.
    """
    return lines.repartition(lines.sparkSession.sparkContext.defaultParallelism, F.xxhash64("value"))


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """Where the whole log is as text files, written on the first use by an application."""
    key = (spark.sparkContext.applicationId, sf_dir, "log")
    if key not in _paths:
        path = new_folder(spark, "log")
        sent = deliveries(spark, sf_dir)
        lines = as_lines(sent).unionByName(odd_lines(sent))
        dealt(lines).write.text(path)
        _paths[key] = path
    return _paths[key]


def deliver(lines: DataFrame, folder: str, days_old: int) -> None:
    """Write lines as files and move them into a folder, where they keep a time some days back."""
    spark = lines.sparkSession
    path = new_folder(spark, "written")
    lines.write.text(path)
    jvm = spark.sparkContext._jvm
    system = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    changed = int((time.time() - days_old * 86400) * 1000)
    for name in children(spark, path):
        if name.startswith("part-"):
            target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            system.setTimes(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), changed, -1)
            system.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), target)


def network_csv(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """City blocks, their locations and network blocks as CSV folders, made of nation and region.

    A nation has 8 addresses; an even one a network of the first 4 of them.
    """
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    start = F.concat(F.lit("203.0.0."), (F.col("n_nationkey") * 8).cast("string"))
    none = F.lit(None).cast("string")
    id_text = F.col("n_nationkey").cast("string")
    blocks = nation.select(F.concat(start, F.lit("/29")), id_text, *[none] * 9)
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select(id_text, *[none] * 4, "n_name", *[none] * 4, "r_name", *[none] * 3)
    org = F.concat(F.lit('Org "'), "n_name", F.lit('", Ltd'))
    networks = nation.filter(F.col("n_nationkey") % 2 == 0)
    networks = networks.select(F.concat(start, F.lit("/30")), (F.col("n_nationkey") + 64512).cast("string"), org)
    folders = []
    for name, frame in (("blocks", blocks), ("places", places), ("networks", networks)):
        folders.append(new_folder(spark, name))
        named = frame.toDF(*[f"c{n}" for n in range(len(frame.columns))])
        named.write.option("header", "true").option("escape", '"').csv(folders[-1])
    return tuple(folders)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lines(spark, log_files(prepare(spark), sf_dir))


def city_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return numeric_ranges(spark.sql(CITY_SQL, nation=nation, region=region))


def asn_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric_ranges(spark.sql(ASN_SQL, nation=table(spark, sf_dir, "nation")))


def ptr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PTR_SQL, events=table(spark, sf_dir, "events"))


def lookups(spark: SparkSession, sf_dir: str) -> Lookups:
    """All tables, prepared on the first use by an application."""
    key = (spark.sparkContext.applicationId, sf_dir, "lookups")
    if key not in _paths:
        path = new_folder(spark, "lookups")
        write_prepared(spark, path, city_ranges(spark, sf_dir), asn_ranges(spark, sf_dir), ptr_table(spark, sf_dir))
        _paths[key] = path
    return Lookups(prepared=read_prepared(spark, _paths[key]))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/footfall-checks/{name}-{uuid.uuid4().hex}"


def stored_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the visits table of the whole log is, ingested on the first use by an application."""
    key = (spark.sparkContext.applicationId, sf_dir, "visits")
    if key not in _paths:
        path = new_folder(spark, "visits")
        ingest_lines(log_lines(spark, sf_dir), path, SETTINGS, lookups(spark, sf_dir))
        _paths[key] = path
    return _paths[key]


def stored_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_visits(prepare(spark), stored_path(spark, sf_dir))
