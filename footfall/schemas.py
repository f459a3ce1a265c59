"""Explicit schemas: nothing is ever inferred."""

from pyspark.sql import types as T

RAW_REQUEST = T.StructType(
    [
        T.StructField("host", T.StringType(), False),
        T.StructField("method", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("status", T.IntegerType(), False),
        T.StructField("remote_ip", T.StringType(), False),
        T.StructField("referrer", T.StringType()),
        T.StructField("user_agent", T.StringType(), False),
        T.StructField("at", T.TimestampType(), False),
    ]
)

# org_domain came later than the rest: files written without it read back as null.
VISIT = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("engaged", T.BooleanType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("asn", T.LongType()),
        T.StructField("org", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("os", T.StringType()),
        T.StructField("device_kind", T.StringType()),
        T.StructField("ip_hash", T.StringType()),
        T.StructField("referrer", T.StringType()),
        T.StructField("visited_at", T.TimestampType()),
        T.StructField("org_domain", T.StringType()),
    ]
)
VISIT_COLUMNS = VISIT.fieldNames()

# A stored visit is one per key; the day is the partition column of the table. The time comes first
# because sorts by the key then seldom compare text.
VISIT_KEY = ["visited_at", "ip_hash", "path", "site"]
PARTITION_COLUMN = "visit_day"
# Inside a day's folder; which one counts is in the manifest (sources/versions.py).
VERSION_COLUMN = "version"
STORED_VISIT = T.StructType([*VISIT.fields, T.StructField(PARTITION_COLUMN, T.DateType())])

BACKLOG = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("engaged", T.BooleanType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("asn", T.LongType()),
        T.StructField("org", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("os", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ipHash", T.StringType()),
        T.StructField("referrer", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("orgDomain", T.StringType()),
    ]
)
