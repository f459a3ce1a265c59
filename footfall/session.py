"""Session settings the jobs rely on, and the shared folder for intermediate tables."""

import math
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SHARED_DIR_SETTING = "spark.checkpoint.dir"

# Log text per shuffle partition. What a visit keeps of its line is about a tenth of the text, and most
# lines are no visits, so a partition of this much text holds 256 MB at most.
BYTES_PER_SHUFFLE_PARTITION = 2560 * 1024 * 1024
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

# Values that a filter may ask Parquet files for one by one.
MOST_VALUES_PUSHED = 100

_local_dirs: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on (UTC days) and let Spark re-plan at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Beyond this number the values of an IN reach the files as their least and greatest only.
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(MOST_VALUES_PUSHED))
    # Of equal keys in a JSON object the last one counts, as everywhere.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Spark's default, INT96, has no minimum and maximum in the files, so no time range could skip any.
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    return spark


def shuffle_partitions(spark: SparkSession, input_bytes: int) -> int:
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, math.ceil(input_bytes / BYTES_PER_SHUFFLE_PARTITION))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Let settings hold for a while; those before hold again afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int) -> Iterator[int]:
    """Start shuffles with enough partitions for the input; adaptive execution merges small ones."""
    partitions = shuffle_partitions(spark, input_bytes)
    with settings(spark, {INITIAL_PARTITIONS: str(partitions)}):
        yield partitions


@contextmanager
def whole_plans(spark: SparkSession) -> Iterator[None]:
    """Keep adaptive execution from leaving out what lies below an empty shuffle, and with it what was observed there."""
    rule = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
    with settings(spark, {"spark.sql.adaptive.optimizer.excludedRules": rule}):
        yield


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; a temporary one only on a single machine with none named."""
    named = spark.sparkContext.getConf().get(SHARED_DIR_SETTING)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SHARED_DIR_SETTING} must name a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="footfall-")
    return _local_dirs[app]
