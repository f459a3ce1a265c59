"""What the visits table says in short, kept beside it: counts per file, and who engaged.

For every file of visits there are its counts by country, referrer and engagement, and the hashes of the visitors
who engaged in it. Files of visits never change and count or do not count as a whole (see `versions`), so sums
over the files that count are exact whatever was appended, rewritten or forgotten meanwhile: files without a summary
are read themselves, and summaries of files that no longer count are not read. A run that ends between storing
visits and summarising them loses nothing.

Tables are summarised from the first `refresh` on; every insert then summarises its own files.
"""

from collections.abc import Iterable, Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.schemas import PARTITION_COLUMN, STORED_VISIT, VERSION_COLUMN
from footfall.sources.files import exists, literal
from footfall.sources.versions import SUMMARIES, Manifest, day_folder, day_names, read_manifest, version_of_day

_PLACE = [PARTITION_COLUMN, VERSION_COLUMN]
_PLACED = [T.StructField(PARTITION_COLUMN, T.DateType()), T.StructField(VERSION_COLUMN, T.IntegerType())]
_COUNTED = ["country", "referrer", "engaged"]
COUNTS = T.StructType(
    [T.StructField("file", T.StringType()), *[STORED_VISIT[name] for name in _COUNTED], T.StructField("visits", T.LongType()), *_PLACED]
)
ENGAGED = T.StructType([T.StructField("file", T.StringType()), T.StructField("ip_hash", T.StringType()), *_PLACED])
# Files named to a reader at once.
MOST_FILES = 10_000


def _folder(path: str, kind: str) -> str:
    return f"{path}/{SUMMARIES}/{kind}"


def is_summarised(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/{SUMMARIES}")


def _stored(spark: SparkSession, path: str, kind: str, schema: T.StructType, manifest: Manifest) -> DataFrame:
    """Summaries of the files that count."""
    if not exists(spark, _folder(path, kind)):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(_folder(path, kind))
    return found.filter(F.col(VERSION_COLUMN) == version_of_day(manifest))


def _counts(visits: DataFrame) -> DataFrame:
    """Counts of each file; they combine before anything is shuffled."""
    return visits.groupBy(*_PLACE, "file", *_COUNTED).agg(F.count("*").alias("visits")).select(COUNTS.fieldNames())


def _engaged(visits: DataFrame) -> DataFrame:
    return visits.filter("engaged").select(ENGAGED.fieldNames()).distinct()


def _missing(spark: SparkSession, path: str, manifest: Manifest, days: Iterable[date] | None = None) -> list[str]:
    """Files that count and have no summary; only names are listed, no file is opened but the summaries."""
    there = day_names(spark, path)
    wanted = there if days is None else sorted({str(day) for day in days} & set(there))
    if not wanted:
        return []
    folders = literal(path) if days is None else [literal(day_folder(path, day)) for day in wanted]
    listed = spark.read.format("binaryFile").option("basePath", path).option("pathGlobFilter", "*.parquet").load(folders)
    if not set(_PLACE) <= set(listed.columns):
        return []
    listed = listed.filter(F.col(VERSION_COLUMN) == version_of_day(manifest))
    # A task gives its files on several days the same name.
    listed = listed.select("path", *_PLACE, F.substring_index("path", "/", -1).alias("file"))
    known = _stored(spark, path, "counts", COUNTS, manifest)
    if days is not None:
        known = known.filter(F.col(PARTITION_COLUMN).isin([date.fromisoformat(day) for day in wanted]))
    return sorted(row.path for row in listed.join(known, [*_PLACE, "file"], "left_anti").select("path").collect())


def _read_files(spark: SparkSession, path: str, files: list[str]) -> Iterator[DataFrame]:
    """The visits of some files with the file they are in."""
    schema = T.StructType([*STORED_VISIT.fields, T.StructField(VERSION_COLUMN, T.IntegerType())])
    for start in range(0, len(files), MOST_FILES):
        chosen = [literal(file) for file in files[start : start + MOST_FILES]]
        visits = spark.read.schema(schema).option("basePath", path).parquet(*chosen)
        yield visits.withColumn("file", F.col("_metadata.file_name"))


def refresh(spark: SparkSession, path: str, days: Iterable[date] | None = None) -> int:
    """Summarise the files that have no summary yet, all or those of some days; how many there were.

    All rows of a file's counts go into one file, so that they appear together: a run that is cut short leaves a
    file summarised or not. Who engaged is written first and is a set, so that it may be written twice.
    """
    manifest = read_manifest(spark, path)
    files = [] if manifest is None else _missing(spark, path, manifest, days)
    for visits in _read_files(spark, path, files):
        for kind, summary in (("engaged", _engaged(visits)), ("counts", _counts(visits))):
            whole = summary.repartition(*_PLACE, "file").sortWithinPartitions(*_PLACE, "file")
            whole.write.mode("append").partitionBy(*_PLACE).parquet(_folder(path, kind))
    return len(files)


def _summary(spark: SparkSession, path: str, kind: str, schema: T.StructType, summarise) -> DataFrame:
    manifest = read_manifest(spark, path)
    if manifest is None:
        return spark.createDataFrame([], schema)
    found = _stored(spark, path, kind, schema, manifest)
    for visits in _read_files(spark, path, _missing(spark, path, manifest)):
        found = found.unionByName(summarise(visits))
    return found


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """visit_day, country, referrer, engaged, visits: rows that add up to the table's counts."""
    return _summary(spark, path, "counts", COUNTS, _counts).drop("file", VERSION_COLUMN)


def read_engaged(spark: SparkSession, path: str) -> DataFrame:
    """ip_hash of everyone who ever engaged, once for each file they engaged in."""
    return _summary(spark, path, "engaged", ENGAGED, _engaged).select("ip_hash")
