"""From raw documents to a training mix: five stages, each over all that the one before kept.

Every stage tells rows apart by a key made of id and text, so that null and repeated ids change nothing: a row
without an id is judged by its own text, and of two texts under one id each has its own answer.

Defined results: a null text is scored, kept or dropped like an empty one and is no copy of another; of rows equal in id
and text the near-duplicate stage keeps one; among the members of a class it keeps the one with the smallest id, a null
id last, then the smaller key; texts are read whole, however long; an empty table goes through as an empty table;
columns other than those of documents are dropped by the first stage.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import decontaminate, mixing, near_dup, pii, quality
from footfall.llm.common import DOCUMENT_COLUMNS, documents, stored


def row_key() -> Column:
    """A number for each pair of id and text, never null."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def keyed(docs: DataFrame) -> DataFrame:
    """The key in the place of the id, and the text."""
    return docs.select(row_key().alias("doc_id"), "text")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    scored = quality.score(docs, quality.trained_on(spark, sf_dir, docs))
    return scored.filter("accepted").select(*DOCUMENT_COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates, and of rows equal in id and text one."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    rows = stored(docs.select("doc_id", row_key().alias("_key")).groupBy("_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "keys")
    classes = near_dup.near_duplicates(keyed(docs)).select(F.col("doc_id").alias("_key"), "class_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key", "rows")).alias("_first")
    first = rows.join(classes, "_key").groupBy("class_id").agg(least).select("_first._key", "_first.rows")
    # The kept keys grow with the documents, so both sides are dealt out by key, at every size alike.
    kept = docs.withColumn("_key", row_key()).join(stored(first, "first").hint("merge"), "_key")
    repeated = kept.filter(F.col("rows") > 1).dropDuplicates(["_key"])
    return kept.filter(F.col("rows") == 1).unionByName(repeated).select(*DOCUMENT_COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    found = decontaminate.matches(keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = stored(found.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return docs.withColumn("_key", row_key()).join(found, "_key", "left_anti").select(*DOCUMENT_COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and the terms that disclose it, in the texts."""
    clean = pii.sanitise(docs.select(*DOCUMENT_COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))
    return clean.select(*DOCUMENT_COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with `copies` whole repetitions and `part` words of one more."""
    taken = mixing.mix(docs.select(*DOCUMENT_COLUMNS), carry=("text", "lang", "n_chars")).filter(F.col("taken") > 0)
    return taken.select(*DOCUMENT_COLUMNS, "size", "source_size", "target", "copies", "part", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("mixing sources", mixed),
]

# Classifiers, signatures and embeddings are beyond SQL; tests check each stage on planted rows and its operator alone.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
