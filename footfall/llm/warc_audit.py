"""Merkle fixity audit of WARC replicas.

Every record is hashed. The records of a file are cut into ranges of `leaf_bytes` of offset; a range's node
hashes its records in order of offset, and `fanout` neighbouring nodes make a node of the level above, up
to one root for each file. Two replicas compare roots first and descend only into branches that differ, so
that an audit of intact files reads one row for each of them. Below the last differing ranges the records
themselves are compared.

Offsets are those the index of the archive promised, so that a lost record leaves a gap and shifts nothing.

Defined results: null and empty payloads hash as empty; records without a url are kept; repeated rows are
records of their own at their own offsets; an empty archive has no nodes, and against a full one every
record is missing or extra; columns besides those named are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import stored

RECORD = ["file", "offset", "length", "record_id", "digest"]


def warc_records(pages: DataFrame, pages_per_file: int = 2048) -> DataFrame:
    """Pages as WARC response records: file, offset, length, record_id, record (bytes as text).

    A file holds the pages of a range of ids, in order of id, so that no file grows with the corpus.
    """
    payload = F.coalesce("html", F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    record = F.concat(header, payload, F.lit("\r\n\r\n"))
    file = F.coalesce(F.floor(F.col("page_id") / pages_per_file), F.lit(-1))
    return pages.select(file.cast("long").alias("file"), F.col("page_id").alias("record_id"), record.alias("record"))


def fingerprints(records: DataFrame) -> DataFrame:
    """RECORD columns; the bytes of a record are read once, and only its digest goes on."""
    hashed = records.select(
        "file", "record_id", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest")
    )
    order = Window.partitionBy("file").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).select(*RECORD)


def _node(entries: Column) -> Column:
    """Hash of ordered children."""
    texts = F.transform(F.array_sort(entries), lambda e: F.concat_ws(":", e["at"].cast("string"), e["digest"]))
    return F.sha2(F.concat_ws(",", texts).cast("binary"), 256)


def merkle_levels(records: DataFrame, leaf_bytes: int, fanout: int, levels: int) -> list[DataFrame]:
    """Node tables (file, node, digest) from the leaves to the roots; each is computed once.

    A leaf holds the records that begin in `leaf_bytes` of offset; a higher node at most `fanout` children.
    """
    at = F.col("offset")
    entry = F.struct(at.alias("at"), F.concat_ws(":", F.col("length").cast("string"), "digest").alias("digest"))
    leaves = records.groupBy("file", F.floor(at / leaf_bytes).alias("node")).agg(_node(F.collect_list(entry)).alias("digest"))
    tables = [stored(leaves, "merkle-0")]
    for level in range(1, levels + 1):
        child = F.struct(F.col("node").alias("at"), "digest")
        parent = F.floor(F.col("node") / fanout) if level < levels else F.lit(0).cast("long")
        nodes = tables[-1].groupBy("file", parent.alias("parent")).agg(_node(F.collect_list(child)).alias("digest"))
        tables.append(stored(nodes.withColumnRenamed("parent", "node"), f"merkle-{level}"))
    return tables


def _differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """(file, node) of nodes that differ or that only one side has."""
    renamed = other.select("file", "node", F.col("digest").alias("_other"))
    joined = one.select("file", "node", "digest").join(renamed, ["file", "node"], "full_outer")
    return joined.filter(~F.col("digest").eqNullSafe(F.col("_other"))).select("file", "node")


def audit(
    original: DataFrame, replica: DataFrame, leaf_bytes: int = 262_144, fanout: int = 16, levels: int = 4
) -> DataFrame:
    """Records that differ between two replicas: file, offset, length, record_id, status (changed, missing, extra).

    Both take RECORD columns. `levels` above the leaves reach one root for files up to
    leaf_bytes * fanout ** (levels - 1) * fanout bytes; the last level joins whatever is left.
    """
    sides = [merkle_levels(side.select(*RECORD), leaf_bytes, fanout, levels) for side in (original, replica)]
    suspects = _differing(sides[0][levels], sides[1][levels])
    for level in range(levels - 1, -1, -1):
        parents = suspects.select("file", F.col("node").alias("_parent"))
        parent = F.floor(F.col("node") / fanout) if level + 1 < levels else F.lit(0).cast("long")

        def below(nodes: DataFrame) -> DataFrame:
            return nodes.withColumn("_parent", parent).join(parents, ["file", "_parent"], "left_semi")

        suspects = stored(_differing(below(sides[0][level]), below(sides[1][level])), f"suspects-{level}")
    ranges = suspects.withColumnRenamed("node", "_leaf")

    def records_in(side: DataFrame, prefix: str) -> DataFrame:
        found = side.withColumn("_leaf", F.floor(F.col("offset") / leaf_bytes)).join(ranges, ["file", "_leaf"], "left_semi")
        return found.select("file", "offset", *[F.col(c).alias(f"{prefix}{c}") for c in ("length", "record_id", "digest")])

    pairs = records_in(original, "a_").join(records_in(replica, "b_"), ["file", "offset"], "full_outer")
    status = (
        F.when(F.col("b_digest").isNull(), "missing")
        .when(F.col("a_digest").isNull(), "extra")
        .when((F.col("a_digest") != F.col("b_digest")) | (F.col("a_length") != F.col("b_length")), "changed")
    )
    return pairs.withColumn("status", status).filter(F.col("status").isNotNull()).select(
        "file",
        "offset",
        F.coalesce("a_length", "b_length").alias("length"),
        F.coalesce("a_record_id", "b_record_id").alias("record_id"),
        "status",
    )


def damaged(records: DataFrame) -> DataFrame:
    """A replica for the registered query: some records altered in place, some lost, by record id."""
    odd = F.coalesce(F.col("record_id"), F.lit(0)) % 97
    altered = F.when(odd == 5, F.concat(F.lit("X"), F.expr("substring(record, 2)"))).otherwise(F.col("record"))
    return records.withColumn("record", altered)


def audit_query(spark, sf_dir: str) -> DataFrame:
    """All pages as an archive, audited against a replica with altered and lost records."""
    records = warc_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    original = stored(fingerprints(records), "original")
    replica = fingerprints(damaged(records)).filter(F.coalesce(F.col("record_id"), F.lit(0)) % 211 != 7)
    return audit(original, stored(replica, "replica"))


AUDIT_SQL = r"""
WITH records AS (
  SELECT coalesce(CAST(page_id // 2048 AS BIGINT), -1) AS file, page_id AS record_id,
    CAST(strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
      || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
      || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
      || repeat(chr(13) || chr(10), 2) || coalesce(html, '') || repeat(chr(13) || chr(10), 2)) AS BIGINT) AS length
  FROM pages),
placed AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY record_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM records)
SELECT file, "offset", length, record_id,
  CASE WHEN coalesce(record_id, 0) % 211 = 7 THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE coalesce(record_id, 0) % 211 = 7 OR coalesce(record_id, 0) % 97 = 5"""
