"""What several operators need: folds, tables in the shared folder, word arrays, ordinals."""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.session import settings, shared_dir
from footfall.sources.files import remove_file_named

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Text handled at once inside a task; a longer text is handled alone.
CHUNK_BYTES = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id falls in part 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % parts, F.lit(0))


def hash_place(id_column: str) -> Column:
    """A number from 0 to 1 for each id, the same in every run."""
    return F.pmod(F.xxhash64(id_column), F.lit(1 << 40)) / float(1 << 40)


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Name a checkpoint folder where the session has none (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def checkpointed(frame: DataFrame) -> DataFrame:
    """For small tables: computed once, kept in the shared folder."""
    with_checkpoints(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that it is computed once."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    schema = frame.schema
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def stored_alone(frame: DataFrame, name: str) -> DataFrame:
    """Like `stored`; the shuffles that made the table are removed from the executors' disks at once."""
    with settings(frame.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        return stored(frame, name)


def forget(*tables: DataFrame) -> None:
    """Remove tables that `stored` wrote and nobody reads any more."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            remove_file_named(table.sparkSession, folder)


def ordinals(frame: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Number rows from 0 in a global order without a window over all of them.

    Rows are range partitioned once; each partition counts its own and starts where the ones before end.
    """
    parts = checkpointed(frame.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = parts.withColumn("_within", within).join(starts, "_part")
    return numbered.withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_start", "_within")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of bounded text, however long or many the texts of a batch are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space: all words in order, and where each text's words begin (n + 1 bounds)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    kept = pc.greater(pc.binary_length(flat), 0)
    counts = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False).astype(np.int64))])
    return flat.filter(kept), counts[bounds]


def codes_of(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's index among the distinct words, and those."""
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): equal inputs give equal, otherwise unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def hash_strings(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, from their UTF-8 bytes."""
    words = words.cast(pa.large_string())
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    buffers = words.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    lengths = np.diff(offsets)
    # A polynomial in an odd base, summed per word; powers count from the word's own start.
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    longest = int(lengths.max()) if n else 0
    powers = np.ones(longest + 1, np.uint64)
    if longest:
        powers[1:] = np.cumprod(np.full(longest, 0x9E3779B97F4A7C15, np.uint64))
    terms = mix64(data.astype(np.uint64) + np.uint64(1)) * powers[place]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    return mix64(sums[starts + lengths] - sums[starts] + lengths.astype(np.uint64))


_WORD_BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2^64, kept for the next call."""
    if len(_powers["up"]) <= n:
        for name, base in (("up", _WORD_BASE), ("down", pow(_WORD_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _plain_table() -> np.ndarray:
    """Letters a to z and digits as they are, A to Z lower-cased, other ASCII a space, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[48:58] = np.arange(48, 58)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


_PLAIN = _plain_table()
_BYTE_HASHES = mix64(np.arange(1, 257, dtype=np.uint64))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of letters and digits, and where each text's begin.

    ASCII characters other than letters and digits end a word, and so does the punctuation of the Unicode
    blocks Latin-1 (U+0080 to U+00BF), General Punctuation and CJK Symbols.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    plain = _PLAIN[data]
    for at, length in ((np.flatnonzero(data == 0xC2), 2), (_blocks(data), 3)):
        for k in range(length):
            plain[at + k] = 32
    inside = np.concatenate([[False], plain != 32, [False]])
    # A word also begins and ends where its text does.
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers_to(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_HASHES[plain] * up[: len(data)], dtype=np.uint64)])
    hashes = mix64((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def _blocks(data: np.ndarray) -> np.ndarray:
    """Where characters of General Punctuation (E2 80, E2 81) and CJK Symbols (E3 80) begin."""
    lead = np.flatnonzero((data[:-2] == 0xE2) | (data[:-2] == 0xE3)) if len(data) > 2 else np.zeros(0, np.int64)
    second = data[lead + 1]
    return lead[(second == 0x80) | ((data[lead] == 0xE2) & (second == 0x81))]
