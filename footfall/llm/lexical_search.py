"""Ranked lexical search by presence masks.

One pass over the documents keeps, for each, its number of terms and how often it holds each term that some
item asks for. The totals that weights need (documents, terms, documents per term) are sums over that table.

A second pass takes the table in shards of bounded size. For each item of a shard, the bitmaps of the item's
terms are laid side by side, so that every document has a mask of the terms it holds, and documents are grouped
by it. A mask bounds the score of its documents: the sum over its terms of the weight times the largest
factor the term has in the shard. Masks are evaluated from the highest bound down, until the k-th best score
found so far in the task is above the bound of the next mask; a document below that bound cannot be among
the k best. Tasks give back at most k rows per item, which are ranked in two steps.

Scores are whole numbers, so they are the same in any order. Items are taken in groups of bounded size: what
tasks share of a group is its terms, never the documents. Documents are not capped and read whole.

Defined results: a text that is null or has no term counts nowhere; rows with a repeated id are documents of
their own, a null id comes last among equals; all rows of one item id (null as well) are one item, which asks
for the terms of its distinct texts, repeats included; an item without terms has no rows; documents of score 0
are not ranked; an empty table on either side gives an empty table; other columns are ignored, whatever
their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.common import checkpointed, documents, slices, stored, words_of

# What a term is, and which characters change case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (item, term) rows that tasks share at once.
GROUP_TERMS = 200_000
SHARD_DOCS = 16_384
SHARD_POSTINGS = 4_000_000
# Documents evaluated at once, at least.
STEP_DOCS = 64
SALTS = 32
COUNTED = "doc_id long, n long, terms array<int>, times array<int>"
FOUND = "item int, doc_id long, score long"


def _term_bytes() -> bytes:
    """What each byte of a text becomes: ASCII letters in lower case, digits and all bytes beyond ASCII as they
    are, anything else a space."""
    plain = bytearray(range(256))
    for code in range(128):
        plain[code] = ord(chr(code).lower()) if chr(code).isalnum() else 32
    return bytes(plain)


_TERM_BYTES = _term_bytes()


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms in order, and where each text's begin (n + 1 bounds)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer((data.to_pybytes() if data else b"").translate(_TERM_BYTES))
    return words_of(pa.LargeStringArray.from_buffers(len(texts), offsets, plain, offset=texts.offset))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of each item."""
    texts = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    lower = F.translate("text", UPPER, LOWER)
    terms = texts.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def item_groups(items: DataFrame) -> list[DataFrame]:
    """(item_id, terms: array of (term, times)) in groups of bounded size; an item is in one group."""
    terms = checkpointed(item_terms(items))
    groups = max(1, -(-terms.count() // GROUP_TERMS))
    whole = terms.groupBy("item_id").agg(F.collect_list(F.struct("term", "times")).alias("terms"))
    return [whole.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) for g in range(groups)]


def counted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n, and the terms of a vocabulary (by place) that a document holds, with how often."""
    words, size = pa.array(vocabulary, pa.large_string()), max(1, len(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            terms, bounds = terms_of(batch.column("text"))
            place = pc.index_in(terms, value_set=words)
            known = np.flatnonzero(pc.is_valid(place).to_numpy(zero_copy_only=False))
            codes = pc.drop_null(place).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.searchsorted(bounds, known, side="right") - 1
            pairs, times = np.unique(doc * size + codes, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * size).astype(np.int32)
            n = np.diff(bounds)
            columns = [
                batch.column("doc_id"), pa.array(n),
                pa.ListArray.from_arrays(pa.array(ends), pa.array((pairs % size).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"]).filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(count, COUNTED), "term-counts")


class Best:
    """The k best documents of an item so far: highest score first, then the smaller id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.unnamed = np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        unnamed = np.concatenate([self.unnamed, unnamed])
        order = np.lexsort((ids, unnamed, -scores))[: self.k]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]

    def least(self) -> int:
        """What a score has to reach to matter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1


class Shard:
    """Documents of a shard by term: which hold it, and its factor in each of them."""

    def __init__(self, ids: pa.Array, n: np.ndarray, terms: np.ndarray, times: np.ndarray, ends: np.ndarray, facts: tuple[int, int]):
        documents, total = facts
        self.unnamed = pc.is_null(ids).to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        m = 100 - 25 + (25 * n.astype(np.int64) * documents) // total
        times = times.astype(np.int64)
        factor = (1_000_000_000 * times) // (1000 * times + 12 * m[doc])
        order = np.argsort(terms, kind="stable")
        self.docs, self.factors = doc[order], factor[order]
        held, starts = np.unique(terms[order], return_index=True)
        bounds = [*starts.tolist(), len(order)]
        most = np.maximum.reduceat(self.factors, starts) if len(held) else np.zeros(0, np.int64)
        self.places = {int(t): (a, b, int(high)) for t, a, b, high in zip(held, bounds, bounds[1:], most)}

    def search(self, asked: list[tuple[int, int]], best: Best) -> None:
        """Add to an item's best; `asked` has its terms and their weights, none of them 0."""
        held = [(*self.places[t], weight) for t, weight in asked if t in self.places]
        # A bound of all terms together settles most items of a shard without a look at its documents.
        if sum(weight * high for _, _, high, weight in held) < best.least():
            return
        masks = np.zeros((len(self.ids), -(-len(held) // 64)), np.uint64)
        for j, (a, b, _, _) in enumerate(held):
            masks[self.docs[a:b], j // 64] |= np.uint64(1) << np.uint64(j % 64)
        some = np.flatnonzero(masks.any(axis=1))
        if masks.shape[1] == 1:
            distinct, group = np.unique(masks[some, 0], return_inverse=True)
            distinct = distinct[:, None]
        else:
            distinct, group = np.unique(masks[some], axis=0, return_inverse=True)
        bounds = np.zeros(len(distinct), np.int64)
        holds = [(distinct[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1) != 0 for j in range(len(held))]
        for has, (_, _, high, weight) in zip(holds, held):
            bounds[has] += weight * high
        order = np.argsort(-bounds, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_mask = rank[group.reshape(-1)]
        members = some[np.argsort(by_mask, kind="stable")]
        ends = np.cumsum(np.bincount(by_mask, minlength=len(order)))
        bounds, done, at, step = bounds[order], 0, 0, STEP_DOCS
        while at < len(order) and bounds[at] >= best.least():
            # The next masks whose bound still counts, some documents at once.
            until = max(at + 1, int(np.searchsorted(ends, done + step, side="right")))
            until = min(until, int(np.searchsorted(-bounds, -best.least(), side="right")))
            chosen = np.sort(members[done : ends[until - 1]])
            scores = np.zeros(len(chosen), np.int64)
            for a, b, _, weight in held:
                near = np.searchsorted(self.docs[a:b], chosen)
                near[near == b - a] = 0
                hit = self.docs[a:b][near] == chosen
                scores[hit] += weight * self.factors[a:b][near[hit]]
            good = scores >= best.least()
            best.add(scores[good], self.ids[chosen[good]], self.unnamed[chosen[good]])
            done, at, step = int(ends[until - 1]), until, 2 * step


def _shards(batches: Iterator[pa.RecordBatch], facts: tuple[int, int]) -> Iterator[Shard]:
    """Documents of a task in shards of bounded size."""
    parts, docs, postings = [], 0, 0

    def shard() -> Shard:
        rows = pa.Table.from_batches(parts).combine_chunks()
        terms, times = (rows.column(c).combine_chunks() for c in ("terms", "times"))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))])
        flat = [np.asarray(c.flatten()) for c in (terms, times)]
        return Shard(rows.column("doc_id").combine_chunks(), rows.column("n").to_numpy(), *flat, ends, facts)

    for batch in batches:
        for start in range(0, batch.num_rows, SHARD_DOCS):
            piece = batch.slice(start, SHARD_DOCS)
            held = len(piece.column("terms").flatten())
            if parts and (docs + piece.num_rows > SHARD_DOCS or postings + held > SHARD_POSTINGS):
                yield shard()
                parts, docs, postings = [], 0, 0
            parts.append(piece)
            docs, postings = docs + piece.num_rows, postings + held
    if parts:
        yield shard()


def _group_ranks(spark: SparkSession, docs: DataFrame, group: DataFrame, k: int) -> DataFrame | None:
    """Ranks of a group of items; None if it has none."""
    items = group.orderBy("item_id").collect()  # GROUP_TERMS rows of terms, and what one item has beyond
    vocabulary = sorted({row["term"] for item in items for row in item["terms"]})
    if not vocabulary:
        return None
    table = counted(docs, vocabulary)
    documents, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(table.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = {t: int(np.floor(1000 * np.log((2 * documents + 2) / (2 * held + 1)))) for t, held in df.items()}
    place = {term: number for number, term in enumerate(vocabulary)}
    asked = []
    for item in items:
        codes = [(place[row["term"]], row["times"]) for row in item["terms"]]
        asked.append([(t, times * weight[t]) for t, times in codes if weight.get(t, 0) > 0])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for shard in _shards(batches, (documents, total)):
            for terms, found in zip(asked, best):
                shard.search(terms, found)
        for number, found in enumerate(best):
            ids = pa.array(found.ids, pa.int64(), mask=found.unnamed)
            columns = [pa.array(np.full(len(ids), number), pa.int32()), ids, pa.array(found.scores)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    found = table.mapInArrow(search, FOUND)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # However many tasks there are, a window gets the k best of an item from each of SALTS parts.
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    for keys in (["item", "salt"], ["item"]):
        placed = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn("rank", placed).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(n, item["item_id"]) for n, item in enumerate(items)], "item int, item_id long")
    return salted.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    spark, out = docs.sparkSession, None
    for group in item_groups(items.withColumn("item_id", F.col("item_id").cast("long"))):
        found = _group_ranks(spark, docs, group, k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def ranked_query(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


RANKED_SQL = rf"""
WITH terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY item_id, term),
sized AS (SELECT row, doc_id, count(*) AS n FROM terms GROUP BY row, doc_id),
totals AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM sized),
held AS (
  SELECT row, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, totals GROUP BY term),
factors AS (
  SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * documents) // total)) AS factor
  FROM held JOIN sized USING (row), totals),
scored AS (
  SELECT item_id, row, doc_id, CAST(sum(times * w * factor) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN factors USING (term) GROUP BY item_id, row, doc_id),
placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 20"""
