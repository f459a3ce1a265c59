"""Near duplicates by BagMinHash signatures, bands, and exact overlap of shingle bags.

Texts are lower-cased and cut into words of letters and digits; a bag holds the shingles of five words with
their numbers of occurrences. Equal texts become one node. A signature of `bands` x `rows` components puts
each node in one bucket for each band; two texts of similarity 0.8 share none of 20 buckets of 5 rows with a
probability of 0.0004. Links are pairs with an exact weighted Jaccard similarity of at least `threshold`,
and classes are the connected components of links.

No bucket is expanded into all its pairs:

1. Every member of a bucket meets the bucket's leader, the member that shares most buckets with others
   (among copies of one text, the text itself).
2. Of buckets with at most `small` members, the pairs whose components still differ are compared.
3. In larger ones the overlap of x and y is at most min(|x & L|, |y & L|) plus what the two share beyond
   their leader L, in shingles that L has not (or has less often). So a pair whose components differ can
   only be linked if it shares enough beyond the leader: each member is looked up by the rarest of these
   shingles, as many as make it impossible to share enough without one of them, and a pair that meets at
   one of them, the rarest it shares, can share no more than either has from there on. Or, if it shares nothing
   there, if the overlaps with L alone are large enough for its sizes, which are looked up. All other
   pairs are settled unseen.

Defined results: a null text is a class of its own; texts without words are in one class only with equal
ones; equal rows share a class; a text of fewer than five words is a single shingle; an empty table gives
an empty table; other columns are ignored. The class id is the smallest doc_id of the class.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.bag_minhash import bags, band_hashes, shingle_hashes, signatures
from footfall.llm.common import documents, hash_strings, hashed_words, mix64, slices, stored
from footfall.llm.components import components

BANDS, ROWS, THRESHOLD, SMALL = 20, 5, 0.8, 32


def text_keys(texts: pa.Array, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit keys of the word sequences; of the characters where there are no words."""
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes + mix64(place)), dtype=np.uint64)])
    keys = mix64(sums[bounds[1:]] - sums[bounds[:-1]])
    wordless = np.diff(bounds) == 0
    keys[wordless] = mix64(hash_strings(pc.fill_null(texts, "")) + np.uint64(1))[wordless]
    return keys.view(np.int64)


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, node, buckets (none without shingles) of every non-null text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            hashes, bounds = hashed_words(texts)
            bag = bags(*shingle_hashes(hashes, bounds))
            buckets = band_hashes(signatures(*bag, len(texts), bands * rows), rows)
            some = np.diff(bounds) > 0
            ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(buckets[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(text_keys(texts, hashes, bounds)), listed],
                ["doc_id", "node", "buckets"],
            )

    rows_in = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    return rows_in.mapInArrow(sketch, "doc_id long, node long, buckets array<long>")


def bag_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes, counts (binary) of the wanted nodes; `wanted` has node and one of its doc_ids."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            hashes, bounds = hashed_words(texts)
            owner, shingles, counts = bags(*shingle_hashes(hashes, bounds))
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            pairs = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(text_keys(texts, hashes, bounds)),
                    pa.array([shingles[a:b].tobytes() for a, b in pairs], pa.binary()),
                    pa.array([counts[a:b].astype(np.int32).tobytes() for a, b in pairs], pa.binary()),
                ],
                ["node", "hashes", "counts"],
            )

    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    chosen = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    # A node whose rows all lack an id is among these.
    chosen = chosen.unionByName(texts.filter(F.col("doc_id").isNull()))
    found = chosen.mapInArrow(collect, "node long, hashes binary, counts binary")
    return found.dropDuplicates(["node"]).join(wanted.select("node"), "node", "left_semi")


MEASURED = "a long, b long, shared long, size_a long, size_b long, similarity double, beyond array<struct<shingle: long, mass: int>>"


def beyond(hashes: np.ndarray, excess: np.ndarray) -> list[dict]:
    """Shingles with a positive excess."""
    more = excess > 0
    return [{"shingle": h, "mass": n} for h, n in zip(hashes[more].view(np.int64).tolist(), excess[more].tolist())]


def measure(pairs: DataFrame, bags_of: DataFrame) -> DataFrame:
    """Exact overlap of pairs (a, b, big); with `big` also the shingles that a has more often than b."""

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in ("a", "b", "shared", "size_a", "size_b", "similarity", "beyond")}
            columns = [batch.column(name).to_pylist() for name in ("a", "b", "big", "a_hashes", "a_counts", "b_hashes", "b_counts")]
            for a, b, big, ha, ca, hb, cb in zip(*columns):
                ha, hb = np.frombuffer(ha, np.uint64), np.frombuffer(hb, np.uint64)
                ca, cb = np.frombuffer(ca, np.int32), np.frombuffer(cb, np.int32)
                at = np.minimum(np.searchsorted(hb, ha), max(0, len(hb) - 1))
                in_b = np.where(hb[at] == ha, cb[at], 0) if len(hb) else np.zeros(len(ha), np.int32)
                shared, size_a, size_b = int(np.minimum(ca, in_b).sum()), int(ca.sum()), int(cb.sum())
                union = size_a + size_b - shared
                values = (a, b, shared, size_a, size_b, shared / union if union else 0.0, beyond(ha, ca - in_b) if big else [])
                for name, value in zip(out, values):
                    out[name].append(value)
            cells = pa.list_(pa.struct([("shingle", pa.int64()), ("mass", pa.int32())]))
            types = [pa.int64()] * 5 + [pa.float64(), cells]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    def side(name: str) -> DataFrame:
        return bags_of.select(F.col("node").alias(name), F.col("hashes").alias(f"{name}_hashes"), F.col("counts").alias(f"{name}_counts"))

    joined = pairs.select("a", "b", "big").join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(overlap, MEASURED)


def _labelled(table: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """The component of a node, itself where it has no link."""
    renamed = labels.select(F.col("node").alias(column), F.col("label").alias(name))
    return table.join(renamed, column, "left").withColumn(name, F.coalesce(name, column))


def _main_labels(table: DataFrame, keys: list[str]) -> DataFrame:
    """The largest component of each group (`main`), and how many components it holds.

    Pairs of different components have at least one member outside the largest, so joins leave out pairs inside it.
    """
    each = table.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    groups = each.groupBy(*keys).agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("_most"))
    return groups.select(*keys, "labels", F.col("_most.label").alias("main"))


def near_duplicate_links(docs: DataFrame, sketched: DataFrame, threshold: float, small: int) -> DataFrame:
    """Links (a, b) between nodes whose components are those of all links within buckets."""
    nodes = sketched.filter(F.size("buckets") > 0).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("buckets").alias("buckets"))
    placed = nodes.select("node", "doc_id", F.explode("buckets").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    placed = stored(placed.join(stored(sizes, "sizes"), "bucket"), "placed")
    wanted = placed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.sum("size").alias("central"))
    wanted = stored(wanted, "wanted")
    bags_of = stored(bag_table(docs, wanted), "bags")

    members = placed.select("bucket", "node", "size").join(wanted.select("node", "central"), "node")
    leaders = members.groupBy("bucket").agg(F.max(F.struct("central", "node")).alias("_most"))
    leaders = stored(leaders.select("bucket", F.col("_most.node").alias("leader")), "leaders")
    members = stored(members.join(leaders, "bucket"), "members")
    star = members.filter(F.col("node") != F.col("leader")).groupBy(F.col("node").alias("a"), F.col("leader").alias("b"))
    met = stored(measure(star.agg(F.max(F.col("size") > small).alias("big")), bags_of), "met")
    links = met.filter(F.col("similarity") >= threshold).select("a", "b")
    labels = components(links)

    # Small buckets that still hold several components.
    few = _labelled(members.filter(F.col("size") <= small).select("bucket", "node"), labels, "node", "label")
    mixed = few.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    few = stored(few.join(mixed.filter(F.col("_low") != F.col("_high")).select("bucket"), "bucket", "left_semi"), "few")
    other = few.select("bucket", F.col("node").alias("b"), F.col("label").alias("label_b"))
    close = few.withColumnRenamed("node", "a").join(other, "bucket")
    close = close.filter((F.col("a") < F.col("b")) & (F.col("label") != F.col("label_b"))).select("a", "b")

    # Large buckets, by what their members have beyond the leader.
    large = members.filter(F.col("size") > small).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    known = met.join(large, ["a", "b"], "left_semi").select(F.col("a").alias("node"), F.col("b").alias("leader"), "shared", F.col("size_a").alias("size"), "similarity")
    known = stored(_labelled(known, labels, "node", "label"), "known")
    above = known.join(met.select(F.col("a").alias("node"), F.col("b").alias("leader"), "beyond"), ["node", "leader"])
    above = above.withColumn("cell", F.explode("beyond")).withColumn("needed", F.ceil(F.col("size") * threshold - 1e-6) - F.col("shared"))
    above = stored(above.select("leader", "node", "label", "shared", "size", "needed", "cell.shingle", "cell.mass"), "above")
    # A shingle that only one member has is common to no pair; the others come first in the order of commonness.
    frequency = above.groupBy("leader", "shingle").agg(F.count("*").alias("members")).filter(F.col("members") > 1)
    common_last = Window.partitionBy("leader", "node").orderBy(F.desc("members"), "shingle")
    above = above.join(frequency, ["leader", "shingle"]).withColumn("tail", F.sum("mass").over(common_last))
    above = above.filter(F.col("tail") >= F.greatest(F.col("needed"), F.lit(1)))
    rare = stored(above.select("leader", "shingle", F.col("node").alias("a"), "label", "shared", "size", "tail"), "rare")
    mixed = _main_labels(rare, ["leader", "shingle"]).filter(F.col("labels") > 1).drop("labels")
    all_rare = stored(rare.join(mixed, ["leader", "shingle"]), "mixed")
    one = all_rare.filter(F.col("label") != F.col("main"))
    two = all_rare.drop("main").select("leader", "shingle", *[F.col(c).alias(f"{c}_b") for c in ("label", "shared", "size", "tail")], F.col("a").alias("b"))
    most_shared = F.least("tail", "tail_b") + F.least("shared", "shared_b")
    reachable = most_shared + 1e-6 >= (F.col("size") + F.col("size_b")) * (threshold / (1 + threshold))
    once = (F.col("label_b") == F.col("main")) | (F.col("a") < F.col("b"))
    shared_beyond = one.join(two, ["leader", "shingle"]).filter((F.col("label") != F.col("label_b")) & once & reachable)
    # Without a shared shingle beyond the leader: shared(x, y) <= shared(x, L), so size(y) is bounded. Both
    # bounds are within 1 / threshold of size(x), so that they lie in neighbouring classes of size.
    step = np.log(1 / threshold)
    most = F.floor(F.col("shared") * ((1 + threshold) / threshold) - F.col("size") + 1e-6)
    least = F.ceil(F.col("size") * threshold - 1e-6)
    classes = F.sequence(F.floor(F.log(F.greatest(F.lit(1), least)) / step - 1e-9), F.floor(F.log(most) / step + 1e-9))
    place = F.floor(F.log("size") / step).alias("class")
    sized = known.select("leader", F.col("node").alias("b"), "size", F.col("label").alias("label_b"), "shared", place)
    mains = stored(_main_labels(sized.withColumnRenamed("label_b", "label"), ["leader", "class"]).drop("labels"), "mains")
    sized = sized.join(mains, ["leader", "class"]).withColumn("inside", F.col("label_b") == F.col("main")).drop("main")
    bounds = [least.alias("_least"), most.alias("_most"), F.explode(classes).alias("class")]
    loose = known.filter((F.col("similarity") < threshold) & (least <= most) & (most > 0))
    loose = loose.select("leader", F.col("node").alias("a"), "label", F.col("size").alias("_size"), *bounds)
    # A member of the largest component meets only the others of the class.
    meets = F.when(F.col("label") == F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    loose = loose.join(mains, ["leader", "class"]).withColumn("inside", F.explode(meets)).drop("main")
    enough = F.col("shared") + 1e-6 >= (F.col("_size") + F.col("size")) * (threshold / (1 + threshold))
    fits = F.col("size").between(F.col("_least"), F.col("_most")) & enough & (F.col("label") != F.col("label_b"))
    within = loose.join(sized, ["leader", "class", "inside"]).filter(fits)

    pairs = close.union(shared_beyond.select("a", "b")).union(within.select("a", "b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("big", F.lit(False))
    further = measure(pairs, bags_of).filter(F.col("similarity") >= threshold).select("a", "b")
    return links.union(stored(further, "further"))


def near_duplicates(
    docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, small: int = SMALL
) -> DataFrame:
    """doc_id, class_id of every row."""
    sketched = stored(sketches(docs, bands, rows), "sketch")
    labels = components(near_duplicate_links(docs, sketched, threshold, small))
    known = _labelled(sketched.select("doc_id", "node"), labels, "node", "label")
    least = stored(known.groupBy("label").agg(F.min("doc_id").alias("class_id")), "classes")
    classed = known.join(least, "label").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    alone = docs.filter(F.col("text").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    return classed.unionByName(alone.withColumn("class_id", F.col("doc_id")))


def near_dup_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
