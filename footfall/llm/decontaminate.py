"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling tables, edit distance.

The CGK embedding walks over a string: in step j it outputs the current symbol and moves on if a random bit
of (j, symbol) is 1. Two strings a few edits apart soon walk in step again, so their edit distance turns
into a Hamming distance of the outputs. Symbols here are words of letters and digits in lower case.

Items are grouped by length: those of 4 * 2^k - 1 words or more, for k up to 2, use windows of 3 * 2^k words,
taken from documents at every 2^k-th word and from items at every word, so that each occurrence of an item
holds a document window that starts at one of the item's own. Windows of longer items stay that short: the more
words an item has, the more of its windows have few edits, and one is enough. All windows are embedded `walks`
times; each embedding has `tables` tables, whose keys are samples of the steps. A document window that shares a
key with an item window is a candidate place of the item. Where enough of the item's words are near, the least
number of word edits between the whole item and any stretch of the document is computed exactly, and the item
of n words is found if it is at most `edits` * n.

The embedding is part of one pass over the documents without any shuffle. The benchmark is sent to the
tasks in groups of at most MAX_GROUP_WORDS words, in as many passes as it takes.

Defined results: null texts, items of fewer than 3 words and null items match nothing; repeated documents
are matched each, repeated items are found under each item_id; an empty table gives an empty table; other
columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import documents, hashed_words, slices

WALKS, TABLES, SAMPLES, EDITS = 5, 4, 6, 0.2
LONGEST_CLASS = 2
MAX_GROUP_WORDS = 2_000_000
# Marks of the keys that occur: small enough for the tables of all walks to stay in a core's cache.
_FILTER_BITS = 19
MATCH = "doc_id long, item_id long, edits int, first_word long, words int"


def size_class(words: int) -> int:
    """The largest k with 4 * 2^k - 1 <= words, LONGEST_CLASS at most."""
    return min(LONGEST_CLASS, ((words + 1) // 4).bit_length() - 1)


def place_step(words: int, edits: float) -> int:
    """Windows of an item that look alike count once in so many words; places are exact up to it."""
    return max(1, int(edits * words) // 4)


def sampled_steps(k: int, walk: int) -> tuple[int, int, list[np.ndarray]]:
    """Half-way step, last step, and the steps each table of a walk looks at, as many from either half.

    A walk takes one and a half steps per window word, so that it rarely leaves the window.
    """
    steps = max(2, 9 * 2**k // 2)
    half, count = steps // 2, SAMPLES // 2
    random = np.random.default_rng(1000 * k + walk)
    pick = lambda a, b: random.choice(np.arange(a, b), min(count, b - a), replace=False)
    tables = [np.sort(np.concatenate([pick(0, half), pick(half, steps)])) for _ in range(TABLES)]
    return half, max(int(t[-1]) for t in tables) + 1, tables


def _mix32(x: np.ndarray) -> np.ndarray:
    """A 32-bit finalizer."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


class Walk:
    """One embedding of all windows of a stream of symbols."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, k: int, walk: int):
        self.half, self.last, self.tables = sampled_steps(k, walk)
        self.padded = np.concatenate([symbols, np.zeros(self.last + 1, np.uint32)])
        self.place = starts.astype(np.int32 if len(self.padded) < 1 << 31 else np.int64)
        self.keys = [np.zeros(len(starts), np.uint32) for _ in self.tables]
        self.seed, self.block = walk + 1, -1

    def go(self, first: int, last: int) -> None:
        for step in range(first, last):
            if step // 32 != self.block:
                self.block = step // 32
                self.bits = _mix32(self.padded + np.uint32((self.seed + 100 * self.block) * 0x9E3779B9 % (1 << 32)))
            symbol = self.bits[self.place]
            for table, steps in enumerate(self.tables):
                if step in steps:
                    self.keys[table] *= np.uint32(0x9E3779B1)
                    self.keys[table] += symbol
            symbol >>= np.uint32(step % 32)
            symbol &= np.uint32(1)
            self.place += symbol.astype(self.place.dtype)

    def keep(self, chosen: np.ndarray) -> None:
        self.place = self.place[chosen]
        self.keys = [keys[chosen] for keys in self.keys]


class Tables:
    """Window keys of the items of one size class."""

    def __init__(self, k: int, items: list[np.ndarray], numbers: list[int], edits: float = EDITS):
        self.k = k
        window = 3 * 2**k
        gap = np.zeros(window * 2, np.uint32)
        stream = np.concatenate([part for words in items for part in (words, gap)])
        begins = np.cumsum([0] + [len(words) + len(gap) for words in items])
        places = [np.arange(len(words) - window + 1) for words in items]
        self.owner = np.concatenate([np.full(len(at), n) for n, at in zip(numbers, places)])
        self.offset = np.concatenate(places)
        part = np.concatenate([at // place_step(len(words), edits) for words, at in zip(items, places)])
        starts = np.concatenate([b + at for b, at in zip(begins, places)])
        self.walks = []
        for number in range(WALKS):
            walk = Walk(stream, starts, k, number)
            walk.go(0, walk.half)
            halves = [self._marks(_mix32(keys)) for keys in walk.keys]
            walk.go(walk.half, walk.last)
            tables = []
            for keys in map(_mix32, walk.keys):
                order = np.argsort(keys, kind="stable")
                # An item that repeats itself has the same window many times: first of each part only.
                new = np.ones(len(order), bool)
                new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (keys, self.owner, part)], axis=0)
                order = order[new]
                tables.append((keys[order], order, self._marks(keys)))
            self.walks.append((halves, tables))

    @staticmethod
    def _marks(keys: np.ndarray) -> np.ndarray:
        marks = np.zeros(1 << _FILTER_BITS, bool)
        marks[keys >> np.uint32(32 - _FILTER_BITS)] = True
        return marks

    def candidates(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (document, item, first word) at which an item may begin.

        A window goes on to the second half of a walk only where some table knows its first half.
        """
        stride, window = 2**self.k, 3 * 2**self.k
        counts = np.maximum(0, (np.diff(bounds) - window) // stride + 1)
        document = np.repeat(np.arange(len(counts)), counts)
        number = np.arange(len(document)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = bounds[:-1][document] + number * stride
        found = []
        shift = np.uint32(32 - _FILTER_BITS)
        for walk_number, (halves, tables) in enumerate(self.walks):
            walk = Walk(symbols, starts, self.k, walk_number)
            walk.go(0, walk.half)
            known = np.zeros(len(starts), bool)
            for keys, marks in zip(walk.keys, halves):
                known |= marks[_mix32(keys) >> shift]
            left = np.flatnonzero(known)
            walk.keep(left)
            walk.go(walk.half, walk.last)
            for keys, (ordered, order, marks) in zip(map(_mix32, walk.keys), tables):
                at = np.flatnonzero(marks[keys >> shift])
                low, high = np.searchsorted(ordered, keys[at], "left"), np.searchsorted(ordered, keys[at], "right")
                at, low, high = left[at[high > low]], low[high > low], high[high > low]
                which = np.repeat(np.arange(len(at)), high - low)
                entry = order[np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[which]]
                where = number[at][which] * stride - self.offset[entry]
                found.append(np.column_stack([document[at][which], self.owner[entry], where]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def symbols_of(hashes: np.ndarray) -> np.ndarray:
    """Words as 32-bit symbols; what they are mistaken for, the exact comparison drops."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def least_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between the item and any stretch of the text: (edits, first word, words)."""
    n = len(text)
    place = np.arange(n + 1)
    cost, begin = np.zeros(n + 1, np.int64), place.copy()
    for k, word in enumerate(item, 1):
        change = np.concatenate([[k], cost[:-1] + (text != word)])
        drop = cost + 1
        best = np.minimum(change, drop)
        start = np.where(change <= drop, np.concatenate([[0], begin[:-1]]), begin)
        # Extra words of the text: the least of best[i] + (j - i) over i <= j, and where it is reached.
        level = (best - place) * (n + 2) - place
        reached = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == reached, place, 0))
        cost, begin = best[source] + place - source, start[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end - int(begin[end])


def missing_words(item: np.ndarray, text: np.ndarray) -> int:
    """How many of the item's words the text does not hold: no stretch of it has fewer edits."""
    words, counts = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(words, text), len(words) - 1)
    held = np.bincount(at[words[at] == text], minlength=len(words))
    return len(item) - int(np.minimum(held, counts).sum())


def best_match(item: np.ndarray, text: np.ndarray, places: np.ndarray, allowed: int, step: int = 1) -> tuple[int, int, int] | None:
    """The best of an item's candidate places, which are up to step - 1 too far right; the first of equals."""
    best, done = None, -1
    for place in np.sort(places):
        low, high = max(0, int(place) - allowed - step + 1), min(len(text), int(place) + len(item) + 2 * allowed)
        if low < done and int(place) + len(item) + allowed <= done:
            continue  # the stretch is inside one that was looked at
        exact = text[max(0, int(place)) : max(0, int(place)) + len(item)]
        if len(exact) == len(item) and (exact == item).all():
            return 0, max(0, int(place)), len(item)
        done = high
        if missing_words(item, text[low:high]) > allowed:
            continue
        edits, first, words = least_edits(item, text[low:high])
        if edits <= allowed and (best is None or edits < best[0]):
            best = (edits, low + first, words)
    return best


def item_groups(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items (id, text) in groups of bounded size; a group is read by the driver when its turn comes."""
    items = benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    sized = items.withColumn("_words", F.size(F.split("text", r"\s+")))
    total = sized.agg(F.sum("_words")).first()[0] or 0
    groups = max(1, -(-total // MAX_GROUP_WORDS))
    for group in range(groups):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group).collect()
        yield sorted((row["item_id"], row["text"]) for row in rows)


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, edits, first_word, words: the best match of every item found in a document."""
    found = [_group_matches(docs, items, edits) for items in item_groups(benchmark)]
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    return union


def _group_matches(docs: DataFrame, items: list[tuple[int, str]], edits: float) -> DataFrame:
    ids = [item_id for item_id, _ in items]
    hashes, bounds = hashed_words(pa.array([text for _, text in items], pa.string()))
    words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    by_class: dict[int, list[int]] = {}
    for number, item in enumerate(words):
        if len(item) >= 3:
            by_class.setdefault(size_class(len(item)), []).append(number)
    shared = docs.sparkSession.sparkContext.broadcast((ids, words, by_class))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, by_class = shared.value
        tables = [Tables(k, [symbols_of(words[n]) for n in numbers], numbers, edits) for k, numbers in sorted(by_class.items())]
        for batch in slices(batches):
            hashes, bounds = hashed_words(batch.column("text"))
            symbols = symbols_of(hashes)
            doc_ids = batch.column("doc_id").to_pylist()
            out = []
            for table in tables:
                places = table.candidates(symbols, bounds)
                cuts = np.flatnonzero(np.any(places[1:, :2] != places[:-1, :2], axis=1)) + 1 if len(places) else []
                for group in np.split(places, cuts) if len(places) else []:
                    document, number = int(group[0, 0]), int(group[0, 1])
                    item, text = words[number], hashes[bounds[document] : bounds[document + 1]]
                    match = best_match(item, text, group[:, 2], int(edits * len(item)), place_step(len(item), edits))
                    if match:
                        out.append((doc_ids[document], ids[number], *match))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            names = [field.split()[0] for field in MATCH.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return docs.select("doc_id", "text").mapInArrow(search, MATCH)


def decontaminate_query(spark, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
