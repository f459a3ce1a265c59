"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are the words between ASCII white space, A-Z lower-cased, and one end for each text. The model has
two levels of Chinese restaurants. Every token seen before another (the end stands before a text's first
word) has a restaurant for what follows it; their parent, which all share, is the restaurant of the empty
history, whose word comes after a token never seen. Its base is uniform over the distinct training tokens and
one unknown. Each table of a restaurant is a customer of the parent. With `contexts` given, only that many
most frequent tokens have restaurants, and what follows others sits at the parent directly.

Seating is sampled by blocked Gibbs sweeps: in a sweep all customers of a dish leave a restaurant and are
seated again one after the other, at a new table with a probability that depends on the parent's predictive
probability of the dish and the tables of all other dishes, as of the sweep before. Given those totals,
cells (a context and a token that followed it) are independent, so a sweep is a pass over the cells. Cells lie
in blocks, whose number follows the size of the text: a block has all cells of its words, in packed columns.
What concerns a word is known in its block. What concerns a context is summed over the blocks in parts of the
contexts, each block sending one sum for a context, and comes back to the blocks that asked. Only the parent's
totals go through the driver. A cell seen once has one table in every sweep and is not seated again.
Draws are hashes of dish, restaurant, sweep and customer: a task that runs again seats as before. With
`contexts` given, cells are lists of their dish and sweeps are recomputed instead of stored. Customers beyond
the EXACT-th of a dish arrive in blocks of growing size, each with the tables at its
start. Discounts are estimated from the numbers of tokens seen once and twice, the strength of the
context restaurants by leave-one-out likelihood. Predictive probabilities are averaged over the sweeps after
burn-in.

Counts cover all training text and combine in each task before they are shuffled. Scoring reads each text
against the `head` most frequent cells (tokens, with `contexts` given), whose table has a fixed size; the
others meet the rest in their block (in a join, with `contexts` given): a training text's cell that was not seen
more than once was seen once, only for held-out cells that is looked up. A text's sums over the blocks are added
in parts of the texts. Texts are scored in PASSES passes of as many texts each, so that less lies on disk at a
time. Tokens and cells are known by 64-bit hashes. Rows that are not held out are the training text.

Defined results: a null text is empty, which is its end alone; rows that agree in doc_id and words score
alike, and each gives a row; without training text every token is unknown; an empty table gives an empty
table; other columns are ignored; a null doc_id belongs to the training text.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import codes_of, documents, fold, forget, hash_strings, mix64, slices, stored, stored_alone, words_of

HEAD, HEAD_CELLS, BURN_IN, SAMPLES = 65_536, 524_288, 1, 3
EXACT, GROWTH = 64, 1.15
HELD_ENTRIES = 2_000_000
BLOCK_BYTES, PASSES = 8_000_000, 2
PLACES, SUMS = {"place", "at", "kinds"}, {"base", "score", "text_base", "text_score"}
END = int(hash_strings(pa.array([""])).view(np.int64)[0])
_STEP = 0x9E3779B97F4A7C15


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token codes of all texts, hashes by code, and where each text's tokens begin; code 0 is the end."""
    words, bounds = words_of(texts)
    codes, distinct = codes_of(words)
    # Lower-cased as distinct words: ascii_lower reads a cast slice of an array from the wrong place.
    lowered, distinct = codes_of(pc.ascii_lower(distinct))
    codes = lowered[codes]
    hashes = np.concatenate([[END], hash_strings(distinct).view(np.int64)]).astype(np.int64)
    bounds = bounds + np.arange(len(bounds))
    out = np.zeros(len(words) + len(texts), np.int64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = codes.astype(np.int64) + 1
    return out, hashes, bounds


def contexts_of(codes: np.ndarray, hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Number of each token's context, by the token before it; len(frequent) where it is not a frequent one."""
    sorter = np.argsort(frequent)
    at = np.minimum(np.searchsorted(frequent, hashes, sorter=sorter), max(0, len(frequent) - 1))
    number = np.where(frequent[sorter[at]] == hashes, sorter[at], len(frequent)) if len(frequent) else np.zeros(len(hashes), np.int64)
    # The token before a text's first is the end of the text before it, code 0.
    return number[np.concatenate([[0], codes[:-1]])] if len(codes) else codes


class Counts:
    """Numbers of (token, context) pairs, combined while a task reads; handed on when there are many."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, token: np.ndarray, context: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((token, context, n))
        self.size += len(token)

    def take(self, kind: type = np.int32) -> pa.RecordBatch:
        token, context, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((context, token))
        token, context, n = token[order], context[order], n[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (context[1:] != context[:-1])
        at = np.flatnonzero(new)
        self.parts, self.size = [], 0
        sums = np.add.reduceat(n, at) if len(at) else n
        arrays = [pa.array(token[at]), pa.array(context[at].astype(kind)), pa.array(sums)]
        return pa.RecordBatch.from_arrays(arrays, ["token", "context", "n"])


def pair_counts(texts: DataFrame, frequent: list[int] | None) -> DataFrame:
    """(token, context, n), several rows for a pair; without `frequent` all contexts are 0."""
    chosen = np.array(frequent or [], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for batch in slices(batches):
            codes, hashes, _ = tokens(batch.column("text"))
            kinds = len(chosen) + 1
            context = contexts_of(codes, hashes, chosen) if len(chosen) else np.zeros(len(codes), np.int64)
            keys, n = np.unique(codes * kinds + context, return_counts=True)
            held.add(hashes[keys // kinds], keys % kinds, n.astype(np.int64))
            if held.size > HELD_ENTRIES:
                yield held.take()
        if held.size:
            yield held.take()

    return texts.select("text").mapInArrow(count, "token long, context int, n long")


@dataclass
class Totals:
    """What a sweep needs to know of all dishes: tables of each context, customers and tables of the parent."""

    tables: np.ndarray
    customers: float
    parent_tables: float


@dataclass
class Restaurants:
    """Parameters, the sizes of the restaurants, and the totals after each sweep so far."""

    frequent: list[int]
    sizes: np.ndarray  # customers of each context restaurant
    distinct: int
    total: int
    discounts: tuple[float, float]  # contexts, parent
    strengths: tuple[float, float]
    totals: list[Totals] = field(default_factory=list)

    @property
    def base(self) -> float:
        return 1.0 / (self.distinct + 1)

    def parent_probability(self, customers, tables, totals: Totals):
        strength, discount = self.strengths[1], self.discounts[1]
        return (customers - discount * tables + (strength + discount * totals.parent_tables) * self.base) / (
            strength + totals.customers
        )

    def passed_on(self, totals: Totals) -> np.ndarray:
        """The share of each context restaurant's probability that its parent distributes."""
        return (self.strengths[0] + self.discounts[0] * totals.tables) / (self.strengths[0] + self.sizes)


def seat(n: np.ndarray, new: np.ndarray, probability: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables of n customers of one dish, seated one after the other.

    `new` is the weight of a new table besides `discount` for each table of this dish; `probability` is what
    the parent gives the dish.
    """
    tables = (n > 0).astype(np.float64)
    at = np.flatnonzero(n > 1)
    seated, draw = 1, 0
    while len(at):
        block = 1 if seated < EXACT else int(seated * (GROWTH - 1))
        t = tables[at]
        open_weight = (new[at] + discount * t) * probability[at]
        chance = open_weight / (open_weight + np.maximum(seated + (block - 1) / 2 - discount * t, 1e-12))
        draw += 1
        bits = mix64(key[at] + np.uint64(draw * _STEP % (1 << 64)))
        uniform = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        if block == 1:
            tables[at] += uniform < chance
        else:
            arriving = np.minimum(block, n[at] - seated)
            other = ((mix64(bits) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            tables[at] += np.minimum(arrivals(arriving * chance, uniform, other), arriving)
        seated += block
        at = at[n[at] > seated]
    return tables


def arrivals(mean: np.ndarray, uniform: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion; normal ones where the mean is above 20."""
    drawn = np.zeros(len(mean))
    term = np.exp(-np.minimum(mean, 20.0))
    left = uniform - term
    for k in range(1, 80):
        more = (left > 0) & (mean <= 20)
        if not more.any():
            break
        drawn += more
        term = term * mean / k
        left = left - term
    normal = np.sqrt(-2 * np.log(uniform)) * np.cos(2 * np.pi * other)
    return np.where(mean <= 20, drawn, np.maximum(np.floor(mean + normal * np.sqrt(mean) + 0.5), 0))


class Dishes:
    """The customers of some dishes, a row for each dish and a cell for each of its contexts."""

    def __init__(self, batch: pa.RecordBatch, model: Restaurants):
        self.token = batch.column("token").to_numpy(zero_copy_only=False)
        lists = batch.column("cells")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        context = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(self.token)), counts)
        self.count = np.bincount(row, n, len(self.token))
        own = context < len(model.frequent)
        self.direct = np.bincount(row[~own], n[~own], len(self.token))
        self.row, self.context, self.n = row[own], context[own], n[own]
        self.model = model
        # Before the first sweep every dish has one table.
        self.tables = np.ones(len(self.n))
        self.customers = self.direct + np.bincount(self.row, self.tables, len(self.token))
        self.parent_tables = (self.customers > 0).astype(np.float64)

    def sweep(self, number: int, totals: Totals) -> None:
        model, row, context = self.model, self.row, self.context
        key = mix64(self.token.view(np.uint64) + np.uint64(number))
        probability = model.parent_probability(self.customers, self.parent_tables, totals)
        new = model.strengths[0] + model.discounts[0] * np.maximum(totals.tables[context] - self.tables, 0)
        self.tables = seat(self.n, new, probability[row], model.discounts[0], mix64(key[row] + context.astype(np.uint64) + np.uint64(1)))
        self.customers = self.direct + np.bincount(row, self.tables, len(self.token))
        new = model.strengths[1] + model.discounts[1] * np.maximum(totals.parent_tables - self.parent_tables, 0)
        base = np.full(len(self.token), model.base)
        self.parent_tables = seat(self.customers.astype(np.int64), new, base, model.discounts[1], key)

    def totals(self) -> Totals:
        tables = np.bincount(self.context, self.tables, len(self.model.frequent))
        return Totals(tables, float(self.customers.sum()), float(self.parent_tables.sum()))


def swept(dishes: DataFrame, model: Restaurants) -> Totals:
    """Totals after the sweeps that `model` has totals for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, customers, parents = np.zeros(len(model.frequent)), 0.0, 0.0
        for batch in batches:
            rows = Dishes(batch, model)
            for number, totals in enumerate(model.totals):
                rows.sweep(number, totals)
            found = rows.totals()
            tables, customers, parents = tables + found.tables, customers + found.customers, parents + found.parent_tables
        values = np.concatenate([tables, [customers, parents]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["k", "value"])

    sums = dishes.mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(len(model.frequent) + 2)
    for row in sums:
        values[row["k"]] = row["value"]
    return Totals(values[:-2], values[-2], values[-1])


def discount(once: float, twice: float) -> float:
    """Of how much each count is lowered, from the numbers of things seen once and twice."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


def context_strength(dishes: DataFrame, model: Restaurants, grid: list[float]) -> float:
    """The strength under which the context restaurants best predict each customer from the others."""

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(grid))
        distinct = model.totals[0].tables
        for batch in batches:
            rows = Dishes(batch, model)
            parent = rows.count[rows.row] / model.total
            rest = rows.n - 1 - model.discounts[0] * (rows.n > 1)
            for k, strength in enumerate(grid):
                passed = (strength + model.discounts[0] * distinct[rows.context]) * parent
                chance = (rest + passed) / (strength + np.maximum(model.sizes[rows.context] - 1, 1))
                sums[k] += (rows.n * np.log(np.maximum(chance, 1e-300))).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid), dtype=np.int32)), pa.array(sums)], ["k", "value"])

    found = dishes.mapInArrow(likelihood, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    best = max(found, key=lambda row: (row["value"], -row["k"]), default=None)
    return grid[best["k"]] if best else grid[0]


def cell_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """64-bit keys of cells; the same as `cell_key` of columns."""
    turned = context.view(np.uint64)
    turned = (turned << np.uint64(23)) | (turned >> np.uint64(41))
    return (turned ^ token.view(np.uint64)).view(np.int64)


def place_of(codes: np.ndarray, places: int) -> np.ndarray:
    """The number, below `places`, of the block or part that a token's code belongs to; it rises with the unsigned code."""
    return ((codes.view(np.uint64) >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int32)


def kind_of(name: str) -> type:
    """What a packed column holds: 32-bit places, weights and sums as doubles, otherwise 64-bit numbers."""
    return np.int32 if name in PLACES else np.float64 if name in SUMS or name.endswith("_weight") else np.int64


def binary(names: list[str]) -> str:
    return ", ".join(f"{c} binary" for c in names)


def packed(number: np.ndarray, name: str, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each run of equal numbers, with the columns' values there packed as bytes."""
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
    ends = np.append(starts, len(number))
    arrays = []
    for column, values in columns.items():
        values = np.ascontiguousarray(values, kind_of(column))
        offsets = pa.py_buffer((ends * values.itemsize).astype(np.int32))
        arrays.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(values)]))
    return pa.RecordBatch.from_arrays([pa.array(number[starts].astype(np.int32)), *arrays], [name, *columns])


def with_columns(rows: pa.RecordBatch, more: dict) -> pa.RecordBatch:
    """The rows with more columns, each of one value."""
    arrays = [pa.array([v] * rows.num_rows, pa.bool_() if isinstance(v, bool) else pa.int32()) for v in more.values()]
    return pa.RecordBatch.from_arrays([*rows.columns, *arrays], [*rows.schema.names, *more])


def one_row(values: dict) -> pa.Table:
    """A row of numbers and, from arrays, packed values."""
    arrays = [pa.array([np.ascontiguousarray(v, kind_of(c)).tobytes()] if isinstance(v, np.ndarray) else [v]) for c, v in values.items()]
    return pa.Table.from_arrays(arrays, [*values])


def listed(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """All values of a packed column, row after row."""
    column, kind = rows.column(name), kind_of(name)
    found = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        _, offsets, data = chunk.buffers()
        if data is not None and len(chunk):
            offsets = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            found.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind))
    return np.concatenate(found) if found else np.zeros(0, kind)


def block_number(rows: pa.Table | pa.RecordBatch) -> np.int32:
    return np.int32(rows.column("block")[0].as_py())


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1)


def found_in(values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in `order`, which rises, and whether it is there."""
    if not len(order):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    # Looked up in their own order: neighbours in `order` are in the processor's cache.
    by = np.argsort(values)
    at = np.empty(len(values), np.int64)
    at[by] = np.minimum(np.searchsorted(order, values[by]), len(order) - 1)
    return at, order[at] == values


def cell_batches(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """block and the token, context, n of every token by the hash of the token before it, combined while a task reads."""
    waiting, size = [], 0

    def rows() -> pa.RecordBatch:
        token, context, n = (np.concatenate(x) for x in zip(*waiting))
        # By the upper halves of both hashes: few other cells come between equal ones, which are added up later.
        order = np.argsort((token & ~0xFFFFFFFF).view(np.uint64) | (context.view(np.uint64) >> np.uint64(32)))
        token, context, n = token[order], context[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (context[1:] != context[:-1])]))
        columns = {"token": token[at], "context": context[at], "n": np.add.reduceat(n, at)}
        return packed(place_of(token[at], blocks), "block", columns)

    for batch in slices(batches):
        codes, hashes, _ = tokens(batch.column("text"))
        # The token before a text's first is the end of the text before it, code 0.
        keys, n = np.unique(np.concatenate([[0], codes[:-1]]) * len(hashes) + codes, return_counts=True)
        waiting.append((hashes[keys % len(hashes)], hashes[keys // len(hashes)], n))
        size += len(n)
        if size > HELD_ENTRIES:
            yield rows()
            waiting.clear()
            size = 0
    if waiting:
        yield rows()


CELL_NUMBERS = ["total", "words", "word_once", "word_twice", "cells", "once", "twice"]
CELLS = f"block int, {binary(['word', 'kinds', 'about', 'at', 'n'])}, {', '.join(f'{c} long' for c in CELL_NUMBERS)}"


def counted_blocks(texts: DataFrame, blocks: int) -> DataFrame:
    """All cells, a row for each block of words: its words, the number of cells of each, the block's contexts in order
    of the unsigned hash, and of each cell the place of its context and its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cell_batches(batches, blocks)

    def merge(rows: pa.Table) -> pa.Table:
        n = listed(rows, "n")
        word, place = np.unique(listed(rows, "token"), return_inverse=True)
        about, at = np.unique(listed(rows, "context").view(np.uint64), return_inverse=True)
        cell = place * len(about) + at
        order = np.argsort(cell)
        cell = cell[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        cell, n = cell[first], np.add.reduceat(n[order], first)
        place = cell // len(about)
        counts = np.bincount(place, n, len(word))
        row = {"block": block_number(rows), "word": word, "kinds": np.bincount(place, minlength=len(word))}
        row |= {"about": about.view(np.int64), "at": cell % len(about), "n": n}
        numbers = n.sum(), len(word), (counts == 1).sum(), (counts == 2).sum(), len(n), (n == 1).sum(), (n == 2).sum()
        return one_row(row | {c: int(v) for c, v in zip(CELL_NUMBERS, numbers)})

    found = texts.select("text").mapInArrow(count, f"block int, {binary(['token', 'context', 'n'])}")
    return found.groupBy("block").applyInArrow(merge, CELLS)


def flat(rows: DataFrame, names: list[str], values, schema: str) -> DataFrame:
    """A row for each value that `values` gives of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            found = values({c: listed(row, c) for c in names})
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in found.values()], [*found])

    return rows.select(*names).mapInArrow(run, schema)


def flat_cells(blocks: DataFrame) -> DataFrame:
    """context, token, n of blocks of cells."""

    def values(row: dict) -> dict:
        return {"context": row["about"][row["at"]], "token": np.repeat(row["word"], row["kinds"]), "n": row["n"]}

    return flat(blocks, ["word", "kinds", "about", "at", "n"], values, "context long, token long, n long")


def flat_often(state: DataFrame, kept: list[str]) -> DataFrame:
    """context, token, n and the kept tables of the cells seen more than once."""

    def values(row: dict) -> dict:
        found = {"context": row["about"][row["at"]], "token": row["word"][row["place"]], "n": row["n"]}
        return found | {c: row[c] for c in kept}

    schema = ", ".join(f"{c} long" for c in ["context", "token", "n", *kept])
    return flat(state, ["word", "place", "about", "at", "n", *kept], values, schema)


def questions(rows: DataFrame, names: list[str], values, asked: list[str], parts: int, answer: bool = True) -> DataFrame:
    """What each block knows of its contexts (about), for the parts that these belong to; `values` gives it by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            at = {c: listed(row, c) for c in ["about", *names]}
            found = dict(zip(asked, values(at), strict=True))
            sums = packed(place_of(at["about"], parts), "part", {"about": at["about"], **found})
            yield with_columns(sums, {"block": int(block_number(row)), "answer": answer})

    schema = f"part int, {binary(['about', *asked])}, block int, answer boolean"
    return rows.select("block", "about", *names).mapInArrow(run, schema)


def answered(asked: DataFrame, names: list[str]) -> DataFrame:
    """The sums of the contexts' values over all blocks, for the rows that ask for them: block, part, fact (contexts)
    and the sums. In order of part, a block's facts are in the order of its contexts."""

    def total(rows: pa.Table) -> pa.Table:
        about = listed(rows, "about")
        distinct, at = np.unique(about, return_inverse=True)
        lengths = pc.binary_length(rows.column("about")).to_numpy() // 8
        number = np.repeat(np.arange(len(lengths)), lengths)
        sums = {c: np.bincount(at, listed(rows, c), len(distinct))[at] for c in names}
        lists = packed(number, "row", {"fact": about, **sums})
        found = rows.select(["block", "part", "answer"]).take(pa.array(lists.column("row")))
        return pa.Table.from_arrays([*found.columns[:2], *lists.columns[1:]], ["block", "part", "fact", *names]).filter(found.column("answer"))

    return asked.groupBy("part").applyInArrow(total, f"block int, part int, {binary(['fact', *names])}")


def facts_in_order(rows: pa.Table, names: list[str]) -> list[np.ndarray]:
    rows = rows.select(["part", *names])
    rows = rows.filter(pc.is_valid(rows.column("part"))).sort_by("part")
    return [listed(rows, c) for c in names]


def in_block(*tables: DataFrame) -> DataFrame:
    """The rows of several tables, to be grouped by block."""
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table, allowMissingColumns=True)
    return found


STATE = ["word", "count", "ones", "parents", "place", "about", "at", "n", "others", "tables"]
GRID = [10.0**k for k in range(7)]
LIKELY = [f"likely_{k}" for k in range(len(GRID))]


def state_schema(kept: list[str]) -> str:
    """Words with count, cells seen once and tables at the parent; cells seen more than once with the places of their
    word and context, and tables; contexts with their cells seen once; of each sample the cells' tables and the words'
    weights."""
    names = [*STATE, *(c for k in kept for c in (k, f"{k}_weight"))]
    return f"block int, {binary(names)}, customers long, seats long, {', '.join(f'{c} double' for c in LIKELY)}"


def first_state(cells: DataFrame, blocks: int, total: int, lowered: float) -> DataFrame:
    """Before the first sweep every cell and word has one table.

    `likely_0` ... tell how well the context restaurants of each strength predict each customer of the block from the
    others. The customer of a cell seen once is predicted by its parent alone, whose share does not depend on
    the strength.
    """
    names = ["size", "kinds_all", "ones_all"]

    def known(row: dict) -> list[np.ndarray]:
        at, n, contexts = row["at"], row["n"], len(row["about"])
        return [np.bincount(at, n, contexts), np.bincount(at, minlength=contexts), np.bincount(at, n == 1, contexts)]

    def start(rows: pa.Table) -> pa.Table:
        word, kinds, about, at, n = (listed(rows, c) for c in ("word", "kinds", "about", "at", "n"))
        size, kinds_all, ones_all = facts_in_order(rows, names)
        place = np.repeat(np.arange(len(word)), kinds)
        count, ones = (np.bincount(place, v, len(word)).astype(np.int64) for v in (n, n == 1))
        several = n > 1
        single = np.bincount(at, ~several, len(about))
        others = np.maximum(size - 1, 1)
        place, at, n = place[several], at[several], n[several]
        share, likely = count[place] / float(total), []
        for strength in GRID:
            passed = strength + lowered * kinds_all
            chance = (n - 1 - lowered + passed[at] * share) / (strength + others[at])
            likely.append((single * (np.log(passed) - np.log(strength + others))).sum() + (n * np.log(np.maximum(chance, 1e-300))).sum())
        used, at = np.unique(at, return_inverse=True)
        row = {"block": block_number(rows), "word": word, "count": count, "ones": ones, "parents": np.ones(len(word))}
        row |= {"place": place, "about": about[used], "at": at, "n": n, "others": ones_all[used], "tables": np.ones(len(n))}
        return one_row(row | {"customers": int(kinds.sum()), "seats": len(word)} | {c: float(v) for c, v in zip(LIKELY, likely)})

    rows = cells.select("block", "word", "kinds", "about", "at", "n")
    answers = answered(questions(cells, ["at", "n"], known, names, blocks), names)
    return in_block(rows, answers).groupBy("block").applyInArrow(start, state_schema([]))


@dataclass
class AllRestaurants:
    """A restaurant for every seen context: numbers of the whole, blocks of cells, and the state of the sampling.

    `counted` has all cells, `state` those seen more than once with their tables, and the words; see `CELLS`
    and `state_schema`. Of both a row holds a block, the words whose hashes lie in one of `blocks` ranges.
    """

    counted: DataFrame
    state: DataFrame
    blocks: int
    distinct: int
    total: int
    samples: int
    discounts: tuple[float, float]  # contexts, parent
    strengths: tuple[float, float]
    totals: list[tuple[float, float]] = field(default_factory=list)  # customers and tables of the parent

    @property
    def base(self) -> float:
        return 1.0 / (self.distinct + 1)

    @property
    def kept(self) -> list[str]:
        return [f"kept_{k}" for k in range(self.samples)]

    @property
    def pairs(self) -> DataFrame:
        """context, token, n of every cell."""
        return flat_cells(self.counted)

    @property
    def cells(self) -> DataFrame:
        return flat_often(self.state, self.kept)

    @property
    def contexts(self) -> DataFrame:
        numbers = [F.count("*").alias("kinds"), F.count(F.when(F.col("n") == 1, 1)).alias("ones")]
        return self.pairs.groupBy("context").agg(F.sum("n").alias("size"), *numbers)

    def parent(self, weight, totals: tuple[float, float]):
        """The parent's probability of a token with `weight`, its customers less discounts."""
        customers, tables = totals
        return (weight + (self.strengths[1] + self.discounts[1] * tables) * self.base) / (self.strengths[1] + customers)

    def unknown(self) -> list[float]:
        return [float(self.parent(0.0, t)) for t in self.totals[-self.samples :]] if self.total else [1.0] * self.samples

    def by_token(self) -> DataFrame:
        """token, count, parent_0 ...: the parent's probability in each sample."""
        weights = [f"{c}_weight" for c in self.kept]
        names = ["word", "count", *weights]
        schema = "word long, count long, " + ", ".join(f"{c} double" for c in weights)
        rows = flat(self.state, names, dict, schema)
        parents = [self.parent(F.col(w), t).alias(f"parent_{k}") for k, (w, t) in enumerate(zip(weights, self.totals[-self.samples :]))]
        return rows.select(F.col("word").alias("token"), "count", *parents)

    def by_context(self) -> DataFrame:
        """context, scale, passed_0 ...: the share that the context's restaurant passes on in each sample."""
        sums = self.cells.groupBy("context").agg(*[F.sum(c).alias(c) for c in self.kept])
        scale = self.strengths[0] + F.col("size")
        tables = [F.col("ones") + F.coalesce(c, F.lit(0)) for c in self.kept]
        passed = [((self.strengths[0] + self.discounts[0] * t) / scale).alias(f"passed_{k}") for k, t in enumerate(tables)]
        return self.contexts.join(sums, "context", "left").select("context", scale.alias("scale"), *passed)

    def often(self) -> DataFrame:
        """context, token, n, own of the cells seen more than once; own / scale is what the restaurant gives itself."""
        tables = sum((F.col(c) for c in self.kept[1:]), F.col("kept_0"))
        return self.cells.select("context", "token", "n", (F.col("n") - self.discounts[0] * tables / self.samples).alias("own"))

    def once(self) -> DataFrame:
        return self.pairs.filter(F.col("n") == 1).select("context", "token", "n", F.lit(1.0 - self.discounts[0]).alias("own"))


def train_all(docs: DataFrame, burn_in: int, samples: int) -> AllRestaurants:
    """Restaurants for all contexts, sampled; the last `samples` totals belong to the samples."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(size) // BLOCK_BYTES
    cells = stored_alone(counted_blocks(docs, blocks), "cells")
    total, distinct, *few, kinds, once, twice = (x or 0 for x in cells.agg(*[F.sum(c) for c in CELL_NUMBERS]).first())
    lowered = discount(once, twice), discount(*few)
    state = stored_alone(first_state(cells, blocks, total, lowered[0]), "state")
    likely = [*state.agg(*[F.sum(c) for c in LIKELY]).first()]
    strengths = (GRID[likely.index(max(likely))] if total else 1.0), 1.0
    model = AllRestaurants(cells, state, blocks, distinct, total, samples, lowered, strengths, [(float(kinds), float(distinct))])
    kept: list[str] = []
    for number in range(burn_in + samples):
        name = f"kept_{number - burn_in}" if number >= burn_in else None
        last, model.state = model.state, stored_alone(seated(model, number, kept, name), "state")
        forget(last)
        if name:
            kept.append(name)
        sums = model.state.agg(F.sum("customers"), F.sum("seats")).first()
        model.totals.append((float(sums[0] or 0), float(sums[1] or 0)))
    return model


def seated(model: AllRestaurants, number: int, kept: list[str], name: str | None) -> DataFrame:
    """The state after a sweep; its tables and the words' customers less discounts are also kept under `name`."""
    totals, strengths, discounts, base, blocks = model.totals[-1], model.strengths, model.discounts, model.base, model.blocks

    def known(row: dict) -> list[np.ndarray]:
        return [np.bincount(row["at"], row["tables"], len(row["about"]))]

    def run(rows: pa.Table) -> pa.Table:
        now = {c: listed(rows, c) for c in STATE}
        (tables_all,) = facts_in_order(rows, ["sum"])
        word, place, at, tables = now["word"], now["place"], now["at"], now["tables"]
        customers = now["ones"] + np.bincount(place, tables, len(word)).astype(np.int64)
        weight = customers - discounts[1] * now["parents"]
        probability = (weight + (strengths[1] + discounts[1] * totals[1]) * base) / (strengths[1] + totals[0])
        new = strengths[0] + discounts[0] * np.maximum((now["others"] + tables_all)[at] - tables, 0)
        own = mix64(word.view(np.uint64) + np.uint64(number))
        key = mix64(own[place] + now["about"].view(np.uint64)[at] + np.uint64(1))
        tables = seat(now["n"], new, probability[place], discounts[0], key).astype(np.int64)
        customers = now["ones"] + np.bincount(place, tables, len(word)).astype(np.int64)
        new = strengths[1] + discounts[1] * np.maximum(totals[1] - now["parents"], 0)
        parents = seat(customers, new, np.full(len(word), base), discounts[1], own).astype(np.int64)
        row = {"block": block_number(rows)} | now | {"tables": tables, "parents": parents}
        row |= {c: listed(rows, c) for k in kept for c in (k, f"{k}_weight")}
        row |= {name: tables, f"{name}_weight": customers - discounts[1] * parents} if name else {}
        return one_row(row | {"customers": int(customers.sum()), "seats": int(parents.sum())} | dict.fromkeys(LIKELY, 0.0))

    answers = answered(questions(model.state, ["at", "tables"], known, ["sum"], blocks), ["sum"])
    return in_block(model.state, answers).groupBy("block").applyInArrow(run, state_schema(kept + ([name] if name else [])))


@dataclass
class HeadCells:
    """The most frequent cells in order of key, with the counts of their tokens and log10 probabilities."""

    cells: np.ndarray
    counts: np.ndarray
    scores: np.ndarray


class Block:
    """What the cells of a block need for their probabilities."""

    def __init__(self, rows: pa.Table, model: AllRestaurants):
        self.model = model
        self.word, self.count = listed(rows, "word"), listed(rows, "count")
        self.parents = [model.parent(listed(rows, f"{c}_weight"), t) for c, t in zip(model.kept, model.totals[-model.samples :])]
        seats = [f"seats_{k}" for k in range(model.samples)]
        about, self.size, *tables = (listed(rows, c) for c in ["fact", "size", *seats])
        order = np.argsort(about)
        self.about, self.size, *tables = (v[order] for v in (about, self.size, *tables))
        self.scale = model.strengths[0] + self.size
        # A context never seen passes all on.
        self.passed = [np.where(self.size > 0, (model.strengths[0] + model.discounts[0] * t) / self.scale, 1.0) for t in tables]
        self.place, self.n, self.context = listed(rows, "place"), listed(rows, "n"), listed(rows, "about")[listed(rows, "at")]
        tables = sum((listed(rows, c) for c in model.kept[1:]), listed(rows, model.kept[0]))
        self.own = self.n - model.discounts[0] * tables / model.samples
        self.keys = cell_keys(self.context, self.word[self.place])
        self.order = np.argsort(self.keys)
        self.sorted_keys = self.keys[self.order]

    def scores(self, context: np.ndarray, token: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the tokens and the cells' log10 probabilities, averaged over the samples."""
        at, known = found_in(token, self.word)
        of, met = found_in(context, self.about)
        chance = np.zeros(len(token))
        chance[met] = own[met] / self.scale[of[met]]
        for passed, parent, unknown in zip(self.passed, self.parents, self.model.unknown()):
            first, second = np.ones(len(token)), np.full(len(token), unknown)
            first[met], second[known] = passed[of[met]], parent[at[known]]
            chance = chance + first * second / self.model.samples
        counts = np.zeros(len(token), np.int64)
        counts[known] = self.count[at[known]]
        return counts, np.log10(chance)

    def owned(self, context: np.ndarray, token: np.ndarray, others: np.ndarray) -> np.ndarray:
        """What their restaurants give cells themselves; `others` where a cell was not seen more than once."""
        at, often = found_in(cell_keys(context, token), self.sorted_keys)
        own = others.copy()
        own[often] = self.own[self.order[at[often]]]
        return own


def head_cells(facts: DataFrame, model: AllRestaurants, head: int) -> HeadCells:
    """At most `head` cells: whole steps of an eighth of a doubling."""
    seen = flat(model.state, ["n"], lambda row: dict(zip(("n", "cells"), np.unique(row["n"], return_counts=True))), "n long, cells long")
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    steps = sorted(((r["step"], r["n"], r["least"]) for r in seen.groupBy(step.alias("step")).agg(F.sum("cells").alias("n"), F.min("n").alias("least")).collect()), reverse=True)
    taken, least = 0, None
    for _, n, smallest in steps:
        if taken + n > head:
            break
        taken, least = taken + n, smallest
    if not taken:
        return HeadCells(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def top(rows: pa.Table) -> pa.Table:
        block = Block(rows, model_of.value)
        at = block.n >= least
        context, token = block.context[at], block.word[block.place[at]]
        counts, scores = block.scores(context, token, block.own[at])
        return pa.table({"cell": cell_keys(context, token), "count": counts, "score": scores})

    model_of = shared_model(facts, model)
    found = stored_alone(facts.groupBy("block").applyInArrow(top, "cell long, count long, score double"), "head")
    rows = found.toArrow().combine_chunks().sort_by("cell")
    forget(found)
    return HeadCells(*(rows.column(c).to_numpy() for c in ("cell", "count", "score")))


def shared_model(frame: DataFrame, model: AllRestaurants):
    """The numbers of a model, without its tables, for tasks."""
    return frame.sparkSession.sparkContext.broadcast(replace(model, counted=None, state=None))


def held_cells(docs: DataFrame, model: AllRestaurants) -> DataFrame:
    """Of each block, the cells of held-out text that were seen once, by key, and the contexts seen with other words only."""
    blocks = model.blocks

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in cell_batches(batches, blocks):
            yield found.select(["block", "token", "context"])

    def meet(rows: pa.Table) -> pa.Table:
        token, context = listed(rows, "token"), listed(rows, "context")
        word, kinds, about, at, n = (listed(rows, c) for c in ("word", "kinds", "about", "at", "n"))
        single = n == 1
        known = cell_keys(about[at[single]], np.repeat(word, kinds)[single])
        keys, context = np.unique(cell_keys(context, token)), np.unique(context.view(np.uint64))
        place, met = found_in(known, keys)
        new = ~found_in(context, about.view(np.uint64))[1]
        return one_row({"block": block_number(rows), "once": keys[np.sort(place[met])], "about": context[new].view(np.int64)})

    found = docs.select("text").mapInArrow(read, f"block int, {binary(['token', 'context'])}")
    rows = in_block(model.counted.select("block", "word", "kinds", "about", "at", "n"), found)
    return rows.groupBy("block").applyInArrow(meet, f"block int, {binary(['once', 'about'])}")


def context_facts(held: DataFrame, model: AllRestaurants) -> DataFrame:
    """block, fact, size and tables in each sample of the contexts that the cells of a block have."""
    kept = model.kept
    names = ["size", *(f"seats_{k}" for k in range(model.samples))]

    def counted(row: dict) -> list[np.ndarray]:
        at, n, contexts = row["at"], row["n"], len(row["about"])
        return [np.bincount(at, n, contexts), *[np.bincount(at, n == 1, contexts)] * len(kept)]

    def sampled(row: dict) -> list[np.ndarray]:
        contexts = len(row["about"])
        return [np.zeros(contexts), *(np.bincount(row["at"], row[c], contexts) for c in kept)]

    def unseen(row: dict) -> list[np.ndarray]:
        return [np.zeros(len(row["about"]))] * len(names)

    asked = [
        questions(model.counted, ["at", "n"], counted, names, model.blocks),
        questions(model.state, ["at", *kept], sampled, names, model.blocks, answer=False),
        questions(held, [], unseen, names, model.blocks),
    ]
    return answered(in_block(*asked), names).drop("part")


OCCURRENCES = ["key", "word_context", "word_token"]
TEXTS = ["text_key", "text_id", "text_null", "text_held", "text_tokens", "text_known", "text_base", "text_score"]
ADDED = ["key", "known", "base", "score"]
NO_SUMS = pa.table({"part": pa.array([], pa.int32())} | {c: pa.array([], pa.binary()) for c in [*TEXTS, *ADDED]})
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_all(docs: DataFrame, model: AllRestaurants, head: int, keep: bool) -> DataFrame:
    """doc_id, held_out (as given), n_tokens, n_known, train_tokens, base_score, score of every row.

    Without `keep` the model's tables are removed as soon as they are no longer needed.
    """
    fresh = F.coalesce("held_out", F.lit(True))
    held = stored_alone(held_cells(docs.filter(fresh), model), "held")
    answers = stored_alone(context_facts(held, model), "contexts")
    if not keep:
        forget(model.counted)
    known = ["block", "word", "count", "place", "about", "at", "n", *(c for k in model.kept for c in (k, f"{k}_weight"))]
    facts = in_block(model.state.select(*known), answers)
    shared = docs.sparkSession.sparkContext.broadcast(head_cells(facts, model, head))
    facts = in_block(facts, held.select("block", "once"))
    texts = docs.select("doc_id", "held_out", fresh.alias("fresh"), "text")
    passes = min(PASSES, model.blocks)
    parts = [texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == k) for k in range(passes)]
    parts = [stored_alone(scored_texts(part, facts, model, shared, model.blocks // passes), "scores") for part in parts]
    forget(held, answers, *([] if keep else [model.state]))
    return in_block(*parts)


def scored_texts(texts: DataFrame, facts: DataFrame, model: AllRestaurants, shared, parts: int) -> DataFrame:
    """Sums of texts over the cells of the head, and over the others block by block, meet in `parts` parts of the texts."""
    blocks, model_of, below, total = model.blocks, shared_model(texts, model), float(model.total + model.distinct + 1), model.total

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, waiting, size = shared.value, [], 0
        top_base = np.log10((top.counts + 1) / below)
        for batch in slices(batches):
            codes, hashes, bounds = tokens(batch.column("text"))
            n, before = len(bounds) - 1, np.concatenate([[0], codes[:-1]])
            # Cells are looked up once each, however often they occur in the batch.
            pairs, at = np.unique(before * len(hashes) + codes, return_inverse=True)
            context, token = hashes[pairs // len(hashes)], hashes[pairs % len(hashes)]
            place, inside = found_in(cell_keys(context, token), top.cells)
            owner = np.repeat(np.arange(n), np.diff(bounds))
            keys = document_keys(batch.column("doc_id"), codes, hashes, bounds)
            of_cell = np.zeros((2, len(pairs)))
            of_cell[:, inside] = top_base[place[inside]], top.scores[place[inside]]
            sums = [np.bincount(owner, v[at], n) for v in of_cell]
            out = np.flatnonzero(~inside[at])
            ids, held = batch.column("doc_id").cast(pa.int64()), batch.column("held_out").cast(pa.int64())
            ids, null, held = pc.fill_null(ids, 0), pc.is_null(ids).cast(pa.int64()), pc.fill_null(held, -1)
            numbers = np.diff(bounds), np.diff(bounds) - np.bincount(owner[out], minlength=n)
            columns = [keys, *(v.to_numpy(zero_copy_only=False) for v in (ids, null, held)), *numbers, *sums]
            # The texts' own rows go along with any block.
            rows = packed(np.full(n, int(keys.view(np.uint64)[0]) % blocks), "block", dict(zip(TEXTS, columns)))
            yield padded(rows)
            waiting.append((keys[owner[out]], context[at[out]], token[at[out]], batch.column("fresh").to_numpy(zero_copy_only=False)[owner[out]]))
            size += len(out)
            if size > HELD_ENTRIES // 2:
                yield from occurrences(waiting)
                waiting, size = [], 0
        if waiting:
            yield from occurrences(waiting)

    def occurrences(waiting: list) -> Iterator[pa.RecordBatch]:
        key, context, token, new = (np.concatenate(x) for x in zip(*waiting))
        for fresh in (False, True):
            some = np.flatnonzero(new == fresh)
            block = place_of(token[some], blocks)
            order = np.argsort(block, kind="stable")
            some = some[order]
            columns = {"key": key[some], "word_context": context[some], "word_token": token[some]}
            yield padded(with_columns(packed(block[order], "block", columns), {"fresh": fresh}))

    def meet(rows: pa.Table) -> pa.Table:
        block, found = Block(rows, model_of.value), []
        once = np.sort(listed(rows, "once"))
        for fresh in (False, True):
            some = rows.filter(pc.equal(rows.column("fresh"), fresh))
            key, context, token = (listed(some, c) for c in OCCURRENCES)
            if not len(key):
                continue
            lowered = 1.0 - block.model.discounts[0]
            others = found_in(cell_keys(context, token), once)[1] * lowered if fresh else np.full(len(key), lowered)
            counts, scores = block.scores(context, token, block.owned(context, token, others))
            if not fresh and not counts.all():
                raise ValueError("a row that is not held out is not part of the training text")
            keys, at = np.unique(key.view(np.uint64), return_inverse=True)
            sums = [np.bincount(at, v, len(keys)) for v in (counts > 0, np.log10((counts + 1) / below), scores)]
            keys = keys.view(np.int64)
            found.append(packed(place_of(keys, parts), "part", dict(zip(ADDED, (keys, *sums)))))
        whole = {c: listed(rows, c) for c in TEXTS}
        part = place_of(whole["text_key"], parts)
        order = np.argsort(part, kind="stable")
        found.append(packed(part[order], "part", {c: v[order] for c, v in whole.items()}))
        tables = [pa.Table.from_batches([x]) for x in found]
        return pa.concat_tables([NO_SUMS, *tables], promote_options="default")

    def add(rows: pa.Table) -> pa.Table:
        # Rows that agree in doc_id and words share a key and score alike.
        keys, at, copies = np.unique(listed(rows, "text_key"), return_inverse=True, return_counts=True)
        of = np.searchsorted(keys, listed(rows, "key"))
        known, base, score = ((np.bincount(of, listed(rows, c), len(keys)) / copies)[at] for c in ADDED[1:])
        doc_id, null, held, n_tokens, n_known, text_base, text_score = (listed(rows, c) for c in TEXTS[1:])
        arrays = [
            pa.array(doc_id, mask=null == 1), pa.array(held == 1, mask=held < 0), pa.array(n_tokens), pa.array(n_known + np.rint(known).astype(np.int64)),
            pa.array(np.full(len(at), total, np.int64)), pa.array(text_base + base), pa.array(text_score + score),
        ]
        return pa.Table.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    found = texts.mapInArrow(read, f"block int, {binary([*OCCURRENCES, *TEXTS])}, fresh boolean")
    sums = in_block(found, facts).groupBy("block").applyInArrow(meet, f"part int, {binary([*TEXTS, *ADDED])}")
    return sums.groupBy("part").applyInArrow(add, SCORED)


def padded(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The columns that texts are read into, null where the rows have none."""
    types = {"block": pa.int32()} | dict.fromkeys([*OCCURRENCES, *TEXTS], pa.binary()) | {"fresh": pa.bool_()}
    names = rows.schema.names
    arrays = [rows.column(c) if c in names else pa.nulls(rows.num_rows, kind) for c, kind in types.items()]
    return pa.RecordBatch.from_arrays(arrays, [*types])


def train(
    docs: DataFrame, contexts: int | None = None, burn_in: int = BURN_IN, samples: int = SAMPLES
) -> tuple[DataFrame, Restaurants | AllRestaurants]:
    """The table of counts and the sampled restaurants of all contexts.

    With `contexts`, the table of dishes (token, cells) and the restaurants of the most frequent tokens;
    totals[burn_in:] belong to the samples.
    """
    if contexts is None:
        model = train_all(docs, burn_in, samples)
        return model.pairs, model
    counts = stored(pair_counts(docs, None).groupBy("token").agg(F.sum("n").alias("n")), "token-counts")
    seen = counts.agg(F.sum("n"), F.count("*"), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))).first()
    total, distinct = seen[0] or 0, seen[1]
    frequent = [row["token"] for row in counts.orderBy(F.desc("n"), "token").limit(contexts).collect()]
    pairs = pair_counts(docs, frequent).repartition("token").groupBy("token", "context").agg(F.sum("n").alias("n"))
    dishes = stored(pairs.groupBy("token").agg(F.collect_list(F.struct("context", "n")).alias("cells")), "dishes")
    cell = F.explode("cells").alias("cell")
    by_context = dishes.select(cell).select("cell.*").filter(F.col("context") < len(frequent)).groupBy("context")
    once, twice = (F.count(F.when(F.col("n") == k, 1)).alias(f"seen_{k}") for k in (1, 2))
    sizes = by_context.agg(F.sum("n").alias("size"), F.count("*").alias("dishes"), once, twice).collect()
    size, kinds = np.zeros(len(frequent)), np.zeros(len(frequent))
    for row in sizes:
        size[row["context"]], kinds[row["context"]] = row["size"], row["dishes"]
    lowered = discount(sum(r["seen_1"] for r in sizes), sum(r["seen_2"] for r in sizes)), discount(seen[2], seen[3])
    model = Restaurants(frequent, size, distinct, total, lowered, (1.0, 1.0))
    if not total:
        model.totals = [Totals(np.zeros(0), 0.0, 0.0)] * (burn_in + samples)
        return dishes, model
    model.totals = [Totals(kinds, float(total - size.sum() + kinds.sum()), float(distinct))]
    grid = [10.0**k for k in range(7)]
    model.strengths = (context_strength(dishes, model, grid), 1.0)
    for _ in range(burn_in + samples):
        model.totals.append(swept(dishes, model))
    return dishes, model


PREDICTED = "token long, count long, parent array<double>, contexts array<int>, extra array<double>"


def predictive(dishes: DataFrame, model: Restaurants, burn_in: int) -> DataFrame:
    """Of each token: count, the parent's probability in each sample, and for the contexts where it was seen
    the averaged probability that those restaurants give it themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Dishes(batch, model)
            parent, extra = [], np.zeros(len(rows.n))
            for number, totals in enumerate(model.totals[:-1]):
                rows.sweep(number, totals)
                if number >= burn_in:
                    parent.append(model.parent_probability(rows.customers, rows.parent_tables, model.totals[number + 1]))
                    extra += (rows.n - model.discounts[0] * rows.tables) / (model.strengths[0] + model.sizes[rows.context])
            samples = len(parent)
            ends = np.searchsorted(rows.row, np.arange(len(rows.token) + 1))
            offsets = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows.token),
                    pa.array(rows.count.astype(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(rows.token) + 1, dtype=np.int32) * samples), pa.array(np.column_stack(parent).reshape(-1))
                    ),
                    pa.ListArray.from_arrays(offsets, pa.array(rows.context.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(extra / samples)),
                ],
                ["token", "count", "parent", "contexts", "extra"],
            )

    return dishes.mapInArrow(run, PREDICTED)


@dataclass
class Head:
    """The most frequent tokens in order of hash, with counts and log10 probabilities after each context."""

    tokens: np.ndarray
    counts: np.ndarray
    logs: np.ndarray


def head_of(predicted: DataFrame, model: Restaurants, shares: np.ndarray, head: int) -> tuple[Head, int]:
    """At most `head` tokens, and the least count among them: whole steps of an eighth of a doubling."""
    step = F.floor(F.log2(F.col("count").cast("double")) * 8)
    steps = sorted(((r["step"], r["n"]) for r in predicted.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    taken, least = 0, 1 << 62
    for at, n in steps:
        if taken + n > head:
            break
        taken, least = taken + n, at
    rows = predicted.filter(step >= least).toArrow() if taken else None
    kinds = len(model.frequent) + 1
    if rows is None:
        return Head(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, kinds), np.float32)), least
    rows = rows.combine_chunks().sort_by("token")
    parent = np.array(rows.column("parent").to_pylist(), float).reshape(rows.num_rows, -1)
    logs = np.column_stack([parent @ shares.T / parent.shape[1], parent.mean(axis=1)])
    contexts, extra = rows.column("contexts").combine_chunks(), rows.column("extra").combine_chunks()
    at = np.repeat(np.arange(rows.num_rows), pc.list_value_length(contexts).to_numpy(zero_copy_only=False))
    logs[at, contexts.flatten().to_numpy(zero_copy_only=False)] += extra.flatten().to_numpy(zero_copy_only=False)
    return Head(rows.column("token").to_numpy(), rows.column("count").to_numpy(), np.log10(logs).astype(np.float32)), least


def document_keys(ids: pa.Array, codes: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit keys of doc_id and words."""
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes.view(np.uint64)[codes] + mix64(place)), dtype=np.uint64)])
    number = pc.fill_null(ids.cast(pa.int64()), -1).to_numpy(zero_copy_only=False).view(np.uint64)
    return mix64(sums[bounds[1:]] - sums[bounds[:-1]] + mix64(number + np.uint64(1))).view(np.int64)


def score(
    docs: DataFrame,
    dishes: DataFrame,
    model: Restaurants | AllRestaurants,
    burn_in: int = BURN_IN,
    head: int | None = None,
    keep: bool = True,
) -> DataFrame:
    """doc_id, held_out (as given), n_tokens, n_known, train_tokens, base_score, score of every row.

    Without `keep` the tables of a model of all contexts are used up.
    """
    if isinstance(model, AllRestaurants):
        return score_all(docs, model, HEAD_CELLS if head is None else head, keep)
    head = HEAD if head is None else head
    spark = docs.sparkSession
    kept = model.totals[burn_in + 1 :] or model.totals
    shares = np.column_stack([model.passed_on(t) for t in kept])  # contexts x samples
    unknown = [float(model.parent_probability(0, 0, t)) if model.total else 1.0 for t in kept]
    predicted = stored(predictive(dishes, model, burn_in), "predictive") if model.total else None
    if predicted is None:
        predicted = spark.createDataFrame([], PREDICTED)
    top, least = head_of(predicted, model, shares, head)
    shared = spark.sparkContext.broadcast(top)
    frequent, below = np.array(model.frequent, np.int64), float(model.total + model.distinct + 1)

    def read(batch: pa.RecordBatch):
        codes, hashes, bounds = tokens(batch.column("text"))
        known = shared.value
        at = np.minimum(np.searchsorted(known.tokens, hashes), max(0, len(known.tokens) - 1))
        place = np.where(known.tokens[at] == hashes, at, -1) if len(known.tokens) else np.full(len(hashes), -1)
        keys = document_keys(batch.column("doc_id"), codes, hashes, bounds)
        return codes, hashes, bounds, place[codes], contexts_of(codes, hashes, frequent), keys

    def by_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            codes, _, bounds, place, context, keys = read(batch)
            n = len(bounds) - 1
            owner, inside = np.repeat(np.arange(n), np.diff(bounds)), place >= 0
            sums = [
                np.bincount(owner[inside], values, n).astype(float)
                for values in (
                    np.log10((known.counts[place[inside]] + 1) / below),
                    known.logs[place[inside], context[inside]].astype(float),
                )
            ]
            numbers = np.diff(bounds), np.bincount(owner[inside], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), *map(pa.array, (*numbers, *sums))],
                ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
            )

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, hashes, bounds, place, context, keys = read(batch)
            out = np.flatnonzero(place < 0)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[out]
            arrays = [pa.array(keys[owner]), pa.array(hashes[codes[out]]), pa.array(context[out].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "token", "context"])

    texts = docs.select("doc_id", "held_out", "text")
    heads = texts.mapInArrow(by_head, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    others = texts.select("doc_id", "text").mapInArrow(rest, "key long, token long, context int")
    step = F.floor(F.log2(F.col("count").cast("double")) * 8)
    met = others.join(predicted.filter(step < least), "token", "left")
    parent = F.coalesce("parent", _numbers(unknown))
    passed = F.element_at(F.array(*[_numbers(row) for row in shares], _numbers([1.0] * len(kept))), F.col("context") + 1)
    averaged = F.aggregate(F.zip_with(parent, passed, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) / len(kept)
    own = F.coalesce(F.element_at("extra", F.array_position("contexts", F.col("context")).cast("int")), F.lit(0.0))
    own = F.when(F.array_contains("contexts", F.col("context")), own).otherwise(0.0)
    tails = met.select(
        "key",
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("boolean").alias("held_out"),
        F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("count").isNotNull(), 1).otherwise(0).cast("long").alias("n_known"),
        F.log10((F.coalesce("count", F.lit(0)) + 1) / F.lit(below)).alias("base"),
        F.log10(averaged + own).alias("score"),
    )
    rows = heads.withColumn("copies", F.lit(1)).unionByName(tails.withColumn("copies", F.lit(0)))
    summed = rows.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "copies")],
    )
    one = summed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return one.select(
        "doc_id",
        "held_out",
        *[(F.col(c) / F.col("copies")).cast("long").alias(c) for c in ("n_tokens", "n_known")],
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def scoring_query(spark, sf_dir: str) -> DataFrame:
    """All documents, learned from those of folds other than 2 of 7."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", fold("doc_id", 7) == 2)
    dishes, model = train(docs.filter(~F.col("held_out")))
    return score(docs, dishes, model, keep=False)
