"""Quality classifier by positive-unlabelled learning.

Learned from trusted positives and unlabelled web text only; documents marked as bad are never looked at.
A text is described by how its characters, words and repetitions are distributed (FEATURES); every feature
is cut at quantiles of the unlabelled sample, and a linear model of these cuts is fitted. The class prior
(the share of good documents in the web text) is estimated from the classifier's scores: it is the least
ratio of unlabelled to positive documents above any score, with a margin for the size of the samples. The
model then minimises the non-negative unbiased risk

    prior * R+(positives)  +  max(0, R-(unlabelled) - prior * R-(positives)),

going back up the second term's gradient whenever that term falls below zero.

The fit uses at most `positives` and `unlabelled` documents, the first by a hash of their ids. Every whole
text is scored in one pass.

Defined results: null and empty texts are scored as texts without words; without positives or unlabelled
text every score is 0.5; repeated rows are scored each; an empty table gives an empty table; other columns
are ignored; labels without a document have no effect.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import codes_of, documents, fold, hash_place, slices, words_of

# Characters counted together, as shares of all characters that are not white space.
CLASSES = ["lower", "upper", "digit", "stop", "comma", "shout", "bar", "quote", "bracket", "symbol", "other"]
FEATURES = CLASSES + ["log_words", "word_length", "distinct", "repeated", "line_words", "stop_words"]
QUANTILES = (0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.7, 0.85, 0.92, 0.96, 0.98, 0.99)


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("symbol"), np.int64)
    for name, characters in (("stop", ".?"), ("comma", ",;:-"), ("shout", "!"), ("bar", "|"), ("quote", "'\""), ("bracket", "()")):
        for character in characters:
            table[ord(character)] = CLASSES.index(name)
    table[97:123] = CLASSES.index("lower")
    table[65:91] = CLASSES.index("upper")
    table[48:58] = CLASSES.index("digit")
    table[128:] = CLASSES.index("other")
    table[[9, 10, 11, 12, 13, 32]] = len(CLASSES)
    return table


_TABLE = _class_table()


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = len(CLASSES) + 1
    counts = np.bincount(owner * kinds + _TABLE[data], minlength=n * kinds).reshape(n, kinds).astype(float)
    visible = np.maximum(counts[:, :-1].sum(axis=1), 1)
    newlines = np.bincount(owner[data == 10], minlength=n)
    words, bounds = words_of(texts)
    codes, _ = codes_of(words)
    number = np.diff(bounds)
    some = np.maximum(number, 1)
    document = np.repeat(np.arange(n), number)
    pairs = np.unique(document.astype(np.int64) * (int(codes.max()) + 1 if len(codes) else 1) + codes)
    distinct = np.bincount(pairs // (int(codes.max()) + 1), minlength=n) if len(codes) else np.zeros(n)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (document[1:] == document[:-1])
    repeated = np.bincount(document[again], minlength=n)
    short = np.bincount(document[pc.binary_length(words).to_numpy(zero_copy_only=False) <= 3], minlength=n)
    return np.column_stack(
        [
            counts[:, :-1] / visible[:, None],
            np.log1p(number),
            visible / some,
            # Distinct words against what a text of this length has when words thin out as a power of it.
            distinct / some**0.8,
            repeated / some,
            np.log1p(number / (newlines + 1)),
            short / some,
        ]
    )


@dataclass
class Model:
    """Cuts of each feature and the weight of each interval."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.cuts:
            return np.full(len(rows), 0.5)
        return 1 / (1 + np.exp(-np.clip(design(rows, self.cuts) @ self.weights + self.bias, -30, 30)))


def design(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """One column for each interval of each feature."""
    columns = []
    for k, cut in enumerate(cuts):
        place = np.searchsorted(cut, rows[:, k], side="left")
        columns.append(np.eye(len(cut) + 1)[place])
    return np.concatenate(columns, axis=1)


def _descend(gradient, size: int, rounds: int, rate: float = 0.05) -> np.ndarray:
    """Adam steps on a gradient of all rows."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the shares of unlabelled and positive scores above a threshold.

    The margin is that of both empirical distributions; thresholds with few positives have a wide one.
    """
    thresholds = np.unique(np.concatenate([positive, unlabelled]))
    above_p = 1 - np.searchsorted(np.sort(positive), thresholds, side="left") / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), thresholds, side="left") / len(unlabelled)
    margin = np.sqrt(np.log(20) / (2 * len(positive))) + np.sqrt(np.log(20) / (2 * len(unlabelled)))
    usable = above_p > 0
    bound = (above_u[usable] + margin) / above_p[usable]
    best = int(np.argmin(bound))
    return float(np.clip(above_u[usable][best] / above_p[usable][best], 0.05, 0.98))


def _prior_by_halves(p: np.ndarray, u: np.ndarray, rounds: int, decay: float, splits: int = 5) -> float:
    """Median of the estimates from several seeded splits into halves.

    A rough classifier tells labelled from unlabelled rows of one half; the other half's scores are used.
    """
    random, priors = np.random.default_rng(0), []
    for _ in range(splits):
        in_p, in_u = (random.permutation(len(rows)) < (len(rows) + 1) // 2 for rows in (p, u))
        for fit_p, fit_u, rest_p, rest_u in ((p[in_p], u[in_u], p[~in_p], u[~in_u]), (p[~in_p], u[~in_u], p[in_p], u[in_u])):
            if not min(len(fit_p), len(fit_u), len(rest_p), len(rest_u)):
                continue

            def told_apart(w: np.ndarray) -> np.ndarray:
                return decay * w - (1 - _sigmoid(fit_p @ w)) @ fit_p / len(fit_p) + _sigmoid(fit_u @ w) @ fit_u / len(fit_u)

            rough = _descend(told_apart, p.shape[1], rounds)
            priors.append(estimate_prior(rest_p @ rough, rest_u @ rough))
    return float(np.median(priors)) if priors else 0.5


def fit(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 600, decay: float = 3e-4) -> Model:
    """Non-negative risk minimisation on feature rows."""
    if not len(positive) or not len(unlabelled):
        return Model([], np.zeros(0), 0.0, 0.5)
    cuts = [np.unique(np.quantile(unlabelled[:, k], QUANTILES)) for k in range(unlabelled.shape[1])]
    p, u = (np.column_stack([design(rows, cuts), np.ones(len(rows))]) for rows in (positive, unlabelled))
    prior = _prior_by_halves(p, u, rounds // 3, decay)

    def risk_gradient(w: np.ndarray) -> np.ndarray:
        # Sigmoid loss: a positive costs 1 - s(f), a negative s(f), so the second term is a difference of means.
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = su.mean() - prior * sp.mean()
        up = (sp * (1 - sp)) @ p / len(p)
        gain = (su * (1 - su)) @ u / len(u) - prior * up
        return decay * w - (gain if negative < 0 else prior * up - gain)

    w = _descend(risk_gradient, p.shape[1], rounds)
    return Model(cuts, w[:-1], float(w[-1]), prior)


def _first_by_hash(ids: DataFrame, number: int) -> DataFrame:
    """Ids are counted first, so that about four times as many as wanted are sorted, whatever the input."""
    known = ids.filter(F.col("doc_id").isNotNull()).select("doc_id", hash_place("doc_id").alias("_place"))
    share = 4.0 * number / max(1, known.count())
    chosen = known.filter(F.col("_place") <= share).distinct()
    return chosen.orderBy("_place", "doc_id").limit(number).select("doc_id")


def _rows_of(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Feature rows of some documents, one for each id, in order of id."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "row"]
            )

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    described = chosen.mapInArrow(describe, "doc_id long, row array<double>").dropDuplicates(["doc_id"])
    return np.array([r["row"] for r in sorted(described.collect(), key=lambda r: r["doc_id"])]).reshape(-1, len(FEATURES))


def train(docs: DataFrame, trusted: DataFrame, positives: int = 4_000, unlabelled: int = 8_000) -> Model:
    """Fit on trusted positives (doc_id) and unlabelled documents; the two numbers bound the sample."""
    good = _first_by_hash(trusted, positives)
    return fit(_rows_of(docs, good), _rows_of(docs, _first_by_hash(docs, unlabelled)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The given columns, `quality_score` and `accepted` of every document; `docs` has a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = shared.value.score(features(batch.column("text")))
            arrays = [*batch.columns, pa.array(scores), pa.array(scores >= 0.5)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "quality_score", "accepted"])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(judge, f"{given}, quality_score double, accepted boolean")


def trained_on(spark, sf_dir: str, docs: DataFrame) -> Model:
    """The model for a folder's documents and labels, learned outside fold 1 of 3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = labels.filter((F.col("quality") == 1) & (fold("doc_id", 3) != 1))
    return train(docs.filter(fold("doc_id", 3) != 1), trusted)


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, trained_on(spark, sf_dir, docs))
    return scored.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("accepted").cast("int").alias("predicted"),
    )
