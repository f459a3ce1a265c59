"""Language identification in two steps: the family first, then the language within it.

Texts are lower-cased, everything but letters becomes a space, and byte trigrams are hashed to DIMENSIONS
counts, divided by their number. Linear support vector machines are trained one-versus-one between families
and one-versus-one between the languages of each family, on a bounded sample of labelled documents
(`per_language` documents of each language, and a short piece of each, so that short texts are seen as well).
The predicted family is the one that wins most duels, then the language in it likewise; equal numbers of
wins go to the larger sum of margins, then to the name first in order.

Prediction reads every whole text once; a task holds the weights only (DIMENSIONS numbers for each duel).

Defined results: a null text and one without a letter give `und` with score 0; without labelled documents
every text gives `und`; with one language it is that language with score 1; repeated rows are predicted
each; an empty table gives an empty table; other columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import documents, fold, hash_place, slices

DIMENSIONS = 1 << 13
UNKNOWN = "und"
# Families of languages by ISO code; others form a family of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "indic": "hi ur bn pa gu mr ne si".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "uralic": "fi et hu".split(),
    "semitic": "ar he mt am".split(),
}


def family_of(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((family for family, codes in FAMILIES.items() if code in codes), "other")


def trigram_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts, and where each text's begin (n + 1 bounds)."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    spaced = pc.binary_join_element_wise(*[pa.scalar(" ", pa.large_string()), lowered, pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string())])
    buffers = spaced.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = _LETTERS[np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]].astype(np.uint32)
    offsets = offsets - offsets[0]
    codes = (data[:-2] * np.uint32(2654435761) ^ data[1:-1] * np.uint32(40503) * np.uint32(65539) ^ data[2:] * np.uint32(2246822519)) >> np.uint32(19)
    # The last two trigrams of a text reach into the next one: two trailing spaces keep them its own.
    bounds = np.minimum(offsets, len(codes))
    return codes.astype(np.int64), bounds


def _letter_table() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_LETTERS = _letter_table()


@dataclass
class Duel:
    """A linear decision between two names: positive for the first."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by accelerated gradient descent."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    weight, y = weight.astype(np.float32), y.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    look_w, look_b, t = w, b, 1.0
    step = np.float32(1.0 / (2 * (weight * ((x**2).sum(axis=1) + 1)).sum() + penalty))
    penalty = np.float32(penalty)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look_w + look_b)) * weight * y
        new_w = look_w - step * (penalty * look_w - 2 * (slack @ x))
        new_b = look_b + step * 2 * slack.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = np.float32((t - 1) / new_t)
        look_w, look_b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w.astype(np.float64), float(b)


def duels(x: np.ndarray, labels: np.ndarray) -> list[Duel]:
    found = []
    for first, second in combinations(sorted(set(labels)), 2):
        chosen = (labels == first) | (labels == second)
        w, b = train_svm(x[chosen], np.where(labels[chosen] == first, 1.0, -1.0))
        found.append(Duel(first, second, w, b))
    return found


@dataclass
class Model:
    families: dict[str, list[str]]
    family_duels: list[Duel]
    language_duels: dict[str, list[Duel]]
    scale: float

    def predict(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = self.family_duels + [duel for found in self.language_duels.values() for duel in found]
        counts = np.maximum(np.diff(bounds), 1)
        margins = {}
        for duel in every:
            sums = np.concatenate([[0.0], np.cumsum(duel.weights[codes], dtype=np.float64)])
            margins[id(duel)] = (sums[bounds[1:]] - sums[bounds[:-1]]) * self.scale / counts + duel.bias
        n = len(bounds) - 1
        family, score = winners(sorted(self.families), self.family_duels, margins, n)
        languages = np.empty(n, object)
        for name, members in self.families.items():
            at = family == name
            best, sure = winners(members, self.language_duels[name], margins, n)
            languages[at] = best[at]
            score[at] *= sure[at]
        return languages, score


def winners(names: list[str], held: list[Duel], margins: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Winner of each row, and a score: the product of its chances in its own duels."""
    names = sorted(names)
    wins, sums, chance = (np.zeros((n, len(names))), np.zeros((n, len(names))), np.ones((n, len(names))))
    for duel in held:
        margin = margins[id(duel)]
        for name, signed in ((duel.first, margin), (duel.second, -margin)):
            k = names.index(name)
            wins[:, k] += signed > 0
            sums[:, k] += signed
            chance[:, k] *= 1 / (1 + np.exp(-np.clip(3 * signed, -30, 30)))
    best = np.argmax(wins + 1e-3 * np.tanh(sums / max(1, len(names))), axis=1)
    return np.array(names, object)[best], chance[np.arange(n), best]


def training_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """The first documents of each language by a hash of their ids: doc_id, lang.

    Languages are counted first, so that about four times as many as wanted are ranked, whatever the input.
    """
    order = Window.partitionBy("lang").orderBy("_place", "doc_id")
    ids = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = ids.groupBy("lang").agg((F.lit(4.0 * per_language) / F.count("*")).alias("_share"))
    ids = ids.withColumn("_place", hash_place("doc_id")).join(F.broadcast(counts), "lang")
    ids = ids.filter(F.col("_place") <= F.col("_share"))
    ranked = ids.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_language)
    return ranked.select("doc_id", "lang").distinct()


def train(docs: DataFrame, per_language: int = 400, piece: int = 60) -> Model | None:
    """Fit the model on documents with a language; `per_language` bounds what reaches the driver."""
    chosen = F.broadcast(training_sample(docs, per_language))
    sample = docs.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.large_string())
            middle = pc.utf8_slice_codeunits(texts, 20, 20 + piece)
            for part in (texts, middle):
                codes, bounds = trigram_codes(part)
                found = [np.unique(codes[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("lang").cast(pa.string()),
                        pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()),
                        pa.array([f[1].astype(np.int32).tobytes() for f in found], pa.binary()),
                    ],
                    ["lang", "codes", "counts"],
                )

    rows = sample.dropDuplicates(["doc_id", "lang"]).mapInArrow(count, "lang string, codes binary, counts binary").collect()
    rows = sorted((r["lang"], bytes(r["codes"]), bytes(r["counts"])) for r in rows)
    if not rows:
        return None
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for k, (_, codes, counts) in enumerate(rows):
        values = np.frombuffer(counts, np.int32)
        x[k, np.frombuffer(codes, np.int32)] = values / max(1, values.sum())
    # Scaled so that an average text has length 1.
    scale = float(1 / max(1e-9, np.sqrt((x**2).sum(axis=1)).mean()))
    x *= scale
    labels = np.array([r[0] for r in rows], object)
    kinds = np.array([family_of(label) for label in labels], object)
    families = {kind: sorted(set(labels[kinds == kind])) for kind in sorted(set(kinds))}
    within = {kind: duels(x[kinds == kind], labels[kinds == kind]) for kind in families}
    return Model(families, duels(x, kinds), within, scale)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out (as given), lang_pred, score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.large_string())
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if known is not None:
                best, sure = known.predict(*trigram_codes(texts))
                names[letters], scores[letters] = best[letters], sure[letters]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(list(names), pa.string()), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return docs.select("doc_id", "held_out", "text").mapInArrow(predict, schema)


def language_query(spark, sf_dir: str) -> DataFrame:
    """All documents, learned from those of folds other than 2 of 4."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 4) == 2)
    return identify(docs, train(docs.filter(~F.col("held_out"))))
