r"""Personal data: patterns, then information-theoretic sanitisation of the terms around them.

Patterns find protected entities (e-mail, IP and card numbers, phone numbers). Corpus co-occurrence then
estimates what other terms disclose: with document frequencies n(e), n(t) and n(e, t) over N documents, a
term t near an entity e has the pointwise mutual information

    PMI(t; e) = log(N n(e, t) / (n(e) n(t))),   at most the entity's information IC(e) = log(N / n(e)).

A term with PMI >= remove * IC gives the entity away by itself and is removed; one with
PMI >= generalise * IC narrows it down and is generalised to its kind of word. Chance is kept out by asking
for the pair in `min_contexts` different surroundings (all words in reach of the entity, so that a term inside a
fixed phrase has as many as the phrase). Copies of one passage count once and, however many there are, take
nothing from the others; near copies whose words in reach differ count as different, so that in doubt a term
is sanitised. A term is sanitised in the documents that name the entity it discloses.

Work grows with the text: only words within `reach` words of an entity are candidates, document
frequencies of all words combine in each task before the shuffle, and candidates meet them in a join.

Defined results: a null text is empty and has no spans; repeated rows are documents of their own in the
counts and each get their spans; an empty table gives an empty table; other columns are ignored.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import slices, stored

KINDS = ("email", "ip", "card", "phone", "term")
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{2,}")
_DIGITS = str.maketrans("", "", "() .-+")
# Broadcast the candidate terms only up to this many; beyond, words and terms meet in a shuffled join.
MAX_BROADCAST_TERMS = 100_000


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ leftwards over the local part: every character is looked at once or twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = text[done:at]
        start = done + len(local.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if start < at else None
        done = at + 1
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for found in _IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in found.group().split(".")]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            yield found.span()


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        # At least half of the match is digits, so longer ones need no look.
        if 12 <= found.end() - found.start() <= 37:
            digits = found.group().translate(_DIGITS)
            if 12 <= len(digits) <= 19 and _luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 9 <= len(found.group().translate(_DIGITS)) <= 15:
            yield found.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of start, then kind."""
    spans = [(start, 0, end) for start, end in emails(text)]
    spans += [(start, 1, end) for start, end in ips(text)]
    spans += [(start, 2, end) for start, end in cards(text)]
    if "+" in text:
        spans += [(start, 3, end) for start, end in phones(text)]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def contexts(text: str, spans: list[tuple[int, int, int]], reach: int) -> Iterator[tuple[str, str, str]]:
    """(entity, term, digest of all words in reach) for the words within `reach` words of each span."""
    for start, kind, end in spans:
        # A word may be long; this many characters on either side hold the words in reach.
        left, right = max(0, start - 40 * reach), end + 40 * reach
        words = [w for w in _WORD.finditer(text, left, right) if not any(s < w.end() and w.start() < e for s, _, e in spans)]
        near = [w for w in words if w.end() <= start][-reach:] + [w for w in words if w.start() >= end][:reach]
        entity = f"{KINDS[kind]}:{text[start:end].lower()}"
        terms = [w.group().lower() for w in near]
        around = hashlib.blake2b(" ".join(terms).encode(), digest_size=8).hexdigest()
        for term in dict.fromkeys(terms):
            yield entity, term, around


_MENTIONS = "entity string, term string, around string, doc string"


def mentions(docs: DataFrame, reach: int) -> DataFrame:
    """Candidate terms near each entity, with the document and a digest of the surroundings."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                spans = base_spans(text or "")
                rows += [(*found, str(doc)) for found in contexts(text, spans, reach)] if spans else []
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            names = ("entity", "term", "around", "doc")
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names)

    return docs.select("doc_id", "text").mapInArrow(find, _MENTIONS)


def term_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """In how many documents each term occurs; terms are lower-case words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{2,}"), 0))
    counted = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    if terms.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS:
        terms = F.broadcast(terms)
    # A semi join would be moved below the counts and pass every occurrence on; the terms are distinct.
    return counted.join(terms, "term")


def disclosing_terms(
    docs: DataFrame, reach: int = 8, min_contexts: int = 3, remove: float = 0.95, generalise: float = 0.8
) -> DataFrame:
    """(doc, term, action): terms to sanitise in each document that names the entity they disclose."""
    found = stored(mentions(docs, reach), "mentions")
    numbers = F.countDistinct("doc").alias("n_pair"), F.countDistinct("around").alias("n_around")
    pairs = found.groupBy("entity", "term").agg(*numbers).filter(F.col("n_around") >= min_contexts)
    entities = found.groupBy("entity").agg(F.countDistinct("doc").alias("n_entity"))
    # A term is in at least the documents where it is near some entity: with that bound its information
    # on an entity cannot be understated, so pairs that miss the lower threshold are settled already.
    near = found.groupBy("term").agg(F.countDistinct("doc").alias("n_near"))
    total = F.lit(float(max(docs.count(), 1)))
    information = F.log(total / F.col("n_entity"))

    def pmi_with(n_term: str) -> Column:
        return F.log(total * F.col("n_pair") / (F.col("n_entity") * F.col(n_term)))

    pairs = pairs.join(entities, "entity").join(near, "term")
    pairs = stored(pairs.filter(pmi_with("n_near") >= generalise * information), "pairs")
    frequencies = term_frequencies(docs, pairs.select("term").distinct())
    measured = pairs.join(frequencies, "term")
    pmi = pmi_with("n_term")
    action = F.when(pmi >= remove * information, "remove").when(pmi >= generalise * information, "generalise")
    disclosing = measured.filter(information > 0).withColumn("action", action).filter(F.col("action").isNotNull())
    hits = found.select("doc", "entity", "term").distinct().join(disclosing.select("entity", "term", "action"), ["entity", "term"])
    return hits.groupBy("doc", "term").agg(F.max("action").alias("action"))


def _shape(word: str) -> str:
    return "<NAME>" if word[:1].isupper() else "<WORD>"


def term_spans(text: str, base: list[tuple[int, int, int]], actions: dict[str, str]) -> list[tuple[int, int, int]]:
    """Every occurrence of a disclosing term outside the base spans."""
    if not actions:
        return []
    spans, k = [], 0
    for word in _WORD.finditer(text):
        if word.group().lower() in actions:
            while k < len(base) and base[k][0] < word.start() and base[k][2] <= word.start():
                k += 1
            if not any(s < word.end() and word.start() < e for s, _, e in base[k : k + 4]):
                spans.append((word.start(), 4, word.end()))
    return spans


def sanitised(text: str, spans: list[tuple[int, int, int]], actions: dict[str, str]) -> str:
    """The text with protected spans labelled and disclosing terms removed or generalised."""
    out, done = [], 0
    for start, kind, end in spans:
        if start < done:
            continue
        found = text[start:end]
        if kind < 4:
            mark = LABELS[KINDS[kind]]
        else:
            mark = "" if actions.get(found.lower()) == "remove" else _shape(found)
        out += [text[done:start], mark]
        done = end
    return "".join(out) + text[done:]


SANITISED = (
    "doc_id long, text string, lang string, source string, n_email long, n_ip long, n_card long, n_phone long, "
    "base_sha256 string, spans string"
)


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """Each document with its spans (kind:start:end) and its sanitised text."""
    terms = disclosing_terms(docs, **thresholds)
    by_document = terms.groupBy("doc").agg(F.collect_list(F.concat_ws("\t", "term", "action")).alias("terms"))
    columns = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("doc_id", "text", "lang", "source")]
    keyed = docs.select(*columns).withColumn("doc", F.coalesce(F.col("doc_id").cast("string"), F.lit("None")))
    # Few documents have such terms: they are looked up first, so that texts need no shuffle.
    by_document = stored(by_document, "terms")
    if by_document.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS:
        by_document = F.broadcast(by_document)
    keyed = keyed.join(by_document, "doc", "left").drop("doc")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.to_pydict()
            texts, counts, digests, listed = [], [], [], []
            for text, terms in zip(rows["text"], rows["terms"]):
                base = base_spans(text or "")
                actions = dict(term.split("\t") for term in terms or [])
                spans = sorted(base + term_spans(text or "", base, actions))
                texts.append(None if text is None else sanitised(text, spans, actions))
                counts.append([sum(kind == k for _, kind, _ in base) for k in range(4)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                listed.append(joined(spans))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            arrays = [batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string()), pa.array(rows["lang"], pa.string())]
            arrays += [pa.array(rows["source"], pa.string()), *numbers, pa.array(digests, pa.string()), pa.array(listed, pa.string())]
            names = [field.split()[0] for field in SANITISED.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return keyed.mapInArrow(clean, SANITISED)


def pii_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sanitise(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
