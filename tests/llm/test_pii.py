import random
import re
import time

import pytest

from footfall.llm import pii
from tests.llm.data import AWKWARD, SCHEMA, documents, prose

CLASH = ["doc", "terms", "entity", "term", "n_pair", "spans", "n_email"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def plain_spans(text):
    spans = []
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        for found in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", found.group())
            good = {
                "email": True,
                "ip": name == "ip" and all(int(part) <= 255 for part in found.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits or "1"),
                "phone": 9 <= len(digits) <= 15,
            }[name]
            if good:
                spans.append((found.start(), kind, found.end()))
    return sorted(spans)


@pytest.mark.parametrize("alphabet", ["a1.@-_ ", "0123456789.- +()", "1. ", "a@b.c-d_%+ ", "4111 -+é"])
def test_patterns_against_the_regular_expressions(alphabet):
    chosen = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(chosen.choice(alphabet) for _ in range(chosen.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_cards_and_phones():
    text = "é card 4111 1111 1111 1111, wrong 4111 1111 1111 1112; call +49 (30) 123-4567 or a.b@c.example.org 10.0.0.255 10.0.0.256"
    assert pii.base_spans(text) == plain_spans(text)
    assert [pii.KINDS[kind] for _, kind, _ in pii.base_spans(text)] == ["card", "phone", "email", "ip"]


@pytest.mark.parametrize("unit", ["a", "1", "1.", "@", "a@", "a@b", "+1", "1 ", "+1(", "."])
def test_long_texts_take_time_in_proportion(unit):
    start = time.time()
    pii.base_spans(unit * (400_000 // len(unit)))
    assert time.time() - start < 5


def corpus():
    """Documents of which some name a person's address, always near a nickname found nowhere else."""
    rows = [(k, prose(k), "en", "src0", 0) for k in range(200)]
    for k in range(6):
        rows.append((500 + k, f"{prose(900 + k, 20)} Zorbix ordinary jane@home.example {prose(950 + k, 20)}", "en", "src0", 0))
    # One word that is near the address as often, but found everywhere.
    return [(i, t + " ordinary" if i < 200 else t, lang, s, n) for i, t, lang, s, n in rows]


def test_a_disclosing_term_is_sanitised(spark):
    found = {r["doc_id"]: r for r in pii.sanitise(documents(spark, corpus(), CLASH)).collect()}
    for k in range(500, 506):
        row = found[k]
        assert "<EMAIL>" in row["text"] and "Zorbix" not in row["text"] and "ordinary" in row["text"]
        kinds = [span.split(":")[0] for span in row["spans"].split(",")]
        assert kinds == ["term", "email"]
        assert row["n_email"] == 1
    assert all(row["spans"] == "" and row["text"] for doc, row in found.items() if doc < 200)


def test_copies_are_one_context(spark):
    """The same surroundings again and again are no evidence that a term discloses anything."""
    rows = [(k, prose(k), "en", "src0", 0) for k in range(50)] + [(100 + k, "Zorbix wrote from jane@home.example", "en", "s", 0) for k in range(9)]
    assert pii.disclosing_terms(documents(spark, rows)).isEmpty()


def test_copies_do_not_hide_other_surroundings(spark):
    """A passage copied many times takes nothing from the evidence of the documents that differ."""
    rows = corpus() + [(1000 + k, "Zorbix wrote from jane@home.example", "en", "s", 0) for k in range(300)]
    found = {r["doc_id"]: r for r in pii.sanitise(documents(spark, rows)).collect()}
    assert all("Zorbix" not in found[k]["text"] for k in [*range(500, 506), *range(1000, 1300)])


def test_names_inside_a_fixed_phrase(spark):
    """The words of a name always have the same neighbours, in however many different documents it is."""
    rows = [(k, prose(k), "en", "src0", 0) for k in range(200)]
    rows += [(500 + k, f"{prose(900 + k, 20)} Dr Jane Smith, email jane@x.example. {prose(950 + k, 20)}", "en", "s", 0) for k in range(8)]
    found = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(spark, rows)).collect()}
    assert all(word not in found[500 + k] for k in range(8) for word in ("Dr", "Jane", "Smith"))


def test_frequencies_do_not_depend_on_the_kind_of_join(spark, monkeypatch):
    docs = documents(spark, corpus())
    first = sorted(pii.sanitise(docs).collect(), key=str)
    monkeypatch.setattr(pii, "MAX_BROADCAST_TERMS", 0)
    assert first == sorted(pii.sanitise(docs).collect(), key=str)


def test_awkward_rows(spark):
    found = pii.sanitise(documents(spark, AWKWARD, CLASH)).collect()
    assert len(found) == len(AWKWARD)
    assert all(r["spans"] == "" and r["n_email"] == 0 for r in found)
    assert {r["doc_id"]: r["text"] for r in found}[9001] is None
    assert pii.sanitise(spark.createDataFrame([], SCHEMA)).collect() == []
