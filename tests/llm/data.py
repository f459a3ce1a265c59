"""Small tables with the awkward rows every operator has to take."""

import random

import pyarrow as pa

WORDS = [a + b for a in "ba de fi go lu mi no pe ra su ta vo".split() for b in "ban den fil gor lum mir nop pes rat sul".split()]


def prose(seed, words=80):
    chosen = random.Random(seed)
    return " ".join(chosen.choice(WORDS) for _ in range(words))


def edited(text, edits, seed):
    """The text with some words replaced, dropped or added."""
    chosen, words = random.Random(seed), text.split()
    for k in range(edits):
        at = chosen.randrange(len(words))
        kind = chosen.randrange(3)
        if kind == 0:
            words[at] = f"new{seed}x{k}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"more{seed}x{k}")
    return " ".join(words)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (9001, None, None, None, None),
    (9002, "", "en", "src0", 0),
    (9003, " \t\n ", "en", None, 4),
    (9004, "!!! ...", None, "src1", 7),
    (9005, "x" * 200_000, "en", "src0", 200_000),
    (9006, "one word " * 30_000, "en", "src0", 270_000),
    (9007, prose(7), "en", "src0", 1),
    (9007, prose(7), "en", "src0", 1),
    (None, prose(8), "en", "src0", 1),
    (9008, "日本語 \U0001f600 text", "xx", "é", 3),
]


def documents(spark, rows=AWKWARD, clash=()):
    """A documents table; `clash` adds columns with names an operator may use itself."""
    frame = spark.createDataFrame(list(rows), SCHEMA)
    for name in clash:
        frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    return frame


def batch(texts):
    return pa.array(texts, pa.string())
