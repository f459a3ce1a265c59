"""Text predicates shared by the request filter and the device classes."""

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the JVM counts it: ASCII blanks, file..unit separators, Unicode spaces.
_BLANK = r"[\s\x1c-\x1f\p{Z}]"


def alternation(tokens: list[str]) -> str:
    return "|".join(re.sub(r"([.?*+^$\[\]\\(){}|])", r"\\\1", token) for token in tokens)


def is_blank(text: Column) -> Column:
    return text.rlike(rf"\A{_BLANK}*\z")


def trim_blanks(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_BLANK}+|{_BLANK}+\z", "")


def _any_of(tokens: list[str]) -> str:
    """An expression for any of some lower-case tokens; a look at the next two letters skips most positions."""
    first, second = ("".join(sorted({token[place] for token in tokens})) for place in (0, 1))
    return f"(?=[{first}][{second}])(?:{alternation(tokens)})"


def contains_any(text: Column, tokens: list[str]) -> Column:
    """Any of some lower-case tokens: a few by plain search, many by one expression."""
    if len(tokens) <= 4:
        return reduce(or_, [text.contains(token) for token in tokens])
    return text.rlike(_any_of(tokens))


def contains_any_ignoring_case(text: Column, tokens: list[str]) -> Column:
    return text.rlike("(?iu)" + _any_of(tokens))


def ends_with_any(text: Column, suffixes: list[str]) -> Column:
    return text.rlike(rf"(?:{alternation(suffixes)})\z")


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
