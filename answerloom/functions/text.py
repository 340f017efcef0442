"""Small text helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.fixed_values import WHITESPACE

# Character classes such as \s and \d cover all of Unicode, not only ASCII.
UNICODE = "(?U)"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def has_word(text: Column, words: Iterable[str]) -> Column:
    """One of the words occurs as a whole word, in any case."""
    return text.rlike(r"(?iU)\b(?:" + "|".join(words) + r")\b")


def ends_with_any(text: Column, suffixes: Iterable[str]) -> Column:
    found = F.lit(False)
    for suffix in suffixes:
        found = found | text.endswith(suffix)
    return found


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null when nothing matches. The group must not match an empty text."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
