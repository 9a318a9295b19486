"""Regular expressions that mean the same in Spark (Java) as where they were written for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

#: Blanks of ASCII; other blanks are ordinary characters here.
BLANKS = r"[ \t\n\r\f\x0B]+"


def ascii_words(pattern: str) -> str:
    """A pattern whose word boundaries look at ASCII letters only, as Java's own don't."""
    return pattern.replace(r"\b", _BOUNDARY)


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs in a text. On texts of ASCII alone Java's own word boundaries are the same, and faster."""
    if r"\b" not in pattern:
        return text.rlike(pattern)
    return F.when(F.length(text) == F.octet_length(text), text.rlike(pattern)).otherwise(text.rlike(ascii_words(pattern)))


def squeeze(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def first_match(text: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first pattern that a text matches, else null."""
    return F.coalesce(*[F.when(matches(text, p), v) for v, p in table])


def all_matches(text: Column, table: list[tuple[str, str]]) -> Column:
    """The values of all patterns that a text matches, in the table's order."""
    return F.filter(F.array(*[F.when(matches(text, p), v) for v, p in table]), lambda x: x.isNotNull())


def some(text: Column) -> Column:
    """A text, or null where it is empty."""
    return F.when(text != "", text)


def map_of(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
