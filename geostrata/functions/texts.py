"""Tags, terms and keywords of a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from geostrata.functions.stopwords import STOPWORDS


def java_split(text: Column, separator: str = ",") -> Column:
    """Parts of a text, without empty ones at its end; "" has one part, a text of separators only has none."""
    trimmed = F.regexp_replace(text, f"[{separator}]+$", "")
    return F.when(text == "", F.array(F.lit(""))).when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{separator}]"))


def tags(text: Column) -> Column:
    """Comma-separated tags as they are written; repeated ones count each time."""
    return java_split(text)


def folded_tags(text: Column) -> Column:
    """Distinct tags in lower case, which keywords are compared with."""
    return F.array_distinct(java_split(F.lower(text)))


def terms(text: Column) -> Column:
    """Distinct words between spaces, in the case they have."""
    return F.array_distinct(java_split(text, " "))


def without_stopwords(words: Column) -> Column:
    """Distinct words that aren't stop words. Each is looked up in a set, not compared with the list."""
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOPWORDS)))


def contains_all(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a text's tags hold all keywords, case aside. A cheap search for the bare string goes first: it spares most
    texts the splitting, and plans push it to sources that can use it."""
    folded = F.lower(text)
    have = folded_tags(text)
    return reduce(lambda a, b: a & b, [folded.contains(k) & F.array_contains(have, k) for k in map(str.lower, keywords)], F.lit(True))
