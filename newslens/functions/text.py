"""Text as the query language sees it: lower-case words with single spaces between and around."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_END = r"[.!?]+\s+"


def norm(text: Column) -> Column:
    """`` the words of a text ``; a null text has none. Worth storing: each predicate on it is a plain substring test."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def term_words(term: str) -> list[str]:
    """The words of a query term, by the rule of ``norm``."""
    kept = "".join(c if c.isalnum() else " " for c in term.lower())
    return kept.split()


def has(normed: Column, term: str) -> Column:
    """A keyword, or the words of a phrase in a row. A term without a word matches everything."""
    words = term_words(term)
    return F.contains(normed, F.lit(f" {' '.join(words)} ")) if words else F.lit(True)


def near(normed: Column, terms: list[str], distance: int) -> Column:
    """All pairs of words at most ``distance`` places apart, in either order."""

    def pair(a: str, b: str) -> Column:
        gap = f"(?:[^ ]+ ){{0,{max(0, distance - 1)}}}"
        a, b = re.escape(a), re.escape(b)
        return normed.rlike(f" {a} {gap}{b} | {b} {gap}{a} ")

    words = [w for t in terms for w in term_words(t)]
    if len(words) < 2:
        return has(normed, " ".join(words))
    return reduce(lambda x, y: x & y, [pair(a, b) for a, b in combinations(words, 2)])


def occurrences(normed: Column, term: str) -> Column:
    """How often a term occurs, without overlaps."""
    wanted = f" {'  '.join(term_words(term))} "
    # with doubled spaces each word has its own delimiters, so neighbours don't share one
    doubled = F.replace(normed, F.lit(" "), F.lit("  "))
    return ((F.length(doubled) - F.length(F.replace(doubled, F.lit(wanted), F.lit("")))) / len(wanted)).cast("bigint")


def repeats(normed: Column, term: str, least: int) -> Column:
    return occurrences(normed, term) >= least


def tokens(normed: Column) -> Column:
    return F.filter(F.split(normed, " "), lambda w: w != "")


def places(normed: Column, word: str) -> Column:
    """Where a word stands, counted in words."""
    return F.filter(F.transform(tokens(normed), lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())


def sentences(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SENTENCE_END)


def is_quote(sentence: Column) -> Column:
    """Whether a sentence holds a quoted stretch."""
    return sentence.rlike('"[^"]+"')
