"""Column functions on text. ASCII classes throughout, so that Java's and RE2's regular expressions agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, each once, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the lower-cased text with white space collapsed and ASCII signs taken out."""
    return F.sha2(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"[!-/:-@\[-`{-~]", ""), r"\s+", " "), 256)


def token_estimate(text: Column) -> Column:
    """The default token counter: a quarter of the characters."""
    return F.floor(F.length(text) / 4)


def cache_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def slug(text: Column, words: int = 3) -> Column:
    """The first words, letters and digits only, capitalised and joined by underscores."""
    return F.array_join(F.transform(F.slice(F.split(F.trim(F.regexp_replace(text, r"[^A-Za-z0-9 ]+", "")), " +"), 1, words), F.initcap), "_")


def tidy(text: Column) -> Column:
    """White space collapsed, none before punctuation, and section abbreviations written out."""
    out = F.regexp_replace(text, r"\s+", " ")
    out = F.regexp_replace(out, r" ([,.;:])", "$1")
    return F.trim(F.regexp_replace(out, r"\b(Sec\.|S\.) ?([0-9])", "Section $2"))


def fix_ocr(text: Column) -> Column:
    """Common misreadings inside words, one rule after another."""
    for wrong, right in (("rn", "m"), ("cl", "d"), ("vv", "w")):
        text = F.regexp_replace(text, wrong, right)
    return text


def noise_confidence(text: Column) -> Column:
    """1 less ten times the share of characters outside letters, digits, white space and usual punctuation; not below 0."""
    odd = F.length(F.regexp_replace(text, r"[A-Za-z0-9\s.,;:()'\"-]", ""))
    return F.greatest(F.lit(0.0), 1 - 10.0 * odd / F.greatest(F.length(text), F.lit(1)))


def sentences(text: Column) -> Column:
    """Parts that end after . ! or ? and white space."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays; 0 for two empty ones."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def unsafe(text: Column) -> Column:
    """Whether a text looks like an injection."""
    return text.rlike(r"(?i)<script|javascript:|union\s+select|drop\s+table|;\s*--|\bor\s+1=1")


def is_email(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
