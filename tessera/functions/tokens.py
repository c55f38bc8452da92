"""Tokenizers and string distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Letters, digits and underscore of any script.
WORD_CHARS = r"\p{L}\p{N}_"


def keywords(text: Column) -> Column:
    """Runs of ASCII letters, lower-cased; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def words(text: Column) -> Column:
    """Words with inner apostrophes and hyphens, case kept."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{WORD_CHARS}]+(?:['-][{WORD_CHARS}]+)*"), F.lit(0))


def normalize(text: Column) -> Column:
    """Only word characters, lower-cased."""
    return F.lower(F.regexp_replace(text, f"[^{WORD_CHARS}]+", ""))


def qgrams(word: Column, q: int = 3) -> Column:
    """One q-gram for each character of the word padded on the left with q - 1 `$`; none for the empty word."""
    padded = F.concat(F.lit("$" * (q - 1)), word)
    grams = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(q)))
    return F.when(F.length(word) > 0, grams).otherwise(F.array().cast("array<string>"))


def prefix_distance(prefix: Column, word: Column, delta: Column | int) -> Column:
    """Least edit distance of prefix to any prefix of word, delta + 1 if it exceeds delta.

    Prefixes of word longer than that of prefix by more than delta can't be nearer, so they aren't tried.
    """
    delta = F.lit(delta) if isinstance(delta, int) else delta
    tried = F.transform(F.sequence(F.lit(0), F.least(F.length(prefix) + delta, F.length(word))), lambda n: F.levenshtein(prefix, F.substring(word, F.lit(1), n)))
    return F.least(delta + 1, F.array_min(tried)).cast("int")
