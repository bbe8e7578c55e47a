"""Word and shingle expressions shared by the operators (JVM-side only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; quick for short or plain strings."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]``; a null text has none.

    Other white space becomes a blank first: a split at a single character needs no
    regular expression engine.
    """
    blank = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    return F.filter(F.split(blank, " "), lambda w: w != "")


def lower_words(text: Column) -> Column:
    """The words of ``text`` with A-Z lower-cased; plain text is lowered as a whole."""
    blank = F.coalesce(text, F.lit(""))
    plain = F.octet_length(blank) == F.length(blank)
    return F.when(plain, words(F.lower(blank))).otherwise(F.transform(words(blank), ascii_lower))


def shingle_hashes(tokens: Column, width: int = 5) -> Column:
    """Distinct 64-bit hashes of the word n-grams of ``tokens``, from the words' hashes.

    Fewer words than ``width`` make one shingle, no words make none. ``tokens`` holds the
    hashes of the words (see :func:`word_hashes`).
    """
    n = F.size(tokens)
    many = F.transform(
        F.sequence(F.lit(0), n - width),
        lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(width)]),
    )
    return (
        F.when(n >= width, F.array_distinct(many))
        .when(n > 0, F.array(F.xxhash64(F.lit(0), tokens)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def crc_mod(value: Column, modulus: int) -> Column:
    """crc32 of the decimal text of ``value``, modulo ``modulus``; null stays null."""
    return F.crc32(value.cast("string").cast("binary")) % modulus
