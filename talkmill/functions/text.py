"""Text expressions: whitespace, words, terms, windows and fingerprints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that ECMAScript counts as white space, ready for a regex class.
_SPACES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
           0x3000, 0xFEFF]
WS = "".join(map(chr, _SPACES))

# One character that is no white space. ASCII is told first: a class that lists every space asks each character for all of them, and is
# some twenty times slower. Java's nested classes, so for Spark only.
_WIDE_SPACES = "".join(chr(c) for c in _SPACES if c > 0x7F)
NOT_WS = rf"[\x21-\x7E[\S&&[^{_WIDE_SPACES}]]]"

# FTS5's unicode61 term characters. A term starts with a letter, a number or a private-use
# character and may go on with these combining marks.
TERM_START = r"\p{L}\p{N}\p{Co}"
_MARKS = [*range(0x300, 0x305), *range(0x306, 0x30D), 0x30F, 0x311, 0x31B, *range(0x323, 0x329), 0x32D, 0x32E, 0x330,
          0x331]
TERM_MARKS = "".join(map(chr, _MARKS))
TERM_PATTERN = f"[{TERM_START}]+(?:[{TERM_MARKS}][{TERM_START}{TERM_MARKS}]*)?"

# What counts as a keyword word.
KEYWORD_PATTERN = "[a-z0-9'-]+"

# Default window of the chunker.
WINDOW_CHARS = 8000
WINDOW_OVERLAP = 200


def strip_ws(text: Column) -> Column:
    """The text without white space at its ends. Only the ends are looked at, and a final U+0085, which is no white space, ends the text."""
    return F.trim(text, F.lit(WS))


def split_ws(text: Column) -> Column:
    """Non-empty white-space separated pieces, in order."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_WS}+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_WS}+"))


def terms(text: Column) -> Column:
    """Index terms of a text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def keyword_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(KEYWORD_PATTERN), F.lit(0))


def windows(text: Column, max_chars: int = WINDOW_CHARS, overlap: int = WINDOW_OVERLAP) -> Column:
    """Overlapping windows as array<struct<start_offset, end_offset, text>>; none for an empty text.

    Offsets count code points. The starts form an arithmetic sequence, so no loop is needed.
    """
    if max_chars <= 0:
        raise ValueError("max_chars must be greater than 0")
    if overlap >= max_chars:
        raise ValueError("overlap must be less than max_chars")
    step = max_chars - overlap
    size = F.length(text)
    extra = F.greatest(F.lit(0), size - F.lit(max_chars))
    last = (F.ceil(extra / F.lit(step)) * F.lit(step)).cast("int")
    starts = F.sequence(F.lit(0), last, F.lit(step))
    parts = F.transform(
        starts,
        lambda s: F.struct(
            s.alias("start_offset"),
            F.least(s + F.lit(max_chars), size).alias("end_offset"),
            F.substring(text, s + F.lit(1), F.lit(max_chars)).alias("text"),
        ),
    )
    return F.when(size > 0, parts)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def normalized_words(text: Column) -> Column:
    """Distinct words of a title: lower case, NFKC, letters and digits only, two characters or more.

    Spark has no NFKC function. ASCII text is unchanged by it, so only other text is handed to Python.
    """
    low = F.lower(text)
    folded = F.coalesce(_nfkc(F.when(low.rlike(r"[^\x00-\x7f]"), low)), low)
    return words_of_folded(folded)


def words_of_folded(folded: Column) -> Column:
    found = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= 2))


def fingerprint(text: Column, algorithm: str = "sha256") -> Column:
    """Content hash: SHA-256, or the short 32-bit polynomial form that older batches carry."""
    if algorithm == "sha256":
        return F.sha2(text, 256)
    if algorithm != "poly32":
        raise ValueError(f"unknown fingerprint algorithm: {algorithm}")
    mask = F.lit(0xFFFFFFFF)

    def add(h: Column, unit: Column) -> Column:
        return (h * F.lit(31) + unit).bitwiseAND(mask)

    def add_char(h: Column, char: Column) -> Column:
        point = F.ascii(char).cast("bigint")
        above = point - F.lit(0x10000)
        high = F.lit(0xD800) + F.shiftright(above, 10)
        low = F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))
        return F.when(point > 0xFFFF, add(add(h, high), low)).otherwise(add(h, point))

    def to_hex(h: Column) -> Column:
        signed = F.when(h > 0x7FFFFFFF, h - F.lit(0x100000000)).otherwise(h)
        return F.lpad(F.lower(F.hex(F.abs(signed))), 8, "0")

    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.aggregate(chars, F.lit(0).cast("bigint"), add_char, to_hex)


def phrase_regex(tokens: Column) -> Column:
    """Case-insensitive alternation of literal tokens."""
    special = r"([\.\*\+\?\^\$\{\}\(\)\|\[\]\\])"
    escaped = F.transform(tokens, lambda t: F.regexp_replace(t, special, r"\\$1"))
    return F.concat(F.lit("(?iu)("), F.array_join(escaped, "|"), F.lit(")"))
