"""Text normalisation as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII character classes. What the simple tokeniser deletes is all but white space and printables.
SPACE = r" \t\n\x0B\f\r"
NON_ASCII = r"[^\x00-\x7F]"
DELETED = r"[^\x09-\x0D\x20-\x7E]+"


def strip_non_ascii(col: Column) -> Column:
    return F.regexp_replace(col, NON_ASCII, "")


def has_non_ascii(col: Column) -> Column:
    return F.octet_length(col) != F.char_length(col)


def is_blank(col: Column) -> Column:
    """Nothing but spaces and tabs; an empty string is blank too."""
    return col.rlike(r"\A[ \t]*\z")


def _letters_and_gaps(col: Column) -> Column:
    """Lower-cased ASCII without control characters: letters, digits, punctuation and white space are left.

    Non-ASCII characters go first, so that folding case never turns one of them into ASCII.
    """
    return F.lower(F.regexp_replace(col, DELETED, ""))


def simple_tokenize(col: Column) -> Column:
    """Lower-cased ASCII words separated by one space."""
    return F.trim(F.regexp_replace(_letters_and_gaps(col), "[^a-z0-9]+", " "))


def simple_words(col: Column) -> Column:
    """The words of :func:`simple_tokenize`; the empty text gives one empty word."""
    return F.split(simple_tokenize(col), " ")


def split_words(col: Column) -> Column:
    """Non-blank words, case kept, split on any ASCII whitespace."""
    return F.filter(F.split(col, f"[{SPACE}]+"), lambda w: w != "")


def clean_tokens(col: Column) -> Column:
    """Drop tokens without an ASCII letter or digit, fold case, join by one space."""
    words = F.filter(split_words(col), lambda w: w.rlike("[A-Za-z0-9]"))
    return F.lower(F.array_join(words, " "))
