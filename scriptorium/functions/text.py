"""Scalar expressions on words and tokens, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOFT_HYPHEN = "­"
# Characters stripped from both ends of a word before it is looked up.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANKS = " \t\n\r\x0b\x0c"
QUOTES = "»«“”„›‹"
# The white space at which running text is split into words.
SPACE_CLASS = "\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def effective(gold: Column, original: Column) -> Column:
    """The text that counts: the correction unless it is NULL or empty, else what was read."""
    return F.coalesce(F.nullif(gold, F.lit("")), original)


def clean(word: Column) -> Column:
    """The dictionary form: no hyphens anywhere, no punctuation, quotes or blanks at the ends."""
    return F.btrim(F.translate(word, SOFT_HYPHEN + "-", ""), F.lit(PUNCTUATION + BLANKS + QUOTES))


def letters(word: Column) -> Column:
    return F.regexp_count(word, F.lit("\\p{L}"))


def is_punctuation(word: Column) -> Column:
    return word.rlike("^\\p{P}+$")


def is_numeric(word: Column) -> Column:
    return word.rlike("^\\p{N}+$")


def ends_in_hyphen(word: Column, dashes: bool = False) -> Column:
    """Whether a word ends in a hyphen or soft hyphen; with ``dashes`` any dash counts."""
    return word.rlike("[\\p{Pd}\\x{ad}]+$" if dashes else "[\\x{ad}\\-]+$")


def term_key(text: Column) -> Column:
    """Index form of a word or term: lower case, no punctuation, then no blanks at the ends."""
    return F.btrim(F.btrim(F.lower(text), F.lit(PUNCTUATION)), F.lit(BLANKS))


def shown_hyphen(text: Column) -> Column:
    """A closing soft hyphen is shown as a plain one."""
    return F.regexp_replace(text, "\\x{ad}$", "-")


def split_words(text: Column) -> Column:
    """The words of running text, in order."""
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def characters(text: Column) -> Column:
    """The characters of a text as an array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def truth(text: Column) -> Column:
    """yes, true, t, y, 1 in any case are true, all else false."""
    return F.coalesce(F.lower(F.btrim(text)).isin("yes", "true", "t", "y", "1"), F.lit(False))


def stem(path: Column) -> Column:
    """The file name of a path without folders and last extension."""
    return F.regexp_extract(path, "([^/]*?)(\\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, "[^/.][^/]*?(\\.[^./]*)?$", 1)
