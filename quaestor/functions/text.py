"""Text column expressions. All of them stay inside the JVM.

The character classes equal Python's on `str` (checked over the basic plane):
white space, decimal digits and word characters are Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD_RUN = r"[\p{L}\p{N}_]+"
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"

# The three repair rules, in the order in which they apply.
REPAIR_RULES = (
    (r"([^\n])\1{3,}", "$1$1"),
    (SPACE + "+", " "),
    (r"([bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ])\1{2,}", "$1"),
)


def strip(col: Column) -> Column:
    """Remove white space at both ends; null becomes the empty string."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), rf"\A{SPACE}+|{SPACE}+\z", "")


def clean(
    col: Column,
    lowercase: bool = True,
    remove_punctuation: bool = True,
    remove_digits: bool = True,
) -> Column:
    """Lower-case, punctuation marks to spaces, delete digits, collapse white space."""
    out = F.coalesce(col, F.lit(""))
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = F.regexp_replace(out, r"\p{Punct}", " ")
    if remove_digits:
        out = F.regexp_replace(out, r"\p{Nd}+", "")
    return strip(F.regexp_replace(out, SPACE + "+", " "))


def words(col: Column) -> Column:
    """Lower-cased words made of ASCII letters only, in order, with repeats."""
    tokens = F.split(F.lower(F.coalesce(col, F.lit(""))), NON_WORD_RUN)
    return F.filter(tokens, lambda t: t.rlike("^[a-z]+$"))


def segments(col: Column) -> Column:
    """The text cut into alternating word and gap runs; joining them gives the text back."""
    return F.regexp_extract_all(col, F.lit(rf"({WORD_RUN}|{NON_WORD_RUN})"), F.lit(1))


def repair(col: Column) -> Column:
    """All repair rules, one after the other, on the whole text."""
    for pattern, replacement in REPAIR_RULES:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def token_sort_key(col: Column) -> Column:
    """Keep ASCII, marks to spaces, lower-case, sort the tokens."""
    ascii_only = F.regexp_replace(F.coalesce(col, F.lit("")), r"[^\x00-\x7F]", "")
    spaced = F.lower(F.regexp_replace(ascii_only, r"[^A-Za-z0-9_]", " "))
    tokens = F.filter(F.split(spaced, " +"), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def edit_confidence(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings give 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - F.levenshtein(a, b) / longest)
    )


def restore_case(original: Column, corrected: Column) -> Column:
    """Give the correction the original's upper or title case."""
    return (
        F.when(original.rlike("^[A-Z]+$"), F.upper(corrected))
        .when(
            original.rlike("^[A-Z][a-z]*$"),
            F.concat(F.upper(F.substring(corrected, 1, 1)), F.lower(F.substring(corrected, 2, 1 << 30))),
        )
        .otherwise(corrected)
    )
