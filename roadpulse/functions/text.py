"""Text expressions over whole descriptions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character Python's str methods treat as blank.
_BLANK = r"\s\x1C-\x1F"


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^[{_BLANK}]+|[{_BLANK}]+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?U)([^{_BLANK}]+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def mentions(column: str, substrings: tuple[str, ...]) -> Column:
    """1 when any literal substring occurs (substring, not word, semantics)."""
    quoted = [part.replace("\\", "\\\\").replace("'", "\\'") for part in substrings]
    hits = " OR ".join(f"contains(`{column}`, '{part}')" for part in quoted)
    return F.expr(f"CASE WHEN {hits} THEN 1 ELSE 0 END")


def word_char_grams(text: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams that stay inside one blank-padded, lower-cased word.

    Words are set two blanks apart, so a window that leaves its word is exactly one
    holding a double blank. A look-ahead reads the window at every character.
    """
    spaced = F.concat(F.lit(" "), F.regexp_replace(
        strip_blanks(F.lower(text)), rf"(?U)[{_BLANK}]+", "  "), F.lit(" "))
    return F.concat(*[
        F.regexp_extract_all(spaced, F.lit(rf"(?s)(?=((?:(?!  ).){{{n - 1}}}.))."), F.lit(1))
        for n in sizes])
