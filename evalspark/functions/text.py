"""Column expressions on text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank, as a markup break and as a word.
BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
MARKUP_BREAK = r"<br\s*/?>"
WORD = r"[\p{L}\p{N}_]{2,}"
ELLIPSIS = " …"


def strip(col: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return rstrip(F.regexp_replace(col, rf"\A{BLANK}", ""))


def rstrip(col: Column) -> Column:
    return F.regexp_replace(col, rf"{BLANK}\z", "")


def strip_breaks(col: Column) -> Column:
    """Markup line breaks become one blank each; then both ends are stripped."""
    return strip(F.regexp_replace(col, MARKUP_BREAK, " "))


def truncate(col: Column, limit: int) -> Column:
    """Text over ``limit`` characters is cut there, right-stripped and marked with an ellipsis."""
    cut = F.concat(rstrip(F.substring(col, 1, limit)), F.lit(ELLIPSIS))
    return F.when(F.length(col) > limit, cut).otherwise(col)


def extract_title(name: Column) -> Column:
    """"Braund, Mr. Owen" -> "Mr": between the first comma and the next full stop.

    A name without a comma, with nothing there, or absent gives "Unknown".
    """
    second = F.get(F.split(name, ","), F.lit(1))
    title = strip(F.get(F.split(second, r"\."), F.lit(0)))
    return F.when(title.isNull() | (title == ""), F.lit("Unknown")).otherwise(title)


def words(col: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def without(tokens: Column, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(list(stop_words)))


def with_bigrams(tokens: Column) -> Column:
    """The tokens followed by every pair of neighbours."""
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(tokens, pairs)
