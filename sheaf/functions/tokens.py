"""Token estimates without a vocabulary.

A word is a maximal run of ``[A-Za-z0-9_]``. Text that is mostly ASCII counts one
token per word and per other byte that is not a space or tab, plus

* one per byte after the first that stands in the "other" letter case than the
  word began in (from a lower-case letter on in ``Hello``, from an upper-case
  letter on in ``fooBar`` or ``_Bar``), and
* one per started group of three digits after a word's first byte.

Each count is the length of what a ``regexp_replace`` leaves over, so the estimate is
a few linear passes and never builds an array of words. Words of lower-case letters
alone add nothing beyond the first count; they are taken out before the others.

The patterns say ``\\w`` and ``\\W`` (ASCII in Java) rather than ``[^A-Za-z0-9_]``: negated
unions of ranges are slow in Java and do not scale over the threads of one JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions.text import col, once

# leaves the first byte of every word and every counted non-word byte
WORDS_AND_MARKS = r"(\w)\w*+[ \t]*+|[ \t]++"
# takes out stretches of marks and plain lower-case words, leaving the other words
PLAIN_STRETCHES = r"\W++(?:[a-z_]++\W++)*+"
# leaves one digit per started group of three that follows a word byte
DIGIT_GROUPS = r"(?<=\w)(\d)\d{0,2}|\D++|\d"
# leaves the lower-case stretches of words that start upper-case
LOWER_STRETCHES = r"(?<!\w)[a-z0-9_]\w*+|\W++|[A-Z][A-Z0-9_]*+"
# leaves the upper-case stretches of all other words
UPPER_STRETCHES = r"(?<!\w)(?:[A-Z]\w*+|[0-9_][a-z0-9_]*+)|\W++|[a-z][a-z0-9_]*+"


def _left_over(text: Column, pattern: str, keep: str = "") -> Column:
    return F.octet_length(F.regexp_replace(text, pattern, keep))


def tokens_ascii(text: str | Column) -> Column:
    c = col(text)
    extra = once(
        F.regexp_replace(c, PLAIN_STRETCHES, " "),
        lambda words: _left_over(words, DIGIT_GROUPS, "$1")
        + _left_over(words, LOWER_STRETCHES)
        + _left_over(words, UPPER_STRETCHES),
    )
    return F.greatest(F.lit(1), _left_over(c, WORDS_AND_MARKS, "$1") + extra)


def tokens_unicode(text: str | Column) -> Column:
    """Code points that are not white space, plus newlines; at least one."""
    blank = fv.UNICODE_SPACE.replace(r"\n", "")
    return F.greatest(F.lit(1), F.char_length(F.regexp_replace(col(text), f"[{blank}]++", "")))


def estimate_tokens(text: str | Column) -> Column:
    c = col(text)
    size = F.octet_length(c)
    ascii_bytes = F.octet_length(F.regexp_replace(c, r"\P{ASCII}++", ""))
    return (
        F.when(size == 0, 0)
        .when((size != F.char_length(c)) & (ascii_bytes / size < fv.ASCII_RATIO), tokens_unicode(c))
        .otherwise(tokens_ascii(c))
    )
