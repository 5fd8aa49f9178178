"""Text helpers shared by the operators: extensions, lines, bytes, white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf import fixed_values as fv

STRINGS = "array<string>"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rows_of(array: str | Column) -> Column:
    """``explode`` for arrays that cost something to compute.

    The plain form makes Spark add a filter on the array's size, which computes the array
    a second time. Callers drop the null row of an empty array where one can occur.
    """
    return F.explode_outer(array)


def file_ext(path: str | Column) -> Column:
    """Lower-cased extension with its dot; '' where the last path element has none."""
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]*)\z", 1))


def has_ext(path: str | Column, extensions: list[str]) -> Column:
    return file_ext(path).isin(extensions)


def lines(text: str | Column) -> Column:
    return F.split(col(text), "\n", -1)


def newlines_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]++", "")


def count_text(text: Column, piece: str) -> Column:
    """Occurrences of a one-byte ``piece``."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(piece), F.lit("")))


def trim_space(text: str | Column) -> Column:
    """Trim Unicode white space on both sides; Spark's own ``trim`` drops blanks only."""
    sp = fv.UNICODE_SPACE
    return F.regexp_extract(col(text), rf"(?s)\A[{sp}]*+(.*[^{sp}])?", 1)


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{fv.UNICODE_SPACE}]")


def byte_view(text: str | Column) -> Column:
    """The UTF-8 bytes as one character each, so that a regex can count and match bytes."""
    c = col(text)
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, c).otherwise(F.decode(c.cast("binary"), "ISO-8859-1"))


def ancestors(path: str | Column) -> Column:
    """Directories above a path, outermost first: ``a/b/c`` gives ``[a, a/b]``."""

    def prefixes(parts: Column) -> Column:
        depth = F.size(parts) - 1
        return F.when(
            depth > 0,
            F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
        ).otherwise(F.array().cast(STRINGS))

    return once(F.split(col(path), "/", -1), prefixes)


def parent_dir(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"(?s)\A(.*)/[^/]*\z", 1)


def base_name(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)\z", 1)


def count_chars(text: str | Column) -> Column:
    return F.char_length(col(text))


def count_lines(text: str | Column) -> Column:
    """Newlines, plus one for a last line that does not end in one."""
    c = col(text)
    open_line = F.when((F.octet_length(c) > 0) & ~c.endswith("\n"), 1).otherwise(0)
    return count_text(c, "\n") + open_line


def human_size(n: str | Column) -> Column:
    """``1.43 MB`` style sizes on a base of 1024; ties round to even."""
    c = col(n)

    def scaled(unit: int, name: str) -> Column:
        return F.format_string(f"%.2f {name}", F.bround(c / F.lit(float(unit)), 2))

    return (
        F.when(c >= 1024**3, scaled(1024**3, "GB"))
        .when(c >= 1024**2, scaled(1024**2, "MB"))
        .when(c >= 1024, scaled(1024, "KB"))
        .otherwise(F.concat(c.cast("string"), F.lit(" B")))
    )


def looks_binary(raw: str | Column) -> Column:
    """Content sniff on a BINARY column: a NUL, or over 10 % invalid UTF-8, in the first 8 KiB.

    The bytes are viewed as ISO-8859-1 characters; taking out every well-formed UTF-8
    sequence leaves exactly the invalid bytes, so no Python is needed.
    """
    head = F.substring(col(raw), 1, fv.SNIFF_BYTES)
    well_formed = (
        r"[\x00-\x7F]++|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]"
        r"|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
        r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
    )
    view = F.decode(head, "ISO-8859-1")
    invalid = F.char_length(F.regexp_replace(view, well_formed, ""))
    ratio = invalid / F.octet_length(head)
    valid = F.is_valid_utf8(head.cast("string"))
    return F.when(F.position(F.lit(b"\x00"), head) > 0, True).when(valid, False).otherwise(
        ratio > fv.INVALID_RATIO
    )
