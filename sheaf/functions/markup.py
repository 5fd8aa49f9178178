"""Pieces of the four output styles for one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions.text import col, file_ext, lines


def text_concat(*parts: str | Column) -> Column:
    """Concatenate; plain strings are literals here, not column names."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def cdata_body(text: Column) -> Column:
    return F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>]]><![CDATA["))


def cdata(text: str | Column) -> Column:
    c = col(text)
    return F.when(c == "", "").otherwise(text_concat("<![CDATA[", cdata_body(c), "]]>"))


def _replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def xml_attr(text: str | Column) -> Column:
    return _replace_all(col(text), [("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")])


def xml_text(text: str | Column) -> Column:
    legal = F.regexp_replace(
        col(text), r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "�"
    )
    return _replace_all(
        legal,
        [("&", "&amp;"), ('"', "&#34;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"),
         ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")],
    )


def closed_line(text: Column) -> Column:
    """The text with a newline added where it does not end in one."""
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def code_fence(text: str | Column) -> Column:
    """A backtick fence one longer than any run of three or more that starts a line."""
    runs = F.transform(lines(text), lambda x: F.char_length(F.regexp_extract(x, r"\A(`*+)", 1)))
    longest = F.array_max(runs)
    c = col(text)
    return F.when(F.contains(c, F.lit("```")) & (longest >= 3), F.repeat(F.lit("`"), longest + 1)).otherwise("```")


def language_hint(path: str | Column) -> Column:
    ext = file_ext(path)
    result = None
    for hint, extensions in fv.LANGUAGE_HINTS.items():
        chain = F if result is None else result
        result = chain.when(ext.isin(extensions), hint)
    return result.otherwise("")


def xml_file(path: Column, content: Column) -> Column:
    return text_concat('    <file path="', xml_attr(path), '">', cdata(content), "</file>\n")


def markdown_file(path: Column, content: Column) -> Column:
    fence = code_fence(content)
    return text_concat(
        "### `", path, "`\n\n", fence, language_hint(path), "\n", closed_line(content), fence, "\n\n"
    )


def plain_file(path: Column, content: Column) -> Column:
    dashes = F.repeat(F.lit("-"), F.greatest(F.lit(0), 70 - F.octet_length(path)))
    return text_concat("---- ", path, " ", dashes, "\n", closed_line(content), "\n")


def json_file(path: Column, content: Column, skip_reason: Column, is_binary: Column, size: Column) -> Column:
    """One file as a JSON object. Skipped files appear with their reason; empty fields do not."""
    kept = skip_reason.isNull()
    return F.to_json(
        F.struct(
            path.alias("path"),
            F.when(kept & (content != ""), content).alias("content"),
            F.when(~kept & is_binary, F.lit(True)).alias("binary"),
            F.when(~kept, skip_reason).alias("skipped"),
            size.alias("bytes"),
        )
    )


def part_filename(base: str | Column, index: Column) -> Column:
    """``repo.xml`` and 2 give ``repo.2.xml``."""
    b = col(base)
    ext = F.regexp_extract(b, r"(\.[^./]*)\z", 1)
    return text_concat(F.left(b, F.char_length(b) - F.char_length(ext)), ".", index, ext)
