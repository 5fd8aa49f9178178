"""Text transforms of one document: comments, blank lines, line numbers, payloads, bodies.

Comment removal cuts a text into tokens that cover all of it (regexes with
possessive quantifiers, so long literals cannot exhaust the Java stack), empties
the comment tokens and joins the rest again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions.text import STRINGS, col, count_text, file_ext, is_blank, lines, newlines_only, once

_DOUBLE = r'"(?:[^"\\]|\\.)*+\\?+"?+'
_SINGLE = r"'(?:[^'\\]|\\.)*+\\?+'?+"
_TICKED = r"`[^`]*+`?+"

C_TOKENS = (
    r"(?s)//[^\n]*+|/\*.*?(?:\*/|\z)"
    rf"|(?:[^/\"'`]++|{_DOUBLE}|{_SINGLE}|{_TICKED}|/(?![/*]))++"
)
HASH_TOKENS = rf"(?s)#[^\n]*+|(?:[^#\"']++|{_DOUBLE}|{_SINGLE})++"


def _rebuild(text: Column, tokens: str, is_comment) -> Column:
    parts = F.regexp_extract_all(text, F.lit(tokens), F.lit(0))
    return F.array_join(F.transform(parts, lambda t: F.when(is_comment(t), newlines_only(t)).otherwise(t)), "")


def _blank_out(text: Column, comment: str, opener: str) -> Column:
    """Replace every match of ``comment`` by its newlines; ``opener`` starts every comment."""
    pieces = F.split(text, comment, -1)
    matches = F.regexp_extract_all(text, F.lit(comment), F.lit(0))
    joined = F.array_join(
        F.zip_with(pieces, matches, lambda p, m: F.concat(p, F.coalesce(newlines_only(m), F.lit("")))), ""
    )
    return F.when(F.contains(text, F.lit(opener)), joined).otherwise(text)


def strip_c_comments(text: str | Column) -> Column:
    c = col(text)
    stripped = _rebuild(c, C_TOKENS, lambda t: t.startswith("//") | t.startswith("/*"))
    return F.when(F.contains(c, F.lit("//")) | F.contains(c, F.lit("/*")), stripped).otherwise(c)


def strip_hash_comments(text: str | Column) -> Column:
    c = col(text)
    stripped = _rebuild(c, HASH_TOKENS, lambda t: t.startswith("#"))
    return F.when(F.contains(c, F.lit("#")), stripped).otherwise(c)


def strip_lua_comments(text: str | Column) -> Column:
    return _blank_out(col(text), r"(?s)--\[\[.*?\]\]|--[^\n]*+", "--")


def strip_sql_comments(text: str | Column) -> Column:
    """Line comments first, so a block that opens behind ``--`` is never one."""
    return _blank_out(F.regexp_replace(col(text), r"--[^\n]*+", ""), r"(?s)/\*.*?\*/", "/*")


def strip_xml_comments(text: str | Column) -> Column:
    return _blank_out(col(text), r"(?s)<!--.*?-->", "<!--")


def strip_comments(path: str | Column, text: str | Column) -> Column:
    ext = file_ext(path)
    return (
        F.when(ext.isin(fv.HASH_COMMENT_EXTENSIONS), strip_hash_comments(text))
        .when(ext.isin(fv.LUA_EXTENSIONS), strip_lua_comments(text))
        .when(ext.isin(fv.SQL_EXTENSIONS), strip_sql_comments(text))
        .when(ext.isin(fv.XML_COMMENT_EXTENSIONS), strip_xml_comments(text))
        .otherwise(strip_c_comments(text))
    )


def remove_empty_lines(text: str | Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: ~is_blank(x)), "\n")


def line_numbers(text: str | Column) -> Column:
    """``<n> | <line>`` with n right-aligned; an empty line after the last newline is not shown."""
    c = col(text)
    rows = lines(c)
    shown = F.when((c == "") | c.endswith("\n"), F.size(rows) - 1).otherwise(F.size(rows))
    parts = F.struct(
        F.slice(rows, F.lit(1), shown).alias("rows"), F.char_length(F.size(rows).cast("string")).alias("width")
    )

    def numbered(p: Column) -> Column:
        return F.array_join(
            F.transform(
                p["rows"], lambda x, i: F.concat(F.lpad((i + 1).cast("string"), p["width"], F.lit(" ")), F.lit(" | "), x)
            ),
            "\n",
        )

    return once(parts, numbered)


def truncate_base64(text: str | Column) -> Column:
    """One pass over the text finds the runs; only a text with several of them is read again for their lengths."""
    c = col(text)
    run = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{60,}+={0,2}+"  # a run always matches from its first byte

    def note(length: Column) -> Column:
        return F.concat(F.lit("[base64 omitted, "), length.cast("string"), F.lit(" chars]"))

    def shortened(pieces: Column) -> Column:
        first, second = F.get(pieces, F.lit(0)), F.get(pieces, F.lit(1))
        one = F.concat(first, note(F.char_length(c) - F.char_length(first) - F.char_length(second)), second)
        matches = F.regexp_extract_all(c, F.lit(run), F.lit(0))
        notes = F.zip_with(pieces, matches, lambda p, m: F.concat(p, F.coalesce(note(F.char_length(m)), F.lit(""))))
        return F.when(F.size(pieces) == 1, c).when(F.size(pieces) == 2, one).otherwise(F.array_join(notes, ""))

    return once(F.split(c, run, -1), shortened)


def _starts_with_any(words: list[str]) -> str:
    quoted = "|".join(w.replace("#", "\\#") for w in words)
    return rf"\A[{fv.ASCII_SPACE}]*+(?:{quoted})"


_SPANS = "array<struct<first:int,last:int>>"


def _compress_brace_lines(rows: Column, language: Column) -> Column:
    """Fold over the lines; the state grows only where a block closes.

    ``language`` is a place in ``BRACE_SIGNATURES``: their patterns are literals, which are compiled once and not
    for every line, and are only asked about lines that can open a block.

    ``depth`` is the brace depth of the open block (0 outside), ``start`` the line
    behind the signature, ``spans`` the line ranges to replace by the elision mark.
    """

    def signed(x: Column) -> Column:
        found = F.lit(None).cast("boolean")
        for i, (_, words) in enumerate(fv.BRACE_SIGNATURES):
            found = F.when(language == i, x.rlike(_starts_with_any(words))).otherwise(found)
        return found

    def facts(x: Column) -> Column:
        comment = x.rlike(rf"\A[{fv.UNICODE_SPACE}]*+(?:/[/*]|\*)")
        return F.struct(
            (count_text(x, "{") - count_text(x, "}")).alias("net"),
            (F.contains(x, F.lit("{")) & signed(x) & ~comment).alias("signature"),
        )

    def state(depth: Column, start: Column, spans: Column, n: Column) -> Column:
        return F.struct(depth.alias("depth"), start.alias("start"), spans.alias("spans"), n.alias("n"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        depth = s["depth"] + x["net"]
        outside = s["depth"] == 0
        span = F.array(F.struct(s["start"].alias("first"), n.alias("last")))
        return (
            F.when(outside & x["signature"] & (x["net"] > 0), state(x["net"], n + 1, s["spans"], n))
            .when(outside, state(F.lit(0), s["start"], s["spans"], n))
            .when(depth > 0, state(depth, s["start"], s["spans"], n))
            .otherwise(state(F.lit(0), s["start"], F.concat(s["spans"], span), n))
        )

    start = state(F.lit(0), F.lit(1), F.array().cast(_SPANS), F.lit(0))

    def finish(s: Column) -> Column:
        # what follows an unclosed signature is dropped without a mark
        shown = F.when(s["depth"] > 0, s["start"] - 1).otherwise(s["n"])
        kept = F.transform(
            s["spans"],
            lambda span, i: F.concat(
                _between(rows, _span_end(s["spans"], i) + 1, span["first"] - 1),
                F.array(F.lit(fv.ELISION_BRACES)),
            ),
        )
        tail = _between(rows, _span_end(s["spans"], F.size(s["spans"])) + 1, shown)
        return F.array_join(F.concat(F.flatten(kept), tail), "\n")

    return F.aggregate(F.transform(rows, facts), start, step, finish)


def _span_end(spans: Column, i: Column) -> Column:
    """Last line of the span before position ``i`` (0-based), 0 if there is none."""
    return F.when(i > 0, F.try_element_at(spans, i)["last"]).otherwise(F.lit(0))


def _between(rows: Column, first: Column, last: Column) -> Column:
    return F.slice(rows, first, F.greatest(F.lit(0), last - first + 1))


def compress_braces(path: str | Column, text: str | Column) -> Column:
    """Keep what stands outside braces and signature lines; bodies become one mark."""
    ext = file_ext(path)
    language = F.lit(None).cast("int")
    for i, (extensions, _) in enumerate(fv.BRACE_SIGNATURES):
        language = F.when(ext.isin(extensions), i).otherwise(language)
    parts = F.struct(lines(text).alias("rows"), language.alias("language"))
    every = [e for extensions, _ in fv.BRACE_SIGNATURES for e in extensions]
    compressed = once(parts, lambda p: _compress_brace_lines(p["rows"], p["language"]))
    return F.when(ext.isin(every), compressed).otherwise(col(text))


def compress_python(text: str | Column) -> Column:
    """Keep headers and blank lines; a header that ends in ``:`` hides the deeper lines below it."""
    return once(lines(text), _compress_python_lines)


def _compress_python_lines(rows: Column) -> Column:
    """The fold carries the indent of the hiding header (-1: none) and closes a range of
    kept lines whenever a hidden line or a mark follows it."""

    def facts(x: Column) -> Column:
        header = x.rlike(_starts_with_any(fv.PYTHON_HEADERS))
        return F.struct(
            F.char_length(F.regexp_extract(x, rf"\A([{fv.ASCII_SPACE}]*+)", 1)).alias("indent"),
            header.alias("header"),
            (header & x.rlike(rf":[{fv.UNICODE_SPACE}]*+\z")).alias("opens"),
            is_blank(x).alias("blank"),
        )

    def state(hide: Column, first: Column, out: Column, n: Column) -> Column:
        return F.struct(hide.alias("hide"), first.alias("first"), out.alias("out"), n.alias("n"))

    def span(first: Column, last: Column, mark: Column) -> Column:
        return F.array(F.struct(first.alias("first"), last.alias("last"), mark.alias("mark")))

    no_mark = F.lit(-1)

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        hidden = ~x["header"] & (s["hide"] >= 0) & (x["indent"] > s["hide"])
        flush = F.when(s["first"] < n, F.concat(s["out"], span(s["first"], n - 1, no_mark))).otherwise(s["out"])
        marked = F.concat(s["out"], span(s["first"], n, x["indent"] + 4))
        return (
            F.when(~x["blank"] & x["opens"], state(x["indent"], n + 1, marked, n))
            .when(x["blank"] | x["header"], state(s["hide"], s["first"], s["out"], n))
            .when(hidden, state(s["hide"], n + 1, flush, n))
            .otherwise(state(F.lit(-1), s["first"], s["out"], n))
        )

    start = state(F.lit(-1), F.lit(1), F.array().cast("array<struct<first:int,last:int,mark:int>>"), F.lit(0))

    def finish(s: Column) -> Column:
        kept = F.transform(
            s["out"],
            lambda o: F.concat(
                _between(rows, o["first"], o["last"]),
                F.when(
                    o["mark"] >= 0, F.array(F.concat(F.repeat(F.lit(" "), o["mark"]), F.lit(fv.ELISION_PYTHON)))
                ).otherwise(F.array().cast(STRINGS)),
            ),
        )
        return F.array_join(F.concat(F.flatten(kept), _between(rows, s["first"], s["n"])), "\n")

    return F.aggregate(F.transform(rows, facts), start, step, finish)


def compress_code(path: str | Column, text: str | Column) -> Column:
    return F.when(file_ext(path) == ".py", compress_python(text)).otherwise(compress_braces(path, text))

