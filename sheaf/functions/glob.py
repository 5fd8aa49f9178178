r"""Ignore-file globs as regular expressions.

``*`` stays inside a path element, ``**`` crosses elements and takes one following
``/`` with it (so ``**/x`` also hits ``myx``), ``?`` is one byte, ``[...]`` a byte
class with ranges and ``!``/``^``, and ``\`` quotes. A pattern without ``/`` may match
from any element on. Regexes are matched against ``text.byte_view`` of a path.

The translation exists twice with one meaning: in Python for rules the program
states, and as a column expression for rules read from ignore files.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import byte_view, col, once, trim_space

NEVER = "(?!)"
_TOKEN = r"\*\*/?|\*|\?|\[[!^]?[^\]]*\]?|\\.|."
_ITEM = r".-.|."
_FLOATING = "(?:.*/)?"


@dataclass(frozen=True)
class Rule:
    pattern: str
    negate: bool = False
    dir_only: bool = False
    anchored: bool = False

    @property
    def regex(self) -> str:
        body = glob_body(self.pattern)
        return body if self.anchored or "/" in self.pattern else _FLOATING + body


def parse_rule(line: str) -> Rule | None:
    """One ignore-file line; None for blank lines, comments and bare markers."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    negate = line.startswith("!")
    line = line.removeprefix("!")
    dir_only = line.endswith("/")
    line = line.removesuffix("/")
    anchored = line.startswith("/")
    line = line.removeprefix("/")
    return Rule(line, negate, dir_only, anchored) if line else None


def parse_rules(patterns: list[str]) -> list[Rule]:
    return [r for r in map(parse_rule, patterns) if r]


def _latin(s: str) -> str:
    return s.encode("utf-8").decode("latin-1")


def _quote(c: str) -> str:
    return c if c.isascii() and c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c


def _piece(token: str) -> str:
    if token.startswith("**"):
        return ".*"
    if token == "*":
        return "[^/]*"
    if token == "?":
        return "[^/]"
    if token == "\\":
        return NEVER
    if token[0] == "\\":
        return _quote(token[1])
    if token[0] != "[":
        return _quote(token)
    body = token[1:].removesuffix("]")
    negated = body[:1] in ("!", "^")
    items = ""
    for item in re.findall(_ITEM, body[negated:], re.S):
        if item[0] <= item[-1]:
            items += f"\\x{ord(item[0]):02x}-\\x{ord(item[-1]):02x}"
    if negated:
        return f"[^/{items}]"
    return f"(?!/)[{items}]" if items else NEVER


def glob_body(pattern: str) -> str:
    return "".join(map(_piece, re.findall(_TOKEN, _latin(pattern), re.S)))


def whole(bodies: list[str]) -> str:
    return rf"(?s)\A(?:{'|'.join(bodies)})\z" if bodies else NEVER


def _quote_col(c: Column) -> Column:
    return F.regexp_replace(c, r"([^A-Za-z0-9_\x{80}-\x{10FFFF}])", r"\\$1")


def _class_col(token: Column) -> Column:
    body = F.regexp_replace(token, r"(?s)\A\[|\]\z", "")
    negated = body.rlike(r"\A[!^]")
    items = F.regexp_extract_all(F.regexp_replace(body, r"\A[!^]", ""), F.lit("(?s)" + _ITEM), F.lit(0))
    ordered = F.filter(items, lambda i: F.ascii(F.left(i, F.lit(1))) <= F.ascii(F.right(i, F.lit(1))))

    def code(c: Column) -> Column:
        return F.concat(F.lit("\\x"), F.lpad(F.hex(F.ascii(c)), 2, "0"))

    text = F.array_join(
        F.transform(ordered, lambda i: F.concat(code(F.left(i, F.lit(1))), F.lit("-"), code(F.right(i, F.lit(1))))),
        "",
    )
    return (
        F.when(negated, F.concat(F.lit("[^/"), text, F.lit("]")))
        .when(text == "", NEVER)
        .otherwise(F.concat(F.lit("(?!/)["), text, F.lit("]")))
    )


def glob_body_col(pattern: str | Column) -> Column:
    """``glob_body`` for a column of patterns."""
    tokens = F.regexp_extract_all(byte_view(pattern), F.lit("(?s)" + _TOKEN), F.lit(0))

    def piece(t: Column) -> Column:
        return (
            F.when(t.startswith("**"), ".*")
            .when(t == "*", "[^/]*")
            .when(t == "?", "[^/]")
            .when(t == "\\", NEVER)
            .when(t.startswith("\\"), _quote_col(F.substring(t, 2, 1)))
            .when(t.startswith("["), _class_col(t))
            .otherwise(_quote_col(t))
        )

    return F.array_join(F.transform(tokens, piece), "")


def rule_regex_col(pattern: str | Column, anchored: str | Column) -> Column:
    p = col(pattern)
    floating = ~col(anchored) & ~p.contains("/")
    body = F.concat(F.when(floating, _FLOATING).otherwise(""), glob_body_col(p))
    return F.concat(F.lit(r"(?s)\A(?:"), body, F.lit(r")\z"))


def parse_rule_col(line: str | Column) -> Column:
    """``parse_rule`` as a struct column; null where the line holds no rule."""

    def parsed(text: Column) -> Column:
        body = F.regexp_replace(text, r"\A!", "")
        pattern = F.regexp_extract(text, r"(?s)\A!?/?(.*?)/?\z", 1)
        rule = F.struct(
            pattern.alias("pattern"),
            text.startswith("!").alias("negate"),
            body.endswith("/").alias("dir_only"),
            body.rlike(r"(?s)\A/.").alias("anchored"),
        )
        return F.when((pattern != "") & ~text.startswith("#"), rule)

    return once(trim_space(line), parsed)


def last_match(path: Column, is_dir: bool, rules: list[Rule]) -> Column:
    """True / False as the last matching rule ignores / keeps ``path``; null if none matches.

    Walking the rules backwards makes "last match wins" the first true branch of a
    CASE. Neighbours of equal sign are one alternation, so the 87 default patterns
    cost a single regex and the rule list never becomes a join.
    """
    usable = [r for r in rules if is_dir or not r.dir_only]
    runs: list[tuple[bool, list[str]]] = []
    for rule in usable:
        if runs and runs[-1][0] == rule.negate:
            runs[-1][1].append(rule.regex)
        else:
            runs.append((rule.negate, [rule.regex]))
    result = F.lit(None).cast("boolean")
    for negate, bodies in runs:
        result = F.when(path.rlike(whole(bodies)), F.lit(not negate)).otherwise(result)
    return result


def glob_match(path: str | Column, pattern: str, is_dir: bool = False) -> Column:
    """Does one glob match? A leading ``!`` is dropped; a trailing ``/`` asks for a directory."""
    rule = parse_rule(pattern)
    if rule is None or (rule.dir_only and not is_dir):
        return F.lit(False)
    return byte_view(path).rlike(whole([rule.regex]))
