"""Secret detection in one pass over a row: a substring test picks the rules whose regex runs at all.

Patterns are written as RE2 reads them and rewritten here for Java: RE2's ``\\s`` has
no vertical tab, and ignoring case there also equates the long s with "s" and the
Kelvin sign with "k".
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions.text import byte_view, col, newlines_only, once

LONG_S, KELVIN = "ſ", "K"
FINDINGS = "array<struct<rule_ord:int,match_ord:int,line:int,rule:string,match:string>>"


@dataclass(frozen=True)
class SecretRule:
    """``anchors``: texts of which one occurs in every match; empty means "always try"."""

    name: str
    pattern: str
    min_entropy: float = 0.0
    anchors: list[str] = field(default_factory=list, hash=False)


def builtin_rules() -> list[SecretRule]:
    return [SecretRule(n, p, e, fv.SECRET_ANCHORS[n]) for n, p, e in fv.SECRET_RULES]


def java_pattern(pattern: str) -> str:
    folded = pattern.startswith("(?i)")

    def rewrite(token: re.Match) -> str:
        t = token.group()
        if t.startswith("["):
            t = t.replace(r"\s", fv.ASCII_SPACE)
            if folded and re.search(r"[a-z]-[a-z]|[A-Z]-[A-Z]|[sSkK]", t.replace(r"\-", "")):
                t = t[:-1] + LONG_S + KELVIN + "]"
            return t
        if t == r"\s":
            return f"[{fv.ASCII_SPACE}]"
        if folded and t in "sS":
            return f"[s{LONG_S}]"
        if folded and t in "kK":
            return f"[k{KELVIN}]"
        return t

    return re.sub(r"(?s)\(\?\w+\)|\\.|\[\^?(?:\\.|[^\]\\])*\]|.", rewrite, pattern)


def shannon_entropy(text: str | Column) -> Column:
    """Bits per byte, summed in byte order."""
    view = byte_view(text)
    size = F.char_length(view)
    symbols = F.array_sort(F.array_distinct(F.regexp_extract_all(view, F.lit("(?s)."), F.lit(0))))

    def share(c: Column) -> Column:
        return (size - F.char_length(F.replace(view, c, F.lit("")))) / size

    return F.aggregate(symbols, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def redact(match: str | Column) -> Column:
    m = col(match)
    head, tail = F.left(m, F.lit(3)), F.right(m, F.lit(3))
    hidden = F.octet_length(m) - F.octet_length(head) - F.octet_length(tail)
    return F.when(F.octet_length(m) <= 8, "[redacted]").otherwise(
        F.concat(head, F.repeat(F.lit("*"), hidden), tail)
    )


def _may_match(content: Column, lowered: Column, rule: SecretRule) -> Column:
    if not rule.anchors:
        return F.lit(True)
    folded = rule.pattern.startswith("(?i)")
    haystack = lowered if folded else content
    tests = [F.contains(haystack, F.lit(a)) for a in rule.anchors]
    if folded and re.search("[sk]", "".join(rule.anchors)):
        tests += [F.contains(content, F.lit(LONG_S)), F.contains(content, F.lit(KELVIN))]
    result = tests[0]
    for t in tests[1:]:
        result = result | t
    return result


def _line_numbers(content: Column, pattern: Column, matches: Column) -> Column:
    """The 1-based line every match starts on, in linear time.

    The text is reduced to its newlines with one mark per match; the marks on the
    i-th line of that are the matches of line i.
    """
    marks = F.array_join(
        F.zip_with(
            F.split(content, pattern, -1),
            matches,
            lambda p, m: F.concat(
                newlines_only(p), F.when(m.isNull(), "").otherwise(F.concat(F.lit("\x01"), newlines_only(m)))
            ),
        ),
        "",
    )
    return F.flatten(
        F.transform(F.split(marks, "\n", -1), lambda x, i: F.array_repeat(i + 1, F.char_length(x)))
    )


def raw_matches(content: str | Column, pattern: Column) -> Column:
    """All non-overlapping matches of a Java pattern as array<struct<line, match_ord, text>>."""
    c = col(content)

    def numbered(matches: Column) -> Column:
        pairs = F.arrays_zip(matches.alias("text"), _line_numbers(c, pattern, matches).alias("line"))
        return F.transform(
            pairs,
            lambda m, i: F.struct(m["line"].alias("line"), (i + 1).alias("match_ord"), m["text"].alias("text")),
        )

    return once(F.regexp_extract_all(c, pattern, F.lit(0)), numbered)


def findings(content: str | Column, rules: list[SecretRule] | None = None) -> Column:
    """Findings of all rules on one text, in rule order and then text order.

    Plain substring tests pick the rules that can match at all, which for most texts
    is none; only those run their regex.
    """
    c = col(content)
    active = builtin_rules() if rules is None else rules
    if not active:
        return F.array().cast(FINDINGS)

    def rule_facts(i: int, r: SecretRule) -> Column:
        return F.struct(
            F.lit(i).alias("ord"),
            F.lit(r.name).alias("name"),
            F.lit(java_pattern(r.pattern)).alias("pattern"),
            F.lit(float(r.min_entropy)).alias("least"),
        )

    def candidates_of(lowered: Column) -> Column:
        return F.array(*[F.when(_may_match(c, lowered, r), rule_facts(i, r)) for i, r in enumerate(active, 1)])

    candidates = F.array_compact(once(F.lower(c), candidates_of))

    def found(rule: Column) -> Column:
        # the margin only absorbs rounding in the last digits of a sum of logarithms
        kept = F.filter(
            raw_matches(c, rule["pattern"]),
            lambda m: (rule["least"] <= 0) | (shannon_entropy(m["text"]) >= rule["least"] - 1e-9),
        )
        return F.transform(
            kept,
            lambda m: F.struct(
                rule["ord"].alias("rule_ord"),
                m["match_ord"].alias("match_ord"),
                m["line"].alias("line"),
                rule["name"].alias("rule"),
                redact(m["text"]).alias("match"),
            ),
        )

    return F.flatten(F.transform(candidates, found)).cast(FINDINGS)
