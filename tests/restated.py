"""Plain Python statements of the semantics, for comparison with the Spark expressions."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def tokens(s: str) -> int:
    raw = s.encode()
    if not raw:
        return 0
    if sum(b < 128 for b in raw) / len(raw) < 0.85:
        return max(1, sum(c == "\n" or c not in SPACE for c in s))
    total = 0
    for piece in re.findall(rb"[A-Za-z0-9_]+|[^A-Za-z0-9_]", raw):
        if not re.match(rb"[A-Za-z0-9_]", piece):
            total += piece not in (b" ", b"\t")
            continue
        word = piece.decode()
        total += 1
        began_upper = now_upper = word[0].isupper()
        for c in word[1:]:
            if c.isalpha():
                now_upper = c.isupper()
            total += now_upper != began_upper
        total += sum(math.ceil(len(run) / 3) for run in re.findall("[0-9]+", word[1:]))
    return max(1, total)


def glob(pattern: str, path: str, is_dir: bool = False) -> bool:
    pattern = pattern.strip()
    if not pattern or pattern[0] == "#":
        return False
    pattern = pattern.removeprefix("!")
    if pattern.endswith("/"):
        if not is_dir:
            return False
        pattern = pattern[:-1]
    anchored = pattern.startswith("/")
    pattern = pattern.removeprefix("/")
    names = [path]
    if not anchored and "/" not in pattern:
        parts = path.split("/")
        names = ["/".join(parts[i:]) for i in range(len(parts))]
    return any(_match(pattern.encode(), n.encode()) for n in names)


@lru_cache(maxsize=200_000)
def _match(p: bytes, n: bytes) -> bool:
    if not p:
        return not n
    if p[:2] == b"**":
        rest = p[2:].removeprefix(b"/") if n else p[2:]
        return any(_match(rest, n[i:]) for i in range(len(n) + 1))
    if p[:1] == b"*":
        stop = n.find(b"/")
        stop = len(n) if stop < 0 else stop
        return any(_match(p[1:], n[i:]) for i in range(stop + 1))
    if not n:
        return False
    c, rest = n[:1], n[1:]
    if p[:1] == b"?":
        return c != b"/" and _match(p[1:], rest)
    if p[:1] == b"[":
        end = p.find(b"]", 1)
        body, after = (p[1:], b"") if end < 0 else (p[1:end], p[end + 1 :])
        negated = body[:1] in (b"!", b"^")
        body = body[negated:]
        hit = any(
            (i[0] <= c[0] <= i[2]) if len(i) == 3 else i == c for i in re.findall(rb"(?s).-.|.", body)
        )
        return c != b"/" and hit != negated and _match(after, rest)
    if p[:1] == b"\\":
        return len(p) > 1 and p[1:2] == c and _match(p[2:], rest)
    return p[:1] == c and _match(p[1:], rest)


def ignored(rules: list[str], path: str, is_dir: bool) -> bool:
    verdict = False
    for line in rules:
        line = line.strip()
        if not line or line.startswith("#") or not line.removeprefix("!").removesuffix("/").removeprefix("/"):
            continue
        if glob(line, path, is_dir):
            verdict = not line.startswith("!")
    return verdict


def strip_c(s: str) -> str:
    out, i = [], 0
    while i < len(s):
        two = s[i : i + 2]
        if two == "//":
            end = s.find("\n", i)
            i = len(s) if end < 0 else end
        elif two == "/*":
            end = s.find("*/", i + 2)
            end = len(s) if end < 0 else end + 2
            out.append("\n" * s.count("\n", i, end))
            i = end
        elif s[i] in "\"'`":
            j = i + 1
            while j < len(s) and s[j] != s[i]:
                j += 2 if s[j] == "\\" and s[i] != "`" else 1
            out.append(s[i : j + 1])
            i = j + 1
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def strip_hash(s: str) -> str:
    out, i = [], 0
    while i < len(s):
        if s[i] == "#":
            end = s.find("\n", i)
            i = len(s) if end < 0 else end
        elif s[i] in "\"'":
            j = i + 1
            while j < len(s) and s[j] != s[i]:
                j += 2 if s[j] == "\\" else 1
            out.append(s[i : j + 1])
            i = j + 1
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def _newlines(m: re.Match) -> str:
    return "\n" * m.group().count("\n")


def strip_lua(s: str) -> str:
    return re.sub(r"(?s)--\[\[.*?\]\]|--[^\n]*", _newlines, s)


def strip_sql(s: str) -> str:
    return re.sub(r"(?s)/\*.*?\*/", _newlines, re.sub(r"--[^\n]*", "", s))


def strip_xml(s: str) -> str:
    return re.sub(r"(?s)<!--.*?-->", _newlines, s)


def drop_empty(s: str) -> str:
    return "\n".join(x for x in s.split("\n") if x.strip(SPACE))


def number(s: str) -> str:
    rows = s.split("\n")
    width = len(str(len(rows)))
    if rows[-1] == "":
        rows = rows[:-1]
    return "\n".join(f"{i:>{width}} | {x}" for i, x in enumerate(rows, 1))


def base64(s: str) -> str:
    return re.sub(r"[A-Za-z0-9+/]{60,}={0,2}", lambda m: f"[base64 omitted, {len(m.group())} chars]", s)


def compress_braces(s: str, words: list[str]) -> str:
    kept, depth = [], 0
    for x in s.split("\n"):
        net = x.count("{") - x.count("}")
        if depth:
            depth = max(0, depth + net)
            if not depth:
                kept.append("  // ...")
            continue
        kept.append(x)
        t = x.strip(SPACE)
        comment = t.startswith(("//", "/*", "*"))
        if not comment and x.lstrip("\t\n\f\r ").startswith(tuple(words)) and net > 0:
            depth = net
    return "\n".join(kept)


def compress_python(s: str, words: list[str]) -> str:
    kept, hide = [], None
    for x in s.split("\n"):
        bare = x.lstrip("\t\n\f\r ")
        indent = len(x) - len(bare)
        if not x.strip(SPACE):
            kept.append(x)
        elif bare.startswith(tuple(words)):
            kept.append(x)
            if x.strip(SPACE).endswith(":"):
                hide = indent
                kept.append(" " * (indent + 4) + "# ...")
        elif hide is None or indent <= hide:
            hide = None
            kept.append(x)
    return "\n".join(kept)


def entropy(s: str) -> float:
    raw = s.encode()
    return -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values())


def scan(s: str, rules: list[tuple[str, str, float]]) -> list[tuple[int, str]]:
    """(line, rule) in rule order, then text order."""
    found = []
    for name, pattern, least in rules:
        for m in re.finditer(pattern.replace(r"[^\s]", r"[^\t\n\f\r ]").replace(r"'\"\s]", "'\"\\t\\n\\f\\r ]")
                             .replace(r"\s*", r"[\t\n\f\r ]*"), s):
            if least and entropy(m.group()) < least - 1e-9:
                continue
            found.append((s.count("\n", 0, m.start()) + 1, name))
    return found


def fence(s: str) -> str:
    longest = max(len(x) - len(x.lstrip("`")) for x in s.split("\n"))
    return "`" * (longest + 1 if longest >= 3 else 3)


def looks_binary(raw: bytes) -> bool:
    head = raw[:8192]
    if b"\0" in head:
        return True
    invalid, i = 0, 0
    while i < len(head):
        for n in (1, 2, 3, 4):
            try:
                head[i : i + n].decode("utf-8")
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            invalid += 1
            i += 1
    return bool(head) and invalid / len(head) > 0.10


def split_parts(raw: bytes, limit: int) -> list[bytes]:
    parts = []
    while len(raw) > limit:
        cut = raw.rfind(b"\n", 0, limit)
        cut = limit if cut <= 0 else cut
        parts.append(raw[:cut])
        raw = raw[cut:].removeprefix(b"\n")
    return parts + [raw] if raw or not parts else parts
