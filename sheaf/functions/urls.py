"""Repository addresses: is it one, and what does it name?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import once, trim_space

SHORTHAND = r"\A[A-Za-z0-9_][A-Za-z0-9._-]*/[A-Za-z0-9_][A-Za-z0-9._-]*\z"
_URL = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)"
FIELDS = ("url", "host", "owner", "repo", "branch", "subdir", "error")


def is_remote_url(address: str | Column) -> Column:
    a = trim_space(address)
    return a.rlike(SHORTHAND) | a.rlike(r"\A(?:https?://|git://|ssh://|git@)")


def _spec(**fields: Column | str) -> Column:
    def text(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(*[text(fields.get(f, "")).cast("string").alias(f) for f in FIELDS])


def _segment(parts: Column, i: int) -> Column:
    return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))


def _web_fields(scheme: Column, host: Column, parts: Column) -> Column:
    n = F.size(parts)
    owner = F.when(n >= 2, _segment(parts, 0)).otherwise("")
    repo = F.when(n >= 2, F.regexp_replace(_segment(parts, 1), r"\.git\z", "")).otherwise("")
    deep = (n >= 4) & _segment(parts, 2).isin("tree", "blob")
    below = F.array_join(F.slice(parts, F.lit(5), F.greatest(F.lit(0), n - 4)), "/")
    return _spec(
        url=F.concat(scheme, F.lit("://"), host, F.lit("/"), owner, F.lit("/"), repo, F.lit(".git")),
        host=host,
        owner=owner,
        repo=repo,
        branch=F.when(deep, _segment(parts, 3)).otherwise(""),
        subdir=F.when(deep, below).otherwise(""),
    )


def _web_spec(a: Column) -> Column:
    scheme = F.lower(F.regexp_extract(a, _URL, 1))
    host = F.regexp_replace(F.regexp_extract(a, _URL, 2), r"\A.*@", "")
    quoted = F.regexp_extract(a, _URL, 3)
    path = F.try_url_decode(F.replace(quoted, F.lit("+"), F.lit("%2B")))
    no_host = F.concat(F.lit('url has no host: "'), a, F.lit('"'))
    seen = F.struct(
        scheme.alias("scheme"),
        host.alias("host"),
        F.split(F.regexp_replace(path, r"\A/+|/+\z", ""), "/", -1).alias("parts"),
    )

    def checked(u: Column) -> Column:
        good_host = u["host"].rlike(r"\A(?:\[[^\]]*\]|[^: <>\"]*)(?::[0-9]*)?\z")
        return (
            F.when(u["host"] == "", _spec(error=no_host))
            .when(u["parts"].isNull(), _spec(error="invalid url escape"))
            .when(~good_host, _spec(error="invalid host"))
            .otherwise(_web_fields(u["scheme"], u["host"], u["parts"]))
        )

    return F.when(a.rlike(r"[\x00-\x1F\x7F]"), _spec(error="invalid control character in url")).otherwise(
        once(seen, checked)
    )


def parse_repo_url(address: str | Column) -> Column:
    """Struct ``url, host, owner, repo, branch, subdir, error``; absent parts are ''."""
    return once(trim_space(address), _parse)


def _parse(a: Column) -> Column:
    ssh_path = F.regexp_replace(F.regexp_extract(a, r"(?s)\Agit@[^:]*:(.*)\z", 1), r"\.git\z", "")
    ssh = _spec(
        url=a,
        host=F.regexp_extract(a, r"(?s)\Agit@([^:]*):", 1),
        owner=F.substring_index(ssh_path, "/", 1),
        repo=F.regexp_extract(ssh_path, r"(?s)\A[^/]*/(.*)\z", 1),
    )
    shorthand = _spec(
        url=F.concat(F.lit("https://github.com/"), a, F.lit(".git")),
        host="github.com",
        owner=F.substring_index(a, "/", 1),
        repo=F.substring_index(a, "/", -1),
    )
    return (
        F.when(a == "", _spec(error="empty remote"))
        .when(a.rlike(r"\A(?:/|\./|\.\./|file://)"), _spec(url=a, host="local"))
        .when(a.rlike(SHORTHAND), shorthand)
        .when(a.rlike(r"(?s)\Agit@[^:]*\z"), _spec(error=F.concat(F.lit('invalid git@ url "'), a, F.lit('"'))))
        .when(a.startswith("git@"), ssh)
        .otherwise(_web_spec(a))
    )
