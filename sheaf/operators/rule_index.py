"""An index over ignore rules found in a corpus: a path meets only the rules that its own name lets match.

Every rule is filed under one key of its directory, the first of these that its pattern allows:

* ``n``: the path's last element, where the pattern ends in a whole literal element;
* ``e``: the path's extension, where the pattern ends in literal text with a dot;
* ``f``: the first element below the directory, where the pattern begins with a whole literal element;
* ``a``: any path.

A path asks, for each directory above it that has rules, for its own four keys. What comes back are single rules, so
no rule list lies on a row; the regex of a rule is tried on the paths that share its key, and of the rules that match
the deepest directory's last line wins by a maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import ancestors, base_name, byte_view, parent_dir
from sheaf.operators.joins import salted_lookup

KEY = "_key"


def _key(scope: Column, kind: str, value: Column) -> Column:
    return F.concat(scope, F.lit(f"\n{kind}\n"), value)


def rule_key() -> Column:
    """The key of a rule from ``scope_dir, pattern``; a rule that fits no narrow key is filed under ``a``."""
    p, scope = F.col("pattern"), F.col("scope_dir")
    # A class without its end takes the rest of the pattern; nothing behind it is literal.
    closed = ~p.rlike(r"\[[^\]]*\z")
    last = F.regexp_extract(p, r"([^/]*)\z", 1)
    whole = ~last.rlike(r"[*?\[\]\\]") & ~p.rlike(r"\*\*/[^/]*\z") & (last != "")
    tail = F.regexp_extract(p, r"([^/*?\[\]\\]*)\z", 1)
    first = F.regexp_extract(p, r"\A([^/*?\[\]\\]+)/", 1)
    return (
        F.when(closed & whole, _key(scope, "n", last))
        .when(closed & tail.contains("."), _key(scope, "e", F.regexp_extract(tail, r"([^.]*)\z", 1)))
        .when(first != "", _key(scope, "f", first))
        .otherwise(_key(scope, "a", F.lit("")))
    )


def indexed(rules: DataFrame) -> DataFrame:
    """Rules of ``scan_ignore_rules`` with their key."""
    return rules.select("scope_dir", rule_key().alias(KEY), "file_ord", "line_no", "negate", "dir_only", "regex")


def path_keys(scope: Column, below: Column) -> Column:
    """The keys under which rules of directory ``scope`` are found that may match the path ``below`` it."""
    name = base_name(below)
    extension = F.when(name.contains("."), _key(scope, "e", F.regexp_extract(name, r"([^.]*)\z", 1)))
    first = F.when(below.contains("/"), _key(scope, "f", F.regexp_extract(below, r"\A([^/]*)/", 1)))
    return F.array_compact(F.array(_key(scope, "n", name), extension, first, _key(scope, "a", F.lit(""))))


def below_scope(path: Column, scope: Column) -> Column:
    return F.when(scope == "", path).otherwise(F.substring(path, F.char_length(scope) + 2, F.char_length(path)))


def self_and_above(directory: str | Column) -> Column:
    """A directory and all above it, outermost first; the top is ''."""
    d = F.col(directory) if isinstance(directory, str) else directory
    return F.when(d == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), ancestors(d), F.array(d)))


def asked_keys(scoped: DataFrame) -> DataFrame:
    """``path, depth, _below, _key`` for each key of each ``path, depth, scope_dir``."""
    scoped = scoped.withColumn("_below", below_scope(F.col("path"), F.col("scope_dir")))
    return scoped.select("path", "depth", "_below", F.explode_outer(path_keys(F.col("scope_dir"), F.col("_below"))).alias(KEY))


def all_scopes(paths: DataFrame) -> DataFrame:
    """``path, depth, scope_dir`` for every directory above a path, with rules or not."""
    return paths.select("path", F.posexplode_outer(self_and_above(parent_dir("path"))).alias("depth", "scope_dir"))


def ignored_paths(paths: DataFrame, scoped: DataFrame, rules: DataFrame, stated: Column, is_dir: bool) -> DataFrame:
    """The distinct ones of ``paths`` (``path``) that are ignored by rules from files or else as ``stated`` says.

    ``rules`` have their ``rule_key``; ``scoped`` has the directories whose rules may have a say on a path. Hot keys are dealt to several tasks, and the
    verdict is a maximum over single rules: the stated verdict stands below the outermost directory.
    """
    usable = rules if is_dir else rules.where("not dir_only")
    index = usable.select(KEY, "file_ord", "line_no", "negate", "regex")
    matched = salted_lookup(asked_keys(scoped), index, on=KEY, how="inner", spread="path").where(F.rlike(byte_view("_below"), F.col("regex")))
    places = matched.select("path", F.struct("depth", "file_ord", F.col("line_no").cast("int").alias("line_no"), (~F.col("negate")).alias("ignored")).alias("_last"))
    before = paths.select("path", F.struct(F.lit(-1).alias("depth"), F.lit(0).alias("file_ord"), F.lit(0).alias("line_no"), stated.alias("ignored")).alias("_last"))
    return places.unionByName(before).groupBy("path").agg(F.max("_last").alias("_last")).where("_last.ignored").select("path")
