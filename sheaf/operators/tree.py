"""Directory trees as rows.

A node's ``sort_key`` lists its path elements, each led by ``0`` for a directory and
``1`` for a file and followed by a NUL, so that plain string order is depth-first
with directories before files. Path elements above a node always are directories,
so the key needs nothing but the path itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import ancestors, base_name, parent_dir, rows_of
from sheaf.operators.ranks import with_rank


def tree_nodes(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Distinct nodes ``path, parent, name, depth, is_dir``; a path that others pass through is a directory."""
    node = F.struct(F.col(path).alias("path"), F.lit(False).alias("is_dir"))
    above = F.transform(ancestors(path), lambda d: F.struct(d.alias("path"), F.lit(True).alias("is_dir")))
    every = files.select(rows_of(F.concat(above, F.array(node))).alias("n"))
    nodes = every.groupBy(F.col("n.path").alias("path")).agg(F.bool_or("n.is_dir").alias("is_dir"))
    return nodes.select(
        "path",
        parent_dir("path").alias("parent"),
        base_name("path").alias("name"),
        F.size(F.split("path", "/", -1)).alias("depth"),
        "is_dir",
    )


def sort_key(path: str, is_dir: str) -> Column:
    above = F.transform(F.split(parent_dir(path), "/", -1), lambda x: F.concat(F.lit("0"), x, F.lit("\0")))
    prefix = F.when(parent_dir(path) == "", "").otherwise(F.array_join(above, ""))
    return F.concat(prefix, F.when(F.col(is_dir), "0").otherwise("1"), base_name(path), F.lit("\0"))


def tree_lines(nodes: DataFrame) -> DataFrame:
    """``sort_key, line``: the rendered lines, two blanks per level, directories with ``/``."""
    line = F.concat(
        F.repeat(F.lit("  "), F.col("depth") - 1), F.col("name"), F.when(F.col("is_dir"), "/").otherwise("")
    )
    return nodes.select(sort_key("path", "is_dir").alias("sort_key"), line.alias("line"))


def tree_render(files: DataFrame, path: str = "rel_path") -> DataFrame:
    return tree_lines(tree_nodes(files, path)).orderBy("sort_key")


def tree_numbered(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """``sort_key, line, line_no``: the lines of the tree with their numbers, from 1."""
    return with_rank(tree_lines(tree_nodes(files, path)), [F.asc("sort_key")], "line_no")
