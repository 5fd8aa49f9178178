"""Order by change history.

Commits are ``hash, author, ts, ...``; the files they touched are a second table
``hash, path`` (``touched_files`` derives it from an array column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions.text import rows_of
from sheaf.operators.ranks import with_rank


def touched_files(commits: DataFrame) -> DataFrame:
    return commits.select("hash", rows_of("files").alias("path")).where("path is not null")


def recent_commits(commits: DataFrame, n: int = fv.RECENT_COMMITS) -> DataFrame:
    """The latest ``n`` commits; n <= 0 means the default of 50. Equal times go by hash."""
    return commits.orderBy(F.desc("ts"), "hash").limit(n if n > 0 else fv.RECENT_COMMITS)


def recent_files(commits: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """Files touched by the latest ``n`` commits.

    At most ``n`` commit rows reach the join, which Spark plans from their measured size.
    """
    return files.join(recent_commits(commits, n).select("hash"), "hash", "left_semi")


def change_freq(commits: DataFrame, files: DataFrame, n: int = fv.FREQUENCY_COMMITS) -> DataFrame:
    """``path, n_changes`` over the latest ``n`` commits; n <= 0 means the default of 100."""
    limit = n if n > 0 else fv.FREQUENCY_COMMITS
    touched = recent_files(commits, files, limit)
    return touched.groupBy("path").agg(F.count("*").alias("n_changes"))


def with_change_freq(files: DataFrame, freq: DataFrame, path: str = "rel_path") -> DataFrame:
    """Add ``n_changes``; a path without history counts 0."""
    known = freq.select(F.col("path").alias(path), "n_changes")
    return files.join(known, path, "left").withColumn("n_changes", F.coalesce("n_changes", F.lit(0)).cast("long"))


def order_by_change_freq(files: DataFrame, freq: DataFrame, path: str = "rel_path") -> DataFrame:
    """Most changed files first, ties by path; without any history this is path order."""
    return with_change_freq(files, freq, path).orderBy(F.desc("n_changes"), path)


def rank_by_change_freq(files: DataFrame, freq: DataFrame, path: str = "rel_path") -> DataFrame:
    """The rows of ``order_by_change_freq`` with their ``rank`` in that order, 1 for the most changed file."""
    return with_rank(with_change_freq(files, freq, path), [F.desc("n_changes"), F.asc(path)])
