"""Commit logs dumped as text.

A record starts with a marker; its first line is ``hash 0x1f author 0x1f date 0x1f subject``
and every further non-blank line is a file the commit touched. Any ``git log`` can
write this with ``--name-only --pretty=format:<marker>%H%x1f%an%x1f%aI%x1f%s``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import trim_space

MARKER = "\x01COMMIT\x01"
FIELD = "\x1f"


def scan_commit_log(spark: SparkSession, location: str, marker: str = MARKER) -> DataFrame:
    """``hash, author, date, message, files``; records with fewer than four fields are dropped.

    The marker is the line separator of the text source, so a large dump is split
    among tasks like any text file.
    """
    records = spark.read.option("lineSep", marker).text(location)
    text = F.regexp_replace("value", r"\A\n+", "")
    head = F.split(F.substring_index(text, "\n", 1), FIELD, -1)
    rows = records.select(
        head.alias("head"),
        F.filter(
            F.transform(F.split(F.regexp_replace(text, r"\A[^\n]*+\n?", ""), "\n", -1), trim_space),
            lambda f: f != "",
        ).alias("files"),
    )
    return rows.where(F.size("head") >= 4).select(
        F.col("head")[0].alias("hash"),
        F.col("head")[1].alias("author"),
        F.col("head")[2].alias("date"),
        F.col("head")[3].alias("message"),
        "files",
    )


def commit_timestamp(date: str) -> Column:
    """The ISO-8601 date of a commit as a timestamp."""
    return F.to_timestamp(F.col(date))
