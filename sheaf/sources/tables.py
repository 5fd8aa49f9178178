"""Corpora that already are tables.

The corpus schema, used by every operator::

    abs_path string, rel_path string, bytes bigint, is_binary boolean,
    content string, skip_reason string      (null: the file is kept)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import col, has_ext
from sheaf import fixed_values as fv


def as_corpus(df: DataFrame, path: str | Column, content: str | Column, abs_path: str | Column | None = None) -> DataFrame:
    """A text table in the corpus schema; ``bytes`` is the size of the text as it stands."""
    p, c = col(path), col(content)
    return df.select(
        (p if abs_path is None else col(abs_path)).alias("abs_path"),
        p.alias("rel_path"),
        F.octet_length(c).cast("long").alias("bytes"),
        has_ext(p, fv.BINARY_EXTENSIONS).alias("is_binary"),
        c.alias("content"),
        F.lit(None).cast("string").alias("skip_reason"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to all cores when a scan has fewer splits than the cluster has cores.

    Text work is bound by processors, and a small table may be a single row group. The
    shuffle this adds is bounded by the number of cores times the size of a split; a table
    with more splits is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_corpus_table(spark: SparkSession, location: str, path: str | Column, content: str | Column) -> DataFrame:
    """Read a Parquet table as a corpus; only the columns named reach the scan."""
    rows = spark.read.parquet(location).select(col(path).alias("path"), col(content).alias("content"))
    return as_corpus(spread(rows), "path", "content")


def scan_manifest(spark: SparkSession, location: str) -> DataFrame:
    """A list of paths, one per line."""
    return spark.read.text(location).select(F.col("value").alias("line"))
