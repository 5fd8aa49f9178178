"""Helpers that several of the operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.session import store_table

SPACE = r"\x20\x09-\x0D"
#: Rows of numbers that one block of a running total holds.
BLOCK_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Equality of the named columns; null equals null, so that rows without an id are joined too."""
    met = F.lit(True)
    for c in columns:
        met = met & left[c].eqNullSafe(right[c])
    return met


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same ``keys`` that come before in ``order``.

    ``rows`` must be narrow: it is range-partitioned by keys and order into blocks of about
    ``BLOCK_ROWS`` rows and stored. A window adds up inside each block, another one over the
    blocks' sums, so a key that holds most rows is spread over as many tasks as it has blocks.
    """
    spark = rows.sparkSession
    rows = store_table(rows)
    blocks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS))
    sort = [F.col(c).asc_nulls_last() for c in [*keys, *order]]
    dealt = store_table(rows.repartitionByRange(blocks, *sort).withColumn("_block", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_block").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    met = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return dealt.join(sums, met).withColumn(name, F.col("_before") + F.col("_within")).select(*rows.columns, name)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) with the components of the edges given."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    while not np.array_equal(label[label], label):
        label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _forests(batches):
    held_a, held_b, size = [], [], 0
    for pdf in batches:
        held_a.append(pdf["a"].to_numpy(np.int64))
        held_b.append(pdf["b"].to_numpy(np.int64))
        size += len(pdf)
        if size > 500_000:  # edges, not nodes, are bounded here: what is held is contracted again and again
            a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
            if len(a) > 250_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = a[:0], b[:0]
            held_a, held_b, size = [a], [b], len(a)
    if held_a:
        a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
        yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """``node, root`` of every node of ``edges`` (bigint ``a, b``) that is not itself the smallest of its component.

    Every task contracts its own edges first; then large-star and small-star rounds run until
    nothing changes, each of them aggregation and a join, each stored in the shared folder. What fits into a
    block is contracted by one task: a round costs the driver six shuffles' tasks, however few edges they hold.
    What does not is joined by shuffles, by hint: edges of few roots take little on disk and much in a broadcast.
    """
    edges = store_table(edges.select("a", "b").where("a <> b").mapInPandas(_forests, "a bigint, b bigint").distinct())

    def seen(e):
        return tuple(e.select(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())

    state = seen(edges)
    while state[0]:
        if state[0] <= block:
            edges = store_table(edges.coalesce(1).mapInPandas(_forests, "a bigint, b bigint"))
            break
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = store_table(small)
        new = seen(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
