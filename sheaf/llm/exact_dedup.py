"""Exact dedup: 128-bit content hash, groups, then a comparison of bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import SPACE, text_or_empty
from sheaf.session import store_table


def normalised(text):
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id>, keep_id, group_size, kept, text_sha256, content_hash``.

    Texts are equal when identical without ASCII white space; a null text counts as empty, and all
    empty texts are one group. Of equal texts the row with most code points stays, then the one
    with the smallest id (a null id is the largest). Rows that repeat both id and text
    all carry ``kept`` = true when theirs is the id that stays; ``drop_copies`` keeps one of them.
    An empty table gives no rows; other columns are ignored, whatever their names.

    The hashes travel, not the texts. Only rows whose 128-bit hash occurs twice have their texts
    joined again and grouped by hash and bytes, so a collision splits its group. The stored hashes are joined by a
    shuffle, by hint: Spark's estimate of them is no measure of what a broadcast takes in the driver.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    bytes_ = normalised(F.col("_text"))
    hashed = store_table(
        rows.select(
            "_id",
            F.unhex(F.md5(bytes_)).alias("_hash"),
            F.unhex(F.sha2(bytes_, 256)).alias("_sha"),
            F.char_length("_text").alias("_points"),
        )
    )
    rank = F.min(F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id")))
    groups = hashed.groupBy("_hash", "_sha").agg(F.count(F.lit(1)).alias("_n"), rank.alias("_first"))
    repeated = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    members = hashed.join(repeated.hint("merge"), "_hash").select(F.col("_id").alias("_member"), "_hash").distinct()
    compared = (
        rows.join(members, F.col("_id").eqNullSafe(F.col("_member")))
        .select("_hash", normalised(F.col("_text")).alias("_bytes"))
        .where(F.unhex(F.md5("_bytes")) == F.col("_hash"))  # an id may have several texts
        .groupBy("_hash", "_bytes")
        .agg(F.count(F.lit(1)).alias("_same"))
        .select("_hash", F.unhex(F.sha2("_bytes", 256)).alias("_sha"), "_same")
    )
    classes = groups.join(compared, ["_hash", "_sha"], "left").select("_hash", "_sha", "_first", F.coalesce("_same", "_n").alias("_size"))
    return (
        hashed.join(classes.hint("merge"), ["_hash", "_sha"])
        .select(
            F.col("_id").alias(id_col),
            F.col("_first.id").alias("keep_id"),
            F.col("_size").cast("bigint").alias("group_size"),
            F.col("_id").eqNullSafe(F.col("_first.id")).alias("kept"),
            F.lower(F.hex("_sha")).alias("text_sha256"),
            F.lower(F.hex("_hash")).alias("content_hash"),
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one row for each group of equal texts."""
    verdict = exact_dedup(docs, id_col, text_col).where("kept")
    stay = verdict.select(F.col(id_col).alias("_keep"), F.unhex("content_hash").alias("_keep_hash")).distinct()
    text = text_or_empty(text_col)
    rows = docs.select(
        F.struct("*").alias("_row"),
        F.col(id_col).alias("_id"),
        F.unhex(F.md5(normalised(text))).alias("_hash"),
        F.char_length(text).alias("_points"),
    )
    joined = rows.join(stay, F.col("_hash").eqNullSafe(F.col("_keep_hash")) & F.col("_id").eqNullSafe(F.col("_keep")))
    nth = F.row_number().over(Window.partitionBy("_hash", "_id").orderBy(F.col("_points").desc()))
    return joined.withColumn("_nth", nth).where("_nth = 1").select("_row.*")
