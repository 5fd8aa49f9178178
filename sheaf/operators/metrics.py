"""Sizes of files and of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions.text import count_chars, count_lines, human_size
from sheaf.functions.tokens import estimate_tokens
from sheaf.operators.ranks import with_rank
from sheaf.operators.status import kept


def file_metrics(corpus: DataFrame) -> DataFrame:
    """``rel_path, chars, tokens, lines, bytes`` of kept files; bytes are those of the source."""
    return kept(corpus).select(
        "rel_path",
        count_chars("content").cast("long").alias("chars"),
        estimate_tokens("content").cast("long").alias("tokens"),
        count_lines("content").cast("long").alias("lines"),
        "bytes",
    )


def corpus_totals(metrics: DataFrame) -> DataFrame:
    """One row: ``files, chars, tokens, bytes``."""

    def total(c: str):
        return F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)

    return metrics.agg(F.count("*").alias("files"), total("chars"), total("tokens"), total("bytes"))


def top_files(metrics: DataFrame, n: int = fv.TOP_FILES) -> DataFrame:
    """The ``n`` files with the most tokens, then characters, then by path; none for n <= 0."""
    return metrics.orderBy(F.desc("tokens"), F.desc("chars"), "rel_path").limit(max(0, n))


def top_report(metrics: DataFrame, n: int = fv.TOP_FILES) -> DataFrame:
    """The lines of a run report: ``rank, line``. A length of 0 falls back to five files."""
    wanted = n if n > 0 else fv.TOP_FILES
    rank = F.row_number().over(Window.orderBy(F.desc("tokens"), F.desc("chars"), "rel_path"))
    line = F.format_string("  %d. %s — %d tokens, %d chars", F.col("rank"), F.col("rel_path"), F.col("tokens"), F.col("chars"))
    ranked = top_files(metrics, wanted).withColumn("rank", rank)  # a window over the few rows just chosen
    return ranked.select("rank", line.alias("line")).orderBy("rank")


def totals_report(totals: DataFrame) -> DataFrame:
    """The summary lines of a run report as one row per line: ``rank, line``."""
    size = F.concat(F.col("bytes").cast("string"), F.lit(" ("), human_size("bytes"), F.lit(")"))
    lines = [
        F.concat(F.lit("  files:   "), F.col("files").cast("string")),
        F.concat(F.lit("  chars:   "), F.col("chars").cast("string")),
        F.concat(F.lit("  tokens:  ~"), F.col("tokens").cast("string")),
        F.concat(F.lit("  bytes:   "), size),
    ]
    return totals.select(F.posexplode_outer(F.array(*lines)).alias("pos", "line")).select(
        (F.col("pos") + 1).alias("rank"), "line"
    )


def token_listing(metrics: DataFrame, threshold: int = 0) -> DataFrame:
    return metrics.where(F.col("tokens") >= threshold).select("rel_path", "tokens").orderBy("rel_path")


def token_ranks(metrics: DataFrame) -> DataFrame:
    """``rel_path, tokens, rank`` of all files in the order of ``top_files``."""
    ranked = with_rank(metrics.select("rel_path", "tokens", "chars"), [F.desc("tokens"), F.desc("chars"), F.asc("rel_path")])
    return ranked.select("rel_path", "tokens", "rank")


def with_human_size(df: DataFrame, size: str = "bytes") -> DataFrame:
    return df.withColumn("human_size", human_size(size))
