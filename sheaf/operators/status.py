"""Why a file is skipped. Reasons in order of precedence: extension, read error, content, secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions.text import has_ext, looks_binary


def binary_by_ext(files: DataFrame, path: str = "rel_path") -> DataFrame:
    return files.withColumn("is_binary", has_ext(path, fv.BINARY_EXTENSIONS))


def binary_by_content(files: DataFrame, raw: str = "raw") -> DataFrame:
    return files.withColumn("is_binary", looks_binary(raw))


def skip_status(files: DataFrame, raw: str = "raw", error: str = "read_error") -> DataFrame:
    """From ``rel_path``, raw bytes and a read error to the corpus columns.

    Contents are only looked at where the extension and the read leave the question open.
    Text that is not UTF-8 is read as ISO-8859-1, one character per byte, so that characters and lines
    are counted as bytes are and ``encode(content, 'ISO-8859-1')`` gives the bytes back.
    """
    text = F.col(raw).cast("string")
    text = F.when(F.is_valid_utf8(text), text).otherwise(F.decode(raw, "ISO-8859-1"))
    by_ext = has_ext("rel_path", fv.BINARY_EXTENSIONS)
    reason = (
        F.when(by_ext, fv.REASON_EXTENSION)
        .when(F.col(error).isNotNull(), F.concat(F.lit(fv.REASON_READ), F.col(error)))
        .when(looks_binary(raw), fv.REASON_CONTENT)
    )
    return (
        files.withColumn("skip_reason", reason)
        .withColumn("is_binary", F.coalesce(F.col("skip_reason").isin(fv.REASON_EXTENSION, fv.REASON_CONTENT), F.lit(False)))
        .withColumn("content", F.when(F.col("skip_reason").isNull(), text).otherwise(""))
        .drop(raw, error)
    )


def kept(corpus: DataFrame) -> DataFrame:
    return corpus.where("skip_reason is null")
