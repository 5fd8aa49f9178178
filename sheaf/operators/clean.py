"""Content transforms of the kept files, in their fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import cleaning


def clean_documents(
    corpus: DataFrame,
    *,
    remove_comments: bool = False,
    truncate_base64: bool = False,
    compress: bool = False,
    remove_empty_lines: bool = False,
    show_line_numbers: bool = False,
    path: str = "rel_path",
    content: str = "content",
) -> DataFrame:
    """Comments, payloads, bodies, blank lines, line numbers; skipped files stay as they are.

    Each step is a projection of its own, all in one stage, so no step is evaluated twice.
    """
    steps = [
        (remove_comments, lambda: cleaning.strip_comments(path, content)),
        (truncate_base64, lambda: cleaning.truncate_base64(content)),
        (compress, lambda: cleaning.compress_code(path, content)),
        (remove_empty_lines, lambda: cleaning.remove_empty_lines(content)),
        (show_line_numbers, lambda: cleaning.line_numbers(content)),
    ]
    is_kept = F.col("skip_reason").isNull() if "skip_reason" in corpus.columns else F.lit(True)
    for wanted, step in steps:
        if wanted:
            corpus = corpus.withColumn(content, F.when(is_kept, step()).otherwise(F.col(content)))
    return corpus
