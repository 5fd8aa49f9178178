"""Secret scan over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions.text import rows_of
from sheaf.functions.secrets import FINDINGS, SecretRule, builtin_rules, findings
from sheaf.session import store_table


def with_findings(corpus: DataFrame, extra_rules: list[SecretRule] = ()) -> DataFrame:
    """Add the array ``findings``; skipped files are not scanned. No shuffle."""
    rules = builtin_rules() + list(extra_rules)
    scanned = F.when(F.col("skip_reason").isNull(), findings("content", rules))
    return corpus.withColumn("findings", F.coalesce(scanned, F.array().cast(FINDINGS)))


def explode_findings(scanned: DataFrame) -> DataFrame:
    """One row per finding: ``rel_path, rule_ord, match_ord, line, rule, match``."""
    rows = scanned.select("rel_path", rows_of("findings").alias("f"))
    return rows.where("f is not null").select("rel_path", "f.*")


def secret_scan(corpus: DataFrame, extra_rules: list[SecretRule] = ()) -> DataFrame:
    return explode_findings(with_findings(corpus, extra_rules))


def secret_quarantine(scanned: DataFrame, unique_paths: bool = False) -> DataFrame:
    """Mark files with findings as removed; they stay in trees and lists, without content.

    A finding condemns a path: every row of a flagged path falls, whichever root it came from. The
    flagged paths are stored first, so that Spark plans the join from their size and usually
    leaves the contents where they are. ``unique_paths`` promises that no path repeats, which makes it
    a test on the row itself.
    """
    marked = scanned.withColumn("_flagged", F.size("findings") > 0)
    if not unique_paths:
        flagged = store_table(marked.where("_flagged").select("rel_path").distinct().withColumn("_hit", F.lit(True)))
        marked = marked.drop("_flagged").join(flagged, "rel_path", "left").withColumnRenamed("_hit", "_flagged")
    flagged = F.coalesce("_flagged", F.lit(False))
    return (
        marked.withColumn("skip_reason", F.when(flagged, fv.REASON_SECRET).otherwise(F.col("skip_reason")))
        .withColumn("content", F.when(flagged, "").otherwise(F.col("content")))
        .drop("_flagged", "findings")
        .select("abs_path", "rel_path", "bytes", "is_binary", "content", "skip_reason")
    )


def findings_report(found: DataFrame) -> DataFrame:
    """Report lines ``line N: rule`` by path, in scan order.

    A sorted table of lines rather than one list per path: a path with very many
    findings is then only many rows.
    """
    entry = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("rule"))
    return found.select("rel_path", "rule_ord", "match_ord", entry.alias("entry")).orderBy(
        "rel_path", "rule_ord", "match_ord"
    )
