"""One call from a corpus to a pack."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions.secrets import SecretRule
from sheaf.operators.clean import clean_documents
from sheaf.operators.history import change_freq, recent_commits, touched_files, with_change_freq
from sheaf.operators.metrics import corpus_totals, file_metrics
from sheaf.operators.render import Options, assemble_sections
from sheaf.operators.secrets import explode_findings, secret_quarantine, with_findings
from sheaf.operators.split import BLOCK_BYTES, split_packs
from sheaf.session import drop_table, store_table, task_count


@dataclass
class Pack:
    """What a run yields; every field is a DataFrame and nothing is collected."""

    corpus: DataFrame
    findings: DataFrame
    metrics: DataFrame
    totals: DataFrame
    sections: DataFrame
    parts: DataFrame | None = None


def pack_corpus(
    corpus: DataFrame,
    options: Options = Options(),
    *,
    scan_secrets: bool = True,
    extra_rules: list[SecretRule] = (),
    unique_paths: bool = False,
    remove_comments: bool = False,
    truncate_base64: bool = False,
    compress: bool = False,
    remove_empty_lines: bool = False,
    show_line_numbers: bool = False,
    commits: DataFrame | None = None,
    sort_by_changes: bool = True,
    sort_commits: int = fv.FREQUENCY_COMMITS,
    include_log: bool = False,
    log_commits: int = fv.RECENT_COMMITS,
    tree_files: DataFrame | None = None,
    split_bytes: int = 0,
) -> Pack:
    """Scan, order, clean, measure and render a corpus, in that order.

    Secrets are looked for in the original text. The scanned corpus is stored, so that every file
    is read and scanned once and findings and quarantine agree; findings and the cleaned corpus
    are stored too, since totals, tree and document all read it, and the scanned one is deleted.
    ``commits`` has ``hash, author, date, message, files, ts``.
    """
    empty = corpus.sparkSession.createDataFrame([], "rel_path string, rule_ord int, match_ord int, line int, rule string, match string")
    scanned = store_table(with_findings(corpus, list(extra_rules))) if scan_secrets else None
    found = store_table(explode_findings(scanned)) if scan_secrets else empty
    marked = secret_quarantine(scanned, unique_paths) if scan_secrets else corpus
    if commits is not None and sort_by_changes:
        freq = change_freq(commits, touched_files(commits), sort_commits)
        marked = with_change_freq(marked, freq)
    cleaned = store_table(
        clean_documents(
            marked,
            remove_comments=remove_comments,
            truncate_base64=truncate_base64,
            compress=compress,
            remove_empty_lines=remove_empty_lines,
            show_line_numbers=show_line_numbers,
        )
    )
    if scanned is not None:
        drop_table(scanned)
    metrics = file_metrics(cleaned)
    totals = corpus_totals(metrics)
    log = recent_commits(commits, log_commits) if commits is not None and include_log else None
    sections = assemble_sections(cleaned, totals, options, tree_files, log)
    blocks = None
    if split_bytes > 0:  # the sizes of the files stand in for those of the rendered text
        size = cleaned.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        blocks = task_count(corpus.sparkSession, size, BLOCK_BYTES)
    return Pack(
        corpus=cleaned,
        findings=found,
        metrics=metrics,
        totals=totals,
        sections=sections,
        parts=split_packs(sections, split_bytes, blocks=blocks) if split_bytes > 0 else None,
    )
