"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm.bpe import encode_digests
from sheaf.llm.common import table
from sheaf.llm.exact_dedup import drop_copies
from sheaf.llm.mixing import mixed_documents
from sheaf.llm.near_texts import drop_near_texts
from sheaf.llm.quality_fm import keep_good
from sheaf.llm.queries import vocabulary_path
from sheaf.session import store_table


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below one half go.

    Null and empty texts are scored like others; without labels of both kinds nothing can be learnt and the
    labels' smoothed share decides for all (no labels: all stay). Repeated rows are judged alike.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, the longest stays, then that with the smallest id.

    Null texts are empty ones; of all empty documents one stays, and one of repeated rows.
    """
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of connected documents that with the smallest id stays.

    Documents are linked whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found exactly,
    or whose fingerprints (those of op5) differ in at most 4 bits.
    """
    return drop_near_texts(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated as their sources' targets ask; documents without words are not part of a mix."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of the mix, repeats included."""
    return encode_digests(docs, vocabulary_path())


STAGES = [
    ("quality classifier", reject_bad),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: Scores, fingerprints and token ids cannot be computed in SQL; the tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
