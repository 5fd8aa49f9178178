"""Joins of what grows with the corpus are shuffled, however small Spark takes the tables to be."""

import re

import pytest
from pyspark.sql import functions as F

from sheaf.llm import common, exact_dedup, near_texts, simhash

#: Joins of which no side may be broadcast: by bucket, fingerprint, node or pair. (Distinct hashes of pairs are measured first, behind a shuffle.)
GROWING = re.compile(r"BroadcastHashJoin \[(_key|_fp|_node|_h[ab]|[ab])#")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plan of every table that is stored, as first planned."""
    found = []

    def watch(module):
        store = module.store_table
        monkeypatch.setattr(module, "store_table", lambda df: (found.append(plan_of(df)), store(df))[1])

    for module in (common, exact_dedup, near_texts, simhash):
        watch(module)
    return found


@pytest.fixture(scope="module")
def docs(spark):
    text = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id") % 40) for k in range(30)], F.when(F.col("id") % 3 == 0, F.lit("end")))
    return spark.range(300).select(F.col("id").alias("doc_id"), text.alias("text"))


def test_buckets_of_exploded_fingerprints_are_not_broadcast(spark, tmp_path):
    spark.range(2000).select(F.xxhash64("id").alias("_fp")).write.parquet(f"{tmp_path}/prints")
    plan = plan_of(simhash.near_edges(spark.read.parquet(f"{tmp_path}/prints")))
    assert "SortMergeJoin [_key" in plan and "Broadcast" not in plan


def test_near_copies_broadcast_nothing_that_grows(docs, plans):
    stay = near_texts.drop_near_texts(docs)
    assert stay.count() == 40
    assert any("SortMergeJoin [_node" in p for p in plans) and any("SortMergeJoin [b#" in p for p in plans)
    assert not [m[0] for p in plans for m in GROWING.finditer(p)]


def test_fingerprint_groups_and_exact_copies_broadcast_nothing_that_grows(docs):
    plan = plan_of(simhash.simhash_groups(docs))
    assert "SortMergeJoin [_fp" in plan and not GROWING.search(plan)
    plan = plan_of(exact_dedup.exact_dedup(docs))
    assert "SortMergeJoin [_hash" in plan and not re.search(r"BroadcastHashJoin \[_hash#\d+\]", plan)


def test_rounds_of_components_broadcast_no_edges(spark, plans):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert common.components(edges, block=0).agg(F.max("root")).first()[0] == 0
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)
