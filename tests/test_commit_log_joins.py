"""Joins of a commit log stay shuffled however small the tables are on disk, and find every file."""

import json
import re

import pytest
from pyspark.sql import functions as F

from sheaf.operators.joins import salted_lookup, salts_asked
from sheaf.operators.render import HEAD, Options, TOUCHED, assemble_sections, commit_rows, in_order

HASH = "concat('c', id)"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Commit 0 touches 400 files, commits without a remainder of 3 two, the others none; one file twice, one of no commit."""
    commits = spark.range(60).selectExpr(f"{HASH} as hash", "'a' as author", "'2024-01-01' as date", "'m' as message", "id as ts")
    few = spark.range(60).where("id % 3 = 0").selectExpr(f"{HASH} as hash", "explode(array('x/1', 'x/2', 'x/2')) as path")
    many = spark.range(400).selectExpr("'c0' as hash", "concat('y/', id) as path")
    lost = spark.range(1).selectExpr("'none' as hash", "'z' as path")
    place = tmp_path_factory.mktemp("log")
    commits.write.parquet(f"{place}/commits")
    few.union(many).union(lost).write.parquet(f"{place}/files")
    return spark.read.parquet(f"{place}/commits"), spark.read.parquet(f"{place}/files")


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("style", ["xml", "json"])
def test_commits_are_not_broadcast(log, style):
    plan = planned(commit_rows(*log, style))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("style", ["xml", "json"])
def test_every_file_of_every_commit_is_told(log, style):
    told = commit_rows(*log, style).collect()
    want = {("c0", f"y/{i}") for i in range(400)} | {(f"c{i}", f"x/{k}") for i in range(0, 60, 3) for k in (1, 2)}
    assert sorted((r.hash, r.path) for r in told if r.step == TOUCHED) == sorted(want)
    assert sum(r.step == HEAD for r in told) == 60
    assert sum(r.body.count("x/2") for r in told) == 40


def test_only_the_asked_copies_are_made(spark, log):
    _, files = log
    asked = files.groupBy("hash").agg(salts_asked("path").alias("asked"))
    found = salted_lookup(files, asked, "hash", "inner", "path", asked="asked")
    assert found.count() == files.count()
    assert asked.selectExpr("max(bit_count(asked)) as n").first().n == 16


def test_json_log_in_a_document_joins_only_for_its_rows(spark, log):
    commits, files = log
    listed = commits.join(files.groupBy("hash").agg(F.collect_list("path").alias("files")), "hash", "left")
    listed = listed.withColumn("ts", F.timestamp_seconds("ts"))
    corpus = spark.createDataFrame([], "abs_path string, rel_path string, bytes bigint, is_binary boolean, content string, skip_reason string")
    totals = spark.range(1).selectExpr("0L as files", "0L as chars", "0L as tokens", "0L as bytes")
    sections = assemble_sections(corpus, totals, Options(style="json", tree=False, files=False), log=listed)
    told = json.loads("".join(r.body for r in in_order(sections).collect()))["git_log"]
    assert [c["hash"] for c in told] == [f"c{i}" for i in reversed(range(60))]
    assert len(told[-1]["files"]) == 403 and "files" not in told[-2]
    # the files are looked up once, not again for the list's ends
    assert len(re.findall(r"Join \[hash#\d+, _salt#\d+\]", planned(sections))) == 1
