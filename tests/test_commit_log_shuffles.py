"""A commit log in several styles moves its files once and sorts once for styles with files and once for those without."""

import re

import pytest
from pyspark.sql import functions as F

from sheaf.operators.joins import SALT, SALTS, spread_rows
from sheaf.operators.render import HEAD, TAIL, TOUCHED, commit_rows, render_commit_log

STYLES = ("xml", "markdown", "json", "plain")


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """3,000 commits of two files, one of them named twice, commit 0 with 3,000 more; every tenth without; files of no commit."""
    commits = spark.range(3000).selectExpr(
        "concat('c', id) as hash", "concat('a', id % 7) as author", "'2024-01-01' as date", "concat('m', id, '\\nmore') as message", "id div 3 as ts"
    )
    few = spark.range(3100).where("id % 10 > 0").selectExpr("concat('c', id) as hash", "explode(array('x/1', 'x/2', 'x/2')) as path")
    many = spark.range(3000).selectExpr("'c0' as hash", "concat('y/', id) as path")
    place = tmp_path_factory.mktemp("log")
    commits.write.parquet(f"{place}/commits")
    few.union(many).write.parquet(f"{place}/files")
    return spark.read.parquet(f"{place}/commits"), spark.read.parquet(f"{place}/files")


def test_styles_share_their_shuffles(log):
    told = [render_commit_log(*log, style).select(F.lit(style).alias("style"), "hash", "step", "path", "body") for style in STYLES]
    whole = told[0].union(told[1]).union(told[2]).union(told[3])
    whole.collect()
    plan = whole._jdf.queryExecution().executedPlan().executedPlan().toString()
    made = [x for x in plan.split("\n") if re.search(r"Exchange (range|hash)partitioning", x) and "ReusedExchange" not in x]
    assert sum("rangepartitioning" in x for x in made) == 2
    assert sum("REPARTITION_BY_COL" in x for x in made) == 1  # files, dealt by commit and salt
    assert not [x for x in made if re.search(r"hashpartitioning\(hash#\d+, path#", x)]
    assert "body" not in "".join(re.findall(r"rangepartitioning\(.*", "".join(made)))


@pytest.mark.parametrize("style", STYLES)
def test_document_order_and_rows(log, style):
    got = [(r.ts, r.hash, r.step, r.path) for r in render_commit_log(*log, style).collect()]
    want = []
    for i in range(3000):
        where, files = (i // 3, f"c{i}"), ["x/1", "x/2"] if i % 10 else []
        if i == 0:
            files = [f"y/{k}" for k in range(3000)]
        want.append((*where, HEAD, ""))
        if style in ("xml", "json"):
            want += [(*where, TOUCHED, f) for f in files] + [(*where, TAIL, "")]
    assert got == sorted(want, key=lambda r: (-r[0], *r[1:]))


def test_bodies_of_commits_with_and_without_files(log):
    def body(style, name):
        return "".join(r.body for r in commit_rows(*log, style).where(F.col("hash") == name).orderBy("step", "path").collect())

    assert body("json", "c11") == '{"hash":"c11","author":"a4","date":"2024-01-01","message":"m11\\nmore","files":["x/1","x/2","x/2"]}'
    assert body("json", "c20") == '{"hash":"c20","author":"a6","date":"2024-01-01","message":"m20\\nmore"}'
    assert body("xml", "c11").count("<file>x/2</file>") == 2 and "<files>" not in body("xml", "c20")
    assert body("json", "c0").count('"y/') == 3000 and '"files":["y/0","y/1","y/10"' in body("json", "c0")
    assert body("plain", "c20") == "c20 2024-01-01 — m20\n"


def test_only_keys_of_many_rows_are_spread(log):
    salts = {r["hash"]: r.n for r in spread_rows(log[1], "hash", "path").groupBy("hash").agg(F.countDistinct(SALT).alias("n")).collect()}
    assert salts["c0"] == SALTS and sum(n > 1 for n in salts.values()) < 300
    assert spread_rows(log[1].where("false"), "hash", "path").count() == 0
