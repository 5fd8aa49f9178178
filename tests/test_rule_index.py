"""The index over found ignore rules: against trying every rule in turn, and with very many rules."""

import random
import time

import pytest
import restated
from pyspark.sql import functions as F

from sheaf.operators import rule_index, select

PATTERNS = [
    "*.log", "a.log", "!a.log", "build/", "build", "/top", "src/*.py", "src/**", "**/x.txt", "**/gen", "*", "!keep*", "?.md", "[ab].go", "[!a]*.go", "[a.log", "x[.]log",
    "a\\.log", "\\*.log", "docs/a/b.md", "docs/[ab]/", "*.tar.gz", "*.", ".*", "é*.txt", "é.txt", "a b", "*log", "no.ext*", "/src/a", "!/src/a/", "**", "a**b", "***/x.log", "[*.log", "b]", "x/", "[ab]/c.log",
]
NAMES = ["a", "b", "src", "build", "docs", "top", "gen", "x", "é", "a b", "keep", "c.d"]
LEAVES = ["a.log", "b.log", "x.log", "x.txt", "myx.txt", "é.txt", "a.md", "b.md", "a.go", "z.go", "q.tar.gz", "dot.", ".hid", "a", "b]", "gen", "mygen", "x.py", "no.ext1", "keep.log", "*.log", "[a.log", "alog"]


def trees(seed):
    rng = random.Random(seed)
    paths = {"/".join([*(rng.choice(NAMES) for _ in range(rng.randint(0, 4))), rng.choice(LEAVES)]) for _ in range(250)}
    dirs = sorted({d for p in paths for d in above(p)})
    files = {}
    for d in rng.sample(dirs, min(len(dirs), 12)) + [""]:
        files[f"{d}/.gitignore".lstrip("/")] = "\n".join(rng.sample(PATTERNS, rng.randint(0, 6)))
    return sorted(paths), files


def above(path):
    parts = path.split("/")
    return ["/".join(parts[:n]) for n in range(len(parts))]


def plain_verdict(path, is_dir, files, stated):
    verdict = None
    for line in stated:
        verdict = one(line, path, is_dir, verdict)
    for d in above(path):
        body = files.get(f"{d}/.gitignore".lstrip("/"))
        for line in (body or "").split("\n"):
            verdict = one(line, path[len(d) + 1 :] if d else path, is_dir, verdict)
    return bool(verdict)


def one(line, below, is_dir, before):
    """What a rule makes of the verdict before it: the restated list of a rule that ignores, alone, tells whether it matches."""
    positive = line.removeprefix("!")
    if not positive.strip() or not restated.ignored([positive], below, is_dir):
        return before
    return not line.startswith("!")


@pytest.mark.parametrize("seed", range(6))
def test_nested_rules_equal_trying_each(spark, seed):
    paths, files = trees(seed)
    stated = ["*.md", "!a.md"] if seed % 2 else []
    corpus = spark.createDataFrame([(p, 1) for p in paths], "rel_path string, bytes int")
    rules = select.scan_ignore_rules(spark.createDataFrame(list(files.items()), "rel_path string, content string"))
    got = {r.rel_path for r in select.nested_ignores(corpus, rules, stated).collect()}
    pruned = {d for p in paths for d in above(p) if d and plain_verdict(d, True, files, stated)}
    want = {p for p in paths if not plain_verdict(p, False, files, stated) and not pruned & set(above(p))}
    assert got == want
    dirs = sorted({d for p in paths for d in above(p) if d})
    kept = select.unignored_dirs(spark.createDataFrame([(d,) for d in dirs], "rel_path string"), rules, stated)
    assert {r.rel_path for r in kept.collect()} == {d for d in dirs if d not in pruned}


def test_a_rule_is_found_by_every_path_it_matches(spark):
    """Each pattern against each path: where the regex matches, the path asks for the rule's key."""
    given = [r for p in PATTERNS for r in [(p,)]]
    rules = select.scan_ignore_rules(spark.createDataFrame([(".gitignore", "\n".join(p for (p,) in given))], "rel_path string, content string"))
    paths = spark.createDataFrame([(p,) for p in {*LEAVES, *NAMES, *(f"{n}/{x}" for n in NAMES for x in LEAVES), *(f"src/{n}/{x}" for n in NAMES for x in LEAVES)}], "path string")
    keyed = paths.withColumn("keys", rule_index.path_keys(F.lit(""), F.col("path")))
    met = keyed.crossJoin(rules.withColumn("key", rule_index.rule_key())).where(F.rlike(F.col("path"), F.col("regex")))
    assert met.count() > 500
    assert met.where(~F.array_contains("keys", F.col("key"))).count() == 0


def test_very_many_rules(spark):
    """100,000 rules over 10,000 directories: a file meets few of them, and a rule at the top meets all files."""
    dirs = spark.range(10_000).selectExpr("concat('d', id % 100, '/e', id div 100) as dir")
    lines = [f"gen{k}.txt" for k in range(4)] + [f"*.x{k}" for k in range(3)] + ["/out/", "!gen1.txt", "tmp/*"]
    rule_files = dirs.select(F.concat("dir", F.lit("/.gitignore")).alias("rel_path"), F.lit("\n".join(lines)).alias("content"))
    rules = select.scan_ignore_rules(rule_files.unionByName(spark.createDataFrame([(".gitignore", "*.log")], "rel_path string, content string"))).cache()
    assert rules.count() == 100_001
    names = ["a.log", "b.txt", "gen0.txt", "gen1.txt", "c.x2", "out/k.txt", "tmp/y", "sub/gen3.txt", "sub/d.py"]
    files = dirs.select(F.explode(F.array(*[F.concat("dir", F.lit("/" + n)) for n in names])).alias("rel_path"))
    begun = time.time()
    kept = select.nested_ignores(files, rules).groupBy(F.regexp_extract("rel_path", r"^[^/]*/[^/]*/(.*)", 1).alias("name")).count().collect()
    assert {r.name: r["count"] for r in kept} == {n: 10_000 for n in ("b.txt", "gen1.txt", "sub/d.py")}
    assert time.time() - begun < 60
    rules.unpersist()
