"""What the cleaning chain costs: patterns are compiled once, and payloads are found in one pass."""

from pyspark.sql import functions as F

from sheaf.functions import cleaning


def test_payloads_of_none_one_and_several_runs(spark):
    run = "Ab+/" * 20
    texts = ["", "é words", run, f"é {run}== ü", f"{run}=\n{'B' * 59} {'B' * 60}", f"x.{run}===={run}y", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(cleaning.truncate_base64("t")).collect()
    note = "[base64 omitted, {} chars]".format
    assert [r[0] for r in got] == ["", "é words", note(80), f"é {note(82)} ü", f"{note(81)}\n{'B' * 59} {note(60)}", f"x.{note(82)}=={note(81)}", None]


def test_signature_patterns_are_literals(spark):
    """A pattern that is not one is compiled anew for every line."""
    code = "func a() {\n x\n}\n// func b() {\nclass C {\n}"
    docs = spark.createDataFrame([(f"a{e}", code) for e in (".go", ".ts", ".txt")], "p string, t string")
    done = docs.select("p", cleaning.compress_braces("p", "t").alias("t"))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    patterns = [x.split(", ", 1)[-1] for x in plan.split("RLIKE(")[1:]]
    assert patterns and all(not p.lstrip().startswith(("lambda", "namedlambda")) for p in patterns), patterns
    got = {r.p: r.t for r in done.collect()}
    assert got["a.go"] == "func a() {\n  // ...\n// func b() {\nclass C {\n}" and got["a.txt"] == code
    assert got["a.ts"] == "func a() {\n x\n}\n// func b() {\nclass C {\n  // ..."
    assert done.where(F.col("t").isNull()).count() == 0
