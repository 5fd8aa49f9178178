import random

from pyspark.sql import functions as F

from sheaf.operators import ranks


def test_ranks_equal_the_sorted_rows(spark, monkeypatch):
    """Also with more blocks than a group holds, ties in all keys, nulls and a hot key."""
    monkeypatch.setattr(ranks, "ROWS_PER_BLOCK", 20)
    monkeypatch.setattr(ranks, "GROUP", 4)
    rng = random.Random(4)
    rows = [(rng.choice([None, 7, 7, 7, rng.randrange(50)]), rng.randrange(900), None if rng.random() < 0.1 else rng.randrange(9)) for _ in range(1500)]
    df = spark.createDataFrame(rows, "a int, b int, w int").repartition(5)
    got = ranks.with_rank(df, [F.desc_nulls_last("a"), F.asc("b")]).collect()
    assert sorted(r.rank for r in got) == list(range(1, 1501))
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1])
    assert [key(r) for r in sorted(got, key=lambda r: r.rank)] == sorted(map(key, rows))
    placed = sorted(ranks.with_offsets(df, [F.asc_nulls_first("a"), "b"], F.col("w"), "at").collect(), key=lambda r: (r.at, r.w or 0))
    at = 0
    for r in placed:
        assert r.at == at
        at += r.w or 0
    assert sorted((r.a is None, r.a, r.b, r.w is None, r.w) for r in placed if r.a is not None and r.w is not None) == sorted(
        (False, a, b, False, w) for a, b, w in rows if a is not None and w is not None
    )


def test_one_key_for_all_rows(spark):
    df = spark.range(100_000).select(F.lit("same").alias("k"))
    got = ranks.with_rank(df, ["k"])
    assert got.agg(F.count_distinct("rank"), F.max("rank")).first()[:] == (100_000, 100_000)


def test_no_rows(spark):
    assert ranks.with_rank(spark.createDataFrame([], "k string"), ["k"]).collect() == []
