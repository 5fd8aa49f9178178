"""Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sheaf.llm import merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ", _id string, tree string, pos string, h string, leaf string, root string, proof string, block string, kept string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    i, _, lang, source, n = row
    return digest("".join(map(field, (i, source, lang, n, text))))


def way(hashes, at):
    """The last hash and, level by level, what stands left and right."""
    beside = []
    while len(hashes) > 1:
        first = at - at % 3
        run = hashes[first : first + 3]
        beside.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        hashes = [digest("".join(hashes[k : k + 3])) for k in range(0, len(hashes), 3)]
        at //= 3
    return hashes[0], beside


def plain(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0] is None, r[0] or 0, leaf_of(r, r[1]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: [x[2] for x in sorted(sources[s], key=lambda x: x[:3])] for s in names}
    subroots = [way(leaves[s], 0)[0] for s in names]
    found = []
    for k, s in enumerate(names):
        for at, (_, _, own, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            sub, low = way(leaves[s], at)
            root, high = way(subroots, k)
            folded = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                folded = leaf_of(r, r[1].replace("\n", ""))
            for left, right in low + high:
                folded = digest(left + folded + right)
            found.append((r[0], own, sub, root, digest("".join(a + b for a, b in low + high)), folded, folded == root))
    return sorted(found, key=repr)


def spark_rows(spark, rows, parts=3, extra=False):
    schema = DOCS + (CLASH if extra else "")
    df = spark.createDataFrame([(*r, *["x"] * 9) for r in rows] if extra else rows, schema).repartition(parts)
    return sorted((tuple(r) for r in merkle.merkle_manifest(merkle.without_line_feeds(df)).collect()), key=repr)


def text_of(k):
    return None if k % 17 == 0 else "\n" if k % 13 == 0 else f"é {k}\n\nline" if k % 3 else f"no feeds {k}"


@pytest.mark.parametrize("levels", [2, merkle.LEVELS])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, levels):
    """Sources of 1, 3, 9, 27, 81, 82 and 900 leaves, so trees end inside a band, at its top and above it."""
    small_bands(monkeypatch, levels, 3**levels)
    sizes = {"one": 1, "three": 3, "nine": 9, "é": 27, "full": 81, None: 82, "hot": 900}
    rows = [(k * 7 % 5003 - 40, text_of(k), None if k % 5 == 0 else "de", s, k if k % 4 else None) for s, n in sizes.items() for k in range(n)]
    assert spark_rows(spark, rows) == plain(rows)


def small_bands(monkeypatch, levels, chunk):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "WIDTH", 3**levels)
    monkeypatch.setattr(merkle, "CHUNK", chunk)


def test_upper_nodes_are_copied_by_chunk(spark, monkeypatch):
    """With small chunks the hot source's upper nodes and its way to the root have many copies."""
    small_bands(monkeypatch, 4, 81)
    rows = [(k, text_of(k), "de", "hot" if k % 3 else f"s{k:04d}", k) for k in range(700)]
    assert spark_rows(spark, rows) == plain(rows)
    leaves = spark.range(700).select(F.lit("shot").alias("tree"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    small_bands(monkeypatch, 4, 27)
    copies = {(r.band, r.pos): r["count"] for r in merkle.build(leaves).others.groupBy("band", "pos").count().collect()}
    assert copies == {**{(1, k): 3 for k in range(8)}, (1, 8): 2}


@pytest.mark.parametrize("extra", [False, True])
def test_manifest_of_odd_rows(spark, extra):
    long = "words of a line\n" * 20_000
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (3, long, "de", "a", 9), (4, "\n", "de", "a", 1), (5, "x", "de", "a", 1), (5, "x", "de", "a", 1), (None, "n", "de", "a", 1), (None, "m\n", "de", None, 1)]
    assert spark_rows(spark, rows, extra=extra) == plain(rows)


def test_manifest_of_nothing_and_of_one(spark):
    empty = merkle.merkle_manifest(spark.createDataFrame([], DOCS))
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    assert spark_rows(spark, [(8, "a\nb", "de", "x", 3)]) == plain([(8, "a\nb", "de", "x", 3)])


def test_other_columns_may_be_hashed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = merkle.merkle_manifest(df, ["v"], "k", "v").orderBy("k").collect()
    assert [r.leaf for r in got] == [digest("1:a"), digest("1:b")]
    assert got[0].root == digest(digest("1:a") + digest("1:b")) and all(r.verified for r in got)
    assert got[0].proof == digest(digest("1:b"))
