import random
import time
import tracemalloc

import pyarrow as pa
import pytest
import restated as py

from sheaf.operators import split
from sheaf.operators.split import _layout, split_packs


def parts_of(spark, packs: dict[str, list[str]], limit: int, blocks: int, fan: int = 64):
    rows = [(k, i, t) for k, texts in packs.items() for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "pack string, i int, body string").repartition(3)
    got = {}
    for r in split_packs(df, limit, "pack", ("i",), blocks=blocks, fan=fan).collect():
        got.setdefault(r.pack, {})[r.part_no] = bytes(r.content)
        got[r.pack]["n"] = r.n_parts
    return got


@pytest.mark.parametrize("limit, blocks, seed", [(12, 1, 0), (7, 5, 1), (1, 4, 2), (40, 9, 3), (3, 7, 4), (200, 6, 5), (2, 8, 6)])
def test_split_matches_one_pass(spark, limit, blocks, seed):
    rng = random.Random(seed)
    bits = ["a", "\n", "line\n", "é", "x" * 9, "\n\n", "long " * 6 + "\n", "word "]
    packs = {
        f"p{k}": ["".join(rng.choices(bits, k=rng.randrange(1, 8))) for _ in range(rng.randrange(1, 40))] for k in range(12)
    }
    packs["lines"] = ["line1\nline2\n", "line3\nline4\nline5\n"]
    packs["wide"] = ["z" * 50, "y" * 50, "\n", "w" * 30]
    got = parts_of(spark, packs, limit, blocks)
    for name, texts in packs.items():
        expected = py.split_parts("".join(texts).encode(), limit)
        n = got[name].pop("n")
        assert [got[name][i] for i in sorted(got[name])] == expected, name
        assert n == len(expected) and sorted(got[name]) == list(range(1, n + 1))


@pytest.mark.parametrize("limit, blocks, fan, seed", [(30, 40, 2, 7), (9, 25, 3, 8), (300, 30, 2, 9), (5, 12, 2, 10)])
def test_split_one_pack_in_many_blocks(spark, limit, blocks, fan, seed):
    rng = random.Random(seed)
    bits = ["a", "\n", "line\n", "é", "x" * 9 + "\n", "\n\n", "long " * 8 + "\n", "word ", "12345\n" * 6]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 6))) for _ in range(400)]
    got = parts_of(spark, {"one": texts, "two": ["12345\n" * 50] * 9}, limit, blocks, fan)
    for name, whole in (("one", "".join(texts)), ("two", "12345\n" * 450)):
        expected = py.split_parts(whole.encode(), limit)
        assert got[name].pop("n") == len(expected)
        assert [got[name][i] for i in sorted(got[name])] == expected


def test_known_case(spark):
    got = parts_of(spark, {"p": ["line1\nline2\nline3\n", "line4\nline5\n"]}, 12, 2)["p"]
    assert [got[i] for i in (1, 2, 3)] == [b"line1\nline2", b"line3\nline4", b"line5\n"]


def test_layout_of_many_blocks_is_linear(spark):
    n = 200_000
    rows = spark.range(n).selectExpr(
        "'p' as pack", "cast(id as int) as block", "cast(100 + id % 7 as bigint) as nbytes",
        "if(id % 5 = 0, null, cast(10 as bigint)) as first_end", "if(id % 5 = 0, null, cast(90 as bigint)) as last_end",
    )
    began = time.time()
    got = [tuple(r) for r in _layout(rows).orderBy("node").collect()]
    assert time.time() - began < 60
    sizes = [100 + i % 7 for i in range(n)]
    at, line, want = 0, 0, []
    for i, size in enumerate(sizes):
        want.append((i, at, line))
        line = at + 90 if i % 5 else line
        at += size
    assert [(r[2], r[4], r[5]) for r in got] == want
    assert {(r[3], r[8], r[9]) for r in got} == {(n, line, at)}
    following = None
    for i in range(n - 1, -1, -1):
        assert got[i][6:8] == ((following, True) if following else (at, False))
        following = want[i][1] + 10 if i % 5 else following


def test_a_block_is_held_once():
    """Reading a block and finding its lines takes little more than the block; two copies were held, and a byte per byte compared."""
    size, n = 1 << 20, 24
    body = b"x" * 99 + b"\n"

    def batches():
        for i in range(n):
            rows = size // len(body)
            yield pa.RecordBatch.from_pydict({
                "pack": ["p"] * rows, "block": pa.array([0] * rows, pa.int32()), "seq": range(i * rows, (i + 1) * rows),
                "offset": [0] * rows, "body": pa.array([body] * rows, pa.binary()),
            })

    tracemalloc.start()
    ((_, data),) = split._stretches(batches())
    ends = split._line_ends(data)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert bytes(data) == body * (size // len(body) * n) and ends.tolist() == list(range(100, len(data) + 1, 100))
    assert most < 1.4 * len(data)
