"""Periodic runs against trying every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sheaf.llm import periodic


def plain_runs(words, repeats=4, shortest=6):
    found = set()
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            part = words[start : i + q]
            smaller = any(all(part[k] == part[k + d] for k in range(len(part) - d)) for d in range(1, q))
            if len(part) >= max(shortest, repeats * q) and not smaller:
                found.add((start, len(part), q))
    return sorted(found)


def plain(text, repeats=4, shortest=6):
    words = [] if text is None else text.encode().split()
    runs = plain_runs(words, repeats, shortest)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    rest = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return len(runs), *first, "".join(f"{s},{n},{q}\n" for s, n, q in runs), rest


def texts(seed, count):
    """Texts of few words, of repeated pieces, and of pieces inside repeated pieces."""
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 6)):
            piece = [rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 9))]
            if rng.random() < 0.3:
                piece = piece * rng.randint(2, 5) + [rng.choice("xy")]
            words += piece * rng.choice([1, 1, 3, 4, 6])
        yield rng.choice([" ", "\n", " \t"]).join(words)


@pytest.mark.parametrize("repeats, shortest", [(4, 6), (2, 2), (3, 10)])
def test_runs_equal_trying_everything(repeats, shortest):
    given = list(texts(repeats, 250))
    got = periodic.reports([t.encode() for t in given], repeats, shortest)
    assert [(*r[:6], r[6].decode()) for r in got] == [plain(t, repeats, shortest) for t in given]
    assert sum(r[0] for r in got) > 100


def test_suffixes_are_sorted_and_share_what_they_say():
    rng = random.Random(4)
    sequences = [[rng.randint(1, 3) for _ in range(rng.randint(0, 40))] for _ in range(30)]
    words = np.array([w for s in sequences for w in [*s, 0]])
    owner = np.repeat(np.arange(len(sequences)), [len(s) + 1 for s in sequences])
    first, second, common = periodic.Suffixes(words, owner).neighbours(4)
    begins = np.concatenate([[0], np.cumsum([len(s) + 1 for s in sequences])])
    got = sorted((int(owner[a]), int(a - begins[owner[a]]), int(b - begins[owner[b]]), int(n)) for a, b, n in zip(first, second, common))
    want = []
    for k, s in enumerate(sequences):
        ordered = sorted(range(len(s)), key=lambda i: s[i:])
        for a, b in zip(ordered, ordered[1:]):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            if n >= 4:
                want.append((k, a, b, n))
    assert got == sorted(want)
    assert all(np.diff(common) <= 0)


CLASH = "doc_id bigint, text string, _id string, _text string, n_runs string, start string, runs string"


def test_odd_rows(spark):
    long = "one two three " * 30_000
    wide = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, wide), (6, "ha " * 9), (6, "ha " * 9), (None, "é é " * 7), (7, "a\u000bb\u000ca\u000bb a b a b a")]
    df = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], CLASH).repartition(3)
    got = sorted((tuple(r) for r in periodic.periodic_runs(df).collect()), key=repr)
    want = [(i, *plain(t)) for i, t in rows if i not in (4, 5)]
    want += [(4, 1, 0, 90_000, 3, 30_000_000, "0,90000,3\n", "one two three"), (5, 0, None, None, None, None, "", wide)]
    assert got == sorted(want, key=repr)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_batches_change_nothing(spark, monkeypatch):
    given = [(i, t) for i, t in enumerate(texts(9, 60))]
    df = spark.createDataFrame(given, "doc_id bigint, text string").coalesce(1)
    whole = sorted(tuple(r) for r in periodic.periodic_runs(df).collect())
    monkeypatch.setattr(periodic, "BATCH_WORDS", 40)
    assert [r for b in [list(periodic._batches([t.encode() for _, t in given]))] for r in b][-1][1] == len(given)
    assert [(i, *r[:6], r[6].decode()) for (i, t), r in zip(given, [periodic.reports([t.encode()])[0] for _, t in given])] == whole


def planted(doc_id, text):
    words = (text or "").encode().split()
    named = zlib.crc32(str(doc_id).encode())
    if named % 10 or not words:
        return words
    n, g = len(words), named // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_planted_periods(spark):
    rng = random.Random(8)
    rows = [(i, None if i % 41 == 0 else " \n".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 90)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", periodic.planted_period().alias("text"))
    assert {r.doc_id: (r.text or "").encode().split() for r in df.collect()} == {i: planted(i, t) for i, t in rows}
    got = {r.doc_id: r for r in periodic.periodic_runs(df, digests=True).collect()}
    for i, t in rows:
        want = plain(b" ".join(planted(i, t)).decode())
        assert (got[i].n_runs, got[i].start, got[i].period) == (want[0], want[1], want[3])
        assert got[i].runs_sha256 == hashlib.sha256(want[5].encode()).hexdigest()
        assert got[i].collapsed_sha256 == hashlib.sha256(want[6].encode()).hexdigest()
