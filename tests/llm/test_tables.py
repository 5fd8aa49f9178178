"""Operators that work on ids, hashes and counts: exact dedup, mixing, SimHash, lines, vectors, components."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sheaf.llm import common, cover_tree, exact_dedup, line_dedup, mixing, near_texts, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ", _id string, _row string, _text string, _hash string, size string, component_id string, keep_id string"
LONG = "long words and longer words again " * 4000


def documents(spark, rows, extra=False):
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    if extra:
        return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], DOCS + CLASH)
    return spark.createDataFrame(rows, DOCS)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "a"), (5, LONG.replace(" ", "\n"), "b"), (6, "a b", None),
    (7, "ab", "é"), (7, "ab", "é"), (None, "a  b", "a"), (None, None, "b"), (9, "ohne Trennung", "b"), (10, "a\u000bb c", "a"),
]


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Shared helpers ---------------------------------------------------------------------------


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(-400, 400), rng.randint(-400, 400)) for _ in range(300)]
    pairs += [(k, k + 1) for k in range(1000, 1200)] + [(5000, 5000 + k) for k in range(1, 300)]
    want = groups(pairs, {n for p in pairs for n in p})
    got = dict(collected(common.components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7))))
    assert got == {n: r for n, r in want.items() if n != r}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_few_edges_take_one_task_and_many_take_rounds(spark, monkeypatch):
    """A round of shuffles has as many tasks for few edges as for many, and the driver holds something of each."""
    rng = random.Random(6)
    pairs = [(rng.randint(-400, 400), rng.randint(-400, 400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1100)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7)
    stored = []
    store = common.store_table
    monkeypatch.setattr(common, "store_table", lambda df: (stored.append(df._jdf.queryExecution().executedPlan().toString()), store(df))[1])
    few = collected(common.components(edges))
    assert len(stored) == 2 and "Exchange" not in stored[1]
    want = groups(pairs, {n for p in pairs for n in p})
    assert dict(few) == {n: r for n, r in want.items() if n != r}
    stored.clear()
    assert collected(common.components(edges, block=0)) == few
    assert len(stored) > 2 and all("Exchange" in x for x in stored)


def test_running_total_splits_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_ROWS", 20)
    rng = random.Random(2)
    rows = [(None if k % 9 == 0 else ("hot" if k % 3 else "b"), rng.randint(0, 50), k, rng.randint(0, 9)) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v bigint")
    got = {r.i: r.before for r in common.running_total(df, ["k"], ["o", "i"], "v", "before").collect()}
    for k, o, i, _ in rows:
        assert got[i] == sum(w for l, p, j, w in rows if l == k and (p, j) < (o, i))


# Exact dedup ------------------------------------------------------------------------------


def brute_exact(rows):
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    by = {}
    for i, t, _ in rows:
        by.setdefault(strip(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t, _ in rows:
        g = by[strip(t)]
        keep = min(g)[3]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(strip(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_exact_dedup_on_odd_rows(spark, extra):
    docs = documents(spark, ODD, extra)
    got = exact_dedup.exact_dedup(docs)
    assert collected(got.drop("content_hash")) == brute_exact(ODD)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    want = {(r[1], r[4]) for r in brute_exact(ODD)}
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(k) for k, _ in want)


def test_exact_dedup_of_nothing(spark):
    docs = documents(spark, [])
    assert exact_dedup.exact_dedup(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0


def test_exact_dedup_splits_a_collision(spark, monkeypatch):
    # A hash that takes all texts of equal length for the same.
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lpad(F.hex(F.char_length(F.col(c) if isinstance(c, str) else c)), 32, "0"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(documents(spark, [(1, "ab", "a"), (2, "cd", "a"), (3, "a b", "a"), (4, "xyz", "a")])).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


# Mixing -----------------------------------------------------------------------------------


def filled(sizes, weights=(3, 1, 2), share=1.5, repeats=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(repeats * sizes[s] for s in full)
        open_ = sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and left * weight[s] / open_ > repeats * sizes[s]} if open_ else set()
        if not over:
            return {s: repeats * sizes[s] if s in full else left * weight[s] / open_ for s in sizes}
        full |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 50, 400])), rng.choice(["hot", "hot", "hot", "b", "c", "ä", "Z", None])) for i in range(600)] + ODD
    docs = documents(spark, rows, True)
    got = mixing.mix_sources(docs).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = filled(size)
    taken = {}
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken >= r.epochs * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.5 + 1e-6
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_complete_epochs_come_first(spark):
    rows = [(i, "a b c", "few") for i in range(5)] + [(100 + i, "a b c", "many") for i in range(95)]
    for r in mixing.mix_sources(documents(spark, rows)).where("source = 'few'").collect():
        assert r.taken == 6  # the smaller source reaches twice its size
    shares = [r.taken for r in mixing.mix_sources(documents(spark, rows)).where("source = 'many'").collect()]
    assert min(shares) >= 3 and max(shares) == 6


def test_weights_favour_good_documents(spark):
    docs = documents(spark, [(i, "aaaaa " * 20, "s") for i in range(3000)])
    heavy = F.when(F.col("doc_id") % 2 == 0, 10.0).otherwise(1.0)
    got = mixing.mix_sources(docs, weight=heavy, share=0.2).where("taken > 0").collect()
    share = sum(r.doc_id % 2 == 0 for r in got) / len(got)
    assert 0.86 < share < 0.95  # a first draw gives 10/11, later ones a little less


def test_mixed_documents_are_whole_rows(spark):
    docs = documents(spark, [r for r in ODD] + [(50 + i, "x y z " * (i + 1), "b") for i in range(30)], True)
    plan = mixing.mix_sources(docs, whole_documents=True).where("taken > 0").collect()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.taken // r.size for r in plan)
    assert mixing.mixed_documents(documents(spark, [])).count() == 0
    assert mixing.mix_sources(documents(spark, [])).count() == 0


# SimHash ----------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_every_set_of_positions_is_left_out_by_a_mask():
    masks = simhash.covering_masks()
    assert len(masks) == 31 and all(30 <= m.bit_count() <= 34 for m in masks)
    rng = random.Random(0)
    for _ in range(4000):
        changed = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & changed == 0 for m in masks)


def test_fingerprints_and_groups_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "GAMMA", "délta", "x", "yy", "zzz q"] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 60, 300]))
        rows.append((1000 + i, " ".join(words), "s"))
        for k in range(rng.choice([0, 0, 3])):  # near copies
            other = list(words)
            if len(other) > 20:
                other[rng.randrange(len(other))] = "changed"
            rows.append((2000 + 10 * i + k, "\t".join(other), "s"))
    rows += ODD
    docs = documents(spark, rows, True)
    got = simhash.simhash_groups(docs).collect()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    assert sorted((repr(r.doc_id), int(r.fingerprint, 16)) for r in got) == sorted((repr(i), p) for (i, _, _), p in zip(rows, prints))
    pairs = [(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 4]
    of = groups(pairs, set(prints))
    least = {}
    for (i, _, _), p in zip(rows, prints):
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    for r in got:
        assert r.component_id == least.get(of[int(r.fingerprint, 16)])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({of[p] for p in prints})
    assert simhash.simhash_groups(documents(spark, [])).count() == 0


def test_large_buckets_are_compared_in_blocks(spark):
    rng = random.Random(8)
    chain, fp = [], rng.getrandbits(63)
    for _ in range(150):
        for b in rng.sample(range(63), 4):
            fp ^= 1 << b
        chain.append(fp)
    prints = chain + [chain[0] ^ (1 << b) ^ (1 << c) for b in range(20) for c in range(20)]
    df = spark.createDataFrame([(p,) for p in sorted(set(prints))], "_fp bigint")
    for block in (16, 4096):
        edges = [tuple(r) for r in simhash.near_edges(df, block=block).collect()]
        assert all((a ^ b) >= 0 for a, b in edges)
        got = groups(edges, set(prints))
        want = groups([(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 4], set(prints))
        assert got == want


# Lines ------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def changed(rng, line, n):
    out = list(line)
    for _ in range(n):
        p = rng.randrange(len(out))
        out[p : p + 1] = rng.choice([[], ["q"], [out[p], "é"], ["😀"]])
    return "".join(out)


@pytest.mark.parametrize("limit", [0, 1, 2, 3])
def test_banded_distance_and_complete_candidates(limit):
    rng = random.Random(limit)
    bases = ["".join(rng.choices("abé", k=rng.randint(limit + 2, 24))) for _ in range(60)]
    lines = sorted({x for b in bases for x in (b, *(changed(rng, b, rng.randint(1, 4)) for _ in range(3))) if len(x) > limit})
    pairs = [(a, b) for k, a in enumerate(lines) for b in lines[k + 1 :]] + [("", ""), ("", "a"), ("x" * 5000, "x" * 4999 + "y")]
    want = np.array([edits(a, b) <= limit if len(a) < 100 else limit >= 1 for a, b in pairs])
    assert (line_dedup.within(pairs, limit) == want).all()
    key, owner, side = line_dedup.substring_keys(lines, limit)
    index = {}
    for k, o in zip(key[side == 0], owner[side == 0]):
        index.setdefault(k, set()).add(o)
    found = {tuple(sorted((o, p))) for k, o in zip(key[side == 1], owner[side == 1]) for p in index.get(k, ())}
    number = {x: i for i, x in enumerate(lines)}
    marks = line_dedup.signatures(lines)
    for (a, b), near in zip(pairs, want):
        if near and a in number and b in number:
            assert int(marks[number[a]] ^ marks[number[b]]).bit_count() <= 4 * limit
    assert all(tuple(sorted((number[a], number[b]))) in found for (a, b), near in zip(pairs, want) if near and a in number and b in number)


def brute_lines(rows, limit, least):
    strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    seen = sorted({(i is None, i or 0, t or "") for i, t, _ in rows}, key=lambda r: r[:2])
    places = {}
    for none, i, t in seen:
        for no, x in enumerate(t.split("\n")):
            if strip(x):
                places.setdefault(strip(x), []).append((none, i, no))
    near = [(a, b) for a in places for b in places if a < b and min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= limit and edits(a, b) <= limit]
    of = groups(near, set(places))
    first = {}
    for x, p in places.items():
        first[of[x]] = min([*p, first.get(of[x], p[0])])
    out = {}
    for none, i, t in seen:
        counts = [0, 0, 0, 0, 0]
        for no, x in enumerate(t.split("\n")):
            if x := strip(x):
                kept, own = first[of[x]] == (none, i, no), min(places[x]) == (none, i, no)
                for k, yes in enumerate((True, kept, not kept and not own, not kept and own)):
                    counts[k] += yes
                counts[4] += sum(x in p for p in near)
        out[None if none else i] = tuple(counts)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdef é", k=rng.randint(10, 70))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(f" {x}\t" if rng.random() < 0.3 else x for x in lines), "s"))
    rows += [(100, None, "s"), (101, "\n\n", "s"), (None, base[0] + "\n" + base[1], "s"), (5, rows[5][1], "s"), (102, "y" * 50_000 + "\n" + "y" * 49_999, "s")]
    docs = documents(spark, rows, True)
    got = {r[0]: tuple(r[1:]) for r in line_dedup.line_dedup(docs, least=20).collect()}
    small = [r for r in rows if r[0] != 102]
    assert {k: v for k, v in got.items() if k != 102} == brute_lines(small, 2, 20)
    assert got[102] == (2, 1, 0, 1, 2)
    cut = line_dedup.drop_lines(docs, least=20)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    for r in cut.collect():
        if r.doc_id == 100:
            assert r.text is None
        else:
            assert len([x for x in r.text.split("\n") if x.strip()]) == got[r.doc_id][1]
    assert line_dedup.line_dedup(documents(spark, [])).count() == 0


# Vectors ----------------------------------------------------------------------------------


def brute_vectors(rows):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = [[] for _ in rows]
    for i, (_, v) in enumerate(rows):
        for j, (_, w) in enumerate(rows):
            if i != j and ok(v) and ok(w) and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9:
                    links[i].append(j)
    of = groups([(i, j) for i, x in enumerate(links) for j in x], range(len(rows)))
    ids = {}
    for i, (name, v) in enumerate(rows):
        if name is not None:
            ids[of[i]] = min(name, ids.get(of[i], name))
    out = []
    for i, (name, v) in enumerate(rows):
        c = ids.get(of[i]) if ok(v) else name
        out.append((name, len(links[i]), c, name == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [8, 40, 4096])
def test_vector_groups_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    rows = [(int(i), [float(x) for x in centres[i % 12] * rng.uniform(0.01, 50) + rng.normal(size=6) * [0.02, 0.2, 0.6][i % 3]]) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(20)] + [(300 + i, [2 * x for x in rows[5][1]]) for i in range(3)]
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (405, [])]
    rows += [(None, rows[7][1]), (None, [1e200, 0.0, 0.0, 0.0, 0.0, 0.0]), (406, [1e-200, 0.0, 0.0, 0.0, 0.0, 0.0]), (7, rows[7][1]), (407, [1.0, 2.0]), (408, [1.0, 2.1])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, _node string")
    assert collected(cover_tree.embedding_groups(df, block=block)) == brute_vectors(rows)
    assert cover_tree.embedding_groups(df.limit(0)).count() == 0


def test_tree_levels_nest_and_cover():
    rng = np.random.default_rng(1)
    points = cover_tree.unit(np.repeat(rng.normal(size=(40, 5)), 6, axis=0) + rng.normal(size=(240, 5)) * 0.15)
    under = cover_tree.build(points)
    for level, radius in enumerate(cover_tree.RADII):
        d = np.sqrt(((points - points[under[:, level]]) ** 2).sum(1))
        assert d.max() <= radius + 0.01
        assert (under[under[:, level], level] == under[:, level]).all()
        if level:
            assert all(len(set(under[under[:, level] == n, level - 1])) == 1 for n in set(under[:, level]))


def test_near_texts_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):
        words = rng.choices(vocabulary, k=rng.choice([0, 2, 5, 6, 30, 80, 200, 600]))
        rows.append((100 * i, " ".join(words)))
        for k in range(rng.choice([0, 2, 6])):
            other = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                other.insert(rng.randint(0, len(other)), "changed")
            rows.append((100 * i + k + 1, "\n".join(other).upper()))
    rows += [(9000 + i, " ".join(["the same passage of some common words", *rng.choices(vocabulary, k=9)])) for i in range(40)]

    def parts(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [parts(t) for _, t in rows]
    prints = [plain_fingerprint(t) for _, t in rows]
    near = [(i, j) for j in range(len(rows)) for i in range(j) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = [(i, j) for i, j in near if (prints[i] ^ prints[j]).bit_count() > 4]
    assert far  # pairs that fingerprints alone miss
    links = near + [(i, j) for j in range(len(rows)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4]
    of = groups(links, set(range(len(rows))))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[of[i]] = min(doc, least.get(of[i], doc))
    docs = documents(spark, [(*r, "s") for r in rows])
    for block in (3, near_texts.BLOCK):
        kept = simhash.drop_near_copies(docs, links=near_texts.near_text_edges(docs, block=block))
        assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert near_texts.drop_near_texts(documents(spark, [])).count() == 0
