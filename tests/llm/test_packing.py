"""Packing: best fills against trying all sums, and whole packs checked piece by piece."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sheaf.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def sums(counts, room):
    reach = {0}
    for length, n in counts.items():
        reach = {s + length * k for s in reach for k in range(n + 1) if s + length * k <= room}
    return max(reach)


@pytest.mark.parametrize("seed", range(60))
def test_best_fill_equals_trying_all(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 60): rng.randint(0, 9) for _ in range(rng.randint(0, 6))}
    room = rng.randint(0, 150)
    taken = packing.best_fill(counts, room)
    assert all(0 < n <= counts[length] for length, n in taken.items())
    assert sum(length * n for length, n in taken.items()) == sums(counts, room)


def check(counts, plan, window):
    """Every token of every rest lies in one place, and every sequence is gapless and of a size it may have."""
    places = packing.Places(plan.entries)
    held = {}
    for rest, n in counts.items():
        for number in range(n):
            pieces = places.find(rest, number)
            at = 0
            for start, length, sequence, offset in pieces:
                assert start == at and length > 0
                at += length
                held.setdefault(sequence, []).append((offset, length))
            assert at == rest
    sizes = []
    for sequence in range(plan.sequences):
        at = 0
        for offset, length in sorted(held.pop(sequence)):
            assert offset == at
            at += length
        sizes.append(at)
    assert not held
    tokens = sum(k * n for k, n in counts.items())
    assert sizes[: tokens // window] == [window] * (tokens // window)
    rest = sizes[tokens // window :]
    assert sorted(rest, reverse=True) == rest and len(set(rest)) == len(rest) and all(s & (s - 1) == 0 for s in rest)


@pytest.mark.parametrize("seed", range(60))
def test_plans_are_whole_and_without_padding(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 64, 256])
    kinds = rng.choice([1, 3, 30])
    counts = {}
    for _ in range(kinds):
        counts[rng.randint(1, window - 1)] = rng.choice([1, 2, rng.randint(1, 400)])
    check(counts, packing.Plan(counts, window), window)


def test_a_plan_grows_with_lengths_not_with_documents():
    rng = random.Random(1)
    few = {k: rng.randint(1, 9) for k in range(1, 4096)}
    small, large = packing.Plan(few), packing.Plan({k: n * 1_000_000 for k, n in few.items()})
    tokens = sum(k * n for k, n in few.items())
    assert small.sequences == tokens // 4096 + (tokens % 4096).bit_count()
    assert len(large.entries) < 12 * 4096
    hot = packing.Plan({3000: 10**12})
    assert hot.sequences == 3000 * 10**12 // 4096 + (3000 * 10**12 % 4096).bit_count() and len(hot.entries) < 5000


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


STRANGE = [
    "", " ", "\n\t\u000b", "Plain words, and don't they'll IT'S 'S 's", "<|endoftext|> a<|startoftext|>b <|endof text|>", "École ́ é İstanbul ΟΔΟΣ ΟΔΟΣ. ΣΑΣ",
    "a b c\u0085d\u001ce　f", "日本語 テキスト한국어", "x" * 3000, "😀😀 👨‍👩‍👧 ‍", "12345 3.14 1,000", "ﬁ ﬁ ½ ① Å K", "__init__ ??!! ---", " a b", "'", "' s 't'll",
]


def test_words_are_encoded_as_in_their_texts(monkeypatch):
    rng = random.Random(7)
    texts = STRANGE + ["".join(rng.choice("aB'sé \ń<|>Σ1_.,-!İβ") for _ in range(60)) for _ in range(300)]
    texts += [" ".join(rng.sample(STRANGE, 5)) for _ in range(50)]
    whole_texts = library()
    want = [np.array(whole_texts.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for t in texts]
    assert packing.Words(PATH).encode(pa.array(texts), 2) == want
    plain = [k for k, t in enumerate(texts) if "<|" not in t]
    assert packing.Words(PATH).encode(pa.array([texts[k] for k in plain]), 2) == [want[k] for k in plain]
    monkeypatch.setattr(packing, "MEMORY", 20)
    small = packing.Words(PATH)
    assert [small.encode(pa.array([t]), 2)[0] for t in texts] == want


def whole(rows, texts, window):
    """Check the pieces of a pack; ``texts`` are the documents' texts by id, several of one id allowed."""
    t = library()
    ids = {i: [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in given] for i, given in texts.items()}
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    tokens = sum(len(x) for given in ids.values() for x in given)
    assert len(places) == tokens // window + (tokens % window).bit_count()
    for i, given in ids.items():
        own = sorted([r for r in rows if r.doc_id == i], key=lambda r: r.start)
        assert sum(r.length for r in own) == sum(map(len, given))
        for r in own:
            assert any(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in given)


CLASH = "doc_id bigint, text string, _id string, _row string, n string, ids string, rest string, length string"


@pytest.mark.parametrize("window", [64, 4096])
def test_packs_of_odd_rows(spark, window):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "same words"), (3, "same words"), (None, "no id"), (4, "many different words " * 6000), *((10 + k, t) for k, t in enumerate(STRANGE))]
    rows += [(100 + k, " ".join(rng.choice(["alpha", "beta,", "Gamma", "1"]) for _ in range(rng.choice([3, 3, 40, rng.randint(0, 300)])))) for k in range(200)]
    df = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], CLASH).repartition(5)
    got = packing.with_crc(packing.pack_documents(df, PATH, window=window)).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    whole(got, texts, window)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_pieces_hold_their_ids(spark):
    df = spark.createDataFrame([(k, "to be or not to be " * k) for k in range(30)], "doc_id bigint, text string")
    t = library()
    for r in packing.pack_documents(df, PATH, closing=7, window=16).collect():
        ids = [*t.encode("to be or not to be " * r.doc_id, add_special_tokens=False).ids, 7]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]
