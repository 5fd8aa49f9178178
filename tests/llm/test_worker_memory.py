"""What Python workers keep after a step, and how many of them a task needs."""

import tracemalloc

import numpy as np
import public_tokenizers

from sheaf.llm import bpe, quality_fm, simhash
from sheaf.session import store_table


def kept_mb(work):
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    work()
    after = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    return (after - before) / 1e6


def test_pieces_seen_once_are_not_kept():
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{k * 1000 + i:x}q" for i in range(1000)) for k in range(350)]

    def work():
        for at in range(0, len(texts), 10):
            vocabulary.digests(texts[at : at + 10])

    assert kept_mb(work) < 75 and len(vocabulary.known) + len(vocabulary.older) < 2 * bpe.MEMORY + 40_000


def test_pieces_that_occur_again_stay(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    merged = []
    merge = vocabulary.merge
    monkeypatch.setattr(vocabulary, "merge", lambda pieces: (merged.extend(pieces), merge(pieces))[1])
    for k in range(40):
        vocabulary.digests(["common " + " ".join(f"x{k * 30 + i}" for i in range(30))])
    assert merged.count(b"common") == 1


def test_words_leave_nothing_in_the_quality_classifier():
    text = " ".join(f"w{i}" for i in range(150_000)).encode()
    assert kept_mb(lambda: quality_fm.features(text, [1.0])) < 2


def test_the_classifier_gets_a_text_once(spark):
    docs = spark.createDataFrame([(1, "good words é", 12), (2, None, None), (3, "", 0)], "doc_id bigint, text string, n_chars bigint")
    size = quality_fm.width(1)
    rng = np.random.default_rng(1)
    model = quality_fm.Machine(0.1, rng.normal(size=size).astype(np.float32), rng.normal(size=(size, 8)).astype(np.float32))
    apart = {r.doc_id: r.score for r in quality_fm.score(docs, model).collect()}
    row = docs.selectExpr("struct(*) as _row", "cast(n_chars as double) as n_chars")
    inside = quality_fm.score(row, model, 1, keep=("_row",))
    assert {r._row.doc_id: r.score for r in inside.collect()} == apart
    assert [r._row.text for r in inside.orderBy("_row.doc_id").collect()] == ["good words é", None, ""]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id bigint, quality int")
    plan = quality_fm.keep_good(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "_k0#" in plan and "_text#" not in plan


def test_edges_of_fingerprints_are_stored_before_they_are_joined_up(spark, monkeypatch):
    """Else one task would run two Python steps, in two workers."""
    plans = []
    found = simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: (plans.append(edges._jdf.queryExecution().optimizedPlan().toString()), found(edges))[1])
    docs = store_table(spark.createDataFrame([(i, "one two three four five six" + " x" * (i % 2)) for i in range(20)], "doc_id bigint, text string"))
    assert simhash.simhash_groups(docs).count() == 20
    assert plans and "MapInPandas" not in plans[0]
