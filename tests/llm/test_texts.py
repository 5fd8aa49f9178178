"""Operators that read texts: scores, chat, BPE, WARC; and the pipeline."""

import gzip
import hashlib
import io
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sheaf.llm import bpe, chat, quality_fm, queries, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ", _id string, _row string, _text string, score string, held_out string, ids string"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark, rows, extra=True):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows] if extra else rows, DOCS + CLASH if extra else DOCS)


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def held(spark, query, label, sf):
    found = query(spark, sf)
    both = found.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", label).toPandas()
    return both["score"].to_numpy(), both["predicted"].to_numpy(), both[label].to_numpy()


# Scores -----------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    score, predicted, label = held(spark, queries.op1_quality_machine, "quality", "/root/testdata/sf0.01")
    assert area(score, label) > 0.97 and (predicted == label).mean() > 0.95


def test_toxicity_on_held_out_documents(spark):
    score, predicted, label = held(spark, queries.op2_toxicity_channel, "toxic", "/root/testdata/sf0.1")
    assert area(score, label) > 0.93 and predicted[label == 0].mean() < 0.02 and predicted[label == 1].mean() > 0.8


ODD = [(1, None), (2, ""), (None, "some words here"), (3, "idiot " * 30_000), (4, "x" * 100_000), (4, "x" * 100_000), (5, "a" + " b" * 9000), (6, "\x00\n\n  ü😀")]


@pytest.mark.parametrize("scores", [quality_fm.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_rows_and_without_labels(spark, scores):
    labels = spark.createDataFrame([(3, 1, 1), (3, 0, None), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    for df in (labels, labels.limit(0)):
        got = scores(documents(spark, ODD), df).collect()
        assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in ODD)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in got)
    assert all(r.score == 0.5 for r in got)
    assert scores(documents(spark, []), labels).count() == 0


def test_held_out_labels_teach_nothing(spark):
    rows = [(i, ("good words " if i % 2 else "bad signs ") * 9) for i in range(200)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    turned = labels.withColumn("quality", F.when(quality_fm.held_out("doc_id", 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(repr, quality_fm.quality_scores(docs, x).collect())) for x in (labels, turned))
    assert a == b
    scores = {r.doc_id: r.score for r in quality_fm.quality_scores(docs, labels).collect()}
    assert all((s > 0.5) == (i % 2 == 1) for i, s in scores.items())


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    rows = [(rng.choice(50, n, replace=False).astype(np.int32), rng.normal(size=n).astype(np.float32)) for n in (3, 7, 1)]
    for (slots, x), got in zip(rows, m.score(rows)):
        z = m.bias + (m.linear[slots] * x).sum()
        z += sum(m.factors[slots[i]] @ m.factors[slots[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4


def letters(text):
    from pyspark.sql import SparkSession

    got = toxicity.gram_counts(documents(SparkSession.active(), [(1, text)])).toArrow()
    return toxicity.Letters(got.column("gram").to_numpy(), got.column("n").to_numpy())


def test_language_model_is_a_distribution_and_counts_whole_texts(spark):
    text = "ab, Cd é" * 300_000
    got = toxicity.gram_counts(documents(spark, [(1, text), (2, None), (3, "zz")]))
    assert got.agg(F.sum("n")).first()[0] >= 300_000 * 8
    log = letters("a few words and more words").log.reshape(-1, toxicity.SYMBOLS)
    assert np.allclose(np.exp(log).sum(1), 1, atol=1e-3)
    assert toxicity.gram_counts(documents(spark, [])).agg(F.sum("n")).first()[0] in (None, 3, 6)


def spaced_letters(text):
    words = list(map(toxicity._bare, text.encode().split()))
    return toxicity.spaced([w if len(w) <= toxicity.CHUNK else "" for w in words])


def all_paths(columns, log, words):
    """The best of all paths: every way of every column, and every word where it may stand."""
    start = (toxicity.BOUND * 28 + toxicity.BOUND) * 28 + toxicity.BOUND
    best = [-1e9, ""]

    def go(at, state, score, text):
        if at == len(columns):
            if score > best[0]:
                best[:] = score, text
            return
        for written, cost, _ in columns[at]:
            s, total = state, score + cost
            for c in written:
                k = toxicity._symbol(c)
                if k != toxicity.BOUND or s != start:
                    total += float(log[s * 28 + k])
                    s = start if k == toxicity.BOUND else s * 28 % 28**3 + k
            go(at + 1, s, total, text + written)
        if state == start:
            spelled = {"": 0.0}
            for end in range(at, len(columns) - 1):
                new = {}
                for before, cost in spelled.items():
                    for written, price, _ in columns[end]:
                        if " " not in written:
                            new[before + written] = max(new.get(before + written, -1e9), cost + price)
                spelled = new
                for w in words & set(spelled):
                    s = start
                    for c in w:
                        s = s * 28 % 28**3 + toxicity._symbol(c)
                    go(end + 1, s, score + toxicity.LISTED + spelled[w], text + w)

    go(0, start, 0.0, "")
    return best[1]


def test_decoding_finds_the_best_of_all_paths(spark):
    rng = random.Random(3)
    model = letters("the idiot and the moron told a worthless story to the stupid clown in the trash " * 50)
    for words in (set(), {"clown", "scum", "losers"}):
        tree = toxicity.word_tree(words)
        for _ in range(150):
            text = "".join(rng.choice("cl0owns$!u|m") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 6)))
            columns = [*toxicity.lattice(text), toxicity._END]
            assert toxicity.decode(text, model, tree=tree) == all_paths(columns, model.log, words)
        for hidden in ("(lown", "$cuum", "l0ssers"):
            assert toxicity.decode(hidden, model, tree=tree) == all_paths([*toxicity.lattice(hidden), toxicity._END], model.log, words)
        for parts in (["cl", "ow", "n"], ["los", "er", "s"], ["s", "cum"]):
            columns = [c for p in parts for c in (*toxicity.lattice(p), toxicity._BORDER)][:-1]
            assert toxicity.decode(parts, model, tree=tree) == all_paths([*columns, toxicity._END], model.log, words)


def obfuscated():
    """``kind, word, hidden word``: each of ten words four times in each of ten kinds."""
    rng = random.Random(1)
    digits, signs = str.maketrans("oieastgb", "01345798"), str.maketrans("asitcl", "@$!+(|")

    def chunks(w):
        cuts = [0]
        while cuts[-1] < len(w):
            cuts.append(min(len(w), cuts[-1] + rng.randint(1, 3)))
        return " ".join(w[a:b] for a, b in zip(cuts, cuts[1:]))

    def repeated(w, n):
        at = rng.randrange(len(w))
        return w[:at] + w[at] * n + w[at + 1 :]

    def halves(w):
        at = rng.choice([1, 2, 3, len(w) - 3, len(w) - 2, len(w) - 1])
        return f"{w[:at]} {w[at:]}"

    kinds = {
        "digits": lambda w: w.translate(digits), "signs": lambda w: w.translate(signs), "spaced": " ".join, "spaced digits": lambda w: " ".join(w.translate(digits)),
        "hyphens": "-".join, "doubled": lambda w: repeated(w, 2), "tripled": lambda w: repeated(w, 3), "all doubled": lambda w: "".join(c * 2 for c in w), "chunks": chunks, "halves": halves,
    }
    for kind, hide in kinds.items():
        for w in TOXIC_WORDS * 4:
            yield kind, w, hide(w)


TOXIC_WORDS = "idiot clown worthless loser scum garbage stupid moron trash pathetic".split()


def test_nine_of_ten_hidden_words_of_each_kind_are_restored(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = toxicity.gram_counts(texts).toArrow()
    model = toxicity.Letters(got.column("gram").to_numpy(), got.column("n").to_numpy())
    names = {w: zlib.crc32(w.encode()) | 1 for w in TOXIC_WORDS}
    reader = toxicity.Reader(model, {n: (1.0, 0.9) for n in names.values()}, tree=toxicity.word_tree(TOXIC_WORDS))
    hits = {}
    for kind, w, hidden in obfuscated():
        hits.setdefault(kind, []).append(reader.read(f"the house {hidden} garden".encode()) == {names[w]})
    assert {kind: sum(h) >= 36 for kind, h in hits.items()} == dict.fromkeys(hits, True)
    assert not reader.read("the closer house was worth less, so a trashy looking garden".encode())


def test_a_small_reader_reads_the_same(spark):
    model = letters("the idiot and the moron told a story " * 50)
    wanted = {zlib.crc32(w.encode()) | 1: (1.0, 0.9) for w in TOXIC_WORDS}
    large, small = toxicity.Reader(model, wanted), toxicity.Reader(model, wanted, most=3)
    for text in ("the 1d10t said", "", "id iot", "the garden", "a m o r o n", "clow n and lose r", "moron"):
        assert large.read(text.encode()) == small.read(text.encode())


def test_channel_restores_what_was_hidden(spark):
    model = letters("the idiot and the moron told a worthless story to the stupid clown in the trash scum " * 200)
    hidden = "1d10t m0r0n $tup1d w0rthl3ss tr@sh i.d.i.o.t s-c-u-m idiiiot stuuupid cl0wn st!upid"
    plain = "idiot moron stupid worthless trash idiot scum idiot stupid clown stupid"
    for a, b in zip(hidden.split(), plain.split()):
        assert toxicity._hidden(toxicity._core(a)) or a == b
        assert a == "st!upid" or toxicity.decode(a, model).strip() == b
    assert [toxicity.decode(s, model, True).strip() for s in spaced_letters("you i d i o t and a c l 0 w n")] == ["idiot", "a clown"]
    assert toxicity.decode("worthless", model).strip() == "worthless"


def test_hidden_words_are_found(spark):
    rng = random.Random(1)
    clean = "the story of a small house and its garden where nothing much was ever said to anyone at all".split()
    rows, labels = [], []
    for i in range(300):
        words = rng.choices(clean, k=40)
        if i % 3 == 0:
            words[rng.randrange(40)] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    planted = {1000: "the 1d10t said", 1001: "a house i d i o t garden", 1002: "such a m.o.r.o.n was", 1003: "mooooron and house", 1004: "the story of a house", 1005: "MOR0N"}
    got = toxicity.toxicity_scores(documents(spark, [*rows, *planted.items()]), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    found = {r.doc_id: r.predicted for r in got.where("doc_id >= 1000").collect()}
    assert found == {1000: 1, 1001: 1, 1002: 1, 1003: 1, 1004: 0, 1005: 1}


def scored(spark, planted):
    rng = random.Random(1)
    clean = "the story of a small house and its garden where nothing much was ever said to anyone at all".split()
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(clean, k=40)
        if i % 3 == 0:
            words[rng.randrange(40)] = rng.choice(["idiot", "clown", "worthless", "scum", "loser"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    docs = documents(spark, [*rows, *((1000 + i, f"the house {x} garden") for i, x in enumerate(planted))])
    got = toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    found = {r.doc_id: r.predicted for r in got.where("doc_id >= 1000").collect()}
    return [found[1000 + i] for i in range(len(planted))]


def test_signs_at_the_ends_of_a_word_may_be_letters(spark):
    planted = ["worthle$$", "w0rthle$$", "!diot", "!d10t", "(lown", "(l0wn", "(idiot)", "garden$$$", "house!"]
    assert scored(spark, planted) == [1] * 7 + [0] * 2


def test_repeats_and_spacing_of_every_kind(spark):
    planted = ["iddiot", "scumm", "lloser", "i d i o t.", '"i d i o t"', "id iot", "ii dd ii oo tt", "the sea", "a b c"]
    got = scored(spark, planted)
    assert got[:7] == [1] * 7 and got[7:] == [0] * 2
    assert spaced_letters("id\u00ef \u20ac i \u00e9 t") == ["\u20aci\u00e9t"]


# BPE --------------------------------------------------------------------------------------


def awkward_texts():
    rng = random.Random(1)
    alphabet = "aabbcde  \n\t'sré1２ß 　.!ñ😀\x00\x1c\u0085​"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(600)]
    texts += [t.replace("b", "<|endoftext|>") for t in texts[:100]]
    texts += ["", "a" * 30_000, "ab" * 20_000, " " * 5000 + "x", "é" * 3000, "x\n" * 3000, "<|endoftext|>", "don't we'll I'VE", "<|endoftext|"]
    return texts + [f"a{chr(c)} {chr(c)}1" for c in random.Random(2).sample([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], 3000)]


@pytest.mark.parametrize("rounds", [0, 3, bpe.ROUNDS])
def test_long_words_of_many_letters_equal_the_library(monkeypatch, rounds):
    """After any number of rounds the rest goes on in order of rank with the same tokens."""
    monkeypatch.setattr(bpe, "ROUNDS", rounds)
    rng, library, known = random.Random(5), Tokenizer.from_file(BPE), bpe.Vocabulary(BPE)
    parts = ["ab", "the", "ing", "é", "東京", "=", "-", " ", "1", "zz", "Q"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(300))).replace(" ", rng.choice(["", " "])) for _ in range(60)]
    texts += ["".join(rng.choices(letters, k=20_000)) for letters in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", "acgt", "ab", "=-")]
    known.digests(texts)  # all pieces in one flat array
    assert [known.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_word_of_a_million_letters(spark):
    began = time.time()
    word = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    got = bpe.encode_digests(documents(spark, [(1, word)]), BPE).first()
    assert time.time() - began < 90
    assert got.n_tokens == len(Tokenizer.from_file(BPE).encode(word, add_special_tokens=False).ids)


def test_tokens_equal_the_library(spark):
    library = Tokenizer.from_file(BPE)
    texts = awkward_texts()
    docs = documents(spark, [*enumerate(texts), (None, None), (3, texts[3])])
    want = library.encode_batch(texts, add_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = {i: (len(e.ids), sha(",".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))) for i, e in enumerate(want)}
    rows[None] = (0, sha(""), sha(""))
    got = bpe.encode_digests(docs, BPE).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == rows[r.doc_id]
    ids = bpe.encode_ids(docs, BPE)
    back = {r.doc_id: r.text for r in bpe.decode_ids(ids, BPE).collect()}
    assert back == {**dict(enumerate(texts)), None: ""}
    assert bpe.encode_digests(documents(spark, []), BPE).count() == 0


def test_a_full_memory_changes_nothing(monkeypatch):
    texts = awkward_texts()[:200]
    whole = bpe.Vocabulary(BPE).digests(texts)
    monkeypatch.setattr(bpe, "MEMORY", 5)
    small = bpe.Vocabulary(BPE)
    assert [d for t in texts for d in small.digests([t])] == whole


def test_tokens_of_given_documents_equal_the_library(spark):
    library = Tokenizer.from_file(BPE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op6_bpe(spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# Chat -------------------------------------------------------------------------------------


def test_conversations_round_trip(spark):
    rows = [
        (1, 1, "assistant", "fine\\|<|im_end|>\n<|im_start|>user\n"), (1, 0, "user", "hi \\ <\\| <| \\n"), (1, None, "system", None), (1, 2, None, "<"),
        (2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, 1, "role\nwith <|im_end|>\\n", "x" * 70_000), (None, 0, "assistant", " é😀"),
        (3, 0, "user", ""), (3, 5, "assistant", "<|im_end|><|im_start|>assistant ok"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    made = chat.format_conversations(df)
    for r in made.collect():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        turns = [(role, text) for *_, role, text in turns]
        assert chat.read_markup(r.formatted) == turns and r.n_turns == len(turns) and r.rewrites_at is None
        assert [chat.unescape(r.formatted[s.start : s.stop]) for s in r.spans] == [t for _, t in turns]
        assert [s.loss for s in r.spans] == [role == "assistant" for role, _ in turns]
    got = {r.conv_id: r for r in chat.conversation_digests(made).collect()}
    assert got[2].loss_chars == 0 and got[2].n_turns == 3 and got[1].loss_chars == len(rows[0][3])
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_a_template_that_rewrites_history_is_told(spark):
    def numbered(turns):
        return f"{len(turns)} turns\n" + "".join(f"{r}: {t}\n" for r, t in turns)

    def last_only(turns):  # drops what the assistant said before
        return "".join(f"[{r}]{t if r != 'assistant' or k + 1 == len(turns) else ''}\n" for k, (r, t) in enumerate(turns))

    def closed(turns):
        return "<s>" + "".join(f"[{r}] {t} [/{r}]" for r, t in turns)

    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    with pytest.raises(chat.Rewrites) as e:
        chat.spans(numbered, turns)
    assert e.value.turn == 0
    with pytest.raises(chat.Rewrites) as e:
        chat.spans(last_only, turns)
    assert e.value.turn == 2 and e.value.at == len("[user]a\n[assistant]")
    text, found = chat.spans(closed, turns)
    assert [text[a:b] for *_, a, b in found] == ["a", "b", "c"] and found[0][0] == 3
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    row = chat.format_conversations(df, last_only).first()
    assert row.rewrites_at == 2 and row.spans is None


# WARC -------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    same = "<p>the same page</p>" * 10
    rows = [(5, "http://a/ü?x=1\r\nWARC-Type: x", same), (3, None, same), (3, None, same), (9, "u", same), (None, "n", same), (1, "s", "short"), (2, "s", "short"), (4, "e", None), (6, "e", ""), (7, "crlf", "WARC/1.1\r\n\r\n" * 50), (8, "long", "é\x00" * 600_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, payload string, size int")
    got = warc.archive_pages(pages.repartition(3), str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        revisit = html == same and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert r.payload == (None if revisit else html.encode())
    for f in tmp_path.glob("*.members.warc.gz"):
        index = warc.read_index(str(f))
        raw = f.read_bytes()
        assert sum(length for _, length, _ in index) == len(raw)
        whole = gzip.decompress(f.with_name(f.name.replace(".members", "")).read_bytes())
        assert b"".join(gzip.decompress(raw[o : o + n]) for o, n, _ in index) == whole
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_broken_streams_are_errors():
    good = warc.record(1, "u", 3, "d", b"abc", None)
    assert list(warc.split_records([good[:7], good[7:] + good])) == [good, good]
    packed = gzip.compress(good) + gzip.compress(good)
    assert b"".join(warc.inflate(io.BytesIO(packed))) == good * 2
    for broken in (good[:-1], good + b"x", b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.split_records([broken]))
    with pytest.raises(ValueError):
        list(warc.inflate(io.BytesIO(packed[:-4])))


# Pipeline ---------------------------------------------------------------------------------


def test_stages_decide_and_keep_the_columns(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(out.count())
        if name != "mixing sources to target weights":
            assert out.subtract(docs).count() == 0 and sizes[-1] < sizes[-2] + 1
        docs = out
    assert sizes[1] < sizes[0] and sizes[4] > sizes[3]
    good = labels.where("quality = 1").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").count()
    assert sizes[1] >= 0.95 * good
    # The whole run, against the stages' rules in plain Python: what is left and how its texts are encoded.
    library = Tokenizer.from_file(BPE)
    want = sorted((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) == want


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None), (1, ""), (2, "a b"), (2, "a b"), (3, "ab"), (4, "long text " * 9000)]])
def test_stages_on_odd_rows(spark, rows, tmp_path):
    docs = documents(spark, rows)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert set(r.doc_id for r in docs.collect()) == ({3, 4} if rows else set()) or {r.doc_id for r in docs.collect()} == {2, 4}
