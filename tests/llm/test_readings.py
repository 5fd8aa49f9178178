"""Words of doubled letters are decoded only where one of their readings counts, with the same features."""

import itertools
import random

import numpy as np

from sheaf.llm import toxicity


def reader(wanted):
    rng = np.random.default_rng(3)
    letters = toxicity.Letters(np.arange(toxicity.GRAMS), rng.integers(0, 40, toxicity.GRAMS))
    return toxicity.Reader(letters, wanted, tree=toxicity.word_tree(["idiot", "stupid", "barrel"]))


def texts(n=150):
    rng = random.Random(5)
    words = ["idiot", "stupid", "barrel", "año", "cañón", "letter", "moon", "$tupid", "1d1ot", "b-a-r-r-e-l", "x", "yo", "co$$t", "µicro", "(idiot)", "Ärger!!", "h3llo$$"]
    doubled = lambda w: "".join(c * rng.choice((1, 1, 1, 2, 3)) for c in w)
    return [" ".join(doubled(rng.choice(words)) + rng.choice(("", ".", ",", "!", "$$")) for _ in range(40)).encode() for _ in range(n)] + [b"\xff\xfe aab\xffbb", b"", b"_ __ 0 !!"]


WANTED = {f: (1.0, 0.5) for w in ("idiot", "stupid", "barrel", "cañón") for f in toxicity.word_features(w)}


def test_features_are_those_of_decoding_everything():
    all_features, some = reader(None), reader(WANTED)
    for text in texts():
        plain = {f for w in set(text.split()) for f in all_features[w] if f in WANTED}
        assert {f for w in set(text.split()) for f in some[w]} == plain


def test_words_whose_readings_do_not_count_are_not_decoded(monkeypatch):
    read, seen = toxicity.decode, []
    monkeypatch.setattr(toxicity, "decode", lambda text, *more: (seen.append(text), read(text, *more))[1])
    found = reader(WANTED).read(b"letter moon ciionllos barrel iidiott")
    assert seen and set(seen) <= {"barrel", "iidiott"} and found


def test_readings_are_the_ways_through_the_lattice():
    for word in ("letter", "aabbb", "moon", "añño", "x"):
        ways = {"".join(w) for w in itertools.product(*([written for written, _, _ in c] for c in toxicity.lattice(word)))}
        assert set(toxicity.readings(word)) == ways
    assert toxicity.readings("a1") is None and toxicity.readings("µm") is None and toxicity.readings("aabbccddee") is None
