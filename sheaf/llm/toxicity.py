"""Toxicity: noisy-channel deobfuscation under a character language model, then a lexicon learnt from labels."""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import text_or_empty
from sheaf.llm.quality_fm import held_out, labelled_sample

# Character language model -----------------------------------------------------------------

#: a-z, 26 what bounds a word, 27 bytes of other letters.
SYMBOLS, BOUND, OTHER, ORDER = 28, 26, 27, 4
GRAMS = SYMBOLS**ORDER
WINDOW = 1 << 20
_SYMBOL = np.full(256, BOUND, np.int32)
_SYMBOL[97:123] = np.arange(26)
_SYMBOL[65:91] = np.arange(26)
_SYMBOL[128:] = OTHER


def _symbol(c: str) -> int:
    return int(_SYMBOL[ord(c)]) if ord(c) < 128 else OTHER


def windows(text: bytes):
    """Pieces of about ``WINDOW`` bytes, cut where words end if they do; every byte is in one of them."""
    at = 0
    while len(text) - at > WINDOW:
        cut = text.rfind(b" ", at, at + WINDOW)
        cut = cut if cut > at else at + WINDOW
        yield text[at:cut]
        at = cut
    yield text[at:]


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram, n``: counts of runs of four symbols over the whole texts of all documents; every task adds its own up first."""

    def add(counts, text):
        """Whatever bounds words counts as three bounds, so that a word's start knows nothing of the word before."""
        s = _SYMBOL[np.frombuffer(b" " + text + b" ", np.uint8)]
        bound = s == BOUND
        times = np.where(bound, np.where(np.append(True, ~bound[:-1]), 3, 0), 1)
        s = np.repeat(s, times)
        code = s[:-3].copy()
        for i in (1, 2, 3):
            code = code * SYMBOLS + s[i : len(s) - 3 + i]
        counts += np.bincount(code, minlength=GRAMS)

    def run(batches):
        counts, held, size = np.zeros(GRAMS, np.int64), [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                held.append(text)
                size += len(text)
                if size > WINDOW:
                    for part in windows(b" ".join(held)):
                        add(counts, part)
                    held, size = [], 0
        for part in windows(b" ".join(held)):
            add(counts, part)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["gram", "n"])

    sent = docs.select(text_or_empty(text_col).cast("binary").alias("_text"))
    return sent.mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


class Letters:
    """log p(symbol | three symbols before), interpolated with shorter runs. At most ``GRAMS`` numbers, whatever the corpus."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        counts = np.zeros(GRAMS)
        counts[grams] = n
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in range(1, ORDER + 1):
            c = counts.reshape(SYMBOLS ** (ORDER - order), SYMBOLS**order).sum(0).reshape(-1, SYMBOLS)
            p = np.tile(p, (SYMBOLS if order > 1 else 1, 1)).reshape(-1, SYMBOLS)  # the shorter run's, for each symbol before it
            p = (c + 5 * p) / (c.sum(1, keepdims=True) + 5)
        self.log = np.log(p).astype(np.float32).ravel()

    @functools.cached_property
    def listed(self) -> list[float]:
        """The same numbers as Python's, which single look-ups read faster; made where they are used, never sent."""
        return self.log.tolist()


# Channel ----------------------------------------------------------------------------------

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u",
}
STANDS, DROPPED, KEPT, TWICE_OF_MANY, ONCE_OF_MANY, ONCE_OF_TWO, WORD_END = -0.7, -0.4, -3.0, -1.2, -0.3, -2.0, -0.5


Way = tuple[str, float, tuple[int, ...]]


def ways(*written: tuple[str, float]) -> list[Way]:
    """What was written, the channel's log probability and the symbols."""
    return [(text, cost, tuple(map(_symbol, text))) for text, cost in written]


@functools.lru_cache(maxsize=10_000)
def column(c: str, n: int) -> list[Way]:
    """What a run of a character may have been; ``n`` of 3 stands for more, too.

    A letter is itself, once or twice if it is repeated; a sign stands for letters, was put in, or bounds words.
    """
    if c.isalpha() and c not in LEET:
        return ways((c, 0.0)) if n == 1 else ways((c, ONCE_OF_TWO if n == 2 else ONCE_OF_MANY), (c * 2, 0.0 if n == 2 else TWICE_OF_MANY))
    stands = [(x, STANDS) for x in LEET.get(c, "")]
    if n > 1:
        stands += [(x * 2, STANDS * 2) for x in LEET.get(c, "")]
    return ways(*stands, ("", DROPPED if not stands else DROPPED - 2), (" ", KEPT))


def lattice(text: str) -> list[list[Way]]:
    """A column for each run of one character."""
    return [column(c, min(len(run), 3)) for run, c in _RUNS.findall(text)]


_RUNS = re.compile(r"((.)\2*)", re.DOTALL)


def readings(core: str, most: int = 16) -> list[str] | None:
    """All that ``lattice`` says a word of letters may have been, if these are ``most`` words or fewer; None if it has signs or more readings."""
    if not core.isalpha() or "µ" in core:
        return None
    found = [""]
    for run, c in _RUNS.findall(core):
        found = [w + c for w in found] if len(run) == 1 else [w + x for w in found for x in (c, c + c)]
        if len(found) > most:
            return None
    return found


_BORDER = ways(("", 0.0), (" ", WORD_END))
_END = ways((" ", 0.0))


#: log p of a word of the lexicon, written whole at the start of a word: what a word list says in place of the letters.
LISTED = -10.0


def word_tree(words) -> dict:
    """Words as nested dicts by letter; at a word's end the empty letter has the word."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return tree


def listed_words(columns: list[list[Way]], at: int, tree: dict):
    """``end, word, cost``: the words of the tree that columns from ``at`` to before ``end`` may have been."""
    nodes = {id(tree): (tree, 0.0)}
    for end in range(at, len(columns)):
        new: dict[int, tuple[dict, float]] = {}
        for node, cost in nodes.values():
            for written, price, _ in columns[end]:
                to = node
                for c in written:
                    to = to.get(c)
                    if to is None:
                        break
                if to is not None and (id(to) not in new or cost + price > new[id(to)][1]):
                    new[id(to)] = to, cost + price
        if not new:
            return
        nodes = new
        for node, cost in nodes.values():
            if "" in node:
                yield end + 1, node[""], cost


def decode(text: str | list[str], model: Letters, letters_apart: bool = False, tree: dict | None = None) -> str:
    """The likeliest original of ``text``: Viterbi over the lattice; a state is the last three symbols.

    Between letters that stood apart, and between the parts of a list, a word may end. A word of ``tree`` is a path,
    too: where a word starts it may be taken whole for ``LISTED`` instead of its letters' cost.
    """
    if isinstance(text, str):
        columns = lattice(text)
        if letters_apart:
            columns = [way for c in columns for way in (c, _BORDER)]
    else:
        columns = [way for part in text for way in (*lattice(part), _BORDER)][:-1]
    columns.append(_END)
    log = model.listed
    start = (BOUND * SYMBOLS + BOUND) * SYMBOLS + BOUND
    ahead: list[dict[int, tuple[float, tuple]]] = [{} for _ in range(len(columns) + 1)]
    ahead[0][start] = 0.0, ()
    for at, choices in enumerate(columns):
        states, new = ahead[at], ahead[at + 1]
        ahead[at] = None
        if len(choices) == 1 and len(choices[0][2]) == 1 and choices[0][2][0] != BOUND:  # a letter that is itself
            written, cost, (k,) = choices[0]
            for state, (score, back) in states.items():
                total = score + cost + log[state * SYMBOLS + k]
                s = state * SYMBOLS % SYMBOLS**3 + k
                if s not in new or total > new[s][0]:
                    new[s] = total, (back, written)
            choices = ()
        for state, (score, back) in states.items() if choices else ():
            for written, cost, symbols in choices:
                s, total = state, score + cost
                for k in symbols:
                    if k != BOUND or s != start:
                        total += log[s * SYMBOLS + k]
                        s = start if k == BOUND else s * SYMBOLS % SYMBOLS**3 + k
                if s not in new or total > new[s][0]:
                    new[s] = total, (back, written)
        if tree and start in states:
            score, back = states[start]
            for end, word, cost in listed_words(columns[:-1], at, tree):
                s, total = start, score + cost + LISTED
                for c in word[-3:]:
                    s = s * SYMBOLS % SYMBOLS**3 + _symbol(c)
                if s not in ahead[end] or total > ahead[end][s][0]:
                    ahead[end][s] = total, (back, word)
    _, back = max(ahead[-1].values(), key=lambda x: x[0])
    parts = []
    while back:
        back, written = back
        parts.append(written)
    return "".join(reversed(parts))


_AROUND = ".,;:?\"'()[]{}<>-_*#%&~^=/\\`!"
#: Of these the signs that stand for no letter.
_EDGES = "".join(c for c in _AROUND if c not in LEET)


def _core(word: str) -> str:
    """The word without what stands around it."""
    word = word.strip(_AROUND)
    return _MONEY.sub("", word).strip(_AROUND) if word.endswith("$$") else word


_MONEY = re.compile(r"\${2,}$")
_LETTER = re.compile(r"[^\W\d_]")
_ODD = re.compile(r"[^\w']|[\d_]|([^\W\d_])\1")
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
_DOUBLED = re.compile(rb"([a-z])\1")


def _hidden(core: str) -> bool:
    """Letters among signs, or a letter several times in a row."""
    return bool(_ODD.search(core) and _LETTER.search(core))


def _unsigned(text: str) -> str:
    """A word without the signs around it, which stay where nothing else is."""
    return text.strip(_EDGES) or text if len(text) > 1 else text


def _bare(word: bytes) -> str:
    return _unsigned(word.decode("utf-8", "replace"))


#: A chunk is a word of one to three characters, signs around it apart.
CHUNK = 3


def chunk_runs(words: list[bytes], chunks) -> list[tuple[int, int]]:
    """From where to where neighbouring words are chunks."""
    short = np.fromiter(map(chunks.__contains__, words), bool, len(words))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], short, [False]]).astype(np.int8))).tolist()
    return list(zip(edges[::2], edges[1::2]))


def spaced(chunks: list[str]) -> list[str]:
    """Letters written one by one: three or more neighbouring chunks of one character each, repeated equally often; it counts once."""
    found, run, size = [], [], 0
    for c in [*chunks, ""]:
        n = len(c) if c and c == c[0] * len(c) else 0
        if n != size:
            if size and len(run) >= 3:
                found.append("".join(run))
            run, size = [], n
        if n:
            run.append(c[0])
    return found


_PLAIN = str.maketrans({c: x[0] for c, x in LEET.items()})
_SIGNS = re.compile("[" + re.escape("".join(LEET)) + "]")


def plain(word: str) -> bytes:
    """The word in small letters, each sign as the first letter it stands for."""
    return (word.translate(_PLAIN) if _SIGNS.search(word) else word).lower().encode()


def chunked(spelled: list[bytes], sizes: list[int], wanted) -> list[tuple[int, int]]:
    """From where to where two to five neighbouring chunks spell a word of more than three characters in ``wanted``.

    ``spelled`` has the chunks in plain spelling, ``sizes`` their characters.
    """
    found, crc = [], zlib.crc32
    for at in range(len(spelled) - 1):
        name = crc(spelled[at])
        for end, more in enumerate(spelled[at + 1 : at + 5], at + 2):
            name = crc(more, name)
            if name | 1 in wanted and sum(sizes[at:end]) > CHUNK:
                found.append((at, end))
    return found


# Features ---------------------------------------------------------------------------------


def word_features(word: str) -> list[int]:
    """Names, as numbers of 32 bits, of a word (odd) and of its beginnings (even), which inflected words share."""
    n = len(word)
    if n < 3:
        return []
    sent = word.encode()
    names = [zlib.crc32(sent) | 1]
    for size in (4, 5, 6):
        if n >= size:
            beginning = sent[:size] if len(sent) == n else word[:size].encode()
            names.append(zlib.crc32(b"-", zlib.crc32(beginning)) & ~1)
    return names


class Reader(dict):
    """Features of tokens, as written and as restored. Maps a token to those in ``wanted`` (None: all)."""

    def __init__(self, letters: Letters, wanted: dict[int, tuple[float, float]] | None = None, most: int = 400_000, tree: dict | None = None):
        super().__init__()
        self.letters, self.wanted, self.most, self.tree = letters, wanted, most, tree
        #: Of each token in this reader its plain spelling; the chunk, if it is one; of each text that was decoded, its features.
        self.spelled: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, str] = {}
        self.decoded: dict[str, tuple[int, ...]] = {}

    def select(self, features) -> tuple[int, ...]:
        if self.wanted is None:
            return tuple(set(features))
        kept = [f for f in features if f in self.wanted]
        return tuple(set(kept)) if kept else ()

    def named(self, word: str, sent: bytes) -> tuple[int, ...]:
        """What ``select`` leaves of the features of a word (``sent`` as bytes), told without making a list of all."""
        n, wanted, crc = len(word), self.wanted, zlib.crc32
        if wanted is None:
            return self.select(word_features(word))
        if n < 3:
            return ()
        kept = [name] if (name := crc(sent) | 1) in wanted else []
        if n >= 4:
            plain, beginning = len(sent) == n, 0
            for size in (4, 5, 6) if n >= 6 else (4, 5) if n == 5 else (4,):
                if plain:
                    beginning = crc(sent[size - 1 : size], beginning) if size > 4 else crc(sent[:4])
                else:
                    beginning = crc(word[:size].encode())
                if (name := crc(b"-", beginning) & ~1) in wanted:
                    kept.append(name)
        return tuple(set(kept)) if kept else ()

    def restored(self, text: str | list[str], letters_apart: bool = False) -> list[int]:
        return [f for w in decode(text, self.letters, letters_apart, self.tree).split() for f in word_features(w)]

    def core_features(self, core: str) -> tuple[int, ...]:
        if (found := self.decoded.get(core)) is None:
            # Where no reading of a word counts, the likeliest doesn't either.
            few = readings(core) if self.wanted is not None else None
            if few is None or any(self.named(w, w.encode()) for w in few):
                found = self.select(self.restored(core))
            else:
                found = ()
            self.decoded[core] = found
        return found

    def __missing__(self, token: bytes) -> tuple[int, ...]:
        cores: tuple[str, ...] = ()
        if token.isalpha():  # of ASCII: it has no signs at its ends and hides only what doubled letters hide
            sent = token.lower()
            word = sent.decode()
            if len(token) <= CHUNK:
                self.chunks[token] = token.decode()
            if _DOUBLED.search(sent):
                cores = (word,)
            self.spelled[token] = token if sent == token else sent
        else:
            text = token.decode("utf-8", "replace")
            bare, full = _unsigned(text), text.lower()
            if len(bare) <= CHUNK:
                self.chunks[token] = bare
            word = full if full[0].isalnum() and full[-1].isalnum() else _ENDS.sub("", full)
            sent = word.encode()
            # With and without the signs at its ends that may be letters.
            core, other = _core(full), full.strip(_EDGES)
            if _hidden(core):
                cores = (core,)
            if other != core and _hidden(other):
                cores += (other,)
            self.spelled[token] = plain(bare)
        kept = self.named(word, sent)
        if cores:
            kept = tuple({*kept, *(f for core in cores for f in self.core_features(core))})
        self[token] = kept
        return kept

    def across(self, words: list[bytes]):
        """Features of what neighbouring words spell together: letters one by one, chunks, and a chunk beside a longer word.

        Letters one by one are all decoded. Of the others those are decoded whose plain spelling counts, and count if
        the likeliest reading joins them.
        """
        chunks, spelled, wanted, crc = self.chunks, self.spelled, self.wanted, zlib.crc32
        for a, b in chunk_runs(words, chunks):
            run = [chunks[w] for w in words[a:b]] if b - a > 1 else ()
            if b - a >= 3:
                for letters in spaced(run):
                    yield from self.restored(letters.lower(), True)
            if not wanted:  # until it is known which words count
                continue
            joined = []
            if b - a == 2:
                if crc(spelled[words[a + 1]], crc(spelled[words[a]])) | 1 in wanted and len(run[0]) + len(run[1]) > CHUNK:
                    joined.append((a, b))
            elif run:
                joined += [(a + i, a + k) for i, k in chunked([spelled[w] for w in words[a:b]], list(map(len, run)), wanted)]
            if a and crc(spelled[words[a]], crc(spelled[words[a - 1]])) | 1 in wanted:
                joined.append((a - 1, a + 1))
            if b < len(words) and crc(spelled[words[b]], crc(spelled[words[b - 1]])) | 1 in wanted:
                joined.append((b - 1, b + 1))
            for i, k in joined:
                yield from self.restored([_bare(w).lower() for w in words[i:k]])

    def read(self, text: bytes) -> set[int]:
        if len(self) >= self.most:
            self.clear()
            self.spelled.clear()
            self.chunks.clear()
            self.decoded.clear()
        words = text.split()
        found: set[int] = set()
        for f in filter(None, map(self.__getitem__, set(words))):
            found.update(f)
        found.update(self.select(self.across(words)))
        return found


# Model ------------------------------------------------------------------------------------

TRAIN_ROWS = 8_000
#: A feature enters the lexicon when chance gives its split between toxic and other rows with odds below about e^-13.
EVIDENCE = 26.0
CAUTION = 20


@dataclass
class Lexicon:
    """``words`` has a feature's weight in the regression and what it says where it stands alone; beginnings say nothing alone."""

    bias: float
    words: dict[int, tuple[float, float]]
    #: The words themselves, of more than three letters, as the labelled rows spell them.
    spelled: tuple[str, ...] = ()

    def score(self, found: set[int]) -> float:
        z = self.bias + sum(self.words[f][0] for f in found)
        together = float(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        return max([together, *(self.words[f][1] for f in found)])


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 300) -> Lexicon:
    """Features that toxic rows hold clearly more often, then a logistic regression on them.

    Toxic rows mostly hold several such features, which leaves each a small weight; so each word also has the
    share of toxic rows among those that hold it, drawn towards the share of all by ``CAUTION`` rows.

    Labels of one kind only, or none, give their smoothed share and no lexicon.
    """
    toxic = int((labels == 1).sum())
    clean = len(labels) - toxic
    prior = float(np.log((toxic + 1) / (clean + 1)))
    if not toxic or not clean:
        return Lexicon(prior, {})
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, place = np.unique(np.concatenate(rows), return_inverse=True)
    n1 = np.bincount(place, labels[owner], len(names))
    n0 = np.bincount(place, minlength=len(names)) - n1
    share, expect = n1 / (n1 + n0), toxic / (toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(n1 > 0, n1 * np.log(share / expect), 0) + np.where(n0 > 0, n0 * np.log((1 - share) / (1 - expect)), 0))
    kept = np.flatnonzero((g >= EVIDENCE) & (share > expect))
    column = np.full(len(names), -1)
    column[kept] = np.arange(len(kept))
    at = column[place]
    owner, at = owner[at >= 0], at[at >= 0]
    w, bias = np.zeros(len(kept)), prior
    mean_w, mean_b = np.full(len(kept), 1e-6), 1e-6
    for _ in range(epochs):
        z = bias + np.bincount(owner, w[at], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels) / len(rows)
        gw = np.bincount(at, error[owner], len(kept)) + 2e-5 * w
        gb = error.sum()
        mean_w, mean_b = mean_w + gw * gw, mean_b + gb * gb
        w = np.maximum(w - 0.3 * gw / np.sqrt(mean_w), 0)  # toxic words never speak for a text
        bias -= 0.3 * gb / np.sqrt(mean_b)
    alone = (n1[kept] + CAUTION * expect) / (n1[kept] + n0[kept] + CAUTION) * (names[kept] % 2)
    return Lexicon(float(bias), {int(names[k]): (float(x), float(p)) for k, x, p in zip(kept, w, alone)})


def train(docs: DataFrame, labels: DataFrame, usable, letters: Letters, id_col="doc_id", text_col="text", label_col="toxic", limit: int = TRAIN_ROWS) -> Lexicon:
    sample = labelled_sample(labels, id_col, label_col, usable, limit)
    sent = docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).cast("binary").alias("_text"))
    # The sample is limited, so its broadcast is too.
    sent = sent.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_label", "_text")

    def run(batches):
        reader = Reader(letters)
        for b in batches:
            found = [np.sort(np.fromiter(reader.read(t), np.uint32)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["label", "found"])

    # A repeated id brings more rows than the sample has ids: the limit holds for rows too.
    got = sent.mapInArrow(run, "label int, found binary").limit(limit).toArrow()
    got = sorted(zip(got.column("found").to_pylist(), got.column("label").to_pylist()))
    lexicon = fit([np.frombuffer(f, np.uint32) for f, _ in got], np.array([x for _, x in got], float))
    return replace(lexicon, spelled=spelled_words(sent.select("_text"), lexicon.words))


def spelled_words(texts: DataFrame, names) -> tuple[str, ...]:
    """The words of more than three letters that features are named after; as many as there are names, but for equal checksums."""
    names = frozenset(names)

    def run(batches):
        found = set()
        for b in batches:
            for token in {t for text in b.column(0).to_pylist() for t in text.split()}:
                word = _ENDS.sub("", token.decode("utf-8", "replace").lower())
                if len(word) > CHUNK and word.isalpha() and zlib.crc32(word.encode()) | 1 in names:
                    found.add(word)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    return tuple(sorted(r.word for r in texts.mapInArrow(run, "word string").distinct().collect())) if names else ()


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", parts: int = 5, part: int = 0) -> DataFrame:
    """One row per row of ``docs``: ``<id>, held_out, score, predicted``.

    Character statistics come from all documents, the lexicon from at most ``TRAIN_ROWS`` labelled ones
    that are not held out. Texts are read whole, as written and as restored from leetspeak, spacing and
    repetition; id, language and source are never inputs. Null and empty texts score what the labels' share and
    the absence of toxic words say; without labels of both kinds that is all there is, 0.5 for no labels.
    Repeated rows score alike. No rows give no rows; other columns are ignored.
    """
    counts = gram_counts(docs, text_col).toArrow()  # at most GRAMS rows
    letters = Letters(counts.column("gram").to_numpy(), counts.column("n").to_numpy())
    lexicon = train(docs, labels, ~held_out(id_col, parts, part), letters, id_col, text_col, label_col)
    # Of bounded size; what a reader has decoded stays with its worker process from task to task.
    held = docs.sparkSession.sparkContext.broadcast((Reader(letters, lexicon.words, tree=word_tree(lexicon.spelled)), lexicon))
    sent = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).cast("binary").alias("_text"))
    schema = T.StructType([sent.schema["_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        reader, lexicon = held.value
        for b in batches:
            found = [lexicon.score(reader.read(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=schema.names)

    scored = sent.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
    return scored.select(id_col, held_out(id_col, parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
