"""Packing of token sequences into windows by minimum bin slack.

A document is cut into whole windows and a rest. Rests are known to the plan only by how many there are of each
length, at most ``window`` numbers whatever the corpus. The plan repeats, on the driver: take the longest length
left, find by a bitset subset-sum which multiset of the lengths left fills the window best with it, and use that
multiset as often as its lengths last. Every use but the last leaves some length with fewer pieces than the
multiset takes, so the number of steps depends on the window, not on the documents.

What a fill lacks is cut from another rest, and what is left over as a group of its own goes back to the lengths.
The tokens that remain after the last whole window are cut into windows whose sizes are powers of two.

Every rest has a number among those of its length; the plan's entries are ranges of such numbers, so each task
finds the places of its own pieces by binary search.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.bpe import in_slices
from sheaf.llm.common import running_total, text_or_empty
from sheaf.session import store_table

WINDOW = 4096
#: Words that a worker remembers with their ids.
MEMORY = 200_000
#: A small letter or digit and a sign behind it, where a token ends. An apostrophe may begin one with letters, a bar lies in added tokens.
BORDER = r"([a-z0-9])([!-&(-/:-@\[-`{}~])"

# Tokens ---------------------------------------------------------------------------------------


class Words:
    """Token ids of texts, as bytes of unsigned 32-bit numbers, encoded by the tokenizers library.

    For vocabularies that write all letters small and drop white space: no token spans it, and nothing at one
    word's characters depends on another word, so a text's ids are those of its words in turn, and a word is
    encoded once. Words also end at signs behind letters, where these vocabularies end a token. The last ``MEMORY`` to twice as many words are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words, which are distinct."""
        if len(self.known) > MEMORY:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        unknown = []
        for w in words:
            if w not in known:
                if (held := older.get(w)) is None:
                    unknown.append(w)
                else:
                    known[w] = held
        for w, coded in zip(unknown, self.library.encode_batch_fast(unknown, add_special_tokens=False)):
            known[w] = array("I", coded.ids).tobytes()
        return [known[w] for w in words]

    def encode(self, texts: pa.Array, closing: int) -> list[bytes]:
        """The ids of each text and the closing one."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # added tokens are known by their letters' case
            texts = pc.ascii_lower(texts)
        parted = pc.replace_substring_regex(texts, pattern=BORDER, replacement=r"\1 \2")
        split = pc.ascii_split_whitespace(parted)  # the space, tab, line feed, VT, FF and CR
        coded = split.flatten().dictionary_encode()
        ids = [*self.ids(coded.dictionary.to_pylist()), array("I", [closing]).tobytes()]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        places = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(counts), len(ids) - 1)
        many = lengths[places]
        ends = np.cumsum(many)
        taken = np.arange(many.sum()) + np.repeat(starts[places] - (ends - many), many)
        sent = np.frombuffer(b"".join(ids), "<u4")[taken].tobytes()
        borders = [0, *(4 * ends[np.cumsum(counts + 1) - 1]).tolist()]
        return [sent[a:b] for a, b in zip(borders, borders[1:])]


@functools.lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """One per worker process and file; every executor reads the file where it is installed."""
    return Words(path)


def token_rows(docs: DataFrame, path: str, closing: int, id_col: str, text_col: str) -> DataFrame:
    """``_id, n, ids``: the ids of each whole text and the closing one, four bytes each."""
    sent = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    schema = T.StructType([sent.schema["_id"], T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        words = words_of(path)
        for b in batches:
            for part in in_slices(b, 1):
                ids = words.encode(part.column(1), closing)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return sent.mapInArrow(run, schema)


# Plan -----------------------------------------------------------------------------------------


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """A multiset of the lengths in ``counts`` whose sum is as near to ``room`` as any, and not above it.

    Bit ``s`` of a bitset says that ``s`` can be filled. Lengths come in falling order, each in portions of 1, 2, 4,
    ... pieces, so that a portion is one shift; the bitsets before every portion are kept to walk back.
    """
    mask = (1 << (room + 1)) - 1
    reach, portions, before = 1, [], []
    for length in sorted((k for k in counts if k <= room and counts[k] > 0), reverse=True):
        many, size = min(counts[length], room // length), 1
        while many > 0:
            part = min(size, many)
            before.append(reach)
            portions.append((length, part))
            reach |= reach << length * part & mask
            many, size = many - part, size * 2
            if reach >> room:
                break
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, {}
    for (length, part), reach in zip(reversed(portions), reversed(before)):
        if not reach >> total & 1:
            taken[length] = taken.get(length, 0) + part
            total -= length * part
    return taken


@dataclass(frozen=True)
class Entry:
    """Pieces of rests of one length: those numbered ``low`` to ``high``, their part at ``start``, and where they go.

    The piece numbered ``low + k`` is in sequence ``sequence + k // each``, at ``offset + k % each * length``.
    """

    rest: int
    low: int
    high: int
    start: int
    length: int
    sequence: int
    each: int
    offset: int


class Plan:
    """Entries for all rests, given how many there are of each length."""

    def __init__(self, counts: dict[int, int], window: int = WINDOW):
        self.window, self.entries, self.sequences = window, [], 0
        #: Of each length what is left: ranges of rests (their length, low, high) and where the part starts.
        self.left: dict[int, deque] = {}
        self.counts: dict[int, int] = {}
        for length, n in sorted(counts.items()):
            self.give_back(length, length, 0, n, 0)
        tokens = sum(length * n for length, n in self.counts.items())
        while tokens >= window:
            tokens -= self.window * self.fill(window, tokens // window)
        for bit in reversed(range(window.bit_length())):
            if tokens >> bit & 1:
                self.fill(1 << bit, 1)

    def give_back(self, length: int, rest: int, low: int, high: int, start: int) -> None:
        if length and high > low:
            self.left.setdefault(length, deque()).append((rest, low, high, start))
            self.counts[length] = self.counts.get(length, 0) + high - low

    def take(self, length: int, n: int):
        """Ranges of ``n`` pieces of this length."""
        held = self.left[length]
        self.counts[length] -= n
        while n:
            rest, low, high, start = held.popleft()
            part = min(n, high - low)
            yield rest, low, low + part, start
            if part < high - low:
                held.appendleft((rest, low + part, high, start))
            n -= part
        if not self.counts[length]:
            del self.counts[length], self.left[length]

    def place(self, length: int, each: int, times: int, offset: int, size: int | None = None) -> None:
        """Put ``each`` pieces of this length, or their first ``size`` tokens, into each of the next ``times`` sequences.

        An entry begins at a sequence's first piece or covers one sequence only, which keeps its arithmetic simple.
        """
        size = length if size is None else size
        at = 0
        for rest, low, high, start in list(self.take(length, each * times)):
            self.give_back(length - size, rest, low, high, start + size)
            while low < high:
                inside = at % each
                part = min(high - low, each - inside) if inside or high - low < each else (high - low) // each * each
                self.entries.append(Entry(rest, low, low + part, start, size, self.sequences + at // each, each, offset + inside * size))
                low, at = low + part, at + part

    def longer(self, room: int, taken: dict[int, int]) -> int:
        """The shortest length above ``room`` of which a piece is left besides those taken, else 0."""
        return min((k for k, n in self.counts.items() if k > room and n > taken.get(k, 0)), default=0)

    def fill(self, size: int, most: int) -> int:
        """Fill windows of ``size`` in one way, at most ``most`` of them; how many it were."""
        counts, longest = dict(self.counts), max(self.counts)
        if longest <= size:
            counts[longest] -= 1
            taken = best_fill(counts, size - longest)
            taken[longest] = taken.get(longest, 0) + 1
        else:  # only a window smaller than the others meets this
            taken = best_fill(counts, size)
        room = size - sum(length * n for length, n in taken.items())
        cut = 0
        if room:
            # A cut is needed in any case. With one length alone it serves many windows; a few odd pieces
            # among what is taken would let it serve few, so they wait for a window that they fill.
            alone = min(size // longest, self.counts[longest])
            if alone and (cut := self.longer(size - alone * longest, {longest: alone})):
                taken, room = {longest: alone}, size - alone * longest
            else:  # each piece not taken is longer than what is missing, or it would have been taken too
                cut = self.longer(room, taken)
        needed = {**taken, cut: taken.get(cut, 0) + 1} if room else taken
        times = min(most, *(self.counts[length] // n for length, n in needed.items()))
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            self.place(length, n, times, offset)
            offset += length * n
        if room:
            self.place(cut, 1, times, offset, room)
        self.sequences += times
        return times


class Places:
    """For a rest of a length and a number, its pieces: the plan's entries as arrays, found by binary search."""

    def __init__(self, entries: list[Entry], first_sequence: int = 0):
        starts: dict[int, set[int]] = {}
        for e in entries:
            starts.setdefault(e.rest, set()).update((e.low, e.high))
        self.base = 1 + max((e.high for e in entries), default=0)
        self.keys = np.array(sorted(rest * self.base + low for rest, cuts in starts.items() for low in cuts), np.int64)
        # An entry covers the elementary ranges between its ends.
        covers = []
        for k, e in enumerate(entries):
            a, b = np.searchsorted(self.keys, [e.rest * self.base + e.low, e.rest * self.base + e.high])
            covers.append(np.stack([np.arange(a, b), np.full(b - a, e.start), np.full(b - a, k)], 1))
        table = np.concatenate(covers) if covers else np.empty((0, 3), np.int64)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.entry = table[:, 2]
        self.first = np.searchsorted(table[:, 0], np.arange(len(self.keys) + 1))
        self.fields = np.array([(e.low, e.start, e.length, first_sequence + e.sequence, e.each, e.offset) for e in entries], np.int64).reshape(-1, 6)

    def find(self, rest: int, number: int) -> list[tuple[int, int, int, int]]:
        """``start, length, sequence, offset`` of each piece of a rest, first piece first."""
        at = int(np.searchsorted(self.keys, rest * self.base + number, side="right")) - 1
        found = []
        for k in self.entry[self.first[at] : self.first[at + 1]]:
            low, start, length, sequence, each, offset = self.fields[k].tolist()
            nth = number - low
            found.append((start, length, sequence + nth // each, offset + nth % each * length))
        return found


# Documents ------------------------------------------------------------------------------------


def pack_tokens(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of ``rows`` (``_id, n, ids``, as ``token_rows`` gives them): ``_id, start, length, ids, doc_tokens, sequence_id, offset``."""
    spark = rows.sparkSession
    rows = store_table(rows.withColumn("_row", F.monotonically_increasing_id()))
    narrow = rows.select("_row", (F.col("n") % window).alias("rest"), F.expr(f"n div {window}").alias("whole"))
    numbered = store_table(running_total(narrow.withColumn("_one", F.lit(1)), ["rest"], ["_row"], "_one", "number").drop("_one"))
    counts = {r.rest: r.n for r in numbered.where("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    plan = Plan(counts, window)
    long = running_total(numbered.where("whole > 0").select("_row", "whole"), [], ["_row"], "whole", "first")
    numbers = numbered.join(long.select("_row", "first"), "_row", "left").select("_row", "rest", "number", "first")
    held = spark.sparkContext.broadcast(Places(plan.entries, 0))  # of a size that the window bounds
    shapes = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    schema = T.StructType([rows.schema["_id"], *(T.StructField(n, t) for n, t in shapes)])
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    after = plan.sequences

    def run(batches):
        places = held.value
        for b in batches:
            for part in in_slices(b, 2):
                made, source = [], []
                columns = [part.column(i).to_pylist() for i in range(1, 6)]
                for k, (n, ids, rest, number, first) in enumerate(zip(*columns)):
                    pieces = [(i * window, window, after + first + i, 0) for i in range(n // window)]
                    if rest:
                        pieces += [(n - rest + s, size, seq, at) for s, size, seq, at in places.find(rest, number)]
                    made += [(s, size, ids[4 * s : 4 * (s + size)], n, seq, at) for s, size, seq, at in pieces]
                    source += [k] * len(pieces)
                arrays = [pa.array(values, t) for values, t in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(source)), *arrays], names=schema.names)

    joined = rows.join(numbers, "_row").select("_id", "n", "ids", "rest", "number", "first")
    return joined.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, closing: int = 2, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece of a document: ``<id>, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` has the piece's token ids, four bytes each, little endian. Sequences have ``window`` tokens, but for the
    last few, whose sizes are smaller powers of two; none is padded. A document longer than the window fills
    sequences of its own first. A null text is an empty one, whose only id is ``closing``; ids may be null or
    repeat, and repeated rows are packed each by itself. Other columns are ignored; no rows give no rows.
    """
    return pack_tokens(token_rows(docs, path, closing, id_col, text_col), window).withColumnRenamed("_id", id_col)


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of these."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
