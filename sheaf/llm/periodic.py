"""Periodic runs of words: suffix classes united by falling common prefix, and text without its repeated periods."""

from __future__ import annotations

import hashlib
from bisect import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import text_or_empty

#: A run repeats its period at least this often and has at least this many words.
REPEATS, SHORTEST = 4, 6
#: Words whose texts are handled together; a longer text is handled alone.
BATCH_WORDS = 400_000


# Suffixes -----------------------------------------------------------------------------------


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``key`` and, at each place of that order, whether a new value begins."""
    order = np.argsort(key, kind="stable")
    held = key[order]
    return order, np.append(True, held[1:] != held[:-1])


class Suffixes:
    """Suffixes of several word sequences, sorted as far as they share words with another of their sequence.

    ``words`` are numbers from 1 with a 0 behind every sequence; ``owner`` numbers the sequence of each place.
    By doubling, ``ranks[k]`` orders the places by their next ``2**k`` words; a place whose rank is its own keeps it
    and leaves the work, so a round costs what still repeats.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        n = len(words)
        ends = np.flatnonzero(words == 0)
        self.end = ends[owner]  # where each place's sequence ends
        order, new = _grouped(owner.astype(np.int64) * (int(words.max(initial=0)) + 1) + words)
        first = np.flatnonzero(new)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(first, np.diff(np.append(first, n)))
        self.ranks = [rank]
        size = np.bincount(rank, minlength=n)
        active, step = np.flatnonzero(size[rank] > 1), 1
        self.repeated = active
        while len(active):
            rank = self.ranks[-1].copy()
            after = rank[np.minimum(active + step, self.end[active])]
            order, new = _grouped(rank[active] * n + after)
            held = active[order]
            old = rank[held]
            group = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
            group = np.repeat(group, np.diff(np.append(group, len(held))))
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(held)))
            rank[held] = old + np.repeat(first, sizes) - group
            self.ranks.append(rank)
            active, step = np.sort(held[np.repeat(sizes > 1, sizes)]), step * 2

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``a`` and ``b`` share."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[k][a] == self.ranks[k][b]
            total += same.astype(np.int64) << k
            a = np.where(same, np.minimum(a + (1 << k), self.end[a]), a)
            b = np.where(same, np.minimum(b + (1 << k), self.end[b]), b)
        return total

    def neighbours(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours in suffix order that share ``least`` words or more, and how many, most first."""
        level = min(least.bit_length() - 1, len(self.ranks) - 1)
        rank = self.ranks[level]
        places = self.repeated
        places = places[np.bincount(rank[places], minlength=len(rank))[rank[places]] > 1]
        places = places[np.argsort(self.ranks[-1][places], kind="stable")]
        a, b = places[:-1], places[1:]
        near = rank[a] == rank[b]
        a, b = a[near], b[near]
        common = self.shared(a, b)
        keep = np.flatnonzero(common >= least)
        keep = keep[np.argsort(-common[keep], kind="stable")]
        return a[keep], b[keep], common[keep]


# Runs -----------------------------------------------------------------------------------------


def least_shared(repeats: int = REPEATS, shortest: int = SHORTEST) -> int:
    """The fewest words that the suffixes at a run's start and one period on share: ``length - period`` at its least."""
    return min(max(shortest, repeats * q) - q for q in range(1, shortest + 1))


def runs(words: np.ndarray, owner: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """``start, end, period`` of every run of period and length as asked, places counted over all sequences.

    Neighbouring suffixes are joined by falling common prefix, the smaller ordered set of places into the larger.
    When places ``i < j`` become neighbours in their set, ``j - i`` is a period from ``i`` on if that is within the
    common prefix, and the smallest one: a smaller would have put a place between them before. A run's own start
    has the longest common prefix of all its places, so it is the first that is seen with that period and that end.
    """
    least = least_shared(repeats, shortest)
    if not len(words):
        return []
    first, second, common = Suffixes(words, owner).neighbours(least)
    member: dict[int, list[int]] = {}
    found: dict[tuple[int, int], int] = {}
    for a, b, shared in zip(first.tolist(), second.tolist(), common.tolist()):
        larger, smaller = member.get(a), member.get(b)
        if larger is None:
            larger = [a]
        if smaller is None:
            smaller = [b]
        if len(larger) < len(smaller):
            larger, smaller = smaller, larger
        most = shared // (repeats - 1)  # the longest period this prefix repeats often enough
        before = -1
        for k, place in enumerate(smaller, 1):
            # Only neighbours from different sets are new.
            at = bisect(larger, place)
            if at and (left := larger[at - 1]) != before and place - left <= most:
                found.setdefault((place - left, place + shared), left)
            if at < len(larger) and (right := larger[at]) - place <= most and (k == len(smaller) or right < smaller[k]):
                found.setdefault((right - place, right + shared), place)
            larger.insert(at, place)
            member[place] = larger
            before = place
        if len(larger) == len(smaller) + 1:  # a place that was alone so far
            for place in larger:
                member[place] = larger
    return [(start, end, period) for (period, end), start in found.items() if end - start >= max(shortest, repeats * period)]


# Texts -----------------------------------------------------------------------------------------


def _report(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """Number of runs, the longest one, all runs as lines, and the text without what repeats an earlier period."""
    found = sorted((s, e - s, q) for s, e, q in found)
    text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    if longest is None:
        return 0, None, None, None, None, text, b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in found:
        drop[s + q] += 1
        drop[s + n] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    return len(found), *longest, 1000 * longest[1] // longest[2], text, b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def reports(texts: list[bytes], repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple]:
    """``_report`` of every text; the suffixes of all are sorted together, but only those of one text ever meet."""
    split = [t.split() for t in texts]  # bytes split at exactly the space, tab, line feed, VT, FF and CR
    counts = np.fromiter(map(len, split), np.int64, len(split))
    names = pc.dictionary_encode(pa.array([w for words in split for w in words], pa.binary())).indices.to_numpy().astype(np.int64) + 1
    firsts = np.concatenate([[0], np.cumsum(counts + 1)])
    numbers = np.zeros(firsts[-1], np.int64)
    numbers[np.arange(len(names)) + np.repeat(np.arange(len(split)), counts)] = names
    owner = np.repeat(np.arange(len(split)), counts + 1)
    of: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for start, end, period in runs(numbers, owner, repeats, shortest):
        i = int(owner[start])
        of[i].append((start - int(firsts[i]), end - int(firsts[i]), period))
    return [_report(words, found) for words, found in zip(split, of)]


def _batches(texts: list[bytes]):
    """Ranges of texts with about ``BATCH_WORDS`` words, guessed from their sizes."""
    begun, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) // 6 + 1
        if size > BATCH_WORDS or i == len(texts) - 1:
            yield begun, i + 1
            begun, size = i + 1, 0


COLUMNS = [
    ("n_runs", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("period", T.LongType()), ("exponent_milli", T.LongType()),
    ("runs", T.StringType()), ("collapsed", T.StringType()),
]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text: Column | None = None, repeats: int = REPEATS, shortest: int = SHORTEST, digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``<id>, n_runs, start, length, period, exponent_milli, runs, collapsed``.

    A run is a stretch of words that repeats a smallest period at least ``repeats`` times, has ``shortest`` words
    or more and cannot be made longer. ``start`` to ``exponent_milli`` tell of the longest run (ties: the first,
    then that of the smallest period) and are null without one. ``runs`` has a line ``start,length,period`` for each
    run by start, then period; ``collapsed`` is the text without the words that some run holds after its first
    period, joined by spaces. ``digests`` gives SHA-256 digests of these two instead, as ``runs_sha256`` and
    ``collapsed_sha256``. ``text`` may be an expression to read instead of ``text_col``.

    Every row is read whole by the task that holds it; nothing is shuffled. Null and empty texts have no runs and
    an empty rest. Ids may be null or repeat; other columns are ignored; no rows give no rows.
    """
    sent = docs.select(F.col(id_col).alias("_id"), (text_or_empty(text_col) if text is None else F.coalesce(text, F.lit(""))).cast("binary").alias("_text"))
    schema = T.StructType([sent.schema["_id"], *(T.StructField(f"{n}_sha256" if digests and t == T.StringType() else n, t) for n, t in COLUMNS)])
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, last in _batches(texts):
                rows = reports(texts[first:last], repeats, shortest)
                if digests:
                    rows = [(*r[:5], hashlib.sha256(r[5].encode()).hexdigest(), hashlib.sha256(r[6]).hexdigest()) for r in rows]
                else:
                    rows = [(*r[:6], r[6].decode("utf-8", "replace")) for r in rows]
                arrays = [pa.array(values, t) for values, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), *arrays], names=schema.names)

    return sent.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def planted_period(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text; where the id's CRC-32 ends in the digit 0, its words from a place on repeat a period of their own."""
    named = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(named % 10 == 0, _repeated(words, F.floor(named / 10).cast("bigint"))).otherwise(F.col(text_col))


def _repeated(words: Column, g: Column) -> Column:
    """Words from ``a = g % n`` on are those of ``a`` and the ``p - 1`` after it, in turn."""

    def spelled(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        at = F.sequence(F.lit(0).cast("bigint"), n - 1)
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")).otherwise(F.lit(""))

    # The words are bound once, as the only element of an array.
    return F.transform(F.array(words), spelled)[0]
