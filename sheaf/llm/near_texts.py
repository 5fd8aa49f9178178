"""Near copies by the Jaccard similarity of five-word shingles: an exact prefix join, beside the fingerprints of ``simhash``."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import components, text_or_empty
from sheaf.llm.simhash import SEED, drop_near_copies, fingerprint
from sheaf.session import store_table

#: Texts are near whose sets of shingles of ``WORDS`` words share at least ``SHARE`` (a fraction) of their union.
WORDS, SHARE = 5, (4, 5)
#: Buckets that shingles are counted in, so that rare ones come first; and 64-bit words of a text's signature.
COUNT_BITS, MARKS = 18, 4
BLOCK, ROWS = 2048, 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PIECE = "_piece bigint, _node bigint, _size int, _place int, _side int"


# Sets -------------------------------------------------------------------------------------


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's shingles: lower-cased words as in ``fingerprint``; few words: all of them."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(WORDS))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both * SHARE[1] >= SHARE[0] * (len(a) + len(b) - both)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which near texts share one: all but so many of the commonest as a near text must share, and one more.

    Any order that all texts follow will do; with rare ones first few texts meet.
    """
    n = len(hashes)
    return hashes[np.argsort(counts[_bucket(hashes)], kind="stable")][: n - -(-n * SHARE[0] // SHARE[1]) + 1]


def signature(hashes: np.ndarray) -> np.ndarray:
    """Bits that say whether a bin holds an odd number of shingles: texts differ in at most as many bits as shingles."""
    odd = np.bincount((hashes % np.uint64(MARKS * 64)).astype(np.int64), minlength=MARKS * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


# Meetings ---------------------------------------------------------------------------------


def meetings(piece, size, place, side, marks=None):
    """Pairs of rows that may be near, nearest rows first; rows are sorted by piece and size.

    A pair need only pass at the first shingle of its order that it shares: what it can share is what follows.
    """
    up, down = SHARE
    at, step = np.arange(len(piece)), 1
    while True:
        at = at[at + step < len(piece)]
        at = at[(piece[at + step] == piece[at]) & (down * size[at] >= up * size[at + step])]
        if not len(at):
            return
        a, b = at, at + step
        rest = np.minimum(size[a] - place[a], size[b] - place[b])
        hit = ((side[a] < 0) | (side[a] != side[b])) & (rest * (up + down) >= up * (size[a] + size[b]))
        a, b = a[hit], b[hit]
        if marks is not None and len(a):
            apart = np.bitwise_count(marks[a] ^ marks[b]).sum(1, dtype=np.int64)
            hit = apart * (up + down) <= (down - up) * (size[a] + size[b])
            a, b = a[hit], b[hit]
        yield a, b
        step += 1


def _rows(pdf):
    pdf = pdf.sort_values(["_piece", "_size", "_node"])
    return pdf, [pdf[c].to_numpy(np.int64) for c in ("_piece", "_size", "_place", "_side")]


def _pairs(nodes, a, b):
    x, y = nodes[np.concatenate(a or [[]]).astype(np.int64)], nodes[np.concatenate(b or [[]]).astype(np.int64)]
    found = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})
    return found[found["a"] != found["b"]].drop_duplicates()


def _shared(pdf):
    """The rows that meet another one."""
    pdf, columns = _rows(pdf)
    met = np.zeros(len(pdf), bool)
    for a, b in meetings(*columns):
        met[a] = met[b] = True
    return pdf[met]


def _first_mates(pdf):
    """Each row with the nearest shorter text that it may be near to, else with the nearest longer one: enough to connect most groups."""
    pdf, columns = _rows(pdf)
    shorter, longer = np.full(len(pdf), -1), np.full(len(pdf), -1)
    for a, b in meetings(*columns, np.stack(pdf["_marks"].map(lambda m: np.frombuffer(m, np.uint64)))):
        new = shorter[b] < 0
        shorter[b[new]] = a[new]
        new = longer[a] < 0
        longer[a[new]] = b[new]
    mate = np.where(shorter < 0, longer, shorter)
    own = np.flatnonzero(mate >= 0)
    return _pairs(pdf["_node"].to_numpy(np.int64), [own], [mate[own]])


def _other_mates(pdf):
    """All pairs that may be near and are not connected yet."""
    pdf, columns = _rows(pdf)
    root, first, second = pdf["_root"].to_numpy(np.int64), [], []
    for a, b in meetings(*columns, np.stack(pdf["_marks"].map(lambda m: np.frombuffer(m, np.uint64)))):
        apart = root[a] != root[b]
        first.append(a[apart])
        second.append(b[apart])
    return _pairs(pdf["_node"].to_numpy(np.int64), first, second)


def by_piece(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over whole pieces, about ``ROWS`` rows at a time."""

    def run(batches):
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < ROWS:
                continue
            pdf = pd.concat(held)
            last = pdf["_piece"].to_numpy() == pdf["_piece"].iloc[-1]  # may go on in the next batch
            if not last.all():
                yield work(pdf[~last])
                pdf = pdf[last]
            held, size = [pdf], len(pdf)
        if size:
            yield work(pd.concat(held))

    return rows.repartition("_piece").sortWithinPartitions("_piece").mapInPandas(run, schema)


# Spark ------------------------------------------------------------------------------------


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many texts hold shingles of a bucket: 2^COUNT_BITS numbers, whatever the corpus."""

    def run(batches):
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(counts, _bucket(shingles(t)), 1)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["bucket", "n"])

    got = texts.select("_text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return counts


def prefix_rows(texts: DataFrame, counts: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``_piece, _node, _size, _place, _side``: the prefix of every text, its shingles dealt to pieces.

    Shingles that many texts hold are dealt to blocks and every two blocks are one piece, as in ``simhash.near_edges``.
    How many is read off the counts above what a bucket holds on average.
    """
    held, usual = texts.sparkSession.sparkContext.broadcast(counts), int(counts.mean())

    def run(batches):
        counts = held.value
        for b in batches:
            out, size = [], 0
            for node, t in [*zip(b.column(0).to_pylist(), b.column(1).to_pylist()), (None, None)]:
                if t is not None and len(own := shingles(t)):
                    keys = prefix(own, counts)
                    blocks = np.maximum(1, -(-(counts[_bucket(keys)] - usual) // block))
                    mine = (np.uint64(node & (1 << 64) - 1) % blocks.astype(np.uint64)).astype(np.int64)
                    which = np.repeat(np.arange(len(keys)), blocks)
                    other = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    low, high = np.minimum(mine[which], other), np.maximum(mine[which], other)
                    piece = (keys[which] ^ ((low * blocks[which] + high).astype(np.uint64) * _MIX)).view(np.int64)
                    side = np.where(mine[which] == other, -1, mine[which])
                    out.append((piece, np.full(len(which), node), np.full(len(which), len(own)), which, side))
                    size += len(which)
                if out and (t is None or size > ROWS):
                    columns = [np.concatenate(c) for c in zip(*out)]
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_piece", "_node", "_size", "_place", "_side"])
                    out, size = [], 0

    return texts.select("_hash", "_text").mapInArrow(run, _PIECE)


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, fa, fb``: those of the pairs of texts that are near, and their fingerprints.

    Here and below stored tables are joined by a shuffle, by hint: near texts take little on disk and much in a broadcast.
    """
    pairs = store_table(pairs.distinct())
    nodes = pairs.select(F.col("a").alias("_hash")).union(pairs.select("b")).distinct()
    used = store_table(texts.join(nodes, "_hash", "left_semi").dropDuplicates(["_hash"]))
    one, two = (used.select(F.col("_hash").alias(f"_h{k}"), F.col("_text").alias(f"_t{k}")) for k in "ab")
    met = pairs.join(one.hint("merge"), F.col("a") == F.col("_ha")).join(two.hint("merge"), F.col("b") == F.col("_hb")).select("a", "b", "_ta", "_tb")

    def run(batches):
        for batch in batches:
            known, out = {}, []

            def of(node, text):
                if node not in known:
                    if len(known) > 200:
                        known.clear()
                    known[node] = shingles(text)
                return known[node]

            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if near(of(a, x), of(b, y)):
                    out.append((a, b, *(int(np.uint64(fingerprint(t)).view(np.int64)) for t in (x, y))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["a", "b", "fa", "fb"])

    return met.mapInArrow(run, "a bigint, b bigint, fa bigint, fb bigint")


def near_text_edges(docs: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``a, b``: edges between fingerprints that, with those of equal fingerprints, connect all texts that are near.

    Every pair of near texts meets at a shingle of both prefixes. First each text is compared with one mate per
    shingle, which connects most groups without all their pairs; then what is not connected yet.
    """
    text = text_or_empty(text_col)
    texts = docs.select(F.xxhash64(text).alias("_hash"), text.cast("binary").alias("_text"))

    def marks(batches):
        for b in batches:
            made = pa.array([signature(shingles(t)).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), made], names=["_of", "_marks"])

    rows = store_table(by_piece(prefix_rows(texts, shingle_counts(texts), block), _shared, _PIECE))
    nodes = rows.select(F.col("_node").alias("_hash")).distinct()
    marked = texts.join(nodes, "_hash", "left_semi").dropDuplicates(["_hash"]).mapInArrow(marks, "_of bigint, _marks binary")
    rows = store_table(rows.join(marked.hint("merge"), F.col("_node") == F.col("_of")).drop("_of"))
    first = store_table(verified(texts, by_piece(rows, _first_mates, "a bigint, b bigint")))
    roots = components(first.select("a", "b"))
    rooted = rows.join(roots.hint("merge"), F.col("_node") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_node")).drop("node", "root")
    other = store_table(verified(texts, by_piece(rooted, _other_mates, "a bigint, b bigint")))
    return first.union(other).select(F.col("fa").alias("a"), F.col("fb").alias("b"))


def drop_near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of connected texts that with the smallest id.

    Texts are connected when they are near or their fingerprints are; texts without words are near by their fingerprint.
    """
    return drop_near_copies(docs, id_col, text_col, links=near_text_edges(docs, text_col))
