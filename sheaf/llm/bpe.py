"""Byte-level BPE: encoding in batched merge rounds, and decoding."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import text_or_empty

#: How byte-level vocabularies split text before merging (a fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces after which a worker starts a new set of those it keeps with their ids; the set before stays for look-up.
MEMORY = 80_000
NO_MERGE = np.iinfo(np.int64).max
#: Rounds over all symbols before the pieces still unfinished go on in order of rank.
ROUNDS = 64


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies (a fixed value of the format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, ids = byte_symbols(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *added.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = bytes(symbols[c] for c in token)
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.added = added
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.split = regex.compile(SPLIT)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.of_byte[b] = ids[c]
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.of_rank = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.merged = self.of_rank[order]
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    # Merging --------------------------------------------------------------------------

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece.

        All pieces lie in one flat array of symbols. A round looks every neighbouring pair up among the
        sorted pair keys, finds the lowest rank of each piece and merges all its occurrences from the left.
        Pieces without a pair left are set aside, so a round costs what is still being merged. A long piece
        has as many rounds as it has ranks; what ``ROUNDS`` do not finish, ``finish`` does.
        """
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
        flat = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(pieces)), lengths)
        rounds = 0
        while len(flat):
            if (rounds := rounds + 1) > ROUNDS:
                flat, owner = self.finish(flat, owner)
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                for a, b in zip(first, np.append(first[1:], len(flat))):
                    out[owner[a]] = flat[a:b]
                break
            inside = owner[1:] == owner[:-1]
            key = np.where(inside, flat[:-1] * self.size + flat[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where(self.keys[at] == key, self.ranks[at], NO_MERGE), NO_MERGE)
            first = np.flatnonzero(np.append(True, ~inside))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(flat)))
            done = lowest == NO_MERGE
            if done.any():
                for i in np.flatnonzero(done):
                    out[owner[first[i]]] = flat[first[i] : first[i] + sizes[i]]
                stay = np.repeat(~done, sizes)
                flat, owner, rank = flat[stay], owner[stay], rank[stay]
                at = np.append(at, 0)[stay]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(flat):
                    break
            else:
                at = np.append(at, 0)
            hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # Hits that follow each other are one symbol repeated: every second one merges.
            run = np.append(True, np.diff(hits) != 1)
            start = hits[run][np.cumsum(run) - 1]
            hits = hits[(hits - start) % 2 == 0]
            flat[hits] = self.merged[at[hits]]
            stay = np.ones(len(flat), bool)
            stay[hits + 1] = False
            flat, owner = flat[stay], owner[stay]
        return out

    def finish(self, flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of all pieces when nothing can be merged any more, and their pieces.

        A round takes the lowest rank of all pieces, which is the lowest of each that has it, and merges all its pairs from
        the left. Places are kept by the rank of their pair, and only the pairs beside a merge are looked up
        again, so a round costs what it merges and all rounds together what the pieces' symbols are.
        """
        n = len(flat)
        symbol, alive = flat.copy(), np.ones(n, bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, NO_MERGE)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def look_up(places: np.ndarray) -> None:
            places = places[after[places] < n]
            right = after[places]
            key = np.where(owner[places] == owner[right], symbol[places] * self.size + symbol[right], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = np.where(self.keys[at] == key, self.ranks[at], NO_MERGE)
            rank[places] = found
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            borders = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else []
            for a, b, r in zip(borders, [*borders[1:], len(found)], found[borders].tolist() if len(found) else []):
                if r == NO_MERGE:
                    break
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(places[a:b])

        look_up(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            hits = np.unique(np.concatenate(waiting.pop(r)))
            hits = hits[rank[hits] == r]
            if not len(hits):
                continue
            # Pairs that overlap are one symbol repeated: every second one merges.
            nth = np.arange(len(hits))
            run = np.append(True, after[hits[:-1]] != hits[1:])
            hits = hits[(nth - np.maximum.accumulate(np.where(run, nth, 0))) % 2 == 0]
            gone = after[hits]
            symbol[hits] = self.of_rank[r]
            alive[gone], rank[gone], rank[hits] = False, NO_MERGE, NO_MERGE
            after[hits] = after[gone]
            inner = hits[after[hits] < n]
            before[after[inner]] = inner
            left = before[hits]
            look_up(np.concatenate([left[left >= 0], hits]))
        return symbol[alive], owner[alive]

    # Texts ----------------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Added tokens, which are tokens wherever they occur, and what the pattern finds between them."""
        if self.split_added is None or not self.split_added.search(text):
            return self.split.findall(text)
        found: list[str] = []
        for part in self.split_added.split(text):
            found.extend([part] if part in self.added else self.split.findall(part))
        return found

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces not seen lately, together. Pieces that occur again and again stay, those seen once go with their set."""
        if len(self.known) > MEMORY:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        known.update([(p, older[p]) for p in pieces if p not in known and p in older])
        new = [p for p in pieces if p not in known]
        ids = self.merge([b"" if p in self.added else p.encode() for p in new])
        for p, i in zip(new, ids):
            tokens = [self.added[p]] if p in self.added else i.tolist()
            self.known[p] = ",".join(map(str, tokens)), self.decode(tokens)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        self.learn(set(pieces))
        return [int(i) for p in pieces for i in self.known[p][0].split(",")]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, SHA-256 of the ids joined by commas and of the text that decoding them gives."""
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*split))
        found = []
        for pieces in split:
            known = [self.known[p] for p in pieces]
            ids = ",".join([k[0] for k in known])
            # Bytes of tokens are put together before they are read as UTF-8, as decoding asks.
            text = b"".join([k[1] for k in known]).decode("utf-8", "replace")
            found.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return found


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file; every executor reads the file where it is installed."""
    return Vocabulary(path)


def in_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Slices of a batch that hold about ``most`` bytes of ``column`` (texts, bytes or lists), one row at least."""
    values = batch.column(column)
    lengths = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False)) // most
    borders = np.flatnonzero(np.append(True, np.diff(sizes) > 0)) if len(sizes) else np.empty(0, int)
    for a, b in zip(borders, np.append(borders[1:], batch.num_rows)):
        yield batch.slice(int(a), int(b - a))


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id>, n_tokens, ids_sha256, decoded_sha256``; one pass, nothing is shuffled.

    A null text counts as empty and has no tokens. Ids may be null or repeat. No rows give no rows; other
    columns are ignored.
    """
    columns = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _mapped(docs, path, id_col, text_col, lambda v, texts: v.digests(texts), columns)


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, ids``: the token ids of every row's whole text."""
    return _mapped(docs, path, id_col, text_col, lambda v, texts: [(v.encode(t),) for t in texts], [("ids", T.ArrayType(T.IntegerType()))])


def decode_ids(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``<id>, text``; null ids count as none, bytes that are not UTF-8 become U+FFFD."""
    return _mapped(tokens, path, id_col, None, lambda v, ids: [(v.decode(i or []).decode("utf-8", "replace"),) for i in ids], [("text", T.StringType())], F.col(ids_col))


def _mapped(rows: DataFrame, path: str, id_col: str, text_col: str | None, work, columns, value=None) -> DataFrame:
    value = text_or_empty(text_col) if value is None else value
    sent = rows.select(F.col(id_col).alias("_id"), value.alias("_value"))
    schema = T.StructType([sent.schema["_id"], *(T.StructField(n, t) for n, t in columns)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        known = vocabulary(path)
        for b in batches:
            for part in in_slices(b, 1, 1 << 20):
                made = work(known, part.column(1).to_pylist())
                arrays = [pa.array([r[i] for r in made], to_arrow_type(t)) for i, (_, t) in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=schema.names)

    return sent.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
