"""Split packs into parts of at most ``max_bytes``, greedily and at line ends.

A part ends before the last newline inside its window (that newline is dropped) or,
if there is none past the first byte, after exactly ``max_bytes``; a newline right
behind such a hard cut is dropped too. Where a part starts depends on where the one
before it ended, so a plain running sum cannot place the cuts. The chain is still
computed in parallel, also inside one pack of any size:

1. the pack is sorted into *blocks*, contiguous ranges of about one task's size, and
   stored, so that blocks cannot change under retries;
2. running sums over one row per block place blocks and lines in their pack;
3. every block tabulates how it maps each possible start of the part that is open when
   the block begins to the start of the part open when it ends: a step function with
   at most one step per line of a part;
4. neighbouring tables are composed in a tree of bounded fan-in, and the start of the
   pack is followed back down the tree to every block;
5. every block, now knowing its entry, cuts its own bytes, and the pieces of a part that
   spans blocks are put together. A part is bounded by ``max_bytes``.

A line belongs to the block that holds its newline.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators.render import ORDER
from sheaf.session import cut_lineage, store_table, task_count

BLOCK_BYTES = 128 << 20
FAN_IN = 64
GROUP = 512
_PIECES_PER_BATCH = 32 << 20
_SCAN = 1 << 20

_SUMMARY = "pack string, block int, nbytes bigint, first_end bigint, last_end bigint"
_TABLE = "pack string, node bigint, upto array<bigint>, leads_to array<bigint>, cuts array<bigint>"
_ENTRY = "pack string, node bigint, part_start bigint, part_no bigint, exit_start bigint, exit_no bigint"
_COUNT = "pack string, n_parts bigint"
_PIECE = "pack string, part_no bigint, n_parts bigint, piece_offset bigint, piece binary"


@dataclass
class _Cutter:
    """The part that is open: where it starts and its number."""

    limit: int
    start: int
    number: int

    def take_line(self, begin: int, end: int, closed: bool = True) -> list[tuple[int, int]]:
        """Let a line ``[begin, end)`` join the open part, cutting before and inside it as needed.

        Returns the cuts as (end of a part, start of the next).
        """
        made = []
        if end - self.start > self.limit and begin > self.start + 1:
            made.append((begin - 1, begin))
            self.start = begin
        if end - self.start > self.limit:
            hard = -(-(end - self.start) // self.limit) - 1
            stops = [self.start + k * self.limit for k in range(1, hard + 1)]
            made += [(s, s) for s in stops]
            if closed and end - stops[-1] == 1:
                made[-1] = (stops[-1], end)
            self.start = made[-1][1]
        self.number += len(made)
        return made


class _Lines:
    """The lines that end in one block, and how parts proceed through them. Positions are those of the pack."""

    def __init__(self, begin: int, ends: np.ndarray, limit: int):
        self.begin, self.ends, self.limit = begin, ends, limit
        self.known: dict[int, tuple[int, int]] = {}

    def start_of(self, j: int) -> int:
        return int(self.ends[j - 1]) if j else self.begin

    def step(self, start: int) -> tuple[int, int] | None:
        """(next part start, cuts made) or None when the block ends first."""
        j = int(np.searchsorted(self.ends, start + self.limit, "right"))  # the first line that does not fit
        if j >= len(self.ends):
            return None
        begin = self.start_of(j)
        if begin > start + 1:
            return begin, 1
        cutter = _Cutter(self.limit, start, 0)
        cutter.take_line(begin, int(self.ends[j]))
        return cutter.start, cutter.number

    def leave(self, start: int) -> tuple[int, int]:
        """The part start at the end of the block, and the cuts up to there, from a part at ``start``."""
        path = []
        here = start
        while here not in self.known:
            move = self.step(here)
            if move is None:
                self.known[here] = (here, 0)
                break
            path.append((here, move[1]))
            here = move[0]
        exit_at, cuts = self.known[here]
        for at, made in reversed(path):
            cuts += made
            self.known[at] = (exit_at, cuts)
        return exit_at, cuts

    def table(self, lowest: int) -> "_Table":
        """The step function on part starts from ``lowest`` to the begin of the first line."""
        found: list[tuple[int, int, int]] = []
        if not len(self.ends):
            return _Table.of(found)
        last_cutting = int(self.ends[-1]) - self.limit - 1
        lowest, highest = max(lowest, self.begin - self.limit), min(self.begin - 2, last_cutting)
        j = int(np.searchsorted(self.ends, lowest + self.limit, "right"))
        while lowest <= highest:
            bound = min(highest, int(self.ends[j]) - self.limit - 1)
            if bound >= lowest:
                exit_at, made = self.leave(self.start_of(j))
                found.append((bound, exit_at, made + 1))
                lowest = bound + 1
            j += 1
        for start in (self.begin - 1, self.begin):
            if lowest <= start <= last_cutting:
                found.append((start, *self.leave(start)))
        return _Table.of(found)


@dataclass
class _Table:
    """A step function on part starts: up to ``upto[k]`` it leads to ``leads_to[k]`` with ``cuts[k]`` cuts;
    a later start stays as it is."""

    upto: np.ndarray
    leads_to: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, int, int]]) -> "_Table":
        cells = np.array(rows, np.int64).reshape(-1, 3)
        return _Table(cells[:, 0], cells[:, 1], cells[:, 2]).merged()

    def merged(self) -> "_Table":
        same = (self.leads_to[1:] == self.leads_to[:-1]) & (self.cuts[1:] == self.cuts[:-1])
        keep = np.append(~same, True)[: len(self.upto)]
        return _Table(self.upto[keep], self.leads_to[keep], self.cuts[keep])

    def at(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.upto, starts, "left")
        inside = k < len(self.upto)
        k = np.where(inside, k, 0)
        if not len(self.upto):
            return starts, np.zeros(len(starts), np.int64)
        return np.where(inside, self.leads_to[k], starts), np.where(inside, self.cuts[k], 0)

    def then(self, later: "_Table") -> "_Table":
        leads_to, cuts = later.at(self.leads_to)
        beyond = later.upto > (self.upto[-1] if len(self.upto) else -1)
        return _Table(
            np.concatenate([self.upto, later.upto[beyond]]),
            np.concatenate([leads_to, later.leads_to[beyond]]),
            np.concatenate([self.cuts + cuts, later.cuts[beyond]]),
        ).merged()


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, row behind, bytes) of stretches of one pack and block; rows are adjacent in the buffer."""
    body = batch.column("body").cast(pa.large_binary())
    offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    data = np.frombuffer(body.buffers()[2] or b"", np.uint8)
    pack = batch.column("pack").to_numpy(zero_copy_only=False)
    block = batch.column("block").to_numpy(zero_copy_only=False)
    new = np.flatnonzero((pack[1:] != pack[:-1]) | (block[1:] != block[:-1])) + 1
    edges = [0, *new.tolist(), len(body)]
    for i, j in zip(edges, edges[1:]):
        yield i, j, data[offsets[i] : offsets[j]]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytearray]]:
    """One item per pack and block: its first row without the body, and its bytes in order.

    A block is held once: it grows in one buffer, and callers let go of it before they ask for the next.
    """
    head: dict | None = None
    block = bytearray()
    last_seq = -1
    for batch in batches:
        if not batch.num_rows:
            continue
        seq = batch.column("seq").to_numpy(zero_copy_only=False)
        others = batch.drop_columns(["body"])
        for i, j, data in _runs(batch):
            row = others.slice(i, 1).to_pylist()[0]
            if head is None or (head["pack"], head["block"]) != (row["pack"], row["block"]):
                if head is not None:
                    yield head, block
                head, block, last_seq = row, bytearray(), -1
            if seq[i] <= last_seq or np.any(np.diff(seq[i:j]) <= 0):
                raise RuntimeError("rows of a block arrived out of order")
            last_seq = seq[j - 1]
            block += memoryview(data)
    if head is not None:
        yield head, block


def _line_ends(data: bytes | bytearray) -> np.ndarray:
    """Positions behind newlines; the comparison takes a byte for each byte, so it goes by slices."""
    view = np.frombuffer(data, np.uint8)
    found = [np.flatnonzero(view[i : i + _SCAN] == 10) + (i + 1) for i in range(0, len(view), _SCAN)]
    return np.concatenate([np.empty(0, np.int64), *found])


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for head, data in _stretches(batches):
        has_line = b"\n" in data
        yield pa.RecordBatch.from_pydict(
            {
                "pack": pa.array([head["pack"]], pa.string()),
                "block": pa.array([head["block"]], pa.int32()),
                "nbytes": pa.array([len(data)], pa.int64()),
                "first_end": pa.array([data.find(b"\n") + 1 if has_line else None], pa.int64()),
                "last_end": pa.array([data.rfind(b"\n") + 1 if has_line else None], pa.int64()),
            }
        )
        del data


def _layout(summary: DataFrame, group: int = GROUP) -> DataFrame:
    """Where blocks and their lines lie in their pack; none of it depends on the cuts.

    Sums and extremes are taken over ``group`` neighbouring blocks, then over one row per group, so
    no task sees all blocks of a pack. Every frame grows from one end, which keeps it linear.
    """
    summary = summary.withColumn("grp", F.floor(F.col("block") / group))
    inside = Window.partitionBy("pack", "grp")
    forth, back = inside.orderBy("block"), inside.orderBy(F.desc("block"))
    past = (Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("nbytes").over(forth.rowsBetween(*past)), F.lit(0))
    placed = summary.select(
        "pack", "grp", "block", "nbytes", at.alias("at"),
        (at + F.col("first_end")).alias("first_end"), (at + F.col("last_end")).alias("last_end"),
    )
    placed = placed.select(
        "*",
        (F.row_number().over(forth) - 1).alias("nth"),
        F.max("last_end").over(forth.rowsBetween(*past)).alias("line_before"),
        F.min("first_end").over(back.rowsBetween(*past)).alias("end_behind"),
    )
    groups = placed.groupBy("pack", "grp").agg(
        F.sum("nbytes").alias("g_bytes"), F.count("*").alias("g_nodes"), F.min("first_end").alias("g_first"), F.max("last_end").alias("g_last")
    )
    pack = Window.partitionBy("pack")
    forth, back = pack.orderBy("grp"), pack.orderBy(F.desc("grp"))
    g_at = F.coalesce(F.sum("g_bytes").over(forth.rowsBetween(*past)), F.lit(0))
    groups = groups.select("*", g_at.alias("g_at"), F.coalesce(F.sum("g_nodes").over(forth.rowsBetween(*past)), F.lit(0)).alias("g_node"))
    groups = groups.select(
        "pack", "grp", "g_at", "g_node",
        F.max(F.col("g_at") + F.col("g_last")).over(forth.rowsBetween(*past)).alias("g_line_before"),
        F.min(F.col("g_at") + F.col("g_first")).over(back.rowsBetween(*past)).alias("g_end_behind"),
        F.sum("g_nodes").over(pack).alias("n_nodes"),
        F.coalesce(F.max(F.col("g_at") + F.col("g_last")).over(pack), F.lit(0)).alias("last_line"),
        F.sum("g_bytes").over(pack).alias("total"),
    )
    following = F.coalesce(F.col("g_at") + F.col("end_behind"), F.col("g_end_behind"))
    return placed.join(groups, ["pack", "grp"]).select(
        "pack",
        "block",
        (F.col("g_node") + F.col("nth")).cast("long").alias("node"),
        "n_nodes",
        (F.col("g_at") + F.col("at")).alias("offset"),
        F.coalesce(F.col("g_at") + F.col("line_before"), F.col("g_line_before"), F.lit(0)).alias("line_start"),
        F.coalesce(following, F.col("total")).alias("tail_end"),
        following.isNotNull().alias("tail_closed"),
        "last_line",
        "total",
    )


def _tabulate(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, data in _stretches(batches):
            ends = _line_ends(data) + head["offset"]
            del data
            table = _Lines(head["line_start"], ends, limit).table(lowest=0)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "pack": pa.array([head["pack"]], pa.string()),
                    "node": pa.array([head["node"]], pa.int64()),
                    "upto": pa.array([table.upto], longs),
                    "leads_to": pa.array([table.leads_to], longs),
                    "cuts": pa.array([table.cuts], longs),
                }
            )

    return run


def _tables(rows: pd.DataFrame) -> list[tuple[int, _Table]]:
    rows = rows.sort_values("node")
    return [
        (int(t.node), _Table(*(np.asarray(c, np.int64) for c in (t.upto, t.leads_to, t.cuts)))) for t in rows.itertuples()
    ]


def _compose(fan: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tables = _tables(rows)
        whole = tables[0][1]
        for _, t in tables[1:]:
            whole = whole.then(t)
        found = [[rows["pack"].iloc[0], tables[0][0] // fan, whole.upto, whole.leads_to, whole.cuts]]
        return pd.DataFrame(found, columns=["pack", "node", "upto", "leads_to", "cuts"])

    return run


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """Follow the open part through neighbouring nodes from the entry that the rows carry."""
    start, number = int(rows["entry_start"].iloc[0]), int(rows["entry_no"].iloc[0])
    found = []
    for node, table in _tables(rows):
        leads_to, cuts = table.at(np.array([start], np.int64))
        found.append([rows["pack"].iloc[0], node, start, number, int(leads_to[0]), number + int(cuts[0])])
        start, number = found[-1][4:]
    return pd.DataFrame(found, columns=[c.split()[0] for c in _ENTRY.split(", ")])


def _entries(tables: DataFrame, most_nodes: int, fan: int) -> DataFrame:
    """The open part at the begin of every block.

    Neighbouring tables are composed ``fan`` at a time until a pack has no more than
    ``fan`` of them; the known start of the pack is then followed back down. No task
    sees more than ``fan`` tables.
    """
    levels = [tables]
    while -(-most_nodes // fan ** (len(levels) - 1)) > fan:
        parent = F.floor(F.col("node") / fan).alias("parent")
        levels.append(cut_lineage(levels[-1].groupBy("pack", parent).applyInPandas(_compose(fan), _TABLE)))
    entered = levels[-1].withColumn("entry_start", F.lit(0)).withColumn("entry_no", F.lit(1))
    entries = entered.groupBy("pack").applyInPandas(_chain, _ENTRY)
    for tables_below in reversed(levels[:-1]):
        above = entries.select(
            "pack", F.col("node").alias("parent"), F.col("part_start").alias("entry_start"), F.col("part_no").alias("entry_no")
        )
        below = tables_below.withColumn("parent", F.floor(F.col("node") / fan)).join(above, ["pack", "parent"])
        entries = below.groupBy("pack", "parent").applyInPandas(_chain, _ENTRY)
    return entries


def _count_parts(limit: int):
    """The number of parts, from the part that is open when the last block ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for r in rows.itertuples():
                open_part = _Cutter(limit, r.exit_start, r.exit_no)
                if r.total > r.last_line:
                    open_part.take_line(r.last_line, r.total, closed=False)
                found.append([r.pack, open_part.number - (open_part.start >= r.total)])
            yield pd.DataFrame(found, columns=["pack", "n_parts"])

    return run


def _cut(limit: int):
    def block_cuts(head: dict, ends: np.ndarray) -> list[tuple[int, int]]:
        """All cuts that can fall into this block, in order."""
        open_part = _Cutter(limit, head["part_start"], head["part_no"])
        begin = head["line_start"]
        made: list[tuple[int, int]] = []
        if len(ends):
            made += open_part.take_line(begin, int(ends[0]))
            while True:
                j = int(np.searchsorted(ends, open_part.start + limit, "right"))
                if j >= len(ends):
                    break
                made += open_part.take_line(int(ends[j - 1]) if j else begin, int(ends[j]))
            begin = int(ends[-1])
        if head["tail_end"] > begin:  # the line that ends in a later block may cut right here
            made += open_part.take_line(begin, head["tail_end"], head["tail_closed"])
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, data in _stretches(batches):
            offset, end = head["offset"], head["offset"] + len(data)
            rows: list[tuple[int, int, bytes]] = []
            held = 0
            start, number = head["part_start"], head["part_no"]
            cuts = block_cuts(head, _line_ends(data) + offset)
            for stop, following in [*cuts, (head["total"], head["total"])]:
                lo, hi = max(start, offset), min(stop, end)
                if lo < hi:
                    rows.append((number, lo, bytes(memoryview(data)[lo - offset : hi - offset])))
                    held += hi - lo
                    if held >= _PIECES_PER_BATCH:
                        yield _pieces(head, rows)
                        rows, held = [], 0
                start, number = following, number + 1
            del data
            if rows:
                yield _pieces(head, rows)

    return run


def _pieces(head: dict, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_pydict(
        {
            "pack": pa.array([head["pack"]] * n, pa.string()),
            "part_no": pa.array([r[0] for r in rows], pa.int64()),
            "n_parts": pa.array([head["n_parts"]] * n, pa.int64()),
            "piece_offset": pa.array([r[1] for r in rows], pa.int64()),
            "piece": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


def ranges_for(rows: DataFrame, body: str = "body") -> int:
    """How many ranges of ``BLOCK_BYTES`` the bodies fill."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length(body)), F.lit(0))).first()[0]
    return task_count(rows.sparkSession, total, BLOCK_BYTES)


def _beside(stored: DataFrame, facts: DataFrame) -> DataFrame:
    """The stored rows with one row of facts per block, in the order of the block.

    Facts are a stored table, so Spark plans the join from their measured size: as long as that is under
    its broadcast threshold the text stays where it is. Beyond, both sides are hashed by pack and block; a block is
    one map task's output, so also then it comes whole to one task.
    """
    return stored.join(facts, ["pack", "block"]).sortWithinPartitions("pack", "block", "seq")


def split_packs(
    sections: DataFrame,
    max_bytes: int,
    pack: str | None = None,
    order: tuple[str, ...] = ORDER,
    body: str = "body",
    blocks: int | None = None,
    fan: int = FAN_IN,
) -> DataFrame:
    """``pack, part_no, n_parts, content`` of the texts that ``body`` forms in ``order`` within each pack.

    ``content`` is BINARY because a hard cut may fall inside a character. ``blocks`` is the
    number of ranges, so that one fits a task; left out, the bodies are measured first.
    """
    if max_bytes <= 0:
        raise ValueError("max_bytes must be positive")
    key = F.lit("") if pack is None else F.coalesce(F.col(pack).cast("string"), F.lit(""))
    rows = sections.select(key.alias("pack"), *order, F.col(body).cast("binary").alias("body"))
    by = ["pack", *order]
    blocks = blocks or ranges_for(rows)
    ranged = rows.repartitionByRange(blocks, *by)
    stored = cut_lineage(
        ranged.sortWithinPartitions(*by).select(
            "pack", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("seq"), "body"
        )
    )
    layout = store_table(_layout(stored.mapInArrow(_summarize, _SUMMARY)))
    most_nodes = layout.agg(F.max("n_nodes")).first()[0] or 1
    placed = _beside(stored, layout.select("pack", "block", "node", "offset", "line_start"))
    tables = cut_lineage(placed.mapInArrow(_tabulate(max_bytes), _TABLE))
    entries = layout.join(_entries(tables, most_nodes, fan), ["pack", "node"])
    ends = entries.where("node = n_nodes - 1").select("pack", "exit_start", "exit_no", "last_line", "total")
    states = store_table(entries.join(ends.mapInPandas(_count_parts(max_bytes), _COUNT), "pack"))
    entered = _beside(stored, states.drop("node", "n_nodes", "last_line", "exit_start", "exit_no"))
    pieces = entered.mapInArrow(_cut(max_bytes), _PIECE).repartition(blocks, "pack", "part_no")
    in_order = F.sort_array(F.collect_list(F.struct("piece_offset", "piece")))
    whole = F.array_join(F.transform(in_order, lambda p: p["piece"].cast("string")), "").cast("binary")
    return pieces.groupBy("pack", "part_no", "n_parts").agg(whole.alias("content"))
