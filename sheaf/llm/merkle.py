"""Merkle manifest of a dataset: trees of three per source, a tree over the sources, and proofs by a recursive query.

Levels are built ``LEVELS`` at a time (a *band*): the nodes of ``WIDTH`` neighbours meet in one group, which is never
larger. What is stored is one row per node at a band's foot: what stands beside it and its ancestors on these
levels, and, by its key, the link to the node a band higher. A recursive query then climbs from every leaf, one
band a step, appending the siblings and folding the leaf's hash.

All leaves of a source pass its upper nodes. So that these are no hot keys, an upper node has a copy for every
``CHUNK`` neighbouring leaves below it, and a leaf asks for its own chunk's copy.
"""

from __future__ import annotations

import contextlib
import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import running_total
from sheaf.session import drop_table, store_table

LEVELS = 6
WIDTH = 3**LEVELS
CHUNK = WIDTH
#: Name of the tree over the sources; those of sources start with another letter.
TOP = "t"
NO_STEP = "cast(array() as array<struct<l: binary, r: binary>>)"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _up(hashes: str) -> Column:
    return F.expr(f"transform(sequence(0, (size({hashes}) - 1) div 3), i -> sha2(array_join(slice({hashes}, i * 3 + 1, 3), ''), 256))")


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per ``WIDTH`` neighbours of ``nodes`` (``tree, pos, h, leaves``) with the levels above them as ``h0``, ``h1``, and so on.

    A tree's only block ends where one node is left; every other block has all its levels.
    """
    totals = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("_n")).withColumn("block", F.lit(0).cast("bigint"))
    blocks = nodes.groupBy("tree", F.expr(f"pos div {WIDTH}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("_held"), F.sum("leaves").alias("leaves"))
    # Only a tree's first block can be its only one, so this join meets each key once.
    blocks = blocks.join(totals, ["tree", "block"], "left").withColumn("last", F.coalesce(F.col("_n") <= WIDTH, F.lit(False)))
    blocks = blocks.withColumn("h0", F.col("_held.h"))
    for level in range(LEVELS):
        over = F.col("last") & (F.size(f"h{level}") <= 1)
        blocks = blocks.withColumn(f"h{level + 1}", F.when(over, F.col(f"h{level}")).otherwise(_up(f"h{level}")))
    depth = F.when(~F.col("last"), LEVELS)
    for level in range(LEVELS + 1):
        depth = depth.when(F.size(f"h{level}") <= 1, level)
    return blocks.select("tree", "block", "leaves", "last", depth.alias("depth"), *[f"h{i}" for i in range(LEVELS + 1)], F.col(f"h{LEVELS}")[0].alias("out"))


def _steps(blocks: DataFrame, band: int) -> DataFrame:
    """Of every node at the foot of ``blocks`` what stands left and right of it and its ancestors, lowest first.

    ``chunks`` is the range of leaf chunks below the block; it has more than one above two bands only.
    """
    levels = ", ".join(f"h{i}" for i in range(LEVELS))
    beside = f"""
      transform(sequence(0, size(h0) - 1), s -> transform(slice(levels, 1, depth), k -> named_struct(
        'l', unhex(array_join(slice(lv[k], (s div powers[k]) div 3 * 3 + 1, (s div powers[k]) % 3), '')),
        'r', unhex(array_join(slice(lv[k], s div powers[k] + 2, 2 - (s div powers[k]) % 3), '')))))"""
    powers, numbers = ", ".join(str(3**i) for i in range(LEVELS)), ", ".join(map(str, range(LEVELS)))
    wide = blocks.selectExpr("*", f"array({levels}) as lv", f"array({powers}) as powers", f"array({numbers}) as levels")
    wide = wide.select("tree", "block", F.posexplode_outer(F.expr(beside)).alias("slot", "path"))
    return wide.selectExpr("tree", f"{band} as band", f"block * {WIDTH} + slot as pos", "path")


def _copies(steps: DataFrame, nodes: DataFrame, band: int) -> DataFrame:
    """A copy of every step for each chunk of leaves below its node."""
    size = WIDTH**band
    first, last = f"pos * {size} div {CHUNK}", f"(pos * {size} + leaves - 1) div {CHUNK}"
    below = nodes.select("tree", "pos", "leaves")
    return steps.join(below, ["tree", "pos"]).withColumn("chunk", F.explode(F.expr(f"sequence({first}, {last})"))).select(*steps.columns, "chunk")


@dataclass
class Tree:
    """What is known of the levels: steps of the lowest band, steps of the others, ``tree, subroot, leaves, top`` of every tree."""

    first: DataFrame
    others: DataFrame
    roots: DataFrame
    stored: list[DataFrame]


def build(leaves: DataFrame) -> Tree:
    """The levels over ``leaves`` (``tree, pos, h``); positions count from 0 in each tree."""
    nodes, band = leaves.select("tree", "pos", "h", F.lit(1).cast("bigint").alias("leaves")), 0
    steps, roots, stored = [], [], []
    while True:
        blocks = store_table(_blocks(nodes))
        stored.append(blocks)
        steps.append(_copies(_steps(blocks, band), nodes, band) if band else _steps(blocks, band))
        roots.append(blocks.where("last").select("tree", F.col("out").alias("subroot"), "leaves", F.lit(band).alias("top")))
        rest = blocks.where("not last")
        if rest.isEmpty():
            break
        nodes, band = rest.select("tree", F.col("block").alias("pos"), F.col("out").alias("h"), "leaves"), band + 1
    none = steps[0].withColumn("chunk", F.lit(0).cast("bigint")).limit(0)
    return Tree(steps[0], functools.reduce(DataFrame.unionByName, steps[1:], none), functools.reduce(DataFrame.unionByName, roots), stored)


@contextlib.contextmanager
def whole_recursion(spark: SparkSession):
    """A recursive query stops at a number of rows by default; this one has a row per leaf and step."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A hash in bytes after a step, and what stood beside it on the way.
FOLD = "aggregate({path}, {h}, (a, s) -> unhex(sha2(lower(hex(concat(s.l, a, s.r))), 256)))"
BESIDE = "aggregate({path}, cast('' as binary), (a, s) -> concat(a, s.l, s.r))"


def climb(leaves: DataFrame, tree: Tree, nodes: DataFrame, start: str, kept: str, carried: list[str]) -> DataFrame:
    """From every row of ``leaves`` (``tree, pos, chunk, h``) to the last node above it, a stored table.

    Each leaf begins with the step of its own node. ``nodes``, those above, have ``tree, band, pos, chunk, path,
    last, subroot``; ``last`` is the step into a root, and where it is a leaf's first there is none above. ``start``
    says what to keep of a path, ``kept`` what of a further one (``n`` is the node, ``c`` the climbing row). The nodes
    are a fixed share of the leaves, so they are never broadcast.
    """
    own = "".join(f"{c}, " for c in carried)
    mine = "".join(f"c.{c}, " for c in carried)
    with whole_recursion(leaves.sparkSession):
        return store_table(
            leaves.sparkSession.sql(
                f"""
        with recursive climb ({own} tree, band, pos, chunk, h, kept, subroot, done) as (
          select {mine} c.tree, 1, c.pos div {WIDTH}, c.chunk, {FOLD.format(path="n.path", h="c.h")}, {start}, cast(null as string), false
          from {{leaves}} c join {{first}} n on c.tree = n.tree and c.pos = n.pos
          union all
          select /*+ merge(n) */ {mine} c.tree, c.band + 1, c.pos div {WIDTH}, c.chunk, {FOLD.format(path="n.path", h="c.h")}, {kept}, n.subroot, n.last
          from climb c join {{nodes}} n on c.tree = n.tree and c.band = n.band and c.pos = n.pos and c.chunk = n.chunk
          where not c.done)
        select {own} tree, h, kept, subroot from climb where done""",
                leaves=leaves,
                first=tree.first,
                nodes=nodes,
            )
        )


def merkle_manifest(docs: DataFrame, columns=("doc_id", "source", "lang", "n_chars", "text"), id_col="doc_id", source_col="source") -> DataFrame:
    """One row per row of ``docs``: ``<id>, leaf, subroot, root, proof, folded_root, verified``.

    A leaf hashes ``columns`` of a row; a column ``_tampered`` of ``docs``, if there is one, is a second leaf hash to
    fold instead of the row's own. Leaves of a source stand by id (null ids last, equal ids by leaf); sources stand
    by their bytes, null first. ``proof`` is the SHA-256 of all siblings' hex digests on the way to the root.

    Null and empty values hash differently; repeated rows are leaves of their own with proofs of their own, which
    of two equal ones has which is the same to any reader. No rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    own = leaf_hash([F.col(c) for c in columns])
    second = F.coalesce(F.col("_tampered"), own) if "_tampered" in docs.columns else own
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    rows = docs.select(F.col(id_col).alias("_id"), tree.alias("tree"), own.alias("_leaf"), second.alias("_second"), F.lit(1).alias("_one"))
    placed = store_table(running_total(rows, ["tree"], ["_id", "_leaf"], "_one", "pos").drop("_one"))
    if placed.isEmpty():
        return _shaped(placed.select(F.col("_id"), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof", "folded_root")]), id_col)

    sources = build(placed.select("tree", "pos", F.col("_leaf").alias("h")))
    # The null source's tree is "n" and those of sources start with "s": null comes first as it should.
    trees = store_table(running_total(sources.roots.withColumn("_one", F.lit(1)), [], ["tree"], "_one", "number").drop("_one"))
    over = build(trees.select(F.lit(TOP).alias("tree"), F.col("number").alias("pos"), F.col("subroot").alias("h")))
    root = over.roots.first()  # one tree, one row
    # A climb ends above the last band: there, once per chunk, stands the root, or a source's way to it.
    end = F.explode(F.expr(f"sequence(0L, (leaves - 1) div {CHUNK})")).alias("chunk")
    above = over.others.withColumns({"last": F.lit(False), "subroot": F.lit(None).cast("string")})
    ends = over.roots.select("tree", (F.col("top") + 1).alias("band"), F.lit(0).cast("bigint").alias("pos"), F.expr(NO_STEP).alias("path"), end, F.lit(True).alias("last"), "subroot")
    subs = trees.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), F.col("number").alias("pos"), F.expr(f"number div {CHUNK}").alias("chunk"), F.unhex("subroot").alias("h"))
    ways = climb(subs, over, store_table(above.unionByName(ends)), "n.path", "concat(c.kept, n.path)", ["name"])

    above = sources.others.withColumns({"last": F.lit(False), "subroot": F.lit(None).cast("string")})
    ends = trees.join(ways.select(F.col("name").alias("tree"), F.col("kept").alias("path")), "tree")
    ends = ends.select("tree", (F.col("top") + 1).alias("band"), F.lit(0).cast("bigint").alias("pos"), "path", end, F.lit(True).alias("last"), "subroot")
    nodes = store_table(above.unionByName(ends))
    leaves = placed.select("_id", F.unhex("_leaf").alias("_leaf"), "tree", "pos", F.expr(f"pos div {CHUNK}").alias("chunk"), F.unhex("_second").alias("h"))
    # Siblings travel as bytes; at the last step only their digest is left.
    beside = BESIDE.format(path="n.path")
    kept = f"case when n.last then unhex(sha2(lower(hex(concat(c.kept, {beside}))), 256)) else concat(c.kept, {beside}) end"
    done = climb(leaves, sources, nodes, beside, kept, ["_id", "_leaf"])
    for used in [placed, *sources.stored, *over.stored, trees, ways, nodes]:
        drop_table(used)
    shown = {name: F.lower(F.hex(column)) for name, column in (("leaf", "_leaf"), ("proof", "kept"), ("folded_root", "h"))}
    return _shaped(done.select("_id", shown["leaf"].alias("leaf"), "subroot", F.lit(root.subroot).alias("root"), shown["proof"].alias("proof"), shown["folded_root"].alias("folded_root")), id_col)


def _shaped(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("_id", id_col)


def without_line_feeds(docs: DataFrame, columns=("doc_id", "source", "lang", "n_chars", "text"), id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with the leaf hash ``_tampered`` of rows whose id has an even CRC-32, taken after their texts lost all line feeds."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    changed = leaf_hash([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text_col else F.col(c) for c in columns])
    return docs.withColumn("_tampered", F.when(hit & F.contains(F.col(text_col), F.lit("\n")), changed))
