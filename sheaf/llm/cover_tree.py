"""Embedding near-dedup: cover trees over blocks of vectors, and a traversal of every two of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import components, forest
from sheaf.session import store_table

COSINE = 0.9
#: Vectors of one tree, about; and the most pivots that vectors are dealt by.
BLOCK, PIVOTS = 4096, 512
#: Radii of the levels, each half of the one above; the root holds everything.
RADII = (0.5, 0.25, 0.125)
#: Distances come from cosines, whose rounding the bounds allow for; pairs themselves are decided by the cosine.
SLACK = 1e-6
PAIRS = 1 << 20
#: Cosines in single precision are off by less than this; and the radii that nodes are seen together by.
ROUNDING, BANDS = 1e-5, (0.01, 0.15, 0.35)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest component, so that squares neither overflow nor vanish."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


# Trees ------------------------------------------------------------------------------------


def build(points: np.ndarray, radii=RADII) -> np.ndarray:
    """For each point and level the row of the node that it is under: nested, each within the level's radius of its points.

    The first point not yet under a node becomes one; a node of one level is a node of the next.
    """
    n = len(points)
    cosines = np.empty((n, n), np.float32)
    for at in range(0, n, 512):
        cosines[at : at + 512] = points[at : at + 512] @ points.T
    under, parent = np.empty((n, len(radii)), np.int32), np.zeros(n, np.int32)
    for level, radius in enumerate(radii):
        near, free = 1 - radius * radius / 2 + 1e-5, np.ones(n, bool)
        centre = np.full(n, -1, np.int32)
        # Nodes of the level above come first and so stay nodes.
        order = np.argsort(parent != np.arange(n), kind="stable") if level else range(n)
        for i in order:
            if free[i]:
                own = free & (cosines[i] >= near) & (parent == parent[i])
                own[i] = True
                centre[own] = i
                free &= ~own
        under[:, level] = parent = centre
    return under


class Tree:
    """Points with their nodes; level by level each node's point, its covering radius and its children."""

    def __init__(self, points: np.ndarray, under: np.ndarray, weight: np.ndarray, names: np.ndarray):
        self.points, self.weight, self.names = points, weight, names
        self.nodes, self.radius, self.of_point = [], [], []
        for level in range(under.shape[1]):
            rows, place = np.unique(under[:, level], return_inverse=True)
            far = distance(np.einsum("ij,ij->i", points, points[under[:, level]]))
            radius = np.zeros(len(rows))
            np.maximum.at(radius, place, far)
            self.nodes.append(rows)
            self.radius.append(radius)
            self.of_point.append(place)
        # Children of each node (the last level's are points), as one sorted array with borders.
        self.children, self.borders = [], []
        for level in range(under.shape[1]):
            last = level + 1 == under.shape[1]
            child_parent = self.of_point[level] if last else self.of_point[level][self.nodes[level + 1]]
            order = np.argsort(child_parent, kind="stable")
            self.children.append(order)
            self.borders.append(np.searchsorted(child_parent[order], np.arange(len(self.nodes[level]) + 1)))
        self.total = [np.bincount(p, weight, len(r)) for p, r in zip(self.of_point, self.nodes)]


def _expand(tree_a: Tree, tree_b: Tree, level: int, a: np.ndarray, b: np.ndarray):
    """All pairs of a child of a and a child of b, for each pair (a, b), in slices of bounded size."""
    ba, bb = tree_a.borders[level], tree_b.borders[level]
    na, nb = ba[a + 1] - ba[a], bb[b + 1] - bb[b]
    sizes = na * nb
    slices = np.cumsum(sizes) // PAIRS
    for s in np.unique(slices):
        k = np.flatnonzero(slices == s)
        pair = np.repeat(np.arange(len(k)), sizes[k])
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(sizes[k]) - sizes[k], sizes[k])
        ia = tree_a.children[level][ba[a[k]][pair] + nth // nb[k][pair]]
        ib = tree_b.children[level][bb[b[k]][pair] + nth % nb[k][pair]]
        yield ia, ib


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    for at in range(0, len(x), 1 << 14):
        out[at : at + (1 << 14)] = np.einsum("ij,ij->i", x[at : at + (1 << 14)], y[at : at + (1 << 14)])
    return out


class Traversal:
    """Both trees descended together. Pairs of nodes too far apart for their radii go; pairs so near that all
    their points must link are settled at once; the rest give way to their children, and at last to points."""

    def __init__(self, a: Tree, b: Tree, cosine: float):
        self.a, self.b, self.cosine, self.reach = a, b, cosine, float(np.sqrt(2 - 2 * cosine))
        self.count_a, self.count_b = np.zeros(len(a.points)), np.zeros(len(b.points))
        self.edges: tuple[list, list, int] = ([], [], 0)

    def run(self):
        a, b = self.a, self.b
        ra, rb = a.radius[0], b.radius[0]
        order = np.argsort(rb, kind="stable")
        ahead = a.points[a.nodes[0]].astype(np.float32)
        # Nodes of like radius are seen together, so that one bound per row drops nearly all pairs in single precision.
        for columns in np.split(order, np.searchsorted(rb[order], BANDS)):
            if not len(columns):
                continue
            across = np.ascontiguousarray(b.points[b.nodes[0][columns]].astype(np.float32).T)
            widest = np.minimum(self.reach + 2 * SLACK + ra + rb[columns].max(), 2)
            least = (1 - widest * widest / 2 - ROUNDING).astype(np.float32)
            for at in range(0, len(ahead), 512):
                hits = np.flatnonzero(ahead[at : at + 512] @ across >= least[at : at + 512, None])
                x, y = hits // len(columns) + at, columns[hits % len(columns)]
                d = distance(_cosines(a.points[a.nodes[0][x]], b.points[b.nodes[0][y]]))
                near = d <= self.reach + SLACK + ra[x] + rb[y]
                self._nodes(0, x[near], y[near], d[near])
        first, second, _ = self.edges
        if not first:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return forest(np.concatenate(first), np.concatenate(second))

    def _link(self, x: np.ndarray, y: np.ndarray) -> None:
        first, second, size = self.edges
        first.append(x)
        second.append(y)
        if size + len(x) > 2 * PAIRS:
            x, y = forest(np.concatenate(first), np.concatenate(second))
            self.edges = ([x], [y], len(x))
        else:
            self.edges = (first, second, size + len(x))

    def _nodes(self, level: int, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> None:
        """Pairs of nodes within reach, with the distances of their centres."""
        a, b = self.a, self.b
        whole = d + a.radius[level][x] + b.radius[level][y] <= self.reach - SLACK
        if whole.any():
            self._all(level, x[whole], y[whole])
        x, y = x[~whole], y[~whole]
        if not len(x):
            return
        for ia, ib in _expand(a, b, level, x, y):
            if level + 1 == len(a.nodes):
                hit = _cosines(a.points[ia], b.points[ib]) >= self.cosine
                ia, ib = ia[hit], ib[hit]
                self.count_a += np.bincount(ia, b.weight[ib], len(a.points))
                self.count_b += np.bincount(ib, a.weight[ia], len(b.points))
                self._link(a.names[ia], b.names[ib])
            else:
                d = distance(_cosines(a.points[a.nodes[level + 1][ia]], b.points[b.nodes[level + 1][ib]]))
                near = d <= self.reach + SLACK + a.radius[level + 1][ia] + b.radius[level + 1][ib]
                self._nodes(level + 1, ia[near], ib[near], d[near])

    def _all(self, level: int, x: np.ndarray, y: np.ndarray) -> None:
        """Every point under x links with every point under y: sums are added, points hang on the other node's centre."""
        a, b = self.a, self.b
        gain_a = np.bincount(x, b.total[level][y], len(a.nodes[level]))
        gain_b = np.bincount(y, a.total[level][x], len(b.nodes[level]))
        self.count_a += gain_a[a.of_point[level]]
        self.count_b += gain_b[b.of_point[level]]
        # One partner per node holds its points together; the pairs' centres link the nodes.
        for mine, own, other, theirs in ((a, x, b, y), (b, y, a, x)):
            partner = np.full(len(mine.nodes[level]), -1)
            partner[own] = theirs
            points = np.flatnonzero(partner[mine.of_point[level]] >= 0)
            self._link(mine.names[points], other.names[other.nodes[level][partner[mine.of_point[level][points]]]])
        self._link(a.names[a.nodes[level][x]], b.names[b.nodes[level][y]])


# Spark ------------------------------------------------------------------------------------


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _usable(vector):
    """Not null, of finite components, and not zero."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(numbers, lambda x: x != 0), F.lit(False))


def trees(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``_cell, _block, _node, _n, _vec, _under``: every class in a tree. ``_under`` names its node at each level.

    A bounded number of pivots, those of the smallest hash, is sent to all tasks; a vector goes to the cell of
    the nearest pivot of its length. Cells are cut into blocks of at most about ``block`` vectors.
    """
    total = classes.count()
    count = max(1, min(PIVOTS, -(-total // block)))
    nth = F.row_number().over(Window.partitionBy("_dim").orderBy("_node"))
    # The node is a hash, so its order is random. A limit before the window bounds what one task sees.
    chosen = classes.select(F.size("_vec").alias("_dim"), "_node", "_vec").orderBy("_node").limit(count).withColumn("_nth", nth).toPandas()
    pivots = {int(d): unit(_matrix(g["_vec"])) for d, g in chosen.groupby("_dim")}
    names = {d: np.arange(len(p)) + sum(len(q) for e, q in pivots.items() if e < d) for d, p in pivots.items()}

    def assign(batches):
        for pdf in batches:
            for d, g in pdf.groupby(pdf["_vec"].map(len)):
                if d in pivots:
                    at = np.argmax(unit(_matrix(g["_vec"])) @ pivots[d].T, axis=1)
                    cell = names[d][at]
                else:
                    cell = np.full(len(g), -1 - int(d))  # no pivot of this length: a cell of its own
                yield g.assign(_cell=cell)[["_cell", "_node", "_n", "_vec"]]

    schema = "_cell int, _node bigint, _n bigint, _vec array<" + classes.schema["_vec"].dataType.elementType.simpleString() + ">"
    dealt = store_table(classes.select("_node", "_n", "_vec").mapInPandas(assign, schema))
    blocks = dealt.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = dealt.join(blocks, "_cell").withColumn("_block", F.pmod(F.xxhash64("_node", F.lit(5)), F.col("_blocks")).cast("int")).drop("_blocks")

    def grow(pdf):
        under = build(unit(_matrix(pdf["_vec"])))
        node = pdf["_node"].to_numpy()
        return pdf.assign(_under=list(node[under]))[["_cell", "_block", "_node", "_n", "_vec", "_under"]]

    out = "_cell int, _block int, _node bigint, _n bigint, " + schema[schema.index("_vec") :] + ", _under array<bigint>"
    return store_table(dealt.groupBy("_cell", "_block").applyInPandas(grow, out))


def links(grown: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``a, n``: of class a, vectors linked in one pair of trees, itself included; ``a, b``: edges of a spanning forest."""
    blocks = store_table(
        grown.groupBy("_cell", "_block")
        .agg(F.count(F.lit(1)).alias("_rows"), F.first(F.size("_vec")).alias("_dim"))
        .withColumn("_tree", F.xxhash64("_cell", "_block"))
    )
    # A row per tree on either side: trees of equal length meet, each two once. What is not near goes as soon as their nodes are seen.
    left = blocks.select(F.col("_tree").alias("_a"), "_dim")
    right = blocks.select(F.col("_tree").alias("_b"), "_dim")
    meets = store_table(left.join(right, "_dim").where("_a <= _b").select("_a", "_b", F.xxhash64("_a", "_b").alias("_piece")))
    rows = grown.withColumn("_tree", F.xxhash64("_cell", "_block")).drop("_cell", "_block")
    sides = meets.select("_piece", F.explode(F.when(F.col("_a") == F.col("_b"), F.array(F.struct(F.lit(0).alias("side"), F.col("_a").alias("tree")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("_a").alias("tree")), F.struct(F.lit(1).alias("side"), F.col("_b").alias("tree"))))).alias("e"))
    sides = sides.select("_piece", F.col("e.side").alias("_side"), F.col("e.tree").alias("_tree"))
    work = rows.join(sides, "_tree").drop("_tree")

    def tree(pdf):
        names = pdf["_node"].to_numpy(np.int64)
        order = np.argsort(names)
        under = order[np.searchsorted(names[order], np.stack(pdf["_under"].to_numpy()))]
        return Tree(unit(_matrix(pdf["_vec"])), under, pdf["_n"].to_numpy(float), names)

    def meet(pdf):
        one, two = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        first = tree(one)
        second = tree(two) if len(two) else first
        walk = Traversal(first, second, cosine)
        a, b = walk.run()
        found = [(first.names, walk.count_a)] + ([(second.names, walk.count_b)] if len(two) else [])
        frames = [pd.DataFrame({"a": a, "b": b, "n": -1})]
        frames += [pd.DataFrame({"a": names[c > 0], "b": 0, "n": c[c > 0].astype(np.int64)}) for names, c in found]
        return pd.concat(frames)

    return store_table(work.groupBy("_piece").applyInPandas(meet, "a bigint, b bigint, n bigint"))


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: ``<id>, n_links, component_id, kept``.

    Vectors link when their cosine, in double precision, is at least ``cosine``. Null and zero vectors and those
    with null or non-finite components link with nothing; nor do vectors of different length. Equal
    vectors are one class that counts as often as it occurs; ``n_links`` counts rows other than the row
    itself. ``component_id`` is the smallest id reachable, ``kept`` says that it is the row's own. A null id is never
    the smallest while there is another. No rows give no rows; other columns are ignored.
    """
    vector = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("_id"), vector.alias("_vec"), _usable(vector).alias("_ok"))
    rows = rows.withColumn("_node", F.when(F.col("_ok"), F.xxhash64(F.md5(F.col("_vec").cast("string")))))
    classes = store_table(rows.where("_ok").groupBy("_node").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"), F.first("_vec").alias("_vec")))
    found = links(trees(classes, block), cosine)
    linked = found.where("n >= 0").groupBy("a").agg(F.sum("n").alias("_links"))
    roots = components(found.where("n < 0"))
    named = classes.select("_node", "_least").join(roots, F.col("_node") == F.col("node"), "left").select("_node", "_least", F.coalesce("root", "_node").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_least").alias("_component"))
    answer = named.join(least, "_root").join(linked, F.col("_node") == F.col("a")).select(F.col("_node").alias("_of"), "_component", "_links")
    component = F.when(F.col("_ok"), F.col("_component")).otherwise(F.col("_id"))
    return rows.select("_id", "_ok", "_node").join(answer, F.col("_node") == F.col("_of"), "left").select(
        F.col("_id").alias(id_col),
        F.coalesce(F.col("_links") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
