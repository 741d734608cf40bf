"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length one; cosine ``c`` is chord length ``sqrt(2 - 2c)``, a metric, so covering radii bound
what two subtrees can hold. Equal vectors are collapsed first and rejoined last.

Over the whole table the top of the tree is a set of cells around at most ``CELLS`` centres, taken by farthest
first from a bounded sample; a cell's covering radius and size come from all its vectors. Cells are dealt into
blocks of at most about ``BLOCK`` vectors, each of which gets a cover tree (levels of halving radii) once. Blocks of
cells whose covering radii leave a partner possible meet in pairs, one task each; their trees are traversed together:
node pairs further apart than their radii and the threshold allow are pruned, node pairs wholly within the threshold
are counted as a whole and united without looking at their members, the rest is opened; single vectors are compared
by cosine in double precision (those that single precision can't rule out). Tasks return link counts and one edge per
vector, never pairs.

Where cells overlap so much that their blocks would be sent to more partners than blocks without regard to cells,
the latter are taken: few and large, so copies of vectors stay few. Vectors without structure (independent directions
in many dimensions) are such: no metric tree prunes much between them, and comparisons grow with the square of their
number, copies with the square over ``BLOCK``.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of unlike
dimension don't link. Repeated rows link with each other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import materialize
from tributary.llm.components import connected_components

COSINE, BLOCK, CELLS, SAMPLE, LEAF, SPREAD, CHUNK = 0.95, 8192, 256, 4096, 16, 6, 1 << 22
SLACK = 2e-7  # on bounds only, over the rounding of distances; decisions on single pairs are by cosine
SINGLE = 1e-5  # over the rounding of cosines in single precision


class Node:
    """A cover-tree node: all its points (its centre first), their covering radius, and its children, each within half
    the radius of its own centre: single points, and nodes."""

    __slots__ = ("points", "radius", "singles", "nodes")

    def __init__(self, points: np.ndarray, radius: float):
        self.points, self.radius = points, radius
        self.singles, self.nodes = points, []  # a leaf has single points only

    def moved(self, by: int) -> Node:
        out = Node(self.points + by, self.radius)
        out.singles, out.nodes = self.singles + by, [n.moved(by) for n in self.nodes]
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def build(vectors: np.ndarray, points: np.ndarray, away: np.ndarray) -> Node:
    """Tree over ``points``, the first of which is the centre; ``away`` are their distances to it."""
    node = Node(points, float(away.max()))
    if len(points) <= LEAF or node.radius <= SLACK:  # equal but for rounding
        return node
    x = vectors[points]
    half, free = node.radius / 2, np.ones(len(points), bool)
    least = 1 - half * half / 2  # cosine at half the radius
    step = max(1, CHUNK // len(x))
    near, singles = np.concatenate([(x[i : i + step] @ x.T >= least).sum(1) for i in range(0, len(x), step)]), []
    for c in range(len(points)):
        if not free[c]:
            continue
        if near[c] == 1:
            singles.append(points[c])
            continue
        mine = np.flatnonzero(free & (x @ x[c] >= least))
        free[mine] = False
        mine = np.concatenate([[c], mine[mine != c]])
        if len(mine) == 1:
            singles.append(points[c])
        else:
            node.nodes.append(build(vectors, points[mine], distances(x[mine], x[[c]])[:, 0]))
    node.singles = np.array(singles, np.int64)
    return node


class Dual:
    """Counts links and unites linked points while two trees are traversed together."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, cosine: float):
        self.vectors, self.weights, self.cosine = vectors, weights, cosine
        self.single = vectors.astype(np.float32)
        self.reach = math.sqrt(2 - 2 * cosine)
        self.links = np.zeros(len(vectors), np.int64)
        self.parent = np.arange(len(vectors))
        self.compared = 0

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def unite(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def whole(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """All of ``a`` link with all of ``b``, or with each other."""
        w = self.weights
        if b is None:
            self.links[a] += w[a].sum() - w[a]
        else:
            self.links[a] += w[b].sum()
            self.links[b] += w[a].sum()
            a = np.concatenate([a, b])
        for i in a[1:]:
            self.unite(a[0], i)

    def pairs(self, a: np.ndarray, b: np.ndarray, same: bool = False) -> None:
        """Compare single points by cosine."""
        if not len(a) or not len(b):
            return
        self.compared += len(a) * len(b)
        step = max(1, CHUNK // len(b))
        for lo in range(0, len(a), step):
            part = a[lo : lo + step]
            i, j = np.nonzero(self.single[part] @ self.single[b].T >= self.cosine - SINGLE)
            if same:  # a is b
                i, j = i[i + lo < j], j[i + lo < j]
            if not len(i):
                continue
            x, y = part[i], b[j]
            sure = np.einsum("ij,ij->i", self.vectors[x], self.vectors[y]) >= self.cosine
            x, y = x[sure], y[sure]
            np.add.at(self.links, x, self.weights[y])
            np.add.at(self.links, y, self.weights[x])
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                self.unite(p, q)

    def points(self, some: np.ndarray, node: Node) -> None:
        """Single points against a node."""
        far = distances(self.vectors[some], self.vectors[node.points[:1]])[:, 0]
        self.compared += len(some)
        inside = far + node.radius + SLACK <= self.reach
        if inside.any():
            self.whole(some[inside], node.points)
        some = some[~inside & (far <= node.radius + self.reach + SLACK)]
        if len(some):
            self.pairs(some, node.singles)
            for n in node.nodes:
                self.points(some, n)

    def meet(self, a: Node, b: Node) -> None:
        """Links between two nodes, or within one."""
        same = a is b
        if same and 2 * a.radius + SLACK <= self.reach:
            return self.whole(a.points, None)
        self.pairs(a.singles, b.singles, same)
        for n in b.nodes:
            if len(a.singles):
                self.points(a.singles, n)
        if not same and len(b.singles):
            for n in a.nodes:
                self.points(b.singles, n)
        if a.nodes and b.nodes:
            far = distances(self.vectors[[n.points[0] for n in a.nodes]], self.vectors[[n.points[0] for n in b.nodes]])
            self.compared += far.size
            radii = np.array([n.radius for n in a.nodes])[:, None] + np.array([n.radius for n in b.nodes])
            near = far <= radii + self.reach + SLACK
            for i, j in zip(*np.nonzero(np.triu(near) if same else near), strict=True):
                p, q = a.nodes[i], b.nodes[j]
                if p is not q and far[i, j] + radii[i, j] + SLACK <= self.reach:
                    self.whole(p.points, q.points)
                else:
                    self.meet(p, q)
        return None


def tree(vectors: np.ndarray) -> Node:
    return build(vectors, np.arange(len(vectors)), distances(vectors, vectors[:1])[:, 0])


def search(vectors: np.ndarray, weights: np.ndarray, left: Node, right: Node | None, cosine: float) -> Dual:
    """Links within ``left`` (``right`` is None) or between ``left`` and ``right``."""
    dual = Dual(vectors, weights, cosine)
    if right is None:
        dual.meet(left, left)
        return dual
    far = float(distances(vectors[left.points[:1]], vectors[right.points[:1]])[0, 0])
    if far + left.radius + right.radius + SLACK <= dual.reach:
        dual.whole(left.points, right.points)
    elif far <= left.radius + right.radius + dual.reach + SLACK:
        dual.meet(left, right)
    return dual


def unit(rows, dim: int) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres(sample: list, dim: int, k: int) -> np.ndarray:
    """``k`` centres by farthest first."""
    x = unit(sample, dim)
    chosen, away = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < min(k, len(x)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK, cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``embeddings (vec_id, embedding)``."""
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.col("embedding")).alias("embedding"))
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    # A class of rows without vec_id can't be told from others by it; a key of its own stands for it.
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("key"), "rep", "n", "embedding", F.size("embedding").alias("dim")), "vectors")
    dims = classes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()  # at most rows / block
    large = [d.dim for d in dims]
    links = _small_links(classes.where(~F.col("dim").isin(large)) if large else classes, cosine)
    for d in dims:
        links = links.unionByName(_links(classes.where(F.col("dim") == d.dim), d.dim, d.n, cosine, block, cells, sample))
    links = materialize(links, "vector-links")
    counted = links.groupBy("key").agg(F.sum("n_links").alias("found"))
    component = connected_components(links.select(F.col("key").alias("src"), F.col("head").alias("dst")))
    joined = classes.select("key", "rep", "n", "embedding").join(component.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    member = joined.join(least, "component").join(counted, "key", "left").select("embedding", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.where("embedding is not null").join(member, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _found(dual: Dual, keys: np.ndarray) -> pa.Table:
    hit = np.flatnonzero(dual.links)
    roots = np.array([dual.root(i) for i in hit], np.int64)
    return pa.table({"key": pa.array(keys[hit]), "n_links": pa.array(dual.links[hit]), "head": pa.array(keys[roots])})


def _small_links(classes: DataFrame, cosine: float) -> DataFrame:
    """As ``_links``, for dimensions with one block of vectors each: one tree, traversed with itself."""

    def run(table: pa.Table) -> pa.Table:
        vectors = unit(table["embedding"].to_pylist(), table["dim"][0].as_py())
        return _found(search(vectors, table["n"].to_numpy(), tree(vectors), None, cosine), table["key"].to_numpy())

    return classes.select("dim", "key", "n", "embedding").groupBy("dim").applyInArrow(run, "key long, n_links long, head long")


def _links(classes: DataFrame, dim: int, total: int, cosine: float, block: int, cells: int, sample: int) -> DataFrame:
    """``(key, n_links, head)`` per task and linked vector of one dimension; head is the least key linked there."""
    spark = classes.sparkSession.sparkContext
    reach = math.sqrt(2 - 2 * cosine)
    picked = classes.orderBy(F.xxhash64("embedding")).limit(sample).select("embedding").collect()
    pivots = centres([r.embedding for r in picked], dim, max(1, min(cells, -(-total // block))))
    shared = spark.broadcast(pivots)  # at most `cells` vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                away = distances(unit(b.column(2).to_pylist(), dim), shared.value)
                home = away.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(away[np.arange(len(home)), home])], names=["key", "n", "embedding", "cell", "away"])

    kind = classes.schema["embedding"].dataType.simpleString()
    dealt = materialize(classes.select("key", "n", "embedding").mapInArrow(assign, f"key long, n long, embedding {kind}, cell int, away double"), "cells")
    cell = {r.cell: r for r in dealt.groupBy("cell").agg(F.count("*").alias("size"), F.max("away").alias("radius")).collect()}  # at most `cells`
    radius = np.array([cell[c].radius if c in cell else -9.0 for c in range(len(pivots))])
    blocks = np.array([-(-cell[c].size // block) if c in cell else 0 for c in range(len(pivots))], np.int64)
    first = np.concatenate([[0], np.cumsum(blocks)])
    # Cells whose covering radii leave room for a partner meet, block by block.
    near = distances(pivots, pivots) <= radius[:, None] + radius[None, :] + reach + SLACK
    plain = max(-(-total // block), min(SPREAD, -(-total // 1024)))  # blocks without regard to cells
    sent = sum(cell[c].size * int(blocks[near[c]].sum()) for c in cell)
    by_cell = sent < plain * total
    if not by_cell:
        blocks, first, near = np.array([plain]), np.array([0, plain]), np.ones((1, 1), bool)
    layout = spark.broadcast((blocks, first, near))
    code = "<f4" if "float" in kind else "<f8"

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, base, _ = layout.value
        for b in batches:
            home, key = b.column(3).to_numpy() if by_cell else np.zeros(b.num_rows, np.int32), b.column(0).to_numpy()
            salt = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many[home]
            yield pa.RecordBatch.from_arrays([pa.array(base[home] + salt), pa.array(home), *b.columns[:3]], names=["block", "cell", "key", "n", "embedding"])

    def plant(table: pa.Table) -> pa.Table:
        """One row for a block: its vectors, their tree, and the blocks it meets."""
        many, base, meets = layout.value
        table = table.sort_by("key")
        raw = np.array(table["embedding"].to_pylist(), code)
        mine = table["block"][0].as_py()
        others = np.concatenate([np.arange(base[c], base[c] + many[c]) for c in np.flatnonzero(meets[table["cell"][0].as_py()])])
        row = {"block": mine, "x": [min(mine, o) for o in others.tolist()], "y": [max(mine, o) for o in others.tolist()], "keys": table["key"].to_numpy().astype("<i8").tobytes(), "weights": table["n"].to_numpy().astype("<i8").tobytes(), "vectors": raw.tobytes(), "tree": pickle.dumps(tree(unit(raw, dim)))}
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)})

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys = np.concatenate([np.frombuffer(r["keys"], "<i8") for r in rows])
        weights = np.concatenate([np.frombuffer(r["weights"], "<i8") for r in rows])
        vectors = np.concatenate([unit(np.frombuffer(r["vectors"], code), dim) for r in rows])
        trees = [pickle.loads(r["tree"]) for r in rows]
        dual = search(vectors, weights, trees[0], trees[1].moved(len(trees[0].points)) if len(rows) > 1 else None, cosine)
        return _found(dual, keys)

    placed = dealt.mapInArrow(block_of, f"block long, cell int, key long, n long, embedding {kind}")
    grown = placed.groupBy("block").applyInArrow(plant, "block long, x array<long>, y array<long>, keys binary, weights binary, vectors binary, tree binary")
    grown = materialize(grown, "trees")
    pairs = grown.select("block", F.explode(F.arrays_zip("x", "y")).alias("p"), "keys", "weights", "vectors", "tree").select("p.x", "p.y", "block", "keys", "weights", "vectors", "tree")
    return pairs.groupBy("x", "y").applyInArrow(run, "key long, n_links long, head long")
