"""Lloyd's algorithm by dual trees: a cover tree over the vectors, one over the centroids in every round.

Vectors are laid in blocks of at most `block` where they are read; each block gets its cover tree once, and blocks are written in the shared folder as rows. In every round the centroids (k rows, a
parameter, sent to all tasks) get a tree of their own, and both are walked together: a pair of nodes goes when its least possible distance is beyond the greatest possible distance
of the vectors' node to its nearest centroid; a node with one centroid left is that centroid's as a whole; pairs of leaves are compared exactly, in integers. Sums of the clusters leave a
task as k rows and are added in Spark. Bounds are in floating point with a margin; only comparisons in integers decide.

Components are floor(scale * x), so sums, means (floor) and squared distances are exact; a component beyond 2^26 after scaling is an error, as its distances need not fit a long. Vectors that are
null, of another length, or hold a null or non-finite component are left out. Equal distances go to the smaller number. Starts are the vectors with the least hash of their ids (ties by the
components, so repeated rows are starts of their own); with fewer vectors than centroids all of them are starts. A null id hashes as the empty text. Repeated vectors are one leaf, however
many there are in a block. An empty table gives an empty result. Columns other than id and vector are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velarium.shared import cut, ship, stored

MOST = 1 << 26
#: Relative margin of the bounds in floating point.
SLACK = 1e-9


@dataclass
class CoverTree:
    """Nodes by number, the root first, children of a node next to each other; a node's points are a range of `order`. `centre` is a place in `order`."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, leaf: int) -> CoverTree:
        """Children of a node lie within half its scale (a power of two) of their centre, their centres farther than that from each other, and the first has the node's own centre."""
        n = len(points)
        x = points.astype(np.float64)
        norms = (x * x).sum(1)
        between = np.sqrt(np.maximum(norms[:, None] + norms[None, :] - 2 * (x @ x.T), 0))
        order = np.arange(n)
        low, high, at, radius, child, children = [0], [n], [0], [float(between[0].max())], [0], [0]
        node = 0
        while node < len(low):
            a, b, centre = low[node], high[node], at[node]
            if b - a > leaf and radius[node] > 0:
                scale = 2.0 ** (np.ceil(np.log2(radius[node])) - 1)
                rest, done, child[node] = order[a:b].copy(), a, len(low)
                while len(rest):
                    near = between[centre, rest] <= scale
                    near |= rest == centre
                    own = rest[near]
                    order[done : done + len(own)] = own
                    low.append(done)
                    high.append(done + len(own))
                    at.append(int(centre))
                    radius.append(float(between[centre, own].max()))
                    child.append(0)
                    children.append(0)
                    done, rest = done + len(own), rest[~near]
                    centre = rest[0] if len(rest) else 0
                children[node] = len(low) - child[node]
            node += 1
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        # rounding of `between` is far below this
        far = np.array(radius) * (1 + SLACK) + 1e-6 * np.sqrt(norms.max(initial=0) + 1)
        return cls(order, np.array(low), np.array(high), place[at], far, np.array(child), np.array(children))


def _expanded(tree: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of each node, a leaf for itself; which entry each comes from."""
    n = np.maximum(tree.children[nodes], 1)
    of = np.repeat(np.arange(len(nodes)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return np.where(tree.children[nodes] > 0, tree.child[nodes], nodes)[of] + step, of


def nearest(points: np.ndarray, tree: CoverTree, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of the nearest centroid of each point (both of integers, points in the tree's order), and how many distances to points were computed."""
    ctree = CoverTree.of(centroids, 1)
    moved = centroids[ctree.order]
    p, c = points.astype(np.float64), moved.astype(np.float64)
    labels, compared = np.full(len(points), -1, np.int64), 0
    q, r, most = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, np.inf)  # pairs; bound of each vectors' node, by its place among the live ones
    nodes = np.zeros(1, np.int64)  # the live nodes; q counts in these
    leaves, rivals = [], []
    while len(q):
        d = np.sqrt(((p[tree.centre[nodes[q]]] - c[ctree.centre[r]]) ** 2).sum(1))
        reach = tree.radius[nodes[q]]
        np.minimum.at(most, q, d * (1 + SLACK) + reach)
        keep = d * (1 - SLACK) - reach - ctree.radius[r] <= most[q]
        q, r = q[keep], r[keep]
        single = ctree.high[r] - ctree.low[r] == 1
        alone = (np.bincount(q, minlength=len(nodes))[q] == 1) & single
        for node, centroid in zip(nodes[q[alone]], ctree.order[ctree.low[r[alone]]], strict=True):
            labels[tree.low[node] : tree.high[node]] = centroid
        q, r = q[~alone], r[~alone]
        ends = (tree.children[nodes[q]] == 0) & (ctree.children[r] == 0)
        leaves.append(nodes[q[ends]])
        rivals.append(r[ends])
        q, r = q[~ends], r[~ends]
        r, of = _expanded(ctree, r)
        q = q[of]
        live, q = np.unique(q, return_inverse=True)
        kids, of = _expanded(tree, nodes[live])
        # each pair of a node becomes pairs of its children
        width = np.bincount(of, minlength=len(live))
        first = np.cumsum(width) - width
        n = width[q]
        q, r = np.repeat(first[q], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(r, n)
        nodes, most = kids, most[live][of]
    leaves, rivals = np.concatenate(leaves), np.concatenate(rivals)
    # pairs of leaves: every vector with every centroid, in integers
    for s in range(0, len(leaves), 1024):
        a, b = leaves[s : s + 1024], rivals[s : s + 1024]
        n, m = tree.high[a] - tree.low[a], ctree.high[b] - ctree.low[b]
        of = np.repeat(np.arange(len(a)), n * m)
        step = np.arange(len(of)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        i, j = tree.low[a][of] + step // m[of], ctree.low[b][of] + step % m[of]
        d = np.concatenate([((points[i[k : k + 50_000]] - moved[j[k : k + 50_000]]) ** 2).sum(1) for k in range(0, len(i), 50_000)])
        compared += len(i)
        best = np.lexsort((ctree.order[j], d, i))
        i, j, d = i[best], ctree.order[j[best]], d[best]
        head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        i, j, d = i[head], j[head], d[head]
        # a leaf's pairs may lie in several parts
        before = labels[i]
        held = np.where(before >= 0, ((points[i] - centroids[before]) ** 2).sum(1), d)
        better = (before < 0) | (d < held) | ((d == held) & (j < before))
        labels[i[better]] = j[better]
    return labels, compared


PARTS = ["points", "low", "high", "centre", "radius", "child", "children"]


def blocks(vectors: DataFrame, block: int, leaf: int) -> DataFrame:
    """Rows of (id, vec) as blocks with their cover trees, written once."""
    id_type = vectors.schema["id"].dataType
    names = ["ids", *PARTS]
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(c, T.BinaryType()) for c in PARTS)])

    def row(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        tree = CoverTree.of(points, leaf)
        whole = [points[tree.order].astype("<i4"), *(x.astype("<i4") for x in (tree.low, tree.high, tree.centre)), tree.radius.astype("<f8"), *(x.astype("<i4") for x in (tree.child, tree.children))]
        own = ids.take(pa.array(tree.order))
        held = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        return pa.RecordBatch.from_arrays([held, *(pa.array([x.tobytes()], pa.binary()) for x in whole)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, n = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - n)
                at, n = at + part.num_rows, n + part.num_rows
                ids.append(part.column(0))
                points.append(part.column(1).flatten().to_numpy().reshape(part.num_rows, -1))
                if n == block:
                    yield row(pa.concat_arrays(ids), np.concatenate(points))
                    ids, points, n = [], [], 0
        if n:
            yield row(pa.concat_arrays(ids), np.concatenate(points))

    return stored(vectors.select("id", "vec").mapInArrow(run, schema), "vector-trees")


def _read(batch: pa.RecordBatch, k: int, dims: int) -> tuple[np.ndarray, CoverTree]:
    points, low, high, centre, radius, child, children = (np.frombuffer(batch.column(1 + i)[k].as_buffer(), "<f8" if i == 4 else "<i4") for i in range(7))
    wide = lambda x: x.astype(np.int64)
    return wide(points).reshape(-1, dims), CoverTree(np.arange(len(points) // dims), wide(low), wide(high), wide(centre), radius, wide(child), wide(children))


def move(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for b in range(batch.num_rows):
                points, tree = _read(batch, b, dims)
                labels, _ = nearest(points, tree, centroids)
                order = np.argsort(labels, kind="stable")
                kinds, first = np.unique(labels[order], return_index=True)
                total[kinds] += np.add.reduceat(points[order], first, axis=0)
                count += np.bincount(labels, minlength=k)
        some = np.flatnonzero(count)
        if len(some):
            ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.ListArray.from_arrays(ends, pa.array(total[some].ravel()))], names=["cluster", "n", "sums"])

    parts = trees.mapInArrow(sums, "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in each.collect():  # k * dims rows
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims = centroids.shape[1]
    schema = T.StructType([T.StructField("id", trees.schema["ids"].dataType.elementType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                points, tree = _read(batch, b, dims)
                labels, _ = nearest(points, tree, centroids)
                far = ((points - centroids[labels]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b, 1).flatten(), pa.array(labels.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    return trees.mapInArrow(run, schema)


def integral(table: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, vec) of the vectors that are kept, in integers."""
    x = F.col(f"`{vector_col}`")
    fit = x.isNotNull() & (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.floor(v.cast("double") * scale)
    bounded = lambda v: F.when(F.abs(v.cast("double") * scale) < MOST, whole(v)).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST} after scaling")).cast("long"))
    return table.select(F.col(f"`{id_col}`").alias("id"), F.when(fit, F.transform(x, bounded)).alias("vec")).filter(F.col("vec").isNotNull())


def clusters(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, block: int = 2048, leaf: int = 16, salt: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector after `rounds` moves and a last assignment, and the centroids. A block's distances are block^2 numbers in a task."""
    ship(table.sparkSession)
    vectors = integral(table, id_col, vector_col, dims, scale)
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    starts = vectors.orderBy(key, "vec").limit(k).select("vec").collect()
    centroids = np.array([r["vec"] for r in starts], np.int64).reshape(-1, dims)
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    trees = blocks(vectors, block, leaf)
    for _ in range(rounds):
        centroids = move(trees, centroids)
    return assigned(trees, centroids), centroids


def cluster_report(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    found, centroids = clusters(table, id_col, vector_col, **options)
    found, spark = cut(found), table.sparkSession
    marks = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = found.agg(F.sum("distance").alias("inertia"))
    # k rows and one row
    sums = F.broadcast(each.join(F.broadcast(marks), "cluster").join(F.broadcast(whole)))
    return found.join(sums, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
