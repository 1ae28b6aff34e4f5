"""Clustering by centroids: Lloyd's rounds in whole numbers, with kd-trees that assign whole boxes of vectors at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import added_up, finite_rows

LEAF, ROWS = 32, 4096  # vectors of a leaf, and of a tree, at most
LARGEST = 2.0**27  # entries beyond it, once scaled, count as this, so that a squared distance is a long
#: The columns of a tree, each an array as bytes: vectors in the order of the leaves; for each node its first and last row, its left
#: child (the right one is the next; -1: a leaf), the sum of its vectors, and its box.
TREE = {"x": np.int32, "start": np.int32, "stop": np.int32, "left": np.int32, "sums": np.int64, "low": np.int32, "high": np.int32}


class Tree:
    """A kd-tree over integer vectors: each node is halved at the median of its widest dimension until few or equal vectors are left."""

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def over(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """(tree, order): ``order`` has the row of ``x`` of each of the tree's vectors."""
        order, spans, left = np.arange(len(x)), [(0, len(x))], []
        for lo, hi in spans:  # grows meanwhile
            child = -1
            if hi - lo > LEAF:
                part = x[order[lo:hi]]
                width = part.max(axis=0) - part.min(axis=0)
                if width.any():
                    mid = (hi - lo) // 2
                    order[lo:hi] = order[lo:hi][np.argpartition(part[:, width.argmax()], mid)]
                    child = len(spans)
                    spans += [(lo, lo + mid), (lo + mid, hi)]
            left.append(child)
        start, stop, left = (np.array(v, np.int32) for v in (*zip(*spans), left))
        x = np.ascontiguousarray(x[order], np.int32)
        sums, low, high = np.zeros((len(left), x.shape[1]), np.int64), np.zeros((len(left), x.shape[1]), np.int32), np.zeros((len(left), x.shape[1]), np.int32)
        for i in reversed(range(len(left))):  # children come after their node
            if left[i] < 0:
                part = x[start[i] : stop[i]]
                sums[i], low[i], high[i] = part.sum(axis=0, dtype=np.int64), part.min(axis=0), part.max(axis=0)
            else:
                a, b = left[i], left[i] + 1
                sums[i], low[i], high[i] = sums[a] + sums[b], np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
        return cls(x=x, start=start, stop=stop, left=left, sums=sums, low=low, high=high), order

    @classmethod
    def read(cls, row: dict, dims: int) -> Tree:
        arrays = {k: np.frombuffer(row[k], kind) for k, kind in TREE.items()}
        return cls(**{k: v.reshape(-1, dims) if k in ("x", "sums", "low", "high") else v for k, v in arrays.items()})

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """((node, centroid) of nodes assigned whole, rows, their centroids): every vector is in exactly one of them.

        A node's candidate goes if another candidate is strictly nearer to all of the node's box, which the corner most in
        the candidate's favour tells. Ties stay, and are settled in the leaves: the smaller number takes them.
        """
        whole, rows, owners = [], [], []
        exact = _fits(self, centroids)
        # beyond 2^53 products are only nearly right as doubles: then a candidate stays unless it loses by more than that
        slack = 0.0 if exact else 1e-12 * centroids.shape[1] * (4.0 * _largest(self, centroids)) ** 2
        c = centroids.astype(float)
        size = (c * c).sum(axis=1)
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        while len(nodes):
            low, high = self.low[nodes].astype(float), self.high[nodes].astype(float)
            best = np.where(open_, size - (low + high) @ c.T, np.inf).argmin(axis=1)
            for b in np.unique(best):
                at = best == b
                away = c - c[b]
                behind = size - size[b] - 2 * (high[at] @ np.maximum(away, 0).T + low[at] @ np.minimum(away, 0).T)
                open_[at] &= behind <= slack
            alone = open_.sum(axis=1) == 1
            whole += zip(nodes[alone].tolist(), open_[alone].argmax(axis=1).tolist())
            leaf = ~alone & (self.left[nodes] < 0)
            if leaf.any():
                spans = [np.arange(self.start[i], self.stop[i]) for i in nodes[leaf]]
                at = np.concatenate(spans)
                rows.append(at)
                owners.append(_nearest(self.x[at], centroids, np.repeat(open_[leaf], [len(s) for s in spans], axis=0), exact))
            inner = ~alone & ~leaf
            below = self.left[nodes[inner]].astype(np.int64)
            nodes, open_ = np.concatenate([below, below + 1]), np.concatenate([open_[inner]] * 2)
        none = np.zeros(0, np.int64)
        return whole, np.concatenate(rows) if rows else none, np.concatenate(owners) if owners else none


def _largest(tree: Tree, centroids: np.ndarray) -> int:
    return 1 + max(int(np.abs(v.astype(np.int64)).max(initial=0)) for v in (centroids, tree.low[0], tree.high[0]))


def _fits(tree: Tree, centroids: np.ndarray) -> bool:
    """Whether squared distances and the like stay below 2^53, so that doubles hold them exactly."""
    return 8 * centroids.shape[1] * _largest(tree, centroids) ** 2 < 2**53


def _nearest(x: np.ndarray, centroids: np.ndarray, allowed: np.ndarray, exact: bool) -> np.ndarray:
    """The nearest allowed centroid of each row, in exact arithmetic; of equally near ones the first."""
    if exact:
        c = centroids.astype(float)
        return np.where(allowed, (c * c).sum(axis=1) - 2 * (x.astype(float) @ c.T), np.inf).argmin(axis=1)
    far = np.stack([((x.astype(np.int64) - row) ** 2).sum(axis=1) for row in centroids], axis=1)
    return np.where(allowed, far, np.iinfo(np.int64).max).argmin(axis=1)


def trees(vectors: DataFrame, dims: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Kd-trees of at most ROWS vectors each, over those with ``dims`` finite entries; ``ids`` has the vectors' ids in the tree's order."""

    def grown(ids, parts):
        tree, order = Tree.over(np.concatenate(parts))
        columns = [pa.array([pa.concat_arrays(ids).take(pa.array(order)).to_pylist()], pa.list_(pa.int64()))]
        columns += [pa.array([np.ascontiguousarray(getattr(tree, k), kind).tobytes()], pa.binary()) for k, kind in TREE.items()]
        return pa.RecordBatch.from_arrays(columns, ["ids", *TREE])

    def run(batches):
        ids, parts, n = [], [], 0
        for batch in batches:
            at, values = finite_rows(batch.column(1), dims)
            x = np.clip(np.floor(scale * values), -LARGEST, LARGEST).astype(np.int64)
            own = batch.column(0).take(pa.array(at))
            for lo in range(0, len(x), ROWS):
                part = x[lo : lo + ROWS]
                if n + len(part) > ROWS:
                    yield grown(ids, parts)
                    ids, parts, n = [], [], 0
                ids, parts, n = [*ids, own[lo : lo + ROWS]], [*parts, part], n + len(part)
        if n:
            yield grown(ids, parts)

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "ids array<long>, " + ", ".join(f"{k} binary" for k in TREE))


def _read(batches, dims: int):
    """(ids, tree) of each row, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(j)[i] for j, k in enumerate(batch.schema.names)}
            yield row["ids"].values, Tree.read({k: row[k].as_buffer() for k in TREE}, dims)


def first_centroids(vectors: DataFrame, dims: int, k: int, seed: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """The integer vectors of the ``k`` ids whose sha256 of ``seed:id`` is least, in its order; null ids come last, equal ids by their vectors."""
    v = F.col(vector_col).cast("array<double>")
    usable = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("long").cast("string")), 256)
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(key.alias("key"), v.alias("v")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([np.clip(np.floor(scale * np.array(r["v"])), -LARGEST, LARGEST) for r in rows], np.int64).reshape(-1, dims)


def cluster(vectors: DataFrame, k: int = 40, dims: int = 64, rounds: int = 5, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector with ``dims`` finite entries.

    Entries become floor(scale * entry), those beyond 2^27 count as that. Other vectors are left out. Null and repeated ids
    stay, a row for each vector; with fewer than ``k`` vectors there are as many centroids. Ties go to the smaller number, so
    that of equal centroids all but the first stay empty, and as they are. A sum of distances beyond a long is null. An
    empty table gives no rows.

    Other columns, whatever their names, play no part. Each round reads the trees, which are written once, and gives the driver one sum for each centroid and dimension.
    """
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, dims, k, seed, scale, id_col, vector_col)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    k = len(centroids)
    grown = written(trees(vectors, dims, scale, id_col, vector_col), "trees")
    for _ in range(rounds):
        total = added_up(grown, lambda batches, now=centroids: _sums(batches, now), (k, dims + 1), exact=True)
        centroids = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old for row, old in zip(total.tolist(), centroids.tolist())], np.int64)

    def owners(batches):
        for ids, tree in _read(batches, dims):
            whole, rows, leaf = tree.assign(centroids)
            own = np.zeros(len(tree.x), np.int32)
            for node, c in whole:
                own[tree.start[node] : tree.stop[node]] = c
            own[rows] = leaf
            distance = ((tree.x.astype(np.int64) - centroids[own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(distance)], ["vec_id", "cluster", "distance"])

    placed = written(grown.mapInArrow(owners, schema), "clusters")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows at most
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    inside = lambda s: int(s) if s < 2**63 else None
    every = inside(sum(r["s"] for r in sums))
    about = spark.createDataFrame([(r["cluster"], inside(r["s"]), every, digest[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sums(batches, centroids: np.ndarray) -> np.ndarray:
    """For each centroid the sum of its vectors, and in a last column their number."""
    k, dims = centroids.shape
    total = np.zeros((k, dims + 1), np.int64)
    for _, tree in _read(batches, dims):
        whole, rows, leaf = tree.assign(centroids)
        for node, c in whole:
            total[c, :-1] += tree.sums[node]
            total[c, -1] += tree.stop[node] - tree.start[node]
        for c in np.unique(leaf):
            part = tree.x[rows[leaf == c]]
            total[c, :-1] += part.sum(axis=0, dtype=np.int64)
            total[c, -1] += len(part)
    return total
