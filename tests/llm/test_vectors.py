import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm import centroids, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="session")
def odd_vectors(spark):
    """Nulls in every column, empty vectors, other lengths, entries that aren't numbers, repeats, ties, clashing names."""
    rng = np.random.default_rng(1)
    usual = [(i, rng.normal(0, 0.2, 6).astype(np.float32).tolist(), 1) for i in range(300)]
    odd = [(1, usual[0][1], None), (None, usual[1][1], 2), (None, usual[1][1], 2), (900, None, 1), (901, [], 1), (902, [1.0, 2.0], 1), (903, [None] + [0.0] * 5, 1), (904, [float("nan")] + [0.0] * 5, 1), (905, [float("inf")] + [0.0] * 5, 1)]
    table = spark.createDataFrame(usual + odd + usual[:40], SCHEMA)
    return table.withColumns({c: F.lit("clash") for c in ("x", "row", "col", "value", "cluster", "component", "n", "ids", "distance")})


def kept(table, dims):
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    return [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]


def test_whitening_against_dense_algebra(odd_vectors):
    rows = kept(odd_vectors, 6)
    x = np.floor(64 * np.array([v for _, v in rows])).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = c @ vectors / np.sqrt(values)
    got = whitening.whiten(odd_vectors, components=4).collect()
    assert len(got) == 4 * n and {r["component"] for r in got} == {1, 2, 3, 4} and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    for k in range(4):
        own = sorted((r for r in got if r["component"] == k + 1), key=lambda r: (r["deviation"], r["vec_id"] is None, r["vec_id"] or 0))
        order = sorted(range(n), key=lambda i: (int(((n * x[i] - s) ** 2).sum()), rows[i][0] is None, rows[i][0] or 0))
        assert [(r["vec_id"], r["deviation"]) for r in own] == [(rows[i][0], int(((n * x[i] - s) ** 2).sum())) for i in order]
        mine, theirs = np.array([r["whitened"] for r in own]), want[order, k]
        assert np.abs(mine * np.sign(mine @ theirs) - theirs).max() < 1e-8
        assert abs(own[0]["explained"] - values[k] / values.sum()) < 1e-12


@pytest.mark.parametrize("dims,k", [(3, 3), (40, 5), (120, 6)])
def test_lobpcg_certifies_its_residuals(dims, k):
    """Also where vectors, residuals and directions together are fewer than the dimensions, so that several rounds are needed."""
    rng = np.random.default_rng(dims)
    q, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
    values = np.sort(rng.uniform(1, 2, dims))[::-1] * np.linspace(3, 1, dims)
    matrix = (q * values) @ q.T
    asked = []
    found, vectors, residual = whitening.lobpcg(lambda block: asked.append(block.shape[1]) or matrix @ block, dims, k)
    want = np.sort(np.linalg.eigvalsh(matrix))[::-1][:k]
    assert np.abs(found - want).max() < 1e-10 and residual <= 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-10 and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert dims < 100 or len(asked) > 3
    with pytest.raises(RuntimeError):
        whitening.lobpcg(lambda block: rng.normal(size=(dims, dims)) @ block, dims, k, most_rounds=2)


def test_exact_deviations_of_large_entries():
    x = np.array([[1 << 40, 5], [3, -(1 << 40)], [7, 9]], np.int64)
    centre = whitening.Centre(3, [int(v) for v in x.sum(0)])
    assert centre.deviations(x) == [v if v < 2**63 else None for v in (sum((3 * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(0))) for row in x)]
    small = np.array([[1, 5], [3, -4], [7, 9]], np.int64)
    centre = whitening.Centre(3, [int(v) for v in small.sum(0)])
    assert centre.deviations(small) == [int(((3 * row - small.sum(0)) ** 2).sum()) for row in small]


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1)], [(1, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1)] * 5, [(1, [float("nan")], 1)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    line = spark.createDataFrame([(i, [float(i), float(2 * i)], 1) for i in range(9)] + [(99, [3e38, 0.0], 1)] * 0, SCHEMA)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}  # the other has no variance
    far = spark.createDataFrame([(i, [3e38 if i == 3 else float(i), 1.0 * (i % 3)], 1) for i in range(9)], SCHEMA)
    assert {r["deviation"] for r in whitening.whiten(far).collect()} == {None}  # beyond a long: each is far from the mean


def lloyd(rows, k, rounds, scale, seed):
    """Plain loops over whole numbers."""
    x = [tuple(int(np.clip(np.floor(scale * np.float64(v)), -(2**27), 2**27)) for v in vec) for _, vec in rows]
    order = sorted(range(len(x)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest() if rows[i][0] is not None else "", rows[i][1]))
    z = [x[i] for i in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for step in range(rounds + 1):
        own = [min(range(len(z)), key=lambda c: (far(v, z[c]), c)) for v in x]
        if step < rounds:
            for c in range(len(z)):
                members = [v for v, o in zip(x, own) if o == c]
                z[c] = tuple(sum(col) // len(members) for col in zip(*members)) if members else z[c]
    distance = [far(v, z[o]) for v, o in zip(x, own)]
    inside = [sum(d for d, o in zip(distance, own) if o == c) for c in range(len(z))]
    return sorted((i or -1, o, d, inside[o], sum(distance), hashlib.sha256(",".join(map(str, z[o])).encode()).hexdigest()) for (i, _), o, d in zip(rows, own, distance))


@pytest.mark.parametrize("k,rounds", [(1, 1), (7, 5), (40, 3), (1000, 1)])
def test_clusters_against_plain_loops(odd_vectors, k, rounds):
    got = centroids.cluster(odd_vectors, k=k, dims=6, rounds=rounds, scale=8, seed=2)  # a small scale gives ties
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got.columns == names
    assert sorted((r["vec_id"] or -1, *(r[c] for c in names[1:])) for r in got.collect()) == lloyd(kept(odd_vectors, 6), k, rounds, 8, 2)


def test_clusters_of_huge_entries_and_of_nothing(spark):
    rows = [(i, [float(3e38 if i % 3 == 0 else 2**17 * i), float(-i)], 1) for i in range(30)]
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=4, dims=2, rounds=3)
    assert sorted((r["vec_id"] or -1, r["cluster"], r["distance"]) for r in got.collect()) == [t[:3] for t in lloyd([(i, v) for i, v, _ in rows], 4, 3, 256, 2)]
    assert centroids.cluster(spark.createDataFrame([(1, [1.0], 1), (2, None, 1)], SCHEMA), dims=2).collect() == []
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).collect() == []


def test_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-50, 50, (900, 3)) + 400 * np.array(at) for at in ([0, 0, 0], [5, 0, 1], [0, 9, 2])] + [np.full((500, 3), 77)])
    tree, order = centroids.Tree.over(x)
    assert sorted(order) == list(range(len(x))) and (tree.x == x[order]).all()
    leaves = tree.left < 0
    assert (tree.sums[0] == x.sum(0)).all() and (tree.sums[leaves].sum(0) == x.sum(0)).all()
    assert ((tree.stop - tree.start)[leaves & (tree.low != tree.high).any(axis=1)] <= centroids.LEAF).all()
    for scale in (1, 1 << 18):  # the second is beyond what doubles hold exactly
        tree, _ = centroids.Tree.over(x * scale)
        z = x[[5, 1000, 2000, 2800, 5]] * scale  # the last ties with the first
        whole, rows, leaf = tree.assign(z)
        own = np.full(len(x), -1)
        for node, c in whole:
            assert (own[tree.start[node] : tree.stop[node]] == -1).all()
            own[tree.start[node] : tree.stop[node]] = c
        assert (own[rows] == -1).all()
        own[rows] = leaf
        want = np.argmin([((tree.x.astype(np.int64) - c) ** 2).sum(1) for c in z], axis=0)
        assert (own == want).all()
        assert scale > 1 or sum(tree.stop[n] - tree.start[n] for n, _ in whole) > len(x) / 2  # most are assigned in whole nodes
