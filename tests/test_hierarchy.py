import numpy as np
import pytest
from models import components, density_hierarchy, partition, unit
from test_vectors import CELLS, frame, labels, sample

from shutterlake.operators import clustering as C
from shutterlake.operators import hierarchy as H
from shutterlake.operators import neighbors as N


def blobs(seed, n=70, dim=6, spread=(0.03, 0.1, 0.3)):
    """Blobs of several densities, some inside a looser one, and a few stray rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    centres[5] = centres[4] + rng.normal(scale=0.25, size=dim)
    which = rng.integers(0, 7, n)
    scale = np.array([spread[i % 3] for i in range(7)])[which][:, None]
    m = centres[which] + rng.normal(size=(n, dim)) * scale
    m[:5] = rng.normal(size=(5, dim))
    return m


def kruskal(m, core=None):
    d = np.round(np.maximum(1 - unit(m) @ unit(m).T, 0), 9)
    if core is not None:
        d = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    n, total = len(m), 0.0
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for w, i, j in sorted((d[i, j], j, i) for i in range(n) for j in range(i)):
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            total += w
    return total


@pytest.mark.parametrize(("route", "min_samples"), [({}, 1), (CELLS, 4)])
def test_spanning_forest(spark, monkeypatch, route, min_samples):
    """Least total reach, one tree, and later rounds search fewer rows than there are."""
    monkeypatch.setattr(H, "LISTED", 4)
    m = blobs(1)
    rows = N.vector_rows(frame(spark, m), "id", "embedding").selectExpr("id", "vec", "1L AS size")
    with_core, lists = H.reachable(rows, min_samples, **route)
    edges, rounds = H.spanning_forest(with_core, lists, **route)
    got = edges.collect()
    d = np.maximum(1 - unit(m) @ unit(m).T, 0)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min_samples]
    assert len(got) == len(m) - 1
    assert len(set(components(len(m), [(e.u, e.v) for e in got]))) == 1
    assert sum(e.w for e in got) == pytest.approx(kruskal(m, np.round(core, 9)), abs=1e-6)
    assert rounds[0]["searched"] < 10 and sum(r["searched"] for r in rounds) < 2 * len(m)


def test_forest_ends_at_the_maximum_distance(spark):
    m = blobs(2)
    rows = N.vector_rows(frame(spark, m), "id", "embedding").selectExpr("id", "vec", "1L AS size")
    with_core, lists = H.reachable(rows)
    edges, _ = H.spanning_forest(with_core, lists, 0.05)
    d = 1 - unit(m) @ unit(m).T
    n = len(m)
    want = components(n, [(i, j) for i in range(n) for j in range(i) if d[i, j] <= 0.05])
    assert components(n, [(e.u, e.v) for e in edges.collect()]) == want


@pytest.mark.parametrize(("route", "s", "epsilon", "min_size", "min_samples"), [({}, 3, 0.15, 2, 1), (CELLS, 5, 0.02, 3, 3)])
def test_same_as_plain_hierarchy(spark, route, s, epsilon, min_size, min_samples):
    m = blobs(s)
    got = labels(C.density_hierarchy(frame(spark, m), epsilon, 0.15, min_size, min_samples, **route))
    want = dict(enumerate(density_hierarchy(m, epsilon, 0.15, min_size, min_samples)))
    assert got == want
    assert len(set(want.values()) - {-1}) > 2


def test_copies_are_rows_of_one_place(spark):
    m = blobs(6)
    m[40:52] = m[40]
    m[60:62] = m[3]
    got = labels(C.density_hierarchy(frame(spark, m), 0.05, 0.1, 3))
    assert got == dict(enumerate(density_hierarchy(m, 0.05, 0.1, 3)))


def test_clusters_born_above_the_cut_are_found(spark):
    """A loose group beside dense ones: the flat cut takes it for noise, the hierarchy doesn't."""
    rng = np.random.default_rng(7)
    base = np.eye(6)[:3]
    m = np.concatenate([base[k] + rng.normal(scale=s, size=(15, 6)) for k, s in enumerate((0.02, 0.02, 0.25))])
    flat = labels(C.density_cluster(frame(spark, m), 0.005, 0.0))
    full = labels(C.density_hierarchy(frame(spark, m), 0.0, 0.0, 8))
    assert sum(flat[i] == -1 for i in range(30, 45)) > 10
    assert len({full[i] for i in range(30, 45)} - {-1}) == 1 and sum(full[i] == -1 for i in range(30, 45)) < 5


def test_condensed_tree_in_many_rounds(spark):
    """Components beyond a task's edges go on as nodes of the next round; the result stays."""
    rng = np.random.default_rng(8)
    rows = spark.range(60).selectExpr("id", "1L AS size")
    tree = [(i, int(rng.integers(0, i)), float(round(rng.exponential() ** 2, 3)) + 0.001) for i in range(1, 60)]
    edges = spark.createDataFrame(tree, "u long, v long, w double")

    def run(most):
        tree, points = H.condensed_tree(rows, edges, 3, task_edges=most)
        table = sorted((round(r.birth, 9), r.size, round(r.stability, 3), r.own) for r in tree.collect())
        return table, partition({r.id: r.cluster for r in points.collect()})

    assert run(20) == run(1_000_000)


def test_climb_follows_deep_chains(spark):
    df = spark.range(500).selectExpr("id", "greatest(id - 1, 0) AS up")
    assert {r.top for r in H.climb(df).collect()} == {0}


def test_hierarchy_of_few_rows(spark):
    assert labels(C.density_hierarchy(frame(spark, np.array([[1.0, 0.0]])))) == {0: -1}
    two = frame(spark, np.array([[1.0, 0.0], [1.0, 0.001]]))
    assert labels(C.density_hierarchy(two)) == {0: -1, 1: -1}  # the only cluster is the root
