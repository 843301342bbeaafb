import numpy as np
import pytest
from models import average_linkage, components, dbscan, partition, seed, unit
from pyspark.sql import functions as F

from shutterlake.operators import clustering as C
from shutterlake.operators import neighbors as N
from shutterlake.operators import vectors as X
from shutterlake.operators.graph import connected_components

CELLS = {"broadcast_bytes": 0, "block_rows": 16}
ROUTES = [{}, CELLS]


def sample(seed_, n=90, copies=20, dim=8):
    """Loose blobs plus many exact copies of one vector."""
    rng = np.random.default_rng(seed_)
    centres = rng.normal(size=(6, dim))
    m = centres[rng.integers(0, 6, n)] + rng.normal(scale=0.45, size=(n, dim))
    m[n - copies :] = m[0]
    return m.astype(np.float32).astype(float)


def frame(spark, m, **extra):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(3)


def labels(df):
    return {r["id"]: r["cluster_id"] for r in df.collect()}


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize("s", [1])
def test_knn_is_exact(spark, s, route):
    m = sample(s)
    r = N.vector_rows(frame(spark, m), "id", "embedding")
    got = {}
    for row in N.knn_join(r, r, 7, **route).collect():
        got.setdefault(row["id"], []).append((row["rank"], row["distance"]))
    d = 1 - unit(m) @ unit(m).T
    for i in range(len(m)):
        mine = [v for _, v in sorted(got[i])]
        assert np.allclose(mine, np.sort(d[i])[:7], atol=1e-9)


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize("metric,cut", [("cosine", 0.1), ("euclidean", 1.0)])
def test_similar_pairs(spark, route, metric, cut):
    m = sample(3)
    r = N.vector_rows(frame(spark, m), "id", "embedding")
    got = {(p["src"], p["dst"]) for p in N.similar_pairs(r, cut, metric=metric, **route).collect()}
    if metric == "cosine":
        d = 1 - unit(m) @ unit(m).T
    else:
        d = np.linalg.norm(m[:, None] - m[None], axis=2)
    n = len(m)
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= cut}


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize("k", [2, 5, 50])
def test_seed_clusters_with_copies(spark, route, k):
    m = sample(4)
    got = labels(C.seed_clusters(frame(spark, m), k, 0.08, **route))
    want = seed(m, k, 0.08)
    sizes = {c: want.count(c) for c in want}
    assert partition(got) == partition({i: c if sizes[c] > 1 else None for i, c in enumerate(want)})


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize("min_samples", [2, 4])
def test_dbscan(spark, route, min_samples):
    m = sample(5)
    got = labels(C.dbscan(frame(spark, m), 0.06, min_samples, **route))
    want = dbscan(m, 0.06, min_samples)
    if min_samples == 2:
        assert partition(got, {-1}) == partition(want, {-1})
    else:
        assert got == want


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize("s", [6])
def test_average_linkage(spark, route, s):
    m = sample(s, n=60, copies=10)
    got = labels(C.average_linkage(frame(spark, m), 0.15, **route))
    assert partition(got) == partition(average_linkage(m, 0.15))


@pytest.mark.parametrize("route", ROUTES)
def test_density_cluster(spark, route):
    m = sample(8)
    got = labels(C.density_cluster(frame(spark, m), 0.04, 0.2, **route))
    d = 1 - unit(m) @ unit(m).T
    n = len(m)
    comp = components(n, [(i, j) for i in range(n) for j in range(n) if i != j and d[i, j] <= 0.04])
    big = sorted({c for c in comp if comp.count(c) >= 2})
    cents = unit(np.array([m[[i for i in range(n) if comp[i] == c]].mean(0) for c in big]))
    want = {}
    for i in range(n):
        if comp[i] in big:
            want[i] = big.index(comp[i])
        else:
            far = 1 - unit(m[i : i + 1]) @ cents.T
            want[i] = int(far.argmin()) if far.min() < 0.2 else -1
    assert got == want


def test_multipass_merge_against_model(spark):
    m = sample(9, n=80, copies=0)
    start = {i: i % 16 for i in range(80)}
    df = frame(spark, m).withColumn("cluster_id", F.col("id") % 16)
    got = labels(C.merge_multipass(df, 0.6, tight=0.5, tight_slack=0.1, cap=40))
    now = dict(start)
    for _ in range(10):
        ids = sorted(set(now.values()))
        mem = {c: [i for i in now if now[i] == c] for c in ids}
        cent = {c: unit(m[mem[c]].mean(0, keepdims=True))[0] for c in ids}
        u = unit(m)

        def cohesion(c):
            s = u[mem[c]] @ u[mem[c]].T
            n = len(mem[c])
            return (s.sum() - np.trace(s)) / (n * (n - 1)) if n > 1 else 1.0

        tight = {c: cohesion(c) >= 0.5 and len(mem[c]) >= 2 for c in ids}
        pairs = []
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                s = cent[a] @ cent[b]
                fits = len(mem[a]) + len(mem[b]) <= 40
                if fits and (s >= 0.6 or (tight[a] and tight[b] and s >= 0.5)):
                    pairs.append((x, ids.index(b)))
        if not pairs:
            break
        comp = components(len(ids), pairs)
        now = {i: ids[comp[ids.index(c)]] for i, c in now.items()}
    assert got == now


@pytest.mark.parametrize("s", range(2))
def test_components_any_order(spark, s):
    rng = np.random.default_rng(s)
    n = 120
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (90, 2))] + [(i, i + 1) for i in range(20)]
    v = spark.range(n).select("id")
    e = spark.createDataFrame(edges, "src bigint, dst bigint").repartition(1 + s)
    got = {r["id"]: r["component"] for r in connected_components(v, e).collect()}
    assert [got[i] for i in range(n)] == components(n, edges)


def test_components_with_a_hub_and_the_hot_route(spark, monkeypatch):
    from shutterlake.operators import skew

    monkeypatch.setattr(skew, "SMALL", 10)
    edges = [(500, i) for i in range(300)] + [(i, i + 1) for i in range(600, 640)]
    v = spark.range(700).select("id")
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r["id"]: r["component"] for r in connected_components(v, e).collect()}
    assert [got[i] for i in range(700)] == components(700, edges)


def test_cohesion_of_singletons_and_zero_vectors(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 0.0]), (2, [0.0, 1.0])],
        "cluster_id bigint, embedding array<double>",
    )
    s = {r["cluster_id"]: r for r in X.cluster_statistics(df).collect()}
    assert s[1]["cohesion"] == 1.0 and s[1]["tight"]
    assert s[2]["cohesion"] == pytest.approx(0.0, abs=1e-12) and s[2]["size"] == 3


def test_noise_assignment_leaves_clustered_rows(spark):
    m = sample(10)
    df = frame(spark, m).withColumn("cluster_id", F.when(F.col("id") < 40, F.col("id") % 3))
    before = {r["id"]: r["cluster_id"] for r in df.collect()}
    after = labels(C.assign_noise(df, 0.9))
    assert all(after[i] == c for i, c in before.items() if c is not None)


def test_bisecting_and_projection(spark):
    m = sample(11, copies=0)
    df = frame(spark, m)
    assert len(set(labels(C.bisecting(df, 7)).values())) == 7
    xy = np.array([(r["x"], r["y"]) for r in C.project_2d(df).orderBy("id").collect()])
    c = m - m.mean(0)
    top = np.linalg.svd(c, compute_uv=False)[:2] ** 2 / len(m)
    assert np.allclose(np.sort(xy.var(0))[::-1], top, rtol=1e-6)
