import numpy as np
import pytest
from models import average_linkage, partition, unit, ward
from test_vectors import CELLS, frame, labels, sample

from shutterlake.operators import clustering as C
from shutterlake.operators import linkage as L


@pytest.mark.parametrize(("route", "task_rows"), [({}, 1024), (CELLS, 12)])
def test_ward_same_as_plain(spark, route, task_rows):
    m = sample(12, n=60, copies=8)
    got = labels(C.ward(frame(spark, m), 7, task_rows=task_rows, **route))
    assert partition(got) == partition(dict(enumerate(ward(m, 7))))


def test_ward_with_fewer_vectors_than_clusters(spark):
    m = np.array([[1.0, 0.0]] * 3 + [[0.0, 2.0]])
    assert partition(labels(C.ward(frame(spark, m), 80))) == partition({0: 0, 1: 0, 2: 0, 3: 1})


def test_average_linkage_in_small_blocks(spark, monkeypatch):
    """Blocks smaller than the clusters: more rounds, same labels, few searched again."""
    m = sample(13, n=80, copies=0)
    got = labels(C.average_linkage(frame(spark, m), 0.15, task_rows=16))
    assert partition(got) == partition(average_linkage(m, 0.15))


def test_merge_table(spark):
    m = sample(14, n=50, copies=0)
    df = frame(spark, m).selectExpr("id", "embedding AS total", "1L AS size")
    merges, rounds = L.agglomerate(df, "ward", task_rows=16)
    rows = merges.collect()
    assert len(rows) == 49 and len({r.source for r in rows}) == 49 and all(r.target < r.source for r in rows)
    total = ((m - m.mean(0)) ** 2).sum()
    assert sum(r.height for r in rows) == pytest.approx(total)
    assert rounds[0]["searched"] == 50 and rounds[-1]["searched"] == 0 and sum(r["merged"] for r in rounds) == 49


def test_a_long_chain_ends_in_few_rounds(spark):
    """Ten thousand vectors, each nearest to the one before it, so that single merges would take as many rounds."""
    n = 10_000
    angle = np.cumsum(1e-4 * (1 + np.arange(n) / n))
    m = np.stack([np.cos(angle), np.sin(angle)], 1)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(m)], "id long, total array<double>, size long")
    merges, rounds = L.agglomerate(df, "average", 1e-6)
    assert len(rounds) < 40
    sums, size = m.copy(), np.ones(n)
    for r in merges.collect():
        size[r.target] += size[r.source]
        size[r.source] = 0
        assert r.height <= 1e-6 + 1e-12
    # Nothing is left to merge: the rest lies in order on the circle, so neighbours are next to each other.
    rep = np.arange(n)
    for r in merges.collect():
        rep[r.source] = r.target
    while (rep[rep] != rep).any():
        rep = rep[rep]
    means = np.array([unit(m)[rep == c].mean(0) for c in np.unique(rep)])
    assert (1 - (means[:-1] * means[1:]).sum(1) > 1e-6 - 1e-12).all()
    assert sum(r["searched"] for r in rounds[1:]) < n * (len(rounds) - 1) and size.sum() == n


def test_rounds_join_without_broadcasts(spark, monkeypatch):
    """Tables as long as the clusters are shuffled; only the sizes of cells, a row for a region, are broadcast."""
    plans, write = [], L.materialize

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(L, "materialize", noted)
    m = unit(np.random.default_rng(8).normal(size=(60, 6)))
    rows = [(i, list(map(float, v)), 1) for i, v in enumerate(m)]
    merges, rounds = L.agglomerate(spark.createDataFrame(rows, "id bigint, total array<double>, size bigint"), "ward", task_rows=16)
    assert merges.count() == 59 and len(rounds) > 1
    assert sum(p.count("SortMergeJoin") for p in plans) > len(rounds)
    assert sum(p.count("BroadcastHashJoin") for p in plans) <= len(rounds)


@pytest.mark.parametrize(("linkage", "cut"), [("ward", None), ("average", 0.7)])
def test_few_clusters_are_searched_again(spark, linkage, cut):
    """Merged clusters keep the partners of their parts; nearly all were searched again in each round when they didn't."""
    m = unit(np.random.default_rng(5).normal(size=(300, 16)))
    rows = [(i, list(map(float, v)), 1) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id bigint, total array<double>, size bigint")
    merges, rounds = L.agglomerate(df, linkage, cut, task_rows=100)
    again = [r for r in rounds[1:] if r["searched"]]
    assert again and sum(r["searched"] for r in again) < 0.5 * sum(r["clusters"] for r in again)
    got = sorted(r.height for r in merges.collect())
    whole = sorted(x for _, _, x in L.kernels.agglomerate_all(m, np.ones(300), linkage, np.inf if cut is None else cut))
    assert got == pytest.approx(whole)


@pytest.mark.parametrize("linkage", ["ward", "average"])
def test_merges_without_a_matrix(linkage):
    """The same merges as with one, many equal distances included, and one that rounding sees differently from each side."""
    rng = np.random.default_rng(6)
    m = np.r_[unit(rng.normal(size=(120, 5))), unit(rng.integers(1, 3, size=(40, 5)).astype(float))]
    size = rng.integers(1, 4, len(m))
    same = {"size": size}
    costs = L.kernels.ward_costs(same, m, same, m) if linkage == "ward" else L.kernels.distances(m, m, "cosine")
    want = L.kernels.agglomerate(costs, size, np.full(len(m), np.inf), linkage, 0.4)
    got = L.kernels.agglomerate_all(m, size, linkage, 0.4)
    assert sorted(x for _, _, x in got) == pytest.approx(sorted(x for _, _, x in want), abs=1e-9)
    assert len({a for a, _, _ in got}) == len(got) and all(a > b for a, b, _ in got)
