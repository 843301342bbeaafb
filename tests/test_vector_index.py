import math

import numpy as np
import pytest
from models import unit
from pyspark.sql import functions as F
from test_vectors import frame, sample

from shutterlake.operators import lsh as LSH
from shutterlake.operators import neighbors as N
from shutterlake.operators import vector_index as VI


def groups(n=600, dim=16, seed=0):
    """Tight groups far from each other, so that cells can be told apart."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return centres[rng.integers(0, 12, n)] + rng.normal(scale=0.05, size=(n, dim))


def asked(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, vec array<double>")


def plain_search(m, ids, q, k):
    s = unit(q) @ unit(m).T
    out = []
    for i in range(len(q)):
        order = sorted(range(len(m)), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out.append([ids[j] for j in order])
    return out


def found(spark, path, q, k, **options):
    out = {}
    for r in VI.search_index(spark, path, asked(spark, q), k, **options).collect():
        out.setdefault(r.query_id, {})[r.rank] = (r.id, r.similarity)
    return [[out[i][n + 1][0] for n in range(len(out[i]))] for i in range(len(q))]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    m = groups()
    VI.write_index(frame(spark, m), path, cell_rows=40)
    return path, m


@pytest.mark.parametrize("k", [1, 15])
def test_search_equals_the_scan_and_opens_fewer_files(spark, stored, k):
    path, m = stored
    q = m[[3, 77, 300]] + 0.01
    assert found(spark, path, q, k) == plain_search(m, list(range(len(m))), q, k)
    opened, of = VI.files_opened(spark, path, asked(spark, q), k)
    assert 0 < opened < of / 2


def test_many_queries_take_the_shuffled_route(spark, stored, monkeypatch):
    path, m = stored
    monkeypatch.setattr(N, "fits_broadcast", lambda *a: False)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    q = groups(40, seed=0) + 0.02
    assert found(spark, path, q, 5) == plain_search(m, list(range(len(m))), q, 5)


def test_rows_are_added_without_a_rebuild(spark, tmp_path):
    """Rows beyond every reach known so far, and copies in one cell, are found after an append; old files stay."""
    path = str(tmp_path / "i")
    m = groups(200)
    VI.write_index(frame(spark, m), path, cell_rows=20)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "i" / "rows").rglob("*.parquet")}
    more = np.concatenate([groups(50, seed=9), np.repeat(m[:1], 30, axis=0)])
    rows = [(1000 + i, [float(x) for x in v]) for i, v in enumerate(more)]
    VI.add_rows(spark.createDataFrame([*rows, (5000, None), (5001, [0.0] * 16)], "id bigint, embedding array<double>"), path)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    both, ids = np.concatenate([m, more]), [*range(200), *range(1000, 1080)]
    q = np.concatenate([more[[4, 9]], m[[0, 50]], -m[:1]])
    assert found(spark, path, q, 12) == plain_search(both, ids, q, 12)
    assert VI.search_index(spark, path, asked(spark, q), 1000).count() == 280 * len(q)


def test_tests_on_carried_columns_come_before_ranking(spark, tmp_path):
    path = str(tmp_path / "i")
    m = groups(150)
    df = frame(spark, m).withColumn("species", F.when(F.col("id") % 3 == 0, "dog").otherwise("cat"))
    VI.write_index(df, path, carry=["species"], cell_rows=20)
    dogs = [i for i in range(150) if i % 3 == 0]
    q = m[[1, 2]]
    assert found(spark, path, q, 8, keep=F.col("species") == "dog") == plain_search(m[dogs], dogs, q, 8)


def test_index_without_rows(spark, tmp_path):
    path = str(tmp_path / "i")
    VI.write_index(spark.createDataFrame([], "id bigint, embedding array<double>"), path)
    assert VI.search_index(spark, path, asked(spark, groups(2)), 3).isEmpty()
    with pytest.raises(ValueError):
        VI.add_rows(frame(spark, groups(2)), path)


@pytest.mark.parametrize("limit", [0.05, 0.3])
def test_keys_reach_the_recall(limit):
    bits, tables = LSH.choose_keys(1_000_000, limit, 0.95)
    hit = LSH.bit_agreement(limit) ** bits
    assert bits > 3 and tables <= LSH.MAX_TABLES and 1 - (1 - hit) ** tables >= 0.95
    # Bits agree as often as the angle says.
    a = np.random.default_rng(1).normal(size=(4000, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = np.random.default_rng(2).normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = (1 - limit) * a + math.sqrt(1 - (1 - limit) ** 2) * side
    same = (LSH.hash_keys(a, 1, 40) == LSH.hash_keys(b, 1, 40)).mean()
    assert abs(same - LSH.bit_agreement(limit)) < 0.01


@pytest.mark.parametrize("block_rows", [8, 2048])
def test_approximate_pairs_are_right_and_nearly_all(spark, block_rows):
    m = sample(3, n=200, copies=30, dim=16)
    r = N.vector_rows(frame(spark, m), "id", "embedding")
    got = LSH.approximate_pairs(r, 0.1, recall=0.97, bits=6, block_rows=block_rows).collect()
    d = 1 - unit(m) @ unit(m).T
    want = {(i, j) for j in range(len(m)) for i in range(j) if d[i, j] <= 0.1}
    pairs = [(p.src, p.dst) for p in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want
    assert len(pairs) >= 0.9 * len(want) and len(want) > 400
    assert all(abs(p.distance - d[p.src, p.dst]) < 1e-9 for p in got)
    assert LSH.approximate_pairs(r.limit(0), 0.1).isEmpty()
