"""Tables of many files, and work that grows no faster than its input."""

import numpy as np
from pyspark.sql import functions as F

from shutterlake.catalog import registry
from shutterlake.operators import neighbors as N
from shutterlake.operators import search as Q

SF = "/root/testdata/sf0.001"


def _in_folders(spark, target, names, files=3):
    """Copies of tables of sf0.001, each a folder of several files."""
    for name in names:
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(files).write.parquet(f"{target}/{name}.parquet")
    return str(target)


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_streams_read_tables_in_folders(spark, tmp_path):
    d = _in_folders(spark, tmp_path / "in", ["embeddings", "events"])
    queries = registry()[0]
    for name in ("k4_assign_stream", "k2_session_stream"):
        whole = _rows(queries[name](spark, SF))
        assert whole and _rows(queries[name](spark, d)) == whole


def test_overfetched_rows_are_ranked_over_all_batches(spark):
    """Each task scans its part of the index and keeps its own best; the filter sees the best of all parts."""
    m, rows = _vectors(spark, 400)
    wanted = rows.where("id < 3")
    index = rows.repartition(6)
    got = [(r.query_id, r.id) for r in Q.search(index, wanted, 5, keep=F.col("id") % 4 == 0, overfetch=3).collect()]
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-unit[:3] @ unit.T, axis=1)[:, :15]
    want = [(q, int(i)) for q in range(3) for i in [i for i in best[q] if i % 4 == 0][:5]]
    assert len(got) < 15 and sorted(got) == sorted(want)


def _vectors(spark, n, dim=8, seed=3):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vec array<double>")


def test_cells_move_rows_by_tile_not_by_block(spark):
    """Links of a graph in which all hangs together: one set per tile pair, however small the blocks."""
    m, rows = _vectors(spark, 1500)
    links = N.component_edges(rows, 1.2, broadcast_bytes=0, block_rows=16).collect()
    assert len(links) < 20 * len(m)  # 140 a row when each two blocks of 16 met in a task of their own
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = 1 - unit @ unit.T <= 0.1
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b}
    got = [(r.src, r.dst) for r in N.similar_pairs(rows, 0.1, broadcast_bytes=0, block_rows=16).collect()]
    assert len(got) == len(want) and set(got) == want


def test_small_cells_share_tiles_and_large_ones_are_cut():
    first, parts, held = N._tiles({0: 3, 1: 4, 2: 30, 3: 5, 4: 6}, 5, 10)
    assert [h.tolist() for h in held] == [[0, 1], [2], [2], [2], [3], [4]]
    assert first.tolist() == [0, 0, 1, 4, 5] and parts.tolist() == [1, 1, 3, 1, 1]


def test_broadcast_side_stays_small():
    """The driver and every Python worker hold a broadcast side whole."""
    assert N.BROADCAST_BYTES <= 4 * 1024 * 1024 and N.kernels.CHUNK <= 2_000_000


def test_signature_aggregates_by_document_alone(spark):
    """No shuffle by (document, bucket), after which every task held 64 columns of nearly every document."""
    from shutterlake.catalog.core import signature

    plan = signature(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_bursts_in_slices_of_bounded_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from shutterlake.operators import bursts as B

    # A run without a pause, so that every slice starts with open leaders.
    rows = spark.range(300).select(
        F.col("id").alias("media_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 5 > 0, F.struct((F.col("id") % 5).cast("double").alias("lat"), F.lit(0.0).alias("lon"))).alias("gps"),
        F.col("id").alias("phash"),
    )
    whole = _rows(B.group_similar(rows, window_s=7))
    monkeypatch.setattr(B, "SLICE_ROWS", 40)
    cut, made = B.sorted_slices, []
    monkeypatch.setattr(B, "sorted_slices", lambda *a: made.append(cut(*a)) or made[-1])
    assert _rows(B.group_similar(rows, window_s=7)) == whole and len(whole) > 100
    sizes = [r["count"] for r in made[0].groupBy(B.SLICE).count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 80


def test_slices_of_a_timeline_without_pauses_are_bounded(spark, monkeypatch):
    """A change may pass through all slices, one a round; their rows come as a stream, with the open leaders alone beside."""
    from shutterlake.operators import bursts as B

    rng = np.random.default_rng(4)
    t = np.sort(rng.integers(0, 4_000_000_000, 4000))
    place = [None if i % 5 else (40.0 + i % 3, 1.0) for i in range(4000)]
    rows = [(i, int(x), *(p or (None, None))) for i, (x, p) in enumerate(zip(t, place))]
    dated = spark.createDataFrame(rows, "key bigint, t bigint, lat double, lon double")
    whole = _rows(B._dated_leaders(dated, 30_000_000, 0.1))
    cut, made = B.sorted_slices, []
    monkeypatch.setattr(B, "sorted_slices", lambda *a: made.append(cut(*a)) or made[-1])
    monkeypatch.setattr(B, "SLICE_ROWS", 20)
    monkeypatch.setattr(B, "SLICES", 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert _rows(B._dated_leaders(dated, 30_000_000, 0.1)) == whole and len(whole) > 3900
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 4 < made[0].select(B.SLICE).distinct().count() <= 6
    # The rule, row by row.
    open_, want = [], []
    for i, x, lat, lon in rows:
        open_ = [o for o in open_ if x - o[1] <= 30_000_000]
        found = next((o for o in open_ if lat is None or o[2] is None or o[2] == lat), None)
        if found is None:
            found = (i, x, lat)
            open_.append(found)
        want.append((i, found[0]))
    near = B._dated_leaders(dated, 30_000_000, 0.1).select("key", "leader").collect()
    assert all(dict(want)[r.key] == r.leader for r in near)


def test_approximate_join_sends_short_codes(spark):
    """Copies of a row carry a byte a table, not eight."""
    from shutterlake.operators import lsh as LSH

    _, rows = _vectors(spark, 40)
    sent = LSH._keyed(rows, 6, 10, LSH.SEED).select("keys", "codes").collect()
    assert all(len(r.codes) == 10 and list(r.codes) == [k // 10 for k in r["keys"]] for r in sent)
