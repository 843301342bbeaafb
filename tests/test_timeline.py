import datetime as dt

import numpy as np
import pytest
from models import events, groups, leaders
from pyspark.sql import functions as F

from shutterlake.operators import bursts as B
from shutterlake.operators import timeline as T
from shutterlake.operators.ordering import exact_quantile, number_rows

START = dt.datetime(2024, 1, 1)
DDL = "media_id bigint, owner bigint, ts timestamp_ntz, gps struct<lat:double,lon:double>, phash bigint"


def library(s, n=260, step=3.0, undated=0.25):
    rng = np.random.default_rng(s)
    t, rows = 0.0, []
    for i in range(n):
        t += float(rng.choice([0.0, 0.5, 1.0, step, step, 7.0]))
        place = None if rng.random() < 0.4 else (40.0, -74.0 + 0.0009 * int(rng.integers(0, 3)))
        h = int(rng.choice([0, 0b111, 0b111111, 1 << 40, (1 << 40) | 0b11, -1]))
        when = None if rng.random() < undated else START + dt.timedelta(seconds=t)
        rows.append((int(i), int(rng.integers(0, 3)), when, place, h))
    return [rows[i] for i in rng.permutation(n)]


def micros(when):
    return None if when is None else round((when - START).total_seconds() * 1e6)


@pytest.mark.parametrize("s", range(3))
def test_group_similar_is_the_greedy_rule(spark, s):
    rows = library(s)
    df = spark.createDataFrame(rows, DDL).repartition(4)
    got = {}
    for r in B.group_similar(df).collect():
        got.setdefault(r["group_id"], set()).add(r["media_id"])
    plain = [(k, micros(t), g, h) for k, _, t, g, h in rows]
    assert got == groups(leaders(plain, 6, 3_000_000, 0.1))


def test_one_run_over_all_slices(spark):
    """Shooting without a pause: every slice depends on the one before."""
    rows = [(i, 0, START + dt.timedelta(seconds=1.3 * i), None, 1) for i in range(400)]
    df = spark.createDataFrame(rows, DDL).repartition(4)
    got = {}
    for r in B.group_similar(df).collect():
        got.setdefault(r["group_id"], set()).add(r["media_id"])
    plain = [(k, micros(t), g, h) for k, _, t, g, h in rows]
    assert got == groups(leaders(plain, 6, 3_000_000, 0.1))


def ball(n, bits, seed):
    """Distinct hashes within so many bits of one."""
    r = np.random.default_rng(seed)
    out = set()
    while len(out) < n:
        out |= {sum(1 << int(b) for b in r.choice(64, r.integers(0, bits + 1), replace=False)) for _ in range(n)}
    return np.array(sorted(out), np.uint64)[r.permutation(len(out))[:n]] ^ np.uint64(0x5A5A00FF12345678)


@pytest.mark.parametrize(("n", "bits", "visited", "block"), [(100_000, 4, 4096, 2048), (3000, 3, 40, 64)])
def test_a_ball_of_hashes_has_no_pair_list(spark, monkeypatch, n, bits, visited, block):
    """Near hashes at one place: the greedy rule, from blocks that return one row per hash."""
    monkeypatch.setattr(B, "VISITED", visited)
    monkeypatch.setattr(B, "HASH_BLOCK", block)
    h = ball(n, bits, 3)
    late = np.arange(n) >= 5  # a few dated leaders first
    rows = [(i, int(late[i]), int(x), None, None) for i, x in enumerate(h.view(np.int64))]
    df = spark.createDataFrame(rows, "pos bigint, late int, phash bigint, lat double, lon double").repartition(8)
    got = B.leaders_by_hash(df, 6, 0.1).collect()
    owner = dict((r.pos, r.leader) for r in got)
    assert len(got) == len(owner) == n
    free = np.ones(n, bool)
    for i in range(n):
        if free[i]:
            near = free & (np.bitwise_count(h ^ h[i]) < 6) & (np.arange(n) > i) & late
            near[i] = True
            assert all(owner[j] == i for j in np.flatnonzero(near))
            free &= ~near


def test_band_plan_keeps_all_distances():
    for n in (10, 10**6, 10**9, 10**12):
        bands, equal = B.band_plan(n, 6)
        assert bands - 5 == equal


@pytest.mark.parametrize("n", [1, 10**9])
def test_hamming_pairs_by_any_plan(spark, monkeypatch, n):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 40)
    hs = []
    for b in base:
        x = int(b)
        for _ in range(3):
            y = x
            for bit in rng.choice(63, int(rng.integers(0, 8)), replace=False):
                y ^= 1 << int(bit)
            hs.append(y)
    hs = sorted(set(hs))
    monkeypatch.setattr(B, "band_plan", lambda c, d, plan=B.band_plan: plan(n, d))
    df = spark.createDataFrame(
        [(i, h, None, None) for i, h in enumerate(hs)],
        "node bigint, phash bigint, lat double, lon double",
    )
    got = {(r["a"], r["b"]) for r in B.hamming_pairs(df, 6, 0.1).collect()}
    want = {
        (i, j)
        for i in range(len(hs))
        for j in range(i + 1, len(hs))
        if bin((hs[i] ^ hs[j]) & (2**64 - 1)).count("1") < 6
    }
    assert got == want


@pytest.mark.parametrize("s", range(2))
@pytest.mark.parametrize("owner", [None, "owner"])
def test_segment_events(spark, s, owner):
    rng = np.random.default_rng(s)
    t, rows = 0.0, []
    for i in range(300):
        t += float(rng.choice([60, 3600, 7200, 7201, 9000]))
        place = None if rng.random() < 0.6 else (40.0, -74.0 + 0.01 * int(rng.integers(0, 3)))
        # One owner holds most rows.
        rows.append((i, int(rng.choice([0, 0, 0, 1, 2])), START + dt.timedelta(seconds=t), place, 0))
    df = spark.createDataFrame(rows, DDL).repartition(4)
    got = {r["media_id"]: r["event_id"] for r in T.segment_events(df, partition_by=owner).collect()}
    want = {}
    for o in {r[1] for r in rows} if owner else {None}:
        mine = [(k, micros(x), g) for k, w, x, g, _ in rows if o is None or w == o]
        want.update(events(mine, 7_200_000_000, 1.0))
    assert got == want


def test_gap_of_exactly_two_hours_stays(spark):
    rows = [
        (0, 0, START, None, 0),
        (1, 0, START + dt.timedelta(hours=2), None, 0),
        (2, 0, START + dt.timedelta(hours=4, microseconds=1), None, 0),
    ]
    got = T.segment_events(spark.createDataFrame(rows, DDL)).orderBy("media_id").collect()
    assert [r["event_id"] for r in got] == [0, 0, 1]


def test_number_rows_with_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(99).alias("g"),
        F.pmod(F.xxhash64("id"), 1000).alias("o"),
        "id",
    )
    got = number_rows(df.repartition(5), ["g"], [F.col("o").asc(), F.col("id").asc()]).toPandas()
    got = got.sort_values(["g", "o", "id"])
    assert (got["rn"] == got.groupby("g").cumcount() + 1).all()


def test_exact_quantile_matches_numpy(spark):
    df = spark.range(999).select(
        (F.col("id") % 4).alias("g"), (F.pmod(F.xxhash64("id"), 1000) / 10).alias("v"), "id"
    )
    pdf = df.toPandas()
    got = {r["g"]: r["q"] for r in exact_quantile(df, ["g"], "v", 0.75, "q", "id").collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part["v"], 0.75))


def test_window_pairs_leave_in_order_of_time(spark):
    """Rows of one first file stand together, their partners by time, however the rows came."""
    start = dt.datetime(2024, 5, 1)
    rows = [(i, start + dt.timedelta(milliseconds=(i * 37) % 100 * 20)) for i in range(100)]
    df = spark.createDataFrame(rows, "media_id bigint, ts timestamp_ntz").repartition(5)
    got = [(r.first, r.gap_s) for r in B.window_pairs(df, 3).coalesce(1).collect()]
    firsts = [f for i, (f, _) in enumerate(got) if i == 0 or got[i - 1][0] != f]
    assert len(got) == 4950 and len(firsts) == len(set(firsts)) == 99
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:]) if a[0] == b[0])


def test_window_pairs_with_a_crowded_bucket(spark, monkeypatch):
    """All pairs inside the window, a third of the files within one second, dealt into parts."""
    monkeypatch.setattr(B, "WINDOW_BLOCK", 16)
    r = np.random.default_rng(2)
    t = np.concatenate([np.sort(r.integers(0, 200_000, 120)), 90_000 + r.integers(0, 1000, 60)]) * 1000
    rows = [(i, START + dt.timedelta(microseconds=int(x))) for i, x in enumerate(t)] + [(900, None)]
    df = spark.createDataFrame(rows, "media_id bigint, ts timestamp_ntz")
    got = sorted((x.first, x.second) for x in B.window_pairs(df, 3).select("first", "second").collect())
    order = sorted(range(len(t)), key=lambda i: (t[i], i))
    want = [(a, b) for n, a in enumerate(order) for b in order[n + 1 :] if t[b] - t[a] <= 3_000_000]
    assert got == sorted(want) and len(want) > 60 * 59 / 2
