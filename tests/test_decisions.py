"""Cases in which several rows speak about one thing: decisions, changes, late rows."""

from datetime import datetime

from pyspark.sql import functions as F

from shutterlake.operators import ingest as I
from shutterlake.operators import review as R
from shutterlake.plans.face_run import cluster_faces
from shutterlake.sources import listing
from shutterlake.streaming import streams as Z

FACES = "id bigint, cluster_id bigint"
SUGGESTIONS = "id bigint, face_id bigint, suggested_cluster_id bigint"
DECISIONS = "suggestion_id bigint, action string, reviewed_at timestamp, create_new boolean"


def at(hour, minute=0):
    return datetime(2024, 1, 1, hour, minute)


def tables(spark):
    faces = spark.createDataFrame([(1, None), (2, None), (3, None), (4, 9), (5, None)], FACES)
    suggested = spark.createDataFrame([(11, 1, 77), (12, 2, 77), (13, 3, 78), (14, 4, 78), (15, 5, 79), (16, 1, 80)], SUGGESTIONS)
    decided = [
        (11, "accept", at(1), False), (11, "skip", at(2), False),
        (12, "reject", at(1), True), (12, "skip", at(2), False),
        (13, "accept", at(1), False), (13, "reject", at(2), True),
        (14, "reject", at(1), True),
        (15, "reject", at(1), True), (15, "accept", at(2), False),
    ]
    return faces, suggested, spark.createDataFrame(decided, DECISIONS)


def test_an_accept_is_not_undone(spark):
    faces, suggested, decided = tables(spark)
    got = {r.id: r.cluster_id for r in R.accept_suggestions(faces, suggested, decided).collect()}
    assert got == {1: 77, 2: None, 3: 78, 4: 9, 5: 79}
    status = {r.id: r.status for r in R.decide_suggestions(suggested.withColumns({"status": F.lit("pending"), "reviewed_at": F.lit(None).cast("timestamp")}), decided).collect()}
    assert status[11] == "skipped" and status[13] == "rejected" and status[16] == "pending"


def test_first_rejection_of_a_noise_face_opens_a_cluster(spark):
    faces, suggested, decided = tables(spark)
    clusters = spark.createDataFrame([(77,), (100,)], "id bigint")
    moved, made = R.reject_into_new_clusters(faces, clusters, suggested, decided)
    assert {r.id: r.cluster_id for r in moved.collect()} == {1: None, 2: 101, 3: None, 4: 9, 5: 102}
    assert sorted(map(tuple, made.collect())) == [(101, None), (102, None)]
    both = R.accept_suggestions(moved, suggested, decided)
    assert {r.id: r.cluster_id for r in both.collect()} == {1: 77, 2: 101, 3: 78, 4: 9, 5: 79}


def test_several_changes_of_one_row(spark):
    clusters = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id bigint, display_name string, description string")
    changes = spark.createDataFrame(
        [(1, "n1", None, 1), (1, None, "d2", 2), (1, "n0", None, 0), (3, "no", "no", 1)],
        "id bigint, display_name string, description string, at int",
    )
    got = R.update_fields(clusters, changes, time="at")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "n1", "d2"), (2, "b", None)]


def test_upsert_of_two_new_rows(spark):
    old = spark.createDataFrame([("/a", 1, 0), ("/b", 2, 0)], "path string, size int, at int")
    new = spark.createDataFrame([("/a", 5, 1), ("/a", 3, 2), ("/c", 4, 1)], "path string, size int, at int")
    got = I.upsert(old, new, order="at").select("path", "size")
    assert sorted(map(tuple, got.collect())) == [("/a", 3), ("/b", 2), ("/c", 4)]


def test_faces_without_a_vector_stay_in_the_run(spark):
    rows = [(i, [1.0, 0.01 * i, 0.0]) for i in range(6)] + [(6, None), (7, [0.0, 0.0, 0.0])]
    run = cluster_faces(spark.createDataFrame(rows, "id bigint, embedding array<double>"))
    got = {r.id: r.cluster_id for r in run.faces.select("id", "cluster_id").collect()}
    assert sorted(got) == list(range(8)) and got[6] is None and got[7] is None


def test_content_is_hashed_in_chunks(spark, tmp_path):
    import hashlib

    files = {"a.bin": b"x" * 1000, "b c.bin": b"y", "d.bin": bytes(range(256)) * 10}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    for chunk in (7, 1 << 16):
        got = listing.hashed_content(spark, str(tmp_path), chunk).collect()
        assert sorted(r.sha256 for r in got) == sorted(hashlib.sha256(v).hexdigest() for v in files.values())


def test_late_batches_join_their_event(spark, tmp_path):
    """12:00 and 13:40, then 12:10, then 14:30: one event of four photos."""
    source = tmp_path / "in"
    source.mkdir()
    batches = [[at(12), at(13, 40)], [at(12, 10)], [at(14, 30)], [at(23)]]
    schema = "owner bigint, ts timestamp, lat double, lon double"
    stream = Z.event_stream(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), "owner", delay="3 hours"
    )
    for times in batches:
        spark.createDataFrame([(1, t, None, None) for t in times], schema).coalesce(1).write.mode("append").parquet(str(source))
        got = Z.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    rows = [(r.first_ts, r.last_ts, r.num_photos) for r in got.collect()]
    assert rows == [(at(12), at(14, 30), 4)]


def test_event_stream_of_many_owners_in_few_states(spark, tmp_path, monkeypatch):
    """Owners share states, one row may fill an element, and rows without an owner are one owner; each keeps its own events."""
    monkeypatch.setattr(Z, "WAITING_ROWS", 2)
    schema = "owner bigint, ts timestamp, lat double, lon double"
    source = str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(source)
    stream = Z.event_stream(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "owner", delay="1 hour", ranges=2
    )
    owners = [*range(-3, 9), None]
    batches = [
        [(o, at(1 + i % 3), 40.0, -74.0) for i, o in enumerate(owners)] + [(o, at(1 + i % 3, 30), None, -74.0) for i, o in enumerate(owners)],
        [(o, at(4 + i % 3), 41.0 if i % 2 else 40.0, -74.0) for i, o in enumerate(owners)],
        [(o, at(4 + i % 3, 10), 40.0, -74.0) for i, o in enumerate(owners) if i % 2 == 0],
        [(99, at(23), None, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    got = sorted(((r.owner if r.owner is not None else -99), r.event_id, r.first_ts, r.num_photos) for r in Z.drain(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect())
    want = []
    for i, o in enumerate(owners):
        want += [(-99 if o is None else o, 0, at(1 + i % 3), 2), (-99 if o is None else o, 1, at(4 + i % 3), 1 if i % 2 else 2)]
    assert got == sorted(want)


def test_event_stream_over_many_triggers(spark, tmp_path):
    """Fifteen triggers of shuffled rows: the events of the batch operator, save what the watermark has not closed."""
    import datetime as dt

    import numpy as np
    from models import events

    r = np.random.default_rng(5)
    start = dt.datetime(2024, 3, 1)
    rows, t = [], {0: 0.0, 1: 0.0}
    for i in range(240):
        owner = int(r.integers(0, 2))
        t[owner] += float(r.choice([60, 600, 3600, 9000]))
        place = None if r.random() < 0.3 else (40.0 + 0.05 * int(r.integers(0, 2)), -74.0)
        rows.append((owner, start + dt.timedelta(seconds=t[owner]), *(place or (None, None))))
    rows.sort(key=lambda x: x[1])
    schema = "owner bigint, ts timestamp, lat double, lon double"
    source = str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(source)
    stream = Z.event_stream(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "owner", delay="5 hours"
    )
    for k in range(0, 240, 16):  # rows of a batch in any order, and some rows a batch late
        part = rows[k : k + 16]
        spark.createDataFrame([part[i] for i in r.permutation(len(part))], schema).coalesce(1).write.mode("append").parquet(source)
    got = Z.drain(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    for owner in (0, 1):
        own = [(i, round((x[1] - start).total_seconds() * 1e6), None if x[2] is None else x[2:]) for i, x in enumerate(rows) if x[0] == owner]
        number = events(own, 7200 * 10**6, 1.0)
        want = {}
        for i, us, _ in own:
            want.setdefault(number[i], []).append(us)
        mine = {e.event_id: (e.num_photos, e.first_ts, e.last_ts) for e in got if e.owner == owner}
        assert len(mine) > 10
        for k, (n, first, last) in mine.items():
            assert (n, first, last) == (
                len(want[k]), start + dt.timedelta(microseconds=want[k][0]), start + dt.timedelta(microseconds=want[k][-1])
            )
        assert set(mine) >= set(range(max(mine)))
