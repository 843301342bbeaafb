import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import media as M
from shutterlake.functions import paths as P
from shutterlake.operators import dedup as D
from shutterlake.operators import ingest as I
from shutterlake.operators import search as Q
from shutterlake.operators import skew
from shutterlake.plans.library_run import run_library
from shutterlake.sources import listing as L
from shutterlake.sources import reports as O
from shutterlake.streaming import streams as Z


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head()["x"]


@pytest.fixture
def tree(tmp_path):
    for rel, body in {
        "2023/01-January/a.JPG": b"one",
        "2023/01-January/Unknown/b.jpg": b"one",
        "2023/01-January/Unknown/c.mp4": b"two",
        "skip/d.png": b"three",
        "notes.txt": b"four",
    }.items():
        f = tmp_path / "lib" / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(body)
    return str(tmp_path / "lib")


def test_listing_reads_no_content(spark, tree):
    files = L.file_listing(spark, tree)
    assert "content:binary" not in files._jdf.queryExecution().executedPlan().toString()
    names = {r["path"].rsplit("/", 1)[1] for r in L.media_listing(spark, tree).collect()}
    assert names == {"a.JPG", "b.jpg", "c.mp4", "d.png"}
    root = "file:" + tree
    kept = L.media_listing(spark, tree, skip_prefixes=[root + "/skip"], excluded_parts=["Unknown"])
    assert [r["path"].rsplit("/", 1)[1] for r in kept.collect()] == ["a.JPG"]
    months = L.month_folders(files, root).collect()
    assert [(m["year"], m["month"]) for m in months] == [("2023", "01-January")]
    assert L.unknown_folders(files).count() == 1


def test_hashes(spark, tree):
    rows = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in L.hashed_content(spark, tree, 4).collect()}
    assert rows["a.JPG"] == rows["b.jpg"] != rows["c.mp4"]
    assert rows["d.png"] is not None and len(rows) == 5


@pytest.mark.parametrize(
    "name,want",
    [
        ("IMG-DESKTOP-1.jpg", True),
        ("IMG-1.jpg", False),
        ("a-b-c.jpg", False),
        ("x (Conflicted Copy 2023).jpg", True),
        ("x (1).jpg", True),
        ("x (one).jpg", False),
        ("x (2)", True),
        ("plain.jpg", False),
    ],
)
def test_sync_conflicts(spark, name, want):
    assert one(spark, P.is_sync_conflict(F.lit("/d/" + name))) is want


@pytest.mark.parametrize(
    "name,want", [("a.tar.GZ", ".gz"), ("none", ""), (".hidden", ""), ("x.", ""), ("a.b/c", "")]
)
def test_extension(spark, name, want):
    assert one(spark, P.extension(F.lit("/d/" + name))) == want


def test_target_folder(spark):
    ts = F.lit("2023-07-04 10:00:00").cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    place = F.lit("São Paulo!, Brazil")
    size = F.lit(7 * 1024 * 1024)
    assert one(spark, P.target_folder(ts, place, size, none)) == "2023/07-July/São Paulo"
    assert one(spark, P.target_folder(ts, F.lit("!!"), size, none)) == "2023/07-July"
    got = one(spark, P.target_folder(none, F.lit(None).cast("string"), size, ts))
    assert got == "Unknown_Metadata/3-Large_5-15MB/2023/07-July"
    got = one(spark, P.target_folder(none, F.lit(None).cast("string"), F.lit(None).cast("long"), none))
    assert got == "Unknown_Metadata/0-Unknown_Size/Unknown_Date/Unknown_Date"


def test_coordinates_key_is_short(spark):
    assert one(spark, M.location_key(F.lit(40.0), F.lit(-73.98765))) == "40.0,-73.988"


def test_keep_best_order_and_null_hash(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("/a/long.jpg", "h", 10, 1, t),
        ("/a/s.jpg", "h", 10, 1, t),
        ("/a/old.jpg", "h", 10, 1, t - dt.timedelta(days=1)),
        ("/a/big.jpg", "h", 20, 1, t),
        ("/n/1.jpg", None, 1, 1, t),
        ("/n/2.jpg", None, 1, 1, t),
    ]
    df = spark.createDataFrame(
        rows, "path string, sha256 string, resolution bigint, size_bytes bigint, mtime timestamp_ntz"
    )
    got = D.keep_best(df).collect()
    assert {r["keep"] for r in got} == {"/a/big.jpg"} and len(got) == 3
    left = D.keep_best(df.where("path <> '/a/big.jpg'")).collect()
    assert {r["keep"] for r in left} == {"/a/old.jpg"}
    tie = D.keep_best(df.where("path in ('/a/long.jpg', '/a/s.jpg')")).collect()
    assert [r["keep"] for r in tie] == ["/a/s.jpg"]


def test_keep_best_when_one_hash_holds_a_third(spark):
    df = spark.range(6000).select(
        F.concat(F.lit("/p/"), F.lpad("id", 6, "0")).alias("path"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") / 4).cast("int").cast("string")).alias("sha256"),
        F.lit(1).cast("long").alias("resolution"),
        F.lit(1).cast("long").alias("size_bytes"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("mtime"),
    )
    plan = D.keep_best(df)
    n_hashes = df.select("sha256").distinct().count()
    assert plan.count() == 6000 - n_hashes
    assert plan.where("sha256 = 'hot'").select("keep").distinct().count() == 1


def test_skew_joins_equal_join(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    other = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    other = other.unionByName(spark.createDataFrame([(7, 1)], "k bigint, v bigint"))
    def rows_of(df):
        return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)

    for how in ("inner", "left", "left_anti", "left_semi"):
        assert rows_of(skew.skew_join(rows, other, ["k"], how)) == rows_of(rows.join(other, ["k"], how))
    monkeypatch.setattr(skew, "SMALL", 10)
    hot = skew.hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n")
    assert [r["k"] for r in hot.collect()] == [7]
    assert rows_of(skew.split_join(rows, other, ["k"], hot)) == rows_of(rows.join(other, ["k"]))


def sequential_names(existing, plan, style):
    """First free suffix, file by file."""
    shape = {"plain": "{}_{}{}", "dup": "{}_dup{}{}", "paren": "{} ({}){}"}[style]
    used, out = set(existing), {}
    for folder, name, src in sorted(plan, key=lambda p: p[2]):
        stem, dot, ext = name.rpartition(".")
        target, i = name, 0
        while (folder, target) in used:
            i += 1
            target = shape.format(stem, i, dot + ext)
        used.add((folder, target))
        out[src] = target
    return out


@pytest.mark.parametrize("style", ["plain", "dup", "paren"])
def test_collisions_take_the_first_free_name(spark, style):
    shape = {"plain": "a_{}.jpg", "dup": "a_dup{}.jpg", "paren": "a ({}).jpg"}[style]
    existing = [("d", "a.jpg"), ("d", shape.format(2)), ("d", shape.format(3)), ("e", "b.jpg")]
    plan = [("d", "a.jpg", f"s{i}") for i in range(5)] + [("e", "a.jpg", "t1"), ("e", "b.jpg", "t2")]
    got = D.number_collisions(
        spark.createDataFrame(plan, "folder string, name string, src string"),
        spark.createDataFrame(existing, "folder string, name string"),
        style,
    )
    assert {r["src"]: r["target"] for r in got.collect()} == sequential_names(existing, plan, style)


def test_collisions_between_different_names(spark):
    plan = [("d", "a.jpg", "s1"), ("d", "a.jpg", "s2"), ("d", "a_1.jpg", "s3"), ("d", "a_1.jpg", "s4")]
    got = D.number_collisions(
        spark.createDataFrame(plan, "folder string, name string, src string"),
        spark.createDataFrame([], "folder string, name string"),
    ).collect()
    names = {r["src"]: r["target"] for r in got}
    assert len(set(names.values())) == 4 and names["s3"] == "a_1.jpg" and names["s1"] == "a.jpg"


def test_pair_files_round_trip(spark, tmp_path):
    raw = spark.createDataFrame(
        [(" /a.jpg ", "/b, c.jpg"), ("  ", "/x.jpg"), ("/y.jpg", None)], "original string, duplicate string"
    )
    O.write_pairs(raw, str(tmp_path / "p"))
    got = O.read_pairs(spark, str(tmp_path / "p")).collect()
    assert [tuple(r) for r in got] == [("/a.jpg", "/b, c.jpg")]


def test_geocode_cache_file(spark, tmp_path):
    f = tmp_path / "cache.json"
    f.write_text(json.dumps({"40.0,-74.0": "Here, There", "1.0,2.0": None}, indent=2))
    got = {r["key"]: r["address"] for r in O.geocode_cache(spark, str(f)).collect()}
    assert got == {"40.0,-74.0": "Here, There", "1.0,2.0": None}


def test_empty_gallery_names_nobody(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, embedding array<double>")
    empty = spark.createDataFrame([], "position bigint, label string, embedding array<double>")
    assert Q.identify(df, empty).head()["label"] == "unknown"


def test_embed_hook_isolates_bad_rows(spark):
    def model(batch):
        if (batch["id"] == 3).any():
            raise ValueError("unreadable")
        return [[float(i)] for i in batch["id"]]

    out = {r["id"]: r for r in I.embed(spark.range(6), model).collect()}
    assert out[3]["error"] == "unreadable" and out[3]["embedding"] is None
    assert out[2]["embedding"] == [2.0] and out[2]["error"] is None


def test_triplets_respect_labels(spark):
    df = spark.range(200).select("id", F.when(F.col("id") < 120, 0).otherwise(F.col("id") % 5 + 1).alias("label"))
    t = I.mine_triplets(df, per_row=3)
    lab = df.select("id", "label")
    rows = (
        t.join(lab.toDF("anchor", "a"), "anchor")
        .join(lab.toDF("positive", "p"), "positive")
        .join(lab.toDF("negative", "n"), "negative")
    )
    assert rows.count() == 600
    assert rows.where("a <> p or a = n or anchor = positive").isEmpty()


def test_average_hash_against_numpy(spark):
    px = [int(x) for x in np.random.default_rng(0).integers(0, 255, 64)]
    got = one(spark, M.average_hash64(F.array(*[F.lit(x) for x in px])))
    mean = sum(px) / 64
    want = int("".join("1" if x >= mean else "0" for x in px), 2)
    assert got & (2**64 - 1) == want


def test_file_stream_keeps_one_per_content(spark, tree, tmp_path):
    q = (
        Z.file_stream(spark, tree)
        .writeStream.foreachBatch(Z.store_new(str(tmp_path / "out")))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    stored = Z.stored_files(spark, str(tmp_path / "out"))
    assert stored.count() == 4 == stored.select("sha256").distinct().count()


def test_rows_written_as_files_of_one_flat_folder(spark, tmp_path, monkeypatch):
    """A file per row without a folder per row, whose number leads back to the row."""
    monkeypatch.setattr(Z, "TASK_FILES", 3)
    rows = spark.createDataFrame([(i, f"text {i % 7}\n") for i in range(20)], "doc_id bigint, text string")
    target = tmp_path / "in"
    placed = Z.write_files(rows, "text", str(target), ["doc_id"])
    found = [p for p in target.rglob("*") if p.suffix != ".crc" and p.name != "_SUCCESS"]
    assert len(found) == 20 and all(p.parent == target and p.is_file() for p in found)
    names = spark.createDataFrame([(str(p), p.read_text()) for p in found], "path string, content string")
    both = placed.join(names.withColumn("file", Z.file_number(F.col("path"))), "file").collect()
    assert sorted(r.doc_id for r in both) == list(range(20))
    assert all(r.content == r.text + "\n" for r in both)


@pytest.mark.parametrize("reached", [True, False])
def test_small_files_are_written_by_their_tasks(spark, tmp_path, monkeypatch, reached):
    """On a mounted folder Hadoop's own files (a checksum each, two processes to set modes) are left out; both ways agree."""
    monkeypatch.setattr(Z, "TASK_FILES", 4)
    if not reached:
        monkeypatch.setattr(Z, "mounted", lambda spark, path: None)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["", "é\n", None, "a b", " "] * 3)], "id bigint, text string")
    target = tmp_path / "in"
    placed = Z.write_files(rows, "text", f"file:{target}", ["id"])
    assert any(p.suffix == ".crc" for p in target.iterdir()) is not reached
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(str(target))
    content = files.select(Z.file_number(F.col("path")).alias("file"), F.decode("content", "UTF-8").alias("got"))
    both = placed.join(content, "file").collect()
    assert len(both) == 15 and all(r.got == (r.text or "") + "\n" for r in both)


def test_stream_of_small_files_is_listed_in_few_tasks(spark):
    """The source lists a batch path by path, in 10,000 tasks if nothing is said."""
    names = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    with Z.small_files(spark):
        assert int(spark.conf.get(names[0])) <= 4 * spark.sparkContext.defaultParallelism
    assert [spark.conf.get(n) for n in names] == before


def test_ingest_stream_with_an_id_twice(spark, tmp_path):
    """Two texts under one id are two files."""
    import duckdb

    from oracle import difference
    from shutterlake.catalog import registry

    queries, sql = registry()
    rows = [(i, f"text {i % 4}") for i in range(6)] + [(2, "another"), (5, "text 1")]
    where = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(where)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/*.parquet'")
    assert difference(queries["k1_ingest_stream"](spark, str(tmp_path)), con, sql["k1_ingest_stream"]) is None


def test_library_run(spark):
    t = dt.datetime(2024, 5, 1)
    rows = [
        (i, f"/in/{i % 3}/p.jpg" if i else "/in/x.jpg", t + dt.timedelta(seconds=2 * i), f"h{i % 4}", i % 5, 10 + i)
        for i in range(12)
    ]
    media = spark.createDataFrame(
        rows, "media_id bigint, path string, ts timestamp_ntz, sha256 string, phash bigint, size_bytes bigint"
    ).select(
        "media_id", F.concat("path", "media_id").alias("path"), "ts", "sha256", "phash", "size_bytes",
        M.gps(F.lit(40.0), F.lit(-74.0)).alias("gps"), F.lit(1).cast("long").alias("resolution"),
        F.col("ts").alias("mtime"),
    )
    cache = spark.createDataFrame([("40.0,-74.0", "Town, X")], "key string, address string")
    none = spark.createDataFrame([], "folder string, name string")
    run = run_library(media, cache, none)
    assert run.folders.count() == 12 == run.folders.select("folder", "target").distinct().count()
    assert run.folders.where("folder <> 'Organized/2024/05-May/Town'").isEmpty()
    assert run.duplicates.count() == 8
    assert run.events.select("event_id").distinct().count() == 1
    assert run.bursts.count() == 12


def test_store_reads_only_the_ranges_of_a_batch(spark, tmp_path):
    """Contents and paths are stored once, over batches and repeated batches; other ranges may be unreadable."""
    target = str(tmp_path / "store")
    write = Z.store_new(target, ranges=8)
    ddl = "path string, sha256 string, length bigint"
    write(spark.createDataFrame([(f"/a/{i}", f"h{i}", i) for i in range(40)], ddl), 0)
    second = spark.createDataFrame([("/b/1", "h1", 1), ("/b/x", "new", 2), ("/b/a", "new", 2), ("/a/3", "other", 3)], ddl)
    write(second, 1)
    write(second, 1)
    rows = {(r.path, r.sha256, r.batch) for r in Z.stored_files(spark, target).collect()}
    assert rows == {(f"/a/{i}", f"h{i}", 0) for i in range(40)} | {("/b/a", "new", 1)}
    one = spark.createDataFrame([("/c/1", "h1", 1)], ddl)
    mine = one.select(F.pmod(F.xxhash64("sha256"), F.lit(8))).head()[0]
    for f in (tmp_path / "store" / "sha256" / "batch=0").glob("range=*/*.parquet"):
        if f.parent.name != f"range={mine}":
            f.write_bytes(b"not a table")
    write(one, 2)
    assert Z.stored_files(spark, target).where("batch = 2").isEmpty()


def test_progress_has_a_row_per_trigger(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10 + i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    written, progress = Z.drain_with_progress(stream, "scan", str(tmp_path / "out"), str(tmp_path / "state"))
    rows = progress.orderBy("batch_id").collect()
    assert [r.batch_id for r in rows] == [0, 1, 2] and sorted(r.processed for r in rows) == [10, 11, 12]
    assert written.count() == 33 and all(r.task == "scan" and r.duration_ms >= 0 for r in rows)
