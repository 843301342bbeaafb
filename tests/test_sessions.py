import json

import pytest
from pyspark.sql import functions as F

from shutterlake.sources import sessions as S

DDL = "original string, duplicate string, keepOriginal boolean, keepDuplicate boolean"


def decisions(spark, n=500):
    rows = [(f"/o/{i % 7}/é \"{i}\".jpg", f"/d/{i}.jpg", i % 3 > 0, i % 4 > 0) for i in range(n)]
    return spark.createDataFrame(rows, DDL).repartition(6), rows


def test_session_document(spark, tmp_path):
    df, rows = decisions(spark)
    path = str(tmp_path / "session.json")
    S.write_session(df, path, "2024-05-01T10:00:00")
    doc = json.load(open(path, encoding="utf-8"))
    assert list(doc) == ["timestamp", "totalSets", "reviewed", "decisions"]
    assert doc["totalSets"] == 500 and doc["reviewed"] == sum(not (a and b) for _, _, a, b in rows)
    names = [x.split()[0] for x in DDL.split(", ")]
    assert [tuple(x[n] for n in names) for x in doc["decisions"]] == sorted(rows, key=lambda r: (r[0].encode(), r[1]))
    back = S.read_session(spark, path, "original: string, duplicate: string, keepOriginal: boolean, keepDuplicate: boolean")
    assert back.selectExpr("size(decisions)", "totalSets").head() == (500, 500)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["session.json"]


def test_empty_session(spark, tmp_path):
    df, _ = decisions(spark, 3)
    S.write_session(df.limit(0), str(tmp_path / "s.json"), "t")
    assert json.load(open(tmp_path / "s.json")) == {"timestamp": "t", "totalSets": 0, "reviewed": 0, "decisions": []}


def test_audit_lines_are_in_order(spark, tmp_path):
    plan = spark.range(1000).selectExpr("id", "concat('/k/', id % 10) AS keep", "concat('/d\n', id) AS delete").repartition(5)
    S.write_audit(plan, str(tmp_path / "log"), "keep", "id", line=F.concat_ws(" ", F.lit("delete"), "delete", F.lit("keep"), "keep"))
    lines = (tmp_path / "log").read_text().splitlines()
    assert lines == [f"delete /d {i} keep /k/{k}" for k in range(10) for i in range(k, 1000, 10)]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df, _ = decisions(spark)
    bad = df.withColumn("note", F.when(F.col("duplicate") == "/d/400.jpg", F.raise_error(F.lit("no"))).otherwise(F.lit("x")))
    with pytest.raises(Exception):  # noqa: B017
        S.write_audit(bad, str(tmp_path / "log"), "original", "duplicate")
    assert list(tmp_path.iterdir()) == []
