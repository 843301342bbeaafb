"""Line dedup over levelled sorted runs of line hashes (operator 2).

The index of the lines seen so far is a set of runs: tables of (hash, owner)
bucketed and sorted by the hash, disjoint in their hashes. A batch of documents
brings its own hashes with the smallest document that holds each, anti-joins
them with every run by a merge join that reads the runs where they lie (the
bucketing spares their shuffle), and adds what is left as a new run of level 0.
When a level has FANOUT runs, they are merged into one run of the next level, so
the runs to read grow with the logarithm of the number of batches.

Batches come in ascending order of documents, so the run that holds a hash names
the first document with that line. A line stays exactly if (hash, document) is
in the runs. That pair is no hot key however common a line is, so the last step,
an anti-join on the pair, is even by construction, and one line in a third of
all documents is only ever met as partial minima.

Hashes are two seeded 64-bit hashes, 128 bits together.

Defined results: a null text is one empty line; rows with the same id count as
one document and each keep their own lines; rows with a null id count as one
document that comes last; keys shorter than MIN_KEY code points always stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.text import SPACE_CHARS, UPPER, ascii_lower, table, whole
from shutterlake.session import discard, scratch_path

MIN_KEY = 10
#: Batches that one table is cut into, and runs of a level that are merged.
BATCHES = 4
FANOUT = 2

KEY = ("h1", "h2")


class LineRuns:
    """The index: levels of runs, each a bucketed table under the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, "run")
        (
            keys.write.format("parquet")
            .bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", self.paths[name])
            .saveAsTable(name)
        )
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def add(self, batch: DataFrame) -> None:
        """`batch` has h1, h2 and doc; later batches must hold later documents."""
        fresh = batch.groupBy(*KEY).agg(F.min("doc").alias("owner"))
        for run in self.runs():
            fresh = fresh.join(run.select(*KEY).hint("merge"), list(KEY), "left_anti")
        self._place(self._write(fresh), 0)

    def _place(self, run: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fanout:
            return
        merged = None
        for n in self.levels[level]:
            t = self.spark.table(n)
            merged = t if merged is None else merged.unionByName(t)
        name = self._write(merged.repartition(self.buckets, *KEY))
        for n in self.levels[level]:
            self._drop(n)
        self.levels[level] = []
        self._place(name, level + 1)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, self.paths.pop(name))

    def owners(self) -> DataFrame:
        """(h1, h2, owner) of all runs as plain files, so that Spark may split any join with them."""
        schema = "h1 long, h2 long, owner long"  # an empty run has no file to tell it
        return self.spark.read.schema(schema).parquet(*self.paths.values())

    def close(self) -> None:
        """Take the names out of the catalog; the files stay for what still reads them."""
        for name in self.paths:
            self.spark.sql(f"DROP TABLE {name}")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _doc(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(2**63 - 1))


def _read(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        _doc(docs[doc_id]).alias("doc"),
        whole(docs[text]).alias("t"),
    )
    return t.withColumn("th", F.xxhash64("t"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """(row, kept, n_lines, n_dropped) per input row; `row` is the input row as a struct."""
    spark = docs.sparkSession
    cuts = docs.select(_doc(docs[doc_id]).alias("doc")).approxQuantile(
        "doc", [i / batches for i in range(1, batches)], 0.01
    )
    cuts = sorted({int(c) for c in cuts})
    read = _read(docs, doc_id, text)
    lines = (
        read.select("doc", "th", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
        .select("doc", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= MIN_KEY)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("line"), "key").alias("h2"),
            "doc", "th", "pos",
            sum((F.col("doc") > c).cast("int") for c in cuts).alias("batch") if cuts else F.lit(0).alias("batch"),
        )
    )
    path = scratch_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)

    index = LineRuns(spark)
    for b in range(len(cuts) + 1):
        index.add(lines.where(F.col("batch") == b))

    owners = index.owners().withColumnRenamed("owner", "doc")
    index.close()
    dropped = (
        lines.join(owners, [*KEY, "doc"], "left_anti")
        .groupBy("doc", "th")
        .agg(F.collect_set("pos").alias("gone"))
    )
    out = read.join(dropped, ["doc", "th"], "left").withColumn("lines", F.split("t", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    )
    return out.select(
        "row",
        kept.alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with the lines left to them, n_chars counted again; all columns stay."""
    out = drop_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = drop_lines(docs)
    return out.select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM s),
k AS (SELECT *, translate(trim(line, {_SPACES}), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= {MIN_KEY} GROUP BY key),
d AS (SELECT k.*, f.owner IS NOT NULL AND f.owner <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
