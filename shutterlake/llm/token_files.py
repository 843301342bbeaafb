"""Token files: Parquet with one list of token ids per document (operator 9).

Layout: ascending ids over the files and inside each; the ids of the vocabulary
as a dictionary-encoded list column, ids and counts of documents delta-encoded
(data page version 2); row groups and pages of set sizes, with the page index
that Parquet writers add. So a reader of some documents touches only the pages
that hold them, and a reader of the counts touches no tokens.

Files are written from sorted range partitions. The place of a document in the
stream of all tokens is the total of the files before plus a running sum inside
its file; only counts are moved for it, and one row per file.

Defined results: a null or empty text is the end id alone; a null id comes
first; rows with the same id are ordered by the hash of their text; an empty
table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.llm.chunks import library_chunks, packed, text_slices, vocabulary
from shutterlake.llm.text import table, whole
from shutterlake.session import materialize, scratch_path

END = 1
VOCABULARY = "word_bpe_49k.json"

ROW_GROUP_BYTES = 32 * 1024 * 1024
PAGE_BYTES = 64 * 1024
PAGE_ROWS = 2000

SCHEMA = "doc_id {id}, th long, n_tokens long, tokens array<int>"


def _encode(spec, end: bytes, keep_space: bool):
    def run(batches):
        chunks = library_chunks(spec.value, keep_space)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_slices(texts):
                ids = [x + end for x in chunks.ids(texts[a:b])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)),
                    pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)),
                )
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(n), lists],
                    names=["doc_id", "th", "n_tokens", "tokens"],
                )

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary_file: str = VOCABULARY,
    keep_space: bool = False,
) -> None:
    """Encode all texts and write the files. `keep_space` as in `library_chunks`."""
    spec = vocabulary(docs.sparkSession, vocabulary_file)
    read = docs.select(docs[doc_id].alias("doc_id"), whole(docs[text]).alias("text")).withColumn(
        "th", F.xxhash64("text")
    )
    schema = SCHEMA.format(id=read.schema["doc_id"].dataType.simpleString())
    (
        read.repartitionByRange("doc_id", "th")
        .sortWithinPartitions("doc_id", "th")
        .mapInArrow(_encode(spec, packed([END]), keep_space), schema)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("parquet.dictionary.page.size", str(1024 * 1024))
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(path)
    )


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens) without touching the tokens."""
    return spark.read.parquet(path).select("doc_id", "n_tokens")


def read_tokens(spark: SparkSession, path: str, ids: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, tokens); with ids only the pages whose range of ids can hold them are read."""
    t = spark.read.parquet(path)
    if ids is not None:
        t = t.where(F.col("doc_id").isin(list(ids)))
    return t.select("doc_id", "tokens")


def _checksums(batches):
    for batch in batches:
        lists = batch.column("tokens")
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        at = lists.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        rest = [c for c in batch.schema.names if c != "tokens"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in rest], pa.array(sums, pa.int64())], names=[*rest, "ids_crc32"]
        )


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files: start is the number of tokens before."""
    t = spark.read.parquet(path).select(
        "doc_id", "th", "n_tokens", F.input_file_name().alias("file"), "tokens"
    )
    kind = t.schema["doc_id"].dataType.simpleString()
    rows = materialize(
        t.mapInArrow(_checksums, f"doc_id {kind}, th long, n_tokens long, file string, ids_crc32 long")
    )
    # Names of files ascend with their partitions; one row per file.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        rows.groupBy("file")
        .agg(F.sum("n_tokens").alias("n"))
        .select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    inside = (
        Window.partitionBy("file")
        .orderBy(F.col("doc_id").asc_nulls_first(), "th")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(files), "file")
        .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, folder, "documents").select("doc_id", "text"), path)
    return index(spark, path)
