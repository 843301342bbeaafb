"""Token counts from pre-token counts (operator 3).

The pieces of the model never cross from a character that is no space to a
space, nor a line end, so a text's number of tokens is the sum over its
pre-tokens: runs that begin with spaces or with a line end. Every distinct
pre-token is counted once by the library; each document becomes frequencies of
pre-tokens, which are joined to the counts and summed. No ids are made.

Frequent pre-tokens, at most HOT of them, go to the tasks as a table of bounded
size, and sum up beside the text. Only the rare rest is shuffled. A rare
pre-token has fewer occurrences than every frequent one, so no key of that join
is hot.

Defined results: a null or empty text has no tokens; a null id is kept; repeated
rows are counted each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.chunks import text_slices, vocabulary
from shutterlake.llm.text import table, whole
from shutterlake.llm.worker import held
from shutterlake.session import materialize

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Most pre-tokens that are summed beside the text.
HOT = 300_000

SPACE = chr(0x2581)
PRE_TOKEN = re.compile(f"[ {SPACE}]+[^ {SPACE}\n]*|\n[^ {SPACE}\n]*")

def _model(proto: bytes):
    """The library's model."""

    def make():
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("this vocabulary has pieces across pre-tokens")
        return m

    return held("pieces", (zlib.crc32(proto), len(proto)), make)


def pre_tokens(text: str) -> list[str]:
    """All pre-tokens in order; the first has the space that the model puts before a text."""
    return PRE_TOKEN.findall(" " + text) if text else []


def count_pieces(model, pre: list[str]) -> list[int]:
    """Pieces of each pre-token as they are inside a text.

    The model puts a space before what it is given: that stands for the first
    space of a pre-token, and is one piece more before a line end.
    """
    given = [p if p[0] == "\n" else p[1:] for p in pre]
    n = [len(x) for x in model.encode(given, num_threads=1)]
    return [1 if not g else k - (g[0] == "\n" and p[0] == "\n") for p, g, k in zip(pre, given, n)]


def _distinct(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in text_slices(texts, 16_000_000):
            seen: Counter[str] = Counter()
            for t in texts[a:b]:
                seen.update(pre_tokens(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pre", "n"]
            )


def _count(spec):
    def run(batches):
        model = _model(spec.value)
        for batch in batches:
            n = count_pieces(model, batch.column("pre").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("pre"), batch.column("n"), pa.array(n, pa.int64())], names=["pre", "n", "pieces"]
            )

    return run


def _frequencies(hot):
    """Per document: tokens of its frequent pre-tokens, and the frequencies of the rare ones."""

    def run(batches):
        table = hot.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_slices(texts):
                sums, names, often, at = [], [], [], [0]
                for t in texts[a:b]:
                    total = 0
                    for pre, n in Counter(pre_tokens(t)).items():
                        k = table.get(pre)
                        if k is None:
                            names.append(pre)
                            often.append(n)
                        else:
                            total += n * k
                    sums.append(total)
                    at.append(len(names))
                part = batch.slice(a, b - a)
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("row_no"),
                        part.column("n_bytes"),
                        pa.array(sums, pa.int64()),
                        pa.ListArray.from_arrays(at, pa.array(names, pa.string())),
                        pa.ListArray.from_arrays(at, pa.array(often, pa.int64())),
                    ],
                    names=["doc_id", "row_no", "n_bytes", "tokens", "rare", "often"],
                )

    return run


def count_tokens(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary_file: str = VOCABULARY,
    hot_rows: int = HOT,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row."""
    spark = docs.sparkSession
    spec = vocabulary(spark, vocabulary_file)
    read = docs.select(docs[doc_id].alias("doc_id"), whole(docs[text]).alias("text"))
    counts = materialize(
        read.select("text")
        .mapInArrow(_distinct, "pre string, n long")
        .groupBy("pre")
        .agg(F.sum("n").alias("n"))
        .mapInArrow(_count(spec), "pre string, n long, pieces long")
    )
    # Pre-tokens by the power of two of their frequency: at most 64 rows.
    powers = counts.groupBy(F.floor(F.log2("n")).alias("p")).count().orderBy(F.desc("p")).collect()
    cut, held = 64, 0
    for p, n in powers:
        if held + n > hot_rows:
            break
        cut, held = p, held + n
    frequent = F.floor(F.log2("n")) >= cut
    hot = counts.where(frequent).select("pre", "pieces").toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(hot["pre"].to_pylist(), hot["pieces"].to_pylist())))
    kind = read.schema["doc_id"].dataType.simpleString()
    per_doc = materialize(
        read.withColumn("row_no", F.monotonically_increasing_id())
        .withColumn("n_bytes", F.octet_length("text").cast("long"))
        .mapInArrow(
            _frequencies(hot),
            f"doc_id {kind}, row_no long, n_bytes long, tokens long, rare array<string>, often array<long>",
        )
    )
    rare = (
        per_doc.select("row_no", F.explode(F.arrays_zip("rare", "often")).alias("x"))
        .select("row_no", F.col("x.rare").alias("pre"), F.col("x.often").alias("often"))
        .join(counts.where(~frequent).select("pre", "pieces"), "pre")
        .groupBy("row_no")
        .agg(F.sum(F.col("often") * F.col("pieces")).alias("more"))
    )
    return per_doc.select("doc_id", "row_no", "n_bytes", "tokens").join(rare, "row_no", "left").select(
        "doc_id", "n_bytes", (F.col("tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = count_tokens(table(spark, folder, "documents").select("doc_id", "text"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
