"""Fill-in-the-middle transformation by block rotation in place (operator 11).

Spark derives the form and the two cuts of a text from its id alone, so a task
run again, on another executor, makes the same output. Inside a task a text is a
bytearray. One scan turns the cuts, given in code points, into byte places; the
sentinels are inserted there, which leaves the blocks <P>prefix <M>middle
<S>suffix; and two neighbouring blocks change places by three reversals (each
block, then both together). For psm the last two blocks change places, for spm
the first two with the last. Restoring finds the sentinels, rotates back and
takes them out. A text never holds a sentinel of its own (such texts stay plain),
and no sentinel can begin or end inside another one, so the first occurrence of
each is the one that was put in.

Defined results: a null text is empty; an empty text, and one that contains a
sentinel, stays plain, and so does a share of all; a null id is hashed as an
empty one; rows with the same id are cut by the same hashes, at places that also
depend on their length; the row is kept whole, whatever its columns are called.
Texts of any length are handled whole; a reversal holds two pieces of REVERSED
bytes beside the text, and a task returns its rows in tables of about
`shingles.slices` bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import shingles as S
from shutterlake.llm.text import table, whole

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
#: Percent of the texts that stay plain, and of the others that are in spm form.
PLAIN, SPM = 10, 20
#: Bytes exchanged at once by a reversal.
REVERSED = 1 << 16


def reverse(a: np.ndarray, i: int, j: int) -> None:
    """Reverse a[i:j] in place, a piece from each end at a time."""
    while j - i > 1:
        n = min(REVERSED, (j - i) // 2)
        head = a[i : i + n][::-1].copy()
        a[i : i + n] = a[j - n : j][::-1]
        a[j - n : j] = head
        i, j = i + n, j - n


def rotate(a: np.ndarray, i: int, m: int, j: int) -> None:
    """Let the blocks a[i:m] and a[m:j] change places."""
    reverse(a, i, m)
    reverse(a, m, j)
    reverse(a, i, j)


def byte_places(raw: bytes, cuts: tuple[int, int]) -> list[int]:
    """Byte places of cuts given in code points."""
    if raw.isascii():
        return list(cuts)
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [int(starts[c]) if c < len(starts) else len(raw) for c in cuts]


def turn(raw: bytes, form: str, cuts: tuple[int, int]) -> bytes:
    """The output of a text in its form."""
    if form == "plain":
        return raw
    low, high = byte_places(raw, cuts)
    buffer = bytearray(raw)
    for at, mark in ((high, SUFFIX), (low, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    middle = low + len(PREFIX)
    suffix = high + len(PREFIX) + len(MIDDLE)
    rotate(np.frombuffer(buffer, np.uint8), middle if form == "psm" else 0, suffix, len(buffer))
    return bytes(buffer)


def turn_back(output: bytes, form: str) -> bytes:
    """The text, from its output and form alone."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "psm":  # <P> <S> <M> back to <P> <M> <S>
        i, m = buffer.find(SUFFIX), buffer.find(MIDDLE)
    else:  # <S> <P> <M> back to <P> <M> <S>
        i, m = 0, buffer.find(PREFIX)
    rotate(np.frombuffer(buffer, np.uint8), i, m, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.find(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def _each(column: str, change):
    """One changed text per row, in tables of bounded bytes; the row goes along untouched."""

    def run(batches):
        for batch in batches:
            texts = batch.column(column)
            for a, b in S.slices(texts):
                part = batch.slice(a, b - a)
                names = [n for n in part.schema.names if n != "row"]
                cells = [part.column(n).cast(pa.binary()).to_pylist() if n == column else part.column(n).to_pylist() for n in names]
                made = [change(**dict(zip(names, row))) for row in zip(*cells)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(made, pa.binary()).cast(pa.string())], names=["row", column]
                )

    return run


def _turned(text, form, low, high):
    return turn(text, form, (low, high))


def _restored(output, form):
    return turn_back(output, form)


def group_of(hexes: Column, i: int) -> Column:
    """The i-th group of 8 hex digits as an unsigned integer."""
    return F.conv(F.substring(hexes, 8 * i + 1, 8), 16, 10).cast("long")


def fill_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """row (the columns of docs but the text), n, form, prefix_chars, middle_chars, output."""
    source = whole(docs[text])
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[doc_id].cast("string"), F.lit(""))), 256)
    read = docs.select(
        F.struct(
            F.struct(*[docs[c] for c in docs.columns if c != text]).alias("own"),
            F.length(source).cast("long").alias("n"),
            hexes.alias("h"),
        ).alias("d"),
        source.alias("text"),
    )
    h, n = F.col("d.h"), F.col("d.n")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark.decode()))
    form = (
        F.when((n == 0) | marked | (group_of(h, 2) % 100 >= 100 - PLAIN), "plain")
        .when(group_of(h, 3) % 100 < SPM, "spm")
        .otherwise("psm")
    )
    one, two = group_of(h, 0) % (n + 1), group_of(h, 1) % (n + 1)
    cut = read.select("text", "d", form.alias("form"), F.least(one, two).alias("low"), F.greatest(one, two).alias("high"))
    row = F.struct(F.col("d.own").alias("own"), n.alias("n"), "form", "low", "high").alias("row")
    schema = cut.select(row, "text").schema
    out = cut.select(row, "text", "form", "low", "high").mapInArrow(_each("text", _turned), schema)
    split = F.col("row.form") != "plain"
    return out.select(
        F.col("row.own").alias("row"),
        F.col("row.n").alias("n"),
        F.col("row.form").alias("form"),
        F.when(split, F.col("row.low")).alias("prefix_chars"),
        F.when(split, F.col("row.high") - F.col("row.low")).alias("middle_chars"),
        F.col("text").alias("output"),
    )


def restore(turned: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """row (all columns of the turned table) and text, from the output and form."""
    held = turned.select(
        F.struct(*[turned[c] for c in turned.columns]).alias("row"),
        turned[output].alias("output"),
        turned[form].alias("form"),
    )
    schema = held.select("row", "output").schema
    return held.mapInArrow(_each("output", _restored), schema).select("row", F.col("output").alias("text"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = restore(fill_middle(table(spark, folder, "documents").select("doc_id", "text")))
    return out.select(
        "row.row.doc_id",
        *[f"row.{c}" for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2("row.output", 256).alias("output_sha256"),
        F.sha2("text", 256).alias("restored_sha256"),
    )


_GROUPS = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::UBIGINT::BIGINT AS h{i + 1}" for i in range(4))
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT doc_id, t, n, {_GROUPS} FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {100 - PLAIN}
         THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
