"""Document fingerprints by winnowing (operator 5).

Every run of K code points has a 32-bit hash, rolled by doubling (1, 2, 4, ... K
code points). From every window of W hashes the smallest is kept, of equal ones
the rightmost, with its position. Two texts that share W + K - 1 code points in a
row therefore share at least one mark, and positions tell where. A text shorter
than K is one mark; a shorter window is taken whole.

The likeness of two fingerprints is the Jaccard similarity of their hash sets: 1
for two without marks, 0 if only one has any.

The query compares each document with an edited self and with the next document
by id. Next documents are found without a global sort of texts: ids alone are cut
into sorted slices, whose first ids tell each text its slice. A slice's first
text is sent once more, to the slice before it, so a task that reads its slices
in order has every text beside its next one. Texts are moved once and streamed,
never gathered.

Defined results: a null text is empty and has no marks; rows with the same id are
ordered by the hash of their text; a null id comes last; in a table of one row
the row is its own next; a text of any length is marked in pieces, with the same
marks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.chunks import text_slices
from shutterlake.llm.shingles import mix
from shutterlake.llm.text import table, whole
from shutterlake.operators.ordering import SLICE

K = 16
W = 32
BASE = 0x9E3779B97F4A7C15

#: Documents in a slice; at most SLICES slices, beyond which they get longer.
SLICE_DOCS = 1024
SLICES = 100_000

#: Code points that one call marks, some 100 bytes of memory each; a longer text is marked in pieces.
PIECE = 500_000


def marks(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of each text, in order of position, found for all texts at once."""
    n = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))] * len(texts)
    h, width, power = code, 1, BASE
    while width < K:
        if len(h) > width:
            h = h[:-width] * np.uint64(power) + h[width:]
        else:
            h = h[:0]
        power = power * power % 2**64
        width *= 2
    # A key orders by hash, then by position from the right.
    spot = np.arange(len(h), dtype=np.uint64)
    key = (mix(h) & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - (spot & np.uint64(0xFFFFFFFF)))
    low, width = key, 1
    while width < W:
        low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
        width *= 2
    long = n >= K + W - 1
    if len(low):
        # Windows that lie in one text; a window keeps what the one before kept, or a new mark.
        owner = np.repeat(np.arange(len(texts)), np.where(long, n - (K + W - 2), 0))
        count = np.where(long, n - (K + W - 2), 0)
        begin = np.concatenate([[0], np.cumsum(count)])
        start = np.repeat(at[:-1] - begin[:-1], count) + np.arange(begin[-1])
        kept = low[start]
        new = np.ones(len(kept), bool)
        new[1:] = (kept[1:] != kept[:-1]) | (owner[1:] != owner[:-1])
        kept, owner = kept[new], owner[new]
        # All runs are shorter than 2**32, so the low half gives the place in the joined text.
        place = (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64)
        hashes = (kept >> np.uint64(32)).astype(np.uint32)
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i in np.flatnonzero(long).tolist():
            a, b = cut[i], cut[i + 1]
            out[i] = hashes[a:b], place[a:b] - at[i]
    for i in np.flatnonzero(~long & (n > 0)).tolist():
        if n[i] >= K:
            k = key[at[i] : at[i] + n[i] - K + 1].min()
            p = 0xFFFFFFFF - (int(k) & 0xFFFFFFFF) - int(at[i])
            out[i] = np.array([int(k) >> 32], np.uint32), np.array([p], np.int64)
        else:
            v = 0
            for c in texts[i]:
                v = (v * BASE + ord(c) + 1) % 2**64
            v = int(mix(np.array([v ^ int(n[i])], np.uint64))[0]) >> 32
            out[i] = np.array([v], np.uint32), np.array([0], np.int64)
    return out


def long_marks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The marks of one text, a piece of its windows after the other."""
    hashes, places, last = [], [], -1
    for a in range(0, max(1, len(text) - (K + W - 2)), PIECE):
        h, p = marks([text[a : a + PIECE + K + W - 2]])[0]
        p = p + a
        new = p != last  # the first window of a piece may keep what the last one before kept
        hashes.append(h[new])
        places.append(p[new])
        last = p[-1] if len(p) else last
    return np.concatenate(hashes), np.concatenate(places)


def all_marks(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The marks of many texts, in bounded memory whatever their lengths."""
    out = []
    for a, b in text_slices(texts, PIECE):
        out += marks(texts[a:b]) if b > a + 1 or len(texts[a]) <= PIECE else [long_marks(texts[a])]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two hash sets."""
    x, y = set(a.tolist()), set(b.tolist())
    union = len(x | y)
    return len(x & y) / union if union else 1.0


def _mark_rows(batches):
    for batch in batches:
        found = all_marks(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())),
                pa.array([p for _, p in found], pa.list_(pa.int64())),
            ],
            names=["row", "hashes", "positions"],
        )


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, hashes, positions) per input row; `row` has its other columns."""
    held = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c != text] or [F.lit(0).alias("_")]).alias("row"),
        whole(docs[text]).alias("text"),
    )
    row = held.schema["row"].dataType.simpleString()
    return held.mapInArrow(_mark_rows, f"row {row}, hashes array<long>, positions array<long>")


def _place(heads: list[tuple[int, int]]):
    """Give each row its slice; send a slice's first row to the slice before, too."""
    ids = np.array([d for d, _ in heads], np.int64)
    ties = np.array([t for _, t in heads], np.int64)

    def run(batches):
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            th = batch.column("th").to_numpy()
            at = np.maximum(np.searchsorted(ids, doc, "right") - 1, 0)
            # Rows of an id that begins several slices: the last head of that id not beyond the row's hash.
            for i in np.flatnonzero((ids[at] == doc) & (ties[at] > th)).tolist():
                first = int(np.searchsorted(ids, doc[i], "left"))
                at[i] = max(first + int(np.searchsorted(ties[first : at[i] + 1], th[i], "right")) - 1, 0)
            head = np.flatnonzero((ids[at] == doc) & (ties[at] == th))
            take = np.concatenate([np.arange(len(doc)), head])
            where = np.concatenate([at, (at[head] - 1) % len(ids)])
            extra = np.concatenate([np.zeros(len(doc), bool), np.ones(len(head), bool)])
            out = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), pa.array(extra), *out.columns], names=["slice", "extra", *batch.schema.names]
            )

    return run


def _compare(batches):
    """Rows in order of slice, then extra, then document; each row but the extra ones is compared with the next."""
    waiting = None  # (slice, doc_id, text, hashes) of the row that still needs its next
    for batch in batches:
        t = batch.select(["slice", "extra", "doc_id", "text"]).to_pydict()
        for a, b in text_slices(t["text"], PIECE):
            texts = t["text"][a:b]
            own = [h for h, _ in all_marks(texts)]
            ready = []
            for s, extra, d, text, h in zip(t["slice"][a:], t["extra"][a:], t["doc_id"][a:], texts, own):
                if waiting is not None and waiting[0] == s:
                    ready.append((*waiting[1:], text, h))
                waiting = None if extra else (s, d, text, h)
            edited = []
            for _, text, _, after, _ in ready:
                q = len(text) // 4
                edited.append(text[: len(text) - q] + after[:q])
            other = [h for h, _ in all_marks(edited)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in ready], pa.int64()),
                    pa.array([len(r[1]) for r in ready], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                    pa.array([r[2].astype(">u4").tobytes().hex() for r in ready], pa.string()),
                    pa.array([h.astype(">u4").tobytes().hex() for h in other], pa.string()),
                    pa.array([likeness(r[2], h) for r, h in zip(ready, other)], pa.float64()),
                    pa.array([likeness(r[2], r[4]) for r in ready], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """The digest of the query, from (doc_id, text)."""
    read = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)).alias("doc"),
        whole(docs["text"]).alias("text"),
    ).withColumn("th", F.xxhash64("text"))
    n = read.count()
    slices = max(1, min(SLICES, math.ceil(n / SLICE_DOCS)))
    ids = read.select("doc", "th").repartitionByRange(slices, "doc", "th").withColumn(SLICE, F.spark_partition_id())
    # One row per slice: its first document.
    heads = ids.groupBy(SLICE).agg(F.min(F.struct("doc", "th")).alias("head")).select("head.doc", "head.th")
    heads = sorted((r[0], r[1]) for r in heads.collect())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return (
        read.mapInArrow(_place(heads), "slice long, extra boolean, doc_id long, doc long, text string, th long")
        .repartition("slice")
        .sortWithinPartitions("slice", "extra", "doc", "th")
        .mapInArrow(_compare, schema)
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return compare_with_edited(table(spark, folder, "documents").select("doc_id", "text"))
