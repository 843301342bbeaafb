"""Packing token sequences by non-negative least squares over length combinations (operator 7).

Each document is its token ids and an end id, cut at every WINDOW tokens. Full
windows are sequences of their own. The rest of a document, shorter than a
window, is a piece of some length, and the histogram of lengths (at most
WINDOW - 1 numbers, whatever the data) goes to the driver. There, all
combinations of up to DEPTH lengths that fill a window exactly are enumerated,
and repeat counts x >= 0 are fitted so that the pieces they use match the
histogram in least squares. The counts are rounded as far as the histogram
allows. Left-over pieces are laid end to end, longest first, and cut where a
window ends; the last part window is cut into powers of two. So only left-over
pieces are cut, one a window, and no sequence is padded.

Where a piece goes follows from its length and its number among the pieces of
its length, so nothing but (length, number) decides and every piece is placed in
place. Numbers come from sorted slices, since a length may hold any share of the
pieces. Texts are read again only for the few pieces that are cut.

Defined results: a null or empty text is the end id alone; a null id and
repeated rows are documents like others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.chunks import library_chunks, packed, text_slices, vocabulary
from shutterlake.llm.text import table, whole
from shutterlake.operators.ordering import number_rows
from shutterlake.session import materialize

WINDOW = 2048
DEPTH = 3
END = 1
PASSES = 4
VOCABULARY = "byte_bpe_50k.json"


def combinations(lengths: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> np.ndarray:
    """All descending combinations of up to `depth` (1 to 3) present lengths that sum to the window; 0 fills up."""
    here = np.zeros(window + 1, bool)
    here[lengths] = True
    out = []
    if here[window]:
        out.append([[window, 0, 0]])
    if depth >= 2:
        a = lengths[(lengths * 2 >= window) & (lengths < window)]
        a = a[here[window - a]]
        out.append(np.stack([a, window - a, 0 * a], 1))
    if depth >= 3:
        a, b = np.meshgrid(lengths, lengths, indexing="ij")
        c = window - a - b
        ok = (a >= b) & (b >= c) & (c > 0)
        ok[ok] = here[c[ok]]
        out.append(np.stack([a[ok], b[ok], c[ok]], 1))
    return np.concatenate([np.array(x, np.int64).reshape(-1, 3) for x in out]) if out else np.zeros((0, 3), np.int64)


def repeat_counts(hist: np.ndarray, combos: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Non-negative least squares by coordinate descent: each count to its best value in turn."""
    left = hist.astype(float).tolist()
    x = [0.0] * len(combos)
    rows = combos.tolist()
    for _ in range(passes):
        moved = 0.0
        for p, (a, b, c) in enumerate(rows):
            # Squares of the multiplicities: 1 each, 4 for a length used twice, 9 thrice.
            if not b:
                step, norm = left[a], 1
            elif not c:
                step, norm = left[a] + left[b], 4 if a == b else 2
            else:
                same = (a == b) + (b == c)
                step, norm = left[a] + left[b] + left[c], (3, 5, 9)[same]
            d = step / norm
            if d < -x[p]:
                d = -x[p]
            if d:
                x[p] += d
                left[a] -= d
                if b:
                    left[b] -= d
                if c:
                    left[c] -= d
                moved = max(moved, abs(d))
        if moved < 0.25:
            break
    return np.array(x)


def whole_counts(hist: np.ndarray, combos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rounded counts, largest first, never more than the pieces there are; then up, where pieces are left."""
    left = hist.astype(np.int64).copy()
    out = np.zeros(len(combos), np.int64)
    order = np.lexsort((np.arange(len(x)), -x))
    order = order[x[order] > 0.01]
    for up in (False, True):
        for p in order.tolist():
            want = 1 if up else int(x[p] + 0.5)
            used = [v for v in combos[p].tolist() if v]
            n = min([want, *(int(left[v]) // used.count(v) for v in used)])
            if n > 0:
                out[p] += n
                for v in used:
                    left[v] -= n
    return out


class Plan:
    """Sequence and offset of a piece by its length and number (from 0) among those of its length."""

    def __init__(self, hist: np.ndarray, n_full: int, window: int = WINDOW):
        self.window = window
        lengths = np.flatnonzero(hist)
        combos = combinations(lengths, window)
        counts = whole_counts(hist, combos, repeat_counts(hist, combos))
        used = np.zeros(window + 1, np.int64)
        slots, seq = [], n_full
        for p in np.flatnonzero(counts).tolist():
            at, n = 0, int(counts[p])
            for v in combos[p].tolist():
                if v:
                    slots.append((v, used[v], seq, at))
                    used[v] += n
                    at += v
            seq += n
        self.used, self.in_combos = used, int(seq - n_full)
        slots.sort()
        s = np.array(slots, np.int64).reshape(-1, 4)
        self.low, self.seq, self.at = s[:, 1], s[:, 2], s[:, 3]
        self.first = np.searchsorted(s[:, 0], np.arange(window + 2))
        # Left-over pieces on a line, longest first.
        rest = hist - used[: len(hist)]
        begin = np.zeros(window + 1, np.int64)
        begin[:window] = np.cumsum((rest * np.arange(window))[::-1])[::-1] - rest * np.arange(window)
        self.begin, self.line = begin, seq
        total = int((rest * np.arange(window)).sum())
        self.whole_end = total // window * window
        ends, at = [], self.whole_end
        for k in range(window.bit_length(), -1, -1):
            if (total - self.whole_end) >> k & 1:
                at += 1 << k
                ends.append(at)
        self.ends = np.array(ends, np.int64)  # of the sequences after the last whole window

    def place(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, offset) of its parts: one unless it is cut."""
        if number < self.used[length]:
            a, b = self.first[length], self.first[length + 1]
            k = a + int(np.searchsorted(self.low[a:b], number, "right")) - 1
            return [(0, length, int(self.seq[k] + number - self.low[k]), int(self.at[k]))]
        at = int(self.begin[length] + (number - self.used[length]) * length)
        end, out, start = at + length, [], at
        while start < end:
            if start < self.whole_end:
                seq, first = start // self.window, start // self.window * self.window
                stop = first + self.window
            else:
                k = int(np.searchsorted(self.ends, start, "right"))
                first = int(self.ends[k - 1]) if k else self.whole_end
                seq, stop = self.whole_end // self.window + k, int(self.ends[k])
            stop = min(stop, end)
            out.append((start - at, stop - start, self.line + seq, start - first))
            start = stop
        return out


def _measure(spec, end: bytes):
    """Per document: its number of tokens and a checksum for each window of them."""

    def run(batches):
        chunks = library_chunks(spec.value, True)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n, sums = [], []
            for a, b in text_slices(texts):
                for ids in chunks.ids(texts[a:b]):
                    ids += end
                    n.append(len(ids) // 4)
                    sums.append([zlib.crc32(ids[i : i + 4 * WINDOW]) for i in range(0, len(ids), 4 * WINDOW)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), batch.column("row_no"), pa.array(n, pa.int64()),
                 pa.array(sums, pa.list_(pa.int64()))],
                names=["doc_id", "th", "row_no", "doc_tokens", "sums"],
            )

    return run


def _place(plan: Plan):
    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            rows = []
            for i, (length, number) in enumerate(zip(t["length"], t["number"])):
                if length == WINDOW:
                    parts = [(0, length, number - 1, 0)]
                else:
                    parts = plan.place(length, number - 1)
                crc = t["crc"][i] if len(parts) == 1 else None
                rows += [(i, t["start"][i] + s, n, crc, seq, at) for s, n, seq, at in parts]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("doc_id", "th", "row_no", "doc_tokens")]
                + [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6)],
                names=["doc_id", "th", "row_no", "doc_tokens", "start", "length", "crc", "sequence_id", "offset"],
            )

    return run


def _checksums(spec, end: bytes):
    """Checksums of the wanted parts of each text."""

    def run(batches):
        chunks = library_chunks(spec.value, True)
        for batch in batches:
            t = batch.to_pydict()
            rows = []
            for a, b in text_slices(t["text"]):
                for i, ids in enumerate(chunks.ids(t["text"][a:b]), a):
                    ids += end
                    for p in t["parts"][i]:
                        s, n = p["start"], p["length"]
                        rows.append((t["row_no"][i], s, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["row_no", "start", "cut_crc"]
            )

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_file: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    spec, end = vocabulary(spark, vocabulary_file), packed([END])
    read = docs.select(docs[doc_id].alias("doc_id"), whole(docs[text]).alias("text")).withColumn(
        "th", F.xxhash64("text")
    )
    id_type = read.schema["doc_id"].dataType.simpleString()
    # Row numbers are given once and written, so they stay what they are.
    measured = materialize(
        read.withColumn("row_no", F.monotonically_increasing_id()).mapInArrow(
            _measure(spec, end), f"doc_id {id_type}, th long, row_no long, doc_tokens long, sums array<long>"
        )
    )
    pieces = measured.select(
        "doc_id", "th", "row_no", "doc_tokens", F.posexplode("sums").alias("k", "crc")
    ).select(
        "doc_id", "th", "row_no", "doc_tokens", "crc",
        (F.col("k").cast("long") * WINDOW).alias("start"),
        F.least(F.col("doc_tokens") - F.col("k") * WINDOW, F.lit(WINDOW)).cast("long").alias("length"),
    )
    sizes = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most WINDOW rows
    hist = np.zeros(WINDOW, np.int64)
    for length, n in sizes.items():
        if length < WINDOW:
            hist[length] = n
    plan = Plan(hist, sizes.get(WINDOW, 0))
    numbered = number_rows(pieces, ["length"], [F.col("row_no").asc(), F.col("start").asc()], "number")
    placed = materialize(
        numbered.mapInArrow(
            _place(plan),
            f"doc_id {id_type}, th long, row_no long, doc_tokens long, start long, length long, crc long,"
            " sequence_id long, offset long",
        )
    )
    cut = materialize(
        placed.where(F.col("crc").isNull())
        .groupBy("doc_id", "th", "row_no")
        .agg(F.collect_list(F.struct("start", "length")).alias("parts"))
    )
    again = read.withColumnsRenamed({"doc_id": "d", "th": "h"})
    texts = cut.join(again, cut["doc_id"].eqNullSafe(again["d"]) & (cut["th"] == again["h"]))
    texts = texts.dropDuplicates(["row_no"]).select("row_no", "parts", "text")
    sums = materialize(texts.mapInArrow(_checksums(spec, end), "row_no long, start long, cut_crc long"))
    return placed.join(sums, ["row_no", "start"], "left").select(
        "doc_id", "start", "length",
        F.coalesce("crc", "cut_crc").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents").select("doc_id", "text"))
