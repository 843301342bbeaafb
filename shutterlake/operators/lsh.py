"""Approximate similarity join: a hash index of random hyperplanes with exact re-check.

Every row gets, in each of several tables, a key of sign bits: on which side of
random hyperplanes it lies. Two unit vectors at an angle a agree in a bit with
probability 1 - a / pi, whatever the dimension, so bits and tables follow from the
distance limit and the wanted recall. Rows that share a key in any table are
compared exactly, so what is found is right, and only links may be missing.

Unlike the pivot cells of `neighbors`, whose planes reach nearly all cells in
high dimension, the work here depends on the angle alone. Buckets are cut into
blocks; a pair that shares several keys is met in each but returned by the first.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators import kernels
from shutterlake.operators import neighbors as N
from shutterlake.session import materialize

# Functions of this module travel with their tasks, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RECALL = 0.95
MAX_TABLES = 96
SEED = 7


def bit_agreement(max_distance: float) -> float:
    """Probability that a random hyperplane leaves two vectors at this cosine distance on one side."""
    return 1 - math.acos(max(-1.0, min(1.0, 1 - max_distance))) / math.pi


def tables_for(bits: int, max_distance: float, recall: float) -> int:
    """Tables needed so that a pair at the limit shares a key with this probability."""
    hit = bit_agreement(max_distance) ** bits
    if hit >= 1:
        return 1
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit > 0 else 10**9


def choose_keys(rows: int, max_distance: float, recall: float = RECALL, max_tables: int = MAX_TABLES) -> tuple[int, int]:
    """(bits, tables) of least work: keys to shuffle, and rows met by chance in a bucket.

    Chance is that of vectors at a right angle, which agree in half of the bits.
    """
    best, least = (0, 1), math.inf
    for bits in range(63):
        tables = tables_for(bits, max_distance, recall)
        if tables > max_tables:
            break
        # A key costs about as much as a hundred comparisons.
        work = tables * (100 + rows / 2.0**bits)
        if work < least:
            best, least = (bits, tables), work
    return best


def hash_keys(m: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """One key of sign bits per row and table, different in each table."""
    planes = np.random.default_rng(seed).normal(size=(m.shape[1], tables, bits)) if m.shape[1] else np.zeros((0, tables, bits))
    side = np.einsum("nd,dtb->ntb", m, planes, optimize=True) >= 0
    keys = side @ (np.int64(1) << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(m), tables), np.int64)
    return keys * np.int64(tables) + np.arange(tables)


def _code_type(bits: int) -> str:
    """Smallest type of the bits of a key, as codes travel with every copy of a row."""
    return next(t for t, width in (("u1", 8), ("u2", 16), ("u4", 32), ("u8", 64)) if bits <= width)


def _keyed(rows: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    ddl = "id bigint, vec array<double>, keys array<bigint>, codes binary"
    schema = N._arrow_schema(ddl)

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = hash_keys(kernels.matrix(part.column("vec"), True), bits, tables, seed)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), pa.array(keys.ravel())
                )
                codes = (keys // tables).astype(_code_type(bits))
                cols = [part.column("id"), part.column("vec"), lists, pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return rows.select("id", "vec").mapInArrow(scan, ddl)


def approximate_pairs(
    rows: DataFrame,
    max_distance: float,
    recall: float = RECALL,
    closed: bool = True,
    bits: int | None = None,
    seed: int = SEED,
    block_rows: int = N.BLOCK_ROWS,
) -> DataFrame:
    """(src < dst, distance) of rows (id, vec) within the cosine distance.

    Every pair in the result is within it; of those that are, `recall` or more
    are expected, the more the nearer they are.
    """
    rows = materialize(rows.select("id", "vec"))
    if bits is None:
        bits, tables = choose_keys(rows.count(), max_distance, recall)
    else:
        tables = tables_for(bits, max_distance, recall)
    keyed = materialize(_keyed(rows, bits, tables, seed))
    # A row is sent once to each block of its bucket, so blocks are as large as a tile; a task compares them in pieces.
    block_rows = max(block_rows, min(math.ceil(rows.count() / N.TILES), N.TILE_BYTES // (8 * max(1, N._width(rows)))))
    code = _code_type(bits)
    in_table = keyed.select("id", F.explode("keys").alias("key"))
    sizes = in_table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes.select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("nb")))
    own = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    placed = (
        in_table.join(sizes, "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select(
            "id", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
        .join(keyed.drop("keys"), "id")
    )
    ddl = "src bigint, dst bigint, distance double"
    schema = N._arrow_schema(ddl)

    def check(t: pa.Table) -> pa.Table:
        ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
        crossed = t.column("i")[0] != t.column("j")[0]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if crossed else left
        m = kernels.matrix(t.column("vec"), True)
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), code).reshape(len(ids), -1)
        table = t.column("key")[0].as_py() % tables
        found = {"src": [], "dst": [], "distance": []}
        step = max(1, kernels.CHUNK // max(1, len(right)))
        for at in range(0, len(left), step):
            l = left[at : at + step]
            d = 1.0 - m[l] @ m[right].T
            hit = kernels.within(d, max_distance, closed)
            hit &= ids[l][:, None] != ids[right][None, :] if crossed else ids[l][:, None] < ids[right][None, :]
            a, b = np.nonzero(hit)
            x, y, far = l[a], right[b], d[a, b]
            # A pair belongs to the first key that it shares.
            equal = codes[x] == codes[y]
            first = equal.argmax(1) == table if len(x) else np.zeros(0, bool)
            found["src"].append(np.minimum(ids[x], ids[y])[first])
            found["dst"].append(np.maximum(ids[x], ids[y])[first])
            found["distance"].append(far[first])
        return pa.table({c: pa.array(np.concatenate(v) if v else [], schema.field(c).type) for c, v in found.items()})

    return placed.groupBy("key", "i", "j").applyInArrow(check, ddl)


def measured_recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(exact, found, wrong, recall): how many of the exact pairs were found, and pairs that are none."""
    both = exact.select("src", "dst", F.lit(1).alias("_e")).join(
        found.select("src", "dst", F.lit(1).alias("_f")), ["src", "dst"], "full"
    )
    e, f = F.count("_e"), F.count_if(F.col("_e").isNotNull() & F.col("_f").isNotNull())
    return both.agg(
        e.alias("exact"), f.alias("found"), F.count_if(F.col("_e").isNull()).alias("wrong"),
        F.coalesce(F.try_divide(f, e), F.lit(1.0)).alias("recall"),
    )
