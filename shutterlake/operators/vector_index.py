"""A stored vector index laid out by cell: searches open only the cells they can reach.

Folder layout:

* `pivots`  (cell, vec): unit vectors, fixed when the index is made;
* `cells`   (cell, n, reach): one row per cell and batch, `reach` the greatest
  distance of the batch's rows from their pivot;
* `rows`    partitioned by cell: (id, vec, carried columns), unit vectors.

A row lies in the cell of its nearest pivot, so rows are added by writing files
to the folders of their cells; nothing is rebuilt. A search knows from pivots and
reaches how near a cell's rows can be: it first opens the nearest cells that hold
k rows together, and then those that may hold a row nearer than the k-th found.
Results are exact. Distances are those of unit vectors, whose order is that of
the cosine.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.functions import vectors as V
from shutterlake.operators import kernels
from shutterlake.operators import neighbors as N
from shutterlake.operators.dedup import first_per_group
from shutterlake.session import materialize

# Functions of this module travel with their tasks, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that a cell should hold, and cells at most: pivots are broadcast to place rows.
CELL_ROWS = 4096
MAX_CELLS = 4096
#: Rows of one file; a cell that holds more, such as one of many copies, is written in several.
FILE_ROWS = 65_536
#: Room for rounding of distances near zero.
SLACK = 1e-6


def _unit_rows(df: DataFrame, key: str, vector: str, carry: Sequence[str]) -> DataFrame:
    return df.where(V.usable_vector(F.col(vector))).select(
        F.col(key).alias("id"), V.unit(F.col(vector)).alias("vec"), *carry
    )


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add cell and the distance from its pivot."""
    side = rows.sparkSession.sparkContext.broadcast(pivots)
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ddl = names + ", cell INT, away DOUBLE"
    schema = N._arrow_schema(ddl)

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                m = kernels.matrix(part.column("vec"), True)
                sq = (side.value**2).sum(1)[None, :] - 2 * (m @ side.value.T)
                cell = sq.argmin(axis=1)
                away = np.sqrt(((m - side.value[cell]) ** 2).sum(1))
                cols = [*part.columns, pa.array(cell.astype(np.int32)), pa.array(away)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return rows.mapInArrow(scan, ddl)


def _append(rows: DataFrame, path: str, pivots: np.ndarray) -> None:
    placed = materialize(_placed(rows, pivots))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("reach"))
    sizes = materialize(sizes)
    # Rows of a cell lie together; a large cell is dealt out, so no task writes more than a file's rows.
    parts = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / FILE_ROWS).cast("int").alias("_parts")))
    dealt = placed.join(parts, "cell").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    dealt = dealt.repartition("cell", "_part").drop("_part", "_parts", "away").sortWithinPartitions("cell")
    dealt.write.mode("append").partitionBy("cell").parquet(f"{path}/rows")
    sizes.write.mode("append").parquet(f"{path}/cells")


def write_index(
    df: DataFrame,
    path: str,
    key: str = "id",
    vector: str = "embedding",
    carry: Sequence[str] = (),
    cell_rows: int = CELL_ROWS,
) -> None:
    """Make the index. Pivots are a hash-ordered sample of its rows, one per `cell_rows`.

    `cells` is written last of all, so an index that was not finished can't be searched.
    """
    rows = materialize(_unit_rows(df, key, vector, carry))
    want = min(MAX_CELLS, max(1, math.ceil(rows.count() / cell_rows)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(want).select("vec").toArrow()
    pivots = np.unique(kernels.matrix(sample["vec"], True), axis=0)
    listed = [(i, v.tolist()) for i, v in enumerate(pivots)]
    spark = df.sparkSession
    spark.createDataFrame(listed, "cell int, vec array<double>").write.parquet(f"{path}/pivots")
    _append(rows, path, pivots)


def _pivots(spark: SparkSession, path: str) -> np.ndarray:
    table = spark.read.parquet(f"{path}/pivots").orderBy("cell").toArrow()
    return kernels.matrix(table["vec"], False)


def add_rows(df: DataFrame, path: str, key: str = "id", vector: str = "embedding", carry: Sequence[str] = ()) -> None:
    """Add rows to the cells of a stored index. A row may be further from its pivot than any before."""
    pivots = _pivots(df.sparkSession, path)
    if not len(pivots):
        raise ValueError("the index was made without rows, so it has no cells")
    _append(_unit_rows(df, key, vector, carry), path, pivots)


def _cells(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots, row counts and reaches of all cells (at most MAX_CELLS)."""
    pivots = _pivots(spark, path)
    n, reach = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    stats = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"))
    for r in stats.collect():
        n[r["cell"]], reach[r["cell"]] = r["n"], r["reach"]
    return pivots, n, reach


def nearest_possible(m: np.ndarray, pivots: np.ndarray, n: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Least distance that a row of each cell can have from each query, infinite for empty cells.

    A row lies within the cell's reach of its pivot, and on the pivot's side of
    the plane to any other pivot.
    """
    size = (pivots**2).sum(1)
    sq = np.maximum((m * m).sum(1)[:, None] + size[None, :] - 2 * (m @ pivots.T), 0)
    least = np.sqrt(sq) - reach[None, :]
    home = sq.argmin(axis=1)
    between = size[home][:, None] + size[None, :] - 2 * (pivots[home] @ pivots.T)
    between = np.sqrt(np.maximum(between, 1e-300))
    ahead = (sq - sq[np.arange(len(m)), home][:, None]) / (2 * between)
    ahead[between < SLACK] = 0
    least = np.maximum(np.maximum(least, ahead), 0)
    least[:, n == 0] = np.inf
    return least


def _visits(queries: DataFrame, cells, k: int, opened: str | None) -> DataFrame:
    """(id, vec, cell): the first cells to open per query, or (given its k-th distance) those in reach beyond them."""
    side = queries.sparkSession.sparkContext.broadcast(cells)

    def scan(batches):
        pivots, n, reach = side.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                m = kernels.matrix(part.column("vec"), True)
                least = nearest_possible(m, pivots, n, reach)
                order = np.argsort((pivots**2).sum(1)[None, :] - 2 * (m @ pivots.T), axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1)
                # The cells of the nearest pivots that hold k rows, or all cells with rows.
                first = (held - n[order] < k) & (n[order] > 0)
                start = np.zeros(least.shape, bool)
                np.put_along_axis(start, order, first, axis=1)
                if opened is None:
                    go = start
                else:
                    far = part.column(opened).to_numpy(zero_copy_only=False)
                    go = (least <= far[:, None] + SLACK) & ~start & (n > 0)[None, :]
                row, cell = np.nonzero(go)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row)), part.column("vec").take(pa.array(row)), pa.array(cell.astype(np.int32))],
                    names=["id", "vec", "cell"],
                )

    return queries.mapInArrow(scan, "id bigint, vec array<double>, cell int")


def _folders(spark: SparkSession, path: str, wanted: Sequence[int]) -> DataFrame:
    """The rows of some cells; other cells' folders are not even listed."""
    base = f"{path}/rows"
    return spark.read.option("basePath", base).parquet(*[f"{base}/cell={c}" for c in wanted])


def _open(spark: SparkSession, path: str, visits: DataFrame, k: int, keep: Column | None) -> DataFrame:
    """The k best rows of the visited cells per query and block."""
    visits = materialize(visits)
    wanted = [r["cell"] for r in visits.select("cell").distinct().collect()]  # at most MAX_CELLS
    ddl = "id bigint, nid bigint, distance double"
    if not wanted:
        return spark.createDataFrame([], ddl)
    rows = _folders(spark, path, wanted)
    if keep is not None:
        rows = rows.where(keep)
    schema = N._arrow_schema(ddl)
    opt = {**N.DEFAULTS, "k": k}

    def best(batch: pa.RecordBatch, queries: pa.Table) -> pa.Table:
        lm, rm = kernels.matrix(queries.column("vec"), True), kernels.matrix(batch.column("vec"), True)
        out = kernels.nearest_k(kernels.columns(queries), lm, {"id": batch.column("id").to_numpy(zero_copy_only=False)}, rm, opt)
        return kernels.to_table(out, schema)

    if N.fits_broadcast(visits):
        # Few queries: the index is scanned where it lies.
        at = visits.toArrow()
        step = N.BLOCK_ROWS
        side = spark.sparkContext.broadcast({c: at.filter(pc.equal(at["cell"], c)) for c in wanted})

        def scan(batches):
            for batch in batches:
                cells = batch.column("cell").to_numpy(zero_copy_only=False)
                for c in np.unique(cells):
                    part = batch.filter(pa.array(cells == c))
                    for a in range(0, part.num_rows, step):
                        yield from best(part.slice(a, step), side.value[c]).to_batches()

        return rows.select("id", "vec", "cell").mapInArrow(scan, ddl)
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / N.BLOCK_ROWS).cast("bigint").alias("_rb"))
    asked = visits.groupBy("cell").agg(F.ceil(F.count("*") / N.BLOCK_ROWS).cast("bigint").alias("_qb"))
    plan = F.broadcast(materialize(sizes.join(asked, "cell")))
    spread = F.xxhash64("id")
    left = (
        visits.join(plan, "cell")
        .withColumn("i", F.pmod(spread, F.col("_qb")))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_rb") - 1)))
        .select("cell", "i", "j", "id", "vec")
    )
    right = (
        rows.join(plan, "cell")
        .withColumn("j", F.pmod(spread, F.col("_rb")))
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_qb") - 1)))
        .select("cell", "i", "j", "id", "vec")
    )

    def task(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return schema.empty_table()
        return best(block.combine_chunks().to_batches()[0], queries)

    keys = ["cell", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, ddl)


def search_index(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int,
    keep: Column | None = None,
) -> DataFrame:
    """(query_id, id, similarity, rank) of the k best index rows per query (id, vec).

    `keep` tests carried columns before ranking. Equal similarities go by id.
    """
    cells = _cells(spark, path)
    asked = queries.where(V.usable_vector(F.col("vec"))).select(
        F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")
    )
    if not len(cells[0]) or asked.isEmpty():
        return spark.createDataFrame([], "query_id bigint, id bigint, similarity double, rank int")
    asked = materialize(asked)
    first = _open(spark, path, _visits(asked, cells, k, None), k, keep)
    first = materialize(first)
    ranked = first_per_group(first, ["id"], [F.col("distance").asc(), F.col("nid").asc()], k)
    kth = ranked.groupBy("id").agg(F.count("*").alias("_n"), F.max("distance").alias("_far"))
    # Cosine distance d of unit vectors is an L2 distance of sqrt(2 d).
    far = F.when(F.col("_n") == k, F.sqrt(2 * F.greatest("_far", F.lit(0.0)))).otherwise(F.lit(math.inf))
    bounded = asked.join(kth, "id", "left").select("id", "vec", F.coalesce(far, F.lit(math.inf)).alias("_kth"))
    more = _open(spark, path, _visits(materialize(bounded), cells, k, "_kth"), k, keep)
    hits = first.unionByName(more).select(
        F.col("id").alias("query_id"), F.col("nid").alias("id"), (1 - F.col("distance")).alias("similarity"), "distance"
    )
    out = first_per_group(hits, ["query_id"], [F.col("distance").asc(), F.col("id").asc()], k)
    w = W.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(w)).drop("distance")


def files_opened(spark: SparkSession, path: str, queries: DataFrame, k: int) -> tuple[int, int]:
    """Files of the cells that a search opens, and files of the whole index."""
    cells = _cells(spark, path)
    asked = materialize(queries.select("id", F.col("vec").cast("array<double>").alias("vec")))
    hits = search_index(spark, path, queries, k)
    far = hits.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("similarity").alias("_s"))
    kth = F.when(F.col("_n") == k, F.sqrt(2 * F.greatest(1 - F.col("_s"), F.lit(0.0)))).otherwise(F.lit(math.inf))
    near = materialize(asked.join(far.select(F.col("query_id").alias("id"), kth.alias("_kth")), "id"))
    visits = _visits(asked, cells, k, None).unionByName(_visits(near, cells, k, "_kth"))
    wanted = [r["cell"] for r in visits.select("cell").distinct().collect()]
    opened = len(_folders(spark, path, wanted).inputFiles()) if wanted else 0
    return opened, len(spark.read.parquet(f"{path}/rows").inputFiles())
