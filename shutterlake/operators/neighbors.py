"""Exact similarity joins on vector tables.

Two routes give the same rows:

* the right side is measured to fit `BROADCAST_BYTES`: it is broadcast as one
  matrix and the left side is scanned in place, without a shuffle;
* otherwise both sides go to cells around sampled pivots. Cells are gathered into
  tiles of bounded size (large ones are cut), and a left row goes once to each tile
  with a cell that its search radius can reach. A task joins a tile with a part of
  its left rows, block by block, so the rows moved are those of tiles, not of blocks.

A task returns only what the operator needs (k best, component links, counts),
never all pairs it saw.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shutterlake.functions import vectors as V
from shutterlake.operators import kernels
from shutterlake.session import BROADCAST_BYTES, materialize

BLOCK_ROWS = 2048
MAX_PIVOTS = 2048
#: A tile holds so many bytes of vectors at most, or about one part in TILES of a smaller table.
TILE_BYTES = 16 * 1024 * 1024
TILES = 16

DEFAULTS = {
    "metric": "cosine",
    "cut": None,
    "closed": False,
    "k": 1,
    "skip_self": False,
    "carry": (),
    "cap": None,
    "both": None,
}


def vector_rows(df: DataFrame, key: str, vector: str, extra: Sequence[str] = ()) -> DataFrame:
    """(id, vec, extra...) rows with a usable vector."""
    return df.where(V.usable_vector(F.col(vector))).select(
        F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec"), *extra
    )


def radius_of(distance: float, metric: str) -> float:
    """L2 reach that covers a distance of the metric (cosine on vectors of length <= 1)."""
    return distance if metric == "euclidean" else math.sqrt(2 * max(distance, 0.0))


def _arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _width(rows: DataFrame) -> int:
    first = rows.select(F.size("vec").alias("n")).head()
    return first["n"] if first else 0


def fits_broadcast(rows: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measured size of a vector table as a double matrix against the limit."""
    return rows.count() * max(_width(rows), 1) * 8 <= limit


def _broadcast_join(
    left: DataFrame, right: DataFrame, kernel: Callable, ddl: str, opt: dict, normalize: bool
) -> DataFrame:
    table = right.toArrow()
    side = left.sparkSession.sparkContext.broadcast(
        (kernels.columns(table), kernels.matrix(table["vec"], normalize))
    )
    schema, links = _arrow_schema(ddl), kernel is kernels.star_edges

    def scan(batches):
        cols, rm = side.value
        step = max(1, kernels.CHUNK // max(1, len(rm)))
        for batch in batches:
            if len(rm) == 0 or batch.num_rows == 0:
                continue
            lm = kernels.matrix(batch.column("vec"), normalize)
            blocks = ((slice(at, at + step), slice(None)) for at in range(0, len(lm), step))
            out = kernels.run_blocks(kernel, links, blocks, kernels.columns(batch), lm, cols, rm, opt)
            yield from kernels.to_table(out, schema).to_batches()

    return left.mapInArrow(scan, ddl)


def _pivots(right: DataFrame, n: int, block_rows: int, normalize: bool) -> np.ndarray:
    """A hash-ordered sample of at most MAX_PIVOTS distinct vectors."""
    want = min(MAX_PIVOTS, max(1, math.ceil(n / block_rows)))
    table = right.orderBy(F.xxhash64("id"), "id").limit(want).select("vec").toArrow()
    return np.unique(kernels.matrix(table["vec"], normalize), axis=0)


def home_cells(rows: DataFrame, pivots: np.ndarray, normalize: bool) -> DataFrame:
    """Add the cell (nearest pivot) of each row as `home`."""
    side = rows.sparkSession.sparkContext.broadcast(pivots)
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ddl = names + ", home INT"
    schema = _arrow_schema(ddl)

    def scan(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            home = kernels.homes(kernels.matrix(batch.column("vec"), normalize), side.value)
            cols = [*batch.columns, pa.array(home)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return rows.mapInArrow(scan, ddl)


def _tiles(sizes: dict[int, int], n_cells: int, limit: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First tile and number of tiles of each cell, and the cells of each tile.

    Small cells share a tile, a larger one is cut into several; sizes has at most MAX_PIVOTS cells.
    """
    first, parts = np.zeros(n_cells, np.int32), np.ones(n_cells, np.int32)
    held: list[list[int]] = []
    room = 0
    for cell in sorted(sizes):
        n = sizes[cell]
        parts[cell] = -(-n // limit)
        if parts[cell] > 1 or n > room:
            first[cell] = len(held)
            held += [[cell] for _ in range(parts[cell])]
            room = 0 if parts[cell] > 1 else limit - n
        else:
            first[cell] = len(held) - 1
            held[-1].append(cell)
            room -= n
    return first, parts, [np.array(h) for h in held]


def _cell_join(
    left: DataFrame,
    right: DataFrame,
    kernel: Callable,
    ddl: str,
    opt: dict,
    normalize: bool,
    radius,
    symmetric: bool,
    block_rows: int,
    home_only: bool,
) -> DataFrame:
    spark, n = left.sparkSession, right.count()
    schema = _arrow_schema(ddl)
    pivots = _pivots(right, n, block_rows, normalize)
    lhome = materialize(home_cells(left, pivots, normalize))
    if left is right:
        # Renewed columns keep the two sides of the cogroup apart.
        rhome = lhome.select(*[F.col(c).alias(c) for c in [*right.columns, "home"]])
    else:
        rhome = materialize(home_cells(right, pivots, normalize))
    sizes = {r[0]: r[1] for r in rhome.groupBy("home").count().collect()}  # at most MAX_PIVOTS
    limit = max(block_rows, min(math.ceil(n / TILES), TILE_BYTES // (8 * max(1, _width(right)))))
    first, parts, held = _tiles(sizes, len(pivots), limit)
    side = spark.sparkContext.broadcast((pivots, held))

    def reach_of(table, k: int) -> np.ndarray:
        return table[radius].to_numpy() if isinstance(radius, str) else np.full(k, radius)

    def visited(batch) -> tuple[np.ndarray, np.ndarray]:
        """(row, tile) for each tile with a cell in reach."""
        pivots, held = side.value
        t = pa.Table.from_batches([batch])
        m, home = kernels.matrix(t["vec"], normalize), t["home"].to_numpy()
        cells = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        if home_only:
            go = home[:, None] == cells[None, :]
        else:
            go = kernels.cell_reach(m, home, reach_of(t, len(m)), pivots, cells)
        if symmetric:
            go &= cells[None, :] >= home[:, None]
        seen = [go[:, np.searchsorted(cells, h)].any(axis=1) for h in held]
        return np.nonzero(np.stack(seen, axis=1)) if held else (np.zeros(0, int),) * 2

    def pieces(batches):
        rows = max(16, min(1024, 65_536 // max(1, len(side.value[1]))))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def count(batches):
        total = np.zeros(len(side.value[1]), np.int64)
        for piece in pieces(batches):
            np.add.at(total, visited(piece)[1], 1)
        yield pa.RecordBatch.from_pydict({"tile": pa.array(np.arange(len(total), dtype=np.int32)), "n": pa.array(total)})

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lhome.schema)
    spread_schema = _arrow_schema(names + ", tile INT")

    def spread(batches):
        for piece in pieces(batches):
            row, tile = visited(piece)
            cols = [*piece.take(pa.array(row)).columns, pa.array(tile.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, spread_schema)], schema=spread_schema)

    # Parts of the left rows of each tile, so that a task holds two of about one size.
    met = lhome.mapInArrow(count, "tile INT, n BIGINT").groupBy("tile").agg(F.sum("n").alias("n")).where("n > 0")
    met = met.select("tile", F.ceil(F.col("n") / limit).cast("int").alias("lb"))
    met = F.broadcast(materialize(met))
    placing = [(c, int(first[c]), int(parts[c])) for c in sorted(sizes)]
    placing = F.broadcast(spark.createDataFrame(placing, "home INT, first INT, parts INT"))
    spot = F.xxhash64("id")
    lt = (
        lhome.mapInArrow(spread, names + ", tile INT")
        .join(met, "tile")
        .withColumn("i", F.pmod(spot, F.col("lb")).cast("int"))
    )
    rt = (
        rhome.join(placing, "home")
        .withColumn("tile", (F.col("first") + F.pmod(spot, F.col("parts"))).cast("int"))
        .join(met, "tile")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lb") - 1)))
    )
    keys = ["tile", "i"]
    lt = lt.select(*keys, "home", *left.columns)
    rt = rt.select(*keys, "home", *right.columns)
    links = kernel is kernels.star_edges

    def task(lpart, rpart):
        if lpart.num_rows == 0 or rpart.num_rows == 0:
            return schema.empty_table()
        # Rows of one cell side by side.
        lpart, rpart = lpart.sort_by("home"), rpart.sort_by("home")
        lcols, rcols = kernels.columns(lpart), kernels.columns(rpart)
        lm, rm = kernels.matrix(lpart["vec"], normalize), kernels.matrix(rpart["vec"], normalize)
        reach = reach_of(lpart, len(lm))
        blocks = kernels.tile_blocks(lm, lcols["home"], reach, rcols["home"], side.value[0], symmetric, home_only, links)
        out = kernels.run_blocks(kernel, links, blocks, lcols, lm, rcols, rm, opt)
        return kernels.to_table(out, schema) if out else schema.empty_table()

    return lt.groupBy(*keys).cogroup(rt.groupBy(*keys)).applyInArrow(task, ddl)


def similarity_join(
    left: DataFrame,
    right: DataFrame,
    kernel: Callable,
    ddl: str,
    normalize: bool = True,
    symmetric: bool = False,
    radius=None,
    block_rows: int = BLOCK_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    home_only: bool = False,
    **opt,
) -> tuple[DataFrame, bool]:
    """Run a kernel over every block pair in reach.

    Returns the rows and whether each left row was seen by a single call (then
    per-row results need no merge).
    """
    opt = {**DEFAULTS, **opt}
    if not home_only and fits_broadcast(right, broadcast_bytes):
        return _broadcast_join(left, right, kernel, ddl, opt, normalize), True
    if radius is None:
        radius = math.inf if opt["cut"] is None else radius_of(opt["cut"], opt["metric"])
    return (
        _cell_join(
            left, right, kernel, ddl, opt, normalize, radius, symmetric, block_rows, home_only
        ),
        False,
    )


def _keep_k(rows: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("id").orderBy("distance", "nid")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join(
    left: DataFrame,
    right: DataFrame,
    k: int,
    max_distance: float | None = None,
    closed: bool = False,
    metric: str = "cosine",
    include_self: bool = True,
    carry: Sequence[str] = (),
    normalize: bool | None = None,
    **route,
) -> DataFrame:
    """(id, nid, distance, rank): the k nearest right rows of every left row.

    Inputs are `vector_rows`. With a maximum distance only rows below it (or at
    it, when closed) count. Without one, a first round inside each row's own
    cell gives the distance its k-th neighbour cannot exceed, and that becomes
    its search radius in the full round.
    """
    types = {f.name: f.dataType.simpleString() for f in right.schema}
    ddl = "id bigint, nid bigint, distance double" + "".join(f", {c} {types[c]}" for c in carry)
    args = {
        "normalize": metric == "cosine" if normalize is None else normalize,
        "cut": max_distance,
        "closed": closed,
        "metric": metric,
        "skip_self": not include_self,
        "carry": tuple(carry),
        "k": k,
        **route,
    }
    limit = route.get("broadcast_bytes", BROADCAST_BYTES)
    if max_distance is None and not fits_broadcast(right, limit):
        near, _ = similarity_join(
            left, right, kernels.nearest_k, ddl, radius=0.0, home_only=True, **args
        )
        kth = _keep_k(near, k).where(F.col("rank") == k)
        reach = F.sqrt(2 * F.col("_d")) if metric == "cosine" else F.col("_d")
        bound = kth.select("id", F.col("distance").alias("_d"))
        left = materialize(
            left.join(bound, "id", "left")
            .withColumn("_reach", F.coalesce(reach, F.lit(math.inf)))
            .drop("_d")
        )
        args["radius"] = "_reach"
    found, complete = similarity_join(left, right, kernels.nearest_k, ddl, **args)
    return _keep_k(found, k)


def component_edges(
    rows: DataFrame,
    max_distance: float,
    closed: bool = False,
    metric: str = "cosine",
    cap: int | None = None,
    both: str | None = None,
    **route,
) -> DataFrame:
    """(src, dst) links with the components of the graph "distance within the cut".

    `cap` limits the sum of the `size` columns of a pair, `both` names a boolean
    column that must hold on both ends.
    """
    edges, _ = similarity_join(
        rows,
        rows,
        kernels.star_edges,
        "src bigint, dst bigint",
        normalize=metric == "cosine",
        symmetric=True,
        cut=max_distance,
        closed=closed,
        metric=metric,
        cap=cap,
        both=both,
        **route,
    )
    return edges


def similar_pairs(
    rows: DataFrame,
    max_distance: float,
    closed: bool = True,
    metric: str = "cosine",
    cap: int | None = None,
    **route,
) -> DataFrame:
    """The pair list (src < dst, distance) itself."""
    args = {
        "normalize": metric == "cosine",
        "cut": max_distance,
        "closed": closed,
        "metric": metric,
        "cap": cap,
        **route,
    }
    pairs, _ = similarity_join(
        rows, rows, kernels.all_hits, "src bigint, dst bigint, distance double", **args
    )
    return pairs


def neighbour_counts(
    rows: DataFrame, max_distance: float, closed: bool, metric: str, **route
) -> DataFrame:
    """(id, n): rows within the cut, the row itself included."""
    counts, _ = similarity_join(
        rows,
        rows,
        kernels.neighbour_counts,
        "id bigint, n bigint",
        normalize=metric == "cosine",
        cut=max_distance,
        closed=closed,
        metric=metric,
        **route,
    )
    return counts.groupBy("id").agg(F.sum("n").alias("n"))


def lowest_labels(
    left: DataFrame, right: DataFrame, max_distance: float, closed: bool, metric: str, **route
) -> DataFrame:
    """(id, label): smallest `label` of the right rows within the cut."""
    labels, _ = similarity_join(
        left,
        right,
        kernels.lowest_label,
        "id bigint, label bigint",
        normalize=metric == "cosine",
        cut=max_distance,
        closed=closed,
        metric=metric,
        **route,
    )
    return labels.groupBy("id").agg(F.min("label").alias("label"))


def separation_extremes(rows: DataFrame, **route) -> DataFrame:
    """Per identity (`label`): least cosine inside it, greatest to another identity."""
    found, _ = similarity_join(
        rows,
        rows,
        kernels.identity_extremes,
        "label bigint, intra_min double, inter_max double",
        **route,
    )
    return found.groupBy("label").agg(
        F.min(F.when(F.col("intra_min") < math.inf, F.col("intra_min"))).alias("intra_min"),
        F.max(F.when(F.col("inter_max") > -math.inf, F.col("inter_max"))).alias("inter_max"),
    )
