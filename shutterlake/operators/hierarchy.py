"""Density hierarchy of vectors: spanning forest, condensed tree, stability selection.

Two rows reach each other at the larger of their distance and both core distances
(distance to the `min_samples`-th other row). The hierarchy is that of single
linkage on the reach, so it follows from a minimum spanning forest.

* `spanning_forest` runs Boruvka rounds. Each row keeps its nearest rows; as long
  as one of them is in another tree, and no unlisted row can be nearer, no search
  is needed. Only rows whose list is used up, and whose tree has no certain
  shorter edge, are searched, within the shortest edge that their tree is known
  to have; what they find is kept as well.
* `condensed_tree` merges the trees' edges from short to long. The shortest edges
  whose components have at most `task_edges` edges are merged at once, one task a
  component; each component goes on as a single node with a bounded state.
* `select_clusters` finds, from the table of clusters, those of greatest total
  stability, by pointer jumping, so a deep tree costs rounds of its logarithm.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.operators import kernels
from shutterlake.operators import neighbors as N
from shutterlake.operators.graph import connected_components
from shutterlake.operators.skew import sized_join, skew_join
from shutterlake.session import materialize, release

# Functions of this module travel with their tasks, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows kept as neighbours of each row.
LISTED = 8
#: Distances below this count as this, so that copies have a finite density.
LEAST = 10.0**-kernels.DECIMALS
TASK_EDGES = 1_000_000
PIVOTS = 1024

_EDGE = "id bigint, label bigint, nid bigint, nlabel bigint, w double"


# ---- spanning forest ---------------------------------------------------------------


def reachable(rows: DataFrame, min_samples: int = 1, metric: str = "cosine", **route) -> tuple[DataFrame, DataFrame]:
    """Rows with their core distance, and each one's nearest others (id, nid, distance, core, ncore, last).

    `rows` has id, vec and size (a row stands for so many copies). `last` is the
    distance below which no unlisted row lies, null if all rows are listed.
    """
    k = max(LISTED, min_samples + 1)
    near = materialize(N.knn_join(rows, rows, k + 1, metric=metric, carry=["size"], **route))
    w = W.partitionBy("id").orderBy("rank")
    held = near.withColumn("_held", F.sum("size").over(w))
    core = held.where(F.col("_held") > min_samples).groupBy("id").agg(F.min("distance").alias("core"))
    core = core.select("id", F.greatest("core", F.lit(0.0)).alias("core"))
    with_core = rows.join(core, "id", "left").select("id", "vec", "size", F.coalesce("core", F.lit(math.inf)).alias("core"))
    with_core = materialize(with_core)
    ends = near.groupBy("id").agg(F.max("distance").alias("_far"), F.count("*").alias("_n"))
    last = F.when(F.col("_n") > k, F.col("_far"))
    cores = with_core.select("id", "core")
    lists = (
        near.where(F.col("id") != F.col("nid"))
        .join(ends.select("id", last.alias("last")), "id")
        .join(cores, "id")
        .join(cores.select(F.col("id").alias("nid"), F.col("core").alias("ncore")), "nid")
        .select("id", "nid", F.round(F.greatest("distance", "core", "ncore", F.lit(0.0)), kernels.DECIMALS).alias("w"), "last")
    )
    return with_core, materialize(lists)


def spanning_forest(
    rows: DataFrame,
    lists: DataFrame,
    max_distance: float | None = None,
    metric: str = "cosine",
    **route,
) -> tuple[DataFrame, list[dict]]:
    """(u, v, w) edges of a minimum spanning forest, and how many rows each round searched.

    Ties are settled by the ids of the ends; an edge too many among ties closes a
    circle and changes nothing later. With a maximum distance, trees further apart
    stay apart.
    """
    labels = materialize(rows.select("id", F.col("id").alias("label")))
    pivots = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("id", "vec", "core")
    pivots = materialize(pivots)
    normalize = metric == "cosine"
    chosen: list[DataFrame] = []
    rounds: list[dict] = []
    learnt_before = False
    n = rows.count()
    while True:
        other = labels.select(F.col("id").alias("nid"), F.col("label").alias("nlabel"))
        known = sized_join(lists.join(labels, "id"), other, ["nid"], n * LISTED)
        if max_distance is not None:
            known = known.where(F.col("w") <= max_distance)
        edge = F.struct("w", F.least("id", "nid").alias("u"), F.greatest("id", "nid").alias("v"), "nlabel")
        per_row = known.groupBy("id", "label").agg(
            F.min(F.when(F.col("label") != F.col("nlabel"), edge)).alias("e"), F.max("last").alias("last")
        )
        per_row = materialize(per_row)
        upper = materialize(per_row.where("e IS NOT NULL").groupBy("label").agg(F.min("e").alias("e")))
        # A row must be searched if an unlisted row may be nearer than its tree's best edge.
        open_rows = (
            per_row.where(F.col("last").isNotNull() & (F.col("e").isNull() | (F.col("e.w") > F.col("last"))))
            .select("id", "label", "last")
            .join(upper.select("label", F.col("e.w").alias("bound")), "label", "left")
            .where(F.col("bound").isNull() | (F.col("last") <= F.col("bound")))
        )
        if max_distance is not None:
            open_rows = open_rows.where(F.col("last") <= max_distance)
        left = materialize(open_rows.join(rows, "id").select("id", "vec", "core", "label", "bound"))
        searched = left.count()
        best = upper
        if searched:
            side = materialize(rows.join(labels, "id").select("id", "vec", "core", "label"))
            # A bound for trees without any known edge: the nearest of a few rows of other trees.
            marks = pivots.join(labels, "id")
            far, _ = N.similarity_join(
                left.drop("bound"), marks, kernels.nearest_other, _EDGE, normalize=normalize,
                metric=metric, broadcast_bytes=N.BROADCAST_BYTES,
            )
            reach = F.least("bound", "far", F.lit(max_distance if max_distance is not None else math.inf))
            far = far.groupBy("label").agg(F.min("w").alias("far"))
            reach = F.coalesce(reach, F.lit(math.inf)) + 10 * LEAST
            left = left.join(far, "label", "left").withColumn("_reach", F.sqrt(2 * reach) if normalize else reach)
            left = materialize(left.select("id", "vec", "core", "label", "_reach"))
            found, _ = N.similarity_join(
                left, side, kernels.nearest_other, _EDGE, normalize=normalize,
                metric=metric, cut=max_distance, radius="_reach", **route,
            )
            found = materialize(found)
            at_last = upper.unionByName(found.select("label", edge.alias("e")))
            best = materialize(at_last.groupBy("label").agg(F.min("e").alias("e")))
            # What was found stays known: no other tree's row is nearer than that, or than the reach.
            nearest = found.groupBy("id").agg(F.min_by(F.struct("nid", "w"), F.struct("w", "nid")).alias("f"))
            learnt = left.join(nearest, "id", "left").select(
                "id",
                F.coalesce("f.nid", "id").alias("nid"),
                F.coalesce("f.w", F.lit(math.inf)).alias("w"),
                F.coalesce("f.w", F.pow("_reach", 2) / 2 if normalize else F.col("_reach")).alias("last"),
            )
            grown = materialize(lists.unionByName(learnt))
            if learnt_before:
                release(lists)
            lists, learnt_before = grown, True
        rounds.append({"round": len(rounds), "searched": searched, "trees": best.count()})
        if not rounds[-1]["trees"]:
            break
        edges = materialize(best.select("e.u", "e.v", "e.w").distinct())
        chosen.append(edges)
        links = best.select(F.col("label").alias("src"), F.col("e.nlabel").alias("dst"))
        ends = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
        to = connected_components(ends, links).select(F.col("id").alias("label"), F.col("component").alias("_to"))
        moved = skew_join(labels, to, ["label"], "left")
        new = materialize(moved.select("id", F.coalesce("_to", "label").alias("label")))
        release(labels, per_row)
        labels = new
        if labels.select("label").distinct().limit(2).count() < 2:
            break
    if not chosen:
        empty = rows.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("w")).limit(0)
        return empty, rounds
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return materialize(out.distinct()), rounds


# ---- condensed tree ----------------------------------------------------------------

NODE = "node bigint, size bigint, cluster bigint, total double, below double, loose array<bigint>"
CLUSTER = "cluster bigint, parent bigint, birth double, size bigint, stability double, own boolean"
_FOUND = f"kind string, {NODE}, parent bigint, birth double, stability double, own boolean, point bigint"


def _merge_component(min_size: int):
    """Merge the nodes of one component along its edges, from short to long."""
    schema = N._arrow_schema(_FOUND)

    def task(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        state = {r["node"]: [r["size"], r["cluster"], r["total"], r["below"], r["loose"]] for r in nodes.select(
            ["node", "size", "cluster", "total", "below", "loose"]).to_pylist()}
        up = {x: x for x in state}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        u, v, w, e = (edges.column(c).to_numpy() for c in ("u", "v", "w", "edge"))
        order = np.lexsort((e, w))
        at = 0
        while at < len(order):
            end = at
            while end < len(order) and w[order[end]] == w[order[at]]:
                end += 1
            # All merges of one distance are one step: the parts of each new node, and its first edge.
            joined: dict = {}
            first: dict = {}
            for i in order[at:end]:
                a, b = find(int(u[i])), find(int(v[i]))
                if a == b:
                    continue
                low, high = min(a, b), max(a, b)
                up[high] = low
                parts = joined.pop(low, [low]) + joined.pop(high, [high])
                joined[low] = parts
                first[low] = min(first.pop(low, int(e[i])), first.pop(high, int(e[i])), int(e[i]))
            height = float(w[order[at]])
            density = 1.0 / max(height, LEAST)
            for low, parts in joined.items():
                held = [state.pop(p) for p in parts]
                size = sum(h[0] for h in held)
                big = [h for h in held if h[1] is not None]
                loose = [x for h in held if h[1] is None for x in h[4]]
                small = sum(h[0] for h in held if h[1] is None)
                if not big and size < min_size:
                    state[low] = [size, None, 0.0, 0.0, loose]
                    continue
                if len(big) == 1:
                    _, cluster, total, below, _ = big[0]
                    total += small * density
                else:
                    cluster, total, below = first[low], size * density, 0.0
                    for n, c, t, b, _ in big:
                        stable = t - n * density
                        own = not b > stable
                        below += max(stable, b)
                        out.append({"kind": "c", "cluster": c, "parent": cluster, "birth": height, "size": n, "stability": stable, "own": own})
                out += [{"kind": "p", "point": x, "cluster": cluster} for x in loose]
                state[low] = [size, cluster, total, below, []]
            at = end
        for node, (size, cluster, total, below, loose) in state.items():
            out.append({"kind": "n", "node": node, "size": size, "cluster": cluster, "total": total, "below": below, "loose": loose})
        return pa.Table.from_pylist(out, schema=schema)

    return task


def condensed_tree(
    rows: DataFrame, edges: DataFrame, min_size: int = 2, task_edges: int = TASK_EDGES
) -> tuple[DataFrame, DataFrame]:
    """The table of clusters (all but the roots) and (id, cluster) of every row that has one.

    A cluster is a component of at least `min_size` rows that ends where it meets
    another such one, at `birth`; its stability is the sum over its rows of
    density where the row leaves, less density at birth. Rows with the same
    distance to several clusters merge with all of them at once. A component is
    merged by one task only if it has at most `task_edges` edges, save that edges
    of one length are never told apart.
    """
    born = F.col("size") >= min_size
    nodes = rows.select(
        F.col("id").alias("node"),
        "size",
        F.when(born, -1 - F.monotonically_increasing_id()).alias("cluster"),
        F.when(born, F.col("size") / LEAST).otherwise(0.0).alias("total"),
        F.lit(0.0).alias("below"),
        F.when(born, F.array().cast("array<bigint>")).otherwise(F.array("id")).alias("loose"),
    )
    nodes = materialize(nodes)
    points = [materialize(nodes.where("cluster IS NOT NULL").select(F.col("node").alias("id"), "cluster"))]
    clusters: list[DataFrame] = []
    left = materialize(edges.withColumn("edge", F.monotonically_increasing_id()))
    n = left.count()
    while n:
        taken, placed = _shortest(left, n, task_edges)
        by_node = placed.withColumnRenamed("id", "node")
        found = materialize(
            nodes.join(by_node, "node")
            .groupBy("component")
            .cogroup(
                skew_join(taken.withColumn("node", F.col("u")), by_node, ["node"])
                .select("component", "u", "v", "w", "edge")
                .groupBy("component")
            )
            .applyInArrow(_merge_component(min_size), _FOUND)
        )
        clusters.append(found.where("kind = 'c'").select("cluster", "parent", "birth", "size", "stability", "own"))
        points.append(found.where("kind = 'p'").select(F.col("point").alias("id"), "cluster"))
        grown = found.where("kind = 'n'").select("node", "size", "cluster", "total", "below", "loose")
        new = materialize(nodes.join(by_node, "node", "left_anti").unionByName(grown))
        rest = left.join(taken.select("edge"), "edge", "left_anti")
        for end in ("u", "v"):
            to = by_node.select(F.col("node").alias(end), F.col("component").alias("_to"))
            rest = skew_join(rest, to, [end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        rest = materialize(rest.where("u <> v"))
        release(nodes, left)
        nodes, left, n = new, rest, rest.count()
    out = points[0]
    for more in points[1:]:
        out = out.unionByName(more)
    if not clusters:
        return rows.sparkSession.createDataFrame([], CLUSTER), out
    table = clusters[0]
    for more in clusters[1:]:
        table = table.unionByName(more)
    return table, out


def _shortest(edges: DataFrame, n: int, task_edges: int) -> tuple[DataFrame, DataFrame]:
    """The shortest edges whose components are small enough, and the components of their ends."""
    share = 1.0
    while True:
        taken = edges
        if share < 1:
            limit = edges.agg(F.percentile_approx("w", share, 100_000).alias("x")).head()["x"]
            taken = edges.where(F.col("w") <= limit)
        taken = materialize(taken)
        ends = taken.select(F.col("u").alias("id")).unionByName(taken.select(F.col("v").alias("id"))).distinct()
        placed = materialize(connected_components(ends, taken.select(F.col("u").alias("src"), F.col("v").alias("dst"))))
        if n <= task_edges:
            return taken, placed
        most = placed.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).head()["n"]
        one_length = taken.agg((F.min("w") == F.max("w")).alias("x")).head()["x"]
        if most - 1 <= task_edges or one_length:
            return taken, placed
        release(taken, placed)
        share /= 2


# ---- selection ---------------------------------------------------------------------


def climb(table: DataFrame) -> DataFrame:
    """(id, top): follow `up` until a row that points to itself, by doubling the steps."""
    now = materialize(table.select("id", F.col("up").alias("top")))
    while True:
        step = now.select(F.col("id").alias("top"), F.col("top").alias("_next"))
        moved = F.col("_next") != F.col("top")
        new = materialize(skew_join(now, step, ["top"]).select("id", F.col("_next").alias("top"), moved.alias("moved")))
        release(now)
        now = new
        if now.where("moved").isEmpty():
            return now.select("id", "top")


def select_clusters(tree: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """(cluster, chosen): the chosen cluster that each cluster is part of, null for none.

    Chosen are the clusters of greatest total stability (a cluster against the
    best choice inside it). One born below `epsilon` gives way to the first one
    around it that is born above, or the outermost one. Roots are never chosen.
    """
    tree = materialize(tree)
    known = tree.select(F.col("cluster").alias("parent"), F.lit(True).alias("_closed"))
    nodes = materialize(
        skew_join(tree, known, ["parent"], "left").select(
            F.col("cluster").alias("id"), F.when(F.col("_closed"), F.col("parent")).alias("over"), "birth", "own"
        )
    )
    # The outermost own cluster: climb to the nearest own one, then from own one to own one.
    stay = F.coalesce("over", "id")
    own = climb(nodes.select("id", F.when(F.col("own"), F.col("id")).otherwise(stay).alias("up")))
    own = own.join(nodes.select(F.col("id").alias("top"), "own"), "top").where("own").select("id", F.col("top").alias("near"))
    own = materialize(own)
    outer = nodes.where("own").join(own.select(F.col("id").alias("over"), F.col("near").alias("next")), "over", "left")
    top = climb(outer.select("id", F.coalesce("next", "id").alias("up")))
    best = top.select(F.col("top").alias("id")).distinct().join(nodes, "id")
    raised = climb(nodes.select("id", F.when(F.col("birth") <= epsilon, stay).otherwise(F.col("id")).alias("up")))
    chosen = best.join(raised, "id").select(F.when(F.col("birth") < epsilon, F.col("top")).otherwise(F.col("id")).alias("id"))
    chosen = materialize(chosen.distinct().withColumn("chosen", F.lit(True)))
    up = F.when(F.col("chosen"), F.col("id")).otherwise(stay)
    ends = climb(nodes.join(chosen, "id", "left").select("id", up.alias("up")))
    return ends.join(chosen.select(F.col("id").alias("top"), "chosen"), "top", "left").select(
        F.col("id").alias("cluster"), F.when(F.col("chosen"), F.col("top")).alias("chosen")
    )
