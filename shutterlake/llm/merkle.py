"""Merkle manifest of a table with incremental witnesses (operator 12).

Each row is a leaf, each group (here a language) a tree of its rows in id order:
while several nodes remain, every ARITY consecutive ones become the hash of their
hex digests. The subroots, in group order, are the leaves of one more tree, whose
root stands for the table.

A tree is cut into aligned blocks of ARITY ** HEIGHT positions, so that a block is
a whole subtree whatever stands beside it. A task appends a block's nodes one by
one and holds one open run a level. A run that fills closes: each of its nodes
becomes a witness entry (its place and its siblings) for all leaves under it, and
their hash is appended a level up. The roots of the blocks are appended in the
same way, as the nodes of the next round, until one node is left of each tree; the
subroots then make the last tree. Witnesses come down the same rounds: a block's
nodes get their own entries followed by those of the block's root. Only digests
and ids move between machines, and no task holds more than a block, however many
rows one group has.

A witness is bytes, leaf to root: per level one byte for the node's place in its
run, one for the number of siblings, and the siblings' digests of 32 bytes each.

Defined results: null groups are one group, ordered first; null ids come first in
their group; rows with the same id are ordered by their leaf, so equal rows may
change places without a change of any root; a null value is `-`, an empty text
`0:`; a row without an id is never tampered with; an empty table has no rows and
no root. Texts of any length are hashed whole, by Spark's own functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.text import ascii_lower, table
from shutterlake.operators.ordering import number_rows
from shutterlake.session import materialize

ARITY = 8
#: Levels of a block: 4096 leaves, at most 4 kB of witness each.
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of an answer table; a witness of 15 levels has 3.4 kB.
ROWS = 2048


def _hash(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


class OpenTree:
    """Nodes appended in order. Holds the open run of each level and the leaves' partial witnesses."""

    def __init__(self, nodes: Sequence[bytes] = (), keep: bool = True) -> None:
        self.keep = keep
        self.runs: list[list[tuple[bytes, int, int]]] = [[]]
        self.witnesses: list[list[bytes]] = []
        for d in nodes:
            self.append(d)

    def append(self, digest: bytes) -> None:
        n = len(self.witnesses)
        if self.keep:
            self.witnesses.append([])
        self._add(0, (digest, n, n + 1))

    def _add(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self.runs):
            self.runs.append([])
        self.runs[level].append(node)
        if len(self.runs[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        digests = [d for d, _, _ in run]
        if self.keep:
            for i, (_, first, end) in enumerate(run):
                entry = bytes((i, len(run) - 1)) + b"".join(digests[:i] + digests[i + 1 :])
                for w in self.witnesses[first:end]:
                    w.append(entry)
        self._add(level + 1, (_hash(digests), run[0][1], run[-1][2]))

    def finish(self, height: int | None = None) -> bytes:
        """Close the open runs up to this height, or until one node is left; returns that node."""
        level = 0
        while True:
            if level == height or (height is None and len(self.runs[level]) == 1 and level + 1 == len(self.runs)):
                return self.runs[level][0][0]
            if self.runs[level]:
                self._close(level)
            level += 1


def _in_order(t: pa.Table) -> pa.Table:
    return t.combine_chunks().sort_by("pos")


def _roots(t: pa.Table) -> pa.Table:
    """A block's root as one of several of its tree, and as the only one."""
    nodes = _in_order(t.select(["pos", "node"])).column("node").to_pylist()
    return pa.table(
        {
            "tree": t.column("tree")[:1].cast(pa.string()),
            "pos": t.column("block")[:1].cast(pa.int64()),
            "node": pa.array([OpenTree(nodes, keep=False).finish(HEIGHT)], pa.binary()),
            "only": pa.array([OpenTree(nodes, keep=False).finish()], pa.binary()),
        }
    )


def _descend(t: pa.Table, above: pa.Table) -> pa.Table:
    """The nodes of a block with their whole witnesses: the block's own entries, then those of its root."""
    t = _in_order(t).drop_columns(["block"])
    end = above.to_pylist()[0]
    tree = OpenTree(t.column("node").to_pylist())
    tree.finish(None if end["alone"] else HEIGHT)
    made = [b"".join([*w, end["witness"]]) for w in tree.witnesses]
    t = t.append_column("witness", pa.array(made, pa.binary()))
    for name in ("subroot", "root"):
        t = t.append_column(name, pa.array([end[name]] * len(t), pa.binary()))
    return t


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {ARITY**HEIGHT}"))


class Forest:
    """Trees over (tree, pos, node) and any more columns; pos counts from 0 in each tree.

    Closes the blocks, then the blocks of their roots, until each tree has one
    root. `nodes` is a written table; so is what each round keeps.
    """

    def __init__(self, nodes: DataFrame) -> None:
        self.rounds = [nodes]
        self.closed: list[DataFrame] = []
        while True:
            found = materialize(
                _blocked(self.rounds[-1].select("tree", "pos", "node"))
                .groupBy("tree", "block")
                .applyInArrow(_roots, "tree string, pos long, node binary, only binary")
            )
            # A tree with a block beyond the first one goes on.
            more = materialize(found.groupBy("tree").agg(F.max("pos").alias("last")).where("last > 0").select("tree"))
            self.closed.append(found.join(more, "tree", "left_anti").select("tree", F.col("only").alias("node")))
            if more.isEmpty():
                break
            self.rounds.append(materialize(found.join(more, "tree", "left_semi").select("tree", "pos", "node")))

    def roots(self) -> DataFrame:
        """(tree, node), one row per tree."""
        out = self.closed[0]
        for more in self.closed[1:]:
            out = out.unionByName(more)
        return out

    def witnesses(self, above: DataFrame | None = None) -> DataFrame:
        """All nodes with witness, subroot (of their tree) and root.

        `above` (tree, witness, subroot, root) continues the witnesses beyond a tree's root.
        """
        down = None
        for nodes, closed in reversed(list(zip(self.rounds, self.closed))):
            ends = closed.withColumnsRenamed({"node": "subroot"})
            if above is None:
                ends = ends.select("tree", F.lit(b"").alias("witness"), "subroot", F.col("subroot").alias("root"))
            else:
                ends = above.join(ends.select("tree"), "tree", "left_semi")
            ends = ends.select("tree", F.lit(0).cast("long").alias("block"), F.lit(True).alias("alone"), *ENDS)
            if down is not None:
                ends = ends.unionByName(
                    down.select("tree", F.col("pos").alias("block"), F.lit(False).alias("alone"), *ENDS)
                )
            schema = nodes.withColumns({c: F.lit(b"") for c in ENDS}).schema
            down = (
                _blocked(nodes)
                .groupBy("tree", "block")
                .cogroup(ends.groupBy("tree", "block"))
                .applyInArrow(_descend, schema)
            )
            if nodes is not self.rounds[0]:
                down = materialize(down)
        return down


ENDS = ("witness", "subroot", "root")


def leaf(fields: Sequence[Column]) -> Column:
    """The hex digest of a row's fields."""
    parts = []
    for c in fields:
        v = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(leaves: DataFrame, group: str, order: str, digest: str) -> DataFrame:
    """row (the columns of leaves), node (the leaf), witness, subroot and root, digests as bytes.

    `digest` is the column of hex digests, `group` has the trees, `order` the order in them.
    """
    held = leaves.select(
        F.struct(*[leaves[c] for c in leaves.columns]).alias("row"),
        F.coalesce(F.concat(F.lit("="), leaves[group].cast("string")), F.lit("")).alias("tree"),
        leaves[order].alias("by"),
        leaves[digest].alias("hex"),
    )
    numbered = number_rows(held, ["tree"], [F.col("by").asc(), F.col("hex").asc()])
    place = (F.col("rn") - 1).alias("pos")
    forest = Forest(materialize(numbered.select("row", "tree", place, F.unhex("hex").alias("node"))))
    # A null group's tree is named by the empty string, so it comes first; names are compared as bytes.
    subroots = number_rows(materialize(forest.roots()), [], [F.col("tree").asc()])
    top = Forest(materialize(subroots.select(F.lit("").alias("tree"), place, "node", F.col("tree").alias("of"))))
    above = top.witnesses().select(F.col("of").alias("tree"), "witness", F.col("node").alias("subroot"), "root")
    return forest.witnesses(materialize(above)).select("row", "node", *ENDS)


def fold(node: bytes, witness: bytes) -> bytes:
    """The root that a leaf and a witness lead to."""
    at, end = 0, len(witness)
    while at < end:
        i, n = witness[at], witness[at + 1]
        at += 2
        cut, stop = at + 32 * i, at + 32 * n
        node = hashlib.sha256((witness[at:cut] + node + witness[cut:stop]).hex().encode()).digest()
        at = stop
    return node


def siblings(witness: bytes) -> bytes:
    """All digests of a witness, leaf to root."""
    out, at = [], 0
    while at < len(witness):
        stop = at + 2 + 32 * witness[at + 1]
        out.append(witness[at + 2 : stop])
        at = stop
    return b"".join(out)


def verify(manifested: DataFrame, node: Column | None = None) -> DataFrame:
    """The columns of a manifest with folded (from `node`, its own leaf if none is given) and proof_sha256.

    `folded` equals `root` if the node is the leaf that the manifest was made of.
    """
    shown = manifested["node"] if node is None else node
    held = manifested.select("*", F.coalesce(shown, F.lit(b"")).alias("_shown"))
    schema = manifested.withColumns({"folded": F.lit(b""), "proof_sha256": F.lit("")}).schema

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                witness = part.column("witness").to_pylist()
                folded = [fold(n, w) for n, w in zip(part.column("_shown").to_pylist(), witness)]
                proofs = [hashlib.sha256(siblings(w).hex().encode()).hexdigest() for w in witness]
                columns = [part.column(c) for c in part.schema.names if c != "_shown"]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(folded, pa.binary()), pa.array(proofs, pa.string())],
                    names=[f.name for f in schema.fields],
                )

    return held.mapInArrow(run, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(*FIELDS)
    own = [F.col(c) for c in FIELDS]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    shown = [*own[:-1], F.when(changed, ascii_lower(F.col("text"))).otherwise(F.col("text"))]
    leaves = docs.select("doc_id", "lang", leaf(own).alias("leaf"), leaf(shown).alias("shown"))
    made = manifest(leaves, "lang", "doc_id", "leaf")
    out = verify(made, F.unhex(made["row.shown"]))
    return out.select(
        "row.doc_id",
        "row.leaf",
        *[F.lower(F.hex(c)).alias(c) for c in ("subroot", "root")],
        "proof_sha256",
        F.lower(F.hex("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )



def _sql_leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in (*FIELDS[:-1], text)]
    return "sha256(" + " || ".join(parts) + ")"


# The checksum goes over a list with each byte followed by eight marks, one for each shift.
_SQL_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(
    string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
_SQL_TREE = f"""
  SELECT tree, 0 AS level, pos, node, count(*) OVER (PARTITION BY tree) AS n FROM {{leaves}}
  UNION ALL
  SELECT tree, level + 1, pos // {ARITY}, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + {ARITY - 1}) // {ARITY}
  FROM {{nodes}} WHERE n > 1 GROUP BY tree, level, pos // {ARITY}"""
_SQL_STEPS = f"""
  SELECT l.tree, l.pos, x.level,
    coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (x.pos < l.pos // pow({ARITY}, x.level)::BIGINT), '') AS lhs,
    coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (x.pos > l.pos // pow({ARITY}, x.level)::BIGINT), '') AS rhs
  FROM {{leaves}} l JOIN {{nodes}} x ON x.tree = l.tree AND x.n > 1
   AND x.pos // {ARITY} = l.pos // pow({ARITY}, x.level + 1)::BIGINT
  GROUP BY l.tree, l.pos, x.level"""
SQL = f"""
WITH RECURSIVE
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_sql_leaf("text")} AS node,
    {_sql_leaf("CASE WHEN " + _SQL_CRC32 + " % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS shown
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM d),
nodes AS ({_SQL_TREE.format(leaves="l", nodes="nodes")}),
tops AS (SELECT '' AS tree, tree AS lang, row_number() OVER (ORDER BY tree) - 1 AS pos, node FROM nodes WHERE n = 1),
top AS ({_SQL_TREE.format(leaves="tops", nodes="top")}),
steps AS (
  SELECT l.tree, l.pos, row_number() OVER (PARTITION BY l.tree, l.pos ORDER BY s.up, s.level) AS k, s.lhs, s.rhs
  FROM l JOIN (
    SELECT tree, pos, 0 AS up, level, lhs, rhs FROM ({_SQL_STEPS.format(leaves="l", nodes="nodes")})
    UNION ALL
    SELECT i.tree, i.pos, 1, t.level, t.lhs, t.rhs FROM l i JOIN tops o ON o.lang = i.tree
      JOIN ({_SQL_STEPS.format(leaves="tops", nodes="top")}) t ON t.pos = o.pos) s
  ON s.tree = l.tree AND s.pos = l.pos),
proofs AS (SELECT tree, pos, max(k) AS k, string_agg(lhs || rhs, '' ORDER BY k) AS all_siblings FROM steps GROUP BY tree, pos),
folds AS (
  SELECT tree, pos, 0 AS k, shown AS node FROM l
  UNION ALL
  SELECT f.tree, f.pos, f.k + 1, sha256(s.lhs || f.node || s.rhs)
  FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.k = f.k + 1)
SELECT l.doc_id, l.node AS leaf, o.node AS subroot, r.node AS root, sha256(coalesce(p.all_siblings, '')) AS proof_sha256,
  f.node AS folded_root, f.node = r.node AS verified
FROM l JOIN tops o ON o.lang = l.tree JOIN top r ON r.n = 1
LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
JOIN folds f ON f.tree = l.tree AND f.pos = l.pos AND f.k = coalesce(p.k, 0)
"""
