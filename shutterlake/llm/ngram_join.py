"""N-gram Jaccard join by MinHash banding (operator 6).

Texts are sets of five-word shingles; two texts are linked if their sets have a
Jaccard similarity of THRESHOLD or more. Copies (equal word sequences) become one
representative with a count. Representatives get min-hashes in bands; band and
row counts follow from the target recall at the threshold. Texts that share a
band hash are candidates, and every candidate pair is verified on the full sets.

Pairs are never rows. Each representative first joins a cell, named by the
smallest representative it shares any bucket with, which gathers nearly all of a
group's pairs in one place. Buckets whose members lie in several cells verify
the pairs across cells, each in the first band that the pair shares. Cells and
buckets beyond a block are cut into blocks of bounded rows and bytes, a task
holds two blocks, and returns for each representative its number of links and
the smallest representative it is tied to there. Components of those ties are
the classes. Blocks hold all pairs whatever the group's size, so nothing is
capped; a group of m linked different texts costs (m / BLOCK)^2 block pairs.

Defined results: texts without words (null, empty, white space) are linked to
nothing; a text shorter than five words is one shingle; rows with the same id are
documents of their own; a null id sorts last; class_id is the smallest id in the
class, a row without links or copies has its own id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import shingles as S
from shutterlake.llm.text import SPACE, table, whole
from shutterlake.operators.graph import connected_components
from shutterlake.session import materialize

THRESHOLD = 0.8
#: Share of the pairs at the threshold that share a band; pairs above it do so more often.
RECALL = 0.9999
#: Hashes per text at most.
HASHES = 128
SEED = 20

BLOCK_ROWS = 256
BLOCK_BYTES = 4_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so fewest false candidates, that reach the recall."""
    best = None
    for rows in range(1, hashes + 1):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if miss > 0 else 1
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


def _signer(bands: int, rows: int):
    def sign(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in S.slices(texts):
                part = batch.slice(a, b - a)
                words, at = S.word_hashes(part.column("text"))
                sh, sat = S.shingle_hashes(words, at)
                low = S.min_hashes(sh, sat, bands * rows, SEED).reshape(-1, bands, rows)
                h = np.zeros(low.shape[:2], np.uint64)
                for j in range(rows):
                    h = S.mix(h * np.uint64(31) + low[:, :, j])
                h = S.mix(h + np.arange(1, bands + 1, dtype=np.uint64))
                n = np.diff(at)
                size = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                    pa.array(h.ravel().view(np.int64)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        part.column("th"),
                        pa.array(S.sequence_ids(words, at), pa.binary()),
                        lists,
                        pa.array(np.diff(sat), pa.int64()),
                    ],
                    names=["doc", "th", "rep", "bands", "n_shingles"],
                )

    return sign


SIGNED = "doc long, th long, rep binary, bands array<long>, n_shingles long"


def _links(threshold: float):
    """Verify the pairs of two blocks (side 0 and 1), or of one block with itself."""

    def verify(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = t.column("side").to_numpy()
        one_block = t.column("i")[0] == t.column("j")[0]
        if not one_block and (side == side[0]).all():
            # No member fell into the other block; the pairs of this one are verified by itself.
            return pa.table(
                {"rep": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.binary())}
            )
        texts = t.column("text").chunk(0)
        words, at = S.word_hashes(texts)
        sh, sat = S.shingle_hashes(words, at)
        n = len(texts)
        owner = np.repeat(np.arange(n), np.diff(sat))
        # Each text's distinct shingles; only those of two texts or more can meet.
        order = np.lexsort((owner, sh))
        sh, owner = sh[order], owner[order]
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
        sh, owner = sh[new], owner[new]
        sizes = np.bincount(owner, minlength=n)
        _, code, often = np.unique(sh, return_inverse=True, return_counts=True)
        shared = often[code] > 1
        code, owner = code[shared], owner[shared]
        column = np.cumsum(often > 1) - 1
        code = column[code]  # ascending, as the shingles are sorted
        left = np.arange(n) if one_block else np.flatnonzero(side == 0)
        right = left if one_block else np.flatnonzero(side == 1)
        inter = np.zeros((len(left), len(right)), np.float64)
        width = max(256, 4_000_000 // max(n, 1))
        total = int(code[-1]) + 1 if len(code) else 0
        for c in range(0, total, width):
            lo, hi = np.searchsorted(code, [c, c + width])
            m = np.zeros((n, min(width, total - c)), np.float32)
            m[owner[lo:hi], code[lo:hi] - c] = 1
            inter += m[left] @ m[right].T
        union = sizes[left][:, None] + sizes[right][None, :] - inter
        linked = (inter >= threshold * union - 1e-9) & (inter > 0)
        if one_block:
            linked = np.triu(linked, 1)
        i, j = np.nonzero(linked)
        i, j = left[i], right[j]
        if len(i) and t.column("kind")[0].as_py():
            cells = np.array(t.column("cell").to_pylist(), object)
            bands = np.array(t.column("bands").to_pylist(), np.int64)
            here = t.column("bucket")[0].as_py()
            keep = cells[i] != cells[j]
            i, j = i[keep], j[keep]
            equal = bands[i] == bands[j]
            first = bands[i, equal.argmax(1)] if len(i) else np.zeros(0, np.int64)
            keep = equal.any(1) & (first == here)
            i, j = i[keep], j[keep]
        copies = t.column("n").to_numpy()
        reps = t.column("rep").to_pylist()
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        # The smallest representative that each is tied to within the blocks.
        rank = np.empty(n, np.int64)
        by_rep = sorted(range(n), key=reps.__getitem__)
        rank[by_rep] = np.arange(n)
        low = rank.copy()
        while len(i):
            m = np.minimum(low[i], low[j])
            before = low.copy()
            np.minimum.at(low, i, m)
            np.minimum.at(low, j, m)
            low = np.minimum(low, low[np.array(by_rep)[low]])
            if (low == before).all():
                break
        some = np.flatnonzero(links)
        return pa.table(
            {
                "rep": pa.array([reps[x] for x in some], pa.binary()),
                "links": pa.array(links[some].astype(np.int64)),
                "root": pa.array([reps[by_rep[low[x]]] for x in some], pa.binary()),
            }
        )

    return verify


def _blocks(members: DataFrame) -> DataFrame:
    """Rows (kind, gid, i, j, side) + members: each member once for every block its own one meets.

    `members` is a written table with kind, gid, rep, bytes. Sizes are partial
    sums; the sizes are written too, so that a hot group's join can be split.
    """
    sizes = materialize(
        members.groupBy("kind", "gid")
        .agg(F.count("*").alias("m"), F.sum("bytes").alias("b"))
        .where("m > 1")
        .withColumn("nb", F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("b") / BLOCK_BYTES)).cast("int"))
        .select("kind", "gid", "nb")
    )
    own = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    return (
        members.join(sizes, ["kind", "gid"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select(
            "kind", "gid", "rep",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
    )


def classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """(doc, th, class_id, n_links, first) per input row.

    `doc` is the id (the largest long for null), `th` the text's 64-bit hash,
    n_links the number of other rows linked to it, copies included; `first` is
    true for one (doc, th) of each class: the smallest.
    """
    bands, rows = choose_bands(threshold, recall)
    read = docs.select(
        F.coalesce(docs[doc_id].cast("long"), F.lit(2**63 - 1)).alias("doc"), whole(docs[text]).alias("text")
    ).withColumn("th", F.xxhash64("text"))
    signed = materialize(read.mapInArrow(_signer(bands, rows), SIGNED))
    reps = materialize(
        signed.where(F.col("rep").isNotNull())
        .groupBy("rep")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("doc", "th")).alias("at"),
            F.first("bands").alias("bands"),
            F.first("n_shingles").alias("n_shingles"),
        )
    )
    in_bands = reps.select("rep", F.explode("bands").alias("h"))
    buckets = materialize(
        in_bands.groupBy("h").agg(F.count("*").alias("m"), F.min("rep").alias("low")).where("m > 1").drop("m")
    )
    met = materialize(in_bands.join(buckets, "h"))
    cells = materialize(met.groupBy("rep").agg(F.min("low").alias("cell")))
    in_cells = met.select("rep", "h").join(cells, "rep")
    mixed = materialize(
        in_cells.groupBy("h")
        .agg(F.min("cell").alias("a"), F.max("cell").alias("b"))
        .where(F.col("a") != F.col("b"))
        .select("h")
    )
    facts = reps.select("rep", "n", "at", "bands", (F.col("n_shingles") * 8).alias("bytes"))
    members = (
        cells.select(F.lit(0).alias("kind"), F.col("cell").alias("gid"), "rep")
        .unionByName(
            met.join(mixed, "h").select(
                F.lit(1).alias("kind"), F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("gid"), "rep"
            )
        )
        .join(reps.select("rep", (F.col("n_shingles") * 8).alias("bytes")), "rep")
    )
    placed = materialize(_blocks(materialize(members)))
    wanted = placed.select("rep").distinct().join(facts.drop("bytes"), "rep").join(cells, "rep")
    texts = (
        read.join(wanted.select("at.doc", "at.th", "rep", "n", "bands", "cell"), ["doc", "th"])
        .groupBy("doc", "th")
        .agg(*[F.first(c).alias(c) for c in ("rep", "n", "bands", "cell", "text")])
        .drop("doc", "th")
    )
    found = materialize(
        placed.withColumn("bucket", F.when(F.col("kind") == 1, F.conv(F.hex("gid"), 16, -10).cast("long")))
        .join(texts, "rep")
        .groupBy("kind", "gid", "i", "j")
        .applyInArrow(_links(threshold), "rep binary, links long, root binary")
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    ties = found.select(F.col("rep").alias("src"), F.col("root").alias("dst")).distinct()
    tied = materialize(connected_components(links.select(F.col("rep").alias("id")), ties))
    joined = materialize(
        reps.select("rep", "n", "at")
        .join(links, "rep", "left")
        .join(tied.withColumnRenamed("id", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    lowest = materialize(joined.groupBy("component").agg(F.min("at").alias("low")))
    by_rep = materialize(
        joined.join(lowest, "component").select(
            "rep", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
        )
    )
    own = F.struct("doc", "th")
    return signed.join(by_rep, "rep", "left").select(
        "doc", "th",
        F.coalesce("low.doc", "doc").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.col("low").isNull() | (F.col("low") == own)).alias("first"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that come first in their class, one row each; all columns stay.

    Rows without words are documents of their own, whatever their id: all of them stay.
    """
    keep = classes(docs).where("first").select("doc", "th").distinct()
    held = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)).alias("doc"),
        F.xxhash64(whole(docs["text"])).alias("th"),
        whole(docs["text"]).rlike(f"[^{SPACE}]").alias("worded"),
    )
    out = held.where("worded").join(keep, ["doc", "th"]).groupBy("doc", "th").agg(F.first("row").alias("row"))
    out = out.select("row").unionAll(held.where("NOT worded").select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = classes(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "class_id", "n_links")


_CLS = "[^\\x20\\x09-\\x0D]+"
SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_CLS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {S.WORDS}
      THEN list_transform(range(1, len(w) - {S.WORDS - 2}), lambda i: array_to_string(w[i : i + {S.WORDS - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m
                    FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE m >= {THRESHOLD} * (nx.n + ny.n - m) - 1e-9),
reach AS (SELECT doc_id, doc_id AS c FROM documents
  UNION SELECT p.x, r.c FROM reach r JOIN pairs p ON p.y = r.doc_id),
deg AS (SELECT x AS doc_id, count(*)::BIGINT AS n FROM pairs GROUP BY x)
SELECT r.doc_id, min(r.c) AS class_id, coalesce(max(deg.n), 0)::BIGINT AS n_links
FROM reach r LEFT JOIN deg ON deg.doc_id = r.doc_id GROUP BY r.doc_id
"""
