"""Near duplicates by SuperMinHash signatures, banding, verification and union-find (operator 13).

A text is the set of its distinct shingles of WORDS words, A-Z lower-cased. A
SuperMinHash signature has SLOTS slots: every shingle walks through the slots in
a random order of its own, and its j-th slot gets the value j plus a random
fraction; a slot keeps its smallest value. The ranks of a shingle are correlated
(it takes part in every slot at another rank), so matching slots spread less than
with independent minima. After rank j a text is done as soon as no slot is above
j + 1, since later ranks can't get below it: long texts stop after one or two.

Texts with equal sets become one representative. Slots are cut into bands whose
number follows from the target recall; texts that share a band hash are
candidates. Every representative first meets the texts of one cell (named by the
smallest representative it shares a bucket with), block by block; a block's links
are found on the full sets and merged by union-find, and components of the
blocks' results are the groups so far. Buckets whose members are then still in
several groups are verified across groups, all pairs of their blocks, a pair in
the first band it shares. Pairs within a group need no check as they can't change
it. Nothing is capped: m texts that share a bucket but no link cost
(m / BLOCK_ROWS)^2 / 2 block pairs, and m texts that are linked cost m / BLOCK_ROWS
blocks.

Defined results: texts without words (null, empty, white space) have an empty set
and are linked to nothing; fewer than WORDS words are one shingle; rows with the
same id are documents of their own; a null id sorts last (the largest long);
component_id is the smallest id of the group; of several rows that hold it, each
has it as its own id. Texts of any length are hashed whole, a bounded number of
bytes at a time unless one text alone is longer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import shingles as S
from shutterlake.llm.text import table, whole
from shutterlake.operators.graph import connected_components
from shutterlake.session import materialize

WORDS = 3
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Share of the pairs at the threshold that share a band; pairs above it do so more often.
RECALL = 0.9999
#: Slots of a signature at most.
SLOTS = 128
SEED = 13

BLOCK_ROWS = 256
BLOCK_BYTES = 4_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float = PERCENT / 100, recall: float = RECALL, slots: int = SLOTS) -> tuple[int, int]:
    """(bands, rows): the most rows that reach the recall if slots matched independently.

    Slots of one signature match less unevenly than that, so the true recall is higher.
    """
    best = None
    for rows in range(1, slots + 1):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if miss > 0 else 1
        if bands * rows <= slots:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall with so few slots")
    return best


def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes once, ascending, and the texts' places."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(at) - 1))]).astype(np.int64)


def signatures(sets: np.ndarray, at: np.ndarray, slots: int, seed: int = SEED) -> np.ndarray:
    """One row of slots per text; an empty set has infinite ones.

    All texts take rank j at once. Where shingle x stands at rank j follows from
    the swaps of its earlier ranks, traced back, so only its random picks are kept.
    """
    n = len(at) - 1
    out = np.full((n, slots), np.inf)
    owner = np.repeat(np.arange(n), np.diff(at))
    state = S.mix(sets + np.uint64(seed * int(_STEP) % 2**64))
    picks: list[np.ndarray] = []
    live = np.flatnonzero(np.diff(at))
    for j in range(slots if len(live) else 0):
        state = state + _STEP
        random = S.mix(state)
        # The upper half picks one of the slots not yet visited, the lower half is the fraction.
        pick = (j + (((random >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        slot = pick.copy()
        for i in range(j - 1, -1, -1):
            slot[picks[i] == slot] = i
        value = j + (random & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32
        np.minimum.at(out.reshape(-1), owner * slots + slot, value)
        live = live[out[live].max(axis=1) > j + 1]
        if not len(live):
            break
        going = np.zeros(n, bool)
        going[live] = True
        going = going[owner]
        picks.append(pick)
        if not going.all():
            owner, state = owner[going], state[going]
            picks = [p[going] for p in picks]
    return out


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, at = S.word_hashes(pc.ascii_lower(texts))
    return distinct(*S.shingle_hashes(words, at, WORDS))


def _signer(bands: int, rows: int):
    def sign(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in S.slices(texts, 2_000_000):
                part = batch.slice(a, b - a)
                sets, at = _sets(part.column("text"))
                size = np.diff(at)
                some = size > 0
                low = signatures(sets, at, bands * rows)[some].view(np.uint64).reshape(-1, bands, rows)
                h = np.zeros(low.shape[:2], np.uint64)
                for j in range(rows):
                    h = S.mix(h * np.uint64(31) + low[:, :, j])
                h = S.mix(h + np.arange(1, bands + 1, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)),
                    pa.array(h.ravel().view(np.int64)),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("th"), _set_names(sets, at), lists, pa.array(size, pa.int64())],
                    names=["doc", "th", "name", "bands", "n_shingles"],
                )

    return sign


def _set_names(sets: np.ndarray, at: np.ndarray) -> pa.Array:
    """A 128-bit hash of each set; none for an empty one."""
    size = np.diff(at)
    some = size > 0
    both = np.zeros((len(size), 2), np.uint64)
    if some.any():
        starts = at[:-1][some]
        both[some, 0] = S.mix(np.add.reduceat(S.mix(sets ^ _STEP), starts) + size[some].astype(np.uint64))
        both[some, 1] = S.mix(np.add.reduceat(S.mix(sets * _STEP), starts) + size[some].astype(np.uint64))
    raw = pa.py_buffer(both.tobytes())
    names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(size), [None, raw]).cast(pa.binary())
    return pc.if_else(pa.array(some), names, pa.scalar(None, pa.binary()))


SIGNED = "doc long, th long, name binary, bands array<long>, n_shingles long"


class Groups:
    """Union-find over n places; the smallest place is a group's root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def linked(sets: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the texts left x right are linked, by their full sets."""
    n = len(at) - 1
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    _, code, often = np.unique(sets, return_inverse=True, return_counts=True)
    shared = often[code] > 1  # only shingles of two texts or more can meet
    code, owner = (np.cumsum(often > 1) - 1)[code][shared], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    total = int(code[-1]) + 1 if len(code) else 0
    both = np.zeros((len(left), len(right)))
    width = max(256, 4_000_000 // max(n, 1))
    for c in range(0, total, width):
        lo, hi = np.searchsorted(code, [c, c + width])
        m = np.zeros((n, min(width, total - c)), np.float32)
        m[owner[lo:hi], code[lo:hi] - c] = 1
        both += m[left] @ m[right].T
    either = size[left][:, None] + size[right][None, :] - both
    return (100 * both >= percent * either) & (both > 0)


def _merged(percent: int):
    """Ties (src, dst) of the groups of one block, or across two, that a link joins: dst is the smallest."""

    def merge(t: pa.Table) -> pa.Table:
        names, own = np.unique(t.column("group").to_numpy(), return_inverse=True)
        side = t.column("side").to_numpy()
        crossed = t.column("i")[0] != t.column("j")[0]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if crossed else left
        # Pairs to check: of two groups, not met in a cell's block before, and in the first band they share.
        met = t.column("met").to_numpy()
        open_ = (own[left][:, None] != own[right][None, :]) & (met[left][:, None] != met[right][None, :])
        if not crossed:
            open_ &= left[:, None] < right[None, :]
        bucket = t.column("bucket")[0].as_py()
        if bucket is not None and open_.any():
            bands = pc.list_flatten(t.column("bands")).to_numpy().reshape(len(side), -1)
            for k in range(bands.shape[1]):
                if bands[0, k] == bucket:
                    break
                open_ &= bands[left, k][:, None] != bands[right, k][None, :]
        groups = Groups(len(names))
        rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if len(rows):
            need = np.unique(np.concatenate([left[rows], right[cols]]))
            sets, at = _sets(t.column("text").combine_chunks().take(pa.array(need)))
            hit = linked(sets, at, np.searchsorted(need, left[rows]), np.searchsorted(need, right[cols]), percent)
            x, y = np.nonzero(hit & open_[np.ix_(rows, cols)])
            for u, v in set(zip(own[left[rows[x]]].tolist(), own[right[cols[y]]].tolist())):
                groups.union(u, v)
        roots = np.array([groups.find(x) for x in range(len(names))], np.int64)
        moved = roots != np.arange(len(names))
        return pa.table({"src": pa.array(names[moved]), "dst": pa.array(names[roots[moved]])})

    return merge


TIES = "src long, dst long"


def _blocks(members: DataFrame) -> DataFrame:
    """(gid, n_blocks) of the groups of two members or more; `members` has gid, rep and bytes."""
    rows, size = F.count("*"), F.sum("bytes")
    return materialize(
        members.groupBy("gid")
        .agg(rows.alias("m"), size.alias("b"))
        .where("m > 1")
        .select("gid", F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("b") / BLOCK_BYTES)).cast("int").alias("nb"))
    )


def _own(nb: str = "nb"):
    return F.pmod(F.xxhash64("rep"), F.col(nb)).cast("int")


def components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    recall: float = RECALL,
) -> DataFrame:
    """(doc, n_shingles, component_id, kept) per input row; doc is the largest long for a null id."""
    bands, rows = choose_bands(percent / 100, recall)
    read = docs.select(
        F.coalesce(docs[doc_id].cast("long"), F.lit(2**63 - 1)).alias("doc"), whole(docs[text]).alias("text")
    ).withColumn("th", F.xxhash64("text"))
    signed = materialize(read.mapInArrow(_signer(bands, rows), SIGNED))
    # Numbers are given out while the table is written, so they stay as they are.
    reps = materialize(
        signed.where(F.col("name").isNotNull())
        .groupBy("name")
        .agg(
            F.min(F.struct("doc", "th")).alias("at"),
            F.first("bands").alias("bands"),
            F.first("n_shingles").alias("n_shingles"),
        )
        .withColumn("rep", F.monotonically_increasing_id())
    )
    in_bands = reps.select("rep", F.explode("bands").alias("h"))
    buckets = materialize(
        in_bands.groupBy("h").agg(F.count("*").alias("m"), F.min("rep").alias("low")).where("m > 1").drop("m")
    )
    met = materialize(in_bands.join(buckets, "h"))
    cells = materialize(met.groupBy("rep").agg(F.min("low").alias("cell")))
    sized = reps.select("rep", (F.col("n_shingles") * 8).alias("bytes"))
    wanted = cells.join(reps.select("rep", "at", "bands"), "rep")
    texts = materialize(
        read.join(wanted.select("at.doc", "at.th", "rep", "bands"), ["doc", "th"])
        .groupBy("rep")
        .agg(F.first("bands").alias("bands"), F.first("text").alias("text"))
    )

    # Within cells: each block holds the text that names the cell, and members of its own.
    in_cell = cells.select(F.col("cell").alias("gid"), "rep").where("rep <> gid")
    heads = in_cell.select("gid").distinct().select("gid", F.col("gid").alias("rep"))
    sizes = _blocks(materialize(in_cell.unionByName(heads).join(sized, "rep")))
    dealt = in_cell.join(sizes, "gid").select("gid", "rep", _own().alias("i"))
    led = sizes.select("gid", F.col("gid").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"))
    block = F.xxhash64("gid", "i")
    inner = (
        dealt.unionByName(led)
        .join(texts.select("rep", "text"), "rep")
        .select(
            "gid", "i", F.col("i").alias("j"), F.lit(0).alias("side"), F.col("rep").alias("group"),
            F.col("rep").alias("met"), F.lit(None).cast("long").alias("bucket"), "text",
        )
    )
    ties = materialize(inner.groupBy("gid", "i", "j").applyInArrow(_merged(percent), TIES))
    ends = ties.select(F.col("src").alias("id")).unionByName(ties.select(F.col("dst").alias("id"))).distinct()
    grouped = materialize(connected_components(ends, ties))

    # Across cells: buckets that hold several groups and several blocks.
    state = materialize(
        met.select("rep", "h")
        .join(grouped.select(F.col("id").alias("rep"), F.col("component").alias("group")), "rep", "left")
        .join(dealt.select("rep", block.alias("met")), "rep", "left")
        .select("rep", F.col("h").alias("gid"), F.coalesce("group", "rep").alias("group"), F.coalesce("met", "rep").alias("met"))
    )
    mixed = (
        state.groupBy("gid")
        .agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("group", "met")])
        .where("min_group <> max_group AND min_met <> max_met")
        .select("gid")
    )
    several = materialize(state.join(mixed, "gid", "left_semi").join(sized, "rep"))
    sizes = _blocks(several)
    outer = (
        several.drop("bytes")
        .join(sizes, "gid")
        .withColumn("own", _own())
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select(
            "gid", "rep", "group", "met", F.col("gid").alias("bucket"),
            F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
        .join(texts, "rep")
    )
    more = materialize(outer.groupBy("gid", "i", "j").applyInArrow(_merged(percent), TIES))
    ends = more.select(F.col("src").alias("id")).unionByName(more.select(F.col("dst").alias("id"))).distinct()
    merged = materialize(connected_components(ends, more))

    placed = materialize(
        reps.select("rep", "name", "at.doc")
        .join(grouped.select(F.col("id").alias("rep"), F.col("component").alias("one")), "rep", "left")
        .withColumn("one", F.coalesce("one", "rep"))
        .join(merged.select(F.col("id").alias("one"), F.col("component").alias("two")), "one", "left")
        .select("name", "doc", F.coalesce("two", "one").alias("component"))
    )
    lowest = materialize(placed.groupBy("component").agg(F.min("doc").alias("low")))
    by_name = materialize(placed.join(lowest, "component").select("name", "low"))
    component = F.coalesce("low", "doc")
    return signed.join(by_name, "name", "left").select(
        "doc", "n_shingles", component.alias("component_id"), (F.col("doc") == component).alias("kept")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return components(table(spark, folder, "documents").select("doc_id", "text")).withColumnRenamed("doc", "doc_id")


_CLS = "[^\\x20\\x09-\\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_CLS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS}
      THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m
                    FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * m >= {PERCENT} * (nx.n + ny.n - m)),
reach AS (SELECT doc_id, doc_id AS c FROM documents
  UNION SELECT p.x, r.c FROM reach r JOIN pairs p ON p.y = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, r.doc_id = min(r.c) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
