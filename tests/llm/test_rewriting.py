"""Fill-in-the-middle, Merkle manifest and SuperMinHash: the methods on their own, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_edges import TEXTS, docs, key, labels  # noqa: F401

from shutterlake.llm import fill_middle, merkle, super_minhash
from shutterlake.llm import shingles as S

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


# ---- fill in the middle ----------------------------------------------------------


def plain_form(doc_id, text):
    """form, cuts and output by the rule as written."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark, docs):  # noqa: F811
    marked = spark.createDataFrame([(i, t) for i, t in enumerate(["a<P>b", "<S>", "x<M", "<", "P>", "é<S", "🙂" * 9])], "doc_id long, text string")
    for table, rows in ((docs, TEXTS), (marked, [tuple(r) for r in marked.collect()])):
        out = fill_middle.restore(fill_middle.fill_middle(table))
        got = out.select("row.row.doc_id", "row.n", "row.form", "row.prefix_chars", "row.middle_chars", "row.output", "text").collect()
        want = [(d, len(t or ""), *plain_form(d, t or ""), t or "") for d, t in rows]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    made = fill_middle.fill_middle(docs)
    assert made.schema["row"].dataType.names == [c for c in docs.columns if c != "text"]
    assert fill_middle.restore(made).schema["row"].dataType.names == made.columns
    assert fill_middle.restore(fill_middle.fill_middle(docs.limit(0))).isEmpty()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aé🙂<>PSM"), max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm"]))
def test_rotations_are_undone(text, a, b, form):
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    out = fill_middle.turn(text.encode(), form, (a, b))
    p, m, s = text[:a], text[a:b], text[b:]
    assert out.decode() == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert fill_middle.turn_back(out, form).decode() == text


def test_rotation_in_pieces(monkeypatch):
    """Three reversals, also where a reversal takes many pieces."""
    monkeypatch.setattr(fill_middle, "REVERSED", 3)
    for n in range(12):
        for m in range(n + 1):
            for i in range(m + 1):
                a = np.arange(n + 2)
                fill_middle.rotate(a, i, m, n)
                assert a.tolist() == [*range(i), *range(m, n), *range(i, m), n, n + 1]


def test_long_text_is_turned_whole():
    text = ("é🙂 words " * 700_000).encode()
    n = len(text.decode())
    out = fill_middle.turn(text, "spm", (n // 3, n // 2))
    assert len(out) == len(text) + 9 and fill_middle.turn_back(out, "spm") == text


# ---- Merkle manifest -------------------------------------------------------------


def hexed(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([hexed(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        a = at // 8 * 8
        out.append((level[a:at], level[at + 1 : a + 8]))
        at //= 8
    return out


def plain_manifest(rows):
    """rows of (group, id, leaf, shown) -> leaf, subroot, root, proof, folded, verified, in that order."""
    groups = {}
    for g, d, x, shown in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(g, []).append((d, x, shown))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x for _, x, _ in groups[g]]) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names]) if names else [[None]]
    out = []
    for k, g in enumerate(names):
        for i, (d, x, shown) in enumerate(groups[g]):
            path = plain_path(trees[g], i) + plain_path(top, k)
            h = shown
            for a, b in path:
                h = hexed(*a, h, *b)
            proof = hexed(*[y for a, b in path for y in a + b])
            out.append((g, d, x, trees[g][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return sorted(map(repr, out))


def manifested(leaves):
    made = merkle.manifest(leaves, "lang", "doc_id", "leaf")
    out = merkle.verify(made, F.unhex(made["row.shown"]))
    low = [F.lower(F.hex(c)).alias(c) for c in ("subroot", "root")]
    got = out.select("row.lang", "row.doc_id", "row.leaf", *low, "proof_sha256", F.lower(F.hex("folded")), F.col("folded") == F.col("root"))
    return sorted(map(repr, map(tuple, got.collect())))


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_in_blocks(spark, monkeypatch, height):
    """Trees of every shape around a full run or block, whatever the block height."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = []
    for g, n in enumerate((1, 2, 7, 8, 9, 63, 64, 65, 73, 130, 513, 601)):
        for i in range(n):
            rows.append((f"g{g}" if g else None, 7 * i % 1009, hexed(f"{g}:{i}"), hexed(f"{g}:{i}{'x' if i % 5 == 0 else ''}")))
    leaves = spark.createDataFrame(rows, "lang string, doc_id long, leaf string, shown string")
    assert manifested(leaves) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark, docs):  # noqa: F811
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return hexed(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))

    held = docs.collect()
    rows = []
    for r in held:
        change = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        rows.append((r.lang, r.doc_id, leaf(r, r.text), leaf(r, r.text.translate(UPPER) if change else r.text)))
    own = [F.col(c) for c in merkle.FIELDS]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    shown = [*own[:-1], F.when(changed, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))]
    leaves = docs.withColumns({"leaf": merkle.leaf(own), "shown": merkle.leaf(shown), "tree": F.lit(1), "node": F.lit(2), "witness": F.lit(3)})
    assert manifested(leaves) == plain_manifest(rows)
    assert merkle.manifest(leaves, "lang", "doc_id", "leaf").schema["row"].dataType.names == leaves.columns
    assert merkle.verify(merkle.manifest(leaves.limit(0), "lang", "doc_id", "leaf")).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700))
def test_witnesses_grow_with_later_siblings(n):
    """At any time a leaf's witness leads to the node of the largest closed run above it."""
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    tree = merkle.OpenTree(leaves)
    for level, run in enumerate(tree.runs):
        assert len(run) < merkle.ARITY
        for d, first, end in run:
            assert end - first == merkle.ARITY**level
            assert all(merkle.fold(leaves[i], b"".join(tree.witnesses[i])) == d for i in range(first, end))
    root = tree.finish()
    assert root.hex() == plain_tree([x.hex() for x in leaves])[-1][0]
    assert all(merkle.fold(x, b"".join(w)) == root for x, w in zip(leaves, tree.witnesses))
    assert merkle.OpenTree(leaves, keep=False).finish() == root


# ---- SuperMinHash ----------------------------------------------------------------


def one_signature(values, slots, seed):
    """The method value by value, without an early stop, with the same random numbers."""
    out = [float("inf")] * slots
    for v in values:
        state = S.mix(np.array([v], np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        order = list(range(slots))
        for j in range(slots):
            state = state + np.uint64(0x9E3779B97F4A7C15)
            r = int(S.mix(state)[0])
            k = j + ((r >> 32) * (slots - j) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j + (r & 0xFFFFFFFF) / 2**32)
    return out


def test_signatures_against_the_plain_method():
    r = random.Random(1)
    sets = [[r.getrandbits(64) for _ in range(n)] for n in (1, 0, 2, 5, 17, 40, 300, 0)]
    at = np.cumsum([0, *map(len, sets)])
    got = super_minhash.signatures(np.array([x for s in sets for x in s], np.uint64), at, 24, 5)
    assert got.tolist() == [one_signature(s, 24, 5) for s in sets]


def test_signatures_vary_less_than_independent_minima():
    """Share of equal slots for sets of 40 with 30 in common: right on average, with less spread."""
    r = random.Random(2)
    true, slots, ours, plain = 30 / 50, 64, [], []
    for _ in range(400):
        v = [r.getrandbits(64) for _ in range(50)]
        both = np.array(v[:40] + v[10:], np.uint64)
        a, b = super_minhash.signatures(both, np.array([0, 40, 80]), slots)
        ours.append((a == b).mean())
        a, b = S.min_hashes(both, np.array([0, 40, 80]), slots, 3)
        plain.append((a == b).mean())
    assert abs(np.mean(ours) - true) < 0.01
    assert np.mean((np.array(ours) - true) ** 2) < 0.8 * np.mean((np.array(plain) - true) ** 2)


def test_band_recall():
    bands, rows = super_minhash.choose_bands()
    assert bands * rows <= super_minhash.SLOTS and 1 - (1 - 0.85**rows) ** bands >= super_minhash.RECALL
    with pytest.raises(ValueError):
        super_minhash.choose_bands(0.1, 0.999999, 4)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=40))
def test_union_find(pairs):
    groups, want = super_minhash.Groups(20), [{i} for i in range(20)]
    for x, y in pairs:
        assert groups.union(x, y) == (want[x] is not want[y])
        if want[x] is not want[y]:
            want[x] |= want[y]
            for z in want[x]:
                want[z] = want[x]
    assert [groups.find(x) for x in range(20)] == [min(s) for s in want]


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").translate(UPPER).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ")
        w = [x for x in w.split(" ") if x]
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    low = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * len(a | sets[j]) and low[i] != low[j]:
                x, y = sorted((low[i], low[j]))
                low = [x if z == y else z for z in low]
    ids = [min(key(rows[j][0]) for j in range(len(rows)) if low[j] == g) for g in low]
    return sorted((key(d), len(s), c, key(d) == c) for (d, _), s, c in zip(rows, sets, ids))


def found(df):
    return sorted(map(tuple, super_minhash.components(df).select("doc", "n_shingles", "component_id", "kept").collect()))


def test_components_of_odd_rows(docs):  # noqa: F811
    assert found(docs) == plain_components(TEXTS)
    assert super_minhash.components(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("rows_of_block", [4, 256])
def test_components_in_blocks(spark, monkeypatch, rows_of_block):
    """Chains of near copies, copies in other case, and texts that share much but not enough."""
    monkeypatch.setattr(super_minhash, "BLOCK_ROWS", rows_of_block)
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for step in range(40):  # each a few words on from the last: linked in a chain, not all with all
        rows.append(" ".join(base[: 120 - 3 * step] + [f"n{i}" for i in range(3 * step)]))
    for i in range(30):  # about 0.7 alike, so in common buckets without links
        rows.append(" ".join(x if r.random() > 0.06 else f"v{i}" for x in base[::-1]))
    rows += [" ".join(base[:50]).upper(), " ".join(base[:50]), "\n".join(base[:50]) + " ", "a b", "A  b", "a b c", ""]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain_components(rows)


def test_links_are_counted_on_whole_sets():
    sets = [list(range(100)), list(range(8, 100)), list(range(40, 140)), [], [5]]
    at = np.cumsum([0, *map(len, sets)])
    flat = np.array([x for s in sets for x in s], np.uint64)
    everyone = np.arange(5)
    got = super_minhash.linked(flat, at, everyone, everyone, 85)
    for i in range(5):
        for j in range(5):
            a, b = set(sets[i]), set(sets[j])
            assert i == j or got[i, j] == (bool(a & b) and 100 * len(a & b) >= 85 * len(a | b))


def test_equal_sets_have_equal_names():
    a = pa.array(["a b c a b c a", "b c a b c a b c", "A B C A B C A", None, ""])
    sets, at = super_minhash._sets(a)
    names = super_minhash._set_names(sets, at).to_pylist()
    assert names[0] == names[1] == names[2] and names[3] is names[4] is None
