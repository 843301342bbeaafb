"""The stages one after the other, as run() chains them, against a plain version of each on the same input."""

import re
import zlib

import pytest
from oracle import connect
from test_queries import SF, library_ids, packed, plain_base

import corpus_pipeline
from shutterlake.llm import quality
from shutterlake.llm.text import table
from shutterlake.session import materialize


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    docs = table(spark, SF, "documents")
    out = [sorted(docs.collect(), key=lambda r: r.doc_id)]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        key = ["doc_id", "start"] if "start" in docs.columns else ["doc_id"]
        out.append(sorted(docs.collect(), key=lambda r: [r[k] for k in key]))
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "personal_data", "packing"]


def test_quality(stages):
    kept = {r[0] for r in connect(SF).execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()}
    assert stages[1] == [r for r in stages[0] if r.doc_id in kept] and 0 < len(kept) < len(stages[0])


def test_lines(stages):
    owner, out = {}, []
    for r in stages[1]:
        for line in r.text.split("\n"):
            k = line.strip(" \t\n\x0b\f\r").lower()
            if len(k) >= 10:
                owner.setdefault(k, r.doc_id)
    for r in stages[1]:
        lines = [x for x in r.text.split("\n") if owner.get(x.strip(" \t\n\x0b\f\r").lower(), r.doc_id) == r.doc_id]
        text = "\n".join(lines)
        out.append((r.doc_id, text, r.lang, r.source, len(text)))
    assert [tuple(r) for r in stages[2]] == out
    assert any(len(a.text) < len(b.text) for a, b in zip(stages[2], stages[1]))


def test_near_duplicates(stages):
    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = stages[2]
    sets = [shingles(r.text) for r in rows]
    low = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    assert stages[3] == [r for i, r in enumerate(rows) if low[i] == i]


def test_personal_data(stages):
    changed = 0
    for before, after in zip(stages[3], stages[4], strict=True):
        text, done = [], 0
        for span in plain_base(before.text):
            kind, a, b = span.split(":")
            if int(a) >= done:
                text += [before.text[done : int(a)], f"[{kind.upper()}]"]
            done = max(done, int(b))
        text = "".join(text) + before.text[done:]
        assert (after.doc_id, after.text, after.n_chars) == (before.doc_id, text, len(text))
        changed += text != before.text
    assert changed


def test_packing(stages):
    _, ids = library_ids("byte_bpe_50k.json", [r.text for r in stages[4]])
    want = {r.doc_id: [*x, 1] for r, x in zip(stages[4], ids)}
    at = dict.fromkeys(want, 0)
    seqs = {}
    for r in stages[5]:
        assert r.start == at[r.doc_id] and r.ids_crc32 == zlib.crc32(packed(want[r.doc_id][r.start : r.start + r.length]))
        at[r.doc_id] += r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {d: len(x) for d, x in want.items()}
    for parts in seqs.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end == 2048 or end & (end - 1) == 0
