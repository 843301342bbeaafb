"""Every registered query of the subpackage against its SQL, or against a plain version on whole texts."""

import hashlib
import os
import re
import zlib

import pandas as pd
import pyarrow.parquet as pq
import pytest
from oracle import connect, difference

from shutterlake.llm import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry()


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet").to_pandas().sort_values("doc_id")
    return list(zip(t["doc_id"].tolist(), [x or "" for x in t["text"]]))


def rows(spark, name):
    df = QUERIES[name](spark, SF).toPandas()
    return df.sort_values([c for c in ("doc_id", "start") if c in df.columns]).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


def test_token_counts(spark, docs):
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows(spark, "op3_token_counts")
    n = [len(m.encode(t)) for _, t in docs]
    assert got["n_tokens"].tolist() == n
    assert got["n_bytes"].tolist() == [len(t.encode()) for _, t in docs]
    assert got["over_limit"].tolist() == [x > 4096 for x in n]


def plain_base(text):
    """The base rules with the patterns as they stand."""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                s = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1]))
                if not 14 <= len(d) <= 19 or s % 10:
                    continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), ["email", "ip", "card", "phone"].index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data(spark, docs):
    got = rows(spark, "op4_personal_data")
    want = [plain_base(t) for _, t in docs]
    assert any(want)
    assert got["base_sha256"].tolist() == [hashlib.sha256(",".join(w).encode()).hexdigest() for w in want]
    for k in ("email", "ip", "card", "phone"):
        assert got[f"n_{k}"].tolist() == [sum(x.startswith(k) for x in w) for w in want]
    for spans, w in zip(got["spans"], want):
        assert set(w) <= set(spans.split(","))


def test_fingerprints(spark, docs):
    from shutterlake.llm.fingerprints import K, W, likeness, marks

    got = rows(spark, "op5_fingerprints")
    texts = [t for _, t in docs]
    after = [*texts[1:], texts[0]]
    edited = [t[: len(t) - len(t) // 4] + a[: len(t) // 4] for t, a in zip(texts, after)]
    assert got["n_chars"].tolist() == [len(t) for t in texts]
    assert got["edited_sha256"].tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    own, other = [marks([t])[0][0] for t in texts], [marks([t])[0][0] for t in edited]
    assert got["fingerprint"].tolist() == [h.astype(">u4").tobytes().hex() for h in own]
    assert got["near_edited"].tolist() == [likeness(a, b) for a, b in zip(own, other)]
    assert got["near_next"].tolist() == [likeness(a, b) for a, b in zip(own, [*own[1:], own[0]])]
    assert (got["near_edited"] > got["near_next"]).mean() > 0.95
    assert K + W - 1 == 47


def library_ids(name, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t, [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def packed(ids):
    import numpy as np

    return np.array(ids, "<u4").tobytes()


def test_packing(spark, docs):
    got = rows(spark, "op7_packing")
    _, ids = library_ids("byte_bpe_50k.json", [t for _, t in docs])
    by_doc = dict(zip([d for d, _ in docs], [[*x, 1] for x in ids]))
    for d, g in got.groupby("doc_id"):
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.doc_tokens == len(by_doc[d])
            assert r.ids_crc32 == zlib.crc32(packed(by_doc[d][at : at + r.length]))
            at += r.length
        assert at == len(by_doc.pop(d))
    assert not by_doc
    padding = 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        at = 0
        for r in g.itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    assert padding == 0
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].nunique()))


def test_bpe(spark, docs):
    got = rows(spark, "op8_bpe")
    t, ids = library_ids("word_bpe_49k.json", [t for _, t in docs])
    assert got["n_tokens"].tolist() == [len(x) for x in ids]
    assert got["ids_sha256"].tolist() == [hashlib.sha256(packed(x)).hexdigest() for x in ids]
    decoded = [t.decode(x, skip_special_tokens=False) for x in ids]
    assert got["decoded_sha256"].tolist() == [hashlib.sha256(x.encode()).hexdigest() for x in decoded]


def test_token_files(spark, docs, tmp_path):
    from shutterlake.llm import token_files
    from shutterlake.llm.text import table

    got = rows(spark, "op9_token_files")
    _, ids = library_ids("word_bpe_49k.json", [t for _, t in docs])
    ids = [[*x, 1] for x in ids]
    assert got["n_tokens"].tolist() == [len(x) for x in ids]
    assert got["ids_crc32"].tolist() == [zlib.crc32(packed(x)) for x in ids]
    assert got["start"].tolist() == [0, *pd.Series(map(len, ids)).cumsum().tolist()[:-1]]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(table(spark, SF, "documents"), path)
    some = token_files.read_tokens(spark, path, [docs[3][0], docs[17][0]])
    assert {r[0]: list(r[1]) for r in some.collect()} == {docs[i][0]: ids[i] for i in (3, 17)}
    assert token_files.read_counts(spark, path).inputFiles()
    order = []
    for f in sorted((tmp_path / "tokens").glob("part-*.parquet")):
        meta = pq.ParquetFile(f)
        order += meta.read(["doc_id"]).column(0).to_pylist()
        for g in range(meta.metadata.num_row_groups):
            names = {meta.metadata.row_group(g).column(i).path_in_schema: meta.metadata.row_group(g).column(i) for i in range(4)}
            assert names["doc_id"].has_offset_index and names["tokens.list.element"].has_offset_index
            assert "DELTA_BINARY_PACKED" in names["doc_id"].encodings
            assert "RLE_DICTIONARY" in names["tokens.list.element"].encodings
    assert order == [d for d, _ in docs]
