"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from test_queries import library_ids, packed, plain_base

import corpus_pipeline
from shutterlake.llm import bpe, fingerprints, line_dedup, ngram_join, packing, pii, quality, token_counts, token_files
from shutterlake.llm import url_filters

LONG = "x" * 200_000
SENTENCE = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    (7, SENTENCE + "\nthe same line in many texts\n  The Same Line in many texts \nshort"),
    (3, "the same line in many texts\nmail bob.42@mail8.example.com now\nthe same line in many texts"),
    (3, "another text of id three\nthe same line in many texts"),
    (5, None),
    (6, ""),
    (8, " \t\n \n"),
    (None, "text without id\nthe same line in many texts"),
    (9, LONG),
    (10, (SENTENCE + "\n") * 400),
    (11, "call +1 (988) 555-2485 or 4111 1111 1111 1111 at 10.0.0.300 or 10.0.0.30"),
    (12, "call +1 (988) 555-2485 or 4111 1111 1111 1111 at 10.0.0.300 or 10.0.0.30"),
    (12, "call +1 (988) 555-2485 or 4111 1111 1111 1111 at 10.0.0.300 or 10.0.0.30"),
    (13, "🙂 Ünï ΑΣ ǅ <|endoftext|> </s> ▁▁ tail \x1c\x85 "),
    (14, " ".join(f"w{i}" for i in range(60))),
    (15, " ".join(f"w{i}" for i in range(61))),
    (16, " ".join(f"w{i}" for i in range(60)) + " end"),
    (17, "a b c"),
    (18, "a b c"),
    (19, "1" * 50_000 + "@" + "+1" * 20_000 + "a@" * 20_000),
]
CLASHES = ("row", "t", "w", "h", "counts", "kept", "rule", "rep", "doc", "th", "lines", "gone", "cell", "bands", "pos", "id")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en" if d != 14 else None, "src", len(t or ""), *[f"{c}{i}" for c in CLASHES]) for i, (d, t) in enumerate(TEXTS)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    kinds = ["long", "string", "string", "string", "long", *["string"] * len(CLASHES)]
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(14, 1, 0), (15, 1, 0), (15, 0, 0), (None, 1, 0), (999, 1, None), (16, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def folder(tmp_path_factory, labels):
    path = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def key(d):
    return 2**63 - 1 if d is None else d


def plain_lines():
    owner = {}
    for d, t in TEXTS:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\x0b\f\r").lower()
            if len(k) >= 10:
                owner[k] = min(owner.get(k, key(d)), key(d))
    out = []
    for d, t in TEXTS:
        lines = (t or "").split("\n")
        keep = [x for x in lines if owner.get(x.strip(" \t\n\x0b\f\r").lower(), key(d)) == key(d)]
        out.append((key(d), "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out)


def test_lines(spark, docs):
    got = line_dedup.drop_lines(docs, batches=3)
    assert got.schema["row"].dataType.names == docs.columns
    rows = got.select("row.doc_id", "kept", "n_lines", "n_dropped").collect()
    assert sorted((key(r[0]), *r[1:]) for r in rows) == plain_lines()
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert out.where("n_chars <> length(text)").isEmpty()


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes():
    sets = [shingles(t) for _, t in TEXTS]
    n = len(sets)
    linked = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    low = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in linked[i]:
                low[i] = low[j] = min(low[i], low[j])
    ids = [min(key(TEXTS[j][0]) for j in range(n) if low[j] == low[i]) for i in range(n)]
    return sorted((key(d), ids[i], len(linked[i])) for i, (d, _) in enumerate(TEXTS)), len(set(low))


def test_classes(spark, docs):
    want, groups = plain_classes()
    got = ngram_join.classes(docs).select("doc", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == want
    assert max(w[2] for w in want) >= 2
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == groups


def test_large_groups_in_blocks(spark, monkeypatch):
    """Near copies beyond a block, and copies of each: links as counted by hand."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:-1], f"end{i % 30}"]) for i in range(60)]
    texts += [" ".join(f"v{j}_{i}" for j in range(40)) for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in ngram_join.classes(df).select("doc", "class_id", "n_links").collect()}
    assert got == {**{i: (0, 59) for i in range(60)}, **{60 + i: (60 + i, 0) for i in range(5)}}


def test_blocks_without_members(spark, monkeypatch):
    """Few long texts in several blocks by bytes, some of them empty: each link counts once."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 1600)
    texts = [" ".join([*(f"g{g}w{i}" for i in range(200)), f"end{k}"]) for g in range(12) for k in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.classes(df).select("doc", "class_id", "n_links").collect())
    assert got == [(i, i - i % 3, 2) for i in range(36)]


def test_rows_without_words_stay(spark):
    """Texts without words are documents of their own, also with null or repeated ids."""
    rows = [(None, ""), (None, ""), (None, None), (4, " \n"), (4, " \n"), (4, "a b c"), (4, "a b c"), (5, "a b c")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows[:6]))


def test_personal_data(docs):
    weights = pii.train(docs)
    got = pii.find(docs, weights).select("row.doc_id", "base_sha256", "spans", "redacted").collect()
    want = sorted((key(d), hashlib.sha256(",".join(plain_base(t or "")).encode()).hexdigest()) for d, t in TEXTS if d != 19)
    assert sorted((key(r[0]), r[1]) for r in got if r[0] != 19) == want
    by_id = {r[0]: r for r in got}
    assert "bob.42@" not in by_id[3][3] or "another" in by_id[3][3]
    assert "555-2485" not in by_id[12][3] and "4111" not in by_id[12][3] and "10.0.0.30" not in by_id[12][3].replace("10.0.0.300", "")
    out = pii.without_personal_data(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert out.where("n_chars <> length(text)").isEmpty()


def test_fingerprints(spark, docs):
    got = fingerprints.compare_with_edited(docs).select("doc_id", "n_chars", "edited_sha256").collect()
    th = {r[0]: r[1] for r in docs.selectExpr("coalesce(text, '') AS x", "xxhash64(coalesce(text, ''))").collect()}
    order = sorted(((key(d), th[t or ""], d, t or "") for d, t in TEXTS), key=lambda r: r[:2])
    want = []
    for i, (_, _, d, t) in enumerate(order):
        q = len(t) // 4
        edited = t[: len(t) - q] + order[(i + 1) % len(order)][3][:q]
        want.append((key(d), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((key(r[0]), *r[1:]) for r in got) == sorted(want)
    marks = fingerprints.fingerprints(docs)
    assert marks.schema["row"].dataType.names == [c for c in docs.columns if c != "text"]
    assert marks.where("size(hashes) <> size(positions)").isEmpty()


def test_packing(docs):
    got = packing.pack(docs).collect()
    _, ids = library_ids("byte_bpe_50k.json", [t or "" for _, t in TEXTS])
    left = sorted((d is not None, d, [*x, 1]) for (d, _), x in zip(TEXTS, ids) if d is not None)
    assert sum(r.length for r in got) == sum(len(x) + 1 for x in ids)
    wanted = {(d, len(x), zlib.crc32(packed(x[:2048]))) for _, d, x in left if len(x) <= 1}
    assert wanted <= {(r.doc_id, r.doc_tokens, r.ids_crc32) for r in got}
    by_doc = {d: x for _, d, x in left if [e[0] for e in TEXTS].count(d) == 1}
    for r in got:
        if r.doc_id in by_doc:
            assert r.ids_crc32 == zlib.crc32(packed(by_doc[r.doc_id][r.start : r.start + r.length]))
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_bpe(docs):
    t, ids = library_ids("word_bpe_49k.json", [t or "" for _, t in TEXTS])
    got = bpe.encode(docs).collect()
    want = sorted((key(d), packed(x), t.decode(x, skip_special_tokens=False).encode()) for (d, _), x in zip(TEXTS, ids))
    assert sorted((key(r[0]), bytes(r[1]), bytes(r[2])) for r in got) == want


def test_token_files(spark, docs, tmp_path):
    _, ids = library_ids("word_bpe_49k.json", [t or "" for _, t in TEXTS])
    token_files.write_tokens(docs, str(tmp_path / "t"))
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_files.index(spark, str(tmp_path / "t")).collect())
    assert sorted(r[1:] for r in got) == sorted((len(x) + 1, zlib.crc32(packed([*x, 1]))) for x in ids)
    at = 0
    for start, n, _ in got:
        assert start == at
        at += n


def test_token_counts(docs):
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((key(d), len((t or "").encode()), len(m.encode(t or ""))) for d, t in TEXTS)
    for hot in (0, 20, 10**6):
        got = token_counts.count_tokens(docs, hot_rows=hot).collect()
        assert sorted((key(r[0]), *r[1:]) for r in got) == want


def test_quality(spark, docs, labels):
    counted = quality.with_counts(docs)
    got = {(key(r[0]), r[1]): r[2] for r in counted.select("row.doc_id", "row.text", "counts").collect()}
    for d, t in TEXTS:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {p for i, x in enumerate(win) if win.count(x) > 1 for p in (i, i + 1, i + 2)} if len(win) < 6000 else None
        c = got[key(d), t]
        assert c["n_words"] == len(w) and c["word_chars"] == sum(map(len, w))
        if covered is not None:
            assert c["n_repeat_words"] == len(covered)
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns
    assert {r[0] for r in out.select("doc_id").collect()} == {9999} - {9999} | {14, 15, 16}


def test_quality_bounds(spark):
    """A cutoff holds its risk; strata without enough labels get none."""
    clean = "good plain words go on and on here with no marks at all number"
    rows = []
    for i in range(3000):
        junk = i % 10 == 0
        words = [f"{w}{i}x{j}" for j in range(5) for w in clean.split()]
        rows.append((i, " ".join(f"{w}###" if junk else w for w in words), "en" if i % 30 else "xx"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(3000)], "doc_id long, quality int")
    out = quality.judge(quality.with_counts(docs), quality.fit_cutoffs(quality.with_counts(docs), labels))
    gone = {r[0] for r in out.where("NOT kept").select("row.doc_id").collect()}
    assert gone == {i for i in range(3000) if i % 10 == 0 and i % 30}


def test_urls(spark):
    rows = [
        (1, "http://WWW.Example.com/en/a?x=/fr/", "r"), (2, "http://example.com/en/", "r"), (3, "http://a.b.example.com/en/x", "r"),
        (4, "http://example.com", "r"), (5, "https://x.net/es/1", "r"), (6, "https://net/fr/#a", "r"), (7, None, "r"),
        (8, "no scheme.com/en/", "r"), (9, "ftp://x.net/ads/1", "r"), (10, "http://x.org/a/login/b", "r"), (11, "", "r"),
        (12, "http://notexample.com/en/", "r"), (None, "http://x.com/", "r"), (1, "http://WWW.Example.com/en/a?x=/fr/", "r"),
        (13, "http://x.org/tag/a b/feed/", "r"), (14, "http://user@example.com/en/", "r"), (15, "x://" + "a." * 20_000 + "com/", "r"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = url_filters.rule_table(spark, (url_filters.LISTED, url_filters.PATTERNS))
    got = {r[0]: (r[1], r[2]) for r in url_filters.judge(pages, rules).select("row.page_id", "rule", "verdict").collect()}
    assert url_filters.judge(pages, rules).count() == len(rows)
    assert got[1] == ("www.example.com/en/", "allow") and got[2] == ("example.com/en/", "block") and got[3] == ("example.com/en/", "block")
    assert got[4] == (None, "allow") and got[5] == ("net/es/", "block") and got[6] == ("net/fr/", "block")
    assert got[7] == got[8] == got[11] == (None, "allow")
    assert got[9] == ("*/ads/", "block") and got[10] == ("*/login/", "block") and got[13] == ("*/tag/*/feed/", "block")
    assert got[12] == ("com/", "allow") and got[14] == ("com/", "allow") and got[15] == ("com/", "allow")


def test_empty_tables(spark, docs, labels, folder, tmp_path):
    none = docs.limit(0)
    assert line_dedup.drop_lines(none).isEmpty()
    assert ngram_join.classes(none).isEmpty()
    assert fingerprints.compare_with_edited(none).isEmpty() and fingerprints.fingerprints(none).isEmpty()
    assert bpe.encode(none).isEmpty() and token_counts.count_tokens(none).isEmpty()
    token_files.write_tokens(none, str(tmp_path / "t"))
    assert token_files.index(spark, str(tmp_path / "t")).isEmpty()
    rules = url_filters.rule_table(spark, (url_filters.LISTED,))
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(pages, rules).isEmpty()
    some = spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string")
    assert url_filters.judge(some, rules.limit(0)).head()["verdict"] == "allow"
    out = none
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, folder)
        assert out.isEmpty(), name
    assert quality.keep_good(docs, labels.limit(0)).count() == 3


def test_stages_keep_columns(spark, docs, folder):
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert out.columns == docs.columns, name
    assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, out, folder).columns
