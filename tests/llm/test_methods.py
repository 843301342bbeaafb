"""The parts of the methods on their own: exactness, bounds and guarantees."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_queries import library_ids, packed, plain_base

from shutterlake.llm import bpe, chunks, fingerprints, ngram_join, packing, pii, token_counts

ALPHABET = "ab Zé'sst're\n\t 12９.,!-+()@%ÀΣσİßǅ漢🙂▁\x00\x1c\x85\xa0"
odd = st.text(st.sampled_from(ALPHABET), max_size=40) | st.text(max_size=30).filter(
    lambda s: not any(0xD800 <= ord(c) <= 0xDFFF for c in s)
)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a0.@-+ 19()%_"), max_size=40))
def test_base_spans(text):
    assert [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.base_spans(text)] == plain_base(text)


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET + "<|endoftext|>") for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("name", "space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_ids_of_whole_texts(name, space):
    import public_tokenizers

    texts = [*random_texts(3000, 1), "x<|endoftext|>y", " <|endoftext|>  <|endoftext|> z ", "", "  ", "\n\n"]
    _, ids = library_ids(name, texts)
    with open(public_tokenizers.path(name), "rb") as f:
        got = chunks.library_chunks(f.read(), space).ids(texts)
    assert got == [packed(x) for x in ids]


@pytest.mark.parametrize(("name", "space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_latin_words_need_only_the_merges(name, space):
    """Every letter of the direct way, in words with marks, line feeds and spaces around them."""
    import public_tokenizers

    r = random.Random(7)
    letters = [chr(i) for i in range(0x250) if chunks.PLAIN.fullmatch(chr(i))]
    texts = [f"{c} {c}a\n{c}b, x{c}\n {c}!" for c in letters]
    for _ in range(3000):
        words = ["".join(r.choices("etaoin shr" if r.random() < 0.7 else letters, k=r.randint(1, 12))) for _ in range(5)]
        texts.append("".join(w + r.choice(["", ".", "'s,", "$$$", "<|", "|>", "1.", ")\""]) + r.choice(" \n") for w in words))
    texts.append("x<|endoftext|> y<|endoftext|>, <|endoftext|>.")
    _, ids = library_ids(name, texts)
    with open(public_tokenizers.path(name), "rb") as f:
        got = chunks.library_chunks(f.read(), space).ids(texts)
    assert got == [packed(x) for x in ids]


@pytest.fixture(scope="module")
def words():
    import public_tokenizers

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        return bpe._tables(f.read())


def test_bpe_random_texts(words):
    model, held = words
    texts = [*random_texts(3000, 2), "a" * 5000, "ab" * 3000, "!" * 4000, "<|startoftext|>x<|endoftext|><|endoftext|>"]
    t, ids = library_ids(bpe.VOCABULARY, texts)
    for row, want in zip(held.lists(texts), ids):
        assert b"".join(x for x, _ in row) == packed(want)
        assert b" ".join(y for x, y in row if x).decode() == t.decode(want, skip_special_tokens=False)


def test_bpe_pairs_against_merging(words):
    """The pair test says what merging both tokens' letters says."""
    model, _ = words
    r = random.Random(3)
    plain = [i for s, i in model.vocab.items() if not s.endswith(model.end) and model.sure[i]]
    a, b = (np.array([r.choice(plain) for _ in range(4000)]) for _ in range(2))
    got = model.compatible(a, b)
    want = [model.merge(model.names[x] + model.names[y], False) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert got.tolist() == want and not all(want)


@settings(max_examples=300, deadline=None)
@given(odd)
def test_pre_token_sums(text):
    import public_tokenizers

    with open(public_tokenizers.path(token_counts.VOCABULARY), "rb") as f:
        m = token_counts._model(f.read())
    assert sum(token_counts.count_pieces(m, token_counts.pre_tokens(text))) == len(m.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abc🙂"), max_size=150), st.text(st.sampled_from("abc🙂"), max_size=80), st.text(st.sampled_from("ab"), min_size=47, max_size=60))
def test_shared_runs_share_a_mark(before, after, shared):
    x, y = before + shared, shared + after
    (hx, px), (hy, py) = fingerprints.marks([x, y])
    assert set(hx.tolist()) & set(hy.tolist())
    assert (np.diff(px) > 0).all() and (np.diff(py) > 0).all()
    alone = fingerprints.marks([x])[0]
    assert alone[0].tolist() == hx.tolist() and alone[1].tolist() == px.tolist()


def plain_marks(text):
    """Winnowing window by window, from the hashes of the library's own runs."""
    k, w = fingerprints.K, fingerprints.W
    grams = [int(fingerprints.marks([text[i : i + k]])[0][0][0]) for i in range(len(text) - k + 1)]
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        win = grams[i : i + w]
        at = max(j for j in range(len(win)) if win[j] == min(win)) + i
        if not out or out[-1] != at:
            out.append(at)
    return [grams[i] for i in out], out


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab"), min_size=16, max_size=120))
def test_winnowing_by_hand(text):
    h, p = fingerprints.marks([text, "other"])[0]
    assert (h.tolist(), p.tolist()) == plain_marks(text)


def test_marks_of_long_texts_in_pieces(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choices("ab \n", k=n)) for n in (0, 3, 15, 16, 46, 47, 48, 99, 147, 1000, 5000)] + ["a" * 900, "ab" * 700]
    want = [fingerprints.marks([t])[0] for t in texts]
    monkeypatch.setattr(fingerprints, "PIECE", 100)
    for (h, p), (x, y) in zip(fingerprints.all_marks(texts), want, strict=True):
        assert h.tolist() == x.tolist() and p.tolist() == y.tolist()


def test_heads_of_one_id(monkeypatch):
    """Slices that begin with the same id: a row goes to the last one whose head it doesn't precede."""
    heads = [(1, 5), (1, 9), (2, -3), (2, 0), (2, 7), (4, 1)]
    rows = [(0, 3), (1, 5), (1, 8), (1, 9), (1, 11), (2, -9), (2, -3), (2, 6), (2, 7), (3, 0), (4, 0), (4, 1), (9, 9)]
    batch = pa.RecordBatch.from_pydict(
        {"doc": pa.array([d for d, _ in rows], pa.int64()), "th": pa.array([t for _, t in rows], pa.int64())}
    )
    got = next(iter(fingerprints._place(heads)([batch]))).to_pydict()
    placed = [s for s, extra in zip(got["slice"], got["extra"]) if not extra]
    assert placed == [max([i for i, h in enumerate(heads) if h <= row], default=0) for row in rows]


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.1, 0.999999, 4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=200))
def test_packing_plan(lengths):
    """Every piece once, no gap, no padding, for a small window."""
    hist = np.bincount(np.array(lengths, np.int64), minlength=64)[:64]
    plan = packing.Plan(hist, 3, 64)
    number, seqs = [0] * 65, {}
    for n in lengths:
        parts = plan.place(n, number[n])
        number[n] += 1
        assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts]).tolist()[:-1]]
        assert sum(p[1] for p in parts) == n
        for _, m, q, at in parts:
            seqs.setdefault(q, []).append((at, m))
    assert sorted(seqs) == list(range(3, 3 + len(seqs)))
    for parts in seqs.values():
        at = 0
        for o, m in sorted(parts):
            assert o == at
            at += m
        assert at == 64 or at & (at - 1) == 0


def test_least_squares_beats_no_combination():
    r = np.random.default_rng(5)
    hist = np.bincount(r.integers(1, 64, 5000), minlength=64)
    combos = packing.combinations(np.flatnonzero(hist), 64)
    assert {tuple(sorted(x)) for x in combos.tolist()} == {
        tuple(sorted((a, b, c))) for a in range(64) for b in range(64) for c in range(64) if a + b + c == 64 and (a > 0) + (b > 0) + (c > 0) >= 2
    }
    x = packing.repeat_counts(hist, combos)
    made = np.zeros(64)
    for p, row in enumerate(combos.tolist()):
        for v in row:
            if v:
                made[v] += x[p]
    assert (x >= 0).all() and np.square(hist - made).sum() < 0.05 * np.square(hist).sum()
    n = packing.whole_counts(hist, combos, x)
    used = np.zeros(64, int)
    for p, row in enumerate(combos.tolist()):
        for v in row:
            if v:
                used[v] += n[p]
    assert (used <= hist).all() and used.sum() > 0.8 * hist.sum()


def test_field_carries_labels_over_a_document():
    """A number without its full form gets the label of the same number elsewhere; another one stays."""
    r = random.Random(7)
    texts = []
    for _ in range(300):
        n = f"{r.randint(100, 999)}-{r.randint(1000, 9999)}"
        texts.append(f"write to x{n[:2]}@mail.example.com or call +1 (988) {n} about item {r.randint(10, 99)} on page {r.randint(1, 9)}.")
    g, rows = pii.Graph(), []
    for t in texts:
        rows.append(g.add(t, pii.base_spans(t)))
    f, y, c, s = g.arrays()
    w = pii.fit(f, np.where(y < 0, pii.NONE, y), c, s)
    text = "call +1 (988) 123-4567 today. Ask for x42 in room 12, then dial 123-4567 again."
    (base, spans), (_, plain) = pii.search(w, [text, "Ask for x42 in room 12 at once."])
    assert (text.rindex("123-4567"), 3, text.rindex("123-4567") + 8) in spans and len(base) == 1
    assert plain == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("que 7536784127813050 4845168114407329 aique", ["card:4:20", "card:21:37"]),  # sf0.1, document 46
        ("h 2353820953013749 4550997810720808 th", ["card:19:35"]),  # 1262
        ("Des +1 (826) 555-4081 190.137.223.204 du", ["phone:4:21", "ip:22:37"]),  # 1377
        ("un. +1 (843) 555-7672 170.106.47.218 Et", ["phone:4:21", "ip:22:36"]),  # 7052
        ("r, 4465758382889437 4465758382889437 \u00f3", ["card:3:19", "card:20:36"]),  # sf0.01, 254 and 402
        ("12 4111 1111 1111 1111 99 and 4111-1111-1111-1111 12345", ["card:3:22", "card:30:49"]),
        ("at 300.10.0.0.7", ["ip:7:15"]),
        ("+1 (826) 555-4081 4845168114407329", ["phone:0:17", "card:18:34"]),
        ("+49 1512 3456 7890 12345", ["phone:0:13", "phone:0:18", "card:4:24"]),
        ("1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 and 10.0.0.300 or 999.1.1", []),
    ],
)
def test_neighbours_do_not_hide_spans(text, want):
    """A match that ran on into a neighbour is searched again; base spans stay as they are."""
    none = np.zeros((0, 2), np.int64)
    w = pii.fit(np.zeros((0, pii.N_FEATURES), np.int64), np.zeros(0, np.int64), none, none)
    [(base, spans)] = pii.search(w, [text])
    assert [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base] == plain_base(text)
    assert [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans] == want
    assert pii.redact(text, spans).count("[") <= len(spans)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("04.-+ 1()"), max_size=60))
def test_retried_spans_keep_the_rules(text):
    base = pii.base_spans(text)
    for a, kind, b in pii.retried_spans(text, base):
        assert any(pii.KINDS[kind] + f":{0}:{b - a}" == x for x in plain_base(text[a:b])) and (a, kind, b) not in base


def test_log_tail_is_exact(spark):
    from pyspark.sql import functions as F

    from shutterlake.llm.quality import _log_tail

    df = spark.createDataFrame([(0, 500), (3, 900), (12, 4000)], "k long, n long")
    got = df.select("k", "n", _log_tail(F.col("k"), F.col("n").cast("double"), 0.004).alias("x")).collect()
    for k, n, x in got:
        want = sum(math.comb(n, i) * 0.004**i * 0.996 ** (n - i) for i in range(k + 1))
        assert math.isclose(math.exp(x), want, rel_tol=1e-9)
