"""Personal data by fixed patterns and a skip-chain conditional random field (operator 4).

The patterns find what has the full form of an e-mail address, IP address, card
or phone number; these base spans always stay. A match that a pattern drops
because it ran on into a neighbour is searched again for the spans inside it;
these are known like base spans, but not counted as such. The random field adds
what the patterns miss. Its nodes are the tokens that hold a digit or an @; all
other tokens are fixed to "none" by definition and only serve as context features.
Potentials: the features of a token and its neighbours; chain edges between
tokens side by side; skip edges between a token and the next one, however far,
with the same letters and digits, the same last seven digits or the same part
before an @. Known spans clamp their tokens, and loopy sum-product message passing
carries them along the edges, so that equal or similar tokens get one label
through the whole document. Runs of tokens whose marginal reaches ADD become
added spans.

The weights are fitted by pseudo-likelihood on a bounded sample with the known
spans as labels: at most TRAIN_DOCS documents, chosen by the hash of their id,
with at most TRAIN_TOKENS such tokens each. All documents are searched whole.

Defined results: a null text is empty and has no spans; a null id is kept; rows
are searched each for itself, so repeated rows give equal rows.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.text import table, whole

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)

#: Training sample (see above) and the marginal from which a token is added.
TRAIN_DOCS = 3000
TRAIN_TOKENS = 200
ADD = 0.95
ROUNDS = 12
STEPS = 250
BUCKETS = 2048

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(LOCAL)
# A run of digits is only entered at its start: a later entry fails as the first did.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile("[0-9@]")
_GAP = re.compile(r"\s")
_ALNUM = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from their @: the part before it reaches as far back as it can."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_RUN = re.compile(r"[0-9]+")
_PART = re.compile(r"\.[0-9]+")


def _cards_within(text: str, start: int, end: int):
    """Cards among the groups of digits of a dropped match: single groups, else windows of groups of 4 or more (the last 3)."""
    groups = [m.span() for m in _RUN.finditer(text, start, end)]
    alone = {g for g in groups if 14 <= g[1] - g[0] <= 19 and luhn(text[g[0] : g[1]])}
    yield from alone
    for i in range(len(groups)):
        digits = ""
        for j in range(i, len(groups)):
            a, b = groups[j]
            if b - a < 3 or (a, b) in alone or len(digits) + b - a > 19:
                break
            digits += text[a:b]
            # Windows that overlap are all given: none of them can be ruled out.
            if j > i and len(digits) >= 14 and luhn(digits):
                yield groups[i][0], b
            if b - a < 4:
                break


def retried_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans inside matches that base_spans drops whole because they ran on into a neighbour, by start, then kind.

    A dropped card or IP match is searched again from each of its groups of
    digits. A dropped phone match ends before the next other span in it; if none
    leaves it its digits, all its beginnings of 10 to 15 digits are given.
    """
    held, out, done = set(base), set(), 0
    for m in _IP.finditer(text):
        if m.start() < done or (m.start(), 1, m.end()) in held:
            continue
        done = m.end()
        while n := _PART.match(text, done):
            done = n.end()
        groups = [g.span() for g in _RUN.finditer(text, m.start(), done)]
        parts = [text[a:b].lstrip("0") for a, b in groups]
        fits = [len(p) <= 3 and int(p or 0) <= 255 for p in parts]
        i = 1
        while i + 4 <= len(groups):
            if all(fits[i : i + 4]):
                out.add((groups[i][0], 1, groups[i + 3][1]))
                i += 4
            else:
                i += 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 14 and (m.start(), 2, m.end()) not in held:
            out.update((a, 2, b) for a, b in _cards_within(text, m.start(), m.end()))
    if "+" in text:
        starts = sorted(a for a, kind, _ in held | out if kind in (1, 2))
        for m in _PHONE.finditer(text):
            if (m.start(), 3, m.end()) in held:
                continue
            k = bisect.bisect_right(starts, m.start())
            stop = starts[k] if k < len(starts) and starts[k] < m.end() else m.end()
            groups = [g.span() for g in _RUN.finditer(text, m.start(), m.end())]
            n = list(itertools.accumulate(b - a for a, b in groups))
            fits = [(m.start(), 3, b) for x, (_, b) in zip(n, groups) if 10 <= x <= 15]
            before = [s for s in fits if s[2] <= stop]
            out.update(before[-1:] if stop < m.end() and before else fits)
    return sorted(out - held)


def _tokens(text: str):
    """(start, end) of the runs without white space that hold a digit or an @; linear in the text."""
    done = 0
    while (m := _MARK.search(text, done)) is not None:
        a = m.start()
        while a > done and not text[a - 1].isspace():
            a -= 1
        gap = _GAP.search(text, m.end())
        done = gap.start() if gap else len(text)
        yield a, done


def _bucket(kind: str, value: object) -> int:
    return zlib.crc32(f"{kind}={value}".encode("utf-8", "surrogatepass")) % BUCKETS


def _shape(token: str) -> str:
    out = []
    for c in token[:64]:
        s = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def _features(token: str, before: str, after: str) -> list[int]:
    digits = _digits(token)
    parts = token.strip("!?,;:#*$%&|<>\"'()").split(".")
    ip = len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return [
        _bucket("bias", 1),
        _bucket("shape", _shape(token)),
        _bucket("digits", min(len(digits), 20)),
        _bucket("length", min(len(token), 24) // 2),
        _bucket("at", min(token.count("@"), 2)),
        _bucket("dots", min(token.count("."), 4)),
        _bucket("dashes", min(token.count("-"), 4)),
        _bucket("plus", token.startswith("+")),
        _bucket("letters", any(c.isalpha() for c in token)),
        _bucket("ip", ip),
        _bucket("luhn", 13 <= len(digits) <= 19 and luhn(digits)),
        _bucket("before", before[-8:].lower()),
        _bucket("after", after[:8].lower()),
        _bucket("before shape", _shape(before)),
        _bucket("after shape", _shape(after)),
    ]


N_FEATURES = 15


class Graph:
    """The random field of one or many documents: nodes in order, edges as index pairs."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []
        self.features: list[list[int]] = []
        self.base: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, text: str, base: list[tuple[int, int, int]]) -> tuple[int, int]:
        """Add a document's tokens; returns the range of its nodes."""
        first, seen, k = len(self.spans), {}, 0
        open_: list[tuple[int, int, int]] = []
        for a, b in _tokens(text):
            token = text[a:b]
            node = len(self.spans)
            while k < len(base) and base[k][0] < b:
                open_.append(base[k])
                k += 1
            open_ = [s for s in open_ if s[2] > a]
            hits = [kind for start, kind, end in open_ if start < b and end > a]
            before = text[max(0, a - 24) : a].split()
            after = text[b : b + 24].split()
            self.features.append(_features(token, before[-1] if before else "", after[0] if after else ""))
            self.base.append(min(hits) if hits else -1)
            if node > first and not text[self.spans[-1][1] : a].strip() and a - self.spans[-1][1] <= 3:
                self.chain.append((node - 1, node))
            digits = _digits(token)
            keys = [("same", _ALNUM.sub("", token).lower())]
            if len(digits) >= 7:
                keys.append(("tail", digits[-7:]))
            if "@" in token:
                keys.append(("local", token.split("@")[0].lower()))
            for key in keys:
                if len(key[1]) >= 4:
                    if key in seen and seen[key] != node:
                        self.skip.append((seen[key], node))
                    seen[key] = node
            self.spans.append((a, b))
        return first, len(self.spans)

    def arrays(self):
        f = np.array(self.features, np.int64).reshape(-1, N_FEATURES)
        edges = [np.array(sorted(set(e)), np.int64).reshape(-1, 2) for e in (self.chain, self.skip)]
        return f, np.array(self.base, np.int64), *edges


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def fit(features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> dict[str, np.ndarray]:
    """Weights that maximise the pseudo-likelihood: each label given those of its neighbours."""
    n, k = len(labels), NONE + 1
    w = {"unary": np.zeros((BUCKETS, k)), "chain": np.zeros((k, k)), "skip": np.zeros((k, k))}
    if not n:
        w["unary"][:, NONE] = 1.0
        return w
    y = np.eye(k)[labels]
    nb = {}
    for name, e in (("chain", chain), ("skip", skip)):
        m = np.zeros((n, k))
        np.add.at(m, e[:, 0], y[e[:, 1]])
        np.add.at(m, e[:, 1], y[e[:, 0]])
        nb[name] = m
    flat = features.ravel()
    speed = {name: np.zeros_like(v) for name, v in w.items()}
    for _ in range(STEPS):
        p = _softmax(w["unary"][features].sum(1) + nb["chain"] @ w["chain"] + nb["skip"] @ w["skip"])
        d = y - p
        g = {name: (nb[name].T @ d + d.T @ nb[name]) / 2 for name in ("chain", "skip")}
        rep = np.repeat(d, N_FEATURES, 0)
        g["unary"] = np.stack([np.bincount(flat, rep[:, c], BUCKETS) for c in range(k)], 1)
        for name in w:
            grad = g[name] - 0.05 * w[name]
            speed[name] += grad**2
            w[name] += 0.3 * grad / np.sqrt(speed[name] + 1e-8)
    return w


def marginals(w: dict[str, np.ndarray], features, base, chain, skip) -> np.ndarray:
    """Label probabilities after ROUNDS of sum-product messages along all edges."""
    unary = w["unary"][features].sum(1)
    clamped = base >= 0
    unary[clamped] = -30.0
    unary[clamped, base[clamped]] = 30.0
    unary -= unary.max(1, keepdims=True)
    # Every edge in both directions, its messages in logarithms.
    src = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    dst = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    nc, ns = len(chain), len(skip)
    if not len(src):
        return _softmax(unary)
    back = np.concatenate(
        [np.arange(nc, 2 * nc), np.arange(nc), 2 * nc + np.arange(ns, 2 * ns), 2 * nc + np.arange(ns)]
    ).astype(np.int64)
    pot = np.concatenate([np.repeat(w["chain"][None], 2 * nc, 0), np.repeat(w["skip"][None], 2 * ns, 0)])
    msg = np.zeros((len(src), NONE + 1))
    for _ in range(ROUNDS):
        total = unary.copy()
        np.add.at(total, dst, msg)
        out = (total[src] - msg[back])[:, :, None] + pot
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        msg = 0.5 * msg + 0.5 * new
    total = unary.copy()
    np.add.at(total, dst, msg)
    return _softmax(total)


def _added(text: str, spans, base, prob, chained) -> list[tuple[int, int, int]]:
    """Runs of chained tokens that the field labels alike, without the marks around them."""
    out: list[list[int]] = []
    label = prob.argmax(1)
    for i, (a, b) in enumerate(spans):
        if base[i] >= 0 or label[i] == NONE or prob[i, label[i]] < ADD:
            continue
        if out and out[-1][3] == i - 1 and out[-1][1] == label[i] and chained[i]:
            out[-1][2], out[-1][3] = b, i
        else:
            out.append([a, int(label[i]), b, i])
    found = []
    for a, kind, b, _ in out:
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            found.append((a, kind, b))
    return found


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def search(w: dict[str, np.ndarray], texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; the fields of all texts pass messages at once."""
    g = Graph()
    base = [base_spans(t) for t in texts]
    again = [retried_spans(t, b) for t, b in zip(texts, base)]
    ranges = [g.add(t, sorted([*b, *r])) for t, b, r in zip(texts, base, again)]
    features, clamped, chain, skip = g.arrays()
    prob = marginals(w, features, clamped, chain, skip) if len(features) else np.zeros((0, NONE + 1))
    chained = np.zeros(len(g.spans), bool)
    chained[chain[:, 1]] = True
    out = []
    for t, b, r, (i, j) in zip(texts, base, again, ranges):
        more = _added(t, g.spans[i:j], clamped[i:j], prob[i:j], chained[i:j]) if j > i else []
        out.append((b, sorted([*b, *r, *more])))
    return out


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span replaced by its kind in brackets; spans that overlap by that of the first."""
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def _train_rows(batches):
    """Per text: features, labels and edges of its tokens."""
    for batch in batches:
        rows = []
        for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
            g = Graph()
            base = base_spans(text)
            g.add(text, sorted([*base, *retried_spans(text, base)]))
            if 0 < len(g.spans) <= TRAIN_TOKENS:
                f, y, c, s = g.arrays()
                rows.append((h, f.ravel().tolist(), y.tolist(), c.ravel().tolist(), s.ravel().tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64())]
            + [pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in range(1, 5)],
            names=["h", "features", "labels", "chain", "skip"],
        )


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict[str, np.ndarray]:
    """Fit on at most TRAIN_DOCS documents with candidate tokens, the first by the hash of their id."""
    n = docs.count()
    share = min(1.0, 20 * TRAIN_DOCS / max(1, n))
    h = F.xxhash64(docs[doc_id])
    rows = (
        docs.select(h.alias("h"), whole(docs[text]).alias("text"))
        .where(F.pmod(F.xxhash64(F.lit("sample"), "h"), F.lit(1_000_000)) < int(share * 1_000_000))
        .where(F.col("text").rlike("[0-9@]"))
        .mapInArrow(
            _train_rows, "h long, features array<long>, labels array<long>, chain array<long>, skip array<long>"
        )
        .orderBy("h", F.xxhash64("features"))
        .limit(TRAIN_DOCS)
        .toArrow()
        .to_pylist()
    )
    f, y, c, s, at = [], [], [], [], 0
    for r in rows:
        f += r["features"]
        y += r["labels"]
        c += [x + at for x in r["chain"]]
        s += [x + at for x in r["skip"]]
        at += len(r["labels"])
    labels = np.array(y, np.int64)
    labels[labels < 0] = NONE
    shaped = [np.array(x, np.int64).reshape(-1, k) for x, k in ((f, N_FEATURES), (c, 2), (s, 2))]
    return fit(shaped[0], labels, shaped[1], shaped[2])


def find(docs: DataFrame, weights: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """(row, counts of base spans, base_sha256, spans, redacted) per input row."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got = search(weights, texts)
            counts = [[sum(s[1] == k for s in b) for b, _ in got] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b, _ in got], pa.string()),
                    pa.array([_listed(s) for _, s in got], pa.string()),
                    pa.array([redact(t, s) if s else t for t, (_, s) in zip(texts, got)], pa.string()),
                ],
                names=["row", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "redacted"],
            )

    held = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c != text] or [F.lit(0).alias("_")]).alias("row"),
        whole(docs[text]).alias("text"),
    )
    row = held.schema["row"].dataType.simpleString()
    return held.mapInArrow(
        run,
        f"row {row}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, redacted string",
    )


def without_personal_data(docs: DataFrame) -> DataFrame:
    """All documents, spans replaced by their kind in brackets, n_chars counted again; all columns stay."""
    out = find(docs, train(docs))
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = find(docs, train(docs))
    return out.select("row.doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")
