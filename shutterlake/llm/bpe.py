"""BPE encoding by speculation and verification, and decoding (operator 8).

A word is first cut greedily into the longest tokens that match. That guess is
the exact encoding if each token encodes to itself and no pair of neighbours
could ever have merged across its border. Both facts are facts of the
vocabulary: the first is a table made once, the second is tested for all pairs
of all new words at once with arrays. Only words that fail are merged exactly,
by rank. Each distinct chunk of text is encoded once per task process (`chunks`).

The test of a pair walks its two trees of merges from the top: of the two border
symbols, the one that was made last is replaced by its part at the border, and a
pair that has a merge of a rank below that of the replaced symbol would have been
taken first. Equal ranks go to the left merge.

Defined results: a null or empty text, or one of white space only, has no tokens
and decodes to the empty text; special strings in a text are their tokens; a null
id is kept; repeated rows are encoded each.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.chunks import WHITE, Chunks, byte_letters, packed, space_free, text_slices, vocabulary
from shutterlake.llm.text import table, whole
from shutterlake.llm.worker import held

VOCABULARY = "word_bpe_49k.json"
NEVER = 1 << 40

#: The word pattern of the vocabulary file, white space written out.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"


class Bpe:
    """Tables of one vocabulary file with lower-cased words and an end-of-word mark."""

    def __init__(self, spec: bytes):
        model = json.loads(spec)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.end: str = model["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.letters = byte_letters()
        self.word = regex.compile(WORD)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        n = max(self.names) + 1
        self.left, self.right = np.arange(n), np.arange(n)
        self.rank = np.full(n, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges.setdefault((x, y), (r, z))
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([x * n + y for x, y in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        order = np.argsort(keys)
        self.n, self.keys, self.ranks = n, keys[order], ranks[order]
        self.longest = max(map(len, self.vocab))
        self.sure = np.zeros(n, bool)
        for s, i in self.vocab.items():
            mark = bool(self.end) and s.endswith(self.end)
            self.sure[i] = self.merge(s[: -len(self.end)] if mark else s, mark) == [i]

    def _start(self, word: str, mark: bool) -> list[int]:
        out = [self.vocab[c] for c in word[:-1]]
        return [*out, self.vocab[word[-1] + (self.end if mark else "")]] if word else []

    def merge(self, word: str, mark: bool = True) -> list[int]:
        """The exact encoding: lowest rank first, then leftmost; in n log n for long words."""
        ids = self._start(word, mark)
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if (m := self.merges.get((ids[i], ids[i + 1]))) is not None:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i] if ids[i] == x else -1
            if j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := self.merges.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (m[0], a, ids[a], ids[b], m[1]))
        return [x for x in ids if x >= 0]

    def guess(self, word: str) -> list[int]:
        """The longest token that matches, again and again; the last one has the end mark."""
        out, i, n, vocab = [], 0, len(word), self.vocab
        while i < n:
            rest = word[i:] + self.end
            if n - i + len(self.end) <= self.longest and rest in vocab:
                out.append(vocab[rest])
                break
            for j in range(min(n - 1, i + self.longest), i, -1):
                if (t := vocab.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return []
        return out

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two tokens side by side stay two tokens."""
        ok = self.pair_ranks(a, b) == NEVER
        live = np.flatnonzero(ok)
        a, b = a[live], b[live]
        while len(live):
            ra, rb = self.rank[a], self.rank[b]
            more = (ra >= 0) | (rb >= 0)
            live, a, b, ra, rb = live[more], a[more], b[more], ra[more], rb[more]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            good = self.pair_ranks(a, b) >= limit
            ok[live[~good]] = False
            live, a, b = live[good], a[good], b[good]
        return ok

    def words(self, words: list[str]) -> list[list[int]]:
        """Encode distinct words (as byte letters): guess all, test all pairs at once, merge what failed."""
        ids = [self.guess(w) for w in words]
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.array([t for x in ids for t in x], np.int64)
        owner = np.repeat(np.arange(len(ids)), n)
        failed = n == 0
        if len(flat):
            failed[owner[~self.sure[flat]]] = True
            inner = owner[1:] == owner[:-1]
            bad = ~self.compatible(flat[:-1][inner], flat[1:][inner])
            failed[owner[1:][inner][bad]] = True
        for i in np.flatnonzero(failed).tolist():
            ids[i] = self.merge(words[i])
        return ids

    def normal(self, text: str) -> str:
        """Composed, lower case by character (a last sigma is no special case)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks without white space, their distinct words encoded together."""
        parts: list[list[object]] = []
        for c in chunks:
            row: list[object] = []
            for s in self.marks.split(c) if self.marks and "<|" in c else (c,):
                if s in self.special:
                    row.append(self.special[s])
                elif s:
                    row += self.word.findall(self.normal(s))
            parts.append(row)
        distinct = list({w for row in parts for w in row if isinstance(w, str)})
        letters = self.letters
        spelled = ["".join([letters[b] for b in w.encode("utf-8", "surrogatepass")]) for w in distinct]
        ids = dict(zip(distinct, self.words(spelled)))
        return [[t for w in row for t in (ids[w] if isinstance(w, str) else (w,))] for row in parts]

    def decode(self, ids: list[int]) -> str:
        """The names of the tokens, one space between: what a vocabulary file without a decoder gives."""
        return " ".join([self.names[i] for i in ids])


def _tables(spec: bytes) -> tuple[Bpe, Chunks]:
    """The tables, and the known chunks: each maps to (packed ids, decoded bytes)."""

    def make() -> tuple[Bpe, Chunks]:
        bpe = Bpe(spec)
        return bpe, Chunks(
            space_free,
            lambda new: [(packed(x), bpe.decode(x).encode()) for x in bpe.chunks(new)],
            lambda a, b: (a[0] + b[0], a[1] + b" " + b[1]),
        )

    return held("bpe", (zlib.crc32(spec), len(spec)), make)


def _encode(spec):
    def run(batches):
        _, chunks = _tables(spec.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_slices(texts):
                ids, decoded = [], []
                for row in chunks.lists(texts[a:b]):
                    ids.append(b"".join([x for x, _ in row]))
                    decoded.append(b" ".join([y for x, y in row if x]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )

    return run


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_file: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded) per row: ids as little-endian unsigned 32-bit integers, decoded as UTF-8."""
    spec = vocabulary(docs.sparkSession, vocabulary_file)
    read = docs.select(docs[doc_id].alias("doc_id"), whole(docs[text]).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(_encode(spec), f"doc_id {kind}, ids binary, decoded binary")


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = encode(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
