"""Token ids of whole texts by a public tokenizer, each distinct chunk encoded once per task process.

A chunk is a run of white space and the word after it, or one line feed before a
plain word. The tokenizers used here split text before their merges, and always
between a character that is no white space and one that is, so the ids of a text
are those of its chunks in order.
The test suite compares the ids with those of whole texts.

The vocabulary file is read on the driver and shipped to the executors, which
need the library but not the path. The table of known chunks is bounded, and
results don't depend on it.
"""

from __future__ import annotations

import json
import operator
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import public_tokenizers
from pyspark.sql import SparkSession

from shutterlake.llm.worker import held

MEMO = 250_000
PART = 250_000

#: Unicode's white space, as the inside of a character class.
WHITE = (
    "\t-\r\x20\x85\xa0"
    + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    + chr(0x2000) + "-" + chr(0x200A)
)


def vocabulary(spark: SparkSession, name_or_path: str):
    """A broadcast of the file's bytes; its size is that of a vocabulary, whatever the data."""
    path = name_or_path if os.path.sep in name_or_path else public_tokenizers.path(name_or_path)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


#: Latin letters that are single, composed and lower-cased one by one (U+0130 becomes two).
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-" + chr(0x12F) + chr(0x131) + "-" + chr(0x24F)
PLAIN = re.compile(f" ?[{LATIN}]+")
WITH_SPACE = re.compile(f"\n(?= ?[{LATIN}])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
NO_SPACE = re.compile(f"[^{WHITE}]+")
#: ASCII's marks.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STEM_ENDS = frozenset(filter(re.compile(f"[{LATIN}0-9]").match, map(chr, range(0x250))))


def space_free(text: str) -> list[str]:
    """Runs without white space; `split` also splits at four controls that are none here."""
    if any(map(text.__contains__, "\x1c\x1d\x1e\x1f")):
        return NO_SPACE.findall(text)
    return text.split()


class Chunks:
    """Texts to bytes, from a function that gives the bytes of many new chunks.

    Known chunks are kept in two generations of about MEMO entries: a chunk used
    again moves to the younger, and when that is full the older is dropped. A new
    chunk is first cut before its closing marks, so its parts may be known.
    """

    def __init__(
        self,
        find: Callable[[str], list[str]],
        encode: Callable[[list[str]], list],
        joined: Callable = operator.add,
    ):
        self.find, self.encode, self.joined = find, encode, joined
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def _missing(self, chunks: set[str], young: dict, old: dict) -> list[str]:
        """Those that are not in the younger table, nor can be moved there."""
        chunks = chunks.difference(young)
        if not old:
            return list(chunks)
        young.update({c: old[c] for c in chunks if c in old})
        return [c for c in chunks if c not in old]

    def lists(self, texts: list[str]) -> Iterable[list]:
        """For each text what its chunks map to; few texts at a time, which stay in the processor's cache."""
        for a, b in text_slices(texts, PART):
            found = list(map(self.find, texts[a:b]))
            self._learn(found)
            get = self.young.__getitem__
            for chunks in found:
                yield list(map(get, chunks))

    def _learn(self, found: list[list[str]]) -> None:
        """Make all chunks known."""
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        # Marks after a letter or digit are words of their own to the vocabularies here.
        # Special strings begin with '<', so none is cut. Flat lists, as many small
        # objects would keep the garbage collector busy.
        wholes, stems, tails, new = [], [], [], []
        for c in self._missing(set().union(*found), young, old):
            if c[-1] in MARKS and (stem := c.rstrip(MARKS)) and stem[-1] in STEM_ENDS and "<" not in stem:
                wholes.append(c)
                stems.append(stem)
                tails.append(c[len(stem) :])
            else:
                new.append(c)
        new = list(dict.fromkeys(new + self._missing({*stems, *tails}, young, old)))
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            young.update(zip(part, self.encode(part)))
        get = young.__getitem__
        young.update(zip(wholes, map(self.joined, map(get, stems), map(get, tails))))

    def ids(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(x) for x in self.lists(texts)]


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it is printable Latin-1, else the next from 256 on."""
    out, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


def packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class PlainWords:
    """Ids of Latin words by the library's merges alone, many words in a call.

    To such a word the file's other steps (composition, lower case, splitting)
    do no more than change its letters, so only the merges are left. Words stand
    in one string, parted by a byte that UTF-8 never has: no merge holds it, so
    none crosses it. An end-of-word mark is written as a letter of its own.
    """

    GROUP = 64

    def __init__(self, spec: dict):
        from tokenizers import Tokenizer, models

        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        last = {c: chr(0xE000 + i) for i, c in enumerate(letters)} if end else {}

        def renamed(token: str) -> str:
            if not end or not token.endswith(end):
                return token
            stem = token[: -len(end)]
            return stem[:-1] + last[stem[-1]]

        self.part = letters[0xFF]
        vocab = {renamed(t): i for t, i in model["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(self.part in a or self.part in b for a, b in merges):
            raise ValueError("the vocabulary merges a byte that no text has")
        self.bare = Tokenizer(models.BPE(vocab, [(renamed(a), renamed(b)) for a, b in merges]))
        self.part_id = vocab[self.part]
        self.last = last
        lower = spec["normalizer"] is not None
        codes = [0x20, *(i for i in range(0x41, 0x250) if PLAIN.fullmatch(chr(i)))]
        self.table = {
            i: "".join(letters[b] for b in (chr(i).lower() if lower else chr(i)).encode()) for i in codes
        }

    def __call__(self, words: list[str]) -> list[bytes]:
        mapped = "\n".join(words).translate(self.table).split("\n")
        if self.last:
            mapped = [w[:-1] + self.last[w[-1]] for w in mapped]
        groups = [self.part.join(mapped[a : a + self.GROUP]) for a in range(0, len(mapped), self.GROUP)]
        out = []
        for e in self.bare.encode_batch_fast(groups, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            data, at = ids.tobytes(), 0
            for i in (4 * np.flatnonzero(ids == self.part_id)).tolist():
                out.append(data[at:i])
                at = i + 4
            out.append(data[at:])
        return out


def library_chunks(spec: bytes, keep_space: bool) -> Chunks:
    """Ids by the tokenizers library, special strings handled as its default.

    `keep_space` tells that white space is part of the tokens.
    """

    def make() -> Chunks:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(spec.decode())
        t.no_padding()
        t.no_truncation()
        words = PlainWords(json.loads(spec))

        def encode(new: list[str]) -> list[bytes]:
            plain = list(filter(PLAIN.fullmatch, new))
            known = dict(zip(plain, words(plain))) if plain else {}
            rest = [c for c in new if c not in known]
            known.update((c, packed(e.ids)) for c, e in zip(rest, t.encode_batch_fast(rest, add_special_tokens=False)))
            return list(map(known.__getitem__, new))

        return Chunks(WITH_SPACE.findall if keep_space else space_free, encode)

    return held("library", (zlib.crc32(spec), len(spec), keep_space), make)


def text_slices(texts: list[str], most: int = 4_000_000):
    """Ranges of texts of about `most` characters each."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)
