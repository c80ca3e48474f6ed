"""BPE encoding by forced-boundary splitting, and decoding.

Two adjacent symbols of a word that never stand next to each other inside any
vocabulary token can never be merged, nor can a merge span them. A cut between
them is certain, so the fragments between such cuts are encoded on their own
and their ids concatenated: the result is that of encoding the whole word.

Merges go by rank, the leftmost of equal ones first; long fragments use a heap,
so a text of one unbroken megabyte takes n log n steps. What a worker remembers
is bounded in bytes.

Null texts are empty; an empty text has no ids and decodes to the empty text.
Every row gives one row, repeated ones included, and an empty table none; other
columns pass through, but for those named like results, which are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

#: Bytes of the young half of each of a worker's caches, and what an entry takes beside its symbols and for each of them.
CACHE_BYTES, ENTRY_BYTES, SYMBOL_BYTES = 64 << 20, 250, 12
#: Longer keys are worked out anew each time.
MOST_CACHED = 1024
#: Longer fragments are merged with a heap.
LONG = 64
END = "</w>"
#: Code points that stand for a word's last symbol, out of the range that the byte alphabet uses.
LAST = 0xE000
#: ASCII punctuation that, after letters, makes a word of its own.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Below this character all letters are composed, and a text is its own normal form.
COMPOSED = "\u0300"


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


def names_of(spec: dict) -> dict[int, str]:
    """The tokens of a tokenizer file by id."""
    return {v: k for k, v in (spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}).items()}


def decoded(names: dict[int, str], ids: list[int]) -> str:
    """As the library's decode(ids, skip_special_tokens=False) for a file without a decoder: tokens joined by a space; unknown ids are left out."""
    return " ".join(names[i] for i in ids if i in names)


class Cache(dict):
    """A dict of bounded bytes: once the young half is full, the old half goes; what is found in the old half is young again."""

    def __init__(self, make, most: int | None = None):
        self.make, self.most, self.old, self.held = make, most, {}, 0

    def __missing__(self, key):
        if len(key) > MOST_CACHED:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.held >= (self.most or CACHE_BYTES):
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += ENTRY_BYTES + SYMBOL_BYTES * len(key)
        self[key] = value
        return value


class ForcedBoundaryBpe:
    """Encodes as the tokenizer of a tokenizers-library file with word ends does, without special tokens added."""

    def __init__(self, path: str, cache_bytes: int | None = None, counting: bool = False):
        """counting: only the number of ids is asked for, and no texts are made of them."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # the library only normalizes and splits here, so it is given no vocabulary to hold
        lib = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": [], "unk_token": None}, "added_tokens": [], "post_processor": None}))
        if model.get("end_of_word_suffix") != END:
            raise ValueError(f"the vocabulary has no word ends {END!r}")
        self._normalizer, self._splitter = lib.normalizer, lib.pre_tokenizer
        if any(x["content"].split() != [x["content"]] or x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings without white space")
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._added = {k.encode(): v for k, v in added.items()}
        self._added_at = re.compile(b"(" + b"|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + b")") if added else None
        vocab: dict[str, int] = model["vocab"]
        self._names = names_of(spec)
        self._decimal = {i: str(i) for i in self._names}
        self._symbols = {self._inner(k): v for k, v in vocab.items() if len(self._inner(k)) == 1}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: (left id, right id) in one number -> rank and the id of the pair in one number
        self._merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self._inside = {s[i : i + 2] for s in map(self._inner, vocab) for i in range(len(s) - 1)}
        self._bytes = byte_alphabet()
        #: For words of ASCII only, without white space, where the library's normalizer and splitter do no more than this.
        self._ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
        if counting:
            self._strings = lambda ids: ("", "", len(ids))
        self._chunks, self._words = Cache(self._chunk, cache_bytes), Cache(self._plain, cache_bytes)
        self._mapped_words, self._fragments = Cache(self._mapped, cache_bytes), Cache(self._merge, cache_bytes)

    @staticmethod
    def _inner(token: str) -> str:
        """A token as its symbols, one character each."""
        if token.endswith(END) and len(token) > len(END):
            token = token[: -len(END)]
            return token[:-1] + chr(LAST + ord(token[-1]))
        return token

    def fragments(self, word: str) -> list[str]:
        """A word (its last symbol marked), cut at every pair of symbols that no token holds."""
        if self._inside.issuperset(map(add, word, word[1:])):
            return [word]
        cuts = [i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in self._inside]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _merge(self, fragment: str) -> list[int]:
        """Merges the pair of least rank, the leftmost of equals, until none is left."""
        ids = [self._symbols[x] for x in fragment]
        if len(ids) < 2:
            return ids
        if len(ids) > LONG:
            return self._merge_long(ids)
        get, none = self._merges.get, 1 << 60
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a linked list, with a heap of (rank, place) in one number."""
        get, none, n = self._merges.get, 1 << 60, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)] + [none]
        heap = [(r >> 20) << 32 | i for i, r in enumerate(ranks) if r < none]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            best = ranks[i]
            if best >> 20 != entry >> 32:
                continue  # the pair is no longer there
            gone = after[i]
            ids[i], ids[gone], ranks[gone] = best & 0xFFFFF, -1, none
            after[i] = nxt = after[gone]
            if nxt < n:
                before[nxt] = i
                ranks[i] = r = get(ids[i] << 20 | ids[nxt], none)
                if r < none:
                    heappush(heap, (r >> 20) << 32 | i)
            else:
                ranks[i] = none
            if (p := before[i]) >= 0:
                ranks[p] = r = get(ids[p] << 20 | ids[i], none)
                if r < none:
                    heappush(heap, (r >> 20) << 32 | p)
        return [i for i in ids if i >= 0]

    def _ids(self, word: str) -> list[int]:
        """word: in the byte alphabet, unmarked."""
        parts = self.fragments(word[:-1] + chr(LAST + ord(word[-1])))
        if len(parts) == 1:
            return self._merge(parts[0])
        return [i for x in parts for i in self._fragments[x]]

    def _strings(self, ids: list[int]) -> tuple[str, str, int]:
        if len(ids) == 1:
            return self._decimal[ids[0]], self._names[ids[0]], 1
        return " ".join([self._decimal[i] for i in ids]), " ".join([self._names[i] for i in ids]), len(ids)

    def _mapped(self, word: str) -> tuple[str, str, int]:
        return self._strings(self._ids(word))

    def _plain(self, word: str) -> tuple[str, str, int]:
        """A lower-case word before its bytes are mapped."""
        return self._strings(self._ids(word if word.isascii() and word.isprintable() else "".join(map(self._bytes.__getitem__, word.encode()))))

    def _chunk(self, chunk: bytes) -> tuple[str, str, int]:
        """A text without ASCII white space; none of the steps looks across such a space."""
        if self._added_at is not None and self._added_at.search(chunk):
            return self._joined([self._strings([self._added[x]]) if x in self._added else self._piece(x) for x in self._added_at.split(chunk) if x])
        return self._piece(chunk)

    def _piece(self, chunk: bytes) -> tuple[str, str, int]:
        text = chunk.decode()
        low = text.lower()
        core = low.rstrip(PUNCTUATION)
        if core.isalpha() and (chunk.isascii() or max(text) < COMPOSED and max(low) < COMPOSED):
            # letters, and perhaps punctuation after them: two words at most
            if len(core) == len(low):
                return self._words[core]
            a, b = self._words[core], self._words[low[len(core) :]]
            return f"{a[0]} {b[0]}", f"{a[1]} {b[1]}", a[2] + b[2]
        if chunk.isascii():
            return self._joined([self._words[x] for x in self._ascii.findall(low)])
        return self._joined([self._mapped_words[x] for x, _ in self._splitter.pre_tokenize_str(self._normalizer.normalize_str(text))])

    @staticmethod
    def _joined(parts: list[tuple[str, str, int]]) -> tuple[str, str, int]:
        parts = [x for x in parts if x[2]]
        if not parts:
            return "", "", 0
        ids, names, counts = zip(*parts, strict=True)
        return " ".join(ids), " ".join(names), sum(counts)

    def texts(self, text: bytes) -> tuple[str, str, int]:
        """The decimal ids joined by a space, the decoded text, and the number of ids."""
        return self._joined(list(map(self._chunks.__getitem__, text.split())))

    def count(self, text: bytes) -> int:
        """The number of ids alone."""
        chunks = self._chunks
        return sum([chunks[x][2] for x in text.split()])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.texts(text.encode())[0].split()]

    def decode(self, ids: list[int]) -> str:
        return decoded(self._names, ids)


def encode_texts(df: DataFrame, tokenizer: str, text_col: str = "text", with_ids: bool = True, with_texts: bool = True, cache_bytes: int | None = None, with_digest: bool = False) -> DataFrame:
    """Adds n_tokens (long) and, if asked for, ids (array of int), ids_text (decimal ids joined by a space) and decoded (string).

    tokenizer: path of the tokenizer file, readable at that path on every executor.
    cache_bytes: of the young half of each cache of a worker, CACHE_BYTES unless given; results don't depend on it.
    with_digest: adds decoded_sha256, of the text that the ids decode to; the worker that encodes decodes them, so that no second one stands beside it and no text leaves it.
    """
    kept = [c for c in df.columns if c not in ("n_tokens", "ids", "ids_text", "decoded", "decoded_sha256")]
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    fields += [T.StructField("ids_text", T.StringType()), T.StructField("decoded", T.StringType())] * with_texts
    fields += [T.StructField("decoded_sha256", T.StringType())] * with_digest

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counting = len(fields) == 1
        bpe = ForcedBoundaryBpe(tokenizer, cache_bytes, counting)
        for texts in pieces(batches):
            if counting:
                yield pd.DataFrame({"n_tokens": [bpe.count(t or b"") for t in texts]})
                continue
            out = {f.name: [] for f in fields}
            for t in texts:
                ids_text, text, n = bpe.texts(t or b"")
                out["n_tokens"].append(n)
                if with_ids or with_digest:
                    ids = np.array([int(i) for i in ids_text.split()], np.int32)
                if with_ids:
                    out["ids"].append(ids)
                if with_texts:
                    out["ids_text"].append(ids_text)
                    out["decoded"].append(text)
                if with_digest:
                    out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest())
            yield pd.DataFrame(out)

    encoded = F.pandas_udf(run, T.StructType(fields))
    return df.select(*kept, encoded(F.col(text_col).cast("binary")).alias("_bpe")).select(*kept, "_bpe.*")


def decode_ids(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of an array of ids; null ids decode to the empty text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with open(tokenizer, encoding="utf-8") as f:
            names = names_of(json.load(f))
        for ids in pieces(batches):
            yield pd.Series([decoded(names, [] if x is None else list(x)) for x in ids], dtype=object)

    return df.withColumn(out_col, F.pandas_udf(run, T.StringType())(F.col(ids_col)))
