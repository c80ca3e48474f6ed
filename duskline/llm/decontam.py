"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document has as many words as a benchmark item. Its fingerprint
is looked up among the items' in a multi-index: the 64 bits are BLOCKS blocks,
and a fingerprint within RADIUS of an item's is within RADIUS // BLOCKS of it in
one block at least, so the tables of near block values find every item within
the radius. A candidate is verified by the weighted Jaccard similarity of its
five-word shingles (repeats counted), which must reach MIN_SIMILARITY.

A document shorter than an item is one window itself. A window that shares no
shingle with any item has similarity 0 to all; such windows are skipped before
any fingerprint is made.

Words are lower-cased (A-Z); ASCII punctuation separates words like white
space. Texts or items of under five words are one shingle; null and empty ones
have none and match nothing. Repeated rows and items are each compared; of
windows that tie for an item, the first is reported. A null id passes through;
item ids are integers. Very long texts are read whole, WINDOWS windows at a time.
Only the named columns are read by contaminated(), and clean() adds none, so
clashing names don't matter. No items match nothing, no documents give no rows.

Items are taken in blocks of ITEMS (and ITEM_BYTES of text), each a broadcast of
bounded size, indexed once by each Python worker and searched in a scan of its
own: a benchmark of usual size is one block. clean() writes what a block leaves
before the next, so that no stage holds two.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, written

SHINGLE = 5
MIN_SIMILARITY = 0.8
#: Differing bits. At a similarity of 0.8 about 10 are expected, 20 lie 3.5 standard deviations above.
RADIUS = 20
BLOCKS = 7
#: Items, and bytes of their texts, searched for in one pass over the documents.
ITEMS, ITEM_BYTES = 200_000, 96 << 20
#: Window fingerprints made at a time.
WINDOWS = 8192
#: Candidates that a search holds at a time, over all blocks.
PAIRS = 1 << 20
_BITS = 64
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_codes(words: np.ndarray, most: int = SHINGLE) -> np.ndarray:
    """A code for each run of most word codes (all words if fewer), mixed well enough to serve as its hash."""
    size = min(most, len(words))
    n = len(words) - size + 1 if size else 0
    code = np.full(n, size, np.uint64)
    for i in range(size):
        code = (code ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def simhashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all windows of width shingles."""
    bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), bitorder="little").reshape(-1, _BITS)
    sums = np.zeros((len(codes) + 1, _BITS), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[width:] - sums[:-width]) > width, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two bags of shingles."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def bag_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted arrays of shingles, repeats included."""
    kinds, at = np.unique(a, return_index=True)
    n = np.diff(np.append(at, len(a)))
    m = np.searchsorted(b, kinds, "right") - np.searchsorted(b, kinds, "left")
    both = int(np.minimum(n, m).sum())
    return both / (len(a) + len(b) - both)


class BlockIndex:
    """Multi-index of fingerprints: for each block of bits, the fingerprints in buckets by the block's value.

    A query looks into the buckets of all values near its own, so it meets every
    fingerprint within the radius in one block at least.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, _BITS, blocks + 1).astype(int)
        self.blocks = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            values = (prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            order = np.argsort(values, kind="stable").astype(np.int32)
            starts = np.searchsorted(values[order], np.arange((1 << (hi - lo)) + 1, dtype=np.uint64)).astype(np.int64)
            flips = np.arange(1 << (hi - lo), dtype=np.uint64)
            self.blocks.append((np.uint64(lo), np.uint64((1 << (hi - lo)) - 1), order, starts, flips[np.bitwise_count(flips) <= radius // blocks]))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query index, print index) of all pairs within the radius, each once, in order; PAIRS candidates or so are held at a time."""
        each = max(1, PAIRS // max(512, len(self.prints)))
        found = [self._search(queries[i : i + each], i) for i in range(0, len(queries), each)]
        return np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])

    def _search(self, queries: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        met = []
        for lo, mask, order, starts, flips in self.blocks:
            value = (((queries >> lo) & mask)[:, None] ^ flips[None, :]).astype(np.int64).ravel()
            begin, size = starts[value], starts[value + 1] - starts[value]
            q = np.repeat(np.repeat(np.arange(len(queries)), len(flips)), size)
            place = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            p = order[place]
            ok = np.bitwise_count(queries[q] ^ self.prints[p]) <= self.radius
            met.append(q[ok] * len(self.prints) + p[ok])
        pair = np.unique(np.concatenate(met))
        return first + pair // max(1, len(self.prints)), pair % max(1, len(self.prints))


class Items:
    """A block of benchmark items, indexed; flat arrays throughout, as there may be many."""

    def __init__(self, items: list[tuple[object, bytes]], min_similarity: float = MIN_SIMILARITY):
        self.min_similarity = min_similarity
        ids, sizes, prints, codes, owners = [], [], [], [], []
        for i, text in items:
            words = word_codes(normal_words(text))
            if len(words):
                own = np.sort(shingle_codes(words))
                owners.append(np.full(len(own), len(ids), np.int32))
                codes.append(own)
                prints.append(simhashes(own, len(own))[0])
                ids.append(i)
                sizes.append(len(words))
        self.ids, self.sizes = ids, np.array(sizes, np.int64)
        self.bags = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        self.bag_at = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        order = np.argsort(self.bags, kind="stable")
        #: The distinct shingles, and the items that hold each.
        self.known, starts = np.unique(self.bags[order], return_index=True)
        self.held_at, self.holders = np.append(starts, len(order)).astype(np.int64), owner[order]
        #: A bit table of the shingles' low bits, which turns most of a text away.
        self.bits = min(30, max(20, int(len(self.known) * 64).bit_length()))
        self.table = np.zeros((1 << self.bits) // 8, np.uint8)
        low = self.known & np.uint64((1 << self.bits) - 1)
        np.bitwise_or.at(self.table, (low >> np.uint64(3)).astype(np.int64), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))
        self.of_size: dict[int, tuple[np.ndarray, BlockIndex]] = {}
        prints = np.array(prints, np.uint64)
        for n in np.unique(self.sizes):
            at = np.flatnonzero(self.sizes == n)
            self.of_size[int(n)] = (at, BlockIndex(prints[at]))
        #: The sizes of the items whose shingles have so many words.
        self.of_width = {w: {n for n in self.of_size if min(SHINGLE, n) == w} for w in {min(SHINGLE, n) for n in self.of_size}}

    def _shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of codes that are an item's shingle, which shingle)."""
        low = codes & np.uint64((1 << self.bits) - 1)
        at = np.flatnonzero(self.table[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.known, codes[at]), len(self.known) - 1)
        same = self.known[place] == codes[at]
        return at[same], place[same]

    def matches(self, text: bytes | None) -> list[tuple[object, int, int, float]]:
        """(item id, first word, words, similarity) of the best window for each item that one matches."""
        words = normal_words(text)
        if not words or not len(self.ids):
            return []
        words = word_codes(words)
        best: dict[int, tuple[float, int, int]] = {}
        for width, sizes in self.of_width.items():
            if width > len(words):
                continue
            codes = shingle_codes(words, width)
            shared, which = self._shared(codes)
            if not len(shared):
                continue
            counts = self.held_at[which + 1] - self.held_at[which]
            place = np.repeat(shared, counts)
            inner = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
            size = self.sizes[self.holders[np.repeat(self.held_at[which], counts) + inner]]
            for n in sorted(sizes.intersection(np.unique(size).tolist())):
                self._windows(codes, np.unique(place[size == n]), min(n, len(words)) - width + 1, n, best)
        return [(self.ids[k], start, words, score) for k, (score, start, words) in sorted(best.items())]

    def _windows(self, codes: np.ndarray, shared: np.ndarray, span: int, size: int, best: dict[int, tuple[float, int, int]]) -> None:
        """Searches the windows of span shingles, for items of one size, that hold a shared shingle, and keeps each item's best."""
        held, index = self.of_size[size]
        # the starts of windows over a shared shingle: +1 where they begin, -1 where they end
        turns = np.zeros(len(codes) - span + 2, np.int64)
        np.add.at(turns, np.maximum(0, shared - span + 1), 1)
        np.add.at(turns, np.minimum(shared, len(codes) - span) + 1, -1)
        starts = np.flatnonzero(np.cumsum(turns)[:-1] > 0)
        words = span + min(SHINGLE, size) - 1
        for s, e in _runs(starts):
            prints = simhashes(codes[s : e + span - 1], span)
            for q, k in zip(*(x.tolist() for x in index.search(prints)), strict=True):
                item, start = int(held[k]), s + q
                score = bag_similarity(np.sort(codes[start : start + span]), self.bags[self.bag_at[item] : self.bag_at[item + 1]])
                if score >= self.min_similarity and (item not in best or (score, -start) > (best[item][0], -best[item][1])):
                    best[item] = score, start, words


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """[first, end) of runs of consecutive numbers, cut to WINDOWS."""
    for run in np.split(starts, np.flatnonzero(np.diff(starts) != 1) + 1):
        for i in range(0, len(run), WINDOWS):
            part = run[i : i + WINDOWS]
            yield int(part[0]), int(part[-1]) + 1


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int = ITEMS) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's rows with a text, in blocks of most at most, one of which the driver holds at a time."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(item_col, F.col(text_col).cast("binary"))
    block: list[tuple[int, bytes]] = []
    held = 0
    for i, t in rows.toLocalIterator():
        block.append((i, bytes(t)))
        held += len(t)
        if len(block) == most or held >= ITEM_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _schema(kind: str) -> str:
    return f"array<struct<item:{kind}, first_word:long, n_words:long, similarity:double>>"


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(id, item, first_word, n_words, similarity): the best window of each document for each item that it matches."""
    kind = benchmark.schema[item_col].dataType.simpleString()
    schema = _schema(kind)
    found = None
    for block in item_blocks(benchmark, item_col, item_text_col):
        shared = df.sparkSession.sparkContext.broadcast(block)
        hits = df.select(F.col(id_col), F.explode(_matcher(shared, min_similarity, schema)(F.col(text_col).cast("binary"))).alias("m"))
        hits = hits.select(F.col(id_col), F.col("m.item").alias(item_col), "m.first_word", "m.n_words", "m.similarity")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = df.where(F.lit(False)).select(F.col(id_col), F.lit(None).cast(kind).alias(item_col), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("similarity"))
    return found


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The rows of df that match no item, judged in place: no join."""
    schema = _schema(benchmark.schema[item_col].dataType.simpleString())
    first = True
    for block in item_blocks(benchmark, item_col, item_text_col):
        df = df if first else written(df, "clean")
        first = False
        shared = df.sparkSession.sparkContext.broadcast(block)
        df = df.where(F.size(_matcher(shared, min_similarity, schema)(F.col(text_col).cast("binary"))) == 0)
    return df


#: The index that a Python worker made last: workers outlive tasks.
_LAST: dict[str, Items] = {}


def _indexed(key: str, shared, min_similarity: float) -> Items:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Items(shared.value, min_similarity)
    return _LAST[key]


def _matcher(shared, min_similarity: float, schema: str):
    key = uuid.uuid4().hex
    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = _indexed(key, shared, min_similarity)
        for texts in pieces(batches):
            yield pd.Series([[{"item": i, "first_word": s, "n_words": n, "similarity": x} for i, s, n, x in items.matches(t)] for t in texts], dtype=object)

    return run
