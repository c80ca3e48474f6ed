"""SimHash fingerprints, and the Gray-order index that finds those within a few bits of one another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

BITS = 64
#: Shingles whose bits are counted at a time.
SLICE = 1 << 16
#: Node pairs that are looked at together, which bounds the memory of a search.
FRONTIER = 1 << 18


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of size words, joined by a space; fewer words are one shingle, none give none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)]


def hashes(grams: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams))


def bit_majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), SLICE):
        part = np.ascontiguousarray(h[at : at + SLICE]).view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, size: int) -> int:
    """Of the lower-cased (A-Z) words between ASCII white space, which are what bytes.lower and bytes.split give."""
    return bit_majority(hashes(shingles((text or b"").lower().split(), size)))


def fingerprint_column(text: Column, size: int) -> Column:
    """Signed 64-bit fingerprint of a text column. Null and blank texts have zero."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in pieces(batches):
            yield pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return run(text.cast("binary"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order, in which neighbours differ in one bit."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayTree:
    """Hierarchical index of distinct codes in Gray order.

    A node stands for FANOUT nodes below it and holds the bits that all of
    them share (mask and pattern). Going down, only bits not yet shared above
    are compared, and their differences are added to those found above; a pair
    of nodes whose sum exceeds the radius is dropped with all below it.
    """

    FANOUT = 8

    def __init__(self, codes: np.ndarray, exact: int = 0, groups: np.ndarray | None = None):
        """exact: bits that must agree outright. groups: one number a code; only codes of one group are paired, which come together in the tree. order: the place of each of the tree's codes in those given."""
        groups = np.zeros(len(codes), np.int64) if groups is None else groups
        self.order = np.lexsort((gray_rank(codes), groups))
        self.codes = codes[self.order]
        self.exact = np.uint64(exact)
        #: the first and last group below each node, by level
        self.groups = [(groups[self.order], groups[self.order])]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.levels = [(self.codes, np.full(len(codes), full))]
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1]
            starts = np.arange(0, len(pattern), self.FANOUT)
            ones, zeros = np.bitwise_and.reduceat(pattern & mask, starts), np.bitwise_and.reduceat(~pattern & mask, starts)
            self.levels.append((ones, ones | zeros))
            first, last = self.groups[-1]
            self.groups.append((first[starts], last[np.minimum(starts + self.FANOUT, len(last)) - 1]))

    def _below(self, a: np.ndarray, b: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of children of node pairs (a <= b), and the pair that each comes from."""
        k, n = self.FANOUT, len(self.levels[level][0])
        step = np.arange(k)
        x = np.broadcast_to(a[:, None, None] * k + step[None, :, None], (len(a), k, k)).ravel()
        y = np.broadcast_to(b[:, None, None] * k + step[None, None, :], (len(a), k, k)).ravel()
        ok = np.flatnonzero((x < n) & (y < n) & (x <= y if level else x < y))
        first, last = self.groups[level]
        ok = ok[last[x[ok]] >= first[y[ok]]]  # groups ascend, so y's begin no earlier than x's
        return x[ok], y[ok], ok // (k * k)

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of codes (as indexes into self.codes) that differ in at most radius bits, none of them in exact."""
        if len(self.codes) < 2:
            return
        top = len(self.levels) - 1
        root = np.zeros(1, np.int64)
        stack = [(top, root, root, np.zeros(1, np.int64), self.levels[top][1])]
        while stack:
            level, a, b, sofar, seen = stack.pop()
            if not level:
                yield a, b
                continue
            limit = max(1, FRONTIER // self.FANOUT**2)
            if len(a) > limit:
                stack += [(level, a[i : i + limit], b[i : i + limit], sofar[i : i + limit], seen[i : i + limit]) for i in range(0, len(a), limit)]
                continue
            x, y, source = self._below(a, b, level - 1)
            pattern, mask = self.levels[level - 1]
            both = mask[x] & mask[y]
            differing = (pattern[x] ^ pattern[y]) & both & ~seen[source]
            total = sofar[source] + np.bitwise_count(differing)
            keep = (total <= radius) & ((differing & self.exact) == 0)
            if keep.any():
                stack.append((level - 1, x[keep], y[keep], total[keep], both[keep]))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the edges a-b."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        if (ra == rb).all():
            return root
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root[root] != root).any():
            root = root[root]
