"""Pairs of sets of a given Jaccard similarity, by bit sketches of the sets: exact, without a shuffle of what the sets hold.

A sketch counts a set's elements by a hash of them, modulo 2: one bit for each
count. Each element that only one of two sets has changes one bit, so sketches
differ in as many bits at most as the sets differ in elements. Sets of a
similarity t differ in (1 - t) / (1 + t) of the sum of their sizes at most; a pair whose
sketches differ in more is none. That loses no pair, and keeps few others.

Sets meet by size: bands are wider than a similarity lets sizes differ, so a pair is
within a band or in two neighbouring ones. A set is in its own band, and a guest in
the next; sketches are as wide as the band's sets are large. The sets of a group and band are dealt
in blocks, and each two blocks meet in a task of their own. All sketches of a band are compared,
so the comparisons grow with its square, some nanoseconds each, and memory does not.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import checkpointed

#: Sets of a block, and words of 64 bits that its sketches take on average.
BLOCK_ROWS, BLOCK_WORDS = 8192, 1 << 18
#: Characters of the sets of a block that are compared themselves, and the least number of such blocks.
BLOCK_CHARS, FEW_BLOCKS = 16 << 20, 8
#: Sketches are no wider than so many words of 64 bits, whatever the set's size.
MOST_WORDS = 1024
#: Pairs that are compared at a time.
PAIRS = 1 << 20
#: By how much bands are wider than sizes may differ, so that rounding doesn't matter.
MARGIN = 1.04


def _band(n: int, least: float) -> int:
    return int(math.log(n) / math.log(MARGIN / least))


def _width(band: int, least: float) -> int:
    """Words of 64 bits of a band's sketches: a bit for each element of its largest set."""
    return min(MOST_WORDS, math.ceil((MARGIN / least) ** (band + 1) / 64))


def parity(hashes: np.ndarray, width: int) -> bytes:
    counts = np.bincount((hashes % np.uint64(64 * width)).astype(np.int64), minlength=64 * width)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def digested(texts: Column, elements: Callable[[bytes], set[bytes]], least: float) -> Column:
    """struct<key, sketches> of the set of elements that each text has: the SHA-256 of its sorted elements joined by a space, and array<struct<band, guest, n, sketch>> for its own band and the next. Null for an empty set."""
    sketch = T.StructType([T.StructField("band", T.IntegerType()), T.StructField("guest", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])

    @F.pandas_udf(T.StructType([T.StructField("key", T.StringType()), T.StructField("sketches", T.ArrayType(sketch))]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, out = [], []
            for text in batch:
                found = elements(text or b"")
                keys.append(hashlib.sha256(b" ".join(sorted(found))).hexdigest() if found else None)
                own = _band(len(found), least) if found else 0
                h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
                out.append([{"band": b, "guest": b > own, "n": len(h), "sketch": parity(h, _width(b, least))} for b in (own, own + 1)] if found else None)
            yield pd.DataFrame({"key": keys, "sketches": out})

    return run(texts.cast("binary"))


def _near(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b (one sketch a row) that differ in at most limit bits."""
    apart = np.zeros(limit.shape, np.int32)
    first = min(a.shape[1], 8)
    for k in range(first):
        apart += np.bitwise_count(a[:, k, None] ^ b[:, k])
    i, j = np.nonzero(apart <= limit)
    apart, limit = apart[i, j], limit[i, j]
    for k in range(first, a.shape[1]):
        apart = apart + np.bitwise_count(a[i, k] ^ b[j, k])
        near = apart <= limit
        i, j, apart, limit = i[near], j[near], apart[near], limit[near]
    return i, j


def _compared(df: pd.DataFrame, least: float) -> Iterator[pd.DataFrame]:
    """Pairs of two blocks, or of one with itself."""
    guest, n, id_ = df["guest"].to_numpy(bool), df["n"].to_numpy(np.int64), df["id"].to_numpy()
    bits = np.frombuffer(b"".join(df["sketch"]), np.uint64).reshape(len(df), -1)
    own = df["block"].to_numpy() == df["i"].to_numpy()
    left = np.flatnonzero(own)
    right = left if own.all() and (df["i"] == df["j"]).all() else np.flatnonzero(~own)
    step = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        a = left[at : at + step]
        # a row of one block meets those after it
        b = left[at:] if right is left else right
        if not len(b):
            continue
        both = n[a][:, None] + n[b]
        # rounding up keeps what is just at the limit; the sets themselves are compared later
        limit = np.floor(both * ((1 - least) / (1 + least)) + 1e-6).astype(np.int32)
        limit[np.minimum(n[a][:, None], n[b]) < least * np.maximum(n[a][:, None], n[b]) - 1e-6] = -1
        limit[guest[a][:, None] & guest[b]] = -1
        if right is left:
            limit[np.tril_indices(len(a), 0, len(b))] = -1
        x, y = _near(bits[a], bits[b], limit)
        x, y = a[x], b[y]
        swap = id_[x] > id_[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        x, y = x[id_[x] != id_[y]], y[id_[x] != id_[y]]
        yield pd.DataFrame({"a_id": id_[x], "a_key": df["key"].to_numpy()[x], "b_id": id_[y], "b_key": df["key"].to_numpy()[y]})


def _blocks(least: float, keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group, band and blocks; a pair of blocks is compared when it is whole."""
        held: list[pd.DataFrame] = []
        at = None
        of = [*keys, "band", "i", "j"]
        for df in (b for b in batches if len(b)):
            places = df[of].ne(df[of].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(places)
            for low, high in zip(starts, [*starts[1:], len(df)], strict=True):
                part = df.iloc[low:high]
                here = tuple(part[of].iloc[0])
                if held and here != at:
                    yield from _compared(pd.concat(held, ignore_index=True), least)
                    held = []
                at = here
                held.append(part)
        if held:
            yield from _compared(pd.concat(held, ignore_index=True), least)

    return run


def meeting(sets: DataFrame, keys: list[str], least: float) -> DataFrame:
    """a_id, a_key, b_id, b_key (a_id < b_id) of all sets of a group that may have the similarity least, each pair once.

    sets: id (long), key (long, so that an id may be repeated), sketches as digested() gives them, and the columns of the group, none of them null.
    """
    rows = checkpointed(sets.select("id", "key", *keys, F.explode("sketches").alias("s")).select("id", "key", *keys, "s.*"))
    of = [*keys, "band"]
    words = F.sum(F.length("sketch") / 8) / BLOCK_WORDS
    blocks = rows.groupBy(*of).agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, words)).cast("int").alias("blocks"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    dealt = rows.join(checkpointed(blocks), of).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*of, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "guest", "id", "key", "n", "sketch")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *of, "i", "j").sortWithinPartitions(*of, "i", "j")
    return dealt.mapInPandas(_blocks(least, keys), "a_id long, a_key long, b_id long, b_key long")


def _shared(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """How many elements the sets of each pair share, and have."""
    held = {(i, k): set(line.split(" ")) for i, k, line in zip(sets["id"], sets["key"], sets["line"], strict=True)}
    sides = [[held[x] for x in zip(pairs[f"{s}_id"], pairs[f"{s}_key"], strict=True)] for s in "ab"]
    counts = {"shared": [len(a & b) for a, b in zip(*sides, strict=True)], "a_n": list(map(len, sides[0])), "b_n": list(map(len, sides[1]))}
    return pd.DataFrame({"a_id": pairs["a_id"], "b_id": pairs["b_id"], **counts})


def shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a_id, b_id, shared, a_n, b_n: how many elements the sets of each pair share, and have.

    pairs: as meeting() gives them; sets: id, key, line (elements joined by a space), each once, both stored.
    Sets are dealt in blocks, each to those that its partners are in, so that a set of a large family isn't sent once a pair.
    """
    size = sets.agg(F.sum(F.length("line"))).first()[0] or 0
    blocks = max(FEW_BLOCKS, math.ceil(size / BLOCK_CHARS))
    i, j = (F.pmod(F.xxhash64(f"{s}_id", f"{s}_key"), F.lit(blocks)).cast("int").alias(c) for s, c in (("a", "i"), ("b", "j")))
    dealt = pairs.select("*", i, j)
    ends = dealt.select("i", "j", F.explode(F.array(*[F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_key").alias("key")) for s in "ab"])).alias("e"))
    needed = ends.select(F.col("i").alias("of_i"), F.col("j").alias("of_j"), "e.*").distinct().join(sets, ["id", "key"])
    return dealt.groupBy("i", "j").cogroup(needed.groupBy("of_i", "of_j")).applyInPandas(_shared, "a_id long, b_id long, shared long, a_n long, b_n long")
