"""SimHash near-duplicates over a Gray-order hierarchical index.

Texts become 64-bit fingerprints; fingerprints link at radius or fewer
differing bits; a component is all that links reach. Copies share a
fingerprint, so only distinct fingerprints are joined, and nothing is expanded
within a group of copies.

Placement: the 64 bits are eight blocks, and fingerprints with at most two
differing bits agree in six whole blocks at least. Each fingerprint goes to 28
places, one for each choice of six blocks, keyed by their 48 bits. The 16 bits
left over bound a key to 65,536 fingerprints whatever the data, so no key is
hot. A task gathers keys with more than one fingerprint, sorts them in Gray
order (the key's blocks first), builds the tree and searches it with itself; it
emits each fingerprint's local root, not pairs.

Null and blank texts have fingerprint zero and link like any other; texts of
any length are read whole. A null id is no smallest id; a component without any
id has a null component_id. Repeated rows each give a row; an empty table gives
none. Only the id and the text are read, so further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_spread, written
from .simhash import BITS, GrayTree, fingerprint_column, roots

#: Fingerprints in a tree, but for the last key's.
TREE = 200_000
#: Edges of which a hub's share can be left in one task.
FEW_EDGES = 100_000
BLOCK = 8
BLOCKS = BITS // BLOCK
#: The largest radius that the placement guarantees: so many blocks may differ.
MOST_RADIUS = 2
#: The blocks that are free in each place.
PLACES = list(combinations(range(BLOCKS), MOST_RADIUS))


def place_mask(place: int) -> int:
    return sum(((1 << BLOCK) - 1) << BLOCK * b for b in range(BLOCKS) if b not in PLACES[place])


def moved(codes: np.ndarray, place: int, back: bool = False) -> np.ndarray:
    """Codes with the free blocks of a place moved to the bottom, so that Gray order groups by the others; back undoes it."""
    order = [*PLACES[place], *(b for b in range(BLOCKS) if b not in PLACES[place])]
    out = np.zeros_like(codes)
    for low, block in enumerate(order):
        source, target = (low, block) if back else (block, low)
        out |= ((codes >> np.uint64(BLOCK * source)) & np.uint64((1 << BLOCK) - 1)) << np.uint64(BLOCK * target)
    return out


def local_links(codes: np.ndarray, place: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, smaller code that it reaches) for the codes of one place whose key blocks agree."""
    free = BLOCK * MOST_RADIUS
    tree = GrayTree(moved(codes, place), exact=((1 << BITS) - 1) ^ ((1 << free) - 1))
    root = np.arange(len(codes))
    for a, b in tree.pairs(radius):
        root = roots(len(codes), np.concatenate([np.arange(len(codes)), a]), np.concatenate([root, b]))
    mine = moved(tree.codes, place, back=True)
    at = np.flatnonzero(root != np.arange(len(codes)))
    return mine[at], mine[root[at]]


def _search(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by place and key. Keys of one fingerprint are passed over, whole keys gathered until a tree is worth while."""

        def searched(held: list[np.ndarray], place: int) -> pd.DataFrame:
            code, root = local_links(np.concatenate(held), place, radius)
            return pd.DataFrame({"code": code.view(np.int64), "root": root.view(np.int64)})

        def columns(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return df["place"].to_numpy(), df["key"].to_numpy(), df["code"].to_numpy().view(np.uint64)

        held: list[np.ndarray] = []
        at = -1
        rest = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64))  # of the key that may go on
        last = (np.array([-1], np.int32), np.zeros(1, np.int64), np.zeros(1, np.uint64))  # closes the last key
        for batch in _then(map(columns, batches), last):
            place, key, code = (np.concatenate(x) for x in zip(rest, batch, strict=True))
            starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (key[1:] != key[:-1])])
            end = starts[-1]
            rest = place[end:], key[end:], code[end:]
            sizes = np.diff(starts)
            several = np.repeat(sizes > 1, sizes)
            place, code = place[:end][several], code[:end][several]
            for p in np.unique(place).tolist():
                if held and (p != at or sum(map(len, held)) >= TREE):
                    yield searched(held, at)
                    held = []
                at = p
                held.append(code[place == p])
        if held:
            yield searched(held, at)

    return run


def _then(items: Iterator, last) -> Iterator:
    yield from items
    yield last


def links(codes: DataFrame, radius: int = 2) -> DataFrame:
    """(code, root) links of distinct codes, enough to join each code to all at most radius bits away; radius: MOST_RADIUS at most."""
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"the blocks guarantee a radius of {MOST_RADIUS} at most")
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("place"), F.col("code").bitwiseAND(F.lit(_signed(place_mask(i)))).alias("key")) for i in range(len(PLACES))]))
    placed = codes.select("code", place.alias("p")).select("code", "p.place", "p.key")
    return placed.repartition(parts, "place", "key").sortWithinPartitions("place", "key").mapInPandas(_search(radius), "code long, root long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the least node that each node of the edges (code, root) reaches.

    Alternates large-star and small-star steps, which turn a component into a
    star around its least node in a number of rounds that grows with the
    logarithm of its size. Each round is written to the shared folder, and
    those before it are removed. A node with a large share of all edges meets
    them by broadcast (joined_spread), not in one task.
    """
    edges = written(edges.select(F.greatest("code", "root").alias("u"), F.least("code", "root").alias("v")).where("u <> v").distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())
    now = state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        done = [edges]

        def starred(rows: DataFrame, m: Column, done: list[DataFrame] = done, few: bool = now[0] <= FEW_EDGES) -> DataFrame:
            """rows (u, v) with m, u's least neighbour; few rows have no hub worth a join of its own."""
            least = rows.groupBy("u").agg(m.alias("m"), F.count("*").alias("n"))
            if few:
                return rows.join(least, "u")
            done.append(written(least, "least"))
            return joined_spread(rows, done[-1], "u", "n")

        large = starred(both, F.least(F.min("v"), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        if now[0] > FEW_EDGES:
            large = written(large, "large")
            done.append(large)
        small = starred(large, F.min("v"))
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        discard(*done)
        before, now = now, state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def named_parts(codes: DataFrame, parts: DataFrame) -> DataFrame:
    """(code, n, component_id) of all codes (code, first, n): the least id of the component (node, component) that each is in, its own first if in none."""
    parts = written(parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct()), "parts")
    linked = parts.join(codes.select(F.col("code").alias("node"), "first"), "node")
    least = written(linked.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n")), "least")
    of_code = joined_spread(parts, least, "component", "n").select(F.col("node").alias("code"), "least")
    return written(codes.join(of_code, "code", "left").select("code", "n", F.coalesce("least", "first").alias("component_id")), "named")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of df: its id, fingerprint (signed long) and component_id, the smallest id reachable."""
    docs = written(df.select(F.col(id_col).alias("_id"), fingerprint_column(F.col(text_col), shingle).alias("code")), "fingerprints")
    codes = written(docs.groupBy("code").agg(F.min("_id").alias("first"), F.count("*").alias("n")), "codes")
    named = named_parts(codes, components(links(codes.select("code"), radius)))
    return joined_spread(docs, named, "code", "n").select(F.col("_id").alias(id_col), F.col("code").alias("fingerprint"), "component_id")


def hex_of(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of df whose id is their component's smallest; of rows that repeat such an id, one. Rows without an id stay, as nothing can name them."""
    return keep_first(df, near_duplicates(df, id_col, text_col, **parameters), id_col)


def keep_first(df: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows of df that found (ids and component_id) names as their component's smallest."""
    kept = written(found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias("_rows")), "kept")
    # texts are shuffled to the ids whatever their size, as ids grow with the texts and can't be broadcast at scale
    out = df.join(kept.where("_rows = 1").select(id_col).hint("shuffle_hash"), id_col, "left_semi")
    again = kept.where("_rows > 1").select(id_col)
    if not again.isEmpty():
        out = out.unionByName(df.join(again.hint("shuffle_hash"), id_col, "left_semi").dropDuplicates([id_col]))
    return out.unionByName(df.where(F.col(id_col).isNull())) if df.schema[id_col].nullable else out
