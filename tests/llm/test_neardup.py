import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from duskline.llm import neardup, queries, simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius):
    """rows: (id, fingerprint); id -> smallest id reachable."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {i: min(g) for g in groups.values() for i in g}


def families(seed, n=120):
    """Codes in chains and clouds of one to three bits, and far ones."""
    rng = np.random.default_rng(seed)
    codes = [int(x) for x in rng.integers(0, 2**63, n // 4)]
    while len(codes) < n:
        code = codes[rng.integers(len(codes))]
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            code ^= 1 << int(bit)
        codes.append(code)
    return np.unique(np.array(codes, np.uint64))


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_all_pairs(seed):
    codes = families(seed)
    for radius in (0, 1, 2, 5):
        tree = simhash.GrayTree(codes)
        found = {frozenset((int(tree.codes[i]), int(tree.codes[j]))) for a, b in tree.pairs(radius) for i, j in zip(a, b, strict=True)}
        expected = {frozenset((int(x), int(y))) for x in codes for y in codes if x < y and (int(x) ^ int(y)).bit_count() <= radius}
        assert found == expected


def test_gray_order_changes_one_bit_at_a_time():
    ranks = simhash.gray_rank(np.arange(256, dtype=np.uint64))
    order = np.argsort(ranks)
    assert sorted(ranks.tolist()) == list(range(256))
    assert all((int(a) ^ int(b)).bit_count() == 1 for a, b in zip(order, order[1:], strict=False))


def groups_of(found, ids):
    return {frozenset(j for j in ids if found(j) == found(i)) for i in ids}


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_reach_all_that_brute_force_reaches(spark, monkeypatch, radius):
    monkeypatch.setattr(neardup, "TREE", 40)
    codes = families(9, 200)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long").repartition(5)
    parts = neardup.components(neardup.links(df, radius))
    got = {r["node"]: r["component"] for r in parts.collect()}
    expected = brute_components([(int(c), int(c) & (2**64 - 1)) for c in codes.view(np.int64)], radius)
    linked = {i for i, m in expected.items() if sum(x == m for x in expected.values()) > 1}
    assert set(got) >= {i for i in linked if expected[i] != i} and groups_of(lambda i: got.get(i, i), linked) == groups_of(expected.__getitem__, linked)


def test_a_crowd_around_one_code_is_searched_by_the_tree(spark):
    """Many codes that share most keys: every one of them is reached, and those of another crowd are not."""
    near = [1 << i | 1 << j for i in range(64) for j in range(i, 64)]
    far = (1 << 40) - 1 << 20
    codes = np.unique(np.array([0, *near, far, far ^ 1], np.uint64)).view(np.int64)
    parts = neardup.components(neardup.links(spark.createDataFrame([(int(c),) for c in codes], "code long")))
    got = {r["node"]: r["component"] for r in parts.collect()}
    assert len({got.get(int(c), int(c)) for c in codes}) == 2


def test_a_hub_meets_its_edges_by_broadcast(spark, monkeypatch):
    from duskline.llm import common

    monkeypatch.setattr(common, "HUB_ROWS", 5)
    monkeypatch.setattr(neardup, "FEW_EDGES", 10)
    monkeypatch.setattr(common, "HUBS", 4)
    edges = spark.createDataFrame([(i, 7) for i in range(100, 200)] + [(300, 301), (301, 302)], "code long, root long")
    assert groups_of({r["node"]: r["component"] for r in neardup.components(edges).collect()}.get, [*range(100, 200), 301, 302]) == {frozenset(range(100, 200)), frozenset((301, 302))}


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "code long, root long")
    assert {r["component"] for r in neardup.components(edges).collect()} == {0}


def near_texts():
    base = " ".join(f"w{i}" for i in range(400))
    return [base, base.replace("w7 ", "v7 "), base.upper(), base + " tail", base, "other words here " * 9]


def test_query_equals_brute_force(spark, documents, odd_texts, tmp_path):
    texts = [*odd_texts, *near_texts()]
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash_neardup(spark, str(tmp_path)).collect()}
    prints = [(i, brute_print(t)) for i, t in enumerate(texts)]
    assert got == {i: (f"{p:016x}", brute_components(prints, 2)[i]) for i, p in prints}


def test_one_of_each_group_stays(documents):
    df = documents([(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, "far away from all of this"), (7, None), (8, "")]).withColumn("code", F.lit(1))
    kept = neardup.one_of_each(df)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 3), (False, 7), (False, 9), (True, 0)]
    assert neardup.one_of_each(df.limit(0)).count() == 0


def test_components_without_ids(documents):
    got = neardup.near_duplicates(documents([(None, "a b c"), (None, "a b c"), (4, "x y z")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (4, 4)]
