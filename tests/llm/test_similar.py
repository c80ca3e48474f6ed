import random

import numpy as np

import corpus_pipeline
from duskline.llm import neardup, similar


def jaccard(a, b):
    grams = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in (a, b)]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1]) if grams[0] | grams[1] else 1.0


def brute(texts, least=0.8):
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def families(seed):
    """Families of 60 to 200 words with up to a few edits, on both sides of 0.8, and one chain."""
    rng = random.Random(seed)
    texts = []
    for f in range(12):
        base = [f"f{f}w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 100, 200]))]
        texts += [" ".join(base)] + [edited(rng, base, rng.randrange(1, 6)) for _ in range(6)]
    at = [f"c{i}" for i in range(120)]
    for i in range(8):
        at = at[: 10 * i] + [f"x{i}"] + at[10 * i + 1 :]
        texts.append(" ".join(at))
    rng.shuffle(texts)
    return texts


def test_pipeline_stage_drops_copies_with_several_edits(spark, documents):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(250)]
    texts = [" ".join(base), *[edited(rng, base, 4) for _ in range(6)], "one short text of nine words is right here", "far away from all of this"]
    assert all(jaccard(texts[0], t) >= 0.8 for t in texts[1:7])
    kept = corpus_pipeline.drop_near_copies(spark, documents(texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 7, 8]


def test_components_equal_brute_force(documents, odd_texts):
    texts = [*odd_texts, *families(1)]
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(documents(texts)).collect()}
    assert got == brute(texts)


def test_a_family_about_the_threshold_in_small_blocks(documents, monkeypatch):
    """Most members are just below 0.8 of one another, some reach it: many components meet in each key."""
    monkeypatch.setattr(similar, "BLOCK_ROWS", 5)
    monkeypatch.setattr(similar, "BLOCK_HASHES", 1000)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [edited(rng, base, rng.randrange(1, 6)) for _ in range(70)]
    expected = brute(texts)
    assert 10 < len(set(expected.values())) < 65
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(documents(texts)).collect()}
    assert got == expected


def test_overlaps_equal_set_sizes(monkeypatch):
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(-60, 60, n)) for n in sizes] for sizes in ([0, 1, 30, 90], [40, 0, 7]))
    expected = [[len(set(a) & set(b)) for b in right] for a in left]
    for width in (7, 4096):
        monkeypatch.setattr(similar, "WIDTH", width)
        assert similar.overlaps(left, right).tolist() == expected
    assert similar.overlaps(left, [np.array([10**9])]).tolist() == [[0]] * 4


def test_repeated_and_missing_ids(documents):
    base = " ".join(f"w{i}" for i in range(60))
    df = documents([(5, base), (3, base + " end"), (3, "another text under the same id as one before"), (None, "end " + base), (9, "far away from all of this"), (7, None), (8, "")])
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in similar.near_copies(df).collect()))
    assert got == [(False, 3, 3), (False, 3, 3), (False, 5, 3), (False, 7, 7), (False, 8, 7), (False, 9, 9), (True, 0, 3)]
    assert similar.one_of_each(df.limit(0)).count() == 0


def test_op10_keeps_its_contract(documents):
    assert neardup.one_of_each(documents(["a b c d", "a b c d", "x y z u"])).count() == 2


def test_sets_of_a_key_are_searched_by_the_tree(monkeypatch):
    """All pairs of one group within the radius, none of two groups; the stage's search goes through it."""
    from duskline.llm.simhash import GrayTree

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    codes = np.array([base[rng.integers(4)] ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(30))))) for _ in range(300)])
    groups = rng.integers(-3, 40, 300)
    tree = GrayTree(codes, groups=groups)
    got = sorted(tuple(sorted(p)) for a, b in tree.pairs(similar.RADIUS) for p in zip(tree.order[a].tolist(), tree.order[b].tolist(), strict=True))
    assert got == [(i, j) for i in range(300) for j in range(i + 1, 300) if groups[i] == groups[j] and np.bitwise_count(codes[i] ^ codes[j]) <= similar.RADIUS]

    import pandas as pd

    rows = [(1, True, 5, 1, np.arange(9)), (1, False, 7, 2, np.arange(10)), (2, False, 5, 3, np.arange(9)), (1, False, 5, 4, np.arange(50))]
    df = pd.DataFrame([(g, o, p, c, len(s), s) for g, o, p, c, s in rows], columns=["group", "odd", "print", "component", "size", "set"])
    assert similar._links_within(df, 0.8).to_numpy().tolist() == [[2, 1]]
    monkeypatch.setattr(GrayTree, "pairs", lambda self, radius: iter(()))
    assert similar._links_within(df, 0.8).empty
