import random
from collections import Counter

import numpy as np
import pytest

from duskline.llm import decontam

WORDS = [f"{a}{b}" for a in "bcdfghklmn" for b in ("a", "eko", "inu", "ost")]


def weighted(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(text, items, least):
    """Best similarity of any item-sized window, by comparing all of them."""
    words = decontam.normal_words((text or "").encode())
    found = {}
    for i, item in items:
        own = decontam.normal_words((item or "").encode())
        width = min(5, len(own))
        if not own or width > len(words):
            continue
        size = min(len(own), len(words))  # a document shorter than the item is one window
        bag = lambda w, k=width: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        best = max(weighted(bag(words[s : s + size]), bag(own)) for s in range(len(words) - size + 1))
        if best >= least:
            found[i] = round(best, 6)
    return found


def corpus(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choices(WORDS, k=n))) for k, n in enumerate([3, 5, 8, 20, 40, 60, 60, 90])]
    texts = [None, "", "short"]
    for k, item in items:
        around = lambda n: " ".join(rng.choices(WORDS, k=n))
        words = item.split()
        edited = [*words]
        edited[len(words) // 2] = "changed"
        texts += [item, f"{around(30)} {item} {around(30)}", f"{around(9)} {item.upper()}!! {around(2)}", f"{around(5)} {' '.join(edited)}", " ".join(words[: len(words) // 2]), " ".join(words[: len(words) * 19 // 20]), " ".join(words[1:]), around(200), f"{item} {item}"]
    texts.append(" ".join(rng.choices(WORDS, k=20_000)) + " " + items[5][1])
    return items, texts


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_brute_force(spark, documents, seed):
    items, texts = corpus(seed)
    benchmark = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    df = documents(texts)
    got = {}
    for r in decontam.contaminated(df, benchmark).collect():
        got.setdefault(r["doc_id"], {})[r["item_id"]] = round(r["similarity"], 6)
    expected = {i: f for i, f in ((i, brute(t, items, decontam.MIN_SIMILARITY)) for i, t in enumerate(texts)) if f}
    assert got == expected
    kept = {r["doc_id"] for r in decontam.clean(df, benchmark).collect()}
    assert kept == set(range(len(texts))) - set(expected)


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 30).astype(np.uint64)
    queries = np.concatenate([prints, rng.integers(0, 2**63, 200).astype(np.uint64)])
    for q in range(100):
        flips = rng.choice(64, rng.integers(0, 24), replace=False)
        queries = np.append(queries, prints[q % 30] ^ np.uint64(sum(1 << int(b) for b in flips)))
    found = set(zip(*(x.tolist() for x in decontam.BlockIndex(prints).search(queries)), strict=True))
    assert found == {(i, j) for i, q in enumerate(queries) for j, p in enumerate(prints) if (int(q) ^ int(p)).bit_count() <= decontam.RADIUS}


def test_items_in_blocks(spark, documents, monkeypatch):
    items, texts = corpus(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = documents(texts)
    rows = lambda: sorted(map(tuple, decontam.contaminated(df, benchmark).collect()))
    whole = rows()
    monkeypatch.setattr(decontam, "ITEM_BYTES", 300)
    assert rows() == whole
    assert decontam.clean(df, benchmark).count() == len(texts) - len({r[0] for r in whole})


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    df = documents(["some words"])
    assert decontam.contaminated(df, none).count() == 0
    assert decontam.clean(df, none).count() == 1
    assert decontam.contaminated(df.limit(0), spark.createDataFrame([(1, "some words")], "item_id long, text string")).count() == 0


def test_index_of_many_items_of_one_size():
    rng = np.random.default_rng(4)
    items = [(i, " ".join(rng.choice(WORDS, 30)).encode()) for i in range(3000)]
    index = decontam.Items(items)
    assert all(any(m[0] == i and m[3] == 1.0 for m in index.matches(text)) for i, text in items[::100])
    assert not index.matches(" ".join(rng.choice(WORDS, 500)).encode())


def test_null_ids_repeats_and_clashing_names(spark, documents):
    item = " ".join(WORDS[:12])
    df = documents([(None, item), (1, item), (1, item), (2, "nothing of the kind is said here at all")])
    benchmark = spark.createDataFrame([(5, item, "x")], "item_id long, text string, doc_id string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontam.contaminated(df, benchmark).collect()) == [(0, 5), (1, 5), (1, 5)]
    assert [r["doc_id"] for r in decontam.clean(df, benchmark).collect()] == [2]


def test_item_ids_may_be_null_repeated_or_strings(spark, documents):
    item = " ".join(f"item{i}" for i in range(12))
    df = documents([f"before {item} after", "nothing of it"])
    for kind, ids in (("long", [None, 7, 7]), ("string", [None, "a", "b"])):
        benchmark = spark.createDataFrame([(i, item) for i in ids], f"item_id {kind}, text string")
        found = decontam.contaminated(df, benchmark)
        assert dict(found.dtypes)["item_id"] == {"long": "bigint"}.get(kind, kind)
        assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == sorted(((0, i) for i in ids), key=str)
        assert [r.doc_id for r in decontam.clean(df, benchmark).collect()] == [1]
