"""Similar word sets meet by sketches: all of them, and no words are shuffled."""

import random

import duckdb

from duskline.operators import sketches
from duskline.plans import catalogue


def documents(seed):
    """Families about a similarity of 0.8, sets of many sizes, copies, an id over two texts, and rows without words, source or language."""
    rng = random.Random(seed)
    rows, doc_id = [], 0
    for family in range(25):
        base = [f"f{family}w{i}" for i in range(rng.choice([1, 2, 4, 5, 9, 30, 120, 700]))]
        for _ in range(7):
            doc_id += 1
            words = [w if rng.random() > 0.06 else f"x{rng.randrange(10**6)}" for w in base]
            rows.append((doc_id, rng.choice("st") if family % 2 else "s", "en", " ".join(rng.sample(words, len(words))).upper()))
    rows += [(900, "s", "en", rows[0][3]), (3, "s", "en", "some other words under an id as before"), (901, "s", "en", "others words under an id as before some"), (902, None, "en", "ab cd"), (903, None, "en", "ab cd ef"), (904, "s", "en", None), (905, "s", "en", "é x"), (None, "s", "en", "no id at all"), (906, "s", "en", "no id\tat allé İd")]
    return rows


def test_similar_sets_equal_sql_in_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sketches, "BLOCK_ROWS", 20)
    monkeypatch.setattr(sketches, "PAIRS", 50)
    spark.createDataFrame(documents(1), "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalogue.QUERIES["token_jaccard"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        known = c.execute("select a_class, b_class, jaccard, overlap from (" + catalogue.ORACLES["token_jaccard"] + ")").fetchall()
    got = sorted(map(tuple, out.collect()))
    assert len(known) > 50 and got == sorted(known)


def test_words_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame(documents(2), "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue.QUERIES["token_jaccard"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(w" not in plan and "collect_list" not in plan


def test_sketches_bound_what_differs():
    rng = random.Random(3)
    import numpy as np

    for _ in range(50):
        both, a, b = (np.array([rng.randrange(1 << 63) for _ in range(rng.randrange(40))], np.uint64) for _ in range(3))
        x, y = (np.frombuffer(sketches.parity(np.concatenate([both, z]), 2), np.uint64) for z in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b)
