"""Sharding, token rollups and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from compare import rows_in_duckdb, rows_of
from pyspark.sql import functions as F

from duskline.llm import decontam, feistel, queries, token_rollup


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 100, 1000, 4097])
def test_permutation_and_inverse(n):
    for seed in (0, 42):
        shuffle = feistel.FeistelShuffle(n, seed)
        y = shuffle.forward(np.arange(n))
        assert sorted(y.tolist()) == list(range(n))
        assert (shuffle.inverse(y) == np.arange(n)).all()


def test_shuffle_moves_rows_evenly():
    y = feistel.FeistelShuffle(20_000, 42).forward(np.arange(20_000))
    assert abs(np.corrcoef(np.arange(20_000), y)[0, 1]) < 0.03


def test_sharding_equals_its_sql(spark, sf_dir):
    assert rows_of(queries.op8_sharding(spark, sf_dir)) == rows_in_duckdb(queries.oracles()["op8_sharding"], sf_dir)


def test_shards_of_odd_rows(spark, documents, odd_texts, tmp_path):
    documents([*odd_texts, (None, "no id"), (3, "again"), (3, "again"), (3, "again")], 5).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op8_sharding(spark, str(tmp_path)).collect()
    assert len(rows) == len(odd_texts) + 4
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        text = odd_texts[r["doc_id"]] if r["doc_id"] is not None and r["doc_id"] != 3 else None
        if r["doc_id"] not in (None, 3):
            assert (r["size"], r["text_crc32"]) == (len((text or "").encode()) + 1, zlib.crc32((text or "").encode()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_result_does_not_depend_on_partitions(spark, documents, odd_texts):
    deal = lambda parts: sorted(map(tuple, feistel.feistel_shards(documents(odd_texts, parts).select("doc_id"), ["doc_id"], 4, 1).collect()))
    assert deal(1) == deal(7)


def test_sharding_of_no_rows(documents):
    assert feistel.feistel_shards(documents(["x"]).limit(0).select("doc_id"), ["doc_id"]).count() == 0


COUNTED = "source string, lang string, tokenizer string, n_tokens long"


def test_rollup_is_idempotent(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    rows = lambda: {tuple(x) for x in r.totals().collect()}
    first = spark.createDataFrame([("a", "en", "t", 5), ("a", "en", "t", 5), ("b", None, "t", None)], COUNTED)
    assert rows() == set()
    assert r.commit("one", token_rollup.inserts(first)) and not r.commit("one", token_rollup.inserts(first))
    assert rows() == {("a", "en", "t", 2, 10), ("b", None, "t", 1, 0)}
    changed = spark.createDataFrame([("a", "en", "t", 5, "u", 7)], "source string, lang string, tokenizer string, old_tokens long, new_tokenizer string, new_tokens long")
    assert r.commit("two", token_rollup.revisions(changed))
    assert rows() == {("a", "en", "t", 1, 5), ("a", "en", "u", 1, 7), ("b", None, "t", 1, 0)}
    r.compact()
    assert not r.commit("two", token_rollup.revisions(changed)) and r.committed("one")
    assert r.commit("three", token_rollup.deletes(spark.createDataFrame([("a", "en", "u", 7)], COUNTED)))
    assert r.commit("empty", token_rollup.inserts(first.limit(0)))
    r.compact()
    assert rows() == {("a", "en", "t", 1, 5), ("b", None, "t", 1, 0)}


def test_rollup_takes_up_a_batch_that_was_cut_short(spark, tmp_path):
    import os

    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("a", "en", "t", 5)], COUNTED)
    r.commit("one", token_rollup.inserts(rows))
    os.remove(f"{tmp_path}/r/delta/batch-one/_SUCCESS")
    assert r.totals().count() == 0
    assert r.commit("one", token_rollup.inserts(rows)) and r.totals().count() == 1
    with pytest.raises(ValueError):
        r.commit("../one", token_rollup.inserts(rows))


def test_rollup_query_equals_a_plain_count(spark, sf_dir):
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in queries.op4_token_rollup(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    first = {}
    for d in docs:
        first[d["text"] or ""] = min(first.get(d["text"] or "", d["doc_id"]), d["doc_id"])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    expected = {}
    for d in docs:
        if first[d["text"] or ""] == d["doc_id"]:
            text = d["text"] or ""
            parts = "".join(f" {c} " if c.isascii() and not c.isalnum() and c.isprintable() and c != " " else c for c in text)
            for name, n in (("word_bpe_49k", len(t.encode(text, add_special_tokens=False).ids)), ("words-2", len(parts.encode().split()))):
                k = d["source"], d["lang"], name
                a, b = expected.get(k, (0, 0))
                expected[k] = a + 1, b + n
    assert got == expected


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert after.columns == docs.columns, name
        assert after.join(kept, "doc_id", "left_anti").count() == 0, name
        assert 0 < after.count() < kept.count(), name
        kept = after
    leaked = {r[0] for r in decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(out) == {r["doc_id"] for r in kept.collect()} and not leaked & set(out)
    assert all(len(r["ids"]) == r["n_tokens"] for r in out.values())
    assert kept.select(F.countDistinct("text")).first()[0] == kept.count()
    t = decoder()
    assert all(r["decoded_sha256"] == hashlib.sha256(t.decode(r["ids"], skip_special_tokens=False).encode()).hexdigest() for r in list(out.values())[:200])


def decoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_pipeline_on_odd_rows(spark, documents, odd_texts, tmp_path):
    """Null ids and texts, repeated rows, very long texts, clashing and further columns, and empty tables, through every stage."""
    import corpus_pipeline

    # of the labelled texts' own words, so that the quality rules keep it
    good = " ".join(random.Random(9).choices(["alpha", "béta", "gamma,", "Zeta!", "eta", "theta", "iota", "kappa"], k=70))
    rows = [*enumerate(odd_texts), (None, good), (None, None), (500, good), (500, good), (501, good + " end"), (502, " ".join(f"long{i}" for i in range(40_000)))]
    df = documents(rows).withColumn("code", F.lit("mine")).withColumns({"score": F.lit(1), "n_words": F.lit(-5), "kept": F.lit("x")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(30)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some item of the benchmark that nobody holds"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == df.columns, name
        assert {tuple(r) for r in kept.select("code", "score", "n_words", "kept").collect()} == {("mine", 1, -5, "x")}, name
    empty = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(500) == 1 and 501 not in ids and None in ids
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((i is None, i or 0) for i in ids)


def test_copies_without_ids_leave_one(spark, documents, tmp_path):
    documents([(5, "same text"), (None, "same text"), (7, "same text"), (None, "other"), (None, "other")]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["tokenizer"]: r["documents"] for r in queries.op4_token_rollup(spark, str(tmp_path)).collect()} == {"words-2": 2, "word_bpe_49k": 2}
