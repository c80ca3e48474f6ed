import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from duskline.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def own():
    return bpe.ForcedBoundaryBpe(queries.tokenizer_path())


def hard_texts():
    rng = random.Random(3)
    pool = ["a", "A", "b", "Z", "'s", "'", "st", " ", "\n", "0", "9", "!", ".", "<|startoftext|>", "<|endoftext|>", "<|", "é", "É", "ß", "İ", "Σ", "ς", "中", "日本", "😀", "\u0301", "\xa0", "\x1c", "\x85", "\x00", "ﬁ", "½", "한", "\ufeff", "don't", "I'LL"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(1500)]
    return texts + ["".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(10)) for _ in range(1500)]


def test_equals_the_library(own, library):
    for text in hard_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(text)


def test_cuts_are_never_inside_a_token(own):
    for word in ("zqxjkv", "hello", "thequickbrown"):
        marked = word[:-1] + chr(bpe.LAST + ord(word[-1]))
        parts = own.fragments(marked)
        assert "".join(parts) == marked
        whole = own._merge(marked)
        assert [i for p in parts for i in own._merge(p)] == whole


def test_caches_that_overflow_change_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 800)
    small = bpe.ForcedBoundaryBpe(queries.tokenizer_path())
    text = "one two three, four five. one two six seven one"
    assert small.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_counting_makes_no_texts(library):
    counting = bpe.ForcedBoundaryBpe(queries.tokenizer_path(), counting=True)
    for text in [*hard_texts()[::10], "", " \n", "One, two <|endoftext|>x don't. One"]:
        assert counting.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    assert counting._words and not any("".join(v[:2]).strip() for c in (counting._chunks, counting._words, counting._mapped_words) for v in c.values())


def test_query_over_odd_texts(spark, documents, odd_texts, library, tmp_path):
    documents(odd_texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op2_bpe(spark, str(tmp_path)).collect()}
    assert len(got) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_round_trip_of_columns_and_clashing_names(documents, library):
    df = documents(["Hello there", None]).withColumn("ids", F.lit("taken"))
    coded = bpe.encode_texts(df, queries.tokenizer_path())
    back = {r["doc_id"]: r["again"] for r in bpe.decode_ids(coded, queries.tokenizer_path(), out_col="again").collect()}
    assert back == {0: library.decode(library.encode("Hello there", add_special_tokens=False).ids, skip_special_tokens=False), 1: ""}
    assert bpe.encode_texts(df.limit(0), queries.tokenizer_path()).count() == 0


def test_a_word_of_a_megabyte(own, library):
    rng = random.Random(8)
    for text in ("a" * 1_000_000, "".join(rng.choices("acgt", k=60_000)), "ab" * 30_000 + "é" * 2000):
        began = time.time()
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert time.time() - began < 60
    assert own._words.held < bpe.CACHE_BYTES and max(map(len, own._words), default=0) <= bpe.MOST_CACHED


def test_caches_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3000)
    cache = bpe.Cache(len)
    assert [cache["x" * (i % 200)] for i in range(2000)] == [i % 200 for i in range(2000)]
    assert len(cache) + len(cache.old) < 30 and cache["y" * 5000] == 5000 and "y" * 5000 not in cache


def test_the_stage_encodes_and_decodes_in_one_worker(spark, documents, odd_texts, library):
    import corpus_pipeline

    out = corpus_pipeline.encode(spark, documents(odd_texts), "")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {r["doc_id"]: r for r in out.collect()}
    for i, text in enumerate(odd_texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids"]) == (len(ids), ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
