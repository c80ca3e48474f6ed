"""The queries of the training-data operators over the tables of a folder, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_cnn, centroids, decontam, feistel, fill_middle, neardup, perspectives, quality_rules, substring_dedup, token_rollup, toxicity, url_filter
from .common import fold_of, shared_dir, table, words_of, written

#: Score from which a document counts as label 1.
LABEL_SCORE = 0.7


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), quality_rules.trusted_ids(table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_texts(docs, tokenizer_path(), with_ids=False)
    return coded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return perspectives.rotate(table(spark, sf_dir, "conversations")).withColumn("spans", spans)


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: all documents by words; all by BPE; words recounted with punctuation apart; exact copies deleted, the one of the least id kept (one without an id only if none has one). The last two are given twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    text = F.coalesce("text", F.lit(""))
    counted = bpe.encode_texts(docs, tokenizer_path(), with_ids=False, with_texts=False)
    counted = counted.select("doc_id", "source", "lang", F.col("n_tokens").alias("bpe"), F.size(words_of(F.col("text"))).cast("long").alias("words"), F.size(words_of(F.regexp_replace(text, r"([!-/:-@\[-`{-~])", " $1 "))).cast("long").alias("parts"), F.sha2(text, 256).alias("sha"))
    counted = written(counted, "counted")
    # sums add up, so exact copies go without a join by text: all documents go, and the first of each text comes back
    first = counted.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "source", "lang", "parts", "bpe")).alias("f")).select("f.*")
    by = lambda df, name, column: df.select("source", "lang", F.lit(name).alias("tokenizer"), F.col(column).alias("n_tokens"))
    changed = counted.select("source", "lang", F.lit("words-1").alias("tokenizer"), F.col("words").alias("old_tokens"), F.lit("words-2").alias("new_tokenizer"), F.col("parts").alias("new_tokens"))
    copies = None
    for name, column in (("words-2", "parts"), ("word_bpe_49k", "bpe")):
        part = token_rollup.deletes(by(counted, name, column)).unionByName(token_rollup.inserts(by(first, name, column)))
        copies = part if copies is None else copies.unionByName(part)
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/duskline/rollup-{uuid.uuid4().hex}")
    rollup.commit("words-1", token_rollup.inserts(by(counted, "words-1", "words")))
    rollup.commit("bpe", token_rollup.inserts(by(counted, "word_bpe_49k", "bpe")))
    for _ in range(2):
        rollup.commit("words-2", token_rollup.revisions(changed))
        rollup.commit("copies", copies)
    rollup.compact()
    return rollup.totals()


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).withColumn("similarity", F.round("similarity", 6))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Fitted to the labels outside the held-out fold of op7."""
    return toxicity.ToxicityModel.fit(toxicity.training_rows(docs, labels.where(fold_of(F.col("doc_id"), 3) != 1)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= LABEL_SCORE).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = feistel.feistel_shards(rows, ["doc_id", "text_crc32", "size"], shards=16, seed=42)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 4) != 2)
    scored = byte_cnn.score_quality(docs, byte_cnn.fit(*byte_cnn.training_rows(docs, labels)))
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= LABEL_SCORE).cast("int").alias("predicted"))


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", neardup.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"), dims=64, scale=64, clusters=16, rounds=3, seed=1)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20, shortest=5)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_bpe, op3_perspectives, op4_token_rollup, op5_decontamination, op6_url_filter, op7_toxicity, op8_sharding, op9_quality_classifier, op10_simhash_neardup, op11_centroids, op12_fill_in_middle, op13_substring_dedup)
}


def oracles() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op3_perspectives": perspectives.oracle(), "op6_url_filter": url_filter.oracle(), "op8_sharding": feistel.oracle(seed=42), "op11_centroids": centroids.oracle(), "op12_fill_in_middle": fill_middle.oracle(), "op13_substring_dedup": substring_dedup.oracle()}
