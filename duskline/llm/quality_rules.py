"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into BUCKETS; one multinomial is fitted to the
documents of a trusted target, one to the whole raw corpus. A document's score
is the mean over its n-grams of the logarithm of their ratio, in fixed point,
so that it does not depend on the order of addition. It is kept if no base rule
fails and the score is at least the threshold. DataFrame functions only.

Null and empty texts have no words and fail the base rules; their score is 0.
Without any target the ratio is 0 everywhere, and base rules alone decide.
Rows are judged one by one, so repeated ones get equal verdicts; columns of the
input with the names of results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed_once, words_of

BUCKETS = 8192
#: Added to each bucket's count, as a share of the mean count.
SMOOTHING = 0.05
#: Units of a log ratio in fixed point.
SCALE = 10_000
#: Documents that the target is fitted to at most, those with the smallest hash of the id.
TARGET_DOCUMENTS = 20_000
MIN_SCORE = -0.08
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"


def base_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _words, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumns({"_words": computed_once(words_of(F.col(text_col))), "_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_lines")
    word = lambda i: F.get(F.col("_words"), i)
    windows = F.transform(F.col("_words"), lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)))
    out = out.withColumn("_windows", F.slice(windows, 1, F.greatest(F.size("_words") - 2, F.lit(0))))
    # most texts repeat no window, and need no sort
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_placed", computed_once(F.when(repeats, placed)))
    same = lambda x, at: F.coalesce(x["h"] == F.get(F.col("_placed"), at)["h"], F.lit(False))
    again = F.filter("_placed", lambda x, k: same(x, k - 1) | same(x, k + 1))
    out = out.withColumn("_again", again)
    covered = F.array_distinct(F.flatten(F.transform("_again", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return out.withColumn("n_repeat_words", F.when(F.col("_again").isNull(), 0).otherwise(F.size(covered)).cast("long")).drop("_windows", "_placed", "_again")


def word_pairs(words: str) -> Column:
    """array<struct<a, b>>: each word and the next; the last word's b is null."""
    return F.arrays_zip(F.col(words).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))


def bucket(buckets: int, *words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int")


def bucket_counts(df: DataFrame, target_ids: DataFrame, id_col: str, text_col: str, buckets: int) -> tuple[list[int], list[int]]:
    """n-grams in each bucket, over the whole corpus and over the target. One row per bucket reaches the driver."""
    ids = F.broadcast(target_ids.select(F.col(id_col).alias("_target")).distinct())
    marked = df.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("_words")).join(ids, F.col("_id") == F.col("_target"), "left")
    pairs = marked.select(F.col("_target").isNotNull().cast("long").alias("t"), F.explode(word_pairs("_words")).alias("p"))
    both = F.array(bucket(buckets, F.col("p.a")), F.when(F.col("p.b").isNotNull(), bucket(buckets, F.col("p.a"), F.col("p.b"))))
    grams = pairs.select("t", F.explode(both).alias("b")).where("b IS NOT NULL")
    raw, target = [0] * buckets, [0] * buckets
    for b, n, t in grams.groupBy("b").agg(F.count("*"), F.sum("t")).collect():
        raw[b], target[b] = n, t
    return raw, target


def log_ratios(raw: list[int], target: list[int]) -> list[int]:
    """Fixed-point logarithm of the target's share of each bucket over the corpus's, both smoothed."""
    if not sum(target):
        return [0] * len(raw)

    def shares(counts: list[int]) -> list[float]:
        more = max(SMOOTHING * sum(counts) / len(counts), 1e-9)
        return [(c + more) / (sum(counts) + more * len(counts)) for c in counts]

    return [round(SCALE * math.log(t / r)) for t, r in zip(shares(target), shares(raw), strict=True)]


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", most: int = TARGET_DOCUMENTS) -> DataFrame:
    """Ids of documents labelled as good, most at most, those with the smallest hash."""
    ids = labels.where("quality = 1").select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(id_col), id_col).limit(most)


def judge(df: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, min_score: float = MIN_SCORE) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score (double), base_failed and kept to df."""
    raw, target = bucket_counts(df, target_ids, id_col, text_col, buckets)
    ratios = F.from_json(F.lit(str(log_ratios(raw, target))), "array<int>")
    out = base_columns(df, text_col)
    grams = 2 * F.col("n_words") - 1
    ratio = lambda *words: F.get(ratios, bucket(buckets, *words))
    total = F.aggregate(word_pairs("_words"), F.lit(0).cast("long"), lambda acc, p: acc + ratio(p["a"]) + F.when(p["b"].isNotNull(), ratio(p["a"], p["b"])).otherwise(0))
    out = out.withColumn("score", F.when(F.col("n_words") == 0, 0.0).otherwise(F.round(total / grams / SCALE, 6)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score)).drop("_words")
