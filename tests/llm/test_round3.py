"""Centroid clustering, fill-in-middle and substring dedup against their definitions."""

import hashlib
import math
import random
import re
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskline.llm import centroids, fill_middle, queries, substring_dedup

# ---------------------------------------------------------------- centroids


def clusters_by_definition(rows, dims=64, scale=64, clusters=16, rounds=3, seed=1, most=1 << 27):
    """[(id, cluster, distance, cluster_inertia, inertia, digest)] in exact integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(max(-most, min(most, math.floor(Fraction(x) * scale))) for x in v)))
    drawn = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:clusters]
    at = [list(q) for _, q in drawn]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(at))
    if not at:
        return []
    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(near(q)[1], []).append(q)
        for k, mine in own.items():
            at[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = {}
    for _, k, d in found:
        inertia[k] = inertia.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    cut = lambda x: min(x, 2**63 - 1)
    return sorted(((i, k, d, cut(inertia[k]), cut(sum(inertia.values())), digest[k]) for i, k, d in found), key=str)


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def as_float(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def made(df, **options):
    return sorted((tuple(r) for r in centroids.centroid_clusters(df, **options).collect()), key=str)


def test_centroids_equal_the_definition(spark):
    rng = random.Random(3)
    rows = [(i, [as_float(rng.gauss(i % 7, 0.3)) for _ in range(64)]) for i in range(120)]
    rows += [(1000 + i, rows[5][1]) for i in range(80)]
    rows += [(7, rows[9][1]), (7, rows[9][1]), (7, rows[1][1]), (None, rows[2][1]), (2000, None), (2001, []), (2002, [0.5] * 63), (2003, [None] + [0.5] * 63), (2004, [float("nan")] + [0.5] * 63), (2005, [float("-inf")] + [0.5] * 63), (2006, [-0.0] * 64)]
    assert made(vectors_of(spark, rows)) == clusters_by_definition(rows)


def test_centroids_of_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(0, 2**22) for _ in range(64)]) for i in range(40)] + [(50, [1e300] * 64), (51, [-1e300] * 64)]
    assert made(vectors_of(spark, rows, "double"), rounds=2) == clusters_by_definition(rows, rounds=2)


def test_centroids_of_few_and_no_vectors(spark):
    rows = [(1, [0.1] * 4), (2, [0.1] * 4), (3, [0.9] * 4)]
    assert made(vectors_of(spark, rows), dims=4) == clusters_by_definition(rows, dims=4)
    assert made(vectors_of(spark, [(1, [0.1] * 3)]), dims=4) == []
    assert made(vectors_of(spark, [(None, [0.1] * 4)]), dims=4) == []
    assert made(vectors_of(spark, []), dims=4) == []
    with pytest.raises(ValueError):
        centroids.centroid_clusters(vectors_of(spark, rows), dims=65)


def test_centroids_leave_further_columns_out(spark):
    rows = [(i, [i / 10] * 4) for i in range(20)]
    more = vectors_of(spark, rows).withColumns({"cluster": F.lit("x"), "q": F.lit(1), "weight": F.lit(2), "distance": F.lit(3), "h": F.lit(4), "id": F.lit(5)})
    assert made(more, dims=4) == clusters_by_definition(rows, dims=4)


def test_nearest_takes_the_first_of_ties_either_way():
    x = np.array([[0, 0], [3, 0]], np.int64)
    for far in (1, 1 << 21):
        at = np.array([[far, 0], [-far, 0], [far, 0]], np.int64)
        assert centroids.nearest(x, at)[0].tolist() == [0, 0]


# ---------------------------------------------------------------- fill-in-middle


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_by_definition(doc_id, text, seed=42):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


STRANGE = ["<P> in it", "x <S>", "<M>", "ends <", "< <P", "S> M> a <M", " lead", "trail \n", "　wide　 space \x1c", "a\x85b", "é́ \U0001f600 x", "\x00 \x00"]


def test_fill_in_middle_equals_the_definition(spark, documents, odd_texts):
    texts = [*odd_texts, *STRANGE] * 4
    rows = [*enumerate(texts), (None, "no id at all"), (3, "again"), (3, "again")]
    out = fill_middle.fill_in_middle(documents(rows).withColumns({"form": F.lit(1), "n": F.lit("x"), "output": F.lit(2), "prefix": F.lit(3)}))
    out = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back, r.prefix) for r in out.collect()), key=str)
    assert got == sorted(((i, t, *middle_by_definition(i, t), t or "", 3) for i, t in rows), key=str)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_ranked_bits_and_token_ends():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("ab \n\té", k=rng.randint(0, 70)))
        data = text.encode()
        ends, at = [], 0
        for t in TOKEN.findall(text):
            at += len(t.encode())
            ends.append(at - 1)
        mask = fill_middle.token_ends(data)
        assert mask == sum(1 << e for e in ends)
        assert [fill_middle.ranked_bit(mask, r + 1) for r in range(len(ends))] == ends


def test_fill_in_middle_of_an_empty_table(spark, documents):
    assert fill_middle.fill_in_middle(documents([])).count() == 0


# ---------------------------------------------------------------- substring dedup


def repeats_by_definition(rows, window):
    """[(id, n_words, n_removed, kept)] by comparing all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    place = lambda r, s: (rows[r][0] if rows[r][0] is not None else -(2**63), s)
    first = {}
    for r, w in enumerate(words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, place(r, s)), place(r, s))
    out = []
    for r, w in enumerate(words):
        gone = set()
        for s in range(len(w) - window + 1):
            if place(r, s) > first[tuple(w[s : s + window])]:
                gone |= set(range(s, s + window))
        out.append((rows[r][0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def deduped(df, **options):
    return sorted((tuple(r) for r in substring_dedup.remove_repeats(df, **options).collect()), key=str)


@pytest.mark.parametrize("window", [20, 8, 7])
def test_substring_dedup_equals_the_definition(documents, odd_texts, window):
    rng = random.Random(window)
    words = [f"w{i}" for i in range(300)] + ["é", "x" * 300]
    passages = [" ".join(rng.choices(words, k=k)) for k in (window, window + 1, 35, 60)]
    texts = [*odd_texts[:34], "a " * 500, "a b " * 30, "　a　 " * 30]
    for _ in range(40):
        texts.append(" ".join([*rng.choices(words, k=rng.randint(0, 30)), rng.choice(passages), *rng.choices(words, k=rng.randint(0, 30))]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(None, passages[3]), (3, texts[-1]), (3, texts[-1]), (5, passages[2] + " z"), (5, "z " + passages[2])]
    assert deduped(documents(rows), window=window, shortest=2) == repeats_by_definition(rows, window)


def test_substring_dedup_without_repeats_words_or_rows(documents):
    assert deduped(documents(["a b c", None, ""]), window=20) == [(0, 3, 0, "a b c"), (1, 0, 0, ""), (2, 0, 0, "")]
    assert deduped(documents([])) == []


def test_substring_dedup_of_many_copies_in_small_pieces(documents, monkeypatch):
    for name, value in (("CHUNK", 400), ("SEGMENT", 64), ("GATHERED", 50)):
        monkeypatch.setattr(substring_dedup, name, value)
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(i, text if i % 2 else f"{i} {text}") for i in range(60)]
    more = documents(rows).withColumns({"row": F.lit(1), "left": F.lit(2), "doc": F.lit(3), "n_words": F.lit(4)})
    assert deduped(more) == repeats_by_definition(rows, 20)


def test_lengths_double():
    assert substring_dedup.lengths_of(20, 5) == [5, 10, 20]
    assert substring_dedup.lengths_of(50, 5) == [25, 50]
    assert substring_dedup.lengths_of(7, 2) == [7]


def test_words_and_hashes_keep_texts_apart():
    data = np.frombuffer(b"ab cdab", np.uint8)
    starts, ends, text = substring_dedup.word_spans(data, np.array([0, 0, 5, 5, 7, 7]))
    assert [(bytes(data[s:e]), int(t)) for s, e, t in zip(starts, ends, text, strict=True)] == [(b"ab", 1), (b"cd", 1), (b"ab", 3)]
    h = substring_dedup.word_hashes(data, starts, ends, 0x9E3779B97F4A7C15)
    assert h[0] == h[2] != h[1]


# ---------------------------------------------------------------- queries


def test_queries_of_the_round_have_the_contracts_columns(spark, sf_dir):
    found = {n: queries.QUERIES[n](spark, sf_dir).dtypes for n in ("op11_centroids", "op12_fill_in_middle", "op13_substring_dedup")}
    assert found == {
        "op11_centroids": [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")],
        "op12_fill_in_middle": [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")],
        "op13_substring_dedup": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")],
    }
