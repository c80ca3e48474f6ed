import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskline.llm import byte_cnn, queries, toxicity


def held_out(spark, sf_dir, query, label, folds, fold):
    rows = query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    return [(r["predicted"], r[label]) for r in rows if r["held_out"]]


@pytest.fixture(scope="module")
def larger(sf_dir):
    return sf_dir.replace("sf0.001", "sf0.1")


def test_toxicity_on_held_out_documents(spark, larger):
    got = held_out(spark, larger, queries.op7_toxicity, "toxic", 3, 1)
    assert sum(p == y for p, y in got) >= 0.96 * len(got)
    assert sum(p for p, y in got if y) >= 0.78 * sum(y for _, y in got)


def test_quality_on_held_out_documents(spark, larger):
    got = held_out(spark, larger, queries.op9_quality_classifier, "quality", 4, 2)
    assert sum(p == y for p, y in got) >= 0.95 * len(got)
    assert sum(1 - p for p, y in got if not y) >= 0.8 * sum(1 - y for _, y in got)


def brute_kernel(a, b):
    """Sum over pairs of equal three-letter subsequences, within SPAN, of their weights."""

    def occurrences(x):
        n = len(x)
        for i in range(n):
            for k in range(i + 2, min(n, i + toxicity.SPAN)):
                for j in range(i + 1, k):
                    yield (x[i], x[j], x[k]), toxicity.DECAY ** (k - i + 1)

    return sum(w * v for u, w in occurrences(a) for t, v in occurrences(b) if u == t) / toxicity.norm(len(a)) / toxicity.norm(len(b))


def test_folded_weights_equal_the_kernel():
    words = [toxicity.units(w)[0] for w in ("idiot", "loser", "garden", "i-d-i-o-t", "idxiot", "stone", "hidiots")]
    y = np.array([1, 1, -1, 1, 1, -1, -1])
    weights, _ = toxicity.kernel_machine(words, y, np.ones(7), words)
    # the folded value is linear in the kernel with the landmarks: fit it on those and compare on others
    others = [toxicity.units(w)[0] for w in ("idioot", "lo.ser", "gardens", "the", "stones", "iidiot", "lsr", "gard")]
    k = np.array([[brute_kernel(a, b) for b in words] for a in words + others])
    beta = np.linalg.lstsq(k[:7], toxicity.decision(words, weights), rcond=None)[0]
    assert np.allclose(k[7:] @ beta, toxicity.decision(others, weights), atol=1e-3)


def toxic_rows():
    rng = np.random.default_rng(0)
    calm = ["river", "stone", "garden", "window", "morning", "letter", "quiet", "yellow", "paper", "summer"]
    rows = []
    for i in range(160):
        words = list(rng.choice(calm, 20))
        if i % 4 == 0:
            words[3] = ["idiot", "moron", "scumbag", "worthless"][i // 4 % 4]
        rows.append((" ".join(words), int(i % 4 == 0)))
    return rows


def unit_rows():
    return [(toxicity.packed(text), label) for text, label in toxic_rows()]


def test_gapped_and_inserted_characters():
    score = toxicity.ToxicityModel.fit(unit_rows()).scorer()
    bad = score(["you idiot", "you i.d.i.o.t here", "i d i o t", "such an idi0ot", "MORON", "mor-on"])
    fine = score(["river stone", "yellow letter morning", "", None, "...", "quiet " * 5000])
    assert bad.min() > fine.max() and (bad >= 0.5).all() and (fine < 0.5).all()


def test_toxicity_without_examples(documents):
    model = toxicity.ToxicityModel.fit([(toxicity.packed("all fine"), 0)])
    df = documents([None, "", "x"]).withColumn("score", F.lit("taken"))
    assert {r["score"] for r in toxicity.score_toxicity(df, model).collect()} == {0.0}
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_fits_repeat_exactly():
    a, b = toxicity.ToxicityModel.fit(unit_rows()), toxicity.ToxicityModel.fit(unit_rows())
    assert (a.weights == b.weights).all() and a.offset == b.offset and (a.curve == b.curve).all()


def test_toxicity_query_equals_the_model_by_its_definition(spark, documents, tmp_path):
    """The whole query, its training rows included, against a plain version that scores word by word."""
    rows = [(i, text) for i, (text, _) in enumerate(toxic_rows())] + [(900, None), (901, ""), (902, "calm " * 3000 + "you moron"), (903, "i d i o t"), (3, "a second text of an id")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(toxic_rows())] + [(900, 1, 0), (None, 1, 1), (901, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = {i: y for i, (_, y) in enumerate(toxic_rows()) if zlib.crc32(str(i).encode()) % 3 != 1} | ({900: 0} if zlib.crc32(b"900") % 3 != 1 else {})
    seen = sorted((i, toxicity.packed(t), labels[i]) for i, t in rows if i in labels)
    model = toxicity.ToxicityModel.fit([(us, y) for i, us, y in sorted(seen, key=lambda r: (r[0], r[2], r[1]))])

    def score(text):
        values = sorted((float(toxicity.decision([u], model.weights, model.offset)[0]) for u in toxicity.units_in(text)), reverse=True)[: toxicity.TOP]
        top = np.array([values + [toxicity.LOWEST] * (toxicity.TOP - len(values))])
        return 1 / (1 + np.exp(-(toxicity.evidence(top) @ model.curve[:-1] + model.curve[-1])[0]))

    got = sorted((r["doc_id"], round(r["score"], 6)) for r in queries.op7_toxicity(spark, str(tmp_path)).collect())
    assert np.allclose([s for _, s in got], [s for _, s in sorted((i, score(t)) for i, t in rows)], atol=1e-4)
    assert [i for i, _ in got] == sorted(i for i, _ in rows)


def test_quality_query_equals_the_network_by_its_definition(spark, documents, tmp_path):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["lorem", "ipsum", "dolor"], 40)) if i % 2 else "".join(rng.choice(list("!#%&x"), 200)) for i in range(40)] + [None, "", "y" * 3000]
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (41, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    known = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    net = byte_cnn.fit([(texts[i].encode(), i % 2) for i in known], float(np.mean([i % 2 for i in known])))
    got = {r["doc_id"]: r["score"] for r in queries.op9_quality_classifier(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    assert np.allclose([got[i] for i in range(len(texts))], [1 / (1 + np.exp(-brute_logit(net, (t or "").encode()))) for t in texts], atol=1e-3)


def test_training_texts_are_bounded_in_bytes(spark, documents):
    df = documents(["a" * 100] * 20)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    rows, share = byte_cnn.training_rows(df, labels, most_bytes=850)
    assert share == 0.5 and sorted(y for _, y in rows) == [0] * 4 + [1] * 4 and {len(t) for t, _ in rows} == {100}


def test_one_huge_text_leaves_both_labels(spark, documents):
    for huge in (0, 1, 7):
        df = documents([("x" * 8000 if i == huge else f"text {i}") for i in range(20)] + [(3, "again"), (3, "again")])
        labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
        rows, _ = byte_cnn.training_rows(df, labels, most_bytes=8000)
        assert sorted(y for _, y in rows) == sorted(i % 2 for i in range(20) if i != huge)


def test_repeated_ids_are_one_toxicity_example(spark, documents):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    rows = toxicity.training_rows(documents([(1, f"bad words {i}") for i in range(9)] + [(2, "nice words")]), labels)
    assert sorted(y for _, y in rows) == [0, 1]


def test_scores_without_both_labels():
    for share in (0.0, 0.5, 0.9, 1.0):
        expected = min(max(share, 1e-3), 1 - 1e-3)
        assert np.allclose(byte_cnn.fit([(b"one kind", 1)], share).score([b"any", None]), expected)


def brute_logit(net, text):
    """The network by its definition, without tables."""
    pooled = []
    for x in byte_cnn.chunks(text):
        e = net.embedding[x]
        conv = np.array([e[i : i + byte_cnn.WIDTH].ravel() @ net.filters for i in range(byte_cnn.CHUNK - byte_cnn.WIDTH + 1)])
        pooled.append(np.maximum(conv.max(0) + net.bias, 0))
    pooled = np.array(pooled)
    return np.concatenate([pooled.mean(0), pooled.max(0)]) @ net.weights + net.offset


def test_cnn_tables_equal_the_convolution():
    net = byte_cnn.ByteCnn.start()
    net.weights = np.linspace(-1, 1, 2 * byte_cnn.FILTERS).astype(np.float32)
    for text in (b"", b"short", b"x" * 1000, bytes(range(256)) * 5):
        assert np.isclose(net.logit(text, net.tables()), brute_logit(net, text), atol=1e-3)


def test_cnn_gradients():
    net = byte_cnn.ByteCnn.start()
    rng = np.random.default_rng(2)
    net.weights = rng.normal(size=2 * byte_cnn.FILTERS).astype(np.float32)
    x, y = [rng.integers(0, 256, (n, byte_cnn.CHUNK)).astype(np.uint8) for n in (2, 1, 4)], np.array([1, 0, 1], np.float32)
    for name in ("embedding", "filters", "bias", "weights"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    slopes = net._step(x, y)

    def loss():
        pooled = [np.maximum(net._strongest(d)[0], 0) for d in x]
        z = np.array([np.concatenate([p.mean(0), p.max(0)]) for p in pooled]) @ net.weights + net.offset
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1))))) + 0.5e-4 * float(net.weights @ net.weights)

    for name, at in (("filters", (3, 5)), ("bias", (2,)), ("weights", (7,))):
        own = getattr(net, name)
        kept, step = own[at], 1e-5
        own[at] = kept + step
        up = loss()
        own[at] = kept - step
        down = loss()
        own[at] = kept
        assert np.isclose((up - down) / (2 * step), slopes[name][at], atol=2e-3)


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        text = bytes((i * 7 + i // 256) % 255 + 1 for i in range(n))
        own = byte_cnn.chunks(text)
        joined = b"".join(c.tobytes()[: byte_cnn.STRIDE] for c in own[:-1]) + own[-1].tobytes()
        assert joined.rstrip(b"\x00") == text


def test_quality_scores_of_odd_rows(documents):
    df = documents([None, "", "x", "long " * 20_000]).withColumn("score", F.lit("taken"))
    net = byte_cnn.fit([], 0.5)
    assert all(0 <= r["score"] <= 1 for r in byte_cnn.score_quality(df, net).collect())
    assert byte_cnn.score_quality(df.limit(0), net).count() == 0
