"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Learned filters of WIDTH bytes (over a byte embedding) run over each chunk,
pass a ramp and are max-pooled; the chunks' maxima are averaged and, beside
their largest values, combined by a logistic layer into one probability.

The network is fitted by Adam to at most TRAIN_DOCUMENTS labelled documents and
TRAIN_BYTES of their texts, half of each label if there are as many, those with
the smallest hash of the id, each in whole; the logistic layer is then
calibrated to the labels' shares. Fitting and scoring read every byte, SLICE
chunks at a time. Null and empty texts are one chunk of zero bytes. Without both
labels all scores are the share of label 1 (within 0.001 of 0 and 1; 0.5
without any label). Null labels and labels of a null id are left out; a null id
is scored like any other. Repeated rows get equal scores; a column of the
output's name is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

TRAIN_DOCUMENTS, TRAIN_BYTES, BATCH, RATE = 1600, 64 << 20, 32, 0.01
#: Rounds over the sample, and steps in all at least: a small sample is gone through more often.
EPOCHS, STEPS = 11, 400
CHUNK, STRIDE = 256, 224
WIDTH, EMBEDDING, FILTERS = 6, 6, 16
#: Chunks that scoring holds at a time.
SLICE = 512


def chunks(text: bytes | None) -> np.ndarray:
    """The chunks of a text, one a row, the last padded with zero bytes."""
    text = text or b""
    n = max(1, -(-(len(text) - (CHUNK - STRIDE)) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


class ByteCnn:
    def __init__(self, embedding: np.ndarray, filters: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float):
        self.embedding, self.filters, self.bias, self.weights, self.offset = embedding, filters, bias, weights, offset

    @classmethod
    def start(cls, seed: int = 11) -> ByteCnn:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), rng.normal(0, (WIDTH * EMBEDDING) ** -0.5, (WIDTH * EMBEDDING, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0)

    def _strongest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filters' maxima over each chunk, bias included, and where they are."""
        best, top = [], []
        for at in range(0, len(x), SLICE):
            e = self.embedding[x[at : at + SLICE]]
            conv = np.concatenate([e[:, i : CHUNK - WIDTH + 1 + i] for i in range(WIDTH)], axis=2) @ self.filters
            top.append(conv.argmax(1))
            best.append(np.take_along_axis(conv, top[-1][:, None, :], 1)[:, 0] + self.bias)
        return np.concatenate(best), np.concatenate(top)

    def _step(self, docs: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the log loss. docs: the chunks of each document, any number of them."""
        sizes = np.array([len(d) for d in docs])
        starts, x = np.cumsum(sizes) - sizes, np.concatenate(docs)
        best, top = self._strongest(x)
        pooled = np.maximum(best, 0)
        peak = np.array([s + pooled[s : s + n].argmax(0) for s, n in zip(starts, sizes, strict=True)])
        features = np.concatenate([np.add.reduceat(pooled, starts) / sizes[:, None], np.take_along_axis(pooled, peak, 0)], axis=1)
        p = 1 / (1 + np.exp(-np.clip(features @ self.weights + self.offset, -30, 30)))
        miss = ((p - y) / len(docs)).astype(np.float32)
        d_pooled = np.repeat(miss[:, None] * self.weights[:FILTERS] / sizes[:, None], sizes, axis=0)
        np.add.at(d_pooled, (peak, np.arange(FILTERS)[None, :]), miss[:, None] * self.weights[FILTERS:])
        d_best = (d_pooled * (best > 0)).astype(np.float32)
        # the bytes of the window that each filter's maximum came from
        where = x[np.arange(len(x))[:, None, None], top[:, :, None] + np.arange(WIDTH)[None, None, :]]
        d_filters = np.einsum("nfw,nf->wf", self.embedding[where].reshape(len(x), FILTERS, -1), d_best)
        d_windows = (d_best[:, :, None] * self.filters.T[None]).reshape(-1, WIDTH, EMBEDDING)
        d_embedding = np.zeros_like(self.embedding)
        np.add.at(d_embedding, where.reshape(-1, WIDTH), d_windows)
        return {"embedding": d_embedding, "filters": d_filters, "bias": d_best.sum(0), "weights": features.T @ miss + 1e-4 * self.weights, "offset": np.float32(miss.sum())}

    def train(self, docs: list[np.ndarray], y: np.ndarray, seed: int = 12) -> None:
        """docs: the chunks of each document."""
        rng, state, t = np.random.default_rng(seed), {}, 0
        epochs = max(EPOCHS, -(-STEPS // -(-len(y) // BATCH)))
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                t += 1
                for name, slope in self._step([docs[i] for i in part], y[part]).items():
                    m, v = state.get(name, (0.0, 0.0))
                    m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
                    state[name] = m, v
                    move = RATE * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
                    setattr(self, name, getattr(self, name) - move)

    def tables(self) -> list[np.ndarray]:
        """What each pair of bytes adds to the filters, for each pair of places; bytes are looked up two at a time."""
        per = [self.embedding @ self.filters[i * EMBEDDING : (i + 1) * EMBEDDING] for i in range(WIDTH)]
        return [(per[i][:, None, :] + per[i + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32) for i in range(0, WIDTH, 2)]

    def logit(self, text: bytes | None, tables: list[np.ndarray]) -> float:
        all_ = chunks(text)
        total, peak = np.zeros(FILTERS), np.zeros(FILTERS)
        for at in range(0, len(all_), SLICE):
            x = all_[at : at + SLICE].astype(np.intp)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            n = CHUNK - WIDTH + 1
            conv = tables[0].take(pairs[:, :n], axis=0)
            for i in range(1, len(tables)):
                conv += tables[i].take(pairs[:, 2 * i : 2 * i + n], axis=0)
            pooled = np.maximum(conv.max(1) + self.bias, 0)
            total += pooled.sum(0)
            peak = np.maximum(peak, pooled.max(0))
        return float(np.concatenate([total / len(all_), peak]) @ self.weights + self.offset)

    def score(self, texts: list[bytes | None], tables: list[np.ndarray] | None = None) -> np.ndarray:
        tables = tables or self.tables()
        return 1 / (1 + np.exp(-np.clip([self.logit(t, tables) for t in texts], -30, 30)))


def log_odds(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return math.log(p / (1 - p))


def fit(rows: list[tuple[bytes, int]], share: float) -> ByteCnn:
    """rows: (whole text, label); share: of label 1 among all labels, to which the balanced fit is calibrated."""
    y = np.array([r[1] for r in rows], np.float32)
    net = ByteCnn.start()
    if 0 < y.sum() < len(y):
        net.train([chunks(r[0]) for r in rows], y)
        net.offset = float(net.offset) + log_odds(share) - log_odds(float(y.mean()))
    else:
        net.offset = log_odds(share)
    return net


def training_rows(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCUMENTS, most_bytes: int = TRAIN_BYTES) -> tuple[list[tuple[bytes, int]], float]:
    """The bounded sample of labelled documents as (text, label), and the share of label 1.

    Documents come in the order of a hash of their id; a text that no longer fits
    in its label's half of most_bytes is passed over, and the others go on. An id
    that repeats is an example with one of its texts, that of the least hash. The
    driver gets a size for each of most documents, then the chosen texts.
    """
    ids = labels.select(id_col, F.col(label_col).cast("int").alias("_label")).where(F.col(id_col).isNotNull() & F.col("_label").isNotNull())
    share = ids.agg(F.avg("_label")).first()[0]
    order = F.xxhash64(id_col), F.col(id_col)
    ids = ids.distinct()
    ids = ids.where("_label = 1").orderBy(*order).limit(most // 2).unionByName(ids.where("_label = 0").orderBy(*order).limit(most - most // 2))
    texts = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    sized = texts.select(id_col, F.struct(F.xxhash64("_text").alias("hash"), F.octet_length("_text").alias("n")).alias("_size"))
    sizes = sized.join(F.broadcast(ids), id_col).groupBy(id_col, "_label").agg(F.min("_size").alias("_size"), F.first(F.xxhash64(id_col)).alias("h")).collect()
    chosen, held = [], {0: 0, 1: 0}
    for r in sorted(sizes, key=lambda r: (r["h"], r[0])):
        if held[r["_label"]] + r["_size"]["n"] <= most_bytes // 2:
            held[r["_label"]] += r["_size"]["n"]
            chosen.append((r[0], r["_label"], tuple(r["_size"])))
    few = df.sparkSession.createDataFrame(chosen, f"{id_col} {df.schema[id_col].dataType.simpleString()}, _label int, _size struct<hash:bigint,n:int>")
    found = texts.withColumn("_size", F.struct(F.xxhash64("_text").alias("hash"), F.octet_length("_text").alias("n"))).join(F.broadcast(few), [id_col, "_size"])
    found = found.dropDuplicates([id_col, "_label"]).select(id_col, "_label", "_text").collect()
    return [(x, y) for _, y, x in sorted((r[0], r[1], bytes(r[2])) for r in found)], 0.5 if share is None else float(share)


def score_quality(df: DataFrame, net: ByteCnn, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds the probability that each whole text is good to df."""
    shared = df.sparkSession.sparkContext.broadcast((net.embedding, net.filters, net.bias, net.weights, net.offset))

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = ByteCnn(*shared.value)
        tables = own.tables()
        for texts in pieces(batches):
            yield pd.Series(own.score(texts.tolist(), tables))

    return df.withColumn(out_col, run(F.col(text_col).cast("binary")))
