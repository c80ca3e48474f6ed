"""Toxicity by a subsequence-kernel support vector machine on Nyström landmarks.

The kernel compares words by their subsequences of three letters, each weighted
by DECAY to the power of the span it covers, spans up to SPAN, so that inserted
characters and gaps weaken a likeness but don't end it; it is normalised for
length. A landmark sample of words spans the Nyström space, a linear SVM with
squared hinge loss is fitted there, and its decision function is folded into
one weight for each subsequence, which gives the same value as the landmarks.

Labels are of documents, so words are learnt as in multiple-instance learning:
a toxic document's TOP most toxic words are its witnesses, a clean document's
most toxic one is a counterexample, and the fit is repeated. A document's
evidence is its highest score and the mean of the next ones; a logistic curve
over it, fitted to the scores of FOLDS machines that had not seen the document,
gives the probability. Runs of single-letter words count as a word too. Letters
beyond a-z share codes; digits and signs are dropped, and so are gaps.

The fit is to at most TRAIN_DOCUMENTS labelled documents, a third of them toxic if
there are as many, those with the smallest hash of the id, each in whole; the
driver gets their distinct units, not their texts. Scoring reads every whole
text, a batch of rows at a time. Null and empty texts have no words and the
score of no evidence; without toxic or clean examples every score is 0. Labels
of a null id, and null labels, are left out; a null id is scored like any other.
Repeated rows get equal scores; a column of the output's name is replaced. An
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

TRAIN_DOCUMENTS = 4500
FOLDS, FOLD_EXAMPLES = 3, 10
LANDMARKS = 240
NEGATIVES = 8000
DECAY, SPAN = 0.6, 7
#: Letters of a unit, with its two end marks; longer words are cut into overlapping units.
UNIT = 18
ALPHABET = 48
REFITS = 5
#: Highest scores of a document that count, and what a score counts for at least.
TOP, FLOOR = 5, 0.0
KNOTS = (-1.0, 0.0, 0.5, 0.9, 1.5)
#: Toxic documents that hold a unit before it is a first witness beside the best one.
WITNESSES = 3
MIN_LIFT = 3.0
MARGIN_COST = 4.0
LOWEST = -8.0
#: Units worked on at a time.
SLICE = 1 << 14
#: Bytes of remembered words, of which each takes some more than its letters.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 300
_RUNS = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")


class LetterCodes(dict):
    """For str.translate: the code of each character, as a character; None drops what is no letter."""

    def __missing__(self, point: int) -> str | None:
        c = chr(point).lower()[0]
        code = 3 + ord(c) - 97 if "a" <= c <= "z" else 29 + ord(c) % (ALPHABET - 29) if c.isalpha() else None
        self[point] = out = None if code is None else chr(code)
        return out


_CODES = LetterCodes()


def units(word: str) -> list[bytes]:
    """The letter codes of a word between end marks (1 and 2), cut into units; none if it has no letters."""
    codes = word.translate(_CODES).encode("latin-1")
    if not codes:
        return []
    whole = b"\x01" + codes + b"\x02"
    if len(whole) <= UNIT:
        return [whole]
    step = UNIT // 2
    return [whole[i : i + UNIT] for i in range(0, len(whole) - step, step)]


def words_in(text: str | None) -> set[str]:
    text = (text or "").lower()
    found = set(text.split())
    if " " in text:
        found.update("".join(x.split()) for x in _RUNS.findall(text))
    return found


def units_in(text: str | None) -> list[bytes]:
    """The distinct units of a whole text."""
    return sorted({u for w in words_in(text) for u in units(w)})


def packed(text: str | None) -> bytes:
    """units_in as one string; no code is zero."""
    return b"\0".join(units_in(text))


def triples(block: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For units of one length (rows): the index of each subsequence, and its weight."""
    n = block.shape[1]
    wide = np.ascontiguousarray(block.T, np.intp)
    first, second = wide * (ALPHABET * ALPHABET), wide * ALPHABET
    for i in range(n):
        for k in range(i + 2, min(n, i + SPAN)):
            weight = DECAY ** (k - i + 1)
            ends = first[i] + wide[k]
            for j in range(i + 1, k):
                yield ends + second[j], weight


def norm(n: int) -> float:
    return math.sqrt(sum((k - i - 1) * DECAY ** (2 * (k - i + 1)) for i in range(n) for k in range(i + 2, min(n, i + SPAN)))) or 1.0


def by_length(rows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the units of each length, SLICE at most at a time."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    for at in (every[i : i + SLICE] for n in np.unique(sizes) for every in (np.flatnonzero(sizes == n),) for i in range(0, len(every), SLICE)):
        n = len(rows[at[0]])
        yield at, np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), n)


def decision(rows: list[bytes], weights: np.ndarray, offset: float = 0.0) -> np.ndarray:
    """The kernel machine's value of each unit, from the folded weights."""
    out = np.zeros(len(rows))
    for at, block in by_length(rows):
        total = np.zeros(len(at), np.float32)
        for index, weight in triples(block):
            total += weights.take(index) * np.float32(weight)
        out[at] = total / norm(block.shape[1]) + offset
    return out


def _features(rows: list[bytes], columns: np.ndarray) -> np.ndarray:
    """Normalised subsequence weights of units, in the given columns only."""
    out = np.zeros((len(rows), len(columns) + 1), np.float32)
    place = np.full(ALPHABET**3, len(columns), np.int64)
    place[columns] = np.arange(len(columns))
    for at, block in by_length(rows):
        scale = norm(block.shape[1])
        for index, weight in triples(block):
            out[at, place[index]] += np.float32(weight / scale)
    return out[:, :-1]


def kernel_machine(rows: list[bytes], y: np.ndarray, times: np.ndarray, landmarks: list[bytes]) -> tuple[np.ndarray, float]:
    """Folded weights and offset of an SVM (squared hinge, classes of equal weight) on the landmarks' Nyström features. y: 1 or -1; times: how often each row counts."""
    seen = np.zeros(ALPHABET**3, bool)
    for _, block in by_length(landmarks):
        for index, _ in triples(block):
            seen[index] = True
    columns = np.flatnonzero(seen)
    marks = _features(landmarks, columns)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.concatenate([_features(rows[i : i + 400], columns) @ marks.T for i in range(0, len(rows), 400)]) @ root
    z = np.column_stack([z, np.ones(len(z))])
    cost = MARGIN_COST * len(y) * times * np.where(y > 0, 0.5 / max(times[y > 0].sum(), 1), 0.5 / max(times[y < 0].sum(), 1))
    w, active = np.zeros(z.shape[1]), np.ones(len(y), bool)
    for _ in range(25):
        za = z[active] * cost[active, None]
        w = np.linalg.solve(z[active].T @ za + np.eye(z.shape[1]), za.T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    weights = np.zeros(ALPHABET**3, np.float32)
    weights[columns] = marks.T @ (root @ w[:-1])
    return weights, float(w[-1])


class Documents:
    """Labelled documents as lists of unit numbers."""

    def __init__(self, rows: Iterable[tuple[bytes, int]]):
        number: dict[bytes, int] = {}
        self.y, self.holds = [], []
        for found, label in rows:
            own = [number.setdefault(u, len(number)) for u in found.split(b"\0") if u]
            self.holds.append(np.fromiter(own, np.int64, len(own)))
            self.y.append(int(label))
        self.units, self.y = list(number), np.array(self.y)

    def top(self, scores: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's TOP highest scores, falling, and the units that have them (LOWEST and -1 where there are fewer)."""
        value, unit = np.full((len(docs), TOP), LOWEST), np.full((len(docs), TOP), -1, np.int64)
        for row, h in enumerate(self.holds[d] for d in docs):
            best = h[np.argsort(-scores[h], kind="stable")[:TOP]]
            value[row, : len(best)], unit[row, : len(best)] = scores[best], best
        return value, unit

    def fit(self, docs: np.ndarray) -> tuple[np.ndarray, float]:
        toxic, clean = docs[self.y[docs] == 1], docs[self.y[docs] == 0]
        bad, good = Counter(), Counter()
        for d in toxic:
            bad.update(self.holds[d].tolist())
        for d in clean:
            good.update(self.holds[d].tolist())
        # only a unit that toxic documents hold more often than clean ones can be a witness
        lift = {u: ((n + 0.1) / len(toxic)) / ((good[u] + 0.5) / len(clean)) for u, n in bad.items()}
        worth = {u: bad[u] * math.log(x) for u, x in lift.items() if x > MIN_LIFT}
        allowed = np.zeros(len(self.units), bool)
        allowed[list(worth)] = True
        positive: Counter = Counter()
        for d in toxic:
            first = sorted((u for u in self.holds[d].tolist() if u in worth), key=lambda u: (-worth[u], u))[:TOP]
            positive.update(u for i, u in enumerate(first) if not i or bad[u] >= WITNESSES)
        rng = np.random.default_rng(7)
        pool = np.array(sorted(good), np.int64)
        negative = set(rng.choice(pool, min(NEGATIVES, len(pool)), replace=False).tolist())
        best, most = (np.zeros(ALPHABET**3, np.float32), 0.0), -1.0
        for _ in range(REFITS):
            pos = [u for u in sorted(positive) if u not in negative]
            if not pos:
                break
            neg = sorted(negative)
            marks = [*sorted(pos, key=lambda u: (-positive[u], u))[: LANDMARKS * 2 // 3], *rng.permutation(neg)[: LANDMARKS // 3]]
            rows = [self.units[u] for u in [*pos, *neg]]
            times = np.array([positive[u] for u in pos] + [1] * len(neg), float)
            machine = kernel_machine(rows, np.array([1] * len(pos) + [-1] * len(neg)), times, [self.units[u] for u in marks])
            scores = decision(self.units, *machine)
            bad_top, (good_top, good_units) = self.top(scores, toxic)[0], self.top(scores, clean)
            # the share of pairs of a toxic and a clean document that are in order
            right = np.searchsorted(np.sort(summed(good_top)), summed(bad_top)).mean() / len(clean)
            if right >= most:
                best, most = machine, right
            value, unit = self.top(np.where(allowed, scores, LOWEST), toxic)
            positive = Counter([*unit[:, 0][value[:, 0] > LOWEST].tolist(), *unit[:, 1:][value[:, 1:] > 0].tolist()])
            negative |= {u for u in good_units[:, 0].tolist() if u >= 0}
        return best


def summed(top: np.ndarray) -> np.ndarray:
    return np.maximum(top, FLOOR).sum(1)


def evidence(top: np.ndarray) -> np.ndarray:
    """What the curve is fitted to: the highest score, in pieces between KNOTS, and the sum of the next scores within FLOOR and 1."""
    first = np.column_stack([np.clip(top[:, 0], lo, hi) - lo for lo, hi in zip(KNOTS, KNOTS[1:], strict=False)])
    return np.column_stack([first, np.clip(top[:, 1:], FLOOR, 1.0).sum(1)])


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes (none negative) and offset of a logistic curve, by damped Newton steps with a ridge, over standardised values."""
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    free = np.ones(x.shape[1], bool)
    while True:
        z, w = np.column_stack([(x - mean)[:, free] / scale[free], np.ones(len(x))]), np.zeros(int(free.sum()) + 1)
        ridge = np.diag([0.1] * int(free.sum()) + [1e-3])

        def loss(w: np.ndarray, z=z, ridge=ridge) -> float:
            return float(np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + 0.5 * w @ ridge @ w)

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
            if np.abs(step).max() < 1e-7:
                break
        slopes = np.zeros(x.shape[1])
        slopes[free] = w[:-1] / scale[free]
        if (slopes >= 0).all():
            return np.append(slopes, w[-1] - slopes @ mean)
        free &= slopes >= 0


class ToxicityModel:
    def __init__(self, weights: np.ndarray | None, offset: float = 0.0, curve: np.ndarray = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)):
        """weights: of the subsequences; curve: slopes and offset over evidence()."""
        self.weights, self.offset, self.curve = weights, offset, np.asarray(curve, float)

    @classmethod
    def fit(cls, rows: Iterable[tuple[bytes, int]]) -> ToxicityModel:
        """rows: (the packed units of a text, label)."""
        docs = Documents(rows)
        if len(set(docs.y.tolist())) < 2 or not docs.units:
            return cls(None)
        order = np.argsort(docs.y, kind="stable")
        machine = docs.fit(order)
        if min(docs.y.sum(), (1 - docs.y).sum()) < FOLD_EXAMPLES * FOLDS:
            # machines without a fold would know too few words to be compared with the whole one
            return cls(*machine, calibrated(evidence(docs.top(decision(docs.units, *machine), order)[0]), docs.y[order]))
        own = [order[i::FOLDS] for i in range(FOLDS)]
        outside = [evidence(docs.top(decision(docs.units, *docs.fit(np.setdiff1d(order, part))), part)[0]) for part in own]
        return cls(*machine, calibrated(np.concatenate(outside), docs.y[np.concatenate(own)]))

    def scorer(self):
        """Scores texts; remembers words within its lifetime, and forgets all of them beyond CACHE_BYTES."""
        known: dict[str, tuple[int, ...]] = {}
        number: dict[bytes, int] = {}
        values: list[float] = []
        held = 0

        def learn(words: list[str]) -> None:
            nonlocal held
            cut = [units(w) for w in words]
            new = list({u for us in cut for u in us}.difference(number))
            number.update(zip(new, range(len(values), len(values) + len(new)), strict=True))
            values.extend(decision(new, self.weights, self.offset).tolist())
            for w, us in zip(words, cut, strict=True):
                known[w] = tuple(sorted({number[u] for u in us}, key=lambda n: -values[n])[:TOP])
                held += len(w) + ENTRY_BYTES

        def score(texts: list[str | None]) -> np.ndarray:
            nonlocal held
            if self.weights is None:
                return np.zeros(len(texts))
            if held > CACHE_BYTES:
                known.clear()
                number.clear()
                values.clear()
                held = 0
            out = np.full((len(texts), TOP), LOWEST)
            words = [words_in(t) for t in texts]
            if new := list(set().union(*words).difference(known)):
                learn(new)
            for row, own in enumerate(words):
                best = heapq.nlargest(TOP, map(values.__getitem__, {n for w in own for n in known[w]}))
                out[row, : len(best)] = best
            return 1 / (1 + np.exp(-np.clip(evidence(out) @ self.curve[:-1] + self.curve[-1], -30, 30)))

        return score


def training_rows(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_DOCUMENTS) -> list[tuple[bytes, int]]:
    """(packed units, label) of the bounded sample of labelled documents; whole texts become units on the executors. An id that is labelled twice is an example of each label, one whose rows repeat an example with the least of their units."""
    ids = labels.select(id_col, F.col(label_col).cast("int").alias("_label")).where(F.col(id_col).isNotNull() & F.col("_label").isNotNull()).distinct()
    order = F.xxhash64(id_col), F.col(id_col)
    ids = ids.where("_label = 1").orderBy(*order).limit(most // 3).unionByName(ids.where("_label = 0").orderBy(*order).limit(most - most // 3))

    @F.pandas_udf(T.BinaryType())
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in pieces(batches):
            yield pd.Series([packed(t) for t in texts], dtype=object)

    rows = df.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(ids), id_col).select(id_col, "_label", cut("_text").alias("_units"))
    one = rows.groupBy(id_col, "_label").agg(F.min("_units").alias("_units"))
    found = {(r[0], r[1], bytes(r[2])) for r in one.toLocalIterator()}
    return [(us, y) for _, y, us in sorted(found)]


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds the toxicity of each whole text (0 to 1) to df."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.offset, model.curve))

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = ToxicityModel(*shared.value).scorer()
        for texts in pieces(batches):
            yield pd.Series(score(texts.tolist()))

    return df.withColumn(out_col, run(F.col(text_col)))
