"""Substring dedup: words inside a window that also starts earlier go, found by level-wise doubling.

A window of `window` words elects one of the `shortest`-word windows in it, that
of the smallest hash. Equal windows elect equal ones at the same place, so a
window can repeat only if the one it elects does. Elected windows that repeat
are extended to twice their length inside the window that elects them, those
that repeat again, up to the whole window, or until no candidates survive.

Each level is one scan and two shuffles: a task puts its candidates' hashes in
arrays by bucket, equal ones once, a bucket finds the places that survive, and
they are gathered by row. A key that a third of all rows have is therefore sent once a task.
Hashes of short levels have 64 bits, and let too much through at worst; whole
windows have 128, which stand for the words themselves.

Null and empty texts have no words. Null ids come before all others. Rows that
repeat an id count as one document at the same places: of equal windows the one
that starts first is kept, and those of the same start are all kept; rows that
repeat id and text are judged alike. Further columns are left out. A text is
held whole by the task that has it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, discard, written

#: Bytes of text that are hashed at a time, and that go to a bucket.
CHUNK, BUCKET_BYTES = 1 << 20, 1 << 25
#: Bytes whose powers are kept while words are hashed.
SEGMENT = 1 << 16
#: Candidates that a task gathers before it sends them.
GATHERED = 1 << 20
FIRST_ID = -(2**63)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
#: Odd multipliers of the two hashes: bytes in a word, words in a window.
_BASES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_ANSWER = pa.schema([("home", pa.int32()), ("rows", pa.binary()), ("sizes", pa.binary()), ("at", pa.binary())])
_MESSAGE = "bucket int, keys binary, at binary, docs binary, rows binary, sizes binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each word of texts that lie side by side, and the number of its text."""
    solid = ~_IS_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before[cuts], after[cuts - 1] = False, False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each word: the value at base of the polynomial of its bytes, mixed with its length."""
    out, at = np.empty(len(starts), np.uint64), 0
    powers = _powers(base, SEGMENT)
    inverse = _powers(pow(base, -1, 2**64), SEGMENT)
    while at < len(starts):
        stop = max(int(np.searchsorted(ends, starts[at] + SEGMENT, "right")), at + 1)
        lo, hi = int(starts[at]), int(ends[stop - 1])
        if hi - lo > len(powers):
            powers = _powers(base, hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * powers[: hi - lo], out=sums[1:])
        first = starts[at:stop] - lo
        out[at:stop] = (sums[ends[at:stop] - lo] - sums[first]) * inverse[first]
        at = stop
    return _mixed(out + (ends - starts).astype(np.uint64) * np.uint64(base))


def window_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of each window of so many words, made of those of half the length."""
    def rolled(n: int) -> np.ndarray:
        if n == 1:
            return words
        half = rolled(n // 2)
        out = half[: len(half) - n // 2] * np.uint64(pow(base, n // 2, 2**64)) + half[n // 2 :]
        return out if n % 2 == 0 else out[:-1] * np.uint64(base) + words[n - 1 :]

    return _mixed(rolled(length)) if len(words) >= length else np.zeros(0, np.uint64)


def elected(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each place, that of the smallest of the span hashes from it on, the first of equal ones."""
    best, width = np.arange(len(hashes)), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best, width = np.where(hashes[b] < hashes[a], b, a), width + step
    return best


def lengths_of(window: int, shortest: int) -> list[int]:
    """The lengths of the levels: the window, halved while it is even and stays at shortest words or more."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= shortest:
        out.insert(0, out[0] // 2)
    return out


def candidates(data: np.ndarray, bounds: np.ndarray, survivors: list[np.ndarray] | None, lengths: list[int], level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place in it, keys) of the windows to look at on a level; survivors: the places of each text that the level before left."""
    starts, ends, text = word_spans(data, bounds)
    window, base, length = lengths[-1], lengths[0], lengths[level]
    n = len(starts) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros((0, 1 + (length == window)), np.uint64)
    words = word_hashes(data, starts, ends, _BASES[0][0])
    whole = np.flatnonzero(text[:n] == text[window - 1 :])
    choice = elected(window_hashes(words, base, _BASES[0][1]), window - base + 1)[whole]
    first_word = np.searchsorted(text, np.arange(len(bounds) - 1))
    if survivors is not None:
        left = np.zeros(len(starts), bool)
        for i, places in enumerate(survivors):
            left[first_word[i] + places] = True
        kept = left[np.minimum(choice, whole + window - lengths[level - 1])]
        whole, choice = whole[kept], choice[kept]
    marked = np.zeros(len(starts), bool)
    marked[np.minimum(choice, whole + window - length)] = True
    at = np.flatnonzero(marked)
    keys = [window_hashes(words, length, _BASES[0][1])[at]]
    if length == window:
        keys.append(window_hashes(word_hashes(data, starts, ends, _BASES[1][0]), length, _BASES[1][1])[at])
    return text[at], at - first_word[text[at]], np.stack(keys, 1)


def _pack(bucket: int, keys: np.ndarray, at: np.ndarray, docs: np.ndarray, rows: np.ndarray) -> dict:
    """A message: places grouped by row."""
    order = np.lexsort((at, rows))
    rows, docs = rows[order], docs[order] if len(docs) else docs
    new = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    sizes = np.diff(np.append(new, len(rows)))
    return {"bucket": bucket, "keys": keys[order].tobytes() if len(keys) else b"", "at": at[order].astype(np.int32).tobytes(), "docs": docs[new].tobytes() if len(docs) else b"", "rows": rows[new].tobytes(), "sizes": sizes.astype(np.int32).tobytes()}


def _runs(keys: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys and then the others, and the number of each place's key in it."""
    order = np.lexsort((*then[::-1], *keys.T))
    k = keys[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]).any(1)]) if len(k) else np.zeros(0, bool)
    return order, np.cumsum(new) - 1


def _judged(keys: np.ndarray, docs: np.ndarray, at: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(found, representative) of places: on the last level found are those after the first of their key, else all of a repeated key."""
    order, run = _runs(keys, docs, at)
    found, first = np.zeros(len(at), bool), np.zeros(len(at), bool)
    heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    first[order[heads]] = True
    head = order[heads[run]] if len(run) else order
    found[order] = ((docs[order] != docs[head]) | (at[order] != at[head])) if last else np.bincount(run)[run] > 1
    return found, first


def _sent(buckets: int, last: bool, keys: np.ndarray, docs: np.ndarray, rows: np.ndarray, at: np.ndarray) -> Iterator[dict]:
    """What a task sends: for each bucket a place of each key, and for what is known already messages without keys.

    Of a key that a task has twice one place is sent, on the lower levels with
    the negative of its place, as one that is known to survive.
    """
    found, first = _judged(keys, docs, at, last)
    for i in range(0, int(found.sum()), GATHERED // 4):
        known = np.flatnonzero(found)[i : i + GATHERED // 4]
        yield _pack(int(rows[known[0]] % buckets), keys[:0], at[known], docs[known], rows[known])
    place = np.where(found, -1 - at, at) if not last else at
    home = (keys[:, 0] % np.uint64(buckets)).astype(np.int64)
    chosen = np.flatnonzero(first)
    chosen = chosen[np.argsort(home[chosen], kind="stable")]
    cuts = np.flatnonzero(np.concatenate([[True], home[chosen][1:] != home[chosen][:-1]])) if len(chosen) else []
    for part in np.split(chosen, cuts[1:]) if len(chosen) else []:
        yield _pack(int(home[part[0]]), keys[part], place[part], docs[part], rows[part])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Batches in pieces of about CHUNK bytes: the bytes of their texts, the bounds of each, and the piece."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")], np.int64)
        piece = np.cumsum(sizes) // CHUNK
        for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(piece)) + 1) if len(sizes) else []:
            own = batch.slice(int(part[0]), len(part))
            data = np.frombuffer(b"".join(x.as_buffer() for x in own.column("text") if x.is_valid), np.uint8)
            yield data, np.concatenate([[0], np.cumsum(sizes[part])]), own


def _by_home(rows: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple[int, dict]]:
    """Places packed for each bucket of rows."""
    home = rows % buckets
    order = np.argsort(home, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
        yield int(home[part[0]]), _pack(0, rows[:0], at[part], rows[:0], rows[part])


def _level(docs: DataFrame, lengths: list[int], level: int, buckets: int) -> DataFrame:
    """row, left (packed places): survivors of a level, on the last one the windows that start earlier too. docs: row, doc, text and, from the second level on, left."""
    last = level == len(lengths) - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, count = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for x in _sent(buckets, last, *(np.concatenate(p) for p in zip(*gathered, strict=True))):
                yield pa.RecordBatch.from_pylist([x], schema=pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("keys", "at", "docs", "rows", "sizes")]))

        for data, bounds, own in _texts(batches):
            left = None if level == 0 else [np.frombuffer(x, np.int32) for x in own.column("left").to_pylist()]
            text, at, keys = candidates(data, bounds, left, lengths, level)
            if len(at):
                ids, rows = (own.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
                gathered.append((keys, ids[text], rows[text], at))
                count += len(at)
            if count >= GATHERED:
                yield from flush()
                gathered, count = [], 0
        if count:
            yield from flush()

    def answer(messages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, taken = [], []
        for x in (x for batch in messages for x in batch.to_pylist()):
            at, sizes = np.frombuffer(x["at"], np.int32).astype(np.int64), np.frombuffer(x["sizes"], np.int32)
            rows, ids = (np.repeat(np.frombuffer(x[c], np.int64), sizes) for c in ("rows", "docs"))
            if x["keys"]:
                taken.append((np.frombuffer(x["keys"], np.uint64).reshape(len(at), -1), ids, rows, at))
            else:
                out.append((rows, at))
        if taken:
            keys, ids, rows, at = (np.concatenate(p) for p in zip(*taken, strict=True))
            found, _ = _judged(keys, ids, at, last)
            if not last:
                order, run = _runs(keys)
                known = np.zeros(len(at), bool)
                known[order] = np.bincount(run, at[order] < 0)[run] > 0
                found = (found | known) & (at >= 0)
            out.append((rows[found], at[found]))
        if out:
            rows, at = (np.concatenate(p) for p in zip(*out, strict=True))
            yield pa.RecordBatch.from_pylist([{"home": home} | {k: m[k] for k in ("rows", "sizes", "at")} for home, m in _by_home(rows, at, buckets)], schema=_ANSWER)

    def collect(answers: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at = [], []
        for x in (x for batch in answers for x in batch.to_pylist()):
            rows.append(np.repeat(np.frombuffer(x["rows"], np.int64), np.frombuffer(x["sizes"], np.int32)))
            at.append(np.frombuffer(x["at"], np.int32))
        rows, at = np.concatenate(rows), np.concatenate(at)
        order = np.argsort(rows, kind="stable")
        rows, at = rows[order], at[order]
        cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(rows[cuts]), pa.array([p.tobytes() for p in np.split(at, cuts[1:])], pa.binary())], names=["row", "left"])

    columns = ["row", "doc", "text"] + ["left"] * (level > 0)
    answers = docs.select(*columns).mapInArrow(send, _MESSAGE).groupBy("bucket").applyInArrow(answer, "home int, rows binary, sizes binary, at binary")
    return answers.groupBy("home").applyInArrow(collect, "row long, left binary")


def repeats(docs: DataFrame, window: int = 20, shortest: int = 5) -> DataFrame:
    """row, left (packed places): the windows of each row that start earlier too, a written table. docs: row, doc, text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(math.ceil(size / BUCKET_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lengths, found = lengths_of(window, shortest), None
    for level in range(len(lengths)):
        before = found
        found = written(_level(docs if before is None else docs.join(before, "row"), lengths, level, buckets), "repeats")
        if before is not None:
            discard(before)
        if found.isEmpty():
            break
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, shortest: int = 5) -> DataFrame:
    """id_col, n_words, n_removed (long) and kept (the words left, joined by one space) of every row."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    docs = docs.withColumns({"doc": F.coalesce(F.col("id").cast("long"), F.lit(FIRST_ID)), "row": F.xxhash64("id", "text")})
    found = repeats(docs.select("row", "doc", "text"), window, shortest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, own in _texts(batches):
            ids, n_words, removed, kept = own.column("id"), [], [], []
            for text, left in zip(own.column("text"), own.column("left").to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                gone = 0
                if left:
                    at = np.frombuffer(left, np.int32)
                    change = np.zeros(len(words) + 1, np.int32)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    stays = np.cumsum(change[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    n_words.append(len(words))
                    words = list(compress(words, stays))
                else:
                    n_words.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    kind = dict(docs.dtypes)["id"]
    out = docs.select("row", "id", "text").join(found, "row", "left").mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def oracle(window: int = 20) -> str:
    """DuckDB SQL for the query over documents, on windows as strings."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, unnest(range(1, len(w) - {window} + 2)) AS pos, w FROM d),
k AS (SELECT r, coalesce(doc_id, {FIRST_ID}) AS doc, pos, array_to_string(w[pos:pos + {window - 1}], ' ') AS win FROM p),
f AS (SELECT win, min(struct_pack(d := doc, a := pos)) AS first FROM k GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(pos, pos + {window})) AS pos FROM k JOIN f USING (win) WHERE struct_pack(d := doc, a := pos) > first),
u AS (SELECT r, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
s AS (SELECT u.r, count(*) AS n, string_agg(word, ' ' ORDER BY u.pos) AS kept FROM u LEFT JOIN gone ON gone.r = u.r AND gone.pos = u.pos WHERE gone.pos IS NULL GROUP BY u.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r)
"""
