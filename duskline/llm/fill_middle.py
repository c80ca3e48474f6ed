"""Fill-in-middle transformation, with token borders found in big integers.

A text's bytes are translated to a mask of a bit a byte, which holds the bytes
other than white space. A shift and an AND mark the last byte of each run, which
ends a token; what white space is left at the end is a token of its own. bit_count
gives their number, and the place of the token of a rank is found by halving the
mask, whose lower half's count tells where to go on. Bytes that begin a code
point are masked in the same way, which counts code points.

A null text is empty. A null id is drawn for like an empty one. Empty texts,
and those that hold a marker, stay plain. Rows that repeat are cut alike; further
columns are carried along, those named like a result replaced by it. Each text is
held whole by the task that has it, with masks of an eighth of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, SPACES

MARKERS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SOLID = bytes(48 if chr(b) in SPACES else 49 for b in range(256))
#: Bytes that begin a code point: all but 10xxxxxx.
_BEGINS = bytes(48 if b & 0xC0 == 0x80 else 49 for b in range(256))
_CUT = T.StructType([T.StructField(name, kind) for name, kind in (("n", T.LongType()), ("prefix", T.StringType()), ("middle", T.StringType()), ("suffix", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()))])


def mask_of(data: bytes, table: bytes) -> int:
    """An integer whose bit i tells the class of byte i."""
    return int(data[::-1].translate(table), 2) if data else 0


def token_ends(data: bytes) -> int:
    """A mask of the last bytes of tokens."""
    solid = mask_of(data, _SOLID)
    ends = solid & ~(solid >> 1)
    if data and not solid >> (len(data) - 1):
        ends |= 1 << (len(data) - 1)
    return ends


def ranked_bit(mask: int, rank: int) -> int:
    """The place of the rank-th bit that is set, from 1."""
    at, width = 0, mask.bit_length()
    while width > 1:
        half = width // 2
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank <= below:
            mask, width = low, half
        else:
            mask, rank, at, width = mask >> half, rank - below, at + half, width - half
    return at


def cut(text: str, first: int, second: int) -> tuple[int, str, str, str, int, int]:
    """The number n of tokens; the texts before, between and after two borders, drawn from first and second mod n + 1; code points of the first two."""
    data = text.encode()
    ends = token_ends(data)
    n = ends.bit_count()
    lower, upper = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ranked_bit(ends, r) + 1 if r else 0 for r in (lower, upper))
    begins = mask_of(data, _BEGINS)
    chars = (begins & ((1 << a) - 1)).bit_count(), ((begins >> a) & ((1 << (b - a)) - 1)).bit_count()
    return n, data[:a].decode(), data[a:b].decode(), data[b:].decode(), *chars


@F.pandas_udf(_CUT)
def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for columns in batches:
        for at in range(0, len(columns[0]), BATCH_ROWS):
            rows = [cut(*x) for x in zip(*(c.iloc[at : at + BATCH_ROWS] for c in columns), strict=True)]
            yield pd.DataFrame(dict(zip(_CUT.names, zip(*rows, strict=True), strict=True)))


def draws(id_column: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 for an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_percent: int = 50, spm_percent: int = 80, seed: int = 42) -> DataFrame:
    """Adds n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output to df."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = draws(F.col(id_col), seed)
    holds = F.contains(text, F.lit(MARKERS[0])) | F.contains(text, F.lit(MARKERS[1])) | F.contains(text, F.lit(MARKERS[2]))
    form = F.when((text == "") | holds | (h[2] % 100 >= fim_percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    made = df.withColumn("_fim", F.struct(text.alias("text"), form.alias("form"))).withColumn("_cut", _cuts(text, h[0], h[1]))
    form, part = F.col("_fim.form"), lambda name: F.col("_cut")[name]
    psm = F.concat(F.lit(PREFIX), part("prefix"), F.lit(SUFFIX), part("suffix"), F.lit(MIDDLE), part("middle"))
    spm = F.concat(F.lit(SUFFIX), part("suffix"), F.lit(PREFIX), part("prefix"), F.lit(MIDDLE), part("middle"))
    chars = lambda name: F.when(form != "plain", part(name))
    results = {"n": part("n"), "form": form, "prefix_chars": chars("prefix_chars"), "middle_chars": chars("middle_chars"), "output": F.when(form == "plain", F.col("_fim.text")).when(form == "psm", psm).otherwise(spm)}
    return made.withColumns(results).drop("_fim", "_cut")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No marker is in a text, and none can arise where texts meet, so each is found where it was put."""
    before, after = (lambda x, m: F.substring_index(x, m, 1)), (lambda x, m: F.substring_index(x, m, -1))
    psm = F.concat(after(before(output, SUFFIX), PREFIX), after(output, MIDDLE), after(before(output, MIDDLE), SUFFIX))
    spm = F.concat(after(before(output, MIDDLE), PREFIX), after(output, MIDDLE), after(before(output, PREFIX), SUFFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def oracle(fim_percent: int = 50, spm_percent: int = 80, seed: int = 42) -> str:
    """DuckDB SQL for the query over documents, with tokens as a list."""
    h = ", ".join(f"CAST('0x' || substr(digest, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    holds = " OR ".join(f"contains(text, '{m}')" for m in MARKERS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tokens, {h} FROM d),
n AS (SELECT *, len(tokens) AS n, CASE WHEN text = '' OR {holds} OR h3 % 100 >= {fim_percent} THEN 'plain' WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM t),
b AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM n),
c AS (SELECT *, coalesce(array_to_string(tokens[1:lo], ''), '') AS pre, coalesce(array_to_string(tokens[lo + 1:hi], ''), '') AS mid, coalesce(array_to_string(tokens[hi + 1:], ''), '') AS suf FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
