"""Chat formatting by perspective rotation.

Every participant (each distinct role of a conversation that is not a context
role) gets the whole dialogue with its own turns as the assistant's, the others'
as those of users named after their role, context turns as the system's, and a
mask over the contents (with their end mark) of its own turns.

A dialogue is rendered in blocks of BLOCK turn numbers; a block's strings, joined
in the order of block, are the dialogue, so no task holds a long conversation.
Spans count characters from the block's start. DataFrame functions only.

"<|" in a text or a role is written "< |", so that no text forges a turn's marks.
A block is a range of turn numbers; rows of one turn number are in one block.
Other columns of the input are left out. Texts are rendered whole.

Within a turn number, rows are in the order of role and text. Exactly repeated
rows are rendered once. A null role is the participant "unknown", a null text is
empty, a null turn comes first (block null), a null conv_id is a conversation of
its own kind. A conversation of context turns only has no participants and gives
no rows; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed_once

BLOCK = 64
CONTEXT_ROLES = ("system",)
UNKNOWN = "unknown"
#: The parts of a rendered turn.
OPEN, NAME, BODY, CLOSE = "<|im_start|>", " name=", "\n", "<|im_end|>\n"


def header(role: Column, perspective: Column) -> Column:
    own = F.when(role.isin(*CONTEXT_ROLES), "system").when(role == perspective, "assistant").otherwise(F.concat(F.lit("user" + NAME), role))
    return F.concat(F.lit(OPEN), own, F.lit(BODY))


def escaped(text: Column) -> Column:
    """A mark that opens or closes a turn can't stand in a text or a name: its bar is moved off."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, perspective, block, n_turns, rendered, spans, n_masked): spans are the masked [start, end) of the rendered text."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), escaped(F.coalesce("role", F.lit(UNKNOWN))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    speakers = rows.where(~F.col("role").isin(*CONTEXT_ROLES)).select("conv_id", F.col("role").alias("perspective")).distinct()
    blocks = rows.groupBy("conv_id", F.floor(F.col("turn") / block).alias("block")).agg(F.sort_array(F.collect_set(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text"))).alias("turns"))
    # block numbers meet speakers first, without texts; the texts then come by conversation and block, so that a long conversation is dealt to many tasks
    numbers = rows.select("conv_id", F.floor(F.col("turn") / block).alias("block")).distinct()
    views = numbers.join(speakers, numbers["conv_id"].eqNullSafe(speakers["conv_id"])).select(numbers["conv_id"].alias("_conv"), F.col("block").alias("_block"), "perspective")
    both = blocks.join(views, blocks["conv_id"].eqNullSafe(F.col("_conv")) & blocks["block"].eqNullSafe(F.col("_block"))).drop("_conv", "_block")
    parts = F.transform("turns", lambda t: F.struct(header(t["role"], F.col("perspective")).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["role"] == F.col("perspective")).alias("own")))
    out = both.withColumn("_parts", computed_once(parts))
    rendered = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"])), "")
    # (characters so far, spans so far) over the parts
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        body = acc["at"] + F.length(p["head"])
        end = body + F.length(p["body"])
        spans = F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(body.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    out = out.withColumns({"rendered": rendered, "spans": F.aggregate("_parts", start, step)["spans"], "n_turns": F.size("turns").cast("long")})
    masked = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("conv_id", "perspective", "block", "n_turns", "rendered", "spans", masked.alias("n_masked"))


def oracle() -> str:
    """DuckDB SQL for the query over conversations."""
    return f"""
WITH rows_ AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, '{UNKNOWN}'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM rows_ WHERE role NOT IN ('system')),
parts AS (
  SELECT r.conv_id, s.perspective, CAST(floor(r.turn / {BLOCK}) AS BIGINT) AS block, r.turn, r.role, r.text,
    '{OPEN}' || CASE WHEN r.role = 'system' THEN 'system' WHEN r.role = s.perspective THEN 'assistant' ELSE 'user{NAME}' || r.role END || chr(10) AS head,
    r.text || '{CLOSE.strip()}' || chr(10) AS body, r.role = s.perspective AS own
  FROM rows_ r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS done FROM parts)
SELECT conv_id, perspective, block, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN CAST(done - length(body) AS BIGINT) || '-' || CAST(done AS BIGINT) END, ',' ORDER BY turn NULLS FIRST, role, text), '') AS spans,
  CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, perspective, block
"""
