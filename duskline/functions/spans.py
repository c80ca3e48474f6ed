"""Spans of text as array columns: where a pattern matches, and what stands before and after.

A span is struct<start, text>: characters before it, and the text matched. Patterns are
columns, so that one expression serves a whole list of them. Words end as ASCII
letters, digits and underscores do: `word` writes \\b so, whatever the alphabets
beside it. Everything stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before the first and after the last letter of a word: \w is ASCII, and in any case one look at a table, which [A-Za-z0-9_] is not.
_OPENS, _ENDS = r"(?<!\w)", r"(?!\w)"
NO_TEXTS = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: what a lambda refers to is otherwise worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word(pattern: str, any_case: bool = True) -> str:
    """A pattern for Spark, with ASCII word edges for \\b: one that begins an alternative opens a word, others end one."""
    opened = re.sub(r"(^|[(|]|\(\?:)\\b", lambda m: m[1] + _OPENS, pattern)
    return ("(?iu)" if any_case else "") + opened.replace(r"\b", _ENDS)


def parted(text: Column, pattern: str) -> Column:
    """split(text, pattern, -1) for a pattern that matches no empty text: Spark compiles split's pattern for each row, regexp_replace's once."""
    return let(text, lambda t: F.when(F.contains(t, F.lit("\x01")), F.split(t, pattern, -1)).otherwise(F.split(F.regexp_replace(t, pattern, "\x01"), "\x01", -1)))


def patterns(sources: list[str]) -> Column:
    return F.array(*[F.lit(word(p)) for p in sources])


def any_of(sources: list[str]) -> str:
    """A pattern for any of the sources; the edge that most of them begin with is looked at once."""
    edged = [p[2:] for p in sources if p.startswith(r"\b")]
    others = [word(p, any_case=False) for p in sources if not p.startswith(r"\b")]
    first = [_OPENS + "(?:" + "|".join(f"(?:{word(p, any_case=False)})" for p in edged) + ")"] if edged else []
    return "(?iu)" + "|".join([*first, *(f"(?:{p})" for p in others)])


def spans(text: Column, pattern: Column) -> Column:
    """All matches of a pattern, by place: the text between them and they themselves, measured."""
    length = lambda texts: F.aggregate(texts, F.lit(0), lambda n, x: n + F.length(x))
    place = lambda v, i: length(F.slice(v["between"], 1, i + 1)) + length(F.slice(v["found"], 1, i))
    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"))
    return let(both, lambda v: F.transform(v["found"], lambda m, i: F.struct(place(v, i).alias("start"), m.alias("text"))))


def before(text: Column, span: Column, most: int | None = None) -> Column:
    """What stands before a span, at most so many characters of it."""
    start = span["start"]
    if most is None:
        return F.substr(text, F.lit(1), start)
    return F.substr(text, F.greatest(start - most, F.lit(0)) + 1, F.least(start, F.lit(most)))


def after(text: Column, span: Column, most: int) -> Column:
    return F.substr(text, span["start"] + F.length(span["text"]) + 1, F.lit(most))


def sentence_before(text: Column, span: Column) -> Column:
    """What stands before a span in its sentence."""
    # read backwards from the span: a search for the end of the text would try every place before it
    return F.reverse(F.regexp_extract(F.reverse(before(text, span)), r"^[^.!?:\n]*", 0))


def amid_sentence(text: Column, span: Column) -> Column:
    """Whether a capital letter begins a span that doesn't begin a sentence: most likely part of a name."""
    first = F.substring(span["text"], 1, 1)
    last = F.regexp_extract(F.reverse(before(text, span)), r"^\s*(\S)", 1)
    return (first != F.lower(first)) & (last != "") & ~last.isin(".", "!", "?", ":")


def masked(text: Column, names: Column, least: int = 3) -> Column:
    """text with each of the names (of that many characters or more) replaced by a space, in any case."""
    known = F.filter(F.coalesce(names, F.array().cast(NO_TEXTS)), lambda n: F.length(F.trim(n)) >= least)
    quoted = lambda n: F.concat(F.lit(r"(?iu)\Q"), F.replace(F.trim(n), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.aggregate(known, F.coalesce(text, F.lit("")), lambda t, n: F.regexp_replace(t, quoted(n), F.lit(" ")))


def kept(text: Column, pattern: Column, *dropped: Callable[[Column, Column], Column]) -> Column:
    """The spans of a pattern that no rule drops; a rule takes (text, span)."""
    def stays(span: Column) -> Column:
        return ~reduce(or_, [rule(text, span) for rule in dropped], F.lit(False))

    return F.filter(spans(text, pattern), stays)


def claims(text: Column, ordered: list[tuple[str, str]]) -> Column:
    """array<struct<start, name>> of all matches of (pattern, name) pairs that don't overlap one of an earlier pair, by place.

    What a pattern claims is blanked for the later ones, character for character.
    """
    table = F.array(*[F.struct(F.lit(f"(?iu){p}").alias("pattern"), F.lit(n).alias("name")) for p, n in ordered])
    none = F.array().cast("array<struct<start:int,name:string>>")

    def claim(acc: Column, p: Column) -> Column:
        blank = lambda v: F.concat(F.array_join(F.zip_with(F.slice(v["between"], 1, F.size(v["found"])), v["found"], lambda b, s: F.concat(b, F.repeat(F.lit("\x01"), F.length(s["text"])))), ""), F.element_at(v["between"], -1))
        mine = lambda v: F.transform(v["found"], lambda s: F.struct(s["start"].alias("start"), p["name"].alias("name")))
        both = F.struct(spans(acc["rest"], p["pattern"]).alias("found"), F.split(acc["rest"], p["pattern"], -1).alias("between"))
        return F.when(F.rlike(acc["rest"], p["pattern"]), let(both, lambda v: F.struct(blank(v).alias("rest"), F.concat(acc["found"], mine(v)).alias("found")))).otherwise(acc)

    start = F.struct(F.coalesce(text, F.lit("")).alias("rest"), none.alias("found"))
    return F.aggregate(table, start, claim, lambda acc: F.array_sort(acc["found"]))
