"""Descriptions as nested blocks: headings and paragraphs, their lines, and the text and links in each line.

Nothing is lost: the blocks' lines joined again are the text. A fold over the lines
opens a block at a heading, a blank line, or where full lines of prose meet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rooms, spans

#: What lines of their own are titles of sections.
SECTION_TITLES = (
    "lineup|line-up|line up|the lineup|program|programme|program/lineup|timetable|time table|schedule|about|about the event|about the night|about the artist|about the artists|the artists|artists|"
    "info|information|practical info|practical information|practicalities|tickets|ticket info|ticket information|prices|code of conduct|house rules|safer space|safer spaces|safe space|safer space policy|"
    "awareness|accessibility|access|faq|venue|location|doors|age limit|music|sound|praktisk information|praktisk info|praktiske oplysninger|billetter|om eventet|om arrangementet|om kunstneren|om kunstnerne|tilgængelighed"
).split("|")
EXPLICIT_PRACTICAL = r"(?i)^(?:practical info(?:rmation)?|praktisk info(?:rmation)?|praktiske oplysninger)$"
#: Lengths, in characters.
LONG_LINE, BODY, SHOUT = 80, 40, 50
PREVIEW_LEAST, PREVIEW_TARGET, PREVIEW_REST, ABOUT_LEAST = 900, 500, 250, 200
LINK = r"(?i)(?<![A-Za-z0-9_])(?:https?://|www\.)[^\s<>\"'`]*[^\s<>\"'`.,;:!?)\]]"
LABEL = 40

_BLOCK = "struct<type:string,level:string,para:int,lines:array<string>>"


def normal(text: Column) -> Column:
    """Line ends as one character, lines trimmed, at most one blank line between others."""
    lines = F.transform(F.split(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t ]+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")


def _shouted(line: Column) -> Column:
    return (F.length(F.regexp_replace(line, r"\P{L}", "")) >= 3) & ~line.rlike(r"\p{Ll}")


def _level(line: Column, following: Column, hints: Column) -> Column:
    """section, entry or null: whether a line is a heading."""
    bare = F.trim(F.regexp_replace(line, r":$", ""))
    marked = line.rlike(r"^#{1,6}\s+\S")
    title = F.regexp_replace(line, r"^#{1,6}\s+", "")
    body = F.coalesce(F.length(following) >= BODY, F.lit(False))
    closed = line.rlike(r"[.!?,;…]$|\d")
    shout = _shouted(line) & (F.length(line) <= SHOUT) & (F.size(F.split(line, r"\s+")) <= 7) & ~_shouted(F.coalesce(following, F.lit("")))
    return (
        F.when(marked, F.when((F.length(title) <= LONG_LINE) & ~title.rlike(r"[.!?]\s+\S") & ~title.rlike(LINK), "section"))
        .when((F.length(line) > LONG_LINE) | line.rlike(LINK) | (bare == ""), F.lit(None))
        .when(F.lower(bare).isin(*SECTION_TITLES), "section")
        .when(body & ~closed & F.array_contains(hints, F.lower(bare)), "entry")
        .when(body & ~closed & shout, "section")
    )


def blocks(text: Column, hints: Column | None = None) -> Column:
    """array<struct<type, level, para, lines>> of a text in its normal form; hints: names (in lower case) that are headings over a body."""
    hints = F.array().cast("array<string>") if hints is None else hints
    paras = F.filter(F.split(text, "\n\n"), lambda p: p != "")
    flat = F.flatten(F.transform(paras, lambda p, i: F.transform(F.split(p, "\n"), lambda x: F.struct(i.alias("para"), x.alias("line")))))
    told = spans.let(flat, lambda v: F.transform(v, lambda x, i: F.struct(x["para"].alias("para"), x["line"].alias("line"), _level(x["line"], F.get(v, i + 1)["line"], hints).alias("level"))))

    def one(kind: str, x: Column, lines: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("type"), x["level"].alias("level"), x["para"].alias("para"), lines.alias("lines")).cast(_BLOCK))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        long = (F.length(x["line"]) >= LONG_LINE) | (F.length(F.try_element_at(last["lines"], F.lit(-1))) >= LONG_LINE)
        joins = F.coalesce((last["type"] == "paragraph") & (last["para"] == x["para"]) & ~long, F.lit(False))
        more = F.concat(F.slice(acc, 1, F.size(acc) - 1), one("paragraph", x, F.concat(last["lines"], F.array(x["line"]))))
        heading = F.concat(acc, one("heading", x, F.array(F.regexp_replace(x["line"], r"^#{1,6}\s+", ""))))
        return F.when(x["level"].isNotNull(), heading).when(joins, more).otherwise(F.concat(acc, one("paragraph", x, F.array(x["line"]))))

    def closed(acc: Column) -> Column:
        # a heading with nothing after it is a heading of nothing
        last = F.try_element_at(acc, F.lit(-1))
        plain = F.array(F.struct(F.lit("paragraph").alias("type"), F.lit(None).cast("string").alias("level"), last["para"].alias("para"), last["lines"].alias("lines")).cast(_BLOCK))
        return F.when(last["type"] == "heading", F.concat(F.slice(acc, 1, F.size(acc) - 1), plain)).otherwise(acc)

    return F.aggregate(told, F.array().cast(f"array<{_BLOCK}>"), step, closed)


def link_label(url: Column) -> Column:
    """Host and path of a link, cut to a length."""
    label = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"(?i)^(?:https?://)?(?:www\.)?", ""), r"[?#].*$", ""), r"/+$", "")
    return F.when(F.length(label) > LABEL, F.concat(F.substring(label, 1, LABEL - 1), F.lit("…"))).otherwise(label)


def inlines(line: Column) -> Column:
    """array<struct<type, text, href>>: a line as text and links, in order; the texts joined (a link's being its own) are the line."""
    piece = lambda kind, t, href: F.struct(F.lit(kind).alias("type"), t.alias("text"), href.alias("href"))
    none = F.lit(None).cast("string")
    href = lambda u: F.when(u.rlike(r"(?i)^www\."), F.concat(F.lit("https://"), u)).otherwise(u)
    # a link that its source has cut off is never guessed at
    cut = lambda v, u, i: F.endswith(u, F.lit("…")) | F.get(v["between"], i + 1).rlike(r"^(?:…|\.\.\.)")
    link = lambda v, u, i: F.array(piece("text", F.get(v["between"], i), none), F.when(cut(v, u, i), piece("text", u, none)).otherwise(piece("link", u, href(u))))
    made = lambda v: F.concat(F.flatten(F.transform(v["found"], lambda u, i: link(v, u, i))), F.array(piece("text", F.element_at(v["between"], -1), none)))
    both = F.struct(F.split(line, LINK, -1).alias("between"), F.regexp_extract_all(line, F.lit(LINK), F.lit(0)).alias("found"))
    tokens = F.when(line.rlike(LINK), spans.let(both, made)).otherwise(F.array(piece("text", line, none)))
    return F.filter(tokens, lambda p: p["text"] != "")


def nested(found: Column) -> Column:
    """Blocks with their lines as inlines."""
    return F.transform(found, lambda b: F.struct(b["type"].alias("type"), b["level"].alias("level"), F.transform(b["lines"], inlines).alias("lines")))


def rebuilt(tree: Column) -> Column:
    """The text of nested blocks: lines under each other, blocks apart."""
    line = lambda tokens: F.array_join(F.transform(tokens, lambda t: t["text"]), "")
    return F.array_join(F.transform(tree, lambda b: F.array_join(F.transform(b["lines"], line), "\n")), "\n\n")


def _size(b: Column) -> Column:
    return F.aggregate(b["lines"], F.lit(0), lambda n, x: n + F.length(x))


def preview_count(found: Column) -> Column:
    """How many blocks are shown before the fold, or null to show all: whole blocks, no heading last, no small rest."""
    total = F.aggregate(found, F.lit(0), lambda n, b: n + _size(b))
    shown = F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars")), lambda acc, b: F.when(acc["chars"] < PREVIEW_TARGET, F.struct((acc["n"] + 1).alias("n"), (acc["chars"] + _size(b)).alias("chars"))).otherwise(acc), lambda acc: acc["n"])
    # headings at the end of what is shown go with what follows them
    kept = F.aggregate(F.slice(found, 1, shown), F.struct(F.lit(0).alias("i"), F.lit(1).alias("n")), lambda acc, b: F.struct((acc["i"] + 1).alias("i"), F.when(b["type"] == "paragraph", acc["i"] + 1).otherwise(acc["n"]).alias("n")), lambda acc: acc["n"])
    rest = lambda k: total - F.aggregate(F.slice(found, 1, k), F.lit(0), lambda n, b: n + _size(b))
    return spans.let(kept, lambda k: F.when((total > PREVIEW_LEAST) & (k < F.size(found)) & (rest(k) >= PREVIEW_REST), k))


def practical_start(found: Column) -> Column:
    """Where the practical tail starts (a number of blocks before it), or null: all headings from there on are practical, two of them or an explicit one, after a real text about the event."""
    words = lambda b: F.trim(F.regexp_replace(F.array_join(b["lines"], " "), r"[\s:.\-–—]+$", ""))
    practical = lambda b: (b["type"] == "heading") & words(b).rlike(rooms.PRACTICAL)
    first = F.array_position(F.transform(found, practical), True) - 1
    tail = F.when(first > 0, F.slice(found, (first + 1).cast("int"), F.size(found)))
    whole = ~F.exists(tail, lambda b: (b["type"] == "heading") & ~practical(b))
    enough = (F.size(F.filter(tail, practical)) >= 2) | words(F.get(tail, F.lit(0))).rlike(EXPLICIT_PRACTICAL)
    about = F.aggregate(F.slice(found, 1, F.greatest(first, F.lit(0)).cast("int")), F.lit(0), lambda n, b: n + F.when(b["type"] == "paragraph", _size(b)).otherwise(0))
    # a separator line just before it goes with the tail
    line_before = F.coalesce(F.get(F.get(found, (first - 1).cast("int"))["lines"], F.lit(0)).rlike(rooms.SEPARATOR), F.lit(False))
    return F.when((first > 0) & whole & enough & (about >= ABOUT_LEAST), (first - F.when(line_before, 1).otherwise(0)).cast("int"))
