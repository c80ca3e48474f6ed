"""Candidates from HTML: fields found by the elements around them.

A page becomes an array of tags and texts in order; a fold counts how deep each
tracked element is open within an item, so that a text belongs to a field if all
elements that the field names are. Counts bear the unclosed tags that pages have. It is
one expression over a row: pages need no keys and no shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans, text

SKIPPED = r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->"
PIECE = r"<[^>]*>|[^<]+"
_FOUND = "array<struct<item:int,field:string,text:string>>"
#: Entities that texts are decoded of.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def decoded(value: Column) -> Column:
    """Text with its entities decoded and white space collapsed."""
    for entity, character in ENTITIES.items():
        value = F.replace(value, F.lit(entity), F.lit(character))
    return text.squeezed(value)


def pieces(html: Column) -> Column:
    """array<struct<tag, closing, piece>> of a page: tags (lower-case names) and texts (no tag), without scripts, styles and comments."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), SKIPPED, ""), F.lit(PIECE), F.lit(0))
    return F.transform(found, lambda p: F.struct(F.lower(F.regexp_extract(p, r"^</?([A-Za-z][A-Za-z0-9-]*)", 1)).alias("tag"), F.startswith(p, F.lit("</")).alias("closing"), p.alias("piece")))


def fields_of(html: Column, item: str, fields: dict[str, list[str]]) -> Column:
    """array<struct<item, field, text>>: each text and each link's target (field href, of anchors in an item) of a page's items, by number from 1, that stands in all elements of a field."""
    tracked = list(dict.fromkeys([item, *(t for tags in fields.values() for t in tags)]))

    def step(acc: Column, p: Column) -> Column:
        moved = F.when(p["closing"], -1).otherwise(1)
        depths = F.zip_with(F.array(*map(F.lit, tracked)), acc["depths"], lambda t, d: F.greatest(d + F.when(t == p["tag"], moved).otherwise(0), F.lit(0)))
        open_ = lambda tags: reduce(and_, [F.get(acc["depths"], F.lit(tracked.index(t))) > 0 for t in [item, *tags]])
        entry = lambda name, t: F.struct(acc["item"].alias("item"), F.lit(name).alias("field"), t.alias("text"))
        texts = F.array_compact(F.array(*[F.when(open_(tags), entry(name, p["piece"])) for name, tags in fields.items()]))
        href = F.regexp_extract(p["piece"], r"(?i)\shref\s*=\s*[\"']([^\"']*)[\"']", 1)
        link = F.when((p["tag"] == "a") & ~p["closing"] & open_([]) & (href != ""), F.array(entry("href", href))).otherwise(F.array().cast(_FOUND))
        begins = (p["tag"] == item) & ~p["closing"] & (F.get(acc["depths"], F.lit(0)) == 0)
        state = lambda d, i, f: F.struct(d.alias("depths"), i.alias("item"), f.cast(_FOUND).alias("found"))
        # what an item has left open ends with it
        fresh = F.transform(depths, lambda d, i: F.when(i == 0, d).otherwise(0))
        depths = F.when((p["tag"] == item) & (begins | (F.get(depths, F.lit(0)) == 0)), fresh).otherwise(depths)
        return F.when(p["tag"] == "", state(acc["depths"], acc["item"], F.concat(acc["found"], texts))).otherwise(state(depths, acc["item"] + begins.cast("int"), F.concat(acc["found"], link)))

    start = F.struct(F.array(*[F.lit(0)] * len(tracked)).alias("depths"), F.lit(0).alias("item"), F.array().cast(_FOUND).alias("found"))
    return F.aggregate(pieces(html), start, step, lambda acc: acc["found"])


def items(pages: DataFrame, html: str, item: str, fields: dict[str, list[str]]) -> DataFrame:
    """pages' other columns, item, and for each item of a page its fields as text (null if it has none) and href (array). Pages without items give no rows."""
    found = pages.withColumn("_found", fields_of(F.col(html), item, fields)).withColumn("item", F.explode(F.array_distinct(F.transform("_found", lambda x: x["item"]))))
    own = lambda name: F.transform(F.filter("_found", lambda x: (x["item"] == F.col("item")) & (x["field"] == name)), lambda x: x["text"])
    joined = {name: F.nullif(decoded(F.array_join(own(name), " ")), F.lit("")) for name in fields}
    return found.withColumns(joined | {"href": own("href")}).drop("_found", html)


def json_ld(pages: DataFrame, html: str = "html") -> DataFrame:
    """Nodes of the JSON-LD blocks of pages as JSON: single ones, those of lists and of @graph, and the items of an ItemList, each with the page's other columns and its type (the first of several)."""
    block = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))
    rows = pages.select("*", F.explode(block).alias("_b"))
    many = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    one = F.when(F.ltrim("_b").startswith("["), many(F.col("_b"))).otherwise(F.array("_b"))
    node = rows.withColumn("_n", F.explode(one))
    inner = F.concat(many(F.get_json_object("_n", "$['@graph']")), F.transform(many(F.get_json_object("_n", "$.itemListElement")), lambda e: F.coalesce(F.get_json_object(e, "$.item"), e)))
    node = node.withColumn("_n", F.explode(F.concat(F.array("_n"), inner)))
    kind = F.get_json_object("_n", "$['@type']")
    first = F.when(F.startswith(kind, F.lit("[")), F.get(F.from_json(kind, "array<string>"), F.lit(0))).otherwise(kind)
    return node.select(*[c for c in pages.columns if c != html], first.alias("type"), F.col("_n").alias("node"))


def cheapest_offer(node: Column) -> Column:
    """struct<url, price> of a node's cheapest offer: offers are one or a list, prices numbers or text."""
    raw = F.get_json_object(node, "$.offers")
    every = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))
    price = lambda o: F.coalesce(F.get_json_object(o, "$.price"), F.get_json_object(o, "$.lowPrice")).try_cast("double")
    told = F.transform(every, lambda o, i: F.struct(price(o).isNull().alias("unknown"), price(o).alias("price"), i.alias("i"), F.get_json_object(o, "$.url").alias("url")))
    return spans.let(F.array_min(told), lambda o: F.struct(o["url"].alias("url"), o["price"].alias("price")))
