"""Candidates from HTML and JSON-LD, page by page."""

import json

from duskline.sources import connectors, html


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id int, html string")


def test_fields_are_found_by_the_elements_around_them(spark):
    page = """<nav><a href="/x">not in an item</a></nav><script>var t = "<article>";</script>
    <div class=list><ARTICLE id=1><h2><a href='/e/1'>First &amp; best</a></h2><p>Doors 22<p>unclosed <b>bold</b></article>
    <h2>between</h2><article><h2></h2><!-- <h2>no</h2> --><a>no target</a>text only</article></div>"""
    rows = html.items(pages(spark, page, None, "", "<article>", "plain text", "</article></article><article><h2>late</h2></article>"), "html", "article", {"title": ["h2"], "lead": ["p"], "bold": ["p", "b"], "all": []})
    got = {(r.page_id, r.item): (r.title, r.lead, r.bold, r.href) for r in rows.collect()}
    assert got == {(0, 1): ("First & best", "Doors 22 unclosed bold", "bold", ["/e/1"]), (0, 2): (None, None, None, []), (5, 1): ("late", None, None, [])}
    assert set(rows.columns) == {"page_id", "item", "title", "lead", "bold", "all", "href"}


def script(value):
    return f'<script type="application/ld+json">{json.dumps(value)}</script>'


def test_events_of_lists_graphs_and_item_lists(spark):
    event = lambda name, **more: {"@type": "MusicEvent", "name": name, "startDate": "2024-01-01"} | more
    one = script(event("a", offers=[{"price": "200", "url": "/dear"}, {"lowPrice": 90, "url": "/cheap"}, {"url": "/free?"}], performer={"name": "Ann"}, location=[{"name": "Hall"}]))
    several = script([event("b"), {"@type": "Place", "name": "no"}]) + script({"@graph": [event("c", performer=["Bo", {"name": "Cy"}])]})
    listed = script({"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": event("d")}, {"@type": "ListItem", "url": "/e"}, event("e")]})
    odd = script({"@type": ["Event", "Thing"], "name": "f", "offers": {"price": "free"}}) + "<script type='application/ld+json'>{broken</script>" + script({"@type": "Event"})
    rows = connectors.jsonld_events(pages(spark, one, several, listed, odd, None, "")).collect()
    assert {(r.page_id, r.title) for r in rows} == {(0, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "e"), (3, "f")}
    by = {r.title: r for r in rows}
    assert (by["a"].ticket_url, by["a"].price, by["a"].venue, by["a"].lineup) == ("/cheap", 90.0, "Hall", ["Ann"])
    assert by["c"].lineup == ["Bo", "Cy"] and by["f"].price is None and by["b"].lineup == []
