"""Connectors: where candidate events come from.

A connector gives candidate rows and, for each page, whether it was whole. A
fetch is complete if every page was read and the declared count was reached;
only then may rows that were not seen again be taken for gone.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html as markup

CANDIDATE = "title string, venue string, start string, end string, url string, lineup array<string>, genre_hint string, cancelled boolean"


class Pages:
    """A folder of a feed's pages, one file each, written through Hadoop's file systems, so on any store that Spark can read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The number of the last page there is, by doubling and halving; pages are landed in order."""
        if not self._there(1):
            return 0
        low, high = 1, 2
        while self._there(high):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._there(middle) else (low, middle)
        return low

    def _file(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._at, f"page-{number}.json")

    def _there(self, number: int) -> bool:
        return self._fs.exists(self._file(number))

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._file(number))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def land(self, number: int, page: dict) -> None:
        """Writes a page aside and renames it, so that a stream never reads a part of one."""
        aside = self.spark._jvm.org.apache.hadoop.fs.Path(self._at, f"_page-{number}")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(page).encode()))
        finally:
            out.close()
        self._fs.rename(aside, self._file(number))


class FetchFailed(RuntimeError):
    """A page could not be fetched; those before it are landed."""


def land_pages(pages: Pages, fetch: Callable[[str | None], dict], limit: int, cursor: Callable[[dict], str], retries: int = 1, wait: float = 2.0) -> int:
    """Fetches a feed page by page, from where the last run was cut, and lands each page; the number of pages there are.

    fetch(cursor) gives a page with items, at most limit; cursor(item) is what
    the next page comes after. The feed ends with a page that is not full, or one that
    doesn't get further; there is no cap. A page that fails is tried again, then
    ends the run with FetchFailed; PermissionError is not tried again.
    """
    number = pages.last()
    before = pages.read(number) if number else None
    at = cursor(before["items"][-1]) if before and before["items"] else None
    while before is None or len(before["items"]) >= limit:
        for attempt in range(retries + 1):
            try:
                page = fetch(at)
                break
            except PermissionError as e:
                raise FetchFailed(f"page {number + 1}: {e}") from e
            except Exception as e:  # noqa: BLE001  whatever a client raises
                if attempt == retries:
                    raise FetchFailed(f"page {number + 1}: {e}") from e
                time.sleep(wait)
        reached = cursor(page["items"][-1]) if page.get("items") else None
        if number and (reached is None or reached == at):
            break
        number += 1
        pages.land(number, page)
        before, at = {"items": page.get("items") or []}, reached
    return number


_PAGE = "total long, items array<string>, broken string"


def page_rows(files: DataFrame) -> DataFrame:
    """page, item (JSON), declared, problem: a row for each item of whole-text files page-N.json, and for each that is no JSON. Of a stream too."""
    read = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"page-(\d+)\.json", 1).cast("int").alias("page"), F.from_json("value", _PAGE, {"columnNameOfCorruptRecord": "broken"}).alias("p"))
    bad = F.col("p").isNull() | F.col("p.broken").isNotNull()
    none = F.array().cast("array<string>")
    items = F.when(bad, F.array(F.lit(None).cast("string"))).otherwise(F.coalesce("p.items", none))
    return read.select("page", F.explode(items).alias("item"), F.col("p.total").alias("declared"), F.when(bad, "not JSON").alias("problem"))


def paged_feed(spark: SparkSession, path: str) -> DataFrame:
    """page, item (JSON), declared, problem of all pages in a folder; a page missing before a later one is a problem."""
    files = spark.read.option("wholetext", True).text(f"{path}/page-*.json")
    there = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"page-(\d+)\.json", 1).cast("int").alias("page"))
    every = there.agg(F.max("page").alias("last")).select(F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page"))
    gaps = every.join(there, "page", "left_anti")
    none = F.lit(None)
    return page_rows(files).unionByName(gaps.select("page", none.cast("string").alias("item"), none.cast("long").alias("declared"), F.lit("missing page before a later one").alias("problem")))


def page_stream(spark: SparkSession, path: str, each: int = 100) -> DataFrame:
    """The same as a stream of the pages landed, so many files a batch; its checkpoint knows which it has had. Files are told apart by name, so a page is taken once."""
    return page_rows(spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", each).option("pathGlobFilter", "page-*.json").text(path))


def candidates(feed: DataFrame, schema: str = CANDIDATE) -> DataFrame:
    """Items of a feed as candidate rows; items without a title or start are left out."""
    return feed.where("problem IS NULL").select("page", F.from_json("item", schema).alias("c")).select("page", "c.*").where("title IS NOT NULL AND start IS NOT NULL")


def fetch_state(feed: DataFrame, *keys: str) -> DataFrame:
    """One row (for each of keys, if any): items, declared, problems and whether the fetch is complete. No items at all is a failure, not an empty source."""
    problem = F.col("problem").isNotNull()
    state = feed.groupBy(*keys).agg(F.count_if(~problem).alias("items"), F.max("declared").alias("declared"), F.count_if(problem).alias("problems"))
    return state.withColumn("complete", (F.col("items") > 0) & (F.col("problems") == 0) & (F.col("items") >= F.coalesce("declared", F.col("items"))))


def json_feed(spark: SparkSession, path: str, schema: str = CANDIDATE) -> tuple[DataFrame, DataFrame]:
    """(candidates, problems) of a flat feed of one JSON object a line: lines that are no JSON, or lack a title or start, are problems with their text."""
    read = spark.read.text(path).select("value", F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("c"))
    bad = F.col("c").isNull() | F.col("c._broken").isNotNull() | F.col("c.title").isNull() | F.col("c.start").isNull()
    return read.where(~bad).select("c.*").drop("_broken"), read.where(bad).select(F.col("value").alias("text"))


def in_city(rows: DataFrame, city: Column, cities: list[str], postal: Column, codes: tuple[int, int]) -> DataFrame:
    """Rows in one of the cities by name, or by postal code where no city is named."""
    named = F.lower(F.trim(city))
    code = F.regexp_extract(postal, r"\d{4}", 0).try_cast("int")
    return rows.where(F.when(F.coalesce(named, F.lit("")) != "", F.exists(F.array(*map(F.lit, cities)), lambda c: F.contains(named, c))).otherwise(F.coalesce(code.between(*codes), F.lit(False))))


def category_genre(category: Column, genres_of: dict[str, str], text_genre: Column) -> tuple[Column, Column]:
    """(genre, kind of evidence) of a listing: what its source's category stands for, else what its text names, which counts for less if the source has another category."""
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for pair in genres_of.items() for x in pair]), category)
    kind = F.when(mapped.isNotNull(), "official-source-metadata").when(text_genre.isNotNull() & category.isNotNull(), "deterministic-mapping").when(text_genre.isNotNull(), "official-description")
    return F.coalesce(mapped, text_genre), kind


EVENT_TYPES = ("Event", "MusicEvent")


def jsonld_events(pages: DataFrame, html: str = "html") -> DataFrame:
    """Events in the JSON-LD of pages, those of lists, graphs and item lists too: page columns, title, start, end, venue, url, ticket_url, price, lineup."""
    n = markup.json_ld(pages, html).where(F.col("type").isin(*EVENT_TYPES))
    at = lambda path: F.get_json_object("node", f"$.{path}")
    performers = at("performer")
    each = F.when(F.startswith(performers, F.lit("[")), F.from_json(performers, "array<string>")).when(performers.isNotNull(), F.array(performers))
    names = F.filter(F.transform(each, lambda p: F.coalesce(F.get_json_object(p, "$.name"), F.when(~F.startswith(p, F.lit("{")), p))), lambda x: x.isNotNull())
    n = n.withColumn("_offer", markup.cheapest_offer(F.col("node")))
    kept = [c for c in pages.columns if c != html]
    out = n.select(*kept, at("name").alias("title"), at("startDate").alias("start"), at("endDate").alias("end"), F.coalesce(at("location.name"), at("location[0].name")).alias("venue"), at("url").alias("url"), F.col("_offer.url").alias("ticket_url"), F.col("_offer.price").alias("price"), F.coalesce(names, F.array().cast("array<string>")).alias("lineup"))
    return out.where("title IS NOT NULL")


def listing_links(pages: DataFrame, html: str = "html", pattern: str = "") -> DataFrame:
    """The detail pages that listing pages link to, each once with the first page and place that names it."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("at", "target"))
    return found.where(F.col("target").contains(pattern)).groupBy("target").agg(F.min(F.struct("page_id", "at")).alias("_f")).select("target", "_f.page_id", "_f.at")


def details(listing: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """The second stage of a two-stage connector: detail pages joined to the links; those not fetched are kept with a problem."""
    out = listing.join(pages, key, "left")
    return out.withColumn("problem", F.when(F.col("html").isNull(), F.concat(F.lit("not fetched: "), F.col("target"))))


def decoded(raw: Column, charset: str = "ISO-8859-1") -> Column:
    """Text of bytes that are not UTF-8."""
    return F.decode(raw, charset)


DATES = r"(?i)(\d{1,2})[./]\s*(?:(\d{1,2})|(jan|feb|mar|apr|maj|may|jun|jul|aug|sep|okt|oct|nov|dec)\w*)[./]?\s*(\d{4})?(?:.*?kl\.?\s*(\d{1,2})[.:](\d{2}))?"
#: Months as listings write them.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "maj": 5, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "oct": 10, "nov": 11, "dec": 12}


def free_text_candidates(pages: DataFrame, text: str, year: int) -> DataFrame:
    """A candidate for each line of free text that starts with a date: page_id, title, local start."""
    lines = pages.select("page_id", F.explode(F.split(F.col(text), "\n")).alias("line")).where(F.col("line").rlike(r"^\s*\d{1,2}[./]"))
    part = lambda i: F.regexp_extract("line", DATES, i)
    month = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in MONTHS.items() for x in p]), F.lower(part(3))), F.expr("NULL").cast("int"))
    month = F.when(part(2) != "", part(2).cast("int")).otherwise(month)
    start = F.make_timestamp(F.when(part(4) != "", part(4).cast("int")).otherwise(year), month, part(1).cast("int"), F.when(part(5) != "", part(5).cast("int")).otherwise(20), F.when(part(6) != "", part(6).cast("int")).otherwise(0), F.lit(0))
    title = F.trim(F.regexp_replace("line", DATES, ""))
    return lines.select("page_id", F.regexp_replace(title, r"^[\s:–-]+|[\s:–-]+$", "").alias("title"), start.alias("start")).where("title <> '' AND start IS NOT NULL")


def static_relation(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A registry that comes with the program."""
    return spark.createDataFrame(rows, schema)
