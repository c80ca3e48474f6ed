"""Functions that no query needs, one by one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duskline.functions import genres, text, time
from duskline.operators import pipeline
from duskline.sources import connectors, tables


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_labels_inputs_and_addresses(spark):
    stamp = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, time.range_label(stamp("2024-01-15 21:00:00"), stamp("2024-01-16 04:00:00")), time.range_label(stamp("2024-01-15 21:00:00"), F.lit(None).cast("timestamp"))) == ("22:00–05:00", "22:00")
    assert one(spark, time.from_local_input(F.lit("2024-07-01T22:30"))) == (dt.datetime(2024, 7, 1, 20, 30),)
    first = next(iter(genres.TAXONOMY))
    assert one(spark, genres.label_of(F.lit(first))) == (genres.TAXONOMY[first][0],)
    assert one(spark, *[text.valid_email(F.lit(x)) for x in (" a@b.dk ", "a@b", "a b@c.dk", "@b.dk")], text.valid_email(F.lit(None).cast("string"))) == (True, False, False, False, False)


def test_urls_of_a_queue_row(spark):
    urls = F.array(F.lit("a"), F.lit("b"))
    none = F.lit(None).cast("array<string>")
    assert one(spark, pipeline.merged_urls(urls, F.lit("b")), pipeline.merged_urls(none, F.lit("c")), pipeline.merged_urls(urls, F.lit(None).cast("string"))) == (["a", "b"], ["c"], ["a", "b"])


def test_contracts(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    assert tables.require(df, spark.createDataFrame([], "b string, a int").schema).columns == ["b", "a"]
    for wrong in ("a long", "d int"):
        with pytest.raises(TypeError):
            tables.require(df, spark.createDataFrame([], wrong).schema)


def test_json_feed(spark, tmp_path):
    lines = ['{"title": "a", "start": "2024", "lineup": ["x"], "more": 1}', "{broken", '{"title": "b"}', "", '{"start": "2024"}']
    (tmp_path / "feed.json").write_text("\n".join(lines))
    found, problems = connectors.json_feed(spark, str(tmp_path / "feed.json"))
    assert [(r.title, r.lineup) for r in found.collect()] == [("a", ["x"])] and problems.count() == 4
