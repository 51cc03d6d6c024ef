import json

import pytest
from pyspark.sql import functions as F

from sahifa.sources import json_lines, pages, progress
from sahifa.streaming import resume


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "a")
    df = spark.createDataFrame([("https://h/ا", "ت", None, ["x"])], json_lines.ARTICLES)
    json_lines.append(df, path)
    json_lines.append(df, path)
    assert json_lines.read_strict(spark, path, json_lines.ARTICLES).count() == 2
    line = spark.read.text(path).first()[0]
    assert "ا" in line and "category" not in json.loads(line)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('{"url": "u"}\n\n{"url": \n', encoding="utf-8")
    good, bad = json_lines.read_resumed(spark, str(tmp_path / "b"), json_lines.ARTICLES)
    assert [r.url for r in good.collect()] == ["u"] and bad.count() == 1
    with pytest.raises(Exception):
        json_lines.read_strict(spark, str(tmp_path / "b"), json_lines.ARTICLES).collect()


def test_limited_and_single(spark):
    assert json_lines.limited(spark.range(5), "id", 2).count() == 2
    assert json_lines.limited(spark.range(5), "id", 0).count() == 5
    assert json_lines.one_article(spark, "u").first().category == "N/A"


def test_api_responses(spark):
    def page(i, p):
        return json.dumps({"query": {"pages": {i: p}}})

    items = [page("5", {"revisions": [{"slots": {"main": {"*": "a"}}}]}), page("5", {"revisions": [{"*": "b"}]}), page("-1", {"missing": ""}), page("5", {}), "no json", "{}", None]
    df = spark.createDataFrame(list(enumerate(items)), "i int, r string").select("i", pages.wikitext_of(F.col("r")).alias("w")).orderBy("i")
    assert [r.w for r in df.collect()] == ["a", "b", None, None, None, None, None]


def test_fetched_drops_failures(spark):
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    have = spark.createDataFrame([("a", "x"), ("b", ""), ("d", "y")], "url string, html string")
    assert [r.url for r in pages.fetched(want, have).collect()] == ["a"]


def test_stream_keeps_each_page_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "1.json").write_text('{"url": "https://h/a?x"}\n{"url": "https://h/a"}\n{"url": "https://h/b"}\n', encoding="utf-8")

    def run():
        stream = resume.keep_new(resume.read_articles(spark, str(src), json_lines.ARTICLES), "url")
        resume.append_batches(stream, str(out), str(tmp_path / "state")).awaitTermination(120)

    run()
    (src / "2.json").write_text('{"url": "https://h/b#z"}\n{"url": "https://h/c"}\n', encoding="utf-8")
    run()
    assert sorted(r.key for r in spark.read.json(str(out)).collect()) == ["https://h/a", "https://h/b", "https://h/c"]


def test_hourly_counts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"t": "2025-01-01T10:05:00Z"}\n{"t": "2025-01-01T10:50:00Z"}\n{"t": "2025-01-01T15:00:00Z"}\n', encoding="utf-8")
    stream = spark.readStream.schema("t timestamp").json(str(src))
    q = resume.hourly_counts(stream, "t").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.records for r in spark.table("hours").collect()) == [1, 2]


def test_observed_counts(spark):
    df, seen = progress.observed(spark.range(10), even=F.col("id") % 2 == 0, none=F.lit(None).cast("boolean"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5, "none": 0}
