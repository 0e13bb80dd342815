"""Feeds, pages and streams on small inputs."""

from pyspark.sql import functions as F

from tidemark.sources import feeds
from tidemark.streaming import windows


def test_xml_feed(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>[Live] One #tag</title><link>http://x/1</link><guid>g1</guid></item><item><title>One again</title><guid>g1</guid></item><item><title>Two</title></item></channel></rss>")
    got = feeds.normalised(feeds.xml_items(spark, str(tmp_path / "a.xml")), "s").collect()
    assert len(got) == 2 and {r["external_id"] for r in got} >= {"g1"} and all(r["title"] for r in got)


def test_json_and_html(spark):
    raw = spark.createDataFrame([('{"items": [{"headline": "A", "url": "u"}, {"x": 1}]}',), ("broken",)], "j string")
    got = [r[0] for r in raw.select(feeds.json_records(F.col("j"))).collect()]
    assert [(x["title"], x["url"]) for x in got[0]] == [("A", "u")] and not got[1]
    page = spark.createDataFrame([(1, '<p><a href="/a"><b>First</b> one</a><a href="/e"></a><A HREF=\'/b\'>Two</A></p>')], "page_id long, html string")
    assert [(r["rank"], r["url"], r["headline"]) for r in feeds.html_links(page).collect()] == [(1, "/a", "First one"), (3, "/b", "Two")]


def test_streamed_upsert_and_hours(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (1, "2024-01-01 00:20:00", "b"), (2, "2024-01-01 01:00:00", "c")], "id long, ts string, v string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, v string").parquet(str(tmp_path / "in"))
    windows.upsert_into(stream, str(tmp_path / "out"), ["id"], "ts", str(tmp_path / "cp")).awaitTermination()
    assert {(r["id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "b"), (2, "c")}
    q = windows.hourly(stream, "ts", "id").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["id"], r["n"]) for r in spark.sql("select * from hours").collect()) == [(1, 2), (2, 1)]
