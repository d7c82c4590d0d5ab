"""Readers, streams and the judged filter on files made here."""

import json

from pyspark.sql import functions as F

from feedmill.operators.judge import apply_judged, filter_key, words_provider
from feedmill.sources.readers import items_of_envelopes, read_articles, read_rss
from feedmill.streaming.ingest import deliver, run_ingest


def test_rss(spark, tmp_path):
    long = "word " * 200
    (tmp_path / "feed.xml").write_text(f"""<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>t</title>
<item><title> One </title><link>https://a.example/1</link><description>&lt;p&gt;short&lt;/p&gt;</description><pubDate>Sat, 26 Apr 2025 17:19:35 +0200</pubDate></item>
<item><title>Two</title><guid>https://a.example/2</guid><content:encoded>&lt;p&gt;{long}&lt;/p&gt;</content:encoded></item></channel></rss>""")
    got = {r.title: r for r in read_rss(spark, str(tmp_path), 7).collect()}
    assert got["One"].text is None and got["One"].excerpt == "short" and got["One"].url == "https://a.example/1" and got["One"].source_id == 7
    assert got["Two"].text == long.strip() and got["Two"].url == "https://a.example/2"


def test_articles(spark, tmp_path):
    page = {"results": [{"id": "x1", "doi": "https://doi.org/10.5555/abc", "title": "T", "publication_date": "2024-01-02", "cited_by_count": 3, "abstract_inverted_index": {"b": [1, 3], "a": [0, 2]}}, {"id": "x2", "title": "U"}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    got = {r.title: r for r in read_articles(spark, str(tmp_path)).collect()}
    assert got["T"].excerpt == "a b a b" and got["T"].doi == "10.5555/abc" and got["U"].url == "x2" and got["U"].excerpt is None


def test_envelopes(spark):
    items = [{"id": "1", "url": "u", "title": "t", "renditions": {"headline": {"text": "h"}, "brief": {"text": "b"}}}, {"id": "2", "url": "v", "renditions": {"abstract": {"text": "a"}, "brief": {"text": "b"}}}, {"id": "3", "url": "w"}, {"id": "4", "title": "no url"}]
    frame = spark.createDataFrame([(json.dumps({"items": items}),), ("{broken",), (None,)], "envelope string")
    got = {r.id: (r.title, r.text, r.excerpt, r.state) for r in items_of_envelopes(frame).collect()}
    assert got == {"1": ("h", "b", "b", "full"), "2": ("v", "a", "b", "full"), "3": ("w", "", "", "metadata_only")}


def test_ingest_and_delivery(spark, tmp_path):
    raw, out, state = (str(tmp_path / x) for x in ("raw", "out", "state"))
    schema = "raw_id long, url string, fetched_at timestamp"

    def arrive(*rows):
        spark.createDataFrame([(k, u, None) for k, u in rows], "raw_id long, url string, t string").select("raw_id", "url", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, raw_id)").alias("fetched_at")).coalesce(1).write.mode("append").parquet(raw)
        run_ingest(spark, raw, out, state)
        return spark.read.schema(schema).parquet(out).count()

    assert arrive((1, "https://a.example/x?utm_source=q"), (2, "http://www.a.example/x"), (3, None), (4, "https://a.example/y")) == 2
    assert arrive((5, "https://m.a.example/x/"), (6, "https://a.example/z")) == 3

    offers, log, mark = (str(tmp_path / x) for x in ("offers", "log", "mark"))
    for number, pairs in enumerate(([("s", 1), ("s", 1), ("t", 1)], [("s", 1), ("s", 2)], [])):
        spark.createDataFrame(pairs, "subscription_id string, item_id long").coalesce(1).write.mode("append").parquet(offers)
        deliver(spark.readStream.schema("subscription_id string, item_id long").parquet(offers), log, mark)
    assert sorted((r.subscription_id, r.item_id) for r in spark.read.parquet(log).collect()) == [("s", 1), ("s", 2), ("t", 1)]


def test_late_addresses(spark, tmp_path):
    raw, out, state = (str(tmp_path / x) for x in ("raw", "out", "state"))

    def arrive(*rows, each=None):
        for k, u, t in rows:
            spark.createDataFrame([(k, u, t)], "raw_id long, url string, t string").select("raw_id", "url", F.col("t").cast("timestamp").alias("fetched_at")).coalesce(1).write.mode("append").parquet(raw)
        run_ingest(spark, raw, out, state, each)
        return sorted(r.raw_id for r in spark.read.parquet(out).collect())

    a, b, c = (f"https://a.example/{x}" for x in "abc")
    assert arrive((1, a, "2024-06-01"), (2, a, "2024-05-01")) == [2]
    # long before and long after what has been seen, and without a time
    assert arrive((3, b, "2023-01-01"), (4, a, "2027-01-01"), each=1) == [2, 3]
    assert arrive((5, a, "2027-06-01"), (6, b, "2022-01-01"), (7, c, None), each=1) == [2, 3, 7]
    assert arrive() == [2, 3, 7]


def test_judged(spark):
    candidates = spark.createDataFrame([(1, "trout"), (2, "cod"), (3, ""), (4, "trout"), (5, "Trout"), (6, None)], "id long, text string")
    memo = spark.createDataFrame([(4, False)], "id long, passes boolean")
    verdicts, fresh = apply_judged(candidates, memo, "trout", words_provider, [F.col("id")], most=3)
    assert {r.id: r.state for r in verdicts.collect()} == {1: "passing", 2: "rejected", 3: "deferred", 4: "rejected", 5: "deferred", 6: "deferred"}
    assert {r.id for r in fresh.collect()} == {1, 2}

    def broken(instruction, texts):
        raise RuntimeError("no model")

    verdicts, fresh = apply_judged(candidates, memo, "trout", broken, [F.col("id")])
    assert {r.state for r in verdicts.where("id <> 4").collect()} == {"deferred"} and fresh.collect() == []
    assert filter_key(" A  b ") == filter_key("a B") != filter_key("a b", "loose")
