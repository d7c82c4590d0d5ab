"""Filters, rules, packing and state over small tables."""

import pytest
from pyspark.sql import functions as F

from feedmill.operators import feed
from feedmill.operators.feed import Filter, Rule, UnknownFilter

VOC = (("theme", "fish", ("trout", "fish farm")), ("theme", "farm", ("fish farm",)), ("region", "north", ("north of",)))


def test_tags(spark):
    rows = [(1, "Trout, trout: the FISH  farm north of Troutby"), (2, None), (3, ""), (4, "fish; farm"), (5, "trout " * 50_000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {(r.id, r.term): (r.hits, r.score) for r in feed.tag(docs, VOC).collect()}
    assert got == {(1, "fish"): (3, 0.8), (1, "farm"): (1, 0.5), (1, "north"): (1, 0.5), (4, "fish"): (1, 0.5), (4, "farm"): (1, 0.5), (5, "fish"): (50_000, 1.0)}


def test_filter_checks():
    assert Filter.read({"themes": ["fish"], "languages": [], "min_impact": 0}) == Filter(facets={"themes": ("fish",)})
    with pytest.raises(UnknownFilter):
        Filter.read({"colours": ["red"]})
    assert Filter(facets={"themes": ("a",), "regions": ("b",)}).without("themes").facets == {"regions": ("b",)}


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, "trout prices rose north of town", {"theme": ["fish"], "region": ["north"]}, ["acme"], "en", "news", 50.0),
        (2, "trouts and shares", {"theme": ["money"]}, [], None, "market", None),
        (3, "trout but sponsored content", {"theme": ["fish"]}, [], "no", "news", 150.0),
        (4, "ørret og Trout-avl", None, None, "no", None, 10.0),
    ]
    return spark.createDataFrame(data, "id long, haystack string, tags map<string,array<string>>, entities array<string>, lang string, item_type string, impact_score double")


def routed(rows, *rules):
    return {(r.topic, r.id): (r.score, r.why) for r in feed.route(rows, list(rules)).collect()}


def test_rules(rows):
    assert routed(rows, Rule("t", include=("trout",), exclude=("sponsored",))) == {("t", 1): (2.0, "include:trout"), ("t", 4): (1.2, "include:trout")}
    assert routed(rows, Rule("t", facets={"theme": ("fish",), "region": ("north", "south")})) == {("t", 1): (5.0, "theme:fish; region:north")}
    assert routed(rows, Rule("t", entities=("acme", "other"), languages=("en",))) == {("t", 1): (4.0, "entity:acme")}
    assert routed(rows, Rule("t", include=("shares",), languages=("en",), item_types=("market",))) == {("t", 2): (1.0, "include:shares")}
    assert routed(rows, Rule("t", require=("trout",), min_impact=20)) == {("t", 1): (2.5, "require:trout"), ("t", 3): (3.5, "require:trout")}
    assert not Rule("none", exclude=("x",)).positive and routed(rows, Rule("none", exclude=("x",)), Rule("t", include=("zzz",))) == {}


def test_windows(spark):
    day = F.lit("2024-03-01").cast("date")
    since, until = feed.window_of("week", day)
    assert [str(x) for x in spark.range(1).select(since, until).first()] == ["2024-02-24", "2024-03-02"]
    with pytest.raises(ValueError):
        feed.window_of("year", day)


def test_pack_prefix(spark):
    costs = {"a": [4, 4, 4, 1], "b": [20, 1], "c": [0, 10, 0]}
    data = [(g, i, c) for g, cs in costs.items() for i, c in enumerate(cs)]
    items = spark.createDataFrame(data, "g string, id long, cost long")
    take = lambda **k: sorted((r.g, r.id) for r in feed.pack_prefix(items, "g", [F.col("id")], "cost", F.lit(10), F.lit(2), **k).collect())
    assert take() == [("a", 0), ("a", 1), ("c", 0), ("c", 1)]
    assert take(keep_first=True) == [("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1)]


def test_pack_prefix_of_many(spark):
    rows = spark.range(1500).select(F.lit("a").alias("g"), "id", F.lit(1).alias("cost"))
    take = lambda most, **k: feed.pack_prefix(rows, "g", [F.col("id")], "cost", F.lit(5000), F.lit(most), **k).count()
    assert [take(2000), take(2000, cap=2000), take(1200), take(1200, keep_first=True)] == [1500, 1500, 1200, 1200]


def test_state(spark):
    log = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None), (2, "d", 0), (3, "e", None), (3, "e", None)], "k long, v string, at long")
    assert {r.k: r.v for r in feed.latest(log, ["k"], ["at", "v"]).collect()} == {1: "b", 2: "d", 3: "e"}
    runs = spark.createDataFrame([(1, t, b) for t, b in enumerate([1, 0, 1, 1])] + [(2, 0, 1), (2, 1, 1), (3, 0, 0)], "s long, at long, bad int")
    assert {r.s: r.streak for r in feed.open_streaks(runs, "s", ["at"], F.col("bad") == 1).collect()} == {1: 2, 2: 2, 3: 0}
