"""Packs, text helpers, readers and search that no SQL says."""

import json
import random

import pytest
from pyspark.sql import functions as F

from feedmill.functions import answers as A
from feedmill.functions import text as X
from feedmill.operators import dedup, digest, feed, packs, search
from feedmill.sources import readers

TOML = """
name = "sea"
[facets.theme]
key = "themes"
primary = true
terms = [{id = "fish", aliases = ["trout", "cod"]}, {id = "boat", aliases = ["ferry"]}]
[facets.place]
key = "places"
[facets.place.terms.north]
aliases = ["north of"]
[organisations]
exclusive_ids = ["union"]
terms = [{id = "union", aliases = ["fishers union"]}, {id = "council", aliases = ["city council"]}]
[relevance]
strong = ["smolt"]
weak = ["quay"]
"""


def _one(spark, column, **values):
    names = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_pack(spark, tmp_path):
    (tmp_path / "a.toml").write_text(TOML)
    (tmp_path / "broken.toml").write_text("[[")
    found = packs.read_packs(str(tmp_path))
    assert list(found) == ["sea"]
    pack = found["sea"]
    assert pack.keys == {"themes": "theme", "places": "place"} and ("place", "north", ("north of",)) in pack.terms()
    texts = ["A Smolt.", "The Fishers Union met.", "Trout and a ferry.", "Trout at the quay.", "Trout only.", "The city council.", "", None, "troutlet ferryman"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    assert [r.x for r in rows.select("id", pack.relevant(F.col("text")).alias("x")).orderBy("id").collect()] == [True, True, True, True, False, False, False, False, False]
    assert _one(spark, packs.Pack.read("name = 'all'").relevant(F.col("t")), t="x") is True


def test_facet_checks():
    pack = packs.Pack.read(TOML)
    asked = {"themes": ["fish", "horse"], "colours": ["red"], "entities": ["anything"]}
    bad = packs.check_facets(asked, pack)
    assert bad == {"keys": ["colours"], "values": {"themes": ["horse"]}, "known_keys": ["places", "themes"]}
    told = packs.facet_notices(asked, pack)
    assert len(told) == 2 and "colours" in told[0] and "horse" in told[1]
    assert packs.facet_notices({"themes": ["fish"]}, pack) == []


def test_hosts(spark):
    assert _one(spark, packs.link_only(F.col("u")), u="https://no.linkedin.com/x") and not _one(spark, packs.link_only(F.col("u")), u="https://notx.company/x")
    assert _one(spark, packs.content_farm(F.col("u")), u="https://www.openpr.com/1") and not _one(spark, packs.content_farm(F.col("u")), u=None)
    assert _one(spark, packs.market_spam(F.col("t"), F.col("u")), t="Pump Market Size 2024", u="x")


def test_rules_from_json():
    rule = feed.Rule.read("t", '{"include": ["a"], "facets": {"theme": ["fish"]}, "min_impact": 5}')
    assert rule.include == ("a",) and rule.facets == {"theme": ("fish",)} and rule.min_impact == 5
    for bad in ('{"include": []}', '{"colour": ["x"]}', '{"facets": {"planet": ["x"]}}'):
        with pytest.raises(feed.UnknownFilter):
            feed.Rule.read("t", bad)


def test_seeds_and_names(spark):
    seeds = lambda t: _one(spark, A.seed_phrases(F.col("t")), t=t)
    assert seeds('I want to follow "deep sea" and federated learning, on-device training') == ["deep sea", "federated learning", "on-device training"]
    assert seeds("") == [] and seeds(None) == [] and seeds("the latest news and articles") == []
    assert _one(spark, A.tidy_names(F.col("n")), n=['"Fish Daily" (UK)', "ab", "fish daily", "a b c d e f"]) == ["fish daily"]
    assert _one(spark, A.probe_terms(F.col("i"), F.col("r"), F.col("e"), F.col("n")), i=["A"], r=["b"], e=["sea_farms"], n="Name") == ["a", "b", "sea farms"]


def test_candidates(spark):
    urls = lambda t: _one(spark, A.candidate_urls(F.col("t")), t=t)
    assert urls(" reuters , ")[:2] == ["https://reuters.com", "https://www.reuters.com"] and len(urls("reuters")) == 14
    assert urls("a.example/x") == ["https://a.example/x", "https://www.a.example/x"] and urls("www.a.example") == ["https://www.a.example"]
    assert urls("https://a.example") == ["https://a.example"] and urls("") == [] and urls(None) == []


def test_answers(spark):
    f = lambda c, **v: _one(spark, c, **v)
    t, lang = F.col("t"), F.col("l")
    assert f(A.clean_answer(t), t="Summary: One.\n\nTwo.") == "One. Two." and f(A.clean_answer(t), t="Here is the abstract:\nYes.") == "Yes."
    assert f(A.without_reasoning(t), t="hm</think> Done.") == "Done." and f(A.without_reasoning(t), t="Done.") == "Done."
    assert f(A.trim_to_sentence(t), t="One. Two") == "One." and f(A.trim_to_sentence(t), t="no end") == "no end"
    assert f(A.looks_like_reasoning(t, lang), t="Okay, the user wants", l="en") and not f(A.looks_like_reasoning(t, lang), t="Solid work.", l="en")
    assert f(A.looks_like_reasoning(t, lang), t="plain words " * 20, l="el") and not f(A.looks_like_reasoning(t, lang), t="λέξη " * 40, l="el")
    assert f(A.length_in_words(t, lang), t="字" * 16, l="zh") == 10 and f(A.truncate_words(t, 2), t="a b c") == "a b […]"
    assert [f(A.stance_conflict(F.col("q"), F.lit(s), F.lit(a), F.lit(n)), q=q) for q, s, a, n in (("buy", 0, 2, 2), ("sell", 2, 0, 2), ("hold", 0, 9, 9), ("buy", 0, 0, 0))] == ["conflict", "conflict", "", "unsupported"]
    assert f(A.cited(F.col("a"), F.col("b")), a=["3", "1", "3", "9"], b=["1", "3"]) == ["3", "1"]
    assert f(A.clean_terms(F.col("a"), ("x", "y")), a=["y", "z", "x", "y"]) == ["y", "x"]


def _chunks(text, size):
    out, held, n = [], [], 0
    for p in (p.strip() for p in text.split("\n")):
        if not p:
            continue
        if held and n + len(p.split()) > size:
            out, held, n = [*out, "\n\n".join(held)], [], 0
        held, n = [*held, p], n + len(p.split())
        if n >= size:
            out, held, n = [*out, "\n\n".join(held)], [], 0
    return out + (["\n\n".join(held)] if held else [])


def test_paragraphs(spark):
    rng = random.Random(1)
    texts = ["", "one"] + ["\n".join(" ".join(["w"] * rng.randint(0, 40)) for _ in range(rng.randint(1, 12))) for _ in range(30)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "id long, t string")
    got = {r.id: r.x for r in rows.select("id", A.paragraphs_packed(F.col("t"), 30).alias("x")).collect()}
    assert got == {k: _chunks(t, 30) for k, t in enumerate(texts)} | {len(texts): []}


def test_readers(spark, tmp_path):
    page = {"resultList": {"result": [{"id": "1", "source": "PPR", "doi": "10.1/x", "title": "A <b>fish</b>.", "abstractText": "<p>Body</p>", "pubYear": "2024", "citedByCount": 3}, {"id": "2", "source": "MED", "title": "B"}]}}
    (tmp_path / "p.json").write_text(json.dumps(page))
    a, b = readers.reader_of("europepmc")(spark, str(tmp_path / "p.json")).orderBy("title").collect()
    assert (a.url, a.title, a.text, a.content_state, a.published_at) == ("https://doi.org/10.1/x", "A fish", "Body", "full", "2024")
    assert json.loads(a.extra)["is_preprint"] is True and b.url == "https://europepmc.org/article/MED/2" and b.content_state == "metadata_only"
    with pytest.raises(readers.UnknownKind, match="rss"):
        readers.reader_of("telegraph")
    days = spark.createDataFrame([("1970-01-01",), ("2000-01-01",), ("2024-05-05",), ("2030-01-02",), ("1995-05-05",)], "d string").select(readers.plausible_page_date(F.col("d").cast("date"), F.lit("2024-06-01").cast("date")).alias("x"))
    assert [str(r.x) for r in days.collect()] == ["None", "None", "2024-05-05", "None", "None"]


def test_html_forms(spark):
    assert _one(spark, X.clean_html(F.col("t")), t="<STYLE>x</STYLE>ﬁsh &amp;lt; <DIV>a</DIV >b") == "fish &lt; a\nb"


def test_keyword_search(spark):
    docs = spark.createDataFrame([(1, "harbour board opens", ""), (2, "board of the harbour", "harbours"), (3, "ferry", "the board"), (4, "", "nothing"), (5, None, None)], "id long, title string, text string")
    asked = spark.createDataFrame([('"harbour board"',), ("harb board",), ("ferry nothing",), ('"no such"',), ("",)], "query string")
    got = {}
    for r in search.keyword_search(docs, asked, {"title": 8, "text": 1}).collect():
        got.setdefault(r.query, set()).add(r.id)
    assert got == {'"harbour board"': {1}, "harb board": {1, 2}, "ferry nothing": {3, 4}}


def test_digest(spark):
    story = "the harbour board of the town opened a new quay for the ferries of the bay today"
    rows = [("t", 1, 9.0, story), ("t", 2, 8.0, story), ("t", 3, 7.0, "quite another text on trout and smolt in the cold water of the fjord"), ("t", 4, 6.0, "w" * 400)]
    got = [(r.id, r.spent) for r in digest.select(spark.createDataFrame(rows, "topic string, id long, score double, told string"), 60, 3).orderBy("id").collect()]
    assert [i for i, _ in got] == [1, 3]


def test_long_chain_of_conflicts(spark):
    """Row k conflicts with row k - 1 only: every second is kept, in more rounds than any bound set before."""
    rows = [(k, None, None, k, None, 0, 0) for k in range(120)]
    members = [(k, f"p{j}", True) for k, *_ in rows for j in (k, k + 1)] + [(k, f"i{k}", True) for k, *_ in rows]
    got = {r.id: r.kept for r in dedup.keep_first(spark.createDataFrame(members[: 2 * 56] + members[240:296], "id long, key string, active boolean")).collect()}
    assert got == {k: k % 2 == 0 for k in range(56)}


def test_filters(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", None, None), (2, "2024-01-31 00:00:00", "2024-02-01 00:00:00", None), (3, "2024-01-30 00:00:00", None, "skipped")], "id long, s string, r string, enrich_state string").select("id", F.col("s").cast("timestamp").alias("seen_at"), F.col("r").cast("timestamp").alias("read_at"), "enrich_state")
    ids = lambda **f: {r.id for r in rows.where(feed.Filter.read(f).condition()).collect()}
    assert ids(last_days=7, as_of="2024-02-01", off_topic="include") == {2, 3} and ids(unread=True) == {1} and ids(ids=[2, 9]) == {2} and ids(off_topic="only") == {3}
    members = spark.createDataFrame([(feed.FAVOURITES, 1), ("c", 2), (feed.ARCHIVE, 2)], "collection string, id long")
    tags = spark.createDataFrame([], "id long, facet string, term string")
    named = spark.createDataFrame([(1, "sea farms")], "id long, entity string")
    apply = lambda **f: {r.id for r in feed.Filter.read(f).apply(rows, tags, members, named).collect()}
    assert apply(starred=True) == {1} and apply(archived=True) == {2} and apply(collection="c", archived=True) == {2} and apply(entities=["Sea_Farms"]) == {1} and apply(off_topic="include") == {1, 3}
    with pytest.raises(feed.UnknownFilter):
        feed.Filter.read({"last_days": 3}).condition()


def test_envelopes_as_a_source(spark, tmp_path):
    from feedmill.sources.envelopes import EnvelopeSource

    (tmp_path / "a.json").write_text(json.dumps({"items": [{"id": "1", "url": "https://a.example/1", "renditions": {"brief": {"text": "b"}}}, {"id": "2"}]}))
    (tmp_path / "b.json").write_text("{")
    spark.dataSource.register(EnvelopeSource)
    rows = spark.read.format("envelopes").load(str(tmp_path)).collect()
    assert [(r.file, r.id, r.brief, r.headline) for r in rows] == [("a.json", "1", "b", None)]


def test_stages_are_isolated(spark):
    from feedmill.plans.run import run_stages

    done = {}
    log = run_stages(spark, {"a": lambda s: s.range(3), "b": lambda s: 1 / 0, "c": lambda s: s.range(2)}, lambda name, df: done.update({name: df.count()})).collect()
    assert done == {"a": 3, "c": 2} and [(r.stage, r.ok) for r in log] == [("a", True), ("b", False), ("c", True)] and "ZeroDivisionError" in log[1].error


def test_article_filters(spark, tmp_path):
    page = {"results": [{"id": "1", "title": "A", "type": "article", "cited_by_count": 5, "concepts": [{"display_name": "Fish"}]}, {"id": "2", "title": "B", "type": "book", "cited_by_count": 9, "concepts": []}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    read = lambda **f: [r.title for r in readers.read_articles(spark, str(tmp_path / "p.json"), **f).orderBy("title").collect()]
    assert read() == ["A", "B"] and read(min_citations=6) == ["B"] and read(concepts=("fish",)) == ["A"] and read(kind="book") == ["B"]
