"""Text functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from feedmill.functions import text as X
from feedmill.operators import dedup, search, simhash


def value(spark, expression, **columns):
    names = ", ".join(f"{k} string" for k in columns)
    return spark.createDataFrame([tuple(columns.values())], names).select(expression.alias("v")).first().v


URLS = {
    "HTTP://www.M.Example.COM/a/b/?utm_source=x&b=2&a=1&size=9#top": "https://example.com/a/b?a=1&b=2",
    "https://example.com": "https://example.com/",
    "https://example.com/?q=": "https://example.com/",
    "//m.example.com/x//": "https://example.com/x",
    "ftp://example.com/f": "ftp://example.com/f",
    "not a url": "https://not a url",
    None: None,
}


@pytest.mark.parametrize(("url", "want"), URLS.items())
def test_canonical_url(spark, url, want):
    assert value(spark, X.canonical_url(F.col("u")), u=url) == want


def test_small_functions(spark):
    v = lambda e, t: value(spark, e(F.col("t")), t=t)
    assert [v(X.word_count, t) for t in (None, "", "a b\n c", " x y")] == [0, 0, 3, 2]
    assert [v(X.estimate_tokens, t) for t in (None, "", "abc", "a" * 8, "a" * 5_000_000)] == [0, 0, 1, 3, 1_000_000]
    assert [v(X.entity_key, t) for t in ("Acme_Fish Holding A/S", "Mowi ASA", "  A.B. (Ltd.) ", "Inc", "", None)] == ["acme fish", "mowi", "a b", "", "", None]
    assert v(X.find_doi, "see (doi:10.1234/ab.c-1).") == "10.1234/ab.c-1" and v(X.find_doi, "none") is None
    assert v(X.clean_html, "<p>A&amp;B</p><script>x</p></script><b>c</b>&nbsp; d<br>\n\n\n\ne") == "A&B\n c d\n\ne"


def test_language(spark):
    v = lambda t: value(spark, X.detect_language(F.col("t")), t=t)
    assert v("Det er en sak som har vært til behandling og de kan ikke se om det er fra et år eller etter at vi fra skolen skal ha den på ny plass av byen etter av det") == "no"
    assert v("Αυτό είναι ένα κείμενο") == "el" and v("short text") == "en" and v(None) == "en" and v("") == "en"


def test_phrase(spark):
    v = lambda p, t: value(spark, X.phrase(F.col("t"), p), t=t)
    assert v("thin", "a THIN line") and not v("thin", "thing") and v("øl", "et Øl!") and not v("l", "øl") and v("c++", "in c++ code")


def test_simhash(spark):
    base = " ".join(f"word{k}" for k in range(300))
    rows = spark.createDataFrame([(1, base), (2, base + " more"), (3, " ".join(f"else{k * 7}" for k in range(300))), (4, "too short"), (5, None), (6, base)], "id long, text string")
    prints = rows.select("id", simhash.simhash64("text").alias("simhash"))
    got = {r.id: r.simhash for r in prints.collect()}
    assert got[4] == got[5] == 0 and got[1] == got[6]
    pairs = {(r.a, r.b): r.distance for r in simhash.similar_pairs(prints, 6).collect()}
    assert pairs[1, 6] == 0 and {*pairs} == {(1, 6), (1, 2), (2, 6)} and pairs[1, 2] <= 6


def test_blocks_miss_no_pair(spark):
    import random

    rng = random.Random(4)
    values = []
    for _ in range(60):
        x = rng.getrandbits(64)
        values += [x, *(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(3))]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 6 and values[i] and values[j]}
    rows = spark.createDataFrame(list(enumerate(signed)), "id long, simhash long")
    assert {(r.a, r.b) for r in simhash.similar_pairs(rows, 6).collect()} == want


def test_keys_are_not_broadcast(spark, tmp_path):
    """A fingerprint has tens of keys, of which Spark's estimate knows one; broadcast, they filled the driver."""
    spark.range(1, 2000).select("id", F.xxhash64("id").alias("simhash")).write.parquet(str(tmp_path / "prints"))
    near = simhash.similar_prints(spark.read.parquet(str(tmp_path / "prints")), 6)
    near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_decided_rows_are_not_broadcast(spark, monkeypatch):
    """Millions of decided rows are a few MB of Parquet; nothing of the cascade that is joined by id or fingerprint goes through the driver."""
    written, plans = dedup.materialise, []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(dedup, "materialise", kept)
    frame = spark.createDataFrame([(k, f"u{k // 2}", None, 1, None, 150, k) for k in range(1, 9)], "id long, url_key string, doi string, source_id long, title string, words int, simhash long")
    dedup.cascade(frame).collect()
    assert any("LeftOuter" in plan for plan in plans)
    assert not [line for plan in plans for line in plan.split("\n") if "BroadcastHashJoin [id" in line or "BroadcastHashJoin [f" in line]


def test_cascade_is_the_sequential_one(spark):
    import random

    rng = random.Random(5)
    prints = [rng.getrandbits(62) for _ in range(5)]
    rows = []
    for k in range(200):
        p = rng.choice(prints) ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 4)))
        rows.append((k, rng.choice([f"u{rng.randint(0, 120)}", None]), rng.choice([None, "", f"d{rng.randint(0, 60)}"]), rng.choice([1, 2, None]), rng.choice(["", None, f"t{rng.randint(0, 90)}"]), rng.choice([50, 150]), rng.choice([0, p])))
    kept = []
    for r in rows:
        _, url, doi, source, title, words, f = r
        hit = any((url and url == o[1]) or (doi and doi == o[2]) or (title and source is not None and (source, title) == (o[3], o[4])) or (words >= 120 and f and o[6] and (f ^ o[6]).bit_count() <= 6) for o in kept)
        if not hit:
            kept.append(r)
    frame = spark.createDataFrame(rows, "id long, url_key string, doi string, source_id long, title string, words int, simhash long")
    got = dedup.cascade(frame).collect()
    assert len(got) == len(rows) and {r.id for r in got if r.kept} == {r[0] for r in kept}
    gone = spark.createDataFrame([(rows[0][1] or "u1",), (None,)], "url_key string")
    assert {r.id for r in dedup.cascade(frame, gone).collect()} == {r[0] for r in rows if r[1] != (rows[0][1] or "u1")}


def test_search(spark):
    docs = spark.createDataFrame([(1, "salmon farm", "the salmon"), (2, "news", "salmon and trout farm"), (3, "x", None), (4, None, "farm")], "id long, title string, text string")
    queries = spark.createDataFrame([("salmon farm",), ("trout",), ("nothing",)], "query string")
    hits = search.bm25(docs, queries, {"title": 8, "text": 1}).collect()
    assert {(r.query, r.id) for r in hits} == {("salmon farm", 1), ("salmon farm", 2), ("trout", 2)}
    vectors = spark.createDataFrame([(k, [float(k % 7 - 3), float(k % 5 - 2), 1.0]) for k in range(50)], "id long, vec array<float>")
    import numpy as np

    m = np.array([[k % 7 - 3, k % 5 - 2, 1.0] for k in range(50)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    asked = vectors.where("id % 10 = 0").withColumnRenamed("id", "query")
    got = {}
    for r in search.nearest_vectors(vectors, asked, 3, block=8).collect():
        got.setdefault(r.query, {})[r["rank"]] = r.id
    for q, ranks in got.items():
        order = sorted((k for k in range(50) if k != q), key=lambda k: (-round(float(m[q] @ m[k]), 9), k))[:3]
        assert [round(float(m[q] @ m[k]), 9) for k in order] == [round(float(m[q] @ m[ranks[n]]), 9) for n in (1, 2, 3)]
