"""Queries over the tables of a data directory, and the same in SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedmill.functions import text as X
from feedmill.operators import dedup, feed, packs, search, simhash
from feedmill.session import materialise
from feedmill.tables import spread, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Into how many batches the streaming ingest takes a table.
INGEST_BATCHES = 4


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return feed.feed_rows(spread(table(spark, d, "items")), table(spark, d, "sources"), table(spark, d, "enrichment"))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return packs.tags_of(spread(table(spark, d, "items")), PACK)


PACK = packs.read_packs(os.path.dirname(__file__))["harbour"]
_VOCABULARY_SQL = ", ".join(f"('{f}', '{t}', '{a}')" for f, t, names in PACK.terms() for a in names)
_ROWS_SQL = """rows AS (SELECT i.id, i.source_id, i.url, i.url_key, i.title, i.text, i.excerpt, i.lang, i.word_count, i.enrich_state, i.fetched_at AS seen_at, s.name AS source, s.trust, s.tags,
 e.headline, e.summary, e.item_type, e.content_class, e.significance, e.breakthrough, e.impact_score, e.confidence
 FROM items i LEFT JOIN sources s ON s.id = i.source_id LEFT JOIN enrichment e ON e.item_id = i.id)"""
_TAGS_SQL = f"""voc AS (SELECT * FROM (VALUES {_VOCABULARY_SQL}) v(facet, term, alias)),
 ws AS MATERIALIZED (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM items),
 grams AS (SELECT id, unnest(w) AS g FROM ws UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM ws WHERE len(w) > 1)),
 tags AS (SELECT id, facet, term, count(*) AS hits, least(1.0, round(0.35 + 0.15 * count(*), 2))::DOUBLE AS score FROM grams JOIN voc ON g = alias GROUP BY ALL)"""


@query(f"""WITH {_ROWS_SQL} SELECT id, source, title, seen_at, impact_score FROM rows WHERE lang IN ('en', 'no') AND coalesce(impact_score, 0) >= 20 AND coalesce(enrich_state, '') <> 'skipped' ORDER BY seen_at DESC, id LIMIT 50""")
def filter_page_newest(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a filtered feed, newest first."""
    f = feed.Filter.read({"languages": ["en", "no"], "min_impact": 20})
    return _rows(spark, d).where(f.condition()).orderBy(F.desc("seen_at"), "id").limit(50).select("id", "source", "title", "seen_at", "impact_score")


@query(f"""WITH {_ROWS_SQL} SELECT id, seen_at, impact_score FROM rows WHERE lang IN ('en', 'no') AND coalesce(impact_score, 0) >= 20 AND coalesce(enrich_state, '') <> 'skipped' ORDER BY impact_score DESC NULLS LAST, seen_at DESC, id LIMIT 20 OFFSET 20""")
def filter_page_impact(spark: SparkSession, d: str) -> DataFrame:
    """The second page, by impact."""
    f = feed.Filter.read({"languages": ["en", "no"], "min_impact": 20})
    return _rows(spark, d).where(f.condition()).orderBy(F.desc_nulls_last("impact_score"), F.desc("seen_at"), "id").offset(20).limit(20).select("id", "seen_at", "impact_score")


@query(f"WITH {_TAGS_SQL} SELECT id, facet, term, hits, score FROM tags")
def vocabulary_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d)


@query(f"""WITH {_ROWS_SQL}, {_TAGS_SQL} SELECT id, title FROM rows WHERE coalesce(enrich_state, '') <> 'skipped' AND seen_at >= TIMESTAMP '2024-01-01' AND seen_at < TIMESTAMP '2025-01-01'
 AND EXISTS (SELECT 1 FROM tags t WHERE t.id = rows.id AND facet = 'theme' AND term IN ('fish', 'energy')) AND EXISTS (SELECT 1 FROM tags t WHERE t.id = rows.id AND facet = 'region' AND term = 'north')""")
def facet_semi_join(spark: SparkSession, d: str) -> DataFrame:
    f = feed.Filter.read({"themes": ["fish", "energy"], "regions": ["north"], "since": "2024-01-01", "until": "2025-01-01"})
    return f.apply(_rows(spark, d), _tags(spark, d)).select("id", "title")


@query(f"""WITH {_ROWS_SQL}, {_TAGS_SQL}, base AS (SELECT id FROM rows WHERE coalesce(enrich_state, '') <> 'skipped' AND coalesce(impact_score, 0) >= 10)
 SELECT facet, term, count(DISTINCT id) AS n FROM tags WHERE facet = 'theme' AND id IN (SELECT id FROM base) AND id IN (SELECT id FROM tags WHERE facet = 'region' AND term = 'south') GROUP BY ALL
 UNION ALL SELECT facet, term, count(DISTINCT id) FROM tags WHERE facet = 'region' AND id IN (SELECT id FROM base) AND id IN (SELECT id FROM tags WHERE facet = 'theme' AND term = 'money') GROUP BY ALL""")
def facet_counts_excl_self(spark: SparkSession, d: str) -> DataFrame:
    f = feed.Filter.read({"themes": ["money"], "regions": ["south"], "min_impact": 10})
    return feed.facet_counts(_rows(spark, d), _tags(spark, d), f)


@query("""SELECT i.id FROM items i JOIN sources s ON s.id = i.source_id WHERE coalesce(enrich_state, '') <> 'skipped' AND list_has_any(CASE WHEN json_valid(s.tags) THEN from_json(s.tags, '["VARCHAR"]') ELSE [] END, ['tech', 'research'])""")
def source_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).where(feed.Filter.read({"source_tags": ["tech", "research"]}).condition()).select("id")


_RULES = [
    feed.Rule("sea", facets={"theme": ("fish", "transport")}, include=("trout", "ferry trips", "vessels", "smolt"), exclude=("toll bridge",)),
    feed.Rule("power", require=("megawatts",), include=("grid owner", "wind developer", "cable route"), min_impact=10.0),
    feed.Rule("money in the north", facets={"theme": ("money",), "region": ("north",)}, languages=("en", "no")),
    feed.Rule("markets", include=("shares",), item_types=("market", "news")),
]


def _word(p: str) -> str:
    return f"regexp_matches(haystack, '(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])')"


def _rule_sql(r: feed.Rule) -> str:
    tests, score, why = [f"NOT {_word(p)}" for p in r.exclude], "least(2.0, coalesce(impact_score, 0) / 50.0)", []
    if r.item_types:
        tests.append("coalesce(item_type IN ({}), false)".format(", ".join(f"'{x}'" for x in r.item_types)))
    if r.languages:
        tests.append("coalesce(nullif(lang, ''), 'en') IN ({})".format(", ".join(f"'{x}'" for x in r.languages)))
    if r.min_impact:
        tests.append(f"coalesce(impact_score, 0) >= {r.min_impact}")
    for f, terms in r.facets.items():
        hit = "list_sort(list_filter({}, lambda x: list_contains(coalesce({}_terms, []), x)))".format([*terms], f)
        tests.append(f"len({hit}) > 0")
        score += f" + 2.0 * len({hit})"
        why.append(f"'{f}:' || array_to_string({hit}, ',')")
    for p in r.require:
        tests.append(_word(p))
        score += " + 1.5"
        why.append(f"'require:{p}'")
    if r.include:
        fired = "list_filter([{}], lambda x: x IS NOT NULL)".format(", ".join(f"CASE WHEN {_word(p)} THEN '{p}' END" for p in r.include))
        tests.append(f"len({fired}) > 0")
        score += f" + len({fired})"
        why.append(f"'include:' || array_to_string({fired}, ',')")
    return f"SELECT '{r.topic}' AS topic, id, round(({score})::DOUBLE, 2) AS score, array_to_string([{', '.join(why)}], '; ') AS why FROM r WHERE {' AND '.join(tests)}"


_HAY_SQL = "lower(concat_ws(' ', nullif(title, ''), nullif(headline, ''), nullif(summary, ''), nullif(text, '')))"
_ROUTE_SQL = f"""WITH {_ROWS_SQL}, {_TAGS_SQL}, per AS (SELECT id, list(term) FILTER (facet = 'theme') AS theme_terms, list(term) FILTER (facet = 'region') AS region_terms FROM tags GROUP BY id),
 r AS MATERIALIZED (SELECT rows.id, lang, item_type, impact_score, seen_at, {_HAY_SQL} AS haystack, theme_terms, region_terms FROM rows LEFT JOIN per ON per.id = rows.id),
 routed AS MATERIALIZED ({" UNION ALL ".join(map(_rule_sql, _RULES))})"""


def _routed(spark: SparkSession, d: str) -> DataFrame:
    per = feed.tag_map(_tags(spark, d))
    rows = _rows(spark, d).join(per, "id", "left").withColumn("haystack", X.haystack(*map(F.col, ("title", "headline", "summary", "text")))).withColumn("entities", F.array().cast("array<string>"))
    return feed.route(rows, _RULES)


@query(f"{_ROUTE_SQL} SELECT topic, id, score, why FROM routed")
def topic_route_rules(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d)


@query(f"{_ROUTE_SQL} SELECT topic, count(*) AS n FROM routed JOIN r USING (id) WHERE seen_at >= DATE '2025-05-05' AND seen_at < DATE '2025-06-04' GROUP BY topic")
def topic_counts_month(spark: SparkSession, d: str) -> DataFrame:
    since, until = feed.window_of("month", F.lit("2025-06-03").cast("date"))
    times = table(spark, d, "items").select("id", F.col("fetched_at").alias("seen_at")).where((F.col("seen_at") >= since) & (F.col("seen_at") < until))
    return _routed(spark, d).join(times, "id").groupBy("topic").agg(F.count("*").alias("n"))


@query(f"{_ROUTE_SQL} SELECT topic, id, score, rank FROM (SELECT topic, id, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rank FROM routed) WHERE rank <= 10")
def topic_best(spark: SparkSession, d: str) -> DataFrame:
    return search.top(_routed(spark, d), 10, by="topic").select("topic", "id", "score", F.col("rank").cast("long").alias("rank"))


_ASKED = "asked AS (SELECT DISTINCT json_extract_string(spec, '$.query') AS query FROM subscriptions WHERE trim(coalesce(json_extract_string(spec, '$.query'), '')) <> '')"
_BM25_SQL = f"""WITH {_ASKED}, {_ROWS_SQL}, named AS (SELECT DISTINCT query, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM asked), sizes AS (SELECT query, count(*) AS terms FROM named GROUP BY query),
 toks AS MATERIALIZED (SELECT id, regexp_extract_all(lower(coalesce(title, '')), '[\\p{{L}}\\p{{N}}]+') AS a, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS b, regexp_extract_all(lower(coalesce(summary, '')), '[\\p{{L}}\\p{{N}}]+') AS c FROM rows),
 stat AS (SELECT count(*) AS n, avg(len(a) + len(b) + len(c)) AS mean FROM toks),
 flat AS (SELECT id, len(a) + len(b) + len(c) AS length, unnest(a) AS term, 8.0 AS w FROM toks UNION ALL SELECT id, len(a) + len(b) + len(c), unnest(b), 1.0 FROM toks UNION ALL SELECT id, len(a) + len(b) + len(c), unnest(c), 4.0 FROM toks),
 post AS (SELECT term, id, sum(w)::DOUBLE AS f, first(length) AS length FROM flat WHERE term IN (SELECT term FROM named) GROUP BY ALL), spread AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 gain AS (SELECT query, id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) AS g FROM post JOIN spread USING (term) JOIN named USING (term), stat),
 scored AS (SELECT query, id, sum(g) AS score FROM gain JOIN sizes USING (query) GROUP BY query, id, terms HAVING count(*) = terms),
 ranked AS MATERIALIZED (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM scored)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    spec = F.from_json("spec", "query string, languages array<string>, max_tokens bigint, max_items bigint")
    return table(spark, d, "subscriptions").select(spec["query"].alias("query")).where("trim(query) <> ''").distinct()


def _keyword(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(_rows(spark, d).select("id", "title", "text", "summary"), _asked(spark, d), {"title": 8, "text": 1, "summary": 4})


@query(f"{_BM25_SQL} SELECT query, id, round(score, 5) AS score FROM ranked WHERE rank <= 40")
def bm25_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The best items for each subscription's query."""
    return search.top(_keyword(spark, d), 40).select("query", "id", F.round("score", 5).alias("score"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
 SELECT query, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth vector."""
    v = _vectors(spark, d)
    return search.nearest_vectors(v, v.where("id % 50 = 0").withColumnRenamed("id", "query"), 10).select("query", "id", F.round("score", 6).alias("score"))


@query(f"""{_BM25_SQL}, newest AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY seen_at DESC, id) AS rank FROM scored JOIN rows USING (id))
 SELECT query, id, round(sum(part), 9) AS score FROM (SELECT query, id, 1.0 / (60 + rank) AS part FROM ranked WHERE rank <= 100 UNION ALL SELECT query, id, 1.0 / (60 + rank) FROM newest WHERE rank <= 100) GROUP BY query, id""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Keyword rank and recency of the hits, fused."""
    hits = materialise(_keyword(spark, d))  # read by both lists
    times = table(spark, d, "items").select("id", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("seen_at"))
    fused = search.fuse(search.top(hits, 100), search.top(hits.join(times, "id"), 100, score="seen_at"))
    return fused.select("query", "id", F.round("score", 9).alias("score"))


@query("""SELECT doc_id, CASE WHEN len(w) < 6 THEN 0 ELSE (SELECT sum(CASE WHEN votes > 0 THEN (CASE WHEN b = 63 THEN -9223372036854775808 ELSE (1::HUGEINT << b) END) ELSE 0 END)::BIGINT FROM (
  SELECT b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: ('0x' || substr(md5(w[i] || ' ' || w[i+1] || ' ' || w[i+2]), 1, 16))::UBIGINT)) AS h) g, range(64) r(b) GROUP BY b) v) END AS simhash
 FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents) d""")
def simhash64(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", F.coalesce(simhash.simhash64("text"), F.lit(0)).alias("simhash"))


@query("""SELECT x.id AS a, y.id AS b, bit_count(xor(x.simhash, y.simhash))::INT AS distance FROM items x JOIN items y ON x.id < y.id AND x.simhash <> 0 AND y.simhash <> 0 AND bit_count(xor(x.simhash, y.simhash)) <= 6""")
def similar_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items whose stored fingerprints differ in at most six bits."""
    return simhash.similar_pairs(table(spark, d, "items"), 6)


# one row after the other, against the list of what is kept so far
_CASCADE_SQL = f"""WITH RECURSIVE p AS ({ORACLE["simhash64"].replace("doc_id", "id").replace("documents", "items")}),
 r AS MATERIALIZED (SELECT i.id, row_number() OVER (ORDER BY i.id) AS n, nullif(url_key, '') AS u, nullif(doi, '') AS d, source_id AS s, nullif(title, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\s]+')) AS words, nullif(p.simhash, 0) AS f FROM items i JOIN p ON p.id = i.id),
 step AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS id, true AS kept, [{{'u': NULL::VARCHAR, 'd': NULL::VARCHAR, 's': NULL::BIGINT, 't': NULL::VARCHAR, 'f': NULL::BIGINT}}] AS held
 UNION ALL SELECT n, id, hit = 0, CASE WHEN hit = 0 THEN list_append(held, {{'u': u, 'd': d, 's': s, 't': t, 'f': f}}) ELSE held END FROM (SELECT r.*, step.held, len(list_filter(step.held, lambda k: coalesce(k.u = r.u, false) OR coalesce(k.d = r.d, false) OR coalesce(k.s = r.s AND k.t = r.t, false) OR coalesce(r.words >= 120 AND bit_count(xor(k.f, r.f)) <= 6, false))) AS hit FROM step JOIN r ON r.n = step.n + 1))
 SELECT id, kept FROM step WHERE n > 0"""


@query(_CASCADE_SQL)
def dedup_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Which items an ingest in the order of their ids would keep."""
    rows = spread(table(spark, d, "items")).select("id", "url_key", "doi", "source_id", "title", X.word_count(F.col("text")).alias("words"), F.coalesce(simhash.simhash64("text"), F.lit(0)).alias("simhash"))
    return dedup.cascade(rows)


@query("""WITH p AS (SELECT raw_id, regexp_extract(trim(url), '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$', ['scheme', 'host', 'path', 'query']) AS u FROM raw_items WHERE url IS NOT NULL),
 q AS (SELECT raw_id, CASE WHEN lower(u.scheme) IN ('', 'http', 'https') THEN 'https' ELSE lower(u.scheme) END AS scheme, regexp_replace(regexp_replace(lower(u.host), '^www\\.', ''), '^m\\.', '') AS host, regexp_replace(regexp_replace(u.path, ';[^/]*$', ''), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(u.query, '&'), lambda x: regexp_matches(x, '^[^=]+=.') AND NOT regexp_matches(lower(x), '^(?:""" + X.TRACKING + """)'))), '&') AS query FROM p),
 c AS (SELECT raw_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM q)
 SELECT raw_id, canonical, sha1(canonical) AS url_key FROM c""")
def canonical_url_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").where("url is not null").select("raw_id", X.canonical_url(F.col("url")).alias("canonical"), X.url_key(F.col("url")).alias("url_key"))


@query("""SELECT id, len(regexp_extract_all(coalesce(text, ''), '[^\\s]+'))::INT AS words, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE least(length(text) // 4 + 1, 1000000) END::INT AS tokens FROM items""")
def words_and_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("id", X.word_count(F.col("text")).cast("int").alias("words"), X.estimate_tokens(F.col("text")).alias("tokens"))


_HITS_SQL = ", ".join(f"len(list_filter(w, lambda x: list_contains({[*dict.fromkeys(s.split())]}, x))) AS {code}_n" for code, s in X.STOPWORDS.items())


@query(f"""WITH t AS MATERIALIZED (SELECT doc_id, text, {", ".join(f"len(regexp_extract_all(text, '[{span}]')) AS {c}_s" for c, span in X.SCRIPTS)}, greatest(len(regexp_extract_all(text, '\\p{{L}}')), 1) AS letters, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+') AS w FROM documents),
 h AS MATERIALIZED (SELECT *, {_HITS_SQL} FROM t), r AS (SELECT *, list_sort([{", ".join(f"{{'n': -{c}_n, 'k': {k}, 'code': '{c}'}}" for k, c in enumerate(X.STOPWORDS))}]) AS ranked FROM h)
 SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'en' {" ".join(f"WHEN {c}_s / letters > 0.2 THEN '{c}'" for c, _ in X.SCRIPTS)}
 WHEN len(w) >= 25 AND -ranked[1].n >= 4 AND ranked[2].n - ranked[1].n >= 2 THEN ranked[1].code ELSE 'en' END AS detected FROM r""")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    """The language of each document by scripts and function words."""
    return spread(table(spark, d, "documents")).select("doc_id", X.detect_language(F.col("text")).alias("detected"))


@query(f"""WITH {_ROWS_SQL}, m AS (SELECT rows.*, CASE WHEN json_valid(i.meta) THEN TRY_CAST(json_extract_string(i.meta, '$.citations') AS DOUBLE) END AS cites, date_diff('day', seen_at::DATE, DATE '2026-06-01') AS age FROM rows JOIN items i USING (id))
 SELECT id, round(100 * least(greatest((0.40 * coalesce(significance, 0) / 5 + 0.20 * least(greatest(coalesce(trust, 0), 0), 1) + 0.15 * CASE WHEN coalesce(cites, 0) > 0 THEN least(log10(cites + 1) / 2, 1) ELSE 0 END + 0.15 * exp(-greatest(age, 0) / 30.0)
 + CASE WHEN breakthrough THEN 0.10 ELSE 0 END) * CASE content_class WHEN 'promotional' THEN 0.7 WHEN 'content_farm' THEN 0.35 WHEN 'stub' THEN 0.8 ELSE 1.0 END, 0), 1), 1) AS impact FROM m""")
def impact_score(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "items").select("id", F.get_json_object("meta", "$.citations").try_cast("double").alias("cites"))
    rows = _rows(spark, d).join(meta, "id").withColumn("age", F.datediff(F.lit("2026-06-01"), F.col("seen_at")))
    score = X.impact_score(F.col("significance"), F.col("trust"), F.col("cites"), F.lit(False), F.col("age"), F.col("breakthrough"), F.col("content_class"))
    return rows.select("id", score.alias("impact"))


_FORMS = "|".join(x.replace(".", "\\.") for x in sorted(X.LEGAL_FORMS, key=len, reverse=True)).replace("'", "''")
_KEY_SQL = f"""substr(regexp_replace(trim(regexp_replace(regexp_replace(lower(replace(name, '_', ' ')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s&/-]+', ' ', 'g'), '\\s+', ' ', 'g')), '((^| )({_FORMS}))+$', ''), 1, 120)"""


@query(f"SELECT mention_id, {_KEY_SQL} AS entity FROM entities WHERE name IS NOT NULL")
def entity_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("name is not null").select("mention_id", X.entity_key(F.col("name")).alias("entity"))


@query(f"""SELECT entity, count(*) AS n, count(DISTINCT item_id) AS items, max_by(name, {{'l': length(name), 'n': name}}) AS display FROM (SELECT *, {_KEY_SQL} AS entity FROM entities WHERE name IS NOT NULL) WHERE entity <> '' GROUP BY entity HAVING count(*) >= 3""")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each entity is named, and its longest spelling."""
    named = table(spark, d, "entities").where("name is not null").withColumn("entity", X.entity_key(F.col("name"))).where("entity <> ''")
    return named.groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"), F.max_by("name", F.struct(F.length("name"), "name")).alias("display")).where("n >= 3")


_SPEC = """spec AS (SELECT id AS sub, coalesce(from_json(json_extract(spec, '$.languages'), '["VARCHAR"]'), []) AS languages, json_extract_string(spec, '$.max_tokens')::BIGINT AS max_tokens, json_extract_string(spec, '$.max_items')::BIGINT AS max_items FROM subscriptions WHERE active)"""
_OPEN = f"""{_SPEC}, priced AS (SELECT id, coalesce(lang, '') AS lang, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE least(length(text) // 4 + 1, 1000000) END::BIGINT AS cost FROM items WHERE coalesce(enrich_state, '') <> 'skipped'),
 due AS (SELECT sub, p.id, cost, max_tokens, max_items FROM spec JOIN priced p ON len(languages) = 0 OR list_contains(languages, lang) WHERE NOT EXISTS (SELECT 1 FROM deliveries x WHERE x.subscription_id = sub AND x.item_id = p.id)),
 n AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY id) AS n, sum(cost) OVER (PARTITION BY sub ORDER BY id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM due)"""


def _due(spark: SparkSession, d: str) -> DataFrame:
    """What each active subscription may still get: in its languages, not delivered yet."""
    spec = F.from_json("spec", "query string, languages array<string>, max_tokens bigint, max_items bigint")
    subs = table(spark, d, "subscriptions").where("active").select(F.col("id").alias("sub"), F.explode(F.when(F.size(F.coalesce(spec["languages"], F.array())) == 0, F.array(F.lit("*"))).otherwise(F.array_distinct(spec["languages"]))).alias("language"), spec["max_tokens"].alias("max_tokens"), spec["max_items"].alias("max_items"))
    items = table(spark, d, "items").where(F.coalesce("enrich_state", F.lit("")) != "skipped").select("id", F.coalesce("lang", F.lit("")).alias("lang"), X.estimate_tokens(F.col("text")).cast("long").alias("cost"))
    # every item under its language and under any, so that the subscriptions' wishes are an equi-join
    offered = items.select("id", "cost", F.explode(F.array("lang", F.lit("*"))).alias("language"))
    got = table(spark, d, "deliveries").select(F.col("subscription_id").alias("sub"), F.col("item_id").alias("id"))
    return offered.join(subs, "language").drop("language").join(got, ["sub", "id"], "left_anti")


def _most_items(spark: SparkSession, d: str) -> int | None:
    """The greatest count that a subscription asks for."""
    return table(spark, d, "subscriptions").select(F.max(F.from_json("spec", "max_items bigint")["max_items"])).first()[0]


@query(f"WITH {_OPEN} SELECT sub, id, cost, spent FROM n WHERE spent <= max_tokens AND n <= max_items")
def sync_pack_budget(spark: SparkSession, d: str) -> DataFrame:
    """What each subscription's next sync delivers: undelivered items in order until tokens or count run out."""
    return feed.pack_prefix(_due(spark, d), "sub", [F.col("id")], "cost", F.col("max_tokens"), F.col("max_items"), cap=_most_items(spark, d)).select("sub", "id", "cost", "spent")


@query(f"WITH {_OPEN} SELECT sub, id, cost, spent FROM n WHERE (spent <= max_tokens OR n = 1) AND n <= max_items")
def preview_pack(spark: SparkSession, d: str) -> DataFrame:
    """The same with the first item kept at whatever cost."""
    return feed.pack_prefix(_due(spark, d), "sub", [F.col("id")], "cost", F.col("max_tokens"), F.col("max_items"), keep_first=True, cap=_most_items(spark, d)).select("sub", "id", "cost", "spent")


@query("""SELECT i.id, kind, CASE WHEN coalesce(length(t), 0) = 0 THEN 0 ELSE least(length(t) // 4 + 1, 1000000) END::INT AS tokens FROM (SELECT i.id, unnest(['headline', 'brief', 'full']) AS kind, unnest([coalesce(nullif(e.headline, ''), i.title), coalesce(nullif(e.summary, ''), i.excerpt), i.text]) AS t FROM items i LEFT JOIN enrichment e ON e.item_id = i.id) i WHERE coalesce(t, '') <> ''""")
def renditions_priced(spark: SparkSession, d: str) -> DataFrame:
    """Each item's renditions with their price in tokens; empty ones are left out."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("t")) for k, t in (("headline", X.first_text(F.col("headline"), F.col("title"))), ("brief", X.first_text(F.col("summary"), F.col("excerpt"))), ("full", F.nullif("text", F.lit(""))))])
    return _rows(spark, d).select("id", F.explode(F.filter(kinds, lambda x: x["t"].isNotNull())).alias("r")).select("id", "r.kind", X.estimate_tokens(F.col("r.t")).alias("tokens"))


@query("""SELECT i.id, CASE WHEN coalesce(e.summary, '') <> '' THEN 'summary' WHEN coalesce(e.headline, '') <> '' THEN 'headline' WHEN coalesce(i.excerpt, '') <> '' THEN 'excerpt' WHEN coalesce(i.text, '') <> '' THEN 'text' END AS layer,
 coalesce(nullif(e.summary, ''), nullif(e.headline, ''), nullif(i.excerpt, ''), nullif(i.text, '')) AS context FROM items i LEFT JOIN enrichment e ON e.item_id = i.id""")
def context_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The best text at hand for each item, and which it is."""
    steps = ("summary", "headline", "excerpt", "text")
    return _rows(spark, d).select("id", F.coalesce(*[F.when(F.coalesce(c, F.lit("")) != "", c_name) for c, c_name in ((F.col(s), F.lit(s)) for s in steps)]).alias("layer"), X.first_text(*map(F.col, steps)).alias("context"))


@query("SELECT s.id AS sub, count(x.item_id) AS n, count(DISTINCT x.item_id) AS items, max(x.delivered_at) AS last_at FROM subscriptions s LEFT JOIN deliveries x ON x.subscription_id = s.id GROUP BY s.id")
def delivery_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of each subscription, those without any included."""
    got = table(spark, d, "deliveries").groupBy(F.col("subscription_id").alias("sub")).agg(F.count("item_id").alias("n"), F.count_distinct("item_id").alias("items"), F.max("delivered_at").alias("last_at"))
    return table(spark, d, "subscriptions").select(F.col("id").alias("sub")).join(got, "sub", "left").select("sub", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "items")], "last_at")


@query("SELECT subscription_id, item_id, min(delivered_at) AS delivered_at FROM deliveries GROUP BY ALL")
def first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Insert or ignore: the first of each pair's deliveries stands."""
    return table(spark, d, "deliveries").groupBy("subscription_id", "item_id").agg(F.min("delivered_at").alias("delivered_at"))


@query("SELECT subscription_id, item_id, delivered_at FROM (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY delivered_at DESC NULLS LAST, item_id DESC) AS n FROM (SELECT DISTINCT subscription_id, item_id, delivered_at FROM deliveries)) WHERE n <= 3")
def last_three(spark: SparkSession, d: str) -> DataFrame:
    """The last three turns of each subscription."""
    w = Window.partitionBy("subscription_id").orderBy(F.desc_nulls_last("delivered_at"), F.desc("item_id"))
    turns = table(spark, d, "deliveries").select("subscription_id", "item_id", "delivered_at").distinct()
    return turns.withColumn("n", F.row_number().over(w)).where("n <= 3").drop("n")


@query("""SELECT raw_id, url, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, raw_id DESC) AS n FROM raw_items) WHERE n = 1""")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Upsert over an append-only log: the last row of each address."""
    return feed.latest(table(spark, d, "raw_items").select("raw_id", "url", "fetched_at"), ["url"], ["fetched_at", "raw_id"])


@query("""WITH o AS (SELECT source_id, (coalesce(content_state, '') = 'failed') AS bad, sum(CASE WHEN coalesce(content_state, '') = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY fetched_at DESC NULLS LAST, raw_id DESC ROWS UNBOUNDED PRECEDING) AS good FROM raw_items WHERE source_id IS NOT NULL)
 SELECT source_id, count_if(bad AND good = 0) AS streak FROM o GROUP BY source_id""")
def error_streaks(spark: SparkSession, d: str) -> DataFrame:
    """How many failed fetches end each source's log."""
    return feed.open_streaks(table(spark, d, "raw_items").where("source_id is not null"), "source_id", ["fetched_at", "raw_id"], F.coalesce("content_state", F.lit("")) == "failed")


@query("""SELECT coalesce(s.id, -1) AS source_id, count(*) AS fetched, count(DISTINCT r.url) AS addresses, count_if(coalesce(r.text, '') = '') AS empty, count_if(r.content_state = 'failed') AS failed, max(r.fetched_at) AS last_at FROM raw_items r LEFT JOIN sources s ON s.id = r.source_id GROUP BY ALL""")
def ingest_run_totals(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "raw_items").join(table(spark, d, "sources").select(F.col("id").alias("source_id"), F.lit(1).alias("known")), "source_id", "left")
    keyed = joined.select(F.when(F.col("known") == 1, F.col("source_id")).otherwise(-1).alias("source_id"), "url", "text", "content_state", "fetched_at")
    return keyed.groupBy("source_id").agg(F.count("*").alias("fetched"), F.count_distinct("url").alias("addresses"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty"), F.count_if(F.col("content_state") == "failed").alias("failed"), F.max("fetched_at").alias("last_at"))


@query("""SELECT coalesce(nullif(lang, ''), 'unknown') AS language, count(*) AS n, count(e.item_id) AS enriched, round(avg(word_count), 3) AS mean_words FROM items i LEFT JOIN enrichment e ON e.item_id = i.id GROUP BY ALL""")
def coverage_by_language(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "items").join(table(spark, d, "enrichment").select(F.col("item_id").alias("id"), F.lit(1).alias("have")), "id", "left")
    return joined.groupBy(X.first_text(F.col("lang"), F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"), F.count("have").alias("enriched"), F.round(F.avg("word_count"), 3).alias("mean_words"))


@query("""SELECT id FROM items WHERE NOT EXISTS (SELECT 1 FROM enrichment e WHERE e.item_id = items.id) AND coalesce(text, '') <> ''""")
def pending_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """What a provider must still be asked about: items with text and no memo."""
    return table(spark, d, "items").where(F.coalesce("text", F.lit("")) != "").join(table(spark, d, "enrichment").select(F.col("item_id").alias("id")), "id", "left_anti").select("id")


@query("""SELECT i.source_id, item_type, count(*) AS n, count_if(breakthrough) AS breakthroughs, max(impact_score) AS best, list_sort(list(DISTINCT content_class) FILTER (content_class IS NOT NULL)) AS classes FROM items i JOIN enrichment e ON e.item_id = i.id WHERE i.source_id IS NOT NULL GROUP BY ALL""")
def slice_tally(spark: SparkSession, d: str) -> DataFrame:
    """What each source's enriched items are."""
    joined = table(spark, d, "items").where("source_id is not null").select(F.col("id").alias("item_id"), "source_id").join(table(spark, d, "enrichment"), "item_id")
    return joined.groupBy("source_id", "item_type").agg(F.count("*").alias("n"), F.count_if("breakthrough").alias("breakthroughs"), F.max("impact_score").alias("best"), F.array_sort(F.collect_set("content_class")).alias("classes"))


@query("""SELECT item_id, string_agg(w, ' ' ORDER BY pos) AS text FROM (SELECT id AS item_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT id, regexp_extract_all(title, '[^\\s]+') AS ws FROM items WHERE title IS NOT NULL)) GROUP BY item_id""")
def invert_abstract(spark: SparkSession, d: str) -> DataFrame:
    """Texts from an index of words and their places, as one source delivers abstracts."""
    words = F.regexp_extract_all("title", F.lit(r"([^\s]+)"), F.lit(1))
    placed = table(spark, d, "items").where("title is not null").select(F.col("id").alias("item_id"), F.posexplode(words).alias("place", "word"))
    index = placed.groupBy("item_id", "word").agg(F.collect_list("place").alias("places")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    from feedmill.sources.readers import text_of_index

    return index.select("item_id", text_of_index(F.col("index")).alias("text"))


@query("""SELECT id, url, coalesce(nullif(e.headline, ''), nullif(i.title, ''), url) AS title, coalesce(e.summary, '') AS text, CASE WHEN coalesce(e.summary, '') <> '' THEN 'full' ELSE 'metadata_only' END AS state FROM items i LEFT JOIN enrichment e ON e.item_id = i.id WHERE coalesce(url, '') <> ''""")
def envelope_to_items(spark: SparkSession, d: str) -> DataFrame:
    """Items written as an agent feed's envelopes (JSON) and read back."""
    from feedmill.sources.readers import items_of_envelopes

    rendition = lambda t: F.when(F.coalesce(t, F.lit("")) != "", F.struct(t.alias("text")))
    item = F.struct(F.col("id").cast("string").alias("id"), "url", F.struct(rendition(F.col("headline")).alias("headline"), rendition(F.col("summary")).alias("brief")).alias("renditions"), "title")
    envelopes = _rows(spark, d).groupBy("source_id", F.pmod("id", F.lit(512)).alias("part")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("envelope"))
    return items_of_envelopes(envelopes.select("envelope")).select(F.col("id").cast("long").alias("id"), "url", "title", "text", "state")


@query("""SELECT item_id, name FROM (SELECT item_id, unnest(CASE WHEN json_valid(orgs) AND json_type(orgs) = 'ARRAY' THEN from_json(orgs, '["VARCHAR"]') ELSE [] END) AS name FROM enrichment)""")
def listed_names(spark: SparkSession, d: str) -> DataFrame:
    """JSON lists read forgivingly: broken, empty and null ones have no elements."""
    return table(spark, d, "enrichment").select("item_id", F.explode(F.from_json("orgs", "array<string>")).alias("name"))


@query("""SELECT lang AS language FROM (SELECT DISTINCT lang FROM items WHERE coalesce(lang, '') <> '') EXCEPT SELECT lang FROM documents""")
def languages_missing(spark: SparkSession, d: str) -> DataFrame:
    """Labels that items have and documents don't."""
    return table(spark, d, "items").where("coalesce(lang, '') <> ''").select(F.col("lang").alias("language")).subtract(table(spark, d, "documents").select(F.col("lang").alias("language")))


@query("""WITH m AS (SELECT item_id AS id, significance >= 3 AS passes FROM enrichment WHERE significance IS NOT NULL), c AS (SELECT id, text, fetched_at FROM items WHERE lang = 'en'),
 f AS (SELECT id, contains(lower(text), 'trout') AS passes FROM (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = c.id) ORDER BY fetched_at DESC, id LIMIT 24) WHERE coalesce(text, '') <> ''), k AS (SELECT * FROM m UNION ALL SELECT * FROM f)
 SELECT c.id, CASE WHEN k.passes THEN 'passing' WHEN NOT k.passes THEN 'rejected' ELSE 'deferred' END AS state FROM c LEFT JOIN k ON k.id = c.id""")
def verdict_memo_apply(spark: SparkSession, d: str) -> DataFrame:
    """A judged filter: stored verdicts, at most 24 new ones by the stand-in provider, the rest withheld."""
    from feedmill.operators.judge import apply_judged, words_provider

    memo = table(spark, d, "enrichment").where("significance is not null").select(F.col("item_id").alias("id"), (F.col("significance") >= 3).alias("passes"))
    candidates = table(spark, d, "items").where("lang = 'en'").select("id", "text", "fetched_at")
    return apply_judged(candidates, memo, "trout", words_provider, [F.desc("fetched_at"), F.col("id")])[0]


def _scratch(spark: SparkSession) -> str:
    import uuid

    from feedmill.session import shared_dir

    return f"{shared_dir(spark).rstrip('/')}/feedmill-{uuid.uuid4().hex}"


@query(ORACLE["canonical_url_key"].rpartition(" SELECT raw_id, canonical, sha1")[0] + " SELECT DISTINCT sha1(canonical) AS url_key FROM c")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The addresses that a streaming ingest of the raw items keeps, taken in by several batches."""
    from feedmill.streaming.ingest import run_ingest

    at, path = _scratch(spark), f"{d}/raw_items.parquet*"
    files = len(table(spark, d, "raw_items").inputFiles())
    if files < INGEST_BATCHES:  # a stream can't split a file
        path, files = f"{at}/raw", INGEST_BATCHES
        table(spark, d, "raw_items").repartitionByRange(files, "raw_id").write.parquet(path)
    run_ingest(spark, path, f"{at}/out", f"{at}/state", -(-files // INGEST_BATCHES))
    return spark.read.parquet(f"{at}/out").select("url_key")


@query("SELECT DISTINCT subscription_id, item_id FROM deliveries")
def stream_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """What a stream of offers with repeats delivers."""
    from feedmill.streaming.ingest import deliver

    at = _scratch(spark)
    path = f"{d}/deliveries.parquet*"  # as a pattern it may be a file or a directory
    deliver(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("subscription_id", "item_id")
