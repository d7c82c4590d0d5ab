"""Queries on reading state, collections, packs of context, checks and pending work, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedmill.functions import answers as A
from feedmill.functions import text as X
from feedmill.operators import digest, feed, packs, search
from feedmill.plans.registry import _ASKED, _HAY_SQL, _ROUTE_SQL, _ROWS_SQL, _RULES, _TAGS_SQL, PACK, _asked, _routed, _rows, _tags, _vectors, query
from feedmill.tables import spread, table

# The tables hold no reader's state: a delivery stands for reading an item, and a subscription for a collection of what it got.
_READS_SQL = "reads AS (SELECT item_id AS id, min(delivered_at) AS read_at FROM deliveries GROUP BY item_id)"
_FAVOURITES_SQL = "favourite AS (SELECT min(id) AS sub FROM subscriptions WHERE active)"
_TOKENS = "CASE WHEN coalesce(length({0}), 0) = 0 THEN 0 ELSE least(length({0}) // 4 + 1, 1000000) END"
_SPEC = "query string, languages array<string>, max_tokens bigint, max_items bigint"


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return feed.first_reads(table(spark, d, "deliveries").select(F.col("item_id").alias("id"), F.col("delivered_at").alias("read_at")))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries as collections; the first active subscription's are the favourites, the last one's the archive."""
    ends = table(spark, d, "subscriptions").where("active").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    named = F.when(F.col("subscription_id") == F.col("first"), feed.FAVOURITES).when(F.col("subscription_id") == F.col("last"), feed.ARCHIVE).otherwise(F.col("subscription_id"))
    return table(spark, d, "deliveries").join(F.broadcast(ends)).select(named.alias("collection"), F.col("item_id").alias("id"))


@query(f"WITH {_READS_SQL} SELECT id, read_at FROM reads")
def first_reads(spark: SparkSession, d: str) -> DataFrame:
    """Marking read again keeps the first time."""
    return _reads(spark, d)


@query(f"""WITH {_ROWS_SQL}, {_READS_SQL} SELECT rows.id, seen_at, count(*) OVER () AS total FROM rows LEFT JOIN reads ON reads.id = rows.id WHERE read_at IS NULL AND coalesce(enrich_state, '') <> 'skipped' AND coalesce(impact_score, 0) >= 5 ORDER BY seen_at, rows.id LIMIT 50""")
def unread_oldest_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of what is unread, oldest first, with the number of rows on all pages."""
    f = feed.Filter.read({"unread": True, "min_impact": 5})
    rows = feed.feed_rows(table(spark, d, "items"), table(spark, d, "sources"), table(spark, d, "enrichment"), _reads(spark, d)).where(f.condition()).select("id", "seen_at")
    return feed.page(rows, [F.col("seen_at"), F.col("id")], 50)


@query(f"""WITH {_ROWS_SQL} SELECT id FROM rows WHERE coalesce(enrich_state, '') <> 'skipped' AND seen_at >= TIMESTAMP '2025-06-03' - INTERVAL 30 DAYS AND seen_at < TIMESTAMP '2025-06-03' AND item_type IN ('news', 'market') AND content_class = 'substantive'""")
def last_days(spark: SparkSession, d: str) -> DataFrame:
    f = feed.Filter.read({"last_days": 30, "as_of": "2025-06-03", "until": "2025-06-03", "item_types": ["news", "market"], "content_classes": ["substantive"]})
    return _rows(spark, d).where(f.condition()).select("id")


@query(f"WITH {_ROWS_SQL} SELECT id, enrich_state FROM rows WHERE enrich_state = 'skipped' AND seen_at >= TIMESTAMP '2024-01-01'")
def off_topic_only(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).where(feed.Filter.read({"off_topic": "only", "since": "2024-01-01"}).condition()).select("id", "enrich_state")


@query(f"""WITH {_ROWS_SQL}, {_FAVOURITES_SQL}, archive AS (SELECT max(id) AS sub FROM subscriptions WHERE active) SELECT id FROM rows WHERE coalesce(enrich_state, '') <> 'skipped' AND id IN (SELECT item_id FROM deliveries, favourite WHERE subscription_id = sub) AND id NOT IN (SELECT item_id FROM deliveries, archive WHERE subscription_id = sub)""")
def starred_items(spark: SparkSession, d: str) -> DataFrame:
    """What is in the favourites and not archived."""
    f = feed.Filter.read({"starred": True})
    return f.apply(_rows(spark, d), _tags(spark, d), _members(spark, d)).select("id")


@query("SELECT collection, n FROM (SELECT subscription_id AS collection, count(DISTINCT item_id) AS n FROM deliveries GROUP BY 1) ORDER BY n DESC, collection LIMIT 1")
def top_collection(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "deliveries").groupBy(F.col("subscription_id").alias("collection")).agg(F.count_distinct("item_id").alias("n"))
    return sizes.orderBy(F.desc("n"), "collection").limit(1)


@query("SELECT subscription_id AS sub, count(DISTINCT item_id) + 1 AS next_position FROM deliveries GROUP BY 1")
def next_positions(spark: SparkSession, d: str) -> DataFrame:
    """The place after the last in each collection."""
    placed = table(spark, d, "deliveries").groupBy(F.col("subscription_id").alias("sub"), "item_id").agg(F.min("delivered_at").alias("at")).withColumn("position", F.row_number().over(Window.partitionBy("sub").orderBy(F.asc_nulls_last("at"), "item_id")))
    return placed.groupBy("sub").agg((F.max("position") + 1).cast("long").alias("next_position"))


@query(f"{_ROUTE_SQL}, topics AS (SELECT unnest({[r.topic for r in _RULES] + ['nothing']}) AS topic) SELECT topic, count(id) AS n, coalesce(round(max(score), 2), 0) AS best FROM topics LEFT JOIN routed USING (topic) GROUP BY topic")
def topic_totals(spark: SparkSession, d: str) -> DataFrame:
    """Each topic's number of items, topics without any included."""
    nothing = feed.Rule("nothing", include=("zzyzx",))
    topics = spark.createDataFrame([(r.topic,) for r in [*_RULES, nothing]], "topic string")
    found = _routed(spark, d).groupBy("topic").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return topics.join(found, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(0.0)).alias("best"))


@query(f"{_ROUTE_SQL} SELECT topic, id, impact_score, seen_at FROM (SELECT topic, id, impact_score, seen_at, row_number() OVER (PARTITION BY topic ORDER BY impact_score DESC NULLS LAST, seen_at DESC, id) AS n FROM routed JOIN r USING (id)) WHERE n <= 20")
def topic_read_impact(spark: SparkSession, d: str) -> DataFrame:
    """The items of each topic with the greatest impact, then the newest."""
    rows = _rows(spark, d).select("id", "impact_score", "seen_at")
    ranked = Window.partitionBy("topic").orderBy(F.desc_nulls_last("impact_score"), F.desc("seen_at"), "id")
    return _routed(spark, d).join(rows, "id").withColumn("n", F.row_number().over(ranked)).where("n <= 20").select("topic", "id", "impact_score", "seen_at")


_SEEDS = ("trout", "vessels", "grid owner")


@query(f"{_ROUTE_SQL} SELECT topic, id FROM (SELECT topic, id, regexp_extract(why, 'include:([^;]*)', 1) AS fired FROM routed) WHERE fired <> '' AND NOT list_has_any(string_split(fired, ','), {list(_SEEDS)})")
def topic_weak_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches by included words none of which is one that the topic was made from."""
    return feed.weak_matches(_routed(spark, d), _SEEDS).select("topic", "id")


@query(f"""WITH {_ROWS_SQL}, {_TAGS_SQL}, r AS (SELECT id, title, {_HAY_SQL} AS haystack FROM rows) SELECT id, title, n::DOUBLE AS score FROM (SELECT id, title, len(list_filter(['trout', 'ferry trips', 'smolt'], lambda p: regexp_matches(haystack, '(^|[^\\p{{L}}\\p{{N}}_])' || p || '($|[^\\p{{L}}\\p{{N}}_])'))) AS n FROM r) WHERE n > 0 ORDER BY n DESC, id LIMIT 5""")
def draft_preview(spark: SparkSession, d: str) -> DataFrame:
    """The five best matches of a rule that is being drafted."""
    rule = feed.Rule.read("draft", '{"include": ["trout", "ferry trips", "smolt"]}')
    rows = _rows(spark, d).withColumn("haystack", X.haystack(*map(F.col, ("title", "headline", "summary", "text"))))
    best = feed.route(rows.withColumn("impact_score", F.lit(0.0)).withColumn("tags", F.lit(None).cast("map<string,array<string>>")).withColumn("entities", F.lit(None).cast("array<string>")), [rule])
    return best.orderBy(F.desc("score"), "id").limit(5).join(rows.select("id", "title"), "id").select("id", "title", "score")


_VERDICTS_SQL = "verdicts AS (SELECT item_id AS id, coalesce(model, '') AS filter, significance >= 3 AS passes, created_at FROM enrichment WHERE significance IS NOT NULL)"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enrichment").where("significance is not null").select(F.col("item_id").alias("id"), F.coalesce("model", F.lit("")).alias("filter"), (F.col("significance") >= 3).alias("passes"), "created_at")


@query(f"WITH {_VERDICTS_SQL} SELECT filter, count(*) AS judged, count_if(passes) AS passed FROM verdicts GROUP BY filter")
def filter_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many items each filter judged and let pass."""
    return _verdicts(spark, d).groupBy("filter").agg(F.count("*").alias("judged"), F.count_if("passes").alias("passed"))


@query(f"WITH {_VERDICTS_SQL} SELECT v.filter, i.id, i.title, s.name AS source, v.created_at FROM verdicts v JOIN items i ON i.id = v.id LEFT JOIN sources s ON s.id = i.source_id WHERE NOT v.passes ORDER BY v.created_at DESC NULLS LAST, i.id LIMIT 50")
def rejection_log(spark: SparkSession, d: str) -> DataFrame:
    """The last fifty items that a filter rejected."""
    items = table(spark, d, "items").select("id", "title", "source_id")
    sources = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    last = _verdicts(spark, d).where("not passes").join(items, "id").orderBy(F.desc_nulls_last("created_at"), "id").limit(50)
    return last.join(sources, "source_id", "left").select("filter", "id", "title", "source", "created_at")


_OBSERVED_SQL = """seen AS (SELECT i.source_id, i.id, CASE WHEN e.significance >= 3.5 THEN 'supportive' WHEN e.significance < 2 THEN 'adverse' WHEN e.significance < 2.8 THEN 'mixed' ELSE 'neutral' END AS direction, CASE WHEN i.source_id % 2 = 0 THEN 'buy' ELSE 'reduce' END AS call
 FROM items i JOIN enrichment e ON e.item_id = i.id WHERE i.source_id IS NOT NULL AND e.significance IS NOT NULL)"""


@query(f"""WITH {_OBSERVED_SQL}, t AS (SELECT source_id, call, count_if(direction = 'supportive') AS supportive, count_if(direction = 'adverse') AS adverse, count_if(direction = 'mixed') AS mixed, count_if(direction = 'neutral') AS neutral FROM seen GROUP BY ALL)
 SELECT *, CASE WHEN call = 'buy' AND adverse > supportive OR call = 'reduce' AND supportive > adverse THEN 'conflict' ELSE '' END AS stance FROM t""")
def stance_tally(spark: SparkSession, d: str) -> DataFrame:
    """Observations of each source by direction, and whether a call goes against them."""
    e = table(spark, d, "enrichment").where("significance is not null").select(F.col("item_id").alias("id"), "significance")
    at = F.col("significance")
    direction = F.when(at >= 3.5, "supportive").when(at < 2, "adverse").when(at < 2.8, "mixed").otherwise("neutral")
    call = F.when(F.col("source_id") % 2 == 0, "buy").otherwise("reduce")
    seen = table(spark, d, "items").where("source_id is not null").select("id", "source_id").join(e, "id").select("source_id", call.alias("call"), direction.alias("direction"))
    tally = seen.groupBy("source_id", "call").agg(*[F.count_if(F.col("direction") == x).alias(x) for x in ("supportive", "adverse", "mixed", "neutral")])
    total = F.col("supportive") + F.col("adverse") + F.col("mixed") + F.col("neutral")
    return tally.withColumn("stance", A.stance_conflict(F.col("call"), F.col("supportive"), F.col("adverse"), total))


@query("""WITH got AS (SELECT subscription_id AS sub, list_sort(list_distinct(list(item_id))) AS ids FROM deliveries GROUP BY 1), known AS (SELECT source_id, list_sort(list(id)) AS valid FROM items WHERE source_id IS NOT NULL GROUP BY 1)
 SELECT sub, source_id, list_sort(list_intersect(ids, valid))[1:6] AS kept FROM got JOIN known ON list_has_any(ids, valid)""")
def citations_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each subscription's cited items those that a source really has, at most six; pairs without any are left out."""
    cited = table(spark, d, "deliveries").select(F.col("subscription_id").alias("sub"), F.col("item_id").alias("id")).distinct()
    return feed.first_of(cited.join(table(spark, d, "items").where("source_id is not null").select("id", "source_id"), "id"), ["sub", "source_id"], "id", 6, "kept")


@query(f"""WITH l AS (SELECT CASE WHEN coalesce(e.summary, '') <> '' THEN 'summary' WHEN coalesce(i.excerpt, '') <> '' THEN 'excerpt' WHEN coalesce(i.text, '') <> '' THEN 'text' ELSE 'none' END AS layer FROM items i LEFT JOIN enrichment e ON e.item_id = i.id) SELECT layer, count(*) AS n FROM l GROUP BY layer""")
def layer_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How many items are read by which layer of text."""
    layers = F.coalesce(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", c) for c in ("summary", "excerpt", "text")], F.lit("none"))
    return _rows(spark, d).groupBy(layers.alias("layer")).agg(F.count("*").alias("n"))


_ABSTRACTS_SQL = "abstracts AS (SELECT item_id AS id, 'en' AS lang, summary AS body FROM enrichment WHERE coalesce(summary, '') <> '' UNION ALL SELECT id, lang, excerpt FROM items WHERE coalesce(excerpt, '') <> '' AND coalesce(lang, '') NOT IN ('', 'en'))"


@query(f"""WITH {_ABSTRACTS_SQL}, best AS (SELECT id, lang, body FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (lang = 'no') DESC, lang) AS n FROM abstracts) WHERE n = 1)
 SELECT i.id, CASE WHEN b.id IS NOT NULL THEN 'abstract' WHEN coalesce(i.excerpt, '') <> '' THEN 'excerpt' ELSE 'none' END AS layer, b.lang AS lang, coalesce(b.body, nullif(i.excerpt, '')) AS body FROM items i LEFT JOIN best b ON b.id = i.id""")
def context_preferred(spark: SparkSession, d: str) -> DataFrame:
    """Each item's abstract in the reader's language (Norwegian), else in any, else its excerpt."""
    summaries = table(spark, d, "enrichment").where("coalesce(summary, '') <> ''").select(F.col("item_id").alias("id"), F.lit("en").alias("lang"), F.col("summary").alias("body"))
    excerpts = table(spark, d, "items").where("coalesce(excerpt, '') <> '' and coalesce(lang, '') not in ('', 'en')").select("id", "lang", F.col("excerpt").alias("body"))
    best = feed.preferred(summaries.unionByName(excerpts), "no")
    items = table(spark, d, "items").select("id", F.nullif("excerpt", F.lit("")).alias("excerpt")).join(best.withColumn("found", F.lit(True)), "id", "left")
    return items.select("id", F.when(F.col("found"), "abstract").when(F.col("excerpt").isNotNull(), "excerpt").otherwise("none").alias("layer"), "lang", F.coalesce("body", "excerpt").alias("body"))


@query(f"""{_ROUTE_SQL}, ranked AS (SELECT topic, id, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS n FROM routed), costed AS (SELECT topic, id, n, {_TOKENS.format("(coalesce(nullif(e.headline, ''), i.title, '') || ' ' || coalesce(e.summary, ''))")} AS cost FROM ranked JOIN items i USING (id) LEFT JOIN enrichment e ON e.item_id = i.id WHERE n <= 14),
 spent AS (SELECT *, sum(cost) OVER (PARTITION BY topic ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM costed) SELECT topic, id, cost::BIGINT AS cost, spent FROM spent WHERE spent <= 600 OR n = 1""")
def digest_pack(spark: SparkSession, d: str) -> DataFrame:
    """Each topic's best items within 600 tokens and 14 items; the first stays whatever it costs."""
    rows = _rows(spark, d).select("id", X.estimate_tokens(F.concat_ws(" ", F.coalesce(X.first_text(F.col("headline"), F.col("title")), F.lit("")), F.coalesce("summary", F.lit("")))).cast("long").alias("cost"))
    return feed.pack_prefix(_routed(spark, d).join(rows, "id"), "topic", [F.desc("score"), F.col("id")], "cost", F.lit(600), F.lit(14), keep_first=True, cap=14).select("topic", "id", "cost", "spent")


@query()
def digest_select(spark: SparkSession, d: str) -> DataFrame:
    """The same from each topic's 56 best, of which near copies (fingerprints of headline and summary within eight bits) are dropped first."""
    told = _rows(spark, d).select("id", F.concat_ws(" ", F.coalesce(X.first_text(F.col("headline"), F.col("title")), F.lit("")), F.coalesce("summary", F.lit(""))).alias("told"))
    return digest.select(_routed(spark, d).join(told, "id"), budget=600, most=14)


@query(f"""WITH r AS (SELECT i.source_id, i.id, e.impact_score, len(regexp_extract_all(coalesce(nullif(e.headline, ''), i.title, ''), '[^\\s]+')) + least(len(regexp_extract_all(coalesce(i.text, ''), '[^\\s]+')), 200) + 30 AS cost, row_number() OVER (PARTITION BY i.source_id ORDER BY e.impact_score DESC NULLS LAST, i.id) AS n FROM items i JOIN enrichment e ON e.item_id = i.id WHERE i.source_id IS NOT NULL),
 s AS (SELECT *, sum(cost) OVER (PARTITION BY source_id ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM r WHERE n <= 30) SELECT source_id, id, cost::BIGINT AS cost, spent FROM s WHERE spent <= 3000 OR n = 1""")
def ask_pack(spark: SparkSession, d: str) -> DataFrame:
    """What is read to answer a question about a source: its best items, 200 words of each, within 3,000 words and 30 items."""
    cost = X.word_count(F.coalesce(X.first_text(F.col("headline"), F.col("title")), F.lit(""))) + F.least(X.word_count(F.col("text")), F.lit(200)) + 30
    rows = table(spark, d, "items").where("source_id is not null").select("id", "source_id", "title", "text").join(table(spark, d, "enrichment").select(F.col("item_id").alias("id"), "headline", "impact_score"), "id")
    return feed.pack_prefix(rows.select("source_id", "id", "impact_score", cost.cast("long").alias("cost")), "source_id", [F.desc_nulls_last("impact_score"), F.col("id")], "cost", F.lit(3000), F.lit(30), keep_first=True, cap=30).select("source_id", "id", "cost", "spent")


@query()
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each document's paragraphs in pieces of at most 550 words."""
    pieces = spread(table(spark, d, "documents")).select("doc_id", F.posexplode(A.paragraphs_packed(F.col("text"))).alias("place", "piece"))
    return pieces.select("doc_id", "place", X.word_count(F.col("piece")).alias("words"))


@query("""SELECT id, array_to_string(regexp_extract_all(coalesce(text, ''), '[^\\s]+')[1:700], ' ') AS body FROM items WHERE coalesce(text, '') <> ''""")
def escalation_text(spark: SparkSession, d: str) -> DataFrame:
    """The first 700 words of each item's text, for the few that are read whole; empty ones are left out."""
    return table(spark, d, "items").where("coalesce(text, '') <> ''").select("id", F.array_join(F.slice(A.words_of(F.col("text")), 1, 700), " ").alias("body"))


@query("""SELECT i.id, concat_ws(chr(10), nullif(title, ''), nullif(headline, ''), nullif(summary, ''), nullif(array_to_string(regexp_extract_all(coalesce(text, ''), '[^\\s]+')[1:220], ' '), '')) AS told FROM items i LEFT JOIN enrichment e ON e.item_id = i.id""")
def text_to_embed(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("id", A.text_to_embed(*map(F.col, ("title", "headline", "summary", "text"))).alias("told"))


@query("""SELECT doc_id, floor(round(190 * CASE lang WHEN 'en' THEN 1.7 WHEN 'es' THEN 2.4 WHEN 'fr' THEN 2.4 WHEN 'it' THEN 2.4 WHEN 'pt' THEN 2.4 WHEN 'de' THEN 2.6 WHEN 'no' THEN 2.8 WHEN 'el' THEN 5.0 ELSE 3.2 END, 6))::INT + 320 AS budget, len(regexp_extract_all(coalesce(text, ''), '[^\\s\\p{Z}\\x{85}]+'))::INT AS words,
 coalesce(regexp_matches(rtrim(text, ' '), '[^.!?…。！？؟।"'')»”』」]$', 's'), false) AS cut FROM documents""")
def answer_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The token budget by language, the length, and whether the text ends in the middle of a sentence."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", A.token_budget(F.col("lang")).alias("budget"), A.length_in_words(t, F.col("lang")).cast("int").alias("words"), A.looks_truncated(t).alias("cut"))


@query("""SELECT doc_id, coalesce(regexp_matches(text, '(?i)^\\s*(?:okay|ok|alright|so|right|hmm|let me|let''s|first,|i need to|i should|i''ll|the user wants|the user is asking|we need to|to write this)($|\\W)')
 OR length(trim(text)) > 120 AND lang = 'el' AND len(regexp_extract_all(text, '[A-Za-z]')) / greatest(len(regexp_extract_all(text, '\\p{L}')), 1) > 0.92, false) AS leaked FROM documents""")
def leaked_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", A.looks_like_reasoning(F.col("text"), F.col("lang")).alias("leaked"))


@query("""SELECT i.id, CASE WHEN regexp_matches(rtrim(t, ' '), '[^.!?…。！？؟।"'')»”』」]$', 's') AND len(regexp_extract_all(c, '[^\\s]+')) >= 76 THEN c ELSE t END AS told FROM (SELECT id, text AS t, coalesce(nullif(regexp_extract(rtrim(text, ' '), '^(..*[.!?…。！？؟।])', 1, 's'), ''), rtrim(text, ' ')) AS c FROM items WHERE text IS NOT NULL) i""")
def finished_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut in the middle of a sentence, led back to the last whole one."""
    return table(spark, d, "items").where("text is not null").select("id", A.finished(F.col("text"), F.lit("en")).alias("told"))


@query("""SELECT DISTINCT json_extract_string(spec, '$.query') AS query, CASE WHEN trim(json_extract_string(spec, '$.query')) = '' THEN [] ELSE list_filter([regexp_replace(lower(trim(json_extract_string(spec, '$.query'))), '^(the|a|an|about|on|in|of)\\s+', '')], lambda p: length(p) >= 3 AND len(string_split(p, ' ')) <= 5) END AS seeds FROM subscriptions WHERE NOT regexp_matches(lower(json_extract_string(spec, '$.query')), '[,;/"]| and | or | plus |^(i|just|want|read|see|get|news|let|me|to|on|about) ')""")
def query_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The phrases of each subscription's query; queries with conjunctions or quotes are in the tests."""
    q = F.from_json("spec", _SPEC)["query"]
    asked = table(spark, d, "subscriptions").select(q.alias("query")).where("query is not null").distinct()
    plain = asked.where(~F.lower("query").rlike(r'[,;/"]| and | or | plus |^(i|just|want|read|see|get|news|let|me|to|on|about) '))
    return plain.select("query", A.seed_phrases(F.col("query")).alias("seeds"))


@query("""SELECT id, list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:8] AS terms FROM (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) > 3) AS ws FROM sources)""")
def probe_words(spark: SparkSession, d: str) -> DataFrame:
    """The words that each source's name can be recognised by, each once, in their order."""
    none = F.lit(None).cast("array<string>")
    return table(spark, d, "sources").select("id", A.probe_terms(none, none, none, F.col("name")).alias("terms"))


@query("""SELECT id, CASE WHEN u = '' THEN [] WHEN regexp_matches(u, '^https?://') THEN [u] ELSE list_concat(['https://' || u], CASE WHEN u LIKE 'www.%' THEN [] ELSE ['https://www.' || u] END) END AS candidates FROM (SELECT id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS u FROM sources WHERE url LIKE '%://%.%')""")
def source_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The addresses that each source's host may be meant by."""
    return table(spark, d, "sources").where("url like '%://%.%'").select("id", A.candidate_urls(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("candidates"))


@query("SELECT raw_id, strftime(date_trunc('second', fetched_at), '%Y-%m-%dT%H:%M:%S+00:00') AS fetched FROM raw_items")
def instants_as_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").select("raw_id", A.iso(F.col("fetched_at")).alias("fetched"))


_WORD = "(^|[^\\p{{L}}\\p{{N}}_])({0})($|[^\\p{{L}}\\p{{N}}_])"


def _named_sql(words) -> str:
    return f"regexp_matches(lower(text), '{_WORD.format('|'.join(words))}')"


_PRIMARY_SQL = " + ".join(f"{_named_sql(names)}::INT" for _, first, terms in PACK.facets.values() if first for names in terms.values())


@query(f"""SELECT id, coalesce({_named_sql(PACK.strong)} OR {_named_sql([a for alone, names in PACK.orgs.values() if alone for a in names])} OR h > 1 OR h = 1 AND {_named_sql(PACK.weak)}, false) AS relevant FROM (SELECT id, text, {_PRIMARY_SQL} AS h FROM items)""")
def relevance_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether an item belongs to the pack's subject."""
    return spread(table(spark, d, "items")).select("id", PACK.relevant(F.col("text")).alias("relevant"))


@query(f"""WITH h AS (SELECT i.id, coalesce({_PRIMARY_SQL}, 0) AS hits, coalesce(i.enrich_state, '') <> 'skipped' AS ok, content_class, significance, confidence FROM items i JOIN enrichment e ON e.item_id = i.id)
 SELECT id, coalesce(content_class, '') <> 'not_article' AND (ok OR hits > 0) AS relevant, CASE WHEN coalesce(content_class, '') <> 'not_article' AND NOT ok AND hits > 0 THEN least(significance, 1.5) ELSE significance END AS significance, CASE WHEN coalesce(content_class, '') <> 'not_article' AND NOT ok AND hits > 0 THEN least(confidence, 0.5) ELSE confidence END AS confidence FROM h""".replace("lower(text)", "lower(i.text)"))
def relevance_override(spark: SparkSession, d: str) -> DataFrame:
    """Rejected items that the vocabulary names stay, at low weight."""
    primary = [names for _, first, terms in PACK.facets.values() if first for names in terms.values()]
    hits = F.lit(0)
    for names in primary:
        hits = hits + F.coalesce(X.any_phrase(F.col("text"), names), F.lit(False)).cast("int")
    rows = _rows(spark, d).join(table(spark, d, "enrichment").select(F.col("item_id").alias("id")), "id", "left_semi")
    made = A.relevance(F.coalesce("enrich_state", F.lit("")) != "skipped", F.col("content_class"), hits, F.lit(False), F.col("significance"), F.col("confidence"))
    return rows.select("id", made.alias("r")).select("id", "r.*")


@query(f"""SELECT raw_id, regexp_matches(lower(coalesce(url, '')), '{"|".join(h.replace(".", "[.]") for h in packs.FARM_HOSTS)}') AS farm, regexp_matches(concat_ws(' ', title, url), '(?i){packs.MARKET_SPAM}') AS spam FROM raw_items""")
def source_hygiene(spark: SparkSession, d: str) -> DataFrame:
    """Which raw items come from report sellers or are market reports by their title."""
    return table(spark, d, "raw_items").select("raw_id", packs.content_farm(F.col("url")).alias("farm"), packs.market_spam(F.col("title"), F.col("url")).alias("spam"))


@query("""SELECT raw_id FROM raw_items WHERE NOT coalesce(TRY_CAST(regexp_extract(published_at, '^(\\d{4}-\\d{2}-\\d{2})T\\d{2}:\\d{2}', 1) AS DATE) < DATE '2025-06-03' - 63, false)""")
def fresh_enough(spark: SparkSession, d: str) -> DataFrame:
    """What an ingest on 3 June 2025 would take: at most three times 21 days old, or undated."""
    day = F.regexp_extract("published_at", r"^(\d{4}-\d{2}-\d{2})T\d{2}:\d{2}", 1).try_cast("date")
    return feed.not_older(table(spark, d, "raw_items").withColumn("day", day), "day", F.lit("2025-06-03").cast("date"), 63).select("raw_id")


@query("""SELECT 'enrich' AS what, id FROM items WHERE enrich_state IN ('pending', 'failed') UNION ALL SELECT 'embed', id FROM items WHERE id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'translate', id FROM items WHERE coalesce(lang, 'en') NOT IN ('en', '') AND coalesce(translate_state, '') <> 'done'
 UNION ALL SELECT 'abstract', id FROM items WHERE id NOT IN (SELECT item_id FROM enrichment WHERE coalesce(summary, '') <> '')""")
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    """What each stage has still to do."""
    items = table(spark, d, "items").select("id", "lang", "enrich_state", "translate_state")
    have = table(spark, d, "enrichment").where("coalesce(summary, '') <> ''").select(F.col("item_id").alias("id"))
    todo = {
        "enrich": items.where("enrich_state in ('pending', 'failed')"), "embed": items.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti"),
        "translate": items.where("coalesce(lang, 'en') not in ('en', '') and coalesce(translate_state, '') <> 'done'"), "abstract": items.join(have, "id", "left_anti"),
    }
    parts = [rows.select(F.lit(what).alias("what"), "id") for what, rows in todo.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH h AS (SELECT i.id, i.fetched_at, lower(concat_ws(' ', nullif(i.title, ''), nullif(e.summary, ''), nullif(i.text, ''))) AS hay FROM items i LEFT JOIN enrichment e ON e.item_id = i.id) SELECT id FROM h WHERE regexp_matches(hay, '(^|[^\\p{L}\\p{N}_])toll bridge($|[^\\p{L}\\p{N}_])') ORDER BY fetched_at DESC, id LIMIT 40""")
def filter_preview(spark: SparkSession, d: str) -> DataFrame:
    """The forty newest items that a phrase lets pass, before any judgement."""
    rows = _rows(spark, d)
    return rows.where(X.phrase(X.haystack(F.col("title"), F.col("summary"), F.col("text")), "toll bridge")).orderBy(F.desc("seen_at"), "id").limit(40).select("id")


@query("""WITH spec AS (SELECT id AS sub, lower(trim(json_extract_string(spec, '$.query'))) AS phrase FROM subscriptions WHERE active AND trim(coalesce(json_extract_string(spec, '$.query'), '')) <> ''), h AS (SELECT i.id, e.significance, lower(concat_ws(' ', i.title, i.text, e.summary)) AS hay FROM items i JOIN enrichment e ON e.item_id = i.id WHERE e.significance >= 2)
 SELECT sub, h.id FROM spec JOIN h ON contains(hay, phrase) AND NOT contains(hay, 'toll bridge') WHERE h.id > 10""")
def subscription_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Items after a cursor, of some significance, that have a subscription's phrase and not an excluded one."""
    q = F.lower(F.trim(F.from_json("spec", _SPEC)["query"]))
    phrases = table(spark, d, "subscriptions").where("active").select(F.col("id").alias("sub"), q.alias("phrase")).where("phrase <> ''")
    rows = _rows(spark, d).where("significance >= 2 and id > 10").select("id", F.lower(F.concat_ws(" ", "title", "text", "summary")).alias("hay")).where(~F.contains("hay", F.lit("toll bridge")))
    return feed.holding(rows, phrases, "sub")


@query("""WITH asked AS (SELECT id AS sub, unnest(coalesce(from_json(json_extract(spec, '$.languages'), '["VARCHAR"]'), [])) AS language FROM subscriptions) SELECT sub, 'no items in ' || string_agg(DISTINCT language, ', ' ORDER BY language) AS notice FROM asked WHERE language NOT IN (SELECT lang FROM items WHERE lang IS NOT NULL AND source_id = 1) GROUP BY sub""")
def subscription_notices(spark: SparkSession, d: str) -> DataFrame:
    """The languages that a subscription asks for and a source doesn't have."""
    asked = table(spark, d, "subscriptions").select(F.col("id").alias("sub"), F.explode(F.array_distinct(F.from_json("spec", _SPEC)["languages"])).alias("language"))
    known = table(spark, d, "items").where("source_id = 1 and lang is not null").select(F.col("lang").alias("language")).distinct()
    missing = asked.join(known, "language", "left_anti").groupBy("sub").agg(F.array_sort(F.collect_set("language")).alias("missing"))
    return missing.select("sub", F.concat(F.lit("no items in "), F.array_join("missing", ", ")).alias("notice"))


@query("""WITH o AS (SELECT source_id, (coalesce(content_state, '') = 'failed') AS bad, sum(CASE WHEN coalesce(content_state, '') = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY fetched_at DESC NULLS LAST, raw_id DESC ROWS UNBOUNDED PRECEDING) AS good FROM raw_items WHERE source_id IS NOT NULL),
 k AS (SELECT source_id, count_if(bad AND good = 0) AS streak FROM o GROUP BY source_id), n AS (SELECT source_id, count(DISTINCT url) AS fresh FROM raw_items GROUP BY 1)
 SELECT s.id, coalesce(streak, 0) AS streak, s.enabled AND coalesce(streak, 0) < 4 AS enabled, coalesce(s.items_total, 0) + coalesce(fresh, 0) AS items_total FROM sources s LEFT JOIN k ON k.source_id = s.id LEFT JOIN n ON n.source_id = s.id""")
def source_states(spark: SparkSession, d: str) -> DataFrame:
    """Sources after a run: error streak, disabled from four on, items counted up."""
    raw = table(spark, d, "raw_items").where("source_id is not null")
    streaks = feed.open_streaks(raw, "source_id", ["fetched_at", "raw_id"], F.coalesce("content_state", F.lit("")) == "failed")
    fresh = raw.groupBy("source_id").agg(F.count_distinct("url").alias("fresh"))
    return feed.after_run(table(spark, d, "sources"), streaks, fresh)


@query("""SELECT source_id, '{"fetched":' || count(*) || ',"failed":' || count_if(content_state = 'failed') || ',"empty":' || count_if(coalesce(text, '') = '') || '}' AS stats FROM raw_items WHERE source_id IS NOT NULL GROUP BY source_id""")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    """A run's row of the log for each source, with its counters as JSON."""
    counted = table(spark, d, "raw_items").where("source_id is not null").groupBy("source_id").agg(F.count("*").alias("fetched"), F.count_if(F.col("content_state") == "failed").alias("failed"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty"))
    return counted.select("source_id", F.to_json(F.struct("fetched", "failed", "empty")).alias("stats"))


@query("""WITH log AS (SELECT url, content_state = 'failed' AS dismissed, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, raw_id DESC) AS n FROM raw_items WHERE url IS NOT NULL), gone AS (SELECT url FROM log WHERE n = 1 AND dismissed) SELECT i.id FROM items i WHERE i.url IS NULL OR i.url NOT IN (SELECT url FROM gone)""")
def not_dismissed(spark: SparkSession, d: str) -> DataFrame:
    """Items whose address isn't dismissed: the last entry of a log of dismissing (a failed fetch) and undoing (any other) stands."""
    log = table(spark, d, "raw_items").where("url is not null").select("url", "fetched_at", "raw_id", (F.col("content_state") == "failed").alias("dismissed"))
    gone = feed.latest(log, ["url"], ["fetched_at", "raw_id"]).where("dismissed").select("url")
    return table(spark, d, "items").select("id", "url").join(gone, "url", "left_anti").select("id")


@query(f"""WITH {_TAGS_SQL}, again AS (SELECT item_id FROM enrichment WHERE breakthrough), new AS (SELECT item_id AS id, 'type' AS facet, item_type AS term FROM enrichment WHERE breakthrough AND item_type IS NOT NULL)
 SELECT id, facet, term FROM tags WHERE id NOT IN (SELECT item_id FROM again) UNION ALL SELECT id, facet, term FROM new""")
def tags_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Rows replaced by item: what is enriched again loses its old tags and gets the new ones."""
    again = table(spark, d, "enrichment").where("breakthrough")
    new = again.where("item_type is not null").select(F.col("item_id").alias("id"), F.lit("type").alias("facet"), F.col("item_type").alias("term"))
    return feed.replaced(_tags(spark, d).select("id", "facet", "term"), new, again.select(F.col("item_id").alias("id")))


_KEYED = "regexp_replace(lower(trim(name)), '\\s+', ' ', 'g')"


@query(f"""SELECT key, n, display FROM (SELECT {_KEYED} AS key, count(*) AS n, min(name) AS display FROM entities WHERE coalesce(trim(name), '') <> '' GROUP BY 1) WHERE key LIKE 'ro%' ORDER BY n DESC, display LIMIT 40""")
def entity_listing(spark: SparkSession, d: str) -> DataFrame:
    """The most named entities whose key begins with what was typed."""
    key = F.regexp_replace(F.lower(F.trim("name")), r"\s+", " ")
    named = table(spark, d, "entities").where("coalesce(trim(name), '') <> ''").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("name").alias("display"))
    return named.where(F.startswith("key", F.lit("ro"))).orderBy(F.desc("n"), "display").limit(40)


@query(f"WITH {_TAGS_SQL}, c AS (SELECT facet, term, count(*) AS n FROM tags GROUP BY ALL) SELECT facet, list(term ORDER BY n DESC, term)[1:2] AS terms FROM c GROUP BY facet")
def facet_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return feed.top_terms(_tags(spark, d).groupBy("facet", "term").agg(F.count("*").alias("n")), 2)


@query("""SELECT id, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS words FROM (SELECT id, regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+') AS ws FROM items WHERE title IS NOT NULL)""")
def title_words(spark: SparkSession, d: str) -> DataFrame:
    """Each title's words, each once, in their order."""
    return table(spark, d, "items").where("title is not null").select("id", F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("words"))


@query(f"""SELECT i.id, CASE WHEN regexp_matches(published_at, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T') THEN 'exact' WHEN published_at IS NULL THEN 'none' ELSE 'read' END AS date_confidence, coalesce(nullif(e.headline, ''), nullif(i.title, ''), i.url) AS title, {_TOKENS.format("i.text")}::INT AS full_tokens, s.name AS source FROM items i LEFT JOIN enrichment e ON e.item_id = i.id LEFT JOIN sources s ON s.id = i.source_id WHERE coalesce(i.lang, '') IN ('en', 'no')""")
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    """Items as a feed hands them out, flattened: how sure the date is, the title, the price of the full text, the source; in the wanted languages."""
    made = feed.item_structs(_rows(spark, d).join(table(spark, d, "items").select("id", "published_at"), "id"), ("en", "no"))
    return made.select("id", "item.date_confidence", "item.title", F.coalesce(F.col("item.renditions")["full"]["tokens"], F.lit(0)).alias("full_tokens"), F.col("item.provenance.source").alias("source"))


@query(f"""SELECT source_id, string_agg('[' || id || '] ' || title, chr(10) ORDER BY id) AS listing FROM (SELECT source_id, id, title, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n FROM items WHERE source_id IS NOT NULL AND coalesce(title, '') <> '') WHERE n <= 10 GROUP BY source_id""")
def evidence_listing(spark: SparkSession, d: str) -> DataFrame:
    """The first ten items of each source as numbered lines."""
    rows = table(spark, d, "items").where("source_id is not null and coalesce(title, '') <> ''").select("source_id", "id", "title")
    return feed.listing(rows, "source_id", 10)


@query("""WITH newest AS (SELECT id FROM items ORDER BY fetched_at DESC, id LIMIT 12) SELECT (SELECT count(*) FROM newest) AS newest, (SELECT count(*) FROM newest WHERE id NOT IN (SELECT item_id FROM enrichment WHERE coalesce(summary, '') <> '')) AS without_abstract, (SELECT count(*) FROM subscriptions s WHERE NOT EXISTS (SELECT 1 FROM deliveries x WHERE x.subscription_id = s.id)) AS empty_collections""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """Whether the newest twelve items have abstracts, and which collections are empty."""
    newest = table(spark, d, "items").orderBy(F.desc("fetched_at"), "id").limit(12).select("id")
    have = table(spark, d, "enrichment").where("coalesce(summary, '') <> ''").select(F.col("item_id").alias("id"), F.lit(1).alias("have"))
    warm = newest.join(have, "id", "left").agg(F.count("*").alias("newest"), F.count_if(F.col("have").isNull()).alias("without_abstract"), F.lit(1).alias("k"))
    empty = table(spark, d, "subscriptions").select(F.col("id").alias("s")).join(table(spark, d, "deliveries").select(F.col("subscription_id").alias("s")), "s", "left_anti").agg(F.count("*").alias("empty_collections"), F.lit(1).alias("k"))
    return warm.join(empty, "k").drop("k")


@query("""SELECT raw_id, CASE WHEN content_state = 'metadata_only' OR n > 150 THEN 'kept' WHEN n >= 60 THEN 'full' WHEN coalesce(excerpt, '') <> '' THEN 'paywalled' ELSE 'failed' END AS state FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\s]+')) AS n FROM raw_items)""")
def body_states(spark: SparkSession, d: str) -> DataFrame:
    """What became of each raw item's body."""
    from feedmill.sources.readers import body_state

    return table(spark, d, "raw_items").select("raw_id", body_state(F.col("content_state"), F.col("text"), F.col("excerpt")).alias("state"))


@query(f"""WITH {_ASKED}, {_ROWS_SQL}, docs AS (SELECT * FROM rows WHERE lang IN ('en', 'no') AND coalesce(enrich_state, '') <> 'skipped'), named AS (SELECT DISTINCT query, unnest(list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1)) AS part FROM asked), sizes AS (SELECT query, count(*) AS parts FROM named GROUP BY query),
 toks AS MATERIALIZED (SELECT id, regexp_extract_all(lower(coalesce(title, '')), '[\\p{{L}}\\p{{N}}]+') AS a, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS b, regexp_extract_all(lower(coalesce(summary, '')), '[\\p{{L}}\\p{{N}}]+') AS c FROM docs), stat AS (SELECT count(*) AS n, avg(len(a) + len(b) + len(c)) AS mean FROM toks),
 flat AS (SELECT id, len(a) + len(b) + len(c) AS length, unnest(a) AS word, 8.0 AS w FROM toks UNION ALL SELECT id, len(a) + len(b) + len(c), unnest(b), 1.0 FROM toks UNION ALL SELECT id, len(a) + len(b) + len(c), unnest(c), 4.0 FROM toks),
 post AS (SELECT part, id, sum(w)::DOUBLE AS f, first(length) AS length FROM flat JOIN (SELECT DISTINCT part FROM named) ON starts_with(word, part) GROUP BY ALL), spread AS (SELECT part, count(*) AS df FROM post GROUP BY part),
 gain AS (SELECT query, id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) AS g FROM post JOIN spread USING (part) JOIN named USING (part), stat),
 scored AS (SELECT query, id, sum(g) AS score, count(*) AS hit, any_value(parts) AS parts FROM gain JOIN sizes USING (query) GROUP BY query, id), strict AS (SELECT query, max(hit = parts) AS strict FROM scored GROUP BY query),
 hits AS MATERIALIZED (SELECT query, id, score FROM scored JOIN strict USING (query) WHERE NOT strict OR hit = parts), kw AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM hits),
 inside AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (SELECT id FROM docs)), best AS (SELECT query, arg_min(e, {{'s': -score, 'i': id}}) AS e FROM hits JOIN inside USING (id) GROUP BY query),
 near AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(best.e, inside.e) DESC, id) AS rank FROM best, inside),
 fused AS (SELECT query, id, round(sum(part), 9) AS score FROM (SELECT query, id, 1.0 / (60 + rank) AS part FROM kw WHERE rank <= 60 UNION ALL SELECT query, id, 1.0 / (60 + rank) FROM near WHERE rank <= 60) GROUP BY query, id),
 paged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM fused) WHERE n <= 20) SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY seen_at DESC, id) AS place FROM paged JOIN docs USING (id)""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Each subscription's query over the filtered feed: keyword rank and vector rank fused, a page of twenty, the newest first."""
    docs = _rows(spark, d).where(feed.Filter.read({"languages": ["en", "no"]}).condition()).select("id", "seen_at", "title", "text", "summary")
    return search.hybrid(docs, _asked(spark, d), _vectors(spark, d), {"title": 8, "text": 1, "summary": 4})


@query(f"""{_ROUTE_SQL}, v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT topic, k, avg(x) AS x FROM (SELECT topic, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS k FROM routed JOIN v USING (id)) GROUP BY ALL), means AS (SELECT topic, list(x ORDER BY k) AS e FROM m GROUP BY topic),
 s AS (SELECT topic, v.id, list_cosine_similarity(v.e, means.e) AS score FROM means, v), kept AS (SELECT * FROM s WHERE score >= 0.1 AND NOT EXISTS (SELECT 1 FROM routed WHERE routed.topic = s.topic AND routed.id = s.id))
 SELECT topic, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS n FROM kept) WHERE n <= 60""")
def topic_recall(spark: SparkSession, d: str) -> DataFrame:
    """Items near to a topic's by their vectors that no word of its rule named; a judge must admit them."""
    return digest.recall(_routed(spark, d).select("topic", "id"), _vectors(spark, d), 60, 0.1).select("topic", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_ROWS_SQL}, {_TAGS_SQL}, {_READS_SQL}, page AS (SELECT id, title, seen_at, tags FROM rows WHERE coalesce(enrich_state, '') <> 'skipped' ORDER BY seen_at DESC, id LIMIT 30)
 SELECT page.id, title, read_at IS NULL AS unread, coalesce(CASE WHEN json_valid(page.tags) THEN from_json(page.tags, '["VARCHAR"]') END, []) AS source_tags, coalesce(list_sort(list(term) FILTER (facet = 'theme')), []) AS themes, coalesce(list_sort(list(term) FILTER (facet = 'region')), []) AS regions
 FROM page LEFT JOIN tags t ON t.id = page.id LEFT JOIN reads ON reads.id = page.id GROUP BY ALL""")
def hydrated_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of items with their tags by facet, the source's tags and whether they are unread."""
    page = _rows(spark, d).where(feed.Filter.read({}).condition()).select("id", "title", "seen_at", "source_tags").orderBy(F.desc("seen_at"), "id").limit(30)
    tags = feed.tag_map(_tags(spark, d).join(page.select("id"), "id", "left_semi"))
    none = F.array().cast("array<string>")
    made = page.join(tags, "id", "left").join(_reads(spark, d), "id", "left")
    return made.select("id", "title", F.col("read_at").isNull().alias("unread"), F.coalesce("source_tags", none).alias("source_tags"), *[F.array_sort(F.coalesce(F.col("tags")[f], none)).alias(key) for f, key in feed.FACET_KEYS.items()])


@query(f"""WITH {_READS_SQL} SELECT i.id, i.url, coalesce(nullif(e.headline, ''), i.title) AS title, i.text, s.name AS source FROM items i LEFT JOIN sources s ON s.id = i.source_id LEFT JOIN enrichment e ON e.item_id = i.id WHERE i.id = 42""")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One item with its whole text."""
    return _rows(spark, d).where("id = 42").select("id", "url", F.coalesce(F.nullif("headline", F.lit("")), "title").alias("title"), "text", "source")


@query(f"""WITH {_READS_SQL} SELECT (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM items WHERE id NOT IN (SELECT id FROM reads)) AS unread, (SELECT count(*) FROM items WHERE fetched_at >= TIMESTAMP '2025-06-02') AS fresh, (SELECT count(*) FROM sources WHERE enabled AND error_streak < 3) AS healthy""")
def health(spark: SparkSession, d: str) -> DataFrame:
    """Scalar counts of the whole state."""
    items = table(spark, d, "items").select("id", "fetched_at").join(_reads(spark, d).withColumn("read", F.lit(1)), "id", "left")
    counts = items.agg(F.count("*").alias("items"), F.count_if(F.col("read").isNull()).alias("unread"), F.count_if(F.col("fetched_at") >= F.lit("2025-06-02").cast("timestamp")).alias("fresh"), F.lit(1).alias("k"))
    sources = table(spark, d, "sources").agg(F.count_if(F.col("enabled") & (F.col("error_streak") < 3)).alias("healthy"), F.lit(1).alias("k"))
    return counts.join(sources, "k").drop("k")
