"""Keyword rank, vector rank and their fusion, for many queries at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmill.session import materialise

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def bm25(docs: DataFrame, queries: DataFrame, weights: dict[str, float], id_col: str = "id") -> DataFrame:
    """``query, id, score``: BM25 over weighted text columns, for documents that hold every term of the query.

    docs: ``id_col`` and the columns of ``weights``. queries: ``query`` (text). A term matches words equal to
    it. Frequencies are weighted sums over the columns, lengths count the words of all columns, and terms in more than
    half of the documents get a tiny weight. Only words that some query names leave the scan.
    """
    named = queries.select("query", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    sizes = named.groupBy("query").agg(F.count("*").alias("terms"))
    lists = [tokens(F.col(c)) for c in weights]
    split = docs.select(F.col(id_col).alias("id"), *[words.alias(f"w{k}") for k, words in enumerate(lists)])
    ends, bounds = F.lit(0), []
    for k in range(len(lists)):
        ends = ends + F.size(f"w{k}")
        bounds.append(ends)
    # the place of a word in all columns' words tells its column, and thereby its weight
    weight = F.lit(None).cast("double")
    for k, w in reversed(list(enumerate(weights.values()))):
        weight = F.when(F.col("place") < F.col(f"end{k}"), float(w)).otherwise(weight)
    sized = split.select("id", ends.alias("length"), *[b.alias(f"end{k}") for k, b in enumerate(bounds)], F.concat(*[f"w{k}" for k in range(len(lists))]).alias("all"))
    whole = sized.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    found = sized.select("id", "length", *[f"end{k}" for k in range(len(lists))], F.posexplode("all").alias("place", "term")).select("id", "length", "term", weight.alias("w"))
    # Spark broadcasts the terms while they are few, so that the other words never move
    found = found.join(named.select("term").distinct(), "term", "left_semi")
    postings = found.groupBy("term", "id").agg(F.sum("w").alias("f"), F.first("length").alias("length"))
    spread = postings.groupBy("term").agg(F.count("*").alias("df"))
    # the totals are one row, whatever the corpus
    weighted = postings.join(spread, "term").withColumn("one", F.lit(1)).join(F.broadcast(whole.withColumn("one", F.lit(1))), "one")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.when(idf > 0, idf).otherwise(1e-6) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = weighted.select("term", "id", gain.alias("gain")).join(named, "term").groupBy("query", "id").agg(F.sum("gain").alias("score"), F.count("*").alias("hit"))
    return scored.join(sizes, "query").where("hit = terms").select("query", "id", "score")


def top(ranked: DataFrame, k: int, by: str = "query", score: str = "score") -> DataFrame:
    """The ``k`` best rows of each group, with ``rank`` from 1; ties by id."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "id"))).where(F.col("rank") <= k)


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """``query, id, score``: the ``k`` rows of ``vectors`` (``id, vec``) with the greatest cosine to each of ``queries`` (``query, vec``), a query's own row left out.

    Blocks of rows meet blocks of queries by an equi-join on the query block; each meeting is one matrix
    product that keeps ``k`` rows a query, and a window picks the best of those.
    """
    query_blocks = queries.count() // block + 1
    packed = queries.select(F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int").alias("qb"), "query", "vec").groupBy("qb").agg(F.collect_list(F.struct("query", "vec")).alias("asked"))
    row_blocks = vectors.count() // block + 1
    rows = vectors.select(F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int").alias("rb"), "id", "vec").groupBy("rb").agg(F.collect_list(F.struct("id", "vec")).alias("held"))
    met = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).join(packed, "qb")

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)

    def product(batches):
        for batch in batches:
            for held, asked in zip(batch["held"], batch["asked"]):
                ids, qs = np.array([h["id"] for h in held]), np.array([a["query"] for a in asked])
                scores = unit(np.array([a["vec"] for a in asked], dtype=np.float64)) @ unit(np.array([h["vec"] for h in held], dtype=np.float64)).T
                scores[qs[:, None] == ids[None, :]] = -np.inf
                kept = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                yield pd.DataFrame({"query": np.repeat(qs, kept.shape[1]), "id": ids[kept].ravel(), "score": np.take_along_axis(scores, kept, axis=1).ravel()}).query("score > -2")

    return top(met.select("held", "asked").mapInPandas(product, "query bigint, id bigint, score double"), k)


def fuse(*ranked: DataFrame, k: int = 60) -> DataFrame:
    """``query, id, score``: reciprocal rank fusion of lists with ``query, id, rank`` (from 1)."""
    parts = [r.select("query", "id", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part")) for r in ranked]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("query", "id").agg(F.sum("part").alias("score"))


def parsed_queries(queries: DataFrame) -> DataFrame:
    """``query, part, phrase`` of ``query`` (text): its quoted phrases as words with a blank between them, and its other words of two letters or more, which stand for all words that begin so."""
    text = F.lower(F.coalesce("query", F.lit("")))
    clean = lambda t: F.array_join(tokens(t), " ")
    phrases = F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.struct(clean(p).alias("part"), F.lit(True).alias("phrase")))
    words = F.transform(F.filter(tokens(F.regexp_replace(text, '"[^"]*"', " ")), lambda w: F.length(w) > 1), lambda w: F.struct(w.alias("part"), F.lit(False).alias("phrase")))
    return queries.select("query", F.explode(F.array_distinct(F.concat(phrases, words))).alias("p")).select("query", "p.part", "p.phrase").where("part <> ''")


def keyword_search(docs: DataFrame, queries: DataFrame, weights: dict[str, float], id_col: str = "id") -> DataFrame:
    """``query, id, score``: BM25 over weighted columns with phrases and beginnings of words; documents with every part of a query, or, where there are none, with any.

    A part's frequency in a document is the weighted number of words that begin with it, or of places where the phrase stands; its
    document frequency counts the documents with any. Statistics are those of ``docs``, so a narrowed set is ranked within itself.
    Parts meet words by their first two letters, and phrases documents by their first word, in equi-joins.
    """
    parts = parsed_queries(queries)
    sizes = parts.groupBy("query").agg(F.count("*").alias("parts"))
    lists = docs.select(F.col(id_col).alias("id"), *[tokens(F.col(c)).alias(f"w{k}") for k, c in enumerate(weights)])
    length = sum((F.size(f"w{k}") for k in range(len(weights))), F.lit(0))
    counted = lists.select("id", length.alias("length"), *[f"w{k}" for k in range(len(weights))])
    whole = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))

    def weighed(k: int, weight: float) -> Column:
        return F.transform(f"w{k}", lambda w: F.struct(w.alias("word"), F.lit(weight).alias("w")))

    each = F.flatten(F.array(*[weighed(k, float(x)) for k, x in enumerate(weights.values())]))
    words = counted.select("id", "length", F.explode(each).alias("e")).select("id", "length", "e.word", "e.w")
    begun = parts.where("not phrase").select("part").distinct()
    heads = begun.select(F.substring("part", 1, 2).alias("head"), "part")
    # the other words never move: only those with some part's first two letters are left before the sum
    hits = words.withColumn("head", F.substring("word", 1, 2)).join(heads, "head").where(F.startswith("word", F.col("part"))).groupBy("part", "id").agg(F.sum("w").alias("f"), F.first("length").alias("length")).withColumn("phrase", F.lit(False))
    named = parts.where("phrase").select("part", F.split("part", " ").alias("ws")).distinct()
    places = lambda k: F.size(F.filter(F.transform(f"w{k}", lambda w, i: F.slice(F.col(f"w{k}"), i + 1, F.size("ws"))), lambda run: run == F.col("ws")))
    f = sum((places(k) * float(x) for k, x in enumerate(weights.values())), F.lit(0.0))
    first = counted.select("id", F.explode(F.array_distinct(F.concat(*[f"w{k}" for k in range(len(weights))]))).alias("first")).join(named.withColumn("first", F.get("ws", F.lit(0))), "first").select("id", "part", "ws")
    spoken = first.join(counted, "id").select("part", "id", f.alias("f"), "length", F.lit(True).alias("phrase")).where("f > 0")
    postings = hits.select("part", "id", "f", "length", "phrase").unionByName(spoken)
    spread = postings.groupBy("part", "phrase").agg(F.count("*").alias("df"))
    weighted = postings.join(spread, ["part", "phrase"]).withColumn("one", F.lit(1)).join(F.broadcast(whole.withColumn("one", F.lit(1))), "one")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.when(idf > 0, idf).otherwise(1e-6) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = weighted.select("part", "phrase", "id", gain.alias("gain")).join(parts, ["part", "phrase"]).groupBy("query", "id").agg(F.sum("gain").alias("score"), F.count("*").alias("hit")).join(sizes, "query")
    every = scored.groupBy("query").agg(F.max(F.col("hit") == F.col("parts")).alias("strict"))
    return scored.join(every, "query").where("not strict or hit = parts").select("query", "id", "score")


def hybrid(docs: DataFrame, queries: DataFrame, vectors: DataFrame, weights: dict[str, float], size: int = 20, pool: int = 60) -> DataFrame:
    """``query, id, score, place``: a page of keyword and vector ranks fused within ``docs``, then put in the order of ``seen_at``, the newest first.

    docs: ``id, seen_at`` and the columns of ``weights``, narrowed already. vectors: ``id, vec``. A query's vector is that of its best keyword hit that
    has one, so a query without hits has no page. Each list gives its ``pool`` best.
    """
    hits = materialise(keyword_search(docs, queries, weights))
    inside = materialise(vectors.join(docs.select("id"), "id", "left_semi"))
    best = hits.join(inside, "id").groupBy("query").agg(F.min_by("vec", F.struct(-F.col("score"), "id")).alias("vec"))
    numbered = best.select(F.xxhash64("query").alias("number"), "query", "vec")
    near = nearest_vectors(inside, numbered.select(F.col("number").alias("query"), "vec"), pool).withColumnRenamed("query", "number").join(numbered.select("number", "query"), "number")
    fused = top(fuse(top(hits, pool), near.select("query", "id", "rank")).withColumn("score", F.round("score", 9)), size).join(docs.select("id", "seen_at"), "id")
    return fused.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("seen_at"), "id"))).select("query", "id", "score", "place")
