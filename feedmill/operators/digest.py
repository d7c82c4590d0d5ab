"""Selections of the best items for a digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedmill.functions import text as X
from feedmill.operators import feed
from feedmill.operators.simhash import hamming, simhash64

NEAR_BITS, POOL = 8, 4


def select(ranked: DataFrame, budget: int, most: int) -> DataFrame:
    """``topic, id, cost, spent`` of ``ranked`` (``topic, id, score, told``): each topic's best without near copies, within a budget of tokens.

    A pool of POOL x ``most`` of each topic's best is looked at in order; what is within NEAR_BITS bits of an earlier one that was kept is
    dropped, then the pack is filled until it overflows, its first item whatever it costs. The pool's size bounds a topic's array, whatever the corpus.
    """
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "id"))
    pool = ranked.withColumn("n", place).where(F.col("n") <= POOL * most).select("topic", "id", "n", X.estimate_tokens(F.col("told")).cast("long").alias("cost"), F.coalesce(simhash64("told"), F.lit(0)).alias("print"))
    listed = pool.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("n", "id", "cost", "print"))).alias("all"))
    start = F.array().cast("array<struct<n:int,id:bigint,cost:bigint,print:bigint>>")
    near = lambda kept, x: F.exists(kept, lambda k: (x["print"] != 0) & (k["print"] != 0) & (hamming(k["print"], x["print"]) <= NEAR_BITS))
    kept = F.aggregate("all", start, lambda held, x: F.when(near(held, x), held).otherwise(F.concat(held, F.array(x))))
    alone = listed.select("topic", F.explode(kept).alias("k")).select("topic", "k.*")
    return feed.pack_prefix(alone.drop("n").withColumnRenamed("print", "fingerprint").join(pool.select("topic", "id", F.col("n").alias("place")), ["topic", "id"]), "topic", [F.col("place")], "cost", F.lit(budget), F.lit(most), keep_first=True, cap=most).select("topic", "id", "cost", "spent")


def recall(members: DataFrame, vectors: DataFrame, most: int = 60, least: float = 0.34) -> DataFrame:
    """``topic, id, score``: the vectors (``id, vec``) nearest to each topic's mean vector that aren't among its ``members`` (``topic, id``), at most ``most``, of a cosine of ``least`` or more.

    Topics are few: their means meet all vectors in one pass, in which each row is scored against every topic's mean; a topic
    without vectors recalls nothing. The recalled items still need a judge.
    """
    at = members.join(vectors, "id").select("topic", F.posexplode("vec").alias("k", "x")).groupBy("topic", "k").agg(F.avg("x").alias("x"))
    means = at.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("mean"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda total, x: total + x)
    together = means.agg(F.collect_list(F.struct("topic", "mean")).alias("topics")).withColumn("one", F.lit(1))
    scored = vectors.withColumn("one", F.lit(1)).join(F.broadcast(together), "one").select("id", "vec", F.explode("topics").alias("t"))
    cosine = dot(F.col("vec"), F.col("t.mean")) / F.greatest(F.sqrt(dot(F.col("vec"), F.col("vec"))) * F.sqrt(dot(F.col("t.mean"), F.col("t.mean"))), F.lit(1e-9))
    found = scored.select("t.topic", "id", cosine.alias("score")).where(F.col("score") >= least).join(members.select("topic", "id"), ["topic", "id"], "left_anti")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "id"))).where(F.col("n") <= most).select("topic", "id", "score")
