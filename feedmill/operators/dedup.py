"""The order-dependent removal of duplicates at ingest, as a fixpoint over the graph of conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.operators.simhash import similar_prints
from feedmill.session import materialise

LEAST_WORDS, MOST_BITS = 120, 6


def keep_first(members: DataFrame) -> DataFrame:
    """``id, kept``: the rows, in the order of their ids, that conflict with no earlier kept row.

    members: ``id, key, active``; rows with an equal key conflict, but only an ``active`` one is dropped for an earlier row of the key;
    every row needs an active key. Each round drops the undecided rows with an earlier kept row in an active key and keeps those
    without an earlier undecided one there. Of a key only its first kept and its first undecided row matter, so a
    key costs two grouped minima and no pairs, however many rows it has. The first undecided row of all is decided in every
    round, so the rounds end by themselves. Each is written to cut the lineage. What is decided grows with the corpus and is tiny
    as Parquet, so it is never broadcast.
    """
    decided = None
    members = materialise(members)
    while True:
        state = members.withColumn("kept", F.lit(None).cast("boolean")) if decided is None else members.join(decided.hint("merge"), "id", "left")
        least = state.groupBy("key").agg(F.min(F.when(F.col("kept"), F.col("id"))).alias("first_kept"), F.min(F.when(F.col("kept").isNull(), F.col("id"))).alias("first_open"))
        seen = state.where("kept is null and active").join(least, "key").select("id", F.coalesce(F.col("first_kept") < F.col("id"), F.lit(False)).alias("beaten"), (F.col("first_open") < F.col("id")).alias("waiting"))
        open_rows = seen.groupBy("id").agg(F.max("beaten").alias("beaten"), F.max("waiting").alias("waiting"))
        new = materialise(open_rows.where("beaten or not waiting").select("id", (~F.col("beaten")).alias("kept")))
        if new.isEmpty():
            return decided if decided is not None else new
        decided = materialise(new if decided is None else decided.unionByName(new))


def cascade(rows: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """``id, kept`` of ``rows`` (``id, url_key, doi, source_id, title, words, simhash``): first come, first kept.

    A row is left out if dismissed (its ``url_key`` is listed). It is dropped if it shares with an earlier kept row its
    url_key, its DOI, or source and title, or, having at least LEAST_WORDS words, all but MOST_BITS bits of
    its fingerprint. A dropped row drops no other. Null and empty keys and zero fingerprints conflict with
    nothing. ``id`` must be unique.
    """
    if dismissed is not None:
        rows = rows.join(dismissed.select("url_key").where("url_key is not null"), "url_key", "left_anti")
    rows = materialise(rows.select("id", "url_key", "doi", "source_id", "title", "words", "simhash"))
    named = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    keys = F.array(F.concat(F.lit("i"), F.col("id").cast("string")), F.concat(F.lit("u"), named("url_key")), F.concat(F.lit("d"), named("doi")), F.concat(F.lit("t"), F.col("source_id").cast("string"), F.lit(" "), named("title")))
    members = rows.select("id", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"), F.lit(True).alias("active"))
    # rows of one fingerprint conflict with one another, and so do all rows of two similar ones: a key each, no pairs of rows
    long = F.col("words") >= LEAST_WORDS
    printed = rows.where("simhash <> 0").select("id", F.col("simhash").alias("f"), long.alias("active"))
    equal = printed.select("id", F.concat(F.lit("f"), F.col("f").cast("string")).alias("key"), "active")
    near = similar_prints(rows, MOST_BITS).select(F.explode(F.array("f", "g")).alias("f"), F.concat_ws(" ", F.lit("n"), "f", "g").alias("key"))
    similar = printed.join(near.hint("merge"), "f").select("id", "key", "active")
    return keep_first(members.unionByName(equal).unionByName(similar))
