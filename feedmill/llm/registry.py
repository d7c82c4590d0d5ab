"""The queries of the problems, over the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.llm import boilerplate, encoding, garbled, languages, names, near_duplicates, packing, repeated_lines, residue
from feedmill.tables import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_leftovers(spread(table(spark, d, "items"))).withColumnRenamed("id", "item_id")


def _similar_items(spark: SparkSession, d: str) -> near_duplicates.NearDuplicates:
    items = spread(table(spark, d, "items")).select("id", "text")
    # a leftover has no similar items, but a class of its own
    return near_duplicates.near_duplicates(items, "id", words=3, threshold=0.5, least_words=60, without=residue.leftover(F.col("text")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _similar_items(spark, d).pairs().toDF("item_a", "item_b")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The compact form of p2_found: each item's class of equal texts and its number of links to other classes."""
    return _similar_items(spark, d).classes().withColumnRenamed("key", "item_id")


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of p2_found between the classes' representatives, with their similarity."""
    return _similar_items(spark, d).links.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.round("similarity", 6).alias("similarity"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(spread(table(spark, d, "items")))


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Each item's text without the lines repeated in its source."""
    return repeated_lines.remove_repeated(spread(table(spark, d, "items"))).withColumnRenamed("id", "item_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    items = spread(table(spark, d, "items").select("id", "text", "lang", "url"))
    return languages.mislabelled(items, without=residue.leftover(F.col("text"))).withColumnRenamed("id", "item_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(spark, d, "items")).withColumnRenamed("id", "item_id")


def p6_main_text(spark: SparkSession, d: str) -> DataFrame:
    """Each item's text without what stood around the article."""
    return boilerplate.main_text(spread(table(spark, d, "items"))).withColumnRenamed("id", "item_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    named = names.mentions(table(spark, d, "enrichment"), table(spark, d, "entities"))
    return names.link_names(named, table(spark, d, "orgs"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct spelling with the name of its group and the entry it means, if any; names that are in no list are grouped, too."""
    named = names.mentions(table(spark, d, "enrichment"), table(spark, d, "entities"))
    return names.name_groups(named, table(spark, d, "orgs"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_documents(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text, encoded and decoded again."""
    return encoding.decode_documents(p8_ids(spark, d))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(encoding.encode_documents(table(spark, d, "documents"), counts=True))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(spread(table(spark, d, "documents")))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with their text restored."""
    return garbled.restore(spread(table(spark, d, "documents")))


def p10_margins(spark: SparkSession, d: str) -> DataFrame:
    """The margins validated on the documents, with the shares of clean segments above them and of segments garbled on purpose that are led back."""
    return garbled.margins_of(spread(table(spark, d, "documents")))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_links": p2_links, "p1_found": p1_found, "p4_found": p4_found, "p4_cleaned": p4_cleaned, "p10_found": p10_found, "p10_restored": p10_restored, "p10_margins": p10_margins, "p5_found": p5_found, "p6_found": p6_found, "p6_main_text": p6_main_text, "p7_found": p7_found, "p7_groups": p7_groups, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_packed": p9_packed}
ORACLE = {
    "p4_found": """WITH x AS (SELECT DISTINCT id, source_id, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[ \\t\\r]+', ' ', 'g')) AS line FROM (SELECT id, source_id, unnest(string_split(text, chr(10))) AS line FROM items WHERE source_id IS NOT NULL)),
 t AS (SELECT source_id, count(*) AS total FROM items WHERE source_id IS NOT NULL GROUP BY source_id)
 SELECT source_id, line FROM x JOIN t USING (source_id) WHERE line <> '' GROUP BY source_id, line, total HAVING count(*) >= 5 AND count(*) * 50 >= total""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
