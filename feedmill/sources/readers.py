"""Readers of feeds: RSS and Atom as XML, article services' JSON, another feed's envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.functions import text as X

RSS_ITEM = "title string, link string, description string, `content:encoded` string, author string, pubDate string, guid string"
ENVELOPE = "items array<struct<id: string, url: string, title: string, published_at: string, renditions: struct<headline: struct<text: string>, brief: struct<text: string>, abstract: struct<text: string>>>>"
ARTICLES = "results array<struct<id: string, doi: string, title: string, publication_date: string, type: string, cited_by_count: bigint, concepts: array<struct<display_name: string>>, abstract_inverted_index: map<string, array<int>>>>"


def read_rss(spark: SparkSession, path: str, source_id: int | None = None) -> DataFrame:
    """Raw items of RSS files: body from the content, else the description, as plain text; kept as text from 180 words on, else as an excerpt."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    body = X.clean_html(X.first_text(F.col("`content:encoded`"), F.col("description")))
    return rows.select(
        F.lit(source_id).cast("bigint").alias("source_id"), X.first_text(F.col("link"), F.col("guid")).alias("url"), F.trim("title").alias("title"), F.col("pubDate").alias("published_at"), "author",
        F.when(X.word_count(body) > 180, body).alias("text"), F.substring(body, 1, 1200).alias("excerpt"), X.find_doi(F.col("link"), body).alias("doi"),
    )


def text_of_index(index: Column) -> Column:
    """The text of a map from words to their places."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda p: p["word"]), " ")


def read_articles(spark: SparkSession, path: str, min_citations: int = 0, concepts: tuple[str, ...] = (), kind: str | None = None) -> DataFrame:
    """Raw items of an article service's JSON pages, abstracts given as an index of words; narrowed to a kind, to any of some concepts and by citations."""
    pages = spark.read.schema(ARTICLES).option("multiLine", True).json(path)
    rows = pages.select(F.explode("results").alias("r")).where(F.coalesce("r.cited_by_count", F.lit(0)) >= min_citations)
    if kind:
        rows = rows.where(F.col("r.type") == kind)
    if concepts:
        rows = rows.where(F.arrays_overlap(F.transform("r.concepts.display_name", F.lower), F.array(*[F.lit(c.lower()) for c in concepts])))
    return rows.select(X.first_text(F.col("r.doi"), F.col("r.id")).alias("url"), "r.title", F.col("r.publication_date").alias("published_at"), text_of_index(F.col("r.abstract_inverted_index")).alias("excerpt"), X.find_doi(F.col("r.doi")).alias("doi"), F.to_json(F.struct(F.col("r.cited_by_count").alias("citations"))).alias("meta"))


def items_of_envelopes(envelopes: DataFrame) -> DataFrame:
    """``id, url, title, published_at, text, excerpt, state`` of the items in ``envelope`` (JSON text); those without url are left out."""
    items = envelopes.select(F.explode(F.from_json("envelope", ENVELOPE)["items"]).alias("i")).where("coalesce(i.url, '') <> ''")
    headline, brief, abstract = (F.col(f"i.renditions.{k}.text") for k in ("headline", "brief", "abstract"))
    text = F.coalesce(X.first_text(abstract, brief), F.lit(""))
    return items.select(
        "i.id", "i.url", X.first_text(headline, F.col("i.title"), F.col("i.url")).alias("title"), "i.published_at", text.alias("text"),
        F.substring(F.coalesce(X.first_text(brief, abstract), F.lit("")), 1, 1200).alias("excerpt"), F.when(text != "", "full").otherwise("metadata_only").alias("state"),
    )


PMC = "resultList struct<result: array<struct<id: string, source: string, pmid: string, doi: string, title: string, authorString: string, abstractText: string, firstPublicationDate: string, pubYear: string, citedByCount: bigint, fullTextUrlList: struct<fullTextUrl: array<struct<url: string>>>, journalInfo: struct<journal: struct<title: string>>>>>"


def read_pmc(spark: SparkSession, path: str) -> DataFrame:
    """Raw items of a life-science index's JSON pages: linked by DOI, else by full text, else by the index's own page; the abstract is the text."""
    r = spark.read.schema(PMC).option("multiLine", True).json(path).select(F.explode("resultList.result").alias("r"))
    abstract = F.coalesce(X.clean_html(F.col("r.abstractText")), F.lit(""))
    link = F.coalesce(F.concat(F.lit("https://doi.org/"), F.nullif("r.doi", F.lit(""))), F.get("r.fullTextUrlList.fullTextUrl", F.lit(0))["url"], F.concat(F.lit("https://europepmc.org/article/"), F.coalesce("r.source", F.lit("MED")), F.lit("/"), F.coalesce("r.id", F.lit(""))))
    return r.select(
        link.alias("url"), F.rtrim(X.clean_html(F.col("r.title")), F.lit(".")).alias("title"), X.first_text(F.col("r.firstPublicationDate"), F.col("r.pubYear")).alias("published_at"), F.col("r.authorString").alias("author"), abstract.alias("text"), F.substring(abstract, 1, 600).alias("excerpt"), "r.doi",
        F.when(abstract != "", "full").otherwise("metadata_only").alias("content_state"),
        F.to_json(F.struct(F.col("r.journalInfo.journal.title").alias("journal"), (F.col("r.source") == "PPR").alias("is_preprint"), F.coalesce("r.citedByCount", F.lit(0)).alias("citations"), "r.pmid")).alias("extra"),
    )


def body_state(content_state: Column, text: Column, excerpt: Column) -> Column:
    """What becomes of a raw item's body: kept where it is metadata only or long already, full from 60 words on, else paywalled with an excerpt and failed without."""
    n = X.word_count(text)
    return F.when((F.coalesce(content_state, F.lit("")) == "metadata_only") | (n > 150), "kept").when(n >= 60, "full").when(F.coalesce(excerpt, F.lit("")) != "", "paywalled").otherwise("failed")


def plausible_page_date(day: Column, today: Column) -> Column:
    """A page's own date, null where it is out of bounds or a placeholder's: before 1996, after next year, or 1 January of 2000 or 2001."""
    year = F.year(day)
    placeholder = (F.month(day) == 1) & (F.dayofmonth(day) == 1) & year.isin(1970, 2000, 2001)
    return F.when((year > 1995) & (year <= F.year(today) + 1) & ~placeholder, day)


READERS: dict = {}


class UnknownKind(ValueError):
    """No reader is registered for a kind of source."""


def register(kind: str):
    """Registers a reader ``(spark, path) -> raw items`` for a kind of source."""

    def add(f):
        READERS[kind] = f
        return f

    return add


def reader_of(kind: str):
    if kind not in READERS:
        raise UnknownKind(f"no reader for {kind!r}; known kinds: {', '.join(sorted(READERS))}")
    return READERS[kind]


for _kind, _reader in (("rss", read_rss), ("openalex", read_articles), ("europepmc", read_pmc)):
    register(_kind)(_reader)
