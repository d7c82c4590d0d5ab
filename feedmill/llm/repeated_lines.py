"""Problem 4: lines that recur in many documents of one source.

PrefixSpan, distributed. The database is the documents' lines as identifiers, a sequence of the frequent ones for each document; empty
lines and lines that aren't frequent may stand between those of a sequence. The sequences of length one come
from one grouped count. Each round extends every frequent prefix by the lines that follow it next in its projected suffixes, counts in how many
documents of the source each extension stands, and keeps the frequent ones with their suffixes, until nothing can be
extended; no length is set. A prefix whose suffixes all begin alike is led on to the end of what they share at once (by the least and
the greatest suffix, which share what all share), so that a block that always stands together costs one round. Found are the
closed sequences: those that no extension with the same support contains. Their lines are what recurs, and a document loses the
places where such a sequence stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmill.session import materialise

LEAST_DOCUMENTS = 5
ONE_IN = 50


def normal_lines(text: Column) -> Column:
    """The lines of a text for comparing: lower-cased, trimmed, runs of blanks as one, runs of digits as 0; empty lines stay, as empty."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "[ \\t\\r\\u00a0]+", " ")
    return F.transform(F.split(flat, "\n"), lambda line: F.trim(line))


def _support(counted: DataFrame, totals: DataFrame) -> DataFrame:
    return counted.join(totals, "source").where((F.col("n") >= LEAST_DOCUMENTS) & (F.col("n") * ONE_IN >= F.col("total"))).drop("total")


def _boxed(items: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("source is not null")


def _totals(boxed: DataFrame) -> DataFrame:
    return boxed.groupBy("source").agg(F.count("*").alias("total"))


def frequent_lines(items: DataFrame, id_col: str = "id", source_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """``source, line, n, id``: the frequent sequences of length one, with the number of documents and a number within the source."""
    boxed = _boxed(items, id_col, source_col, text_col)
    # each document names a line once, so a count of rows is one of documents, and is combined before the shuffle
    named = boxed.select("source", F.explode(F.array_distinct(normal_lines(F.col("text")))).alias("line")).where("line <> ''")
    found = _support(named.groupBy("source", "line").agg(F.count("*").alias("n")), _totals(boxed))
    # a line is frequent in one of ONE_IN documents at least, so a source has few of them
    return found.withColumn("id", F.row_number().over(Window.partitionBy("source").orderBy("line")))


def _occurrences(boxed: DataFrame, lines: DataFrame) -> DataFrame:
    """``source, doc, row, at, id``: where the frequent lines stand; joined by the line itself, so that no two are taken for one. ``row`` tells rows of one document apart; the result must be written before it is read twice."""
    numbered = boxed.withColumn("row", F.monotonically_increasing_id())
    return numbered.select("source", "doc", "row", F.posexplode(normal_lines(F.col("text"))).alias("at", "line")).where("line <> ''").join(lines.select("source", "line", "id"), ["source", "line"]).drop("line")


def _common(least: Column, greatest: Column) -> Column:
    """What two arrays begin with in common; of the least and the greatest of a set, what all of it begins with."""
    agree = F.zip_with(least, greatest, lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    first = F.array_position(agree, F.lit(False))
    return F.slice(least, 1, F.when(first == 0, F.size(agree)).otherwise(first - 1).cast("int"))


def mine(occurrences: DataFrame, totals: DataFrame) -> DataFrame:
    """``source, ids, n``: the closed frequent sequences of ``occurrences`` (``source, doc, row, at, id``), as arrays of lines' numbers.

    Repeated rows count as documents of their own.
    """
    whole = occurrences.groupBy("source", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
    # every place begins a suffix; the first of a line in a document is its projection
    start = whole.select("source", "row", F.posexplode("ids").alias("k", "id"), "ids").where(F.array_position("ids", F.col("id")) == F.col("k") + 1)
    start = start.select("source", "row", F.array("id").alias("prefix"), F.slice("ids", F.col("k") + 2, F.size("ids")).alias("suffix"))
    projected = materialise(start)
    found = []
    while True:
        groups = projected.groupBy("source", "prefix").agg(F.count("*").alias("n"), F.min("suffix").alias("least"), F.max("suffix").alias("greatest"))
        frequent = materialise(_support(groups, totals).withColumn("shared", _common(F.col("least"), F.col("greatest"))).select("source", "prefix", "n", "shared"))
        if frequent.isEmpty():
            break
        found.append(frequent.select("source", F.concat("prefix", "shared").alias("ids"), "n"))
        on = projected.join(frequent.drop("n"), ["source", "prefix"]).select("source", "row", F.concat("prefix", "shared").alias("prefix"), F.slice("suffix", F.size("shared") + 1, F.size("suffix")).alias("suffix")).where(F.size("suffix") > 0)
        projected = materialise(on.select("source", "row", F.concat("prefix", F.slice("suffix", 1, 1)).alias("prefix"), F.slice("suffix", 2, F.size("suffix")).alias("suffix")))
    every = reduce(DataFrame.unionByName, found, occurrences.select("source", F.array("id").alias("ids"), F.lit(0).cast("bigint").alias("n")).limit(0)).distinct()
    return _closed(materialise(every))


def _closed(sequences: DataFrame) -> DataFrame:
    """The sequences that aren't the tail of another one with the same support: what was begun in the middle of a block is dropped for the whole block."""
    tails = sequences.select("source", "n", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("ids"), F.lit(2))), lambda k: F.slice("ids", k, F.size("ids")))).alias("ids")).where(F.size("ids") > 0)
    return sequences.join(tails.distinct(), ["source", "ids", "n"], "left_anti")


def frequent_sequences(items: DataFrame, id_col: str = "id", source_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """``source, sequence, n``: the closed frequent sequences of lines, with the number of documents of the source in which they stand so.

    Support is at least LEAST_DOCUMENTS documents and one in ONE_IN of the source's rows. Null and empty
    texts count as rows only; rows without source and empty lines are left out; other lines may stand between a sequence's lines.
    """
    boxed = _boxed(items, id_col, source_col, text_col)
    totals = materialise(_totals(boxed))
    lines = materialise(frequent_lines(items, id_col, source_col, text_col))
    closed = mine(materialise(_occurrences(boxed, lines)), totals).withColumn("key", F.xxhash64("source", "ids"))
    placed = closed.select("source", "ids", "n", F.posexplode("ids").alias("k", "id")).join(lines.select("source", "id", "line"), ["source", "id"])
    spelled = placed.groupBy("source", "ids", "n").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("lines"))
    return spelled.select("source", F.transform("lines", lambda x: x["line"]).alias("sequence"), "n")


def repeated_lines(items: DataFrame, id_col: str = "id", source_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """``source_col, line`` of each line of a frequent sequence of its source."""
    lines = frequent_sequences(items, id_col, source_col, text_col).select("source", F.explode("sequence").alias("line"))
    return lines.distinct().withColumnRenamed("source", source_col)


def remove_repeated(items: DataFrame, id_col: str = "id", source_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col`` of each row, the text without the occurrences of its source's frequent sequences.

    ``id_col`` must be unique. A sequence's lines go where they stand, single ones too, whatever stands between them. Texts without such lines, null and
    empty ones and those without source stay as they are.
    """
    boxed = _boxed(items, id_col, source_col, text_col)
    totals = materialise(_totals(boxed))
    lines = materialise(frequent_lines(items, id_col, source_col, text_col))
    occurrences = materialise(_occurrences(boxed, lines))
    mined = mine(occurrences, totals).select("source", F.explode("ids").alias("id")).distinct()
    drop = occurrences.join(mined, ["source", "id"]).groupBy("doc").agg(F.collect_set("at").alias("drop"))
    texts = items.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(drop, "doc", "left")
    kept = F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains("drop", at))
    return texts.select(F.col("doc").alias(id_col), F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text_col))
