"""Ingest and delivery as streams: what is new since the last run, each address once, each item once to a subscriber."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.functions import text as X


def raw_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """The raw items that arrive as Parquet files under ``path``, a directory or a pattern."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)


def first_of_each_address(rows: DataFrame) -> DataFrame:
    """The row first fetched of each ``url_key``, which is added; rows without url are left out."""
    keyed = rows.withColumn("url_key", X.url_key(F.col("url"))).withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).where("url_key is not null")
    ties = [c for c in ("raw_id", "url") if c in rows.columns]
    rest = [c for c in keyed.columns if c != "url_key"]
    first = keyed.groupBy("url_key").agg(F.min_by(F.struct(*rest), F.struct(F.col("fetched_at").isNull(), "fetched_at", *ties)).alias("first"))
    return first.select("first.*", "url_key")


def run_ingest(spark: SparkSession, path: str, out: str, checkpoint: str, files_a_batch: int | None = None) -> None:
    """Take in all that has arrived since the last call and stop; a repeated call finds nothing new.

    Each address is taken in once for good, however late its rows are: a batch is anti-joined with the ``url_key`` of all
    that is written and lands in a directory of its own number, which a repeated batch overwrites.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = first_of_each_address(batch)
        if number:
            done = batch.sparkSession.read.schema("url_key string, batch int").option("basePath", out).parquet(out).where(F.col("batch") < number).select("url_key")
            new = new.join(done, "url_key", "left_anti").select(*new.columns)
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    raw_stream(spark, path, files_a_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Parts by the hash of the subscription, into which deliveries are written.
PARTS = 64


def deliver(offers: DataFrame, out: str, checkpoint: str) -> None:
    """Append the pairs (``subscription_id, item_id``) of a stream of offers that were not delivered before.

    What is written is kept by the hash of the subscription, and a batch is anti-joined only with the parts that it has offers for. It lands in a
    directory of its own number, which a repeated batch overwrites: a pair is delivered once, even after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("subscription_id"), F.lit(PARTS)).cast("int")
        pairs = batch.select("subscription_id", "item_id").distinct().withColumn("part", part)
        if number:
            touched = [r["part"] for r in batch.select(part.alias("part")).distinct().collect()]  # at most PARTS numbers
            done = spark.read.schema("subscription_id string, item_id bigint, batch int, part int").option("basePath", out).parquet(out)
            done = done.where((F.col("batch") < number) & F.col("part").isin(touched)).select("subscription_id", "item_id")
            pairs = pairs.join(done, ["subscription_id", "item_id"], "left_anti")
        pairs.write.mode("overwrite").partitionBy("part").parquet(f"{out}/batch={number}")

    offers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
