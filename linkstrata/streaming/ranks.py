"""Resumable runs as Structured Streaming (C12, J21): finished files are skipped by the checkpoint, batches are overwritten, not repeated."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstrata.operators.vectors import gold_ranks
from linkstrata.plans.staging import shared_dir


def run_batches(source: DataFrame, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Apply ``work`` to each micro-batch of what has arrived and store it as partition ``batch`` of ``out``.

    A batch that is run again after a failure replaces its own partition, so a row is never counted twice.
    """

    def store(batch: DataFrame, n: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    parts = path.rpartition("/")
    # A folder of parts is streamed as it is; a single file by its name in its folder.
    listing = spark._jvm.org.apache.hadoop.fs.Path(path)
    if listing.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(listing).isDirectory():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", parts[2]).parquet(parts[0])


def stream_first(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """(keys, n, order): first row and number of rows of each key, from partial states a batch merged by a batch query."""
    at = f"{shared_dir(spark)}/first-{uuid.uuid4().hex}"
    run_batches(_stream(spark, path), f"{at}/out", f"{at}/checkpoint", lambda b: b.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias(order)))
    return spark.read.parquet(f"{at}/out").groupBy(*keys).agg(F.sum("n").alias("n"), F.min(order).alias(order))


def stream_totals(spark: SparkSession, path: str) -> DataFrame:
    """(split, n, chars) over micro-batches."""
    at = f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}"
    part = lambda b: b.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).cast("bigint").alias("chars"))
    run_batches(_stream(spark, path), f"{at}/out", f"{at}/checkpoint", part)
    return spark.read.parquet(f"{at}/out").groupBy("split").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


def stream_ranks(spark: SparkSession, path: str, key: str, vector: str, gold: DataFrame, base: DataFrame, asks: str) -> tuple[DataFrame, DataFrame]:
    """(ranks, counters): the gold's rank of every query that arrives, batch by batch, and (batch, seen, skipped) of each batch.

    ``gold``: qid, gold, gold_v; ``base``: eid, v; ``asks``: which rows of the stream are queries. A query without gold is
    skipped and counted. A run that is taken up again does only the batches that are missing.
    """
    at = f"{shared_dir(spark)}/ranks-{uuid.uuid4().hex}"

    def work(batch: DataFrame) -> DataFrame:
        q = batch.select(F.col(key).alias("qid"), F.col(vector).alias("v")).join(gold, "qid", "left")
        ranked = gold_ranks(q, base).select("qid", "gold", "rank")
        return q.filter("gold is null").select("qid", "gold", F.lit(None).cast("long").alias("rank")).unionByName(ranked)

    run_batches(_stream(spark, path).filter(asks), f"{at}/out", f"{at}/checkpoint", work)
    every = spark.read.parquet(f"{at}/out")
    counters = every.groupBy("batch").agg(F.count("*").alias("seen"), F.count_if(F.col("gold").isNull()).alias("skipped"))
    return every.filter("gold is not null").select("qid", "gold", "rank"), counters


def deduplicated(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 day") -> DataFrame:
    """First row of each key in a stream; with a time column its state is dropped after ``late``, else it grows with the keys."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if time else stream.dropDuplicates(keys)
