"""Ranks and ranked lists (W1-W4, TK1-TK11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def competition(score: str, by: list[str]) -> Column:
    """1 + number of rows with a strictly greater score; equal scores share a rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score)))


def ordinal(score: str, tie: str, by: list[str]) -> Column:
    """Every row its own rank; ties go to the smaller ``tie``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))


def lists(top: DataFrame) -> DataFrame:
    """(qid, top, scores): arrays in order of rank."""
    items = F.array_sort(F.collect_list(F.struct("rank", "eid", "score")))
    return top.groupBy("qid").agg(items.alias("x")).select("qid", F.col("x.eid").alias("top"), F.col("x.score").alias("scores"))


def two_sided(rows: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n lowest and the n highest rows, with ``side`` and ``place``. A row may stand on both sides of a short table."""
    low = rows.orderBy(F.asc(value), tie).limit(n).withColumn("side", F.lit("improved"))
    high = rows.orderBy(F.desc(value), tie).limit(n).withColumn("side", F.lit("worsened"))
    place = lambda df, o: df.withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy(o, tie)))
    return place(low, F.asc(value)).unionByName(place(high, F.desc(value)))


def top_by(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n a group before it shuffles."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)
