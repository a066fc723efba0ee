"""Lineage cuts in shared storage, and skew-safe joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 1000
"""A key is hot when it holds more than 1/HOT_SHARE of the rows, so fewer than HOT_SHARE keys are."""


STAGED: list[str] = []
"""Tables written by this driver, for ``release``, which also runs at the driver's end."""


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session in one process may go without and gets a temporary one; a cluster raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="linkstrata-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result no longer depends on shuffle files or executors. A hint-free equivalent of
    ``checkpoint()`` that stays columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not STAGED:
        atexit.unregister(_at_exit)
        atexit.register(_at_exit)
    STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _at_exit() -> None:
    """What is staged goes with the driver, if its session still runs."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
            release(spark)
    except Exception:  # noqa: BLE001, S110
        pass


def release(spark: SparkSession) -> None:
    """Delete the tables staged so far. Only for when no result that reads them is still to be computed."""
    while STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_by_count(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key in ``groups``, safe for hot keys.

    ``n`` is the column of ``groups`` with the number of rows of the key and ``total`` the number
    of all rows. Keys with more than total/HOT_SHARE rows are fewer than HOT_SHARE, so that part of
    ``groups`` is broadcast; the others are joined by shuffle.
    """
    limit = total / HOT_SHARE
    hot, cold = groups.filter(F.col(n) > limit), groups.filter(F.col(n) <= limit)
    if not hot.head(1):
        return rows.join(groups, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(
        rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    )


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with more than 1/HOT_SHARE of the rows, and a thousand at least; fewer than HOT_SHARE, or None without any. ``rows`` should be staged."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = counts.filter(F.col("_n") > max(rows.count() / HOT_SHARE, 1000)).select(*keys, F.lit(True).alias("_hot"))
    return stage(hot, "hot") if hot.head(1) else None


def join_salted(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 64, hot: DataFrame | None | bool = False) -> DataFrame:
    """Inner join of two tables that both may have any number of rows of a key.

    Keys that are hot in ``left`` are parted: their rows of ``left`` go to ``salts``
    tasks by hash and only their rows of ``right`` are sent to each of these. ``hot``: ``hot_keys`` of ``left``, if they are known.
    """
    hot = hot_keys(left, keys) if hot is False else hot
    if hot is None:
        return left.join(right, keys)
    own = F.pmod(F.xxhash64(*left.columns), F.lit(salts))
    a = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), own).otherwise(F.lit(0).cast("long"))).drop("_hot")
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    b = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0).cast("long"))))).drop("_hot")
    return a.join(b, [*keys, "_salt"]).drop("_salt")


def lookup(rows: DataFrame, table: DataFrame, key: str, limit: int = 500_000) -> DataFrame:
    """Left join of ``rows`` with a table of one row a key. Null keys find nothing and never meet in one task; the key's column of ``table`` is dropped.

    A table of up to ``limit`` rows is broadcast; a larger one is joined by shuffle, but for its rows of keys with more than
    1/HOT_SHARE of all rows, fewer than HOT_SHARE, which are broadcast.
    """
    if table.count() <= limit:
        return rows.join(F.broadcast(table), key, "left")
    total = rows.count()
    hot = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > total / HOT_SHARE).select(key)
    none = [F.lit(None).cast(t).alias(c) for c, t in table.dtypes if c != key]
    part = lambda kind: rows.join(F.broadcast(hot), key, kind)
    found = part("left_semi").join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key, "left")
    found = found.unionByName(part("left_anti").filter(F.col(key).isNotNull()).join(table, key, "left"))
    return found.unionByName(rows.filter(F.col(key).isNull()).select("*", *none))


def small(table: DataFrame, rows: int = 500_000) -> DataFrame:
    """``table`` with a broadcast hint if it has at most ``rows`` rows, else as it is, to be joined by shuffle.

    Meant for staged tables of keys (8 to 40 bytes a row), so the broadcast is below about 20 MB.
    """
    return F.broadcast(table) if table.count() <= rows else table
