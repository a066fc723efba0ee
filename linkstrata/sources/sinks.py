"""Writers (K1-K9, K11). Large results stay distributed; single files are for tables of report size."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def report_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header, for report-sized tables."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def sharded(rows: DataFrame, path: str, by: list[str]) -> None:
    """Parquet partitioned by columns; a folder is complete when it holds _SUCCESS."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def markdown(rows: DataFrame, order: str) -> DataFrame:
    """One row with the table as Markdown, for report-sized tables."""
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.agg(F.concat(F.lit(head + "\n"), body).alias("markdown"))


def orphans(files: DataFrame, listed: DataFrame, name: str = "name") -> DataFrame:
    """Files that no metadata row names; they are reported, not deleted."""
    return files.join(listed.select(name).distinct(), name, "left_anti")


def _files(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def pretty_json(rows: DataFrame, path: str) -> None:
    """One indented UTF-8 JSON file of a report-sized table, a list of objects, with a line feed at the end.

    It is written beside its place and renamed, so a reader sees the old file or the new one, never a part.
    """
    spark = rows.sparkSession
    text = json.dumps([json.loads(r) for r in rows.toJSON().collect()], indent=2, ensure_ascii=False) + "\n"
    target, fs = _files(spark, path)
    fresh, _ = _files(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.hsync() if out.hasCapability("hsync") else out.flush()
    out.close()
    # Hadoop's rename does not replace, so the old file goes first; a crash in between leaves the whole new one under its other name.
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(fresh, target):
        raise OSError(f"{path} could not be written")


def tradeoff_csv(rows: DataFrame, path: str, by: str, order: str) -> None:
    """``report_csv`` with the highest ``by`` first, equal ones in their order."""
    report_csv(rows.orderBy(F.desc(by), order), path)


def append_lines(rows: DataFrame, path: str) -> None:
    """JSON lines added to what a folder holds."""
    rows.write.mode("append").json(path)


def with_manifest(rows: DataFrame, path: str, shard: str, modes: dict[str, str], version: str) -> None:
    """Parquet partitioned by shard, and beside it ``<path>.manifest``: a row a shard and tensor with mode, version, rows and whether it is complete.

    The manifest is written after the data, so what it lists is there.
    """
    sharded(rows, path, [shard])
    n = rows.sparkSession.read.parquet(path).groupBy(shard).agg(F.count("*").alias("rows"))
    modes_ = F.explode(F.array(*(F.struct(F.lit(t).alias("tensor"), F.lit(m).alias("mode")) for t, m in sorted(modes.items())))).alias("x")
    n.select(F.col(shard).cast("string").alias("shard"), "rows", modes_).select("shard", "rows", "x.tensor", "x.mode", F.lit(version).alias("version"), F.lit(True).alias("complete")).coalesce(1).write.mode("overwrite").parquet(f"{path}.manifest")
