"""Sanitised variants of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstrata.operators.audit import order_hash
from linkstrata.plans.staging import lookup


def dedupe_splits(rows: DataFrame, keys: list[Column], keep_blank: bool = True) -> DataFrame:
    """Train as it is, dev without what train holds, test without what the original train and dev hold, by any of the keys.

    A key that is null or '' never matches; with ``keep_blank`` false it does, removing all blank rows behind one of an
    earlier split. For each key the earliest split that holds a value is aggregated, so a value of any number of rows is one row.
    """
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).otherwise(2)
    out = rows.withColumn("_rank", rank)
    for i, k in enumerate(keys):
        name = f"_k{i}"
        value = F.coalesce(k, F.lit("")) if not keep_blank else F.nullif(k, F.lit(""))
        out = out.withColumn(name, F.md5(value))
    marked = out
    for i in range(len(keys)):
        name = f"_k{i}"
        first = out.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min("_rank").alias(f"_first{i}"))
        marked = lookup(marked, first, name, 200_000)
    seen = F.lit(False)
    for i in range(len(keys)):
        seen = seen | F.coalesce(F.col(f"_first{i}") < F.col("_rank"), F.lit(False))
    return marked.filter(~seen).select(*rows.columns)


def without_images(entities: DataFrame, listed: DataFrame, path: str) -> DataFrame:
    """``entities`` without the listed paths in image_list, order and repeats kept; null lists stay null, emptied ones are []."""
    each = entities.filter("image_list is not null").select("id", F.posexplode("image_list").alias("at", "image"))
    bad = listed.select(F.col(path).alias("image")).filter("image is not null").distinct()
    kept = each.join(bad, "image", "left_anti").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "image"))).alias("x"))
    kept = kept.select("id", F.col("x.image").alias("_kept"))
    fresh = F.when(F.col("image_list").isNull(), F.col("image_list")).otherwise(F.coalesce("_kept", F.array().cast("array<string>")))
    return entities.join(kept, "id", "left").withColumn("image_list", fresh).drop("_kept")


def manifest(rows: DataFrame, by: list[str], images: str | None = None) -> DataFrame:
    """One row a group: rows, distinct ids and answers, and with ``images``, the name of a list column, the number of its elements; null lists have none."""
    more = [F.sum(F.coalesce(F.when(F.col(images).isNotNull(), F.size(images)), F.lit(0))).alias("images")] if images else []
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count_distinct("answer").alias("answers"), *more)


def image_total(entities: DataFrame) -> DataFrame:
    """(entities, images, without): the length of all image lists together, and how many are null or empty."""
    n = F.coalesce(F.when(F.col("image_list").isNotNull(), F.size("image_list")), F.lit(0))
    return entities.agg(F.count("*").alias("entities"), F.sum(n).alias("images"), F.count_if(n == 0).alias("without"))


def contiguous(rows: DataFrame, key: str) -> DataFrame:
    """Whether a key runs from its smallest value without a gap or repeat, and how many rows repeat it."""
    n = F.count_distinct(key)
    return rows.agg(F.count("*").alias("rows"), (F.count("*") - n).alias("repeated"), ((F.max(key) - F.min(key) + 1 == n) & (F.count("*") == n)).alias("contiguous"))


def freeze(gate: DataFrame, lists: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(name, n, sha): the manifest of an accepted dataset; raises if the gate's row 'accepted' has not passed or is missing.

    ``lists``: for each name rows, the whole-number column that orders them, and the column of ids. The hash is SHA-256 of the
    ordered hashes of the runs of ``audit.order_hash``, so lists of any length are hashed by parts; a null id counts as its place.
    """
    if not [r for r in gate.filter("name = 'accepted'").select("passed").collect() if r.passed]:
        raise ValueError("the acceptance gate refused this dataset")
    out = None
    for name, (rows, order, key) in lists.items():
        runs = order_hash(rows, order, [key])
        sha = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sha"))), lambda x: x["sha"]), ""), 256)
        one = runs.agg(sha.alias("sha")).join(rows.agg(F.count("*").alias("n"))).select(F.lit(name).alias("name"), "n", "sha")
        out = one if out is None else out.unionByName(one)
    return out
