"""Samples, grids and neighbours (I1-I7, P12, P19, TK4, U7, A26, A27). Orders come from md5 of the id, so they repeat anywhere."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: Column, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def stratified(rows: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """Of each label max(1, floor(n * share)) rows. Null labels are one stratum."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    quota = counts.join(F.broadcast(total)).select(F.col(label).alias("_l"), F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("_c") / F.col("_t"))).alias("_q"))
    w = Window.partitionBy(label).orderBy(seeded(F.col(key)), key)
    # No quota is above n, so tasks pass on n rows a label at most where Spark limits window groups (n of 1000 or less).
    some = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return some.join(F.broadcast(quota), F.col(label).eqNullSafe(F.col("_l"))).filter("_r <= _q").select(*rows.columns)


def by_difficulty(rows: DataFrame, score: str, key: str, n: int, how: str) -> DataFrame:
    """The n easiest (highest score) or hardest rows, or n / 3 easiest, hardest and nearest to the mean."""
    easy, hard = rows.orderBy(F.desc(score), key), rows.orderBy(score, key)
    if how in ("easy", "hard"):
        return (easy if how == "easy" else hard).limit(n)
    mean = rows.agg(F.avg(score)).first()[0] or 0.0
    middle = rows.orderBy(F.abs(F.col(score) - mean), key)
    return easy.limit(n // 3).unionByName(hard.limit(n // 3)).unionByName(middle.limit(n // 3)).distinct()


def pick(array: Column, key: Column, k: int, seed: int = 0) -> Column:
    """k items of an array without replacement, in an order seeded by the row's key."""
    order = F.array_sort(F.transform(array, lambda x: F.struct(F.md5(F.concat_ws("-", x, key.cast("string"), F.lit(str(seed)))).alias("h"), x.alias("x"))))
    return F.slice(F.transform(order, lambda s: s["x"]), 1, k)


def neighbour_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(qid, overlap): the share of k neighbours that two searches (qid, eid) have in common. Queries in one only have 0."""
    one = lambda x, n: x.groupBy("qid").agg(F.collect_set("eid").alias(n))
    both = one(a, "a").join(one(b, "b"), "qid", "full")
    empty = F.array().cast("array<bigint>")
    return both.select("qid", (F.size(F.array_intersect(F.coalesce("a", empty), F.coalesce("b", empty))) / float(k)).alias("overlap"))


def grid(spark, **axes: list) -> DataFrame:
    """All combinations of short lists."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def ablations(groups: DataFrame, name: str = "grp") -> DataFrame:
    """(left_out, kept): for each group the sorted list of the others."""
    every = groups.agg(F.array_sort(F.collect_set(name)).alias("_all"))  # names of groups: a short list
    return groups.join(F.broadcast(every)).select(F.col(name).alias("left_out"), F.array_except("_all", F.array(name)).alias("kept"))


def _farthest(v: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of n rows: the first of a seeded order, then each time the one farthest from those chosen, ties by the smaller id."""
    order = np.argsort(ids, kind="stable")
    v, place = v[order], order
    first = min(range(len(ids)), key=lambda i: hashlib.md5(f"{ids[order[i]]}-0".encode()).digest())
    out, far = [first], ((v - v[first]) ** 2).sum(1)
    far[first] = -1.0
    while len(out) < min(n, len(ids)):
        nxt = int(far.argmax())
        out.append(nxt)
        far = np.minimum(far, ((v - v[nxt]) ** 2).sum(1))
        far[out] = -1.0
    return place[out]


def diverse(rows: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """(key, vector) of n rows far apart. Each task keeps n rows of what it has seen, farthest first, and one task picks among
    these, which loses at most a factor of two of the distance that n rows can have to all others. Null vectors take no part."""

    def pick(batches):
        pool = None
        for b in batches:
            pool = b if pool is None else pd.concat([pool, b], ignore_index=True)
            if len(pool):
                at = _farthest(np.stack(pool[vector].map(np.asarray)).astype(float), pool[key].to_numpy(), n)
                pool = pool.iloc[at].reset_index(drop=True)
        if pool is not None:
            yield pool

    kind = f"{key} {dict(rows.dtypes)[key]}, {vector} {dict(rows.dtypes)[vector]}"
    return rows.filter(F.col(vector).isNotNull()).select(key, vector).mapInPandas(pick, kind).coalesce(1).mapInPandas(pick, kind)
