"""Geometry of embeddings before and after a change (A8, A16, A26, A27, E9, I4, TK5)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.operators.vectors import dot, doubles


def index_pairs(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """(i, j): n pseudo-random pairs of positions below the number of rows, pairs of equal ends left out, the same on every run."""
    total = rows.count()
    if total < 2:
        return rows.sparkSession.createDataFrame([], "i bigint, j bigint")
    at = lambda s: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed)), F.lit(s))), 1, 12), 16, 10).cast("bigint"), F.lit(total))
    return rows.sparkSession.range(n).select(at("i").alias("i"), at("j").alias("j")).filter("i <> j")


def second_moments(rows: DataFrame, v: str = "v") -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, number of rows) of a vector column: each task adds up its batches, so d x d numbers a task reach the driver's sum."""

    def part(batches):
        import pandas as pd

        s = m = None
        n = 0
        for b in batches:
            if len(b):
                x = np.stack(b[v].map(np.asarray)).astype(float)
                s = x.sum(0) + (0 if s is None else s)
                m = x.T @ x + (0 if m is None else m)
                n += len(x)
        if n:
            yield pd.DataFrame({"i": np.arange(len(s)), "n": n, "s": s, "m": list(m)})

    each = rows.filter(F.col(v).isNotNull()).select(v).mapInPandas(part, "i int, n long, s double, m array<double>")
    flat = each.select("i", "n", "s", F.posexplode("m").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.max("i").alias("_i"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    got = flat.select("i", "j", "x", "n", "s").collect()  # the square of the dimension
    if not got:
        return np.zeros(0), np.zeros((0, 0)), 0
    d = max(r.i for r in got) + 1
    n = got[0].n
    mean, second = np.zeros(d), np.zeros((d, d))
    for r in got:
        second[r.i, r.j] = r.x
        mean[r.i] = r.s / n
    return mean, second / n - np.outer(mean, mean), n


def pca(rows: DataFrame, k: int = 2, v: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """(mean, k x d basis) of the directions with most variance; signs are set so that each direction's largest number is positive."""
    mean, cov, n = second_moments(rows, v)
    if not n:
        return mean, np.zeros((k, 0))
    w, u = np.linalg.eigh(cov)
    basis = u[:, np.argsort(-w)[:k]].T
    return mean, basis * np.sign(basis[np.arange(len(basis)), np.abs(basis).argmax(1)])[:, None]


def project(rows: DataFrame, mean: np.ndarray, basis: np.ndarray, v: str = "v") -> DataFrame:
    """``rows`` with ``xy``: the vector less the mean on each direction."""
    centred = F.zip_with(doubles(F.col(v)), F.array(*map(F.lit, map(float, mean))), lambda x, m: x - m)
    return rows.withColumn("xy", F.array(*(dot(centred, F.array(*map(F.lit, map(float, b)))) for b in basis)))
