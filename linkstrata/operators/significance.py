"""Paired comparison of two runs: bootstrap intervals and McNemar's test (specified in the survey, §2.5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bootstrap(pairs: DataFrame, key: str, a: str, b: str, rounds: int = 200) -> DataFrame:
    """(low, middle, high): 95 % interval of mean(b - a), by Poisson resampling.

    A row counts in round r as often as a Poisson(1) draw from its key and r says, so each task draws its own rows' weights
    and only ``rounds`` sums travel. Nulls in either value are left out.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.col("r").cast("string"))), 1, 10), 16, 10).cast("double") / float(16**10)
    weight = sum((F.when(u > p, 1).otherwise(0) for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)), F.lit(0))
    rows = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    d = F.col(b) - F.col(a)
    means = rows.withColumn("w", weight).groupBy("r").agg((F.sum(F.col("w") * d) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.5).alias("middle"), F.percentile("m", 0.975).alias("high"))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(only_a, only_b, chi2) of two boolean outcomes of the same queries, with continuity correction; 0 without disagreement."""
    n = pairs.agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    gap = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)).cast("double")
    total = F.col("only_a") + F.col("only_b")
    return n.withColumn("chi2", F.when(total > 0, gap * gap / total).otherwise(0.0))
