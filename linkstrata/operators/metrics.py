"""Aggregates of ranks, scores and timings.

Metrics of no rows are null and counts 0. Population deviations unless said; percentiles are exact and interpolate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(c: Column) -> Column:
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def retrieval_metrics(ranks: DataFrame, ks: list[int], by: list[str] | None = None, rank: str = "rank", name: str = "recall") -> DataFrame:
    """Share of ranks within each k, mean reciprocal rank, median, mean and number, of each group."""
    r = F.col(rank)
    aggs = [share(r <= k).alias(f"{name}_{k}") for k in ks]
    aggs += [F.avg(1 / r).alias("mrr"), F.median(r).alias("median_rank"), F.avg(r).alias("mean_rank"), F.count(r).alias("queries")]
    return ranks.groupBy(*(by or [])).agg(*aggs)


def list_metrics(lists: DataFrame, ks: list[int], gold: str = "gold", top: str = "top") -> DataFrame:
    """Hits, reciprocal rank and nDCG from truncated lists: a gold that isn't listed counts 0."""
    at = F.coalesce(F.array_position(top, F.col(gold)), F.lit(0))
    aggs = [share(at.between(1, k)).alias(f"hit_{k}") for k in ks]
    aggs += [F.avg(F.when(at.between(1, k), 1 / F.log2(at + 1)).otherwise(0.0)).alias(f"ndcg_{k}") for k in ks]
    return lists.agg(*aggs, F.avg(F.when(at > 0, 1 / at).otherwise(0.0)).alias("mrr"), F.count("*").alias("queries"))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation: 1 where either deviation is below 1e-12, 0 without rows."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when(F.count(x) == 0, 0.0).when((sx < 1e-12) | (sy < 1e-12), 1.0).otherwise(F.covar_pop(x, y) / (sx * sy))


def corr_of() -> Column:
    """``guarded_corr`` from the sums of ``vectors.paired_moments``."""
    n = F.col("n")
    dev = lambda a, aa: F.sqrt(F.greatest(F.col(aa) / n - (F.col(a) / n) * (F.col(a) / n), F.lit(0.0)))
    sx, sy = dev("x", "xx"), dev("y", "yy")
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).when((sx < 1e-12) | (sy < 1e-12), 1.0).otherwise((F.col("xy") / n - F.col("x") / n * F.col("y") / n) / (sx * sy))


def rank_stability(pairs: DataFrame, base: str, other: str) -> DataFrame:
    """Flips, improvements and deltas between two ranks of the same queries."""
    d = F.col(other) - F.col(base)
    return pairs.agg(
        F.count_if(d != 0).alias("flips"), F.count_if(d < 0).alias("improved"), F.count_if(d > 0).alias("worsened"),
        F.avg(F.abs(d)).alias("mean_abs_delta"), F.median(F.abs(d)).alias("median_abs_delta"), F.avg(d).alias("mean_delta"),
        F.percentile(d, 0.95).alias("p95_delta"), F.max(d).alias("max_delta"), F.min(d).alias("min_delta"),
        share((F.col(base) == 1) != (F.col(other) == 1)).alias("top1_flip_rate"),
        share((F.col(base) <= 10) & (F.col(other) > 10)).alias("top10_exit_rate"), F.count("*").alias("queries"),
    )


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """avg, median, p90, p95, p99, min, max and number of a timing."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.avg(v).alias("avg_v"), F.median(v).alias("p50"), F.percentile(v, 0.9).alias("p90"), F.percentile(v, 0.95).alias("p95"),
        F.percentile(v, 0.99).alias("p99"), F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.count(v).alias("n"),
    )


def five_numbers(v: str) -> list[Column]:
    return [F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, 0.1).alias("p10"), F.percentile(v, 0.9).alias("p90"), F.count(v).alias("n")]


def rank_distribution(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """(rank, n, share): the cumulative share of queries within each rank. One row a distinct rank, counted before the window."""
    by = ranks.groupBy(rank).agg(F.count("*").alias("n"))
    w = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy()
    return by.select(rank, "n", (F.sum("n").over(w) / F.sum("n").over(total)).alias("share"))


def log_histogram(ranks: DataFrame, top: float, bins: int = 30, rank: str = "rank") -> DataFrame:
    """Counts of log10 of the ranks in equal bins of [0, log10(top)]."""
    return ranks.groupBy(F.least(F.lit(bins - 1), F.floor(F.log10(rank) * (bins - 1) / F.log10(F.lit(float(top)))).cast("int")).alias("bin")).agg(F.count("*").alias("n"))


def progressive(steps: DataFrame, step: str, metric: str, least: float) -> DataFrame:
    """``steps`` with the gain on the step before and whether a run that stops below ``least`` has stopped by then."""
    w = Window.orderBy(step)
    rows = steps.withColumn("gain", F.col(metric) - F.lag(metric).over(w))
    low = F.coalesce(F.abs("gain") < least, F.lit(False)).cast("int")
    return rows.withColumn("stopped", F.sum(low).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) > 0)


def patience(steps: DataFrame, step: str, metric: str, wait: int) -> DataFrame:
    """``steps`` with the best metric so far, how many steps ago it was reached, and whether ``wait`` is used up."""
    run = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = steps.withColumn("best", F.max(metric).over(run))
    new = F.coalesce(F.col("best") > F.lag("best").over(Window.orderBy(step)), F.lit(True))
    rows = rows.withColumn("island", F.sum(new.cast("int")).over(run))
    bad = F.row_number().over(Window.partitionBy("island").orderBy(step)) - 1
    return rows.withColumn("bad", bad).withColumn("stop", F.col("bad") >= wait).drop("island")


def degraded(steps: DataFrame, step: str, metric: str, baseline: float, most: float, wait: int) -> DataFrame:
    """``steps`` with the relative degradation against a baseline, how many steps in a row were beyond ``most``, and whether a run that waits for ``wait`` of them stops."""
    loss = (F.lit(baseline) - F.col(metric)) / F.greatest(F.lit(baseline), F.lit(1e-8))
    run = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a step of one run
    rows = steps.withColumn("degradation", loss).withColumn("_good", (F.coalesce(F.col("degradation"), F.lit(0.0)) <= most).cast("int"))
    rows = rows.withColumn("_island", F.sum("_good").over(run))
    bad = F.sum(1 - F.col("_good")).over(Window.partitionBy("_island").orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("bad", bad).withColumn("stop", F.col("bad") >= wait).drop("_good", "_island")


def both_recalls(ranks: DataFrame, lists: DataFrame, ks: list[int]) -> DataFrame:
    """Recall by rank and by membership in the list of the best, side by side: they differ where equal scores or a short list cut the gold off.

    ``ranks``: qid, rank; ``lists``: qid, gold, top.
    """
    x = ranks.select("qid", "rank").join(lists.select("qid", F.array_position("top", F.col("gold")).alias("at")), "qid", "left")
    at = F.coalesce(F.col("at"), F.lit(0))
    return x.agg(*(share(F.col("rank") <= k).alias(f"rank_recall_{k}") for k in ks), *(share(at.between(1, k)).alias(f"list_recall_{k}") for k in ks), F.count("*").alias("queries"))
