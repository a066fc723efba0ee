"""Presence of files and progress of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages of a download in order.
STAGES = ["pending", "downloaded", "verified", "extracted", "unpacked", "arranged", "done"]


def coverage(wanted: DataFrame, present: DataFrame, name: str, by: str, least: float = 99.0) -> DataFrame:
    """(by, checked, found, percent, covered): how many wanted names are present. Nothing to check is 100 percent. Null names are left out."""
    have = present.select(F.col(name)).filter(F.col(name).isNotNull()).distinct().withColumn("_hit", F.lit(1))
    each = wanted.filter(F.col(name).isNotNull()).select(by, name).distinct().join(have, name, "left")
    n = each.groupBy(by).agg(F.count("*").alias("checked"), F.count("_hit").alias("found"))
    every = wanted.select(by).distinct().alias("w").join(n.alias("n"), F.col(f"w.{by}").eqNullSafe(F.col(f"n.{by}")), "left")
    c, f = F.coalesce("checked", F.lit(0)), F.coalesce("found", F.lit(0))
    p = F.when(c > 0, 100.0 * f / c).otherwise(100.0)
    return every.select(f"w.{by}", c.alias("checked"), f.alias("found"), p.alias("percent"), (p > least).alias("covered"))


def folder_counts(files: DataFrame, expected: DataFrame, folder: str = "folder") -> DataFrame:
    """(folder, files): how many files each expected folder holds, null where there is no such folder."""
    n = files.groupBy(folder).agg(F.count("*").alias("files"))
    return expected.select(folder).distinct().join(n, folder, "left")


def stage_number(c: Column) -> Column:
    """Place of a stage in the order, -1 for an unknown one."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), c), F.lit(0)).cast("int") - 1


def advance(state: DataFrame, events: DataFrame, key: str = "name") -> DataFrame:
    """(key, stage): each item's furthest stage of the stored state and new events; a late event never sets it back."""
    both = state.select(key, "stage").unionByName(events.select(key, "stage")).filter(F.col(key).isNotNull())
    return both.groupBy(key).agg(F.max_by("stage", stage_number(F.col("stage"))).alias("stage"))


def todo(state: DataFrame, wanted: DataFrame, stage: str, key: str = "name") -> DataFrame:
    """Items that haven't reached a stage: what a resumed run works on."""
    done = state.filter(stage_number(F.col("stage")) >= STAGES.index(stage)).select(key)
    return wanted.join(done, key, "left_anti")


def phases(rows: DataFrame, by: list[str], parts: list[str], total: str) -> DataFrame:
    """Each phase's share of the total, and what no phase accounts for (0 at least)."""
    sums = rows.groupBy(*by).agg(*(F.sum(F.coalesce(p, F.lit(0.0))).alias(p) for p in parts), F.sum(total).alias(total))
    timed = sum((F.col(p) for p in parts), F.lit(0.0))
    share = [(F.when(F.col(total) > 0, F.col(p) / F.col(total))).alias(f"{p}_share") for p in parts]
    return sums.select(*by, *share, F.greatest(F.col(total) - timed, F.lit(0.0)).alias("unattributed"))


def failed(message: Column) -> Column:
    """Kind of failure by its message: oom, error, or null without one."""
    return F.when(F.contains(F.lower(message), F.lit("out of memory")), "oom").when(F.coalesce(F.trim(message), F.lit("")) != "", "error")
