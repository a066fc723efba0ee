"""Runs of experiments: isolated tasks, timings, environment, validity of what an earlier run left (I8-I10, O3, O7, TK11, E8, S11)."""

from __future__ import annotations

import platform
import statistics
import sys
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prioritised(tasks: DataFrame, priority: str = "priority", order: str = "seq") -> DataFrame:
    """Tasks with the highest priority first, equal ones as they came; null priorities last."""
    return tasks.orderBy(F.desc_nulls_last(priority), order)


def isolated(tasks: DataFrame, work: Callable[[dict], float], key: str) -> DataFrame:
    """(key, value, status, message): ``work`` of each task, one after the other in as many places as there are partitions.

    A task that raises is a row with status 'error', or 'oom' where memory ran out, and its message; the others go on.
    """

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    out.append((row[key], float(work(row)), "ok", None))
                except Exception as e:  # noqa: BLE001
                    out.append((row[key], None, "oom" if isinstance(e, MemoryError) or "out of memory" in str(e).lower() else "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "value", "status", "message"])

    kind = dict(tasks.dtypes)[key]
    return tasks.mapInPandas(run, f"{key} {kind}, value double, status string, message string")


def timed(action: Callable[[], object], warm_up: int = 1, repeats: int = 3) -> dict[str, float]:
    """Mean, population deviation, smallest and largest seconds of an action after a warm-up."""
    for _ in range(warm_up):
        action()
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        action()
        took.append(time.perf_counter() - began)
    return {"mean_s": statistics.fmean(took), "std_s": statistics.pstdev(took), "min_s": min(took), "max_s": max(took), "repeats": repeats}


def environment(spark: SparkSession) -> DataFrame:
    """(name, value): what a run was made with: versions, platform, executor memory and cores, and the driver's memory peak in MB."""
    import resource

    conf = spark.sparkContext.getConf()
    values = {
        "python": sys.version.split()[0], "platform": platform.platform(), "spark": spark.version, "master": spark.sparkContext.master,
        "parallelism": str(spark.sparkContext.defaultParallelism), "executor_memory": conf.get("spark.executor.memory", "1g"),
        "driver_peak_mb": str(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024),
    }
    return spark.createDataFrame(sorted(values.items()), "name string, value string")


def fresh(cache: DataFrame, version: str, column: str = "version") -> DataFrame:
    """``cache`` if all its rows are of a version; raises where others, or none, are: vectors of two models are never mixed."""
    seen = [r[0] for r in cache.select(column).distinct().limit(3).collect()]
    if seen != [version]:
        raise ValueError(f"stale cache: wanted {version}, found {sorted(map(str, seen))}")
    return cache


def resumable(manifest: DataFrame, wanted: DataFrame, version: str, keys: tuple[str, ...] = ("tensor", "mode")) -> tuple[DataFrame, DataFrame]:
    """(kept, todo) of the wanted keys: those that an earlier run finished with the same modes and version, and those to do again."""
    done = manifest.filter((F.col("version") == version) & F.col("complete")).select(*keys).distinct()
    return wanted.join(done, list(keys), "left_semi"), wanted.join(done, list(keys), "left_anti")
