"""Layers of a model as rows: selection, grouping and sensitivity (P17, P18, Q13, Q18, Q21, TK9, TK10, D9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def selected(name: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a name holds one of ``include`` (all do when it is empty) and none of ``exclude``. Null names aren't selected."""
    has = lambda words: F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w)), F.lit(False))
    return (has(include) if include else name.isNotNull()) & (~has(exclude) if exclude else F.lit(True))


def group(name: Column) -> Column:
    """text or vision, and attention, mlp or other; projections are a group of their own."""
    side = F.when(F.contains(name, F.lit("vision")), "vision").when(F.contains(name, F.lit("text")), "text").otherwise("other")
    part = F.when(F.contains(name, F.lit("attn")), "attention").when(F.contains(name, F.lit("mlp")) | F.contains(name, F.lit("fc")), "mlp").otherwise("other")
    return F.when(F.contains(name, F.lit("projection")), "projection").otherwise(F.concat_ws("_", side, part))


def ranking(snr: DataFrame, low: str = "int4", high: str = "int8") -> DataFrame:
    """(label, gap, place): layers by what they lose from the higher to the lower mode, most sensitive first; ties by label."""
    wide = snr.groupBy("label").pivot("mode", [low, high]).agg(F.max("snr_db"))
    gap = (F.col(high) - F.col(low)).alias("gap")
    rows = wide.select("label", gap)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("gap"), "label")))  # a row a layer


def degradation(rows: DataFrame, ids: list[str], metrics: list[str], baseline: float) -> DataFrame:
    """(ids, metric, degradation, relative): the baseline less each metric, and that over the baseline, which counts as 1e-8 at least."""
    gap = F.lit(baseline) - F.col("value")
    return rows.unpivot(ids, metrics, "metric", "value").select(*ids, "metric", gap.alias("degradation"), (gap / F.greatest(F.lit(baseline), F.lit(1e-8))).alias("relative"))
