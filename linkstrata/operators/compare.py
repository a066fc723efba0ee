"""Comparing runs: deltas to a baseline, frontiers, recommendations, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PARTS = 256


def deltas(rows: DataFrame, baseline: Column, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """``rows`` with <metric>_delta to the group's baseline row; null where a group has none. Several baselines: the smallest by all columns."""
    keys = by or []
    base = rows.filter(baseline).groupBy(*keys).agg(F.min(F.struct(*metrics)).alias("base"))
    if keys:
        joined = rows.join(base, keys, "left")
    else:
        joined = rows.join(F.broadcast(base))  # one row
    return joined.select(*rows.columns, *((F.col(m) - F.col(f"base.{m}")).alias(f"{m}_delta") for m in metrics))


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is above 0, else null."""
    return F.when(b > 0, a / b)


def pareto(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that none beats with a smaller or equal x and a larger or equal y, one of them strictly. Equal points all stay.

    A point stays if its y is the best of its x and above that of all smaller x. Distinct x are first parted into PARTS sets
    by hash, each keeping its own front, as only points of such fronts can be on the whole one; one sorted pass over what
    is left follows. Rows with a null in either take no part.
    """
    best = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.max(y).alias("_y"))

    def front(points: DataFrame, w: WindowSpec) -> DataFrame:
        before = F.max("_y").over(w.orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
        return points.withColumn("_before", before).filter("_before is null or _y > _before").drop("_before")

    local = front(best.withColumn("_p", F.pmod(F.hash(x), F.lit(PARTS))), Window.partitionBy("_p")).drop("_p")
    whole = front(local, Window.partitionBy()).select(F.col(x).alias("_x"), "_y")
    return rows.join(whole, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left_semi")


def recommend(rows: DataFrame, metric: str, size: str, loss: float, baseline: Column) -> DataFrame:
    """Modes that lose at most ``loss`` of the metric and are smaller than the baseline."""
    d = deltas(rows, baseline, [metric, size])
    return d.filter((F.col(f"{metric}_delta") >= -loss) & (F.col(f"{size}_delta") < 0))


def find_one(rows: DataFrame, **keys) -> DataFrame:
    """The first row by all columns that has these values; raises where there is none."""
    cond = F.lit(True)
    for k, v in keys.items():
        cond = cond & F.col(k).eqNullSafe(F.lit(v))
    found = rows.filter(cond).orderBy(*rows.columns).limit(1)
    if not found.head(1):
        raise LookupError(f"no row with {keys}")
    return found


def conservative(rows: DataFrame, chosen: dict, baseline: dict, losses: list[str], cost: str) -> DataFrame:
    """The chosen row with its losses against a baseline row and how many times cheaper it is; raises where either is missing."""
    base = find_one(rows, **baseline).select(*(F.col(c).alias(f"_{c}") for c in [*losses, cost]))
    own = find_one(rows, **chosen).join(F.broadcast(base))
    deltas_ = [(F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in losses]
    return own.select(*rows.columns, *deltas_, (F.col(f"_{cost}") / F.greatest(F.col(cost), F.lit(1e-9))).alias(f"{cost}_ratio"))


def tradeoffs(rows: DataFrame, name: str, flat: str, quality: list[str], size: str) -> DataFrame:
    """``rows`` (an index each) against the flat one: drops of quality, what they save and how many times smaller they are."""
    base = find_one(rows, **{name: flat}).select(*(F.col(c).alias(f"_{c}") for c in [*quality, size]))
    drops = [(F.col(f"_{c}") - F.col(c)).alias(f"{c}_drop") for c in quality]
    saved = (F.col(f"_{size}") - F.col(size)).alias("saving")
    return rows.join(F.broadcast(base)).select(*rows.columns, *drops, saved, (F.col(f"_{size}") / F.greatest(F.col(size), F.lit(1e-12))).alias("compression"))


def union_rows(parts: list[DataFrame]) -> DataFrame:
    """All rows, all columns, null where a part lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tall(rows: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return rows.unpivot(ids, values, "metric", "value")


def lenient(c: Column, kind: str = "double", default=0) -> Column:
    """A number out of a string, the default where it isn't one; whole numbers are cut towards zero."""
    d = F.when(c.cast("string").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), c.try_cast("double"))
    return F.coalesce(d if kind == "double" else d.try_cast(kind), F.lit(default).cast(kind))
