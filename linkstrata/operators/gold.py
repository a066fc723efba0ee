"""Gold labels, candidates and validity of mention rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstrata.plans.staging import lookup


def last_wins(rows: DataFrame, key: str, position: str, *values: str) -> DataFrame:
    """One row a key: the values of the row with the highest position. Null keys are left out."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*values), position).alias("v")).select(key, *(F.col(f"v.{v}").alias(v) for v in values))


def first_seen(rows: DataFrame, keys: list[str], position: Column) -> DataFrame:
    """The first row of each key by position, without a sort: partial minima are merged."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), position).alias("v")).select(*keys, "v.*")


def resolve_gold(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(row_id, gold, by): the entity of each mention by its answer, else by title; mentions without either are left out.

    Of several entities with one name the last by id wins. 'nil' and null answers have no id match.
    """
    ids = entities.select(F.col("qid").alias("answer_key"), F.col("id").alias("by_id"))
    titles = last_wins(entities.withColumnRenamed("entity_name", "title"), "title", "id", "id").withColumnRenamed("id", "by_title")
    m = mentions.select("row_id", F.upper(F.trim("answer")).alias("answer_key"), F.col("mentions").alias("title"))
    m = lookup(lookup(m, ids, "answer_key"), titles, "title")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_title").isNotNull(), "title")
    return m.select("row_id", F.coalesce("by_id", "by_title").alias("gold"), how.alias("by")).filter("gold is not null")


def candidates(mentions: DataFrame, entities: DataFrame, n: int = 10) -> DataFrame:
    """(row_id, place, id): the first n candidates but the answer, in order, as entity ids; unknown ones are left out."""
    c = mentions.filter("cands is not null").select("row_id", F.array_remove(F.slice("cands", 1, n), F.coalesce("answer", F.lit(""))).alias("c"))
    c = c.select("row_id", F.posexplode("c").alias("place", "qid"))
    return lookup(c, entities.select("qid", "id"), "qid").filter("id is not null").select("row_id", "place", "id")


def enrich(rows: DataFrame, source: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """``rows`` with the value that ``source`` has under the same keys, nulls equal, the last row winning."""
    # One digest stands for the keys, nulls told from empty texts.
    key = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    s = source.withColumn("_key", key).groupBy("_key").agg(F.max_by(value, position).alias(f"{value}_found"))
    return lookup(rows.withColumn("_key", key), s, "_key", 100_000).drop("_key")


def drop_reason(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """``mentions`` with the first reason to drop the row, or null."""
    known = entities.select(F.col("qid").alias("_key"), F.lit(True).alias("_qid"))
    m = lookup(mentions.withColumn("_key", F.upper(F.trim("answer"))), known, "_key")
    why = (
        F.when(F.col("_key").isNull(), "no answer").when(F.col("_key") == "NIL", "nil").when(F.col("_qid").isNull(), "unknown entity")
        .when(F.coalesce(F.trim("imgPath"), F.lit("")) == "", "no image")
    )
    return m.withColumn("reason", why).drop("_key", "_qid")


def dense_positions(rows: DataFrame, key: str, name: str = "position") -> DataFrame:
    """``rows`` with their 0-based place in the order of ``key`` (unique), without a single-task window.

    Rows are range-partitioned and sorted; the counts of the partitions before give each its offset.
    """
    from pyspark.sql import Window

    from linkstrata.plans.staging import stage

    # Staged, as another run of the same sort may cut the ranges elsewhere.
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key)
    placed = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = stage(placed, "positions")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))  # a row a partition
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def known_gold(rows: DataFrame, gold: str, entities: int) -> DataFrame:
    """Rows whose gold is the number of an entity, below their count; null and negative ones are none."""
    return rows.filter((F.col(gold) >= 0) & (F.col(gold) < entities))


def counted(rows: DataFrame, keep: Column, by: list[str] | None = None) -> DataFrame:
    """(by, seen, kept, skipped): how many rows a filter keeps; null counts as not kept."""
    kept = F.count_if(F.coalesce(keep, F.lit(False)))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("seen"), kept.alias("kept"), (F.count("*") - kept).alias("skipped"))


def with_new_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(qid, name): the known entities, and for each answer that names none of them one with the name of its first mention by row_id."""
    m = mentions.select(F.upper(F.trim("answer")).alias("qid"), "mentions", "row_id").filter("qid is not null and qid <> 'NIL'")
    fresh = m.groupBy("qid").agg(F.min_by("mentions", "row_id").alias("name")).join(entities.select("qid"), "qid", "left_anti")
    return entities.select("qid", F.col("entity_name").alias("name")).unionByName(fresh)
