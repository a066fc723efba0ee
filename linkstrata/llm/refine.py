"""Problem 5: records that differ in layout only, by progressive partition refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.functions.text import md5_key, same_file, squashed
from linkstrata.plans.staging import join_by_count, small, stage

FIELDS = ("mentions", "sentence", "answer", "imgPath")
HISTOGRAM = "etaoinrs0123"
RAW = "mentions string, sentence string, answer string, imgPath string, broken string"


def records(mentions: DataFrame, raw: DataFrame) -> DataFrame:
    """(id, four fields) of the mention rows and of the raw payloads; a broken payload is no record."""
    parsed = raw.select(
        F.col("raw_id").alias("id"),
        F.from_json("payload", RAW, {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}).alias("r"),
    ).filter(F.col("r").isNotNull() & F.col("r.broken").isNull() & F.col("id").isNotNull())
    return (
        mentions.filter(F.col("row_id").isNotNull())
        .select(F.col("row_id").alias("id"), *FIELDS)
        .unionByName(parsed.select("id", *(F.col(f"r.{f}").alias(f) for f in FIELDS)))
    )


def _stripped(rows: DataFrame) -> DataFrame:
    s = [squashed(F.col(c)) for c in FIELDS[:3]] + [same_file(F.col("imgPath"))]
    return rows.select("id", *(e.alias(f"s{i}") for i, e in enumerate(s)))


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(members, groups, rows): id, class of each record that shares one, and class, first_id, n of each class.

    Lengths of the stripped fields and counts of some letters part all records; only those of classes with several members are
    read again and digested, and their ids alone are sent to the second reading.
    """
    letters = [F.length(F.col("s1")) - F.length(F.replace(F.col("s1"), F.lit(x), F.lit(""))) for x in HISTOGRAM]
    cheap = F.xxhash64(*(F.length(f"s{i}") for i in range(4)), *letters)
    slim = stage(_stripped(rows).select("id", cheap.alias("cheap")).distinct(), "p5-slim")
    total = slim.count()
    several = slim.groupBy("cheap").agg(F.count("*").alias("n")).filter("n > 1")
    asked = stage(join_by_count(slim, several, ["cheap"], "n", total).select("id", "cheap"), "p5-asked")
    # The texts meet the ids before anything is made of them, so what has no likeness is neither stripped nor digested again.
    again = _stripped(rows.join(small(asked.select("id").distinct()), "id"))
    full = stage(again.select("id", md5_key(*(F.col(f"s{i}") for i in range(4))).alias("class")).distinct(), "p5-full")
    groups = full.groupBy("class").agg(F.min("id").alias("first_id"), F.countDistinct("id").alias("n"))
    return full, stage(groups.filter("n > 1"), "p5-groups"), total


def formatting_copies(rows: DataFrame) -> DataFrame:
    """Rows (first_id, copy_id, copies): each member of a group but the smallest id, and the group's size.

    ``rows``: id and the four fields. Two records are the same when their fields agree but for white
    space, letter case and punctuation, and name the same file in any path form; null and empty are
    equal. The classes are refined in two steps, see ``classes``. Shuffles carry ids and digests, and
    hot classes are joined by broadcast of fewer than 1000 keys.
    An empty input gives no rows. Ids given twice with one content count as one record.
    """
    members, groups, total = classes(rows)
    return (
        join_by_count(members, groups, ["class"], "n", total)
        .filter("id > first_id")
        .select("first_id", F.col("id").alias("copy_id"), F.col("n").alias("copies"))
    )


def copy_counts(rows: DataFrame) -> DataFrame:
    """(first_id, copies): one row for each distinct record, under its smallest id, and how many records it stands for, itself included."""
    members, groups, total = classes(rows)
    left_out = join_by_count(members, groups, ["class"], "n", total).filter("id > first_id").select("id")
    alone = rows.select("id").distinct().join(left_out, "id", "left_anti")
    return alone.join(groups.select(F.col("first_id").alias("id"), "n"), "id", "left").select(F.col("id").alias("first_id"), F.coalesce("n", F.lit(1)).alias("copies"))
