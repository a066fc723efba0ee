"""Audits of splits and images (U1-U3, A18-A25, J6, J10-J12, D10, F9, F15-F19, TK7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkstrata.plans.staging import lookup

KEYS = {
    "full_row": ["mentions", "sentence", "imgPath", "answer"],
    "mention_context": ["mentions", "sentence"],
    "context": ["sentence"],
    "image": ["imgPath"],
}


def inventory(rows: DataFrame, by: str, counts: dict[str, list[str]]) -> DataFrame:
    """Rows and, for each name, distinct tuples of its columns, a null counting as a value."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), *(F.count_distinct(F.struct(*c)).alias(n) for n, c in counts.items()))


def duplicates(rows: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """(by, duplicates): rows beyond the first of each key, from two partial aggregations."""
    n = rows.groupBy(by, *keys).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg((F.sum("n") - F.count("*")).alias("duplicates"))


def overlaps(rows: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """(left, right, common, smaller, percent): distinct keys two splits share, nulls equal, and their share of the smaller side.

    One pass for all pairs: each key's set of splits, at most one entry a split, gives its pairs. Splits without a common key are
    in the result with 0.
    """
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(split)).alias("s"))
    size = per.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    pairs = per.filter(F.size("s") > 1).select("s", F.explode("s").alias("left")).select("left", F.explode("s").alias("right")).filter("left < right")
    common = pairs.groupBy("left", "right").agg(F.count("*").alias("common"))
    a, b = size.select(F.col("x").alias("left"), F.col("n").alias("nl")), size.select(F.col("x").alias("right"), F.col("n").alias("nr"))
    every = a.join(b, F.col("left") < F.col("right")).join(common, ["left", "right"], "left")  # a row a pair of splits
    small = F.least("nl", "nr")
    return every.select("left", "right", F.coalesce("common", F.lit(0)).alias("common"), small.alias("smaller"), F.round(F.coalesce("common", F.lit(0)) * 100 / small, 4).alias("percent"))


def overlap_sample(rows: DataFrame, split: str, left: str, right: str, key: str, n: int = 20) -> DataFrame:
    """The first n keys in order that both splits have."""
    both = rows.filter(F.col(split).isin(left, right)).groupBy(key).agg(F.count_distinct(split).alias("k")).filter("k = 2").select(key)
    return both.orderBy(key).limit(n)


def gold_image_leakage(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(split, mentions, leaked): mentions with a known answer, and those whose image is one of the entity's."""
    e = entities.select(F.col("qid").alias("_a"), "image_list", F.lit(True).alias("_known"))
    m = lookup(mentions.select("split", "imgPath", F.upper(F.trim("answer")).alias("_a")), e, "_a", 100_000).filter("_known")
    return m.groupBy("split").agg(F.count("*").alias("mentions"), F.count_if(F.coalesce(F.array_contains("image_list", F.col("imgPath")), F.lit(False))).alias("leaked"))


def file_pairs(mentions: DataFrame, entities: DataFrame, by: str) -> DataFrame:
    """(by, pairs, gold): mention and entity rows that share a file, and of these the entity that is the mention's answer. Counted, never listed.

    ``mentions``: ``by``, a (answer), p (file); ``entities``: distinct qid, p. Blank files are none.
    """
    m = mentions.filter("p <> ''").groupBy(by, "p", "a").agg(F.count("*").alias("n"))
    n = entities.filter("p <> ''").groupBy("p").agg(F.count("*").alias("e"))
    pairs = m.groupBy(by, "p").agg(F.sum("n").alias("n")).join(n, "p").groupBy(by).agg(F.sum(F.col("n") * F.col("e")).alias("pairs"))
    own = m.join(entities.select(F.col("qid").alias("a"), "p"), ["p", "a"]).groupBy(by).agg(F.sum("n").alias("gold"))
    return pairs.join(own, by, "left").select(by, "pairs", F.coalesce("gold", F.lit(0)).alias("gold"))


def all_labels(*columns: tuple[DataFrame, str]) -> DataFrame:
    """(label): every value that any of the columns has, once; nulls and empty texts are none. Arrays count by element."""
    out = None
    for rows, c in columns:
        x = F.explode(c) if dict(rows.dtypes)[c].startswith("array") else F.col(c)
        one = rows.select(x.alias("label")).filter("label <> ''").distinct()
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def samples(pairs: DataFrame, by: str, order: list[str], n: int = 20) -> DataFrame:
    """The first n rows of each value of ``by``; ranks are cut before the shuffle, so no task gets a whole group."""
    w = Window.partitionBy(by).orderBy(*order)
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def fingerprint(v: Column) -> tuple[Column, Column]:
    """Sign bits of a vector's first 64 numbers as two longs of 32 bits each."""
    bits = lambda at: F.aggregate(F.slice(v, at, 32), F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1) + F.when(x > 0, 1).otherwise(0))
    return bits(1), bits(33)


def hex_halves(c: Column) -> tuple[Column, Column]:
    """16 hex digits as two longs of 32 bits each, as a single long would overflow."""
    return F.conv(F.substring(c, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(c, 9, 8), 16, 10).cast("bigint")


def hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def hamming_classes(rows: DataFrame) -> DataFrame:
    """(hi, lo, rep, members, asks): one row a fingerprint; ``rows``: id, hi, lo. Null fingerprints are left out.

    ``asks``: any member's id is divisible by 100, the stated query set.
    """
    asks = F.coalesce(F.bool_or(F.col("id") % 100 == 0), F.lit(False))
    return rows.filter("hi is not null and lo is not null").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("members"), asks.alias("asks"))


def hamming_join(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(a, b, distance) of the classes of two sides at most ``radius`` bits apart, by pigeonhole banding: exact, not sampled.

    Cut into radius + 1 bands, two fingerprints within the radius agree in one. Sides are ``hamming_classes``, so copies
    are one row. A pair is taken in the first band that agrees, so none is met twice. For a radius of 7 or more bands are too narrow to part
    much; pass a stated query set as ``left`` then.
    """
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]

    def band(hi: Column, lo: Column, i: int) -> Column:
        s, e = cuts[i], cuts[i + 1]
        take = lambda half, at, to: F.shiftrightunsigned(half, 32 - to).bitwiseAND(F.lit((1 << (to - at)) - 1))
        if e <= 32:
            return take(hi, s, e)
        if s >= 32:
            return take(lo, s - 32, e - 32)
        return F.shiftleft(take(hi, s, 32), e - 32) + take(lo, 0, e - 32)

    def banded(df: DataFrame, x: str) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(i).alias("i"), band(F.col("hi"), F.col("lo"), i).alias("k")) for i in range(n)))
        return df.select(F.col("rep").alias(x), F.col("hi").alias(f"hi_{x}"), F.col("lo").alias(f"lo_{x}"), F.explode(keys).alias("e")).select("*", "e.i", "e.k").drop("e")

    pairs = banded(left, "a").join(banded(right, "b"), ["i", "k"])
    d = hamming((F.col("hi_a"), F.col("lo_a")), (F.col("hi_b"), F.col("lo_b")))
    first = F.lit(n)
    for i in reversed(range(n)):
        first = F.when(band(F.col("hi_a"), F.col("lo_a"), i) == band(F.col("hi_b"), F.col("lo_b"), i), i).otherwise(first)
    return pairs.withColumn("distance", d).filter((F.col("distance") <= radius) & (F.col("i") == first)).select("a", "b", "distance")


def phash(rows: DataFrame, pixels: str = "pixels") -> DataFrame:
    """``rows`` with ``phash``: 16 hex digits of the DCT of a 32 x 32 picture (1024 grey values); others and nulls give null.

    Bits of the low 8 x 8 terms above the median of the 63 without the constant one, which has a bit too.
    """
    k, x = np.meshgrid(np.arange(32), np.arange(32), indexing="ij")
    m = np.sqrt(2 / 32) * np.cos(np.pi * (2 * x + 1) * k / 64)
    m[0] = np.sqrt(1 / 32)

    @F.pandas_udf("string")
    def one(s: pd.Series) -> pd.Series:
        def bits(p):
            if p is None or len(p) != 1024:
                return None
            low = (m @ np.asarray(p, float).reshape(32, 32) @ m.T)[:8, :8].ravel()
            return f"{int(''.join('1' if b else '0' for b in low > np.median(low[1:])), 2):016x}"

        return s.map(bits)

    return rows.withColumn("phash", one(F.col(pixels)))


# The checks of the acceptance gate, in order.
CHECKS = ("normalized_cross_split_zero", "exact_image_bytes_cross_split_zero", "gold_entity_exact_image_bytes_zero", "answer_id_filename_zero", "perceptual_review_complete")


def six_part_gate(counts: DataFrame) -> DataFrame:
    """(name, n, passed): the five CHECKS and 'accepted', whether all pass. ``counts``: name, n of what each check must not find.

    A check without a count has not been made and fails.
    """
    wanted = counts.sparkSession.createDataFrame([(i, c) for i, c in enumerate(CHECKS)], "place int, name string")
    each = wanted.join(F.broadcast(counts.groupBy("name").agg(F.sum("n").alias("n")).filter(F.col("name").isin(*CHECKS))), "name", "left")
    each = each.select("name", "n", (F.coalesce(F.col("n"), F.lit(-1)) == 0).alias("passed"))
    return each.unionByName(each.agg(F.sum("n").alias("n"), F.bool_and("passed").alias("passed")).select(F.lit("accepted").alias("name"), "n", "passed"))


def gate(checks: DataFrame) -> DataFrame:
    """``checks`` (name, passed) with ``accepted``: whether all passed. Without checks there is no row, hence no acceptance."""
    return checks.join(F.broadcast(checks.agg(F.bool_and("passed").alias("accepted"))))


def order_hash(rows: DataFrame, key: str, columns: list[str], chunk: int = 10_000) -> DataFrame:
    """(chunk, sha): SHA-256 of the compact JSON of each run of ``chunk`` rows in the order of ``key`` (a whole number).

    Runs are ranges of the key, so no group grows with the table; the table's hash is that of the ordered hashes.
    """
    part = F.floor(F.col(key) / chunk)
    js = F.array_sort(F.collect_list(F.struct(F.col(key).alias("_k"), F.to_json(F.struct(*columns)).alias("j"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(js, lambda x: x["j"]), ","), F.lit("]"))
    return rows.groupBy(part.alias("chunk")).agg(F.sha2(text, 256).alias("sha"))
