"""What several of the operators use: markup, slips of typing, words as numbers, and rows from pairs of classes."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.plans.staging import small, stage

MARKUP = re.compile(r"\[\[(?:File|Image|Category)\s*:[^\]]*\]\]|<[^<>]{0,500}>|\{\{[^{}]*\}\}|\bhttps?://\S+", re.I)
MOST_BITS = 28
"""A filter has at most 2 ** MOST_BITS bits, 32 MB, whatever it is of."""
CHUNK = 1 << 16
PART = 20_000
"""Rows of a class that meet another class at once."""


def slips(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) from a to b, or most + 1 when there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [far] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            v = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now[j] = v
        if min(now) > most:
            return far
        before, last = last, now
    return min(last[-1], far)


def coded(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit codes of all words one after the other, owner of each, number of words of each list); each distinct word is hashed once."""
    code: dict[str, int] = {}
    n = np.array([len(ws) for ws in lists], np.int64)
    flat = np.fromiter((code.setdefault(w, len(code)) for ws in lists for w in ws), np.int64, int(n.sum()))
    own = pd.util.hash_array(np.array(list(code), dtype=object), categorize=False) if code else np.zeros(0, np.uint64)
    return own[flat], np.repeat(np.arange(len(lists)), n), n


def hashed(texts: np.ndarray) -> np.ndarray:
    """64-bit hashes of an array of strings, the same in every process."""
    return pd.util.hash_array(texts, categorize=False)


class Filter:
    """A Bloom filter of 64-bit hashes with two probes."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    @staticmethod
    def places(h: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return h & mask, (h >> np.uint64(32)) & mask

    def has(self, h: np.ndarray) -> np.ndarray:
        yes = np.ones(len(h), bool)
        for at in self.places(h, self.mask):
            yes &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return yes


def filter_of(rows: DataFrame, column: str, n: int) -> Filter:
    """The filter of a staged column of some n values, 64-bit hashes or texts: parts of it are made by partition and united; the driver gets 2 ** MOST_BITS bits at most."""
    bits = 1 << min(MOST_BITS, max(20, int(16 * n).bit_length()))
    mask = np.uint64(bits - 1)

    def parts(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            x = b[column].to_numpy()
            at = np.unique(np.concatenate(Filter.places(hashed(x) if x.dtype == object else x.view(np.uint64), mask))).astype(np.int64)
            for c in np.unique(at // CHUNK):
                own.setdefault(int(c), np.zeros(CHUNK, bool))[at[at // CHUNK == c] % CHUNK] = True
        yield pd.DataFrame({"chunk": list(own), "bits": [np.packbits(x, bitorder="little").tobytes() for x in own.values()]})

    def unite(g: pd.DataFrame) -> pd.DataFrame:
        x = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in g.bits])
        return pd.DataFrame({"chunk": g.chunk[:1], "bits": [x.tobytes()]})

    kind = "chunk int, bits binary"
    whole = np.zeros(bits // 8, np.uint8)
    for r in rows.select(column).mapInPandas(parts, kind).groupBy("chunk").applyInPandas(unite, kind).collect():
        whole[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return Filter(whole)


def in_chunks(sizes: list[int], most: int):
    """Slices of consecutive items whose sizes sum to at most ``most``; a larger item is alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def expand(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of pairs of classes: ``pairs`` (class_a, class_b, ...), ``left`` (class_a, ...), ``right`` (class_b, ...).

    A class of more than PART rows is parted by hash, and two classes meet part by part, so that a task gets a part of
    each, however many rows a class has. ``left`` and ``right`` should be staged.
    """

    def parts(members: DataFrame, x: str) -> tuple[DataFrame, DataFrame]:
        big = members.groupBy(f"class_{x}").agg(F.ceil(F.count("*") / PART).alias(f"of_{x}")).filter(f"of_{x} > 1")
        big = stage(big, "parts")
        whole = F.coalesce(f"of_{x}", F.lit(1).cast("long"))
        lot = F.pmod(F.xxhash64(*members.columns), whole)
        return members.join(small(big), f"class_{x}", "left").withColumn(f"part_{x}", lot).drop(f"of_{x}"), big

    (left, big_a), (right, big_b) = parts(left, "a"), parts(right, "b")
    for x, big in (("a", big_a), ("b", big_b)):
        whole = F.coalesce(f"of_{x}", F.lit(1).cast("long"))
        pairs = pairs.join(small(big), f"class_{x}", "left").withColumn(f"part_{x}", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1))).drop(f"of_{x}")
    a, b = ["class_a", "part_a"], ["class_b", "part_b"]
    return pairs.join(left, a).join(pairs.select(*a, *b).join(right, b), a + b)
