"""Problem 2: same or near-same records across splits, by minwise hashing of word shingles in banded buckets."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.functions.text import md5_key, same_file, spaced, squashed
from linkstrata.llm.common import expand, slips
from linkstrata.plans.staging import join_by_count, join_salted, small, stage

BANDS, ROWS = 16, 3
MEET = 256
"""A bucket whose lesser side has more records is parted by image, and one that still has by letters of the mention."""
AGREE = 0.8
MEETS_NONE, NONE = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64), np.uint64(0x8EBC6AF09C88C6E3)
"""Salts under which train rows with an image meet held-out rows without, the other way round, and rows without meet."""
MERSENNE = np.uint64((1 << 61) - 1)


def may_slip(a: str, b: str) -> int:
    """How many slips of typing two mentions of these lengths may have: one, and one more for each 12 letters."""
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 + n // 12


def letters(mention: str) -> int:
    """64 bits: for each of 32 classes of letters whether the mention has one, and whether it has more.

    A slip changes the counts of at most two classes, each by one, so two bits at most; a swap changes none.
    """
    bits = 0
    for c in mention:
        at = 2 * (ord(c) % 32)
        bits |= 2 << at if bits >> at & 1 else 1 << at
    return bits - (bits >> 63 << 64)


def parted(keys: np.ndarray, bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each): finer keys by mention, of which any two rows of a key share one if their mentions may be slips of each other.

    k slips change at most 2k of 2k + 2 groups of letters, so two groups stay: there is a key for every two groups, and for every
    k that a pair with this row may have, which hangs on the shorter mention.
    """
    most = np.where(sizes < 4, 0, 1 + sizes // 12)
    least = np.maximum(sizes - most, 0)
    least = np.where(least < 4, 0, 1 + least // 12)
    out, at = [], []
    for k in range(int(most.max(initial=-1)) + 1):
        rows = np.flatnonzero((least <= k) & (k <= most))
        if not len(rows):
            continue
        groups = [sum(3 << 2 * c for c in range(g, 32, 2 * k + 2)) for g in range(2 * k + 2)]
        for i, (g, h) in enumerate(itertools.combinations(groups, 2)):
            x = (bits[rows].view(np.uint64) & np.uint64(g | h)) + np.uint64(k * 1_000_003 + i + 1)
            for _ in range(2):
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            x = ((x ^ keys[rows].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            out.append(x)
            at.append(rows)
    return np.concatenate(out or [keys[:0]]), np.concatenate(at or [np.zeros(0, np.int64)])


def in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    hi = 0
    while hi < min(len(a), len(b)) and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return lo + hi + row[-1]


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20250117)
    return rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64), rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64)


def band_keys(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One 64-bit key for each text and band: the band's minima over all of the text's words; 64 bits that have one
    for each word, so that a word of one text only differs in one bit at most; and the number of words.
    """
    words = [t.split(" ") for t in texts]
    code: dict[str, int] = {}
    flat = np.fromiter((code.setdefault(w, len(code)) for ws in words for w in ws), np.int64)
    own = pd.util.hash_array(np.array(list(code), dtype=object), categorize=False) & np.uint64(0xFFFFFFFF)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]]).astype(np.int64)
    mult, add = _constants()
    out = np.zeros((len(words), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        h = ((own * mult[k] + add[k]) % MERSENNE).astype(np.uint32)
        low = np.minimum.reduceat(h[flat], starts).astype(np.uint64)
        out[:, k // ROWS] = (out[:, k // ROWS] ^ low) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k // ROWS] ^= out[:, k // ROWS] >> np.uint64(29)
    for b in range(BANDS):
        out[:, b] ^= np.uint64(b + 1)
        out[:, b] *= np.uint64(0xD6E8FEB86659FD93)
    bits = np.bitwise_or.reduceat(np.uint64(1) << (own[flat] % np.uint64(64)), starts)
    return out.view(np.int64), bits.view(np.int64), np.array([len(w) for w in words], np.int32)


def overlap_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of equal records (class_a in train, class_b in another split, jaccard of their words) that hold the
    same record, and rows (row_id, train, split, source, class).

    ``rows``: row_id, mentions, sentence, imgPath, split, source. The mention must agree but for case,
    punctuation, spacing and slips of typing, the image must be the same file or missing on a side,
    and four fifths of the longer sentence's words must agree in order. Buckets hold distinct records
    (a digest stands for all its copies in a split), so a group of copies of any size costs one entry a
    band. Pairs of a bucket are those whose image, letters and words differ no more than they may, and a bucket with
    more than MEET records on both sides is parted by image, then by letters of the mention that slips leave as they are.
    Shingles are all words of the sentence. Rows without any word in the sentence are compared by equality of the digest only through
    the same path (their one shingle is '').
    """
    own = rows.filter("row_id is not null and split is not null").select(
        "row_id",
        (F.col("split") == "train").alias("train"),
        "split",
        "source",
        squashed(F.regexp_replace("mentions", "&amp;", "&")).alias("m"),
        spaced(F.regexp_replace("sentence", "&amp;", "&")).alias("s"),
        same_file(F.col("imgPath")).alias("p"),
    )
    own = own.withColumn("rec", F.xxhash64("m", "s", "p"))

    def entries(batches):
        known: set[tuple[int, bool]] = set()
        for b in batches:
            fresh = [x not in known and not known.add(x) for x in zip(b.rec, b.train)]
            if len(known) > 500_000:
                known.clear()
            b = b[fresh]
            if not len(b):
                continue
            keys, words, count = band_keys(b.s)
            path = np.where(b.p == "", 0, pd.util.hash_array(b.p.to_numpy(dtype=object), categorize=False) | np.uint64(1)).astype(np.uint64)
            each = {
                "rec": b.rec.to_numpy(), "side": b.train.to_numpy(np.int8), "letters": np.array([letters(m) for m in b.m], np.int64), "size": b.m.str.len().to_numpy(np.int32),
                "words": words, "count": count, "path": (path >> np.uint64(32)).astype(np.uint32).view(np.int32) | (path > 0),
            }
            yield pd.DataFrame({"key": keys.ravel(), **{c: np.repeat(x, BANDS) for c, x in each.items()}})

    def by_image(batches):
        for b in batches:
            train, none, path = b.side.to_numpy() == 1, b.path.to_numpy() == 0, b.path.to_numpy().astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            # Records with other images never meet in a bucket: with an image they meet the same one or none.
            for rows, salt in (
                (~none, path), (~none, np.where(train, *MEETS_NONE)), (none, np.where(train, *MEETS_NONE[::-1])), (none, np.full(len(b), NONE)),
            ):
                yield b[rows].assign(key=((b.key.to_numpy().view(np.uint64) ^ salt)[rows] * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))

    def by_letters(batches):
        for b in batches:
            keys, at = parted(*(b[c].to_numpy() for c in ("key", "letters", "size")))
            yield b.iloc[at].assign(key=keys)

    kind = "key bigint, rec bigint, side tinyint, letters bigint, size int, words bigint, count int, path int"
    cols = [c.split()[0] for c in kind.split(", ")]

    def two_sided(x: DataFrame) -> DataFrame:
        # Buckets are counted by parts and rows meet the counts, so no task gets a bucket.
        x = stage(x, "p2-entries")
        n = x.groupBy("key").agg(F.sum("side").alias("a"), F.count("*").alias("n")).filter("a > 0 and a < n")
        n = stage(n.select("key", "n", (F.least("a", F.col("n") - F.col("a")) > MEET).alias("hot")), "p2-keys")
        return stage(join_by_count(x, small(n), ["key"], "n", x.count()).select(*cols, "hot"), "p2-buckets")

    shorter, longest = F.least("a.size", "b.size"), F.greatest("a.count", "b.count")
    differ = lambda c: F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")))
    alike = (
        (F.least("a.count", "b.count") >= AGREE * longest - 1e-9)
        & (differ("words") <= F.col("a.count") + F.col("b.count") - 2 * AGREE * longest + 1e-9)
        & (differ("letters") <= 2 * F.when(shorter < 4, 0).otherwise(1 + F.floor(shorter / 12)))
        & F.expr("a.path = b.path or a.path = 0 or b.path = 0")
    )

    def meet(x: DataFrame) -> DataFrame:
        # One condition over both sides keeps the two inputs alike, so that the shuffle is made once.
        x = x.select(*cols).repartition("key").distinct()
        both = x.alias("b").join(x.alias("a"), (F.col("a.key") == F.col("b.key")) & (F.col("b.side") < F.col("a.side")) & alike)
        return both.select(F.col("a.rec").alias("rec_a"), F.col("b.rec").alias("rec_b"))

    buckets = two_sided(own.select("rec", "train", "m", "s", "p").mapInPandas(entries, kind))
    near, hot = meet(buckets.filter("not hot")), buckets.filter("hot").select(*cols)
    if hot.head(1):
        buckets = two_sided(hot.mapInPandas(by_image, kind))
        near, hot = near.unionByName(meet(buckets.filter("not hot"))), buckets.filter("hot").select(*cols)
        if hot.head(1):
            near = near.unionByName(meet(hot.mapInPandas(by_letters, kind)))
    near = stage(near.distinct(), "p2-near")

    asked = stage(near.select(F.explode(F.array("rec_a", "rec_b")).alias("rec")).distinct(), "p2-asked")
    members = stage(own.join(small(asked), "rec").withColumn("text", md5_key(F.col("m"), F.col("s"), F.col("p"))), "p2-members")
    texts = stage(members.groupBy("rec", "text").agg(*(F.min(c).alias(c) for c in "msp")), "p2-texts")
    both = near
    for x in "ab":  # a record may be near very many
        both = join_salted(both, texts.select(*(F.col(c).alias(f"{c}_{x}") for c in ("rec", "text", *"msp"))), [f"rec_{x}"])
        both = stage(both, "p2-both") if x == "a" else both

    @F.pandas_udf("double")
    def agree(m_a: pd.Series, m_b: pd.Series, s_a: pd.Series, s_b: pd.Series) -> pd.Series:
        """Jaccard similarity of the words of two records that agree, else null."""

        def one(a: str, b: str, s: str, t: str) -> float | None:
            if slips(a, b, most := may_slip(a, b)) > most:
                return None
            s, t = s.split(" "), t.split(" ")
            most_words, u, v = max(len(s), len(t)), set(s), set(t)
            alike = len(u & v) / len(u | v)
            # Agreeing words bound the Jaccard similarity from below unless words repeat; then order decides alone.
            if len(u) == len(s) and len(v) == len(t) and alike < 2 * AGREE - 1 - 1e-9:
                return None
            return alike if in_order(s, t) >= AGREE * most_words - 1e-9 else None

        return pd.Series([one(*x) for x in zip(m_a, m_b, s_a, s_b)], dtype="float64")

    alike = F.col("text_a") == F.col("text_b")
    differ = both.filter(~alike).filter("p_a = p_b or p_a = '' or p_b = ''").withColumn("jaccard", agree("m_a", "m_b", "s_a", "s_b")).filter("jaccard is not null")
    pairs = differ.unionByName(both.filter(alike).withColumn("jaccard", F.lit(1.0)))
    pairs = stage(pairs.select(F.col("text_a").alias("class_a"), F.col("text_b").alias("class_b"), "jaccard"), "p2-pairs")
    return pairs, members.select("row_id", "train", "split", "source", F.col("text").alias("class"))


def split_overlaps(rows: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b, split, source, jaccard) of one train row and one row of another split that hold the same record.

    ``split`` and ``source`` are those of the held-out row. See ``overlap_classes``.
    """
    pairs, members = overlap_classes(rows)
    a = members.filter("train").select(F.col("class").alias("class_a"), F.col("row_id").alias("a"))
    b = members.filter("not train").select(F.col("class").alias("class_b"), F.col("row_id").alias("b"), "split", "source")
    found = expand(pairs, a, b).filter("a <> b")
    return found.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "split", "source", "jaccard")


def overlap_report(rows: DataFrame) -> DataFrame:
    """(split, source, rows, repeated, pairs): held-out rows, those that repeat train rows, and their pairs with these. Null sources are one group."""
    pairs, members = overlap_classes(rows)
    # Classes are counted, not expanded: a class of n train rows gives each of its held-out rows n pairs.
    train = members.filter("train").groupBy(F.col("class").alias("class_a")).agg(F.countDistinct("row_id").alias("n"))
    links = pairs.join(train, "class_a").groupBy(F.col("class_b").alias("class")).agg(F.sum("n").alias("pairs"))
    held = members.filter("not train").groupBy("class", "split", "source").agg(F.count("*").alias("k"))
    counts = held.join(links, "class").groupBy("split", "source").agg(F.sum(F.col("k") * F.col("pairs")).alias("pairs"), F.sum("k").alias("repeated"))
    total = rows.filter("split <> 'train'").groupBy("split", "source").agg(F.count("*").alias("rows"))
    return total.alias("t").join(counts.alias("c"), F.expr("t.split <=> c.split and t.source <=> c.source"), "left").select(
        "t.split", "t.source", "rows", F.coalesce("repeated", F.lit(0)).alias("repeated"), F.coalesce("pairs", F.lit(0)).alias("pairs")
    )
