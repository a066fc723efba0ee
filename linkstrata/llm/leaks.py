"""Problem 7: held-out texts inside documents, by spaced-seed hashing and substitution-tolerant verification."""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.llm.common import MARKUP, Filter, coded, filter_of, in_chunks
from linkstrata.plans.staging import join_salted, small, stage

# Which of a window's word positions a seed reads ('1') and which it ignores ('0').
MASKS = ("111111", "11101011", "1101100111", "110010010111")
SHORT_MASKS = ("1", "11", "111")
SHORT = 9
"""Items whose half has fewer words are sought by runs of up to three words."""
SHARE = 0.5
REPLACED = 7
CHARS = 2_000_000
"""Characters of texts that are hashed at once (one text is never parted)."""
SENT_BYTES, SEEDS_SENT = 16_000_000, 500_000
"""Items' words up to so many bytes, and items' seeds up to so many rows, are broadcast; beyond they are joined by shuffle."""

WORD = re.compile(r"[^\W_]+")
HITS = "codes binary, h array<long>, pos array<int>, edge array<boolean>"


def words(text: str | None) -> list[str]:
    """Lower-case words; markup, escapes, punctuation and line breaks aside. Null gives []."""
    if not text:
        return []
    text = MARKUP.sub(" ", html.unescape(text)) if "<" in text or "[" in text or "&" in text or "{" in text or "http" in text else text
    return WORD.findall(text.lower())


def masks_of(n: int) -> tuple[int, ...]:
    """Numbers of the masks by which an item of n words is sought, of MASKS and then SHORT_MASKS.

    A stretch of fewer than seven words has to agree whole, and one of more has three agreeing words in a row, so a run of
    min(half, 3) words finds every short item; the four masks miss no stretch of SHORT words or more.
    """
    half = -(-n // 2)
    return tuple(range(len(MASKS))) if half >= SHORT else (len(MASKS) + min(half, 3) - 1,) if half else ()


def seeds(code: np.ndarray, owner: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window inside one text, hash of its read words by mask ``m``, whether it is not amid windows of equal hash).

    Pairs of windows of which one is at the edge of its run give all alignments of two runs, so two texts that repeat
    one word over and over give as many as they have words, not the product.
    """
    mask = (MASKS + SHORT_MASKS)[m]
    n = len(code) - len(mask) + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.full(n, 0x9E3779B97F4A7C15 + m, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h = (h ^ code[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    at = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
    same = (h[:-1] == h[1:]) & (owner[: n - 1] == owner[len(mask) :]) if n > 1 else np.zeros(0, bool)
    amid = np.zeros(n, bool)
    amid[1:-1] = same[:-1] & same[1:]
    return at, h[at], ~amid[at]


def covered(same: np.ndarray, least: int) -> bool:
    """Whether a stretch of at least ``least`` words has at most one in REPLACED that differs.

    ``same``: for each aligned word whether it agrees. With one point for each word and REPLACED off for
    each that differs, such a stretch is one whose sum is not negative.
    """
    if len(same) < least:
        return False
    gain = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - REPLACED))])
    low = np.minimum.accumulate(gain[: len(gain) - least])
    return bool((gain[least:] >= low).any())


def cover(parts: list[bytes], codes: list[bytes], lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``covered`` for many alignments at once: words of a document, an item's words, where in these they begin, and the item's size."""
    size = np.array([len(p) for p in parts], np.int64) // 4
    out, start = np.zeros(len(parts), bool), np.concatenate([[0], np.cumsum(size)])
    doc, own = np.frombuffer(b"".join(parts), np.uint32), np.frombuffer(b"".join(c[4 * a : 4 * (a + k)] for c, a, k in zip(codes, lo, size)), np.uint32)
    gain = np.where(doc == own, 1, 1 - REPLACED).astype(np.int32)
    for k in np.unique(n):
        least = -(-int(k) // 2)
        every = np.flatnonzero((n == k) & (size >= least))
        for at in np.array_split(every, len(every) // max(1, CHARS // int(k)) + 1):
            if not len(at):
                continue
            wide = np.full((len(at), int(size[at].max()) + 1), -1_000_000, np.int64)
            wide[:, 0] = 0
            row = np.repeat(np.arange(len(at)), size[at])
            place = np.arange(len(row)) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
            wide[row, place + 1] = gain[start[at][row] + place]
            total = np.cumsum(wide, axis=1)
            low = np.minimum.accumulate(total[:, : total.shape[1] - least], axis=1)
            out[at] = (total[:, least:] >= low).any(1)
    return out


def hits(texts: list[str], masks: list[int] | None, known: Filter | None) -> tuple[np.ndarray, dict]:
    """(numbers of the texts with seeds, their words' codes and seeds); ``masks`` None: those of each text's own length; ``known``: seeds to keep."""
    code, owner, n = coded([words(t) for t in texts])
    start = np.concatenate([[0], np.cumsum(n)])
    parts = []
    for m in range(len(MASKS) + len(SHORT_MASKS)) if masks is None else masks:
        at, h, edge = seeds(code, owner, m)
        if masks is None:
            use = np.array([m in masks_of(x) for x in n], bool)[owner[at]] if len(at) else np.zeros(0, bool)
        else:
            use = known.has(h)
        parts.append((owner[at[use]], at[use] - start[owner[at[use]]], h[use], edge[use]))
    own, pos, h, edge = (np.concatenate([p[k] for p in parts]) for k in range(4)) if parts else (np.zeros(0, np.int64),) * 4
    order = np.argsort(own, kind="stable")
    own, pos, h, edge = own[order], pos[order].astype(np.int32), h[order].view(np.int64), edge[order]
    who, first = np.unique(own, return_index=True)
    last = [*first[1:], len(own)]
    brief = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return who, {
        "codes": [brief[start[i] : start[i + 1]].tobytes() for i in who],
        "h": [h[a:b] for a, b in zip(first, last)], "pos": [pos[a:b] for a, b in zip(first, last)], "edge": [edge[a:b] for a, b in zip(first, last)],
    }


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold an item, or half of its words in one stretch, one in seven replaced at most.

    Documents are read and hashed once, whatever the number of items: of the seeds of a document's windows those that pass a
    filter of the items' seeds (``common.filter_of``, 32 MB at most) are joined with the items' by hash, seeds that stand in very many
    documents parted. Around each hit the aligned words decide, on the whole text. However
    the replaced words of a stretch lie, one of the masks reads only words that agree (the tests try all ways for
    stretches of 9 to 34 words); items with a half of fewer than SHORT words are sought by runs of up to three words. Null and
    empty texts hold nothing and empty items are in nothing. Copies of an item text under several ids are all reported.
    """
    empty = documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    asked = stage(items.filter("item_id is not null and text is not null").select("item_id", F.xxhash64("text").alias("item"), "text"), "p7-items")
    texts = asked.groupBy("item").agg(F.min("text").alias("text"))

    def own_seeds(batches):
        for b in batches:
            for part in in_chunks(b.text.str.len().tolist(), CHARS):
                x = b.iloc[part]
                who, found = hits(x.text.tolist(), None, None)
                yield pd.DataFrame({"item": x.item.to_numpy()[who], **found})

    bodies = stage(texts.mapInPandas(own_seeds, f"item long, {HITS}").withColumn("n", (F.length("codes") / 4).cast("int")), "p7-bodies")
    zipped = F.explode(F.arrays_zip("h", "pos", "edge")).alias("s")
    sought = stage(bodies.select("item", "n", zipped).select("item", "n", "s.h", F.col("s.pos").alias("at"), F.col("s.edge").alias("ends")), "p7-sought")
    size = bodies.agg(F.sum("n").alias("w"), F.sum(F.size("h")).alias("h"), F.max(F.col("n") >= 2 * SHORT - 1).alias("long"), F.collect_set(F.when(F.col("n") < 2 * SHORT - 1, F.least(F.ceil(F.col("n") / 2), F.lit(3)))).alias("short")).first()
    if not size.h:
        return empty
    masks = sorted({m for n in ([2 * SHORT] if size.long else []) + [2 * int(x) for x in size.short] for m in masks_of(n)})
    sent = documents.sparkSession.sparkContext.broadcast(filter_of(sought, "h", size.h))

    def look(batches):
        known = sent.value
        for b in batches:
            for part in in_chunks(b.text.str.len().tolist(), CHARS):
                x = b.iloc[part]
                who, found = hits(x.text.tolist(), masks, known)
                yield pd.DataFrame({"doc_id": x.doc_id.to_numpy()[who], "body": x.body.to_numpy()[who], **found})

    rows = documents.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("body"), "text")
    near = stage(rows.mapInPandas(look, f"doc_id long, body long, {HITS}"), "p7-near")
    met = stage(near.select("doc_id", "body", zipped).select("doc_id", "body", "s.h", "s.pos", "s.edge"), "p7-met")
    both = met.join(F.broadcast(sought), "h") if size.h <= SEEDS_SENT else join_salted(met, sought, ["h"])
    lines = both.filter("edge or ends").select("doc_id", "body", "item", "n", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    lines = stage(lines, "p7-lines")
    of_doc = near.select("doc_id", "body", "codes", (F.length("codes") / 4).cast("int").alias("words"))
    lo = F.greatest(F.lit(0), -F.col("shift"))
    hi = F.least(F.col("n"), F.col("words") - F.col("shift"))
    cut = join_salted(lines, of_doc, ["doc_id", "body"]).select(
        "doc_id", "item", "n", lo.alias("lo"), F.col("codes").substr((F.col("shift") + lo) * 4 + 1, (hi - lo) * 4).alias("part")
    )
    of_item = bodies.select("item", "codes")
    cut = cut.join(F.broadcast(of_item), "item") if 4 * size.w <= SENT_BYTES else join_salted(stage(cut, "p7-cut"), of_item, ["item"])

    @F.pandas_udf("boolean")
    def holds(part: pd.Series, codes: pd.Series, lo: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(cover(part.tolist(), codes.tolist(), lo.to_numpy(), n.to_numpy()))

    found = stage(cut.filter(holds("part", "codes", "lo", "n")).select("doc_id", "item").distinct(), "p7-found")
    return join_salted(found, small(asked.select("item", "item_id").distinct()), ["item"]).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(suite, items, leaked, documents): a suite's items, those that leaked, and the documents that carry one."""
    found = leaks(documents, items).join(items.select("item_id", "suite"), "item_id")
    got = found.groupBy("suite").agg(F.countDistinct("item_id").alias("leaked"), F.countDistinct("doc_id").alias("documents"))
    total = items.groupBy("suite").agg(F.count("*").alias("items"))
    got = total.alias("t").join(got.alias("g"), F.expr("t.suite <=> g.suite"), "left")
    return got.select("t.suite", "items", F.coalesce("leaked", F.lit(0)).alias("leaked"), F.coalesce("documents", F.lit(0)).alias("documents"))
