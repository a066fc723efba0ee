"""Problem 8: mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkstrata.plans.staging import small, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are split before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANKS = regex.compile(r"\p{White_Space}{1000,}")
BLOCK = 256
SHARD_TOKENS = 4_000_000
GROUP = 1000
"""Shards whose quotas are found together; the driver sees one row for each group, which holds GROUP x SHARD_TOKENS tokens."""
SEED = 42


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a text. Very long runs of blanks, too deep for the pattern, are one piece each, as the pattern has it, but for a last blank before a word."""
    t, at, n = _tokenizer(path), 0, 0
    if len(text) >= 1000:
        for run in BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            n += len(t.encode_ordinary(text[at : run.start()])) + len(t._encode_single_piece(text[run.start() : end]))
            at = end
    return n + len(t.encode_ordinary(text[at:]))


def token_counts(documents: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``documents`` with ``tokens``: the number of tokens of the whole text in a public tokenizer; null and '' have 0."""

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        return pd.Series([n_tokens(x, path) if x else 0 for x in s], dtype="int32")

    return documents.withColumn("tokens", F.coalesce(count(F.col(text)), F.lit(0)))


def source_key(c):
    """One spelling of a source: lower case, blanks and dashes as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 n + 1), none beyond its cap; ties go to the earlier one.

    Seats that no quotient may exceed are given at once: n seats of weight w have quotients of at least
    x = w / (2 n - 1), so a search for x leaves a few seats to hand out one by one. Fewer seats than asked are
    given only when all caps are reached.
    """
    live = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    got = [0] * len(weights)
    if not live or seats <= 0:
        return got
    seats = min(seats, sum(caps[i] for i in live))
    taken = lambda x: [min(caps[i], int((weights[i] / x + 1) / 2)) if i in alive else 0 for i in range(len(weights))]
    alive = set(live)
    lo, hi = 0.0, 4 * max(weights)
    for _ in range(200):  # at hi no more than `seats` are taken
        mid = (lo + hi) / 2
        if mid <= 0 or sum(taken(mid)) > seats:
            lo = mid
        else:
            hi = mid
    got = taken(hi)
    heap = [(-weights[i] / (2 * got[i] + 1), i) for i in live if got[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, times): the documents of the mixture and how often each is used.

    ``targets``: source, target_share, max_repeat. Of sources without documents the share goes to the others in
    proportion; sources without a target are left out. ``total_tokens`` is by default the most for which
    all shares can be met within max_repeat. Blocks of equal tokens go to sources, then to each source's groups of shards and
    to each group's shards by highest quotients; in a shard the documents' order is seeded, and a document is in the block in which its
    middle falls, so sizes are met to half a document a shard. A quota above a shard's tokens takes whole
    passes first. Null and empty texts have no tokens and aren't used. The same seed gives the same mixture.
    """
    sized = token_counts(documents.filter("doc_id is not null and source is not null").select("doc_id", source_key(F.col("source")).alias("source"), "text"), path=tokenizer)
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeat")
    wanted = {r.source: r for r in wanted.filter("target_share > 0 and max_repeat > 0").collect()}
    sized = stage(sized.filter((F.col("tokens") > 0) & F.col("source").isin(*wanted)).select("doc_id", "source", "tokens"), "p8-sized")
    have = {r.source: r for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    names = sorted(set(have) & set(wanted))
    empty = documents.sparkSession.createDataFrame([], "doc_id bigint, source string, tokens int, times int")
    if not names:
        return empty
    shares = [wanted[s].target_share for s in names]
    shares = [x / sum(shares) for x in shares]
    most = [have[s].tokens * int(wanted[s].max_repeat) for s in names]
    total = total_tokens or min(m / x for m, x in zip(most, shares))
    quotas = dict(zip(names, sainte_lague(shares, round(total / block), [-(-m // block) for m in most])))
    count = {s: max(1, -(-have[s].tokens // SHARD_TOKENS)) for s in names}
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    of = lambda values: F.create_map(*(x for s in names for x in (F.lit(s), F.lit(values[s]))))[F.col("source")]
    placed = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(-seed)), of(count)).cast("int"))
    cap = of({s: int(wanted[s].max_repeat) for s in names})
    filled = placed.groupBy("source", "shard").agg(F.sum("tokens").alias("full"))
    filled = stage(filled.withColumn("group", F.floor(F.col("shard") / GROUP)).withColumn("cap", F.ceil(F.col("full") * cap / block)), "p8-filled")
    groups = filled.groupBy("source", "group").agg(F.sum("full").alias("full"), F.sum("cap").alias("cap")).collect()
    rows = []
    for s in names:
        own = sorted((r.group, r.full, r.cap) for r in groups if r.source == s)
        rows += [(s, g, q) for (g, _, _), q in zip(own, sainte_lague([float(f) for _, f, _ in own], quotas[s], [c for _, _, c in own]))]
    by_group = documents.sparkSession.createDataFrame(rows, "source string, group long, blocks long")

    def share_out(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("shard")
        got = sainte_lague(g.full.astype(float).tolist(), int(g.blocks.iloc[0]), g.cap.tolist())
        return pd.DataFrame({"source": g.source, "shard": g.shard, "full": g.full, "quota": [q * block for q in got]})

    plan = filled.join(small(by_group), ["source", "group"]).groupBy("source", "group").applyInPandas(share_out, "source string, shard int, full long, quota long")
    plan = stage(plan, "p8-plan")
    w = Window.partitionBy("source", "shard").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.sum("tokens").over(w) - F.col("tokens") / 2
    used = placed.withColumn("middle", middle).join(small(plan), ["source", "shard"])
    passes = F.floor(F.col("quota") / F.col("full"))
    times = passes + (F.col("middle") < F.col("quota") - passes * F.col("full")).cast("int")
    return used.select("doc_id", "source", "tokens", F.least(times, cap).cast("int").alias("times")).filter("times > 0")


def mix_report(documents: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_times) for each target; 0 where a source has nothing."""
    used = stage(mixture(documents, targets, **how), "p8-used")
    by = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.count("*").alias("documents"), F.max("times").alias("most_times"))
    total = used.agg(F.sum(F.col("tokens") * F.col("times"))).first()[0] or 1
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return targets.select(source_key(F.col("source")).alias("source"), "target_share").join(by, "source", "left").select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.lit(total)).alias("reached_share"), zero("tokens"), zero("documents"), zero("most_times")
    )
