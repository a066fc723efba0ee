"""Vectors as array<float> columns: expressions inside the JVM, and searches in blocks (F20-F23, E3, E4, E7, J14, TK1-TK3, W5).

Arithmetic is in double. Expressions on null vectors give null; a zero vector normalises to itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
"""Queries a block: what a search sends to every task is at most this many vectors."""
AT_ONCE = 512
"""Queries of a block that are multiplied with a batch at once, which bounds a task's matrix of scores."""


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, f) -> Column:
    """f(value) with the value computed once a row, also where f uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """v / max(|v|, 1e-12)."""
    return let(doubles(v), lambda u: let(F.greatest(norm(u), F.lit(1e-12)), lambda n: F.transform(u, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def late_fusion(text: Column, image: Column, joint: Column, missing: Column) -> Column:
    """Mean of three component scores; the text score alone where an image is missing."""
    return F.when(missing, text).otherwise((text + image + joint) / 3)


def softmax_entropy(scores: Column) -> Column:
    """Entropy of the softmax of an array, over ln of its length; null for fewer than two scores."""

    def entropy(z: Column) -> Column:
        total = F.aggregate(z, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: F.aggregate(z, F.lit(0.0), lambda a, x: a - (x / t) * F.ln(F.greatest(x / t, F.lit(1e-12)))))

    h = let(let(F.array_max(scores), lambda m: F.transform(scores, lambda s: F.exp(s - m))), entropy)
    return F.when(F.size(scores) > 1, h / F.ln(F.size(scores).cast("double")))


def softmax_top(scores: Column) -> Column:
    """Softmax probability of the highest score."""
    return let(F.array_max(scores), lambda m: 1 / F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - m)))


def tokens(v: Column, n: int, width: int) -> Column:
    """A vector as n tokens of a width."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(doubles(v), i * width + 1, width))


def pool(ts: Column, width: int, how: str) -> Column:
    """One vector of many tokens: mean, max, min, cls (the first), or mlp (weighted by the softmax of each token's mean)."""
    at = F.sequence(F.lit(0), F.lit(width - 1))
    if how == "cls":
        return F.element_at(ts, 1)
    if how in ("max", "min"):
        pick = F.array_max if how == "max" else F.array_min
        return F.transform(at, lambda i: pick(F.transform(ts, lambda t: F.get(t, i))))
    if how == "mean":
        return F.transform(at, lambda i: F.aggregate(ts, F.lit(0.0), lambda s, t: s + F.get(t, i)) / F.size(ts))
    if how == "mlp":
        z = F.transform(ts, lambda t: F.exp(F.aggregate(t, F.lit(0.0), lambda s, x: s + x) / width))
        weights = let(z, lambda y: let(F.aggregate(y, F.lit(0.0), lambda s, x: s + x), lambda t: F.transform(y, lambda x: x / t)))
        return let(weights, lambda w: F.transform(at, lambda i: F.aggregate(F.zip_with(ts, w, lambda t, x: F.get(t, i) * x), F.lit(0.0), lambda s, x: s + x)))
    raise ValueError(f"no pooling named {how}")


def blocks(queries: DataFrame, columns: list[str]):
    """The stated query set in blocks of at most BLOCK rows, each as a pandas frame."""
    rows = queries.select(*columns).toLocalIterator(prefetchPartitions=False)
    block = []
    for r in rows:
        block.append(tuple(r))
        if len(block) == BLOCK:
            yield pd.DataFrame(block, columns=columns)
            block = []
    if block:
        yield pd.DataFrame(block, columns=columns)


def union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_topk(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(qid, eid, score, rank): the k base vectors with the highest inner product of each query, itself left out.

    ``queries``: qid, v; ``base``: eid, v. The stated query set is sent in blocks; each task multiplies it with its batches and
    passes on k rows a query and batch, so nothing of the size queries x base is ever stored. Scores are rounded
    to 9 decimals; ties go to the smaller eid. Null vectors take no part.
    """
    parts = []
    for b in blocks(queries.filter("v is not null"), ["qid", "v"]):
        ids, q = b.qid.to_numpy(), np.stack(b.v.map(np.asarray)).astype(np.float64)

        def best(batches, ids=ids, q=q):
            for x in batches:
                if not len(x):
                    continue
                eid = x.eid.to_numpy()
                order = np.argsort(eid, kind="stable")
                eid, v = eid[order], np.stack(x.v.to_numpy()).astype(np.float64)[order]
                for at in range(0, len(ids), AT_ONCE):
                    own = ids[at : at + AT_ONCE]
                    s = np.round(q[at : at + AT_ONCE] @ v.T, 9)
                    s[own[:, None] == eid[None, :]] = -np.inf
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    score = np.take_along_axis(s, top, 1)
                    r, c = np.nonzero(np.isfinite(score))
                    yield pd.DataFrame({"qid": own[r], "eid": eid[top[r, c]], "score": score[r, c]})

        parts.append(base.filter("v is not null").select("eid", "v").mapInPandas(best, "qid long, eid long, score double"))
    found = union(parts, base.sparkSession.createDataFrame([], "qid long, eid long, score double"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "eid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def log_sums(queries: DataFrame, base: DataFrame, scale: float) -> DataFrame:
    """(qid, logsum): ln of the sum of exp(scale x score) over all other base rows. Each batch gives a query one partial sum; no score leaves its task.

    ``queries``: qid, v, a stated set in blocks; ``base``: eid, v. Scores are rounded to 9 decimals; null vectors take no part.
    """
    parts = []
    for b in blocks(queries.filter("v is not null").select("qid", "v"), ["qid", "v"]):
        ids, q = b.qid.to_numpy(), np.stack(b.v.map(np.asarray)).astype(np.float64)

        def sums(batches, ids=ids, q=q):
            for x in batches:
                if len(x):
                    z = scale * np.round(q @ np.stack(x.v.to_numpy()).astype(np.float64).T, 9)
                    z[ids[:, None] == x.eid.to_numpy()[None, :]] = -np.inf
                    top = z.max(1)
                    on = np.isfinite(top)
                    yield pd.DataFrame({"qid": ids[on], "top": top[on], "total": np.exp(z[on] - top[on, None]).sum(1)})

        parts.append(base.filter("v is not null").select("eid", "v").mapInPandas(sums, "qid long, top double, total double"))
    found = union(parts, base.sparkSession.createDataFrame([], "qid long, top double, total double"))
    most = found.groupBy("qid").agg(F.max("top").alias("most"))
    return found.join(most, "qid").groupBy("qid").agg((F.max("most") + F.ln(F.sum(F.col("total") * F.exp(F.col("top") - F.col("most"))))).alias("logsum"))


def paired_moments(queries: DataFrame, base: DataFrame) -> DataFrame:
    """One row (n, x, y, xx, yy, xy, gap): sums over all pairs of a query and another row of their scores by v (x) and by w (y), and of |x - y|.

    ``queries``: qid, v, w, a stated set in blocks; ``base``: eid, v, w. A batch gives one row. Scores are rounded to 9 decimals.
    """
    kind = "n long, x double, y double, xx double, yy double, xy double, gap double"
    whole = "v is not null and w is not null"
    parts = []
    for b in blocks(queries.filter(whole).select("qid", "v", "w"), ["qid", "v", "w"]):
        ids, (q, r) = b.qid.to_numpy(), (np.stack(b[c].map(np.asarray)).astype(np.float64) for c in "vw")

        def sums(batches, ids=ids, q=q, r=r):
            for t in batches:
                if len(t):
                    x, y = (np.round(a @ np.stack(t[c].to_numpy()).astype(np.float64).T, 9) for a, c in ((q, "v"), (r, "w")))
                    on = ids[:, None] != t.eid.to_numpy()[None, :]
                    x, y = x[on], y[on]
                    yield pd.DataFrame([(len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y, np.abs(x - y).sum())], columns=[f.split()[0] for f in kind.split(", ")])

        parts.append(base.filter(whole).select("eid", "v", "w").mapInPandas(sums, kind))
    return union(parts, base.sparkSession.createDataFrame([], kind)).agg(*(F.sum(f.split()[0]).alias(f.split()[0]) for f in kind.split(", ")))


def best_fused(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(qid, eid, score): the base row of the highest late fusion of each query: the mean of text, image and their product, or text alone where the row has no image.

    ``queries``: qid, a, b, a stated set in blocks; ``base``: eid, a, b, missing. Scores are rounded to 9 decimals, ties go to the smaller eid.
    """
    parts = []
    for block in blocks(queries.filter("a is not null and b is not null").select("qid", "a", "b"), ["qid", "a", "b"]):
        ids, (qa, qb) = block.qid.to_numpy(), (np.stack(block[c].map(np.asarray)).astype(np.float64) for c in "ab")

        def best(batches, ids=ids, qa=qa, qb=qb):
            for t in batches:
                if not len(t):
                    continue
                t = t.sort_values("eid", kind="stable")
                x, y = (np.round(q @ np.stack(t[c].to_numpy()).astype(np.float64).T, 9) for q, c in ((qa, "a"), (qb, "b")))
                s = np.round(np.where(t.missing.to_numpy(bool)[None, :], x, (x + y + x * y) / 3), 9)
                s[ids[:, None] == t.eid.to_numpy()[None, :]] = -np.inf
                at = s.argmax(1)
                on = np.isfinite(s[np.arange(len(ids)), at])
                yield pd.DataFrame({"qid": ids[on], "eid": t.eid.to_numpy()[at[on]], "score": s[on, at[on]]})

        parts.append(base.filter("a is not null and b is not null").select("eid", "a", "b", "missing").mapInPandas(best, "qid long, eid long, score double"))
    found = union(parts, base.sparkSession.createDataFrame([], "qid long, eid long, score double"))
    top = found.groupBy("qid").agg(F.max(F.struct("score", -F.col("eid"))).alias("x"))
    return top.select("qid", (-F.col("x.col2")).alias("eid"), F.col("x.score").alias("score"))


def gold_ranks(queries: DataFrame, base: DataFrame, views: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """(qid, gold, gold_score, rank, ordinal) without sorting or storing scores: ranks by counting.

    ``queries``: qid, v, gold, gold_v; ``base``: eid, v. rank is 1 + the number of base rows with a strictly greater score;
    ordinal counts equal scores of smaller eids too. Rows without gold are left out; the query itself is no candidate.
    ``views``: functions of a matrix by name; ranks are counted for all vectors as each of them shows them, in one pass over the base, and rows have ``mode``, the name.
    """
    kinds = views or {"": lambda x: x}
    kind = "mode string, qid long, gold long, gold_score double, above long, level long"
    parts = []
    for b in blocks(queries.filter("v is not null and gold_v is not null"), ["qid", "v", "gold", "gold_v"]):
        ids, gold = b.qid.to_numpy(), b.gold.to_numpy()
        q, g = (np.stack(b[c].map(np.asarray)).astype(np.float64) for c in ("v", "gold_v"))

        def count(batches, ids=ids, gold=gold, q=q, g=g):
            own = {name: (f(q), np.round(np.einsum("ij,ij->i", f(q), f(g)), 9)) for name, f in kinds.items()}
            above, level = ({name: np.zeros(len(ids), np.int64) for name in kinds} for _ in range(2))
            for x in batches:
                if not len(x):
                    continue
                eid, v = x.eid.to_numpy(), np.stack(x.v.to_numpy()).astype(np.float64)
                seen = {name: f(v).T for name, f in kinds.items()}
                for at in range(0, len(ids), AT_ONCE):
                    part = slice(at, at + AT_ONCE)
                    other = ids[part, None] != eid[None, :]
                    ahead = other & (eid[None, :] < gold[part, None])
                    for name, (mine, aim) in own.items():
                        s = np.round(mine[part] @ seen[name], 9)
                        above[name][part] += ((s > aim[part, None]) & other).sum(1)
                        level[name][part] += ((s == aim[part, None]) & ahead).sum(1)
            for name, (_, aim) in own.items():
                yield pd.DataFrame({"mode": name, "qid": ids, "gold": gold, "gold_score": aim, "above": above[name], "level": level[name]})

        parts.append(base.filter("v is not null").select("eid", "v").mapInPandas(count, kind))
    found = union(parts, base.sparkSession.createDataFrame([], kind))
    keys = ["mode", "qid", "gold", "gold_score"] if views else ["qid", "gold", "gold_score"]
    by = found.groupBy(*keys).agg(F.sum("above").alias("above"), F.sum("level").alias("level"))
    return by.select(*keys, (F.col("above") + 1).alias("rank"), (F.col("above") + F.col("level") + 1).alias("ordinal"))


def encode(rows: DataFrame, encoder, columns: list[str], schema: str) -> DataFrame:
    """Hook for encoders (E1, E2, O6): ``encoder(batches of pandas frames) -> frames`` is loaded once a task, rows it can't read are dropped by it."""
    return rows.select(*columns).mapInPandas(encoder, schema)


MASKS = ("fused", "text", "vision", "flip")


def masked(text: Column, image: Column, mode: str, width: int | None = None) -> tuple[Column, Column]:
    """(text, image) as an encoder sees them: both, one with zeros for the other, or the image's rows of ``width`` numbers reversed."""
    zeros = lambda c: F.transform(doubles(c), lambda x: F.lit(0.0))
    if mode not in MASKS:
        raise ValueError(f"no mode named {mode}")
    if mode == "text":
        return doubles(text), zeros(image)
    if mode == "vision":
        return zeros(text), doubles(image)
    if mode == "flip":
        w = width or 1
        at = F.sequence(F.lit(0), (F.size(image) / w).cast("int") - 1)
        return doubles(text), F.when(F.size(image) > 0, F.flatten(F.transform(at, lambda i: F.reverse(F.slice(doubles(image), i * w + 1, w))))).otherwise(doubles(image))
    return doubles(text), doubles(image)


def padded(ids: Column, length: int, pad: int = 0) -> tuple[Column, Column]:
    """(ids, mask) of one length: longer lists are cut, shorter ones filled with ``pad``; the mask is 1 where an id stands. Null is an empty list."""
    own = F.slice(F.coalesce(ids, F.array().cast("array<int>")), 1, length)
    n = F.size(own)
    return F.concat(own, F.array_repeat(F.lit(pad), F.lit(length) - n)), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def batch_loss(rows: DataFrame, batch: str, scale: float, hard: str | None = None) -> DataFrame:
    """(id, loss): contrastive cross-entropy of each row against its batch's entities, itself the right one, and all of its batch's hard negatives.

    ``rows``: id, ``batch``, m (mention vector), e (entity vector), and with ``hard`` a list of vectors. The logit is the inner product
    times ``scale``, 100 at most. Batches are of the size that a training step takes, so each is one group.
    """

    def loss(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        m, e = (np.stack(g[c].to_numpy()).astype(np.float64) for c in ("m", "e"))
        more = [np.asarray(v, float) for vs in g[hard] if vs is not None for v in vs] if hard else []
        z = min(scale, 100.0) * (m @ np.concatenate([e, np.stack(more)] if more else [e]).T)
        top = z.max(1)
        return pd.DataFrame({"id": g.id, "loss": top + np.log(np.exp(z - top[:, None]).sum(1)) - z[np.arange(len(g)), np.arange(len(g))]})

    return rows.groupBy(batch).applyInPandas(loss, f"id {dict(rows.dtypes)['id']}, loss double")
