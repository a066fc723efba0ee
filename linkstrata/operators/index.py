"""Quantised indexes: SQ8, PQ and OPQ (X1, X2). Trained on bounded samples; every row is indexed."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkstrata.operators.vectors import blocks, dot, doubles, exact_topk, union
from linkstrata.plans.staging import stage

TRAIN = 20_000
PROBES = 128
QUERIES = 256
"""Queries scored against a batch of codes at once."""


def sq8_ranges(base: DataFrame) -> DataFrame:
    """One row (lo, hi): arrays of each dimension's smallest and largest value, over all vectors."""
    each = base.select(F.posexplode(doubles(F.col("v"))).alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    s = each.agg(F.array_sort(F.collect_list(F.struct("d", "lo", "hi"))).alias("a"))
    return s.select(F.col("a.lo").alias("lo"), F.col("a.hi").alias("hi"))


def sq8(base: DataFrame, ranges: DataFrame) -> DataFrame:
    """``base`` with v replaced by its 8-bit code a dimension, decoded. ``ranges`` is one row."""
    i = F.zip_with(F.zip_with("lo", "hi", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), doubles(F.col("v")), lambda r, x: F.struct(r["a"].alias("a"), r["b"].alias("b"), x.alias("x")))
    step = lambda r: (r["b"] - r["a"]) / 255.0
    v = F.transform(i, lambda r: F.when(r["b"] > r["a"], r["a"] + F.least(F.greatest(F.rint((r["x"] - r["a"]) / step(r)), F.lit(0.0)), F.lit(255.0)) * step(r)).otherwise(r["x"]))
    return base.join(F.broadcast(ranges)).withColumn("v", v).drop("lo", "hi")


class PQ:
    """Product quantiser: each of m parts of a vector is one of 2^bits centres. ``rotate``: OPQ's rotation, learned by turns."""

    def __init__(self, x: np.ndarray, m: int, bits: int, rotate: bool = False, rounds: int = 8):
        d = x.shape[1]
        if d % m:
            raise ValueError("parts must divide the dimension")
        self.m, self.r = m, np.eye(d)
        for _ in range(rounds if rotate else 1):
            y = x @ self.r
            self.centres = [self._lloyd(p, min(2**bits, len(x)), 4 if rotate else 12) for p in np.split(y, m, 1)]
            if rotate:
                u, _, vt = np.linalg.svd(x.T @ self._decode(self._encode(y)))
                self.r = u @ vt

    @staticmethod
    def _lloyd(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
        c = x[np.random.default_rng(3).permutation(len(x))[:k]].copy()
        for _ in range(rounds):
            home = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
            for j in np.unique(home):
                c[j] = x[home == j].mean(0)
        return c

    def _encode(self, y: np.ndarray) -> np.ndarray:
        return np.stack([(-2 * p @ c.T + (c * c).sum(1)).argmin(1) for p, c in zip(np.split(y, self.m, 1), self.centres)], 1)

    def _decode(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([c[q[:, j]] for j, c in enumerate(self.centres)], 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return self._encode(x @ self.r)

    def decoded(self, q: np.ndarray) -> np.ndarray:
        return self._decode(q) @ self.r.T

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(query, part, centre) inner products: a row's score is the sum of one entry a part, so its vector is never rebuilt."""
        return np.stack([p @ c.T for p, c in zip(np.split(q @ self.r, self.m, 1), self.centres)], 1)

    def size(self) -> int:
        """Bytes of centres and rotation as float32; a row's codes are m bytes."""
        return 4 * (sum(c.size for c in self.centres) + (self.r.size if not np.array_equal(self.r, np.eye(len(self.r))) else 0))

    def rows(self, spark: SparkSession) -> DataFrame:
        """(kind, part, at, v): the index's parameters as a table, to be stored beside the codes."""
        out = [("rotation", 0, i, [float(x) for x in v]) for i, v in enumerate(self.r)]
        out += [("centre", j, i, [float(x) for x in v]) for j, c in enumerate(self.centres) for i, v in enumerate(c)]
        return spark.createDataFrame(out, "kind string, part int, at int, v array<double>")

    @classmethod
    def of(cls, rows: DataFrame) -> PQ:
        """The index that ``rows`` describes."""
        pq, got = cls.__new__(cls), sorted(rows.collect(), key=lambda r: (r.kind, r.part, r["at"]))
        pq.r = np.array([r.v for r in got if r.kind == "rotation"])
        pq.m = 1 + max(r.part for r in got)
        pq.centres = [np.array([r.v for r in got if r.kind == "centre" and r.part == j]) for j in range(pq.m)]
        return pq


def coded(base: DataFrame, pq: PQ) -> DataFrame:
    """(eid, code): every row's codes, a byte a part. Null vectors have none."""

    def one(batches):
        for b in batches:
            if len(b):
                q = pq.codes(np.stack(b.v.map(np.asarray)).astype(float)).astype(np.uint8)
                yield pd.DataFrame({"eid": b.eid, "code": [r.tobytes() for r in q]})

    return base.filter("v is not null").select("eid", doubles(F.col("v")).alias("v")).mapInPandas(one, "eid long, code binary")


def _scores(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(query, row) sums of table entries."""
    out = np.zeros((len(tables), len(codes)))
    for j in range(tables.shape[1]):
        out += tables[:, j][:, codes[:, j]]
    return np.round(out, 9)


def _codes_of(b: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)


def coded_topk(queries: DataFrame, codes: DataFrame, pq: PQ, k: int) -> DataFrame:
    """(qid, eid): the k rows of the highest score by codes, the query itself left out; ties go to the smaller eid. Queries go in blocks."""
    parts = []
    for b in blocks(queries.filter("v is not null"), ["qid", "v"]):
        ids, t = b.qid.to_numpy(), pq.tables(np.stack(b.v.map(np.asarray)).astype(np.float64))

        def best(batches, ids=ids, t=t):
            for x in batches:
                if not len(x):
                    continue
                x = x.sort_values("eid", kind="stable")
                eid, own = x.eid.to_numpy(), _codes_of(x.code)
                for at in range(0, len(ids), QUERIES):
                    s = _scores(t[at : at + QUERIES], own)
                    s[ids[at : at + QUERIES, None] == eid[None, :]] = -np.inf
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    score = np.take_along_axis(s, top, 1)
                    r, c = np.nonzero(np.isfinite(score))
                    yield pd.DataFrame({"qid": ids[at + r], "eid": eid[top[r, c]], "score": score[r, c]})

        parts.append(codes.mapInPandas(best, "qid long, eid long, score double"))
    found = union(parts, codes.sparkSession.createDataFrame([], "qid long, eid long, score double"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "eid")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("qid", "eid")


def _candidates(sample: pd.DataFrame, base: DataFrame, codes: DataFrame, pq: PQ, k: int, recall: float) -> int:
    """How many rows by coded score hold this share of the true k neighbours of the sample's first PROBES rows."""
    spark, probes = base.sparkSession, sample.head(PROBES)
    q = np.stack(probes.v.map(np.asarray)).astype(float)
    asked = spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(probes.eid, q)], "qid long, v array<double>")
    true = exact_topk(asked, base, k).select("qid", F.col("eid").alias("gold")).join(codes.withColumnRenamed("eid", "gold"), "gold").toPandas()  # PROBES x k rows
    if not len(true):
        return k
    t = pq.tables(q)[pd.Index(probes.eid).get_indexer(true.qid)]
    aim = np.array([_scores(t[i : i + 1], _codes_of(true.code.iloc[i : i + 1]))[0, 0] for i in range(len(true))])
    ids, gold = true.qid.to_numpy(), true.gold.to_numpy()

    def count(batches):
        above = np.zeros(len(ids), np.int64)
        for x in batches:
            if len(x):
                eid, own = x.eid.to_numpy(), _codes_of(x.code)
                for at in range(0, len(ids), QUERIES):
                    s, a = _scores(t[at : at + QUERIES], own), aim[at : at + QUERIES, None]
                    ahead = (s > a) | (s == a) & (eid[None, :] < gold[at : at + QUERIES, None])
                    above[at : at + QUERIES] += (ahead & (eid[None, :] != ids[at : at + QUERIES, None])).sum(1)
        yield pd.DataFrame({"i": np.arange(len(ids)), "above": above})

    rank = codes.mapInPandas(count, "i long, above long").groupBy("i").agg((F.sum("above") + 1).alias("rank"))
    return max(k, math.ceil(rank.agg(F.percentile("rank", F.lit(recall))).first()[0] or 0))


class PQIndex:
    """Trained on at most TRAIN rows; every row's codes are stored as a table in the shared folder, and with how many of them to score again."""

    def __init__(self, base: DataFrame, k: int, m: int, bits: int, rotate: bool = False, recall: float = 0.95):
        self.base, self.k = base.filter("v is not null").select("eid", doubles(F.col("v")).alias("v")), k
        sample = self.base.orderBy(F.xxhash64("eid"), "eid").limit(TRAIN).toPandas()
        self.pq = PQ(np.stack(sample.v.map(np.asarray)).astype(float), m, bits, rotate) if len(sample) else None
        if self.pq:
            self.codes = stage(coded(self.base, self.pq), "pq-codes")
            self.candidates = _candidates(sample, self.base, self.codes, self.pq, k, recall)

    def search(self, queries: DataFrame) -> DataFrame:
        """(qid, eid, score, rank): the best k by exact inner product of the rows that the codes put first."""
        if not self.pq:
            return self.base.sparkSession.createDataFrame([], "qid long, eid long, score double, rank int")
        near = coded_topk(queries, self.codes, self.pq, self.candidates)
        both = near.join(self.base, "eid").join(queries.select("qid", F.col("v").alias("q")), "qid")
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "eid")
        scored = both.select("qid", "eid", F.round(dot(F.col("q"), F.col("v")), 9).alias("score"))
        return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= self.k)


def pq_search(queries: DataFrame, base: DataFrame, k: int, m: int, bits: int, rotate: bool = False, recall: float = 0.95) -> DataFrame:
    """(qid, eid, score, rank): the best k by exact inner product of the rows that the codes of every base row put first.

    Trained on at most TRAIN rows; rows are scored by lookup tables over their codes, never by rebuilt vectors. So many rows are scored again as hold ``recall`` of the true k neighbours of PROBES
    rows of the base, ranked among all its codes; so the number grows with the base and shrinks with finer codes. Queries
    unlike the base may find less. Scores are rounded to 9 decimals; ties go to the smaller eid. Null vectors take no part; without any there is no row.
    """
    return PQIndex(base, k, m, bits, rotate, recall).search(queries)


def benchmark(queries: DataFrame, base: DataFrame, k: int, configs: dict[str, tuple[int, int, bool]]) -> DataFrame:
    """(index, bytes, recall, candidates, build_s, search_s, qps, saving, compression, speed_up): each PQ of ``configs`` (parts, bits, rotate) beside exact search ('flat').

    Bytes are those of codes and centres against float32 vectors. Times are of this run.
    """
    spark, rows = base.sparkSession, []
    n, d = base.filter("v is not null").agg(F.count("*"), F.max(F.size("v"))).first()
    asked = queries.count()

    def timed(f):
        began = time.perf_counter()
        out = stage(f(), "benchmark")
        return out, time.perf_counter() - began

    true, flat_s = timed(lambda: exact_topk(queries, base, k).select("qid", "eid"))
    wanted = max(1, true.count())
    flat = 4 * (d or 0) * n
    rows.append(("flat", flat, 1.0, k, 0.0, flat_s))
    for name, (m, bits, rotate) in configs.items():
        began = time.perf_counter()
        index = PQIndex(base, k, m, bits, rotate)
        build = time.perf_counter() - began
        found, search = timed(lambda index=index: index.search(queries).select("qid", "eid"))
        rows.append((name, m * n + (index.pq.size() if index.pq else 0), found.join(true, ["qid", "eid"], "left_semi").count() / wanted, index.candidates if index.pq else 0, build, search))
    out = [(*r, asked / max(r[5], 1e-9), flat - r[1], flat / max(r[1], 1), flat_s / max(r[5], 1e-9)) for r in rows]
    return spark.createDataFrame(out, "index string, bytes long, recall double, candidates int, build_s double, search_s double, qps double, saving long, compression double, speed_up double")
