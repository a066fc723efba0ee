"""Retrieval, ranking and metric queries: every row whose id is divisible by 100 asks all other rows of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstrata.operators import metrics, ranking, vectors
from linkstrata.queries.registry import query, table

CTE = """with e as (select vec_id, embedding::double[] v, label from embeddings),
q as (select vec_id qid, v, label from e where vec_id % 100 = 0),
s as (select q.qid, k.vec_id eid, q.label qlabel, k.label klabel, round(list_inner_product(q.v, k.v), 9) score from q join e k on k.vec_id <> q.qid),
g as (select q.qid, min(k.vec_id) gold from q join e k on k.label = q.label and k.vec_id <> q.qid group by q.qid),
gs as (select s.qid, g.gold, s.score gold_score from s join g on s.qid = g.qid and s.eid = g.gold),
r as (select s.qid, gs.gold, gs.gold_score, 1 + count(*) filter (where s.score > gs.gold_score) as rank,
  1 + count(*) filter (where s.score > gs.gold_score or s.score = gs.gold_score and s.eid < gs.gold) as ordinal from s join gs on s.qid = gs.qid group by all),
t as (select *, row_number() over (partition by qid order by score desc, eid) rank from s),
top as (select qid, list(eid order by rank) as top, list(score order by rank) as scores from t where rank <= 20 group by qid)
"""


def asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(queries with gold, base): gold is the smallest other id of the same label."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"), "label")
    k = e.select(F.col("vec_id").alias("eid"), F.col("embedding").alias("v"), "label")
    w = k.groupBy("label").agg(F.min("eid").alias("first"))
    second = k.join(w, "label").filter("eid > first").groupBy("label").agg(F.min("eid").alias("second"))
    gold = q.join(w, "label").join(second, "label", "left")
    gold = gold.withColumn("gold", F.when(F.col("first") != F.col("qid"), F.col("first")).otherwise(F.col("second")))
    gold = gold.join(k.select(F.col("eid").alias("gold"), F.col("v").alias("gold_v")), "gold")
    return gold.select("qid", "v", "label", "gold", "gold_v"), k


def ranks(spark: SparkSession, d: str) -> DataFrame:
    return vectors.gold_ranks(*asked(spark, d))


def tops(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    q, base = asked(spark, d)
    return ranking.lists(vectors.exact_topk(q, base, k)).join(q.select("qid", "gold", "label"), "qid", "left")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _m(ks, name="recall"):
    return ", ".join(f"round(avg((rank <= {k})::int), 6) {name}_{k}" for k in ks)


@query(CTE + f"select {_m([1, 5, 10, 20, 50, 100])}, round(avg(1.0 / rank), 6) mrr, median(rank)::double median_rank, round(avg(rank), 6) mean_rank, count(*) queries from r")
def retrieval_metrics_fp32(spark, d):
    return rounded(metrics.retrieval_metrics(ranks(spark, d), [1, 5, 10, 20, 50, 100]))


@query(CTE + "select qid, gold, gold_score, ordinal from r")
def retrieval_rank_ordinal(spark, d):
    return ranks(spark, d).select("qid", "gold", "gold_score", "ordinal")


@query(CTE + "select qid, coalesce(list_position(top, gold), 0)::int as position, 1.0 * case when list_contains(top, gold) then 1.0 / list_position(top, gold) else 0 end as rr from top join g using (qid)")
def retrieval_rank_listpos(spark, d):
    p = F.array_position("top", F.col("gold")).cast("int")
    return tops(spark, d).select("qid", p.alias("position"), F.when(p > 0, 1 / p).otherwise(0.0).alias("rr"))


@query(CTE + "select qid, eid, score, rank from t where rank <= 10")
def retrieval_topk10(spark, d):
    q, base = asked(spark, d)
    return vectors.exact_topk(q, base, 10)


@query(CTE + "select qid, top[1:5] as top5, scores[1] as best, gold_score from top join gs using (qid)")
def retrieval_topk_gold_score(spark, d):
    r = ranks(spark, d).select("qid", "gold_score")
    return tops(spark, d).join(r, "qid").select("qid", F.slice("top", 1, 5).alias("top5"), F.col("scores")[0].alias("best"), "gold_score")


@query(CTE + f"select {_m([1, 3, 5, 10, 20], 'hits')}, round(avg(1.0 / rank), 6) mrr, median(rank)::double median_rank, round(avg(rank), 6) mean_rank, count(*) queries from r")
def hits_mr_mrr(spark, d):
    return rounded(metrics.retrieval_metrics(ranks(spark, d), [1, 3, 5, 10, 20], name="hits"))


@query(
    CTE
    + "select "
    + ", ".join(f"round(avg((coalesce(list_position(top, gold), 0) between 1 and {k})::int), 6) hit_{k}, round(avg(case when list_position(top, gold) between 1 and {k} then 1 / log2(list_position(top, gold) + 1) else 0 end), 6) ndcg_{k}" for k in (1, 5, 10))
    + ", round(avg(case when list_position(top, gold) > 0 then 1.0 / list_position(top, gold) else 0 end), 6) mrr, count(*) queries from top join g using (qid)"
)
def ndcg_accuracy_at_k(spark, d):
    return rounded(metrics.list_metrics(tops(spark, d), [1, 5, 10]))


PAIRED = """with p as (select a.vec_id // 2 as pair, a.embedding::double[] a, b.embedding::double[] b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 and a.vec_id % 2 = 0 where a.vec_id % 100 = 0),
n as (select vec_id // 2 as pair, embedding::double[] v from embeddings where vec_id % 2 = 1),
s as (select p.pair, n.pair np, round(list_inner_product(p.a, n.v), 9) s, round(list_inner_product(p.a, p.b), 9) own from p, n),
r as (select pair, own, max(s) filter (where np <> pair) hardest, 1 + count(*) filter (where s > own) as rank from s group by pair, own)
"""


@query(PAIRED + "select pair, own, round(own - hardest, 6) margin, rank from r")
def paired_margin(spark, d):
    e = table(spark, d, "embeddings")
    pair = F.floor(F.col("vec_id") / 2)
    odd = e.filter("vec_id % 2 = 1").select(pair.alias("eid"), F.col("embedding").alias("v"))
    even = e.filter("vec_id % 100 = 0").select(pair.alias("qid"), pair.alias("gold"), F.col("embedding").alias("v"))
    q = even.join(odd.select(F.col("eid").alias("gold"), F.col("v").alias("gold_v")), "gold")
    # exact_topk leaves out the query's own id, which here is its partner: what is left are the negatives.
    hard = vectors.exact_topk(q, odd, 1).select("qid", F.col("score").alias("hardest"))
    r = q.select("qid", F.round(vectors.dot(F.col("v"), F.col("gold_v")), 9).alias("own")).join(hard, "qid")
    above = vectors.gold_ranks(q, odd).select("qid", "rank")
    return r.join(above, "qid").select(F.col("qid").alias("pair"), "own", F.round(F.col("own") - F.col("hardest"), 6).alias("margin"), "rank")


@query(CTE + "select rank, n, round(sum(n) over (order by rank) / sum(n) over (), 6) share from (select rank, count(*) n from r group by rank)")
def rank_cdf(spark, d):
    return rounded(metrics.rank_distribution(ranks(spark, d)))


@query(CTE + "select least(29, floor(log10(rank) * 29 / log10((select count(*) from e)::double)))::int bin, count(*) n from r group by all")
def rank_histogram_log(spark, d):
    return metrics.log_histogram(ranks(spark, d), table(spark, d, "embeddings").count())


@query(CTE + "select floor((scores[1] - scores[2]) * 100)::int bin, count(*) n from top group by all")
def margin_histogram(spark, d):
    m = F.floor((F.col("scores")[0] - F.col("scores")[1]) * 100).cast("int")
    return tops(spark, d).groupBy(m.alias("bin")).agg(F.count("*").alias("n"))


@query(
    CTE
    + """, z as (select qid, scores, list_transform(scores, lambda x: exp(x - scores[1])) z from top),
p as (select qid, scores, list_transform(z, lambda x: x / list_sum(z)) p from z)
select qid, round(scores[1] - scores[2], 6) top1_top2, round(scores[1] - scores[-1], 6) top1_topk, round(list_stddev_pop(scores), 6) deviation,
round(-list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))) / ln(len(p)), 6) entropy, round(p[1], 6) p1 from p"""
)
def score_shape_entropy(spark, d):
    s = F.col("scores")
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)
    dev = F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(s))
    return rounded(
        tops(spark, d).select(
            "qid", (s[0] - s[1]).alias("top1_top2"), (s[0] - F.element_at(s, -1)).alias("top1_topk"), dev.alias("deviation"),
            vectors.softmax_entropy(s).alias("entropy"), vectors.softmax_top(s).alias("p1"),
        )
    )


HALVES = """with e as (select vec_id, embedding[1:32]::double[] a, embedding[33:64]::double[] b from embeddings), q as (select * from e where vec_id % 100 = 0),
s as (select q.vec_id qid, k.vec_id eid, round(list_inner_product(q.a, k.a), 9) sa, round(list_inner_product(q.b, k.b), 9) sb from q join e k on k.vec_id <> q.vec_id),
a as (select qid, eid from (select *, row_number() over (partition by qid order by sa desc, eid) r from s) where r = 1),
b as (select qid, eid from (select *, row_number() over (partition by qid order by sb desc, eid) r from s) where r = 1),
f as (select qid, eid from (select *, row_number() over (partition by qid order by round(case when eid % 7 = 0 then sa else (sa + sb + sa * sb) / 3 end, 9) desc, eid) r from s) where r = 1)
"""


def _halves(spark, d):
    e = table(spark, d, "embeddings")
    half = lambda n: e.select(F.col("vec_id").alias("eid"), F.slice("embedding", n, 32).alias("v"))
    return [vectors.exact_topk(k.filter("eid % 100 = 0").withColumnRenamed("eid", "qid"), k, 1) for k in (half(1), half(33))]


@query(HALVES + "select count(*) queries, round(avg((a.eid = b.eid)::int), 6) agreement from a join b using (qid)")
def modality_agreement(spark, d):
    a, b = (x.select("qid", F.col("eid").alias(n)) for x, n in zip(_halves(spark, d), "ab"))
    return rounded(a.join(b, "qid").agg(F.count("*").alias("queries"), metrics.share(F.col("a") == F.col("b")).alias("agreement")))


@query(HALVES + "select qid, eid from f")
def late_fusion_masked(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("eid"), F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    q = e.filter("eid % 100 = 0").withColumnRenamed("eid", "qid")
    return vectors.best_fused(q, e.withColumn("missing", F.col("eid") % 7 == 0)).select("qid", "eid")


def _pool_sql(expr: str) -> str:
    return f"""with t as (select vec_id, list_transform(range(0, 8), lambda i: embedding[i * 8 + 1 : i * 8 + 8]::double[]) ts from embeddings)
select vec_id, list_transform(range(1, 9), lambda j: round({expr}, 6)) pooled from t"""


def _pooled(how):
    def f(spark, d):
        ts = vectors.tokens(F.col("embedding"), 8, 8)
        e = table(spark, d, "embeddings").withColumn("ts", ts)
        return e.select("vec_id", F.transform(vectors.pool(F.col("ts"), 8, how), lambda x: F.round(x, 6)).alias("pooled"))

    f.__name__ = f"pool_{how}"
    return f


query(_pool_sql("list_avg(list_transform(ts, lambda x: x[j]))"))(_pooled("mean"))
query(_pool_sql("list_max(list_transform(ts, lambda x: x[j]))"))(_pooled("max"))
query(_pool_sql("list_min(list_transform(ts, lambda x: x[j]))"))(_pooled("min"))
query(_pool_sql("ts[1][j]"))(_pooled("cls"))
query(
    """with t as (select vec_id, list_transform(range(0, 8), lambda i: embedding[i * 8 + 1 : i * 8 + 8]::double[]) ts from embeddings),
w as (select *, list_transform(ts, lambda x: exp(list_avg(x))) z from t)
select vec_id, list_transform(range(1, 9), lambda j: round(list_sum(list_transform(range(1, 9), lambda i: ts[i][j] * z[i])) / list_sum(z), 6)) pooled from w"""
)(_pooled("mlp"))


@query(CTE + "select qid, round(ln(sum(exp(least(100, 20.0) * s.score))) - least(100, 20.0) * max(gs.gold_score), 6) loss from s join gs using (qid) group by qid")
def contrastive_loss(spark, d):
    q, base = asked(spark, d)
    own = q.select("qid", (F.round(vectors.dot(F.col("v"), F.col("gold_v")), 9) * 20.0).alias("z"))
    return rounded(vectors.log_sums(q, base, 20.0).join(own, "qid").select("qid", (F.col("logsum") - F.col("z")).alias("loss")))


@query(CTE + f"select label, {_m([1, 10])}, round(avg(1.0 / rank), 6) mrr, median(rank)::double median_rank, round(avg(rank), 6) mean_rank, count(*) queries from r join q using (qid) group by label")
def slice_metrics(spark, d):
    q, base = asked(spark, d)
    return rounded(metrics.retrieval_metrics(vectors.gold_ranks(q, base).join(q.select("qid", "label"), "qid"), [1, 10], ["label"]))
