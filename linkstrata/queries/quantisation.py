"""Queries on quantisers, indexes and comparisons over ``embeddings`` and ``entity_cache``."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkstrata.operators import compare, index, metrics, quantize, vectors
from linkstrata.queries.registry import query, table
from linkstrata.queries.retrieval import CTE, asked, rounded

MODES = ["fp32", "fp16", "int8", "int4", "int2"]
E = "with e as (select vec_id, label, embedding::double[] v from embeddings) "


def _codes_sql(bits: int, v: str = "v") -> str:
    most = 2 ** (bits - 1) - 1
    s = f"greatest(list_max(list_transform({v}, lambda x: abs(x))) / {most}.0, 1e-12)"
    return f"list_transform({v}, lambda x: greatest(least(round_even(x / {s}, 0), {most}), -{most})::tinyint)", s


def _deq_sql(mode: str) -> str:
    if mode == "fp32":
        return "v"
    if mode == "fp16":
        return "list_transform(v, lambda x: case when abs(x) < 0.00006103515625 then round_even(x * 16777216, 0) / 16777216 else round_even(x / pow(2, floor(log2(abs(x))) - 10), 0) * pow(2, floor(log2(abs(x))) - 10) end)"
    q, s = _codes_sql(int(mode[3:]))
    return f"list_transform({q}, lambda x: x * ({s}))"


def _scaled(df, bits):
    return df.withColumn("s", quantize.scale(F.col("v"), bits))


def _round_trip(df, mode):
    bits = 8 if mode.startswith("fp") else int(mode[3:])
    return _scaled(df, bits).withColumn("q", quantize.quantized(F.col("v"), F.col("s"), mode)).withColumn("mode", F.lit(mode))


def _emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query(E + f"select vec_id, {_codes_sql(8)[0]}::int[] as codes, {_codes_sql(8)[1]} as scale from e")
def quantize_int8_rows(spark, d):
    return _scaled(_emb(spark, d), 8).select("vec_id", quantize.codes(F.col("v"), F.col("s"), 8).cast("array<int>").alias("codes"), F.col("s").alias("scale"))


@query(E + " union all ".join(f"select vec_id, {b} bits, list_sum(list_transform({_codes_sql(b)[0]}, lambda x: abs(x)::int))::bigint as total from e" for b in (2, 3, 4, 6, 8)))
def quantize_intb_sweep(spark, d):
    parts = []
    for b in (2, 3, 4, 6, 8):
        q = quantize.codes(F.col("v"), F.col("s"), b)
        parts.append(_scaled(_emb(spark, d), b).select("vec_id", F.lit(b).alias("bits"), F.aggregate(q, F.lit(0).cast("bigint"), lambda a, x: a + F.abs(x.cast("int"))).alias("total")))
    return compare.union_rows(parts)


@query(E + f"select vec_id, {_deq_sql('fp16')} as v16 from e")
def quantize_fp16(spark, d):
    return _emb(spark, d).select("vec_id", quantize.half(F.col("v")).alias("v16"))


@query(E + ", m as (select min(list_min(v)) lo, max(list_max(v)) hi from e) select vec_id, list_transform(v, lambda x: round((greatest(least(round_even(x / ((hi - lo) / 15.0) + -lo / ((hi - lo) / 15.0), 0), 15.0), 0.0) - -lo / ((hi - lo) / 15.0)) * ((hi - lo) / 15.0), 9)) q from e, m")
def quantize_affine_global(spark, d):
    e = _emb(spark, d)
    m = e.agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"))
    q = quantize.affine(F.col("v"), F.col("lo"), F.col("hi"), 4)
    return e.join(F.broadcast(m)).select("vec_id", F.transform(q, lambda x: F.round(x, 9)).alias("q"))


@query(E + ", m as (select greatest(max(list_max(list_transform(v, lambda x: abs(x)))) / 7.0, 1e-12) s from e) select vec_id, list_transform(v, lambda x: round(greatest(least(round_even(x / s, 0), 15), 0) * s, 9) + 0.0) compat, list_transform(v, lambda x: round(greatest(least(round_even(x / s, 0), 7), -7) * s + 0.0, 9) + 0.0) correct from e, m")
def fake_quantize_compat(spark, d):
    e = _emb(spark, d)
    m = e.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top"))
    r = lambda c: F.transform(c, lambda x: F.round(x, 9) + 0.0)
    return e.join(F.broadcast(m)).select("vec_id", r(quantize.fake_quantize(F.col("v"), F.col("top"), 4, True)).alias("compat"), r(quantize.fake_quantize(F.col("v"), F.col("top"), 4)).alias("correct"))


def _errors_sql(modes, by):
    u = " union all ".join(f"select '{m}' as mode, vec_id, label, v, {_deq_sql(m)} q from e" for m in modes)
    return (
        E
        + f""", u as ({u}), x as (select mode, label, vec_id, unnest(v) x, unnest(q) y from u),
p as (select mode, label, vec_id, sum(abs(x - y)) ad, max(abs(x - y)) md, sum((x - y) * (x - y)) dd, sum(x * x) xx, sum(y * y) yy, sum(x * y) xy, sum((x * y < 0)::int) fl, sum((y = 0 and x <> 0)::int) ze, count(*) n from x group by all),
st as (select {by}, sum(ad) / sum(n) mae, max(md) max_error, sqrt(sum(dd) / sum(xx)) rel_l2, avg(xy / greatest(sqrt(xx * yy), 1e-12)) cos_mean, stddev_pop(xy / greatest(sqrt(xx * yy), 1e-12)) cos_std, sum(fl) / sum(n) sign_flips, sum(ze) / sum(n) zeros, sum(dd) / sum(n) mse, 10 * log10((sum(xx) / sum(n)) / (sum(dd) / sum(n) + 1e-8)) snr_db, sum(n)::bigint n from p group by {by})
"""
    )


STATS = "round(mae, 6) mae, round(max_error, 6) max_error, round(rel_l2, 6) rel_l2, round(cos_mean, 6) cos_mean, round(cos_std, 6) cos_std, round(sign_flips, 6) sign_flips, round(zeros, 6) zeros, round(mse, 6) mse, round(snr_db, 6) snr_db, n"


def _errors(spark, d, modes, by):
    parts = [_round_trip(_emb(spark, d), m).select("mode", "label", quantize.error_sums(F.col("v"), F.col("q")).alias("e")) for m in modes]
    return quantize.error_stats(compare.union_rows(parts), by)


@query(_errors_sql(["fp16", "int8", "int4"], "mode") + f"select mode, {STATS} from st")
def quant_error_stats(spark, d):
    return rounded(_errors(spark, d, ["fp16", "int8", "int4"], ["mode"]))


@query(_errors_sql(["int8", "int4"], "mode, label") + "select mode, round(sum(mae * n) / sum(n), 6) mae, round(max(max_error), 6) max_error, round(min(cos_mean), 6) worst_cos, sum(n)::bigint n from st group by mode")
def quant_error_merge(spark, d):
    return rounded(quantize.merge_error_stats(_errors(spark, d, ["int8", "int4"], ["mode", "label"]), ["mode"]))


@query(_errors_sql(["int2", "int3", "int4", "int6", "int8"], "mode, label") + "select mode, label, round(snr_db, 6) snr_db from st")
def snr_by_bits(spark, d):
    return rounded(_errors(spark, d, ["int2", "int3", "int4", "int6", "int8"], ["mode", "label"]).select("mode", "label", "snr_db"))


@query(_errors_sql(["int4", "int8"], "mode, label") + "select label, round(max(snr_db) filter (where mode = 'int4') - max(snr_db) filter (where mode = 'int8'), 6) gap, case when max(snr_db) filter (where mode = 'int4') - max(snr_db) filter (where mode = 'int8') > -24 then 4 else 8 end bits from st group by label")
def mixed_precision_bits(spark, d):
    s = _errors(spark, d, ["int4", "int8"], ["mode", "label"]).groupBy("label").pivot("mode", ["int4", "int8"]).agg(F.max("snr_db"))
    gap = F.col("int4") - F.col("int8")
    return rounded(s.select("label", gap.alias("gap"), F.when(gap > -24, 4).otherwise(8).alias("bits")))


TENSORS = ["text_cls", "image_cls"]


@query("with t as (" + " union all ".join(f"select '{t}' tensor, sum(len({t}))::bigint n, count({t}) vectors from entity_cache" for t in TENSORS) + ") " + " union all ".join(
    f"select tensor, '{m}' as mode, vectors, " + (f"n * {quantize.bits_of(m) // 8} as logical_bytes, n * {quantize.bits_of(m) // 8} as physical_bytes" if m.startswith("fp") else f"(ceil(n * {quantize.bits_of(m)} / 8.0) + 4 * vectors)::bigint as logical_bytes, n + 2 * vectors as physical_bytes") + " from t"
    for m in MODES
))
def storage_by_mode(spark, d):
    c = table(spark, d, "entity_cache")
    n = compare.union_rows([c.agg(F.sum(F.size(t)).cast("long").alias("n"), F.count(t).alias("vectors")).withColumn("tensor", F.lit(t)) for t in TENSORS])
    return compare.union_rows([n.select("tensor", F.lit(m).alias("mode"), "vectors", quantize.logical_bytes(F.col("n"), F.col("vectors"), m).alias("logical_bytes"), quantize.physical_bytes(F.col("n"), F.col("vectors"), m).alias("physical_bytes")) for m in MODES])


def _mode_ranks_sql():
    parts = []
    for m in ["fp32", "int8", "int4", "int2"]:
        parts.append(f"select '{m}' as mode, vec_id, label, {_deq_sql(m)} v from (select vec_id, label, embedding::double[] v from embeddings)")
    return (
        "with z as ("
        + " union all ".join(parts)
        + """), e as (select mode, vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) v from z),
s as (select q.mode, q.vec_id qid, k.vec_id eid, round(list_inner_product(q.v, k.v), 9) score from e q join e k on q.mode = k.mode and k.vec_id <> q.vec_id where q.vec_id % 100 = 0),
g as (select q.vec_id qid, min(k.vec_id) gold from embeddings q join embeddings k on k.label = q.label and k.vec_id <> q.vec_id where q.vec_id % 100 = 0 group by all),
gs as (select s.mode, s.qid, g.gold, s.score aim from s join g on s.qid = g.qid and s.eid = g.gold),
r as (select s.mode, s.qid, 1 + count(*) filter (where score > aim) as rank from s join gs on s.qid = gs.qid and s.mode = gs.mode group by s.mode, s.qid),
b as (select mode, round(avg((rank <= 1)::int), 6) recall_1, round(avg((rank <= 10)::int), 6) recall_10, round(avg((rank <= 100)::int), 6) recall_100, round(avg(1.0 / rank), 6) mrr, median(rank)::double median_rank, round(avg(rank), 6) mean_rank, count(*) queries from r group by mode),
n as (select sum(len(embedding))::bigint n, count(*) vectors from embeddings),
w as (select b.*, case mode when 'fp32' then 4 * n when 'int8' then n + 4 * vectors when 'int4' then ceil(n / 2.0)::bigint + 4 * vectors else ceil(n / 4.0)::bigint + 4 * vectors end size from b, n)
"""
    )


MODE_RANKS = _mode_ranks_sql()


def mode_ranks(spark, d, modes=("fp32", "int8", "int4", "int2")):
    q, base = asked(spark, d)
    return vectors.gold_ranks(q, base, {m: quantize.seen_as(m) for m in modes})


def mode_table(spark, d):
    m = metrics.retrieval_metrics(mode_ranks(spark, d), [1, 10, 100], ["mode"])
    n = table(spark, d, "embeddings").agg(F.sum(F.size("embedding")).cast("long").alias("n"), F.count("*").alias("vectors"))
    size = F.lit(None).cast("long")
    for mode in ("fp32", "int8", "int4", "int2"):
        size = F.when(F.col("mode") == mode, quantize.logical_bytes(F.col("n"), F.col("vectors"), mode)).otherwise(size)
    return rounded(m.join(F.broadcast(n)).withColumn("size", size).drop("n", "vectors"))


@query(MODE_RANKS + "select * from w")
def retrieval_by_mode(spark, d):
    return mode_table(spark, d)


@query(MODE_RANKS + "select w.mode, w.recall_10, round(w.recall_10 - f.recall_10, 6) recall_10_delta, round(w.mrr - f.mrr, 6) mrr_delta, w.size - f.size as size_delta, round(f.size / w.size, 6) compression from w, w f where f.mode = 'fp32'")
def mode_deltas(spark, d):
    x = compare.deltas(mode_table(spark, d), F.col("mode") == "fp32", ["recall_10", "mrr", "size"])
    return rounded(x.select("mode", "recall_10", "recall_10_delta", "mrr_delta", "size_delta", compare.ratio(F.col("size") - F.col("size_delta"), F.col("size")).alias("compression")))


@query(MODE_RANKS + "select w.mode, w.size from w, w f where f.mode = 'fp32' and round(w.recall_10 - f.recall_10, 6) >= -0.01 and w.size < f.size")
def recommend_modes(spark, d):
    return compare.recommend(mode_table(spark, d), "recall_10", "size", 0.0100001, F.col("mode") == "fp32").select("mode", "size")


STAB = MODE_RANKS + ", p as (select a.qid, a.rank r0, b.rank r1, b.rank - a.rank d from r a join r b on a.qid = b.qid where a.mode = 'fp32' and b.mode = 'int2') "


def _pairs(spark, d):
    r = mode_ranks(spark, d, ("fp32", "int2"))
    a, b = (r.filter(F.col("mode") == m).select("qid", F.col("rank").alias(n)) for m, n in (("fp32", "r0"), ("int2", "r1")))
    return a.join(b, "qid").withColumn("d", F.col("r1") - F.col("r0"))


@query(STAB + "select count(*) filter (where d <> 0) flips, count(*) filter (where d < 0) improved, count(*) filter (where d > 0) worsened, round(avg(abs(d)), 6) mean_abs_delta, median(abs(d))::double median_abs_delta, round(avg(d), 6) mean_delta, round(quantile_cont(d, 0.95), 6) p95_delta, max(d) max_delta, min(d) min_delta, round(avg(((r0 = 1) <> (r1 = 1))::int), 6) top1_flip_rate, round(avg((r0 <= 10 and r1 > 10)::int), 6) top10_exit_rate, count(*) queries from p")
def rank_stability(spark, d):
    return rounded(metrics.rank_stability(_pairs(spark, d), "r0", "r1"))


@query(STAB + "select * from (select qid, d, 'improved' side, row_number() over (order by d, qid) place from p) where place <= 3 union all select * from (select qid, d, 'worsened', row_number() over (order by d desc, qid) place from p) where place <= 3")
def rank_flip_topn(spark, d):
    from linkstrata.operators.ranking import two_sided

    return two_sided(_pairs(spark, d).select("qid", "d"), "d", "qid", 3)


@query("select p_partkey, p_size, p_retailprice from part a where not exists (select 1 from part b where b.p_size <= a.p_size and b.p_retailprice >= a.p_retailprice and (b.p_size < a.p_size or b.p_retailprice > a.p_retailprice))")
def pareto_front(spark, d):
    return compare.pareto(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


@query(E + ", x as (select label, unnest(v) x from e), m as (select label, avg(x) m, stddev_samp(x) s from x group by label) select label, count(*) filter (where abs(x - m) > 3 * s) outliers, round(count(*) filter (where abs(x - m) > 3 * s) / count(*), 6) share, round(max(m + 3 * s), 6) upper, round(min(m - 3 * s), 6) lower from x join m using (label) group by label")
def outlier_clip(spark, d):
    return rounded(quantize.outliers(_emb(spark, d).select("label", F.explode("v").alias("x")), "x", ["label"]))


AWQ = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


@query(
    E
    + ", x as (select vec_id, generate_subscripts(v, 1) i, unnest(v) x from e), act as (select i, avg(abs(x)) a from x group by i), g as (select unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) p), "
    "w as (select p, vec_id, i, x, x * pow(greatest(a, 1e-12), p) y, pow(greatest(a, 1e-12), p) f from x join act using (i), g), t as (select p, vec_id, greatest(max(abs(y)) / 7.0, 1e-12) s from w group by all), "
    "m as (select p, avg(pow(greatest(least(round_even(y / s, 0), 7), -7) * s / f - x, 2)) mse from w join t using (p, vec_id) group by p) select p::double as power, round(mse, 9) mse from m"
)
def awq_scale_search(spark, d):
    x = _emb(spark, d).select("vec_id", F.posexplode("v").alias("i", "x"))
    act = x.groupBy("i").agg(F.avg(F.abs("x")).alias("a"))
    f = F.pow(F.greatest("a", F.lit(1e-12)), F.col("p"))
    w = x.join(F.broadcast(act), "i").withColumn("p", F.explode(F.array(*map(F.lit, AWQ)))).select("p", "vec_id", "x", (F.col("x") * f).alias("y"), f.alias("f"))
    s = w.groupBy("p", "vec_id").agg(F.greatest(F.max(F.abs("y")) / 7.0, F.lit(1e-12)).alias("s"))
    q = F.greatest(F.least(F.rint(F.col("y") / F.col("s")), F.lit(7.0)), F.lit(-7.0)) * F.col("s") / F.col("f")
    return rounded(w.join(s, ["p", "vec_id"]).groupBy(F.col("p").alias("power")).agg(F.avg(F.pow(q - F.col("x"), 2)).alias("mse")), 9)


@query(
    "with e as (select vec_id, embedding::double[] v from embeddings), x as (select vec_id, generate_subscripts(v, 1) i, unnest(v) x from e), m as (select i, min(x) lo, max(x) hi from x group by i), "
    "k as (select vec_id, list(case when hi > lo then lo + least(greatest(round_even((x - lo) / ((hi - lo) / 255.0), 0), 0), 255) * ((hi - lo) / 255.0) else x end order by i) v from x join m using (i) group by vec_id), "
    "s as (select q.vec_id qid, k.vec_id eid, round(list_inner_product(q.v, k.v), 9) score from e q join k on k.vec_id <> q.vec_id where q.vec_id % 100 = 0) "
    "select qid, eid, score, rank from (select *, row_number() over (partition by qid order by score desc, eid) rank from s) where rank <= 10"
)
def sq8_search(spark, d):
    q, base = asked(spark, d)
    return vectors.exact_topk(q, index.sq8(base.select("eid", "v"), index.sq8_ranges(base)), 10)


@query()
def pq_search(spark, d):
    return index.pq_search(*asked(spark, d), 10, 16, 6)


@query()
def opq_search(spark, d):
    return index.pq_search(*asked(spark, d), 10, 16, 6, True)


@query()
def index_benchmark(spark, d):
    return index.benchmark(*asked(spark, d), 10, {"pq_16x6": (16, 6, False), "pq_32x6": (32, 6, False), "opq_16x6": (16, 6, True)})


@query()
def gptq_layers(spark, d):
    return rounded(quantize.gptq_rows(_emb(spark, d).select(F.col("label").cast("string").alias("layer"), F.col("vec_id").alias("id"), "v")))
