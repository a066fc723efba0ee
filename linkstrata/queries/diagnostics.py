"""Queries on geometry, layers, significance and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkstrata.operators import compare, coverage, geometry, layers, significance
from linkstrata.queries.auditing import kb, mentions
from linkstrata.queries.quantisation import STAB, _emb, _errors, _errors_sql, _pairs
from linkstrata.queries.registry import query, table
from linkstrata.queries.retrieval import rounded


@query()
def pca_projection(spark, d):
    e = _emb(spark, d)
    mean, basis = geometry.pca(e)
    return geometry.project(e, mean, basis).select("vec_id", F.transform("xy", lambda x: F.round(x, 6)).alias("xy"))


@query("with n as (select count(*) n from embeddings), h as (select range id, md5(range || '-0-i') a, md5(range || '-0-j') b from range(500)), p as (select ('0x' || substr(a, 1, 12))::bigint % n i, ('0x' || substr(b, 1, 12))::bigint % n j from h, n) select i, j from p where i <> j")
def sample_index_pairs(spark, d):
    return geometry.index_pairs(table(spark, d, "embeddings"), "vec_id", 500)


@query(_errors_sql(["int4", "int8"], "mode, label") + ", g as (select label, round(max(snr_db) filter (where mode = 'int8'), 6) - round(max(snr_db) filter (where mode = 'int4'), 6) gap from st group by label) select label, round(gap, 6) gap, row_number() over (order by gap desc, label) place from g")
def sensitivity_ranking(spark, d):
    return rounded(layers.ranking(rounded(_errors(spark, d, ["int4", "int8"], ["mode", "label"]).select("mode", "label", "snr_db"))))


# Names of layers as models give them.
LAYERS = [
    "vision_model.encoder.layers.0.self_attn.q_proj", "vision_model.encoder.layers.0.mlp.fc1", "text_model.encoder.layers.0.self_attn.out_proj", "text_model.encoder.layers.0.mlp.fc2",
    "visual_projection", "text_projection", "text_model.final_layer_norm", "logit_scale",
]


@query("with l as (select replace(x, '.0.', '.' || n_nationkey || '.') as name from nation, (select unnest([" + ", ".join(f"'{x}'" for x in LAYERS) + "]) x)) select name, case when contains(name, 'projection') then 'projection' else (case when contains(name, 'vision') then 'vision' when contains(name, 'text') then 'text' else 'other' end) || '_' || (case when contains(name, 'attn') then 'attention' when contains(name, 'mlp') or contains(name, 'fc') then 'mlp' else 'other' end) end grp, (contains(name, 'attn') or contains(name, 'mlp')) and not contains(name, 'vision') chosen from l")
def layer_groups(spark, d):
    n = F.col("name")
    at = F.concat(F.lit("."), F.col("n_nationkey").cast("string"), F.lit("."))
    every = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, LAYERS))).alias("x")).select(F.replace("x", F.lit(".0."), at).alias("name"))
    return every.select("name", layers.group(n).alias("grp"), layers.selected(n, ["attn", "mlp"], ["vision"]).alias("chosen"))


@query(STAB + "select count(*) filter (where r0 = 1 and r1 <> 1) only_a, count(*) filter (where r0 <> 1 and r1 = 1) only_b, case when count(*) filter (where (r0 = 1) <> (r1 = 1)) > 0 then round(pow(greatest(abs(count(*) filter (where r0 = 1 and r1 <> 1) - count(*) filter (where r0 <> 1 and r1 = 1)) - 1, 0), 2) / count(*) filter (where (r0 = 1) <> (r1 = 1)), 6) else 0.0 end::double chi2 from p")
def mcnemar_top1(spark, d):
    p = _pairs(spark, d).select((F.col("r0") == 1).alias("a"), (F.col("r1") == 1).alias("b"))
    return rounded(significance.mcnemar(p, "a", "b"))


@query()
def paired_bootstrap(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value").alias("a"), (F.col("value") * 1.01 + 0.1).alias("b"))
    return rounded(significance.bootstrap(e, "event_id", "a", "b", 50))


@query("with w as (select distinct split, row_id % 7 as has, \"imgPath\" as name from mentions where \"imgPath\" is not null), p as (select distinct \"imgPath\" as name from mentions where source = 'crowd' and \"imgPath\" is not null), e as (select distinct split, name from w), c as (select split, count(*) checked, count(p.name) found from e left join p using (name) group by split) select split, checked, found, round(100.0 * found / checked, 6) percent, 100.0 * found / checked > 99 covered from c")
def image_coverage(spark, d):
    m = mentions(spark, d).select("split", "source", F.col("imgPath").alias("name"))
    return rounded(coverage.coverage(m.select("split", "name"), m.filter("source = 'crowd'"), "name", "split"))


@query("with s as (select id, case id % 3 when 0 then 'downloaded' when 1 then 'verified' else 'pending' end stage from kb_entity union all select id, 'extracted' from seed_entity), o as (select id, max(list_position(['pending', 'downloaded', 'verified', 'extracted', 'unpacked', 'arranged', 'done'], stage)) p from s group by id) select p::int - 1 as place, count(*) n from o group by all")
def resume_state(spark, d):
    s = table(spark, d, "kb_entity").select(F.col("id").alias("name"), F.element_at(F.array(F.lit("downloaded"), F.lit("verified"), F.lit("pending")), F.col("id") % 3 + 1).alias("stage"))
    new = table(spark, d, "seed_entity").select(F.col("id").alias("name"), F.lit("extracted").alias("stage"))
    return coverage.advance(s, new).groupBy(coverage.stage_number(F.col("stage")).alias("place")).agg(F.count("*").alias("n"))


@query("select event_type, round(sum(case when value > 0 then value else 0 end) / sum(abs(value)), 6) up_share, round(sum(case when value < 0 then -value else 0 end) / sum(abs(value)), 6) down_share, round(greatest(sum(abs(value)) - sum(case when value > 0 then value else 0 end) - sum(case when value < 0 then -value else 0 end), 0), 3) unattributed from events group by event_type")
def phase_shares(spark, d):
    v = F.col("value")
    e = table(spark, d, "events").select("event_type", F.greatest(v, F.lit(0.0)).alias("up"), F.greatest(-v, F.lit(0.0)).alias("down"), F.abs(v).alias("total"))
    p = coverage.phases(e, ["event_type"], ["up", "down"], "total")
    return rounded(p.withColumn("unattributed", F.round("unattributed", 3)))


@query("select qid, min(id) id from (select qid, id from kb_entity union all select qid, id from seed_entity) where qid in (select upper(trim(answer)) from mentions) group by qid")
def semi_join_answers(spark, d):
    a = mentions(spark, d).select(F.upper(F.trim("answer")).alias("qid")).distinct()
    return kb(spark, d).join(a, "qid", "left_semi").groupBy("qid").agg(F.min("id").alias("id"))


@query("with r as (select case event_id % 4 when 0 then '' when 1 then 'CUDA Out of Memory at ' || user_id when 2 then 'bad shape ' || event_type end message from events) select coalesce(case when contains(lower(message), 'out of memory') then 'oom' when coalesce(trim(message), '') <> '' then 'error' end, 'none') kind, count(*) n from r group by all")
def failure_kinds(spark, d):
    i = F.col("event_id") % 4
    message = F.when(i == 0, "").when(i == 1, F.concat(F.lit("CUDA Out of Memory at "), F.col("user_id").cast("string"))).when(i == 2, F.concat(F.lit("bad shape "), "event_type"))
    kinds = table(spark, d, "events").select(F.coalesce(coverage.failed(message), F.lit("none")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@query("select answer, count(*) n, count(distinct mentions) spellings from mentions where answer is not null and upper(trim(answer)) <> 'NIL' group by answer having count(*) > 1")
def mention_groups(spark, d):
    m = mentions(spark, d).filter("answer is not null and upper(trim(answer)) <> 'NIL'")
    return m.groupBy("answer").agg(F.count("*").alias("n"), F.count_distinct("mentions").alias("spellings")).filter("n > 1")


@query("with m as (select split, source, count(*) n, count(distinct answer) answers from mentions group by all) select split, source, metric, value from m unpivot (value for metric in (n, answers))")
def split_source_tall(spark, d):
    m = mentions(spark, d).groupBy("split", "source").agg(F.count("*").alias("n"), F.count_distinct("answer").alias("answers"))
    return compare.tall(m, ["split", "source"], ["n", "answers"])
