"""Queries on formats, filters with counters, checks, packing and comparisons that prepare and judge runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkstrata.functions import text
from linkstrata.operators import audit, compare, gold, metrics, quantize, runs, sanitize, vectors
from linkstrata.queries.auditing import FP, KB, PATH, PLAIN, TRIM, _classes, kb, mentions
from linkstrata.queries.quantisation import MODE_RANKS, _deq_sql, _emb, _errors_sql, _round_trip, mode_table
from linkstrata.queries.registry import query, table
from linkstrata.queries.retrieval import CTE, asked, ranks, rounded, tops
from linkstrata.queries.running import DAYS, _days

# Formats ------------------------------------------------------------------------------------------------


@query("select row_id from mentions where coalesce(mentions, '') <> '' and not starts_with(mentions, 'List of') and coalesce(source, '') <> 'disambiguation' and not contains(lower(coalesce(sentence, '')), 'disambiguation') and regexp_matches(lower(coalesce(\"imgPath\", '')), '\\.(jpg|jpeg|png)$')")
def page_filter(spark, d):
    keep = text.pictured_page(F.col("mentions"), F.col("source"), F.col("sentence"), F.col("imgPath"))
    return mentions(spark, d).filter(keep).select("row_id")


@query("with w as (select row_id, case when starts_with(\"imgPath\", '/') then \"imgPath\" else '/data/set/' || \"imgPath\" end p from mentions), x as (select row_id, p, list_filter(string_split(p, '/'), lambda x: x not in ('', '.')) parts from w) select row_id, '/' || array_to_string(parts, '/') as path from x where p is not null and not list_contains(parts, '..')")
def resolved_paths(spark, d):
    p = text.resolved(F.col("imgPath"), "/data/set", "/data")
    return mentions(spark, d).filter("imgPath is not null and not array_contains(split(imgPath, '/'), '..')").select("row_id", p.alias("path"))


@query("select row_id, replace(replace(mentions, ' ', '_'), '/', '_') || regexp_extract(\"imgPath\", '[^/.][^/]*?(\\.[^./]*)$', 1) as name from mentions where mentions is not null and \"imgPath\" is not null")
def file_names(spark, d):
    m = mentions(spark, d).filter("mentions is not null and imgPath is not null")
    return m.select("row_id", text.file_name(F.col("mentions"), F.col("imgPath")).alias("name"))


@query("with u as (select crawl_id, case when crawl_id % 5 = 0 then coalesce(title, '') else 'https://x.org/wiki/' || coalesce(title, '') end url from crawl_entities) select crawl_id, case when contains(url, '/wiki/') then list_extract(string_split(url, '/wiki/'), -1) else 'UNK_' || crawl_id end page from u")
def page_ids(spark, d):
    url = F.concat(F.when(F.col("crawl_id") % 5 == 0, "").otherwise("https://x.org/wiki/"), F.coalesce("title", F.lit("")))
    return table(spark, d, "crawl_entities").select("crawl_id", text.page_id(url, F.col("crawl_id")).alias("page"))


@query("select split, count(*) n, printf('%.2f%%', 100.0 * count(*) filter (where \"imgPath\" is null or \"imgPath\" = '') / count(*)) as without_image from mentions group by split")
def percent_table(spark, d):
    none = F.count_if(F.coalesce("imgPath", F.lit("")) == "") / F.count("*")
    return mentions(spark, d).groupBy("split").agg(F.count("*").alias("n"), text.percent(none).alias("without_image"))


@query("select distinct 'int4_chunk_' || (l_linenumber * 1000) || case when l_linenumber % 2 > 0 then '_entity_tile_' || (l_linenumber % 2) else '' end || case when l_linenumber % 3 > 0 then '_tglu_tile_' || (l_linenumber % 3) else '' end as label from lineitem")
def run_labels(spark, d):
    n = F.col("l_linenumber").cast("int")
    return table(spark, d, "lineitem").select(text.run_label(F.lit("int4"), n * 1000, n % 2, n % 3).alias("label")).distinct()


@query("with s as (select doc_id, case when n_chars = 0 then null else n_chars * n_chars * n_chars end n from documents) select doc_id, case when n is null then '?' when n < 1024 then printf('%.1f B', n::double) when n < 1048576 then printf('%.1f KiB', n / 1024.0) when n < 1073741824 then printf('%.1f MiB', n / 1048576.0) when n < 1099511627776 then printf('%.1f GiB', n / 1073741824.0) else printf('%.1f TiB', n / 1099511627776.0) end as size from documents join s using (doc_id) where n is null or n % 512 > 0")
def binary_sizes(spark, d):
    n = F.col("n_chars")
    s = table(spark, d, "documents").select("doc_id", F.when(n != 0, n * n * n).alias("n")).filter("n is null or n % 512 > 0")
    return s.select("doc_id", text.binary_size(F.col("n")).alias("size"))


@query("select row_id, md5(concat_ws('_', split, row_id)) joined, md5('{\"row\":' || row_id || ',\"split\":\"' || split || '\"}') as sorted from mentions where split is not null")
def cache_keys(spark, d):
    m = mentions(spark, d).filter("split is not null")
    return m.select("row_id", text.joined_key(F.col("split"), F.col("row_id")).alias("joined"), text.sorted_key(split=F.col("split"), row=F.col("row_id")).alias("sorted"))


@query("select row_id, coalesce(cands[1], 'none') as first from mentions")
def first_candidates(spark, d):
    return mentions(spark, d).select("row_id", text.first_of(F.col("cands"), "none").alias("first"))


@query(f"with {KB} select id, image_list[1] as eval_image, case when len(image_list) > 0 then image_list[(('0x' || substr(md5(id || '-7'), 1, 8))::bigint % greatest(len(image_list), 1)) + 1] end as train_image from kb")
def chosen_images(spark, d):
    i = F.col("image_list")
    return kb(spark, d).select("id", text.chosen_image(i, F.col("id")).alias("eval_image"), text.chosen_image(i, F.col("id"), 7).alias("train_image"))


# Filters with counters, new entities ------------------------------------------------------------------------


@query(f"with {KB}, g as (select m.split, k.id from mentions m left join kb k on upper(trim(m.answer)) = k.qid) select split, count(*) seen, count(*) filter (where id >= 0 and id < 500) kept, count(*) - count(*) filter (where id >= 0 and id < 500) skipped from g group by split")
def gold_range_counts(spark, d):
    from linkstrata.plans.staging import lookup

    ids = kb(spark, d).select(F.col("qid").alias("a"), "id")
    g = lookup(mentions(spark, d).select("split", F.upper(F.trim("answer")).alias("a")), ids, "a")
    return gold.counted(g, F.col("id").between(0, 499), ["split"])


@query("select split, count(*) seen, count(*) filter (where list_contains(cands, answer)) kept, count(*) - count(*) filter (where list_contains(cands, answer)) skipped from mentions group by split")
def gold_in_candidates(spark, d):
    return gold.counted(mentions(spark, d), F.array_contains("cands", F.col("answer")), ["split"])


@query("select qid, entity_name as name from seed_entity union all select upper(trim(answer)), arg_min(mentions, row_id) from mentions where upper(trim(answer)) <> 'NIL' and upper(trim(answer)) not in (select qid from seed_entity) group by 1")
def new_entities(spark, d):
    return gold.with_new_entities(table(spark, d, "seed_entity"), mentions(spark, d))


@query(f"with {KB}, x as (select title, \"desc\" b, crawl_id, row_number() over (order by crawl_id) - 1 entity_id from crawl_entities) select entity_id, crawl_id kb_id, {TRIM.format('title')} as title from x where len(list_filter(regexp_split_to_array(coalesce(b, ''), '\\s+'), lambda x: x <> '')) >= 20")
def numbered_entities(spark, d):
    c = gold.dense_positions(table(spark, d, "crawl_entities").select("crawl_id", "title", "desc"), "crawl_id", "entity_id")
    return c.filter(text.words(F.col("desc")) >= 20).select("entity_id", F.col("crawl_id").alias("kb_id"), text.stripped(F.col("title")).alias("title"))


# Audits ---------------------------------------------------------------------------------------------------

NORMAL = f"select split, {PLAIN.format('mentions')} a, {PLAIN.format('sentence')} b from mentions"


def _normal(spark, d):
    return mentions(spark, d).select("split", text.plain(F.col("mentions")).alias("a"), text.plain(F.col("sentence")).alias("b"))


@query(f"with n as (select distinct split, a, b from ({NORMAL})), s as (select split, count(*) n from n group by split), p as (select x.split as left, y.split as right, count(*) common from n x join n y using (a, b) where x.split < y.split group by all) select x.split as left, y.split as right, coalesce(common, 0) common, least(x.n, y.n) smaller, round(coalesce(common, 0) * 100 / least(x.n, y.n), 4) percent from s x join s y on x.split < y.split left join p on p.left = x.split and p.right = y.split")
def normalized_overlap(spark, d):
    return audit.overlaps(_normal(spark, d), "split", ["a", "b"])


@query(f"with n as ({NORMAL}) select b from (select b from n where split = 'train' intersect select b from n where split = 'test') order by b limit 20")
def normalized_overlap_sample(spark, d):
    return audit.overlap_sample(_normal(spark, d), "split", "train", "test", "b")


@query(f"with {KB} select \"imgPath\" as label from mentions where \"imgPath\" <> '' union select x from (select unnest(image_list) x from kb) where x <> ''")
def all_images(spark, d):
    return audit.all_labels((mentions(spark, d), "imgPath"), (kb(spark, d), "image_list"))


@query(f"with {KB} select count(*) entities, sum(coalesce(len(image_list), 0))::bigint images, count(*) filter (where coalesce(len(image_list), 0) = 0) as without from kb")
def image_totals(spark, d):
    return sanitize.image_total(kb(spark, d))


@query(FP + "select a, b, distance::int distance, place from (select *, row_number() over (partition by distance order by a, b) place from p where distance <= 4) where place <= 20")
def hamming_samples(spark, d):
    c = _classes(spark, d)
    p = audit.hamming_join(c, c, 4).filter("a < b").withColumn("distance", F.col("distance").cast("int"))
    return audit.samples(p, "distance", ["a", "b"]).select("a", "b", "distance", "place")


@query("select sha, list(doc_id order by doc_id) ids from (select sha256(text) sha, doc_id, row_number() over (partition by text order by doc_id) r, count(*) over (partition by text) n from documents where text is not null) where n > 1 and r <= 20 group by sha")
def hash_group_lists(spark, d):
    g = table(spark, d, "documents").filter("text is not null").select(F.sha2("text", 256).alias("sha"), "doc_id")
    first = audit.samples(g, "sha", ["doc_id"]).groupBy("sha").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return first.filter(F.size("ids") > 1)


GATE = f"""with {KB}, n as (select distinct split, a, b from ({NORMAL})), f as (select distinct split, {PATH} p from mentions),
c as (select 'normalized_cross_split_zero' as name, (select count(*) from (select a, b from n group by a, b having count(*) > 1)) n
union all select 'exact_image_bytes_cross_split_zero', (select count(*) from (select p from f where p <> '' group by p having count(*) > 1))
union all select 'gold_entity_exact_image_bytes_zero', (select count(*) from mentions join kb on upper(trim(answer)) = qid where list_contains(image_list, "imgPath"))
union all select 'answer_id_filename_zero', (select count(*) from mentions where answer is not null and contains(lower(coalesce("imgPath", '')), lower(trim(answer))))
union all select 'perceptual_review_complete', (select count(*) from (select 1 from entity_cache where image_cls is not null group by image_cls having count(*) > 1)))
"""


def _gate(spark, d):
    m = mentions(spark, d)
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    shared = lambda df, keys: df.groupBy(*keys).agg(F.count_distinct("split").alias("k")).filter("k > 1")
    files = m.select("split", text.same_file(F.col("imgPath")).alias("p")).filter("p <> ''")
    leaked = audit.gold_image_leakage(m, kb(spark, d)).agg(F.sum("leaked").alias("n")).select(F.lit(audit.CHECKS[2]).alias("name"), "n")
    named = m.filter(F.col("answer").isNotNull() & F.contains(F.lower(F.coalesce("imgPath", F.lit(""))), F.lower(F.trim("answer"))))
    alike = table(spark, d, "entity_cache").filter("image_cls is not null").groupBy(F.xxhash64("image_cls"), "image_cls").agg(F.count("*").alias("k")).filter("k > 1")
    parts = [n(audit.CHECKS[0], shared(_normal(spark, d), ["a", "b"])), n(audit.CHECKS[1], shared(files, ["p"])), leaked, n(audit.CHECKS[3], named), n(audit.CHECKS[4], alike)]
    return audit.six_part_gate(compare.union_rows(parts))


@query(GATE + "select name, n::bigint n, n = 0 as passed from c union all select 'accepted', sum(n)::bigint, bool_and(n = 0) from c")
def six_part_gate(spark, d):
    return _gate(spark, d)


@query("select 'entities' as name, count(*) n, sha256((select string_agg(sha, '' order by chunk) from (select id // 10000 as chunk, sha256('[' || string_agg('{\"qid\":\"' || qid || '\"}', ',' order by id) || ']') sha from kb_entity group by all))) sha from kb_entity union all select 'areas', count(*), sha256((select string_agg(sha, '' order by chunk) from (select area_no // 10000 as chunk, sha256('[' || string_agg('{\"subject\":\"' || subject || '\"}', ',' order by area_no) || ']') sha from subject_area group by all))) from subject_area")
def frozen_manifest(spark, d):
    accepted = spark.createDataFrame([("accepted", True)], "name string, passed boolean")
    return sanitize.freeze(accepted, {"entities": (table(spark, d, "kb_entity"), "id", "qid"), "areas": (table(spark, d, "subject_area"), "area_no", "subject")})


@query(f"with {KB}, f as (select qid, {PATH.replace('\"imgPath\"', 'x')} p from (select distinct qid, unnest(image_list) x from kb)), g as (select distinct qid, p from f where p <> ''), m as (select split, upper(trim(answer)) a, {PATH} p from mentions) select split, count(*) pairs, count(*) filter (where a = qid) gold from m join g using (p) group by split")
def hash_pair_gold(spark, d):
    m = mentions(spark, d).select("split", F.upper(F.trim("answer")).alias("a"), text.same_file(F.col("imgPath")).alias("p"))
    e = kb(spark, d).select("qid", F.explode("image_list").alias("x")).select("qid", text.same_file(F.col("x")).alias("p"))
    return audit.file_pairs(m, e.distinct(), "split")


# Quantisers -------------------------------------------------------------------------------------------------

C = "with e as (select vec_id, label, embedding::double[] v from embeddings) "
HALF = "(case when {0} < 0.00006103515625 then round_even({0} * 16777216, 0) / 16777216 else round_even({0} / pow(2, floor(log2({0})) - 10), 0) * pow(2, floor(log2({0})) - 10) end)"
S4 = "greatest(list_max(list_transform(v, lambda x: abs(x))) / 7.0, 1e-12)"


@query(C + f", s as (select vec_id, v, {HALF.format(S4)} s from e) select vec_id, s as scale, list_transform(v, lambda x: greatest(least(round_even(x / s, 0), 7), -7)::int) as q from s")
def packed_int4(spark, d):
    p = _emb(spark, d).select("vec_id", quantize.packed(F.col("v"), "int4").alias("p"))
    return p.select("vec_id", "p.scale", F.col("p.q").cast("array<int>").alias("q"))


PACK = {"text_cls": "int8", "image_cls": "int4"}


def _pack_sql(t: str, m: str) -> str:
    bits = quantize.bits_of(m)
    most = 2 ** (bits - 1) - 1
    s = HALF.format("s0")
    return f"""select '{t}' as tensor, '{m}' as mode, count(distinct cache_id) vectors, (ceil(count(*) * {bits} / 8.0) + 4 * count(distinct cache_id))::bigint logical_bytes, count(*) + 2 * count(distinct cache_id) as physical_bytes, round(avg(abs(x - y)), 6) mae, round(max(abs(x - y)), 6) max_error
from (select cache_id, x, case when s > 0 then greatest(least(round_even(x / s, 0), {most}), -{most}) * s else 0 end y from (select cache_id, x, s from (select cache_id, v, {s} s from (select cache_id, {t}::double[] v, greatest(list_max(list_transform({t}::double[], lambda x: abs(x))) / {most}.0, 1e-12) s0 from entity_cache where {t} is not null)), unnest(v) u(x)))"""


@query(" union all ".join(_pack_sql(t, m) for t, m in PACK.items()))
def pack_report(spark, d):
    return rounded(quantize.pack_report(table(spark, d, "entity_cache"), PACK))


@query("with w as (select label, unnest(embedding) x from embeddings), n as (select label, count(*) n from w group by label) select count(*) as layers, count(*) filter (where label % 2 = 0) chosen_layers, sum(n)::bigint as parameters, coalesce(sum(n) filter (where label % 2 = 0), 0)::bigint chosen_parameters from n")
def layer_quantisation(spark, d):
    w = _emb(spark, d).withColumnRenamed("label", "layer")
    return quantize.layer_counts(quantize.quantize_layers(w, "int4", F.col("layer") % 2 == 0))


def _outlier_sql(how: str) -> str:
    y = {"clip": "least(greatest(x, m - 3 * s), m + 3 * s)", "absorb": "x", "fp16": "case when abs(x - m) > 3 * s then 0 else x end"}[how]
    q = "greatest(least(round_even(y / t, 0), 7), -7) * t"
    if how == "fp16":
        q = f"case when far then sign(x) * {HALF.format('abs(x)')} else {q} end"
    return f"""select '{how}' as how, label, count(*) filter (where far) far, round(avg(abs(q - x)), 6) mae from (select label, x, far, {q} q from (select *, greatest(max(abs(y)) over (partition by label) / 7.0, 1e-12) t from (select label, x, abs(x - m) > 3 * s far, {y} y from x join st using (label)))) group by label"""


@query(C + ", x as (select label, unnest(v) x from e), st as (select label, avg(x) m, stddev_samp(x) s from x group by label) " + " union all ".join(_outlier_sql(h) for h in ("clip", "absorb", "fp16")))
def outlier_handling(spark, d):
    x = _emb(spark, d).select("label", F.explode("v").alias("x"))
    parts = [quantize.with_outliers(x, "x", ["label"], 4, h).groupBy("label").agg(F.count_if("far").alias("far"), F.avg(F.abs(F.col("q") - F.col("x"))).alias("mae")).withColumn("how", F.lit(h)) for h in ("clip", "absorb", "fp16")]
    return rounded(compare.union_rows(parts))


@query(C + ", x as (select unnest(v) x from e), m as (select min(x) lo, max(x) hi from x) select round(avg(abs(greatest(least(round_even(x / (greatest(abs(lo), abs(hi)) / 7.0), 0), 7), -7) * (greatest(abs(lo), abs(hi)) / 7.0) - x)), 6) as symmetric, round(avg(abs((greatest(least(round_even(x / ((hi - lo) / 15.0) - lo / ((hi - lo) / 15.0), 0), 15), 0) + lo / ((hi - lo) / 15.0)) * ((hi - lo) / 15.0) - x)), 6) as affine from x, m")
def straight_through(spark, d):
    x = _emb(spark, d).select(F.explode("v").alias("x"))
    err = lambda s, n: quantize.straight_through(x, "x", 4, s).agg(F.avg(F.abs(F.col("q") - F.col("x"))).alias(n))
    return rounded(err(True, "symmetric").join(F.broadcast(err(False, "affine"))))


@query("with x as (select shard, unnest(image_cls)::double x from entity_cache where image_cls is not null), t as (select shard, max(abs(x)) top from x group by shard), b as (select unnest([2, 3, 4, 6, 8]) bits), y as (select shard, bits, x, greatest(least(round_even(x / greatest(top / (pow(2, bits - 1) - 1), 1e-12), 0), pow(2, bits - 1) - 1), -(pow(2, bits - 1) - 1)) * greatest(top / (pow(2, bits - 1) - 1), 1e-12) y from x join t using (shard), b) select shard, bits::int bits, round(avg((x - y) * (x - y)), 6) mse, round(10 * log10(avg(x * x) / (avg((x - y) * (x - y)) + 1e-8)), 6) snr_db from y group by all")
def activation_sensitivity(spark, d):
    return rounded(quantize.sensitivity(table(spark, d, "entity_cache").filter("size(image_cls) > 0"), "shard", "image_cls"))


@query(C + ", u as (" + " union all ".join(f"select '{m}' as mode, v, {_deq_sql(m)} q from e" for m in ("int8", "int4")) + "), x as (select mode, abs(sqrt(list_inner_product(q, q)) - sqrt(list_inner_product(v, v))) d, list_max(list_transform(range(1, len(v) + 1), lambda i: abs(q[i] - v[i]))) m, list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(q[i] - v[i]))) t, len(v) n from u) select mode, round(avg(d), 6) norm_error, round(max(m), 6) max_error, round(sum(t) / sum(n), 6) mean_error from x group by mode")
def norm_errors(spark, d):
    parts = [_round_trip(_emb(spark, d), m) for m in ("int8", "int4")]
    return rounded(quantize.norm_errors(compare.union_rows(parts), ["mode"]))


@query("with t as (select shard, 'text_cls' as tensor, 'int8' as mode, sum(len(text_cls))::bigint n, count(text_cls) v from entity_cache group by shard union all select shard, 'image_cls', 'fp16', coalesce(sum(len(image_cls)), 0)::bigint, count(image_cls) from entity_cache group by shard), b as (select *, case when mode = 'int8' then n + 4 * v else 2 * n end b from t) select tensor, mode, sum(b)::bigint bytes, count(*) shards, min(b) least, round(avg(b), 6) mean, max(b) most from b group by all")
def shard_storage(spark, d):
    return rounded(quantize.shard_sizes(table(spark, d, "entity_cache"), "shard", {"text_cls": "int8", "image_cls": "fp16"}))


# Comparisons and runs -----------------------------------------------------------------------------------------


@query(MODE_RANKS + "select w.*, round(w.recall_10 - f.recall_10, 6) recall_10_delta, round(w.mrr - f.mrr, 6) mrr_delta, round(f.size / w.size, 6) size_ratio from w, w f where w.mode = 'int4' and f.mode = 'fp32'")
def conservative_row(spark, d):
    return rounded(compare.conservative(mode_table(spark, d), {"mode": "int4"}, {"mode": "fp32"}, ["recall_10", "mrr"], "size"))


@query(MODE_RANKS + "select w.mode, round(f.recall_1 - w.recall_1, 6) recall_1_drop, round(f.recall_10 - w.recall_10, 6) recall_10_drop, f.size - w.size as saving, round(f.size / w.size, 6) compression from w, w f where f.mode = 'fp32'")
def index_tradeoffs(spark, d):
    x = compare.tradeoffs(mode_table(spark, d), "mode", "fp32", ["recall_1", "recall_10"], "size")
    return rounded(x.select("mode", "recall_1_drop", "recall_10_drop", "saving", "compression"))


@query(DAYS + ", g as (select *, (0.5 - m) / 0.5 degradation from s), h as (select *, sum(case when degradation <= 0.9 then 1 else 0 end) over (order by day) island from g), b as (select day, m, degradation, sum(case when degradation <= 0.9 then 0 else 1 end) over (partition by island order by day) bad from h) select day, m, round(degradation, 6) degradation, bad::bigint bad, bad >= 2 as stop from b")
def relative_degradation(spark, d):
    return rounded(metrics.degraded(_days(spark, d), "day", "m", 0.5, 0.9, 2))


@query(CTE + ", p as (select r.qid, r.rank, coalesce(list_position(top.top, r.gold), 0) as pos from r join top using (qid)) select " + ", ".join(f"round(avg((rank <= {k})::int), 6) rank_recall_{k}, round(avg((pos between 1 and {k})::int), 6) list_recall_{k}" for k in (1, 10, 50)) + ", count(*) queries from p")
def both_recalls(spark, d):
    return rounded(metrics.both_recalls(ranks(spark, d), tops(spark, d), [1, 10, 50]))


@query(CTE + "select qid, gold, rank from r where qid % 300 > 0")
def stream_rank_batches(spark, d):
    from linkstrata.streaming.ranks import stream_ranks

    q, base = asked(spark, d)
    gold_of = q.filter("qid % 300 > 0").select("qid", "gold", "gold_v")
    return stream_ranks(spark, f"{d}/embeddings.parquet", "vec_id", "embedding", gold_of, base, "vec_id % 100 = 0")[0]


@query("select p_partkey, p_size from (select p_partkey, p_size from part order by p_size desc nulls last, p_partkey limit 50)")
def task_queue(spark, d):
    return runs.prioritised(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey").limit(50)


@query("select event_id, case when event_id % 7 = 0 then null else event_id * 2.0::double end as value, case when event_id % 7 <> 0 then 'ok' when event_id % 2 = 0 then 'oom' else 'error' end as status from events")
def isolated_tasks(spark, d):
    def work(row: dict) -> float:
        if row["event_id"] % 7 == 0:
            raise RuntimeError("CUDA out of memory" if row["event_id"] % 2 == 0 else "bad shape")
        return row["event_id"] * 2.0

    return runs.isolated(table(spark, d, "events").select("event_id"), work, "event_id").drop("message")


@query("with t as (select unnest(['text_cls', 'image_cls', 'text_cls']) tensor, unnest(['int8', 'fp16', 'int4']) as mode) select tensor, mode, tensor = 'text_cls' and mode = 'int8' as kept from t")
def resume_validity(spark, d):
    shards = table(spark, d, "entity_cache").select("shard").distinct()
    done = shards.select(F.lit("text_cls").alias("tensor"), F.lit("int8").alias("mode"), F.lit("v2").alias("version"), F.lit(True).alias("complete"))
    old = shards.select(F.lit("image_cls").alias("tensor"), F.lit("fp16").alias("mode"), F.lit("v1").alias("version"), F.lit(True).alias("complete"))
    wanted = spark.createDataFrame([("text_cls", "int8"), ("image_cls", "fp16"), ("text_cls", "int4")], "tensor string, mode string")
    kept, todo = runs.resumable(done.unionByName(old), wanted, "v2")
    return kept.withColumn("kept", F.lit(True)).unionByName(todo.withColumn("kept", F.lit(False)))


# What encoders see ---------------------------------------------------------------------------------------------


@query("with e as (select vec_id, embedding[1:32]::double[] t, embedding[33:64]::double[] i from embeddings) " + " union all ".join(f"select vec_id, '{m}' as mode, round({t} + 2 * {i}, 6) seen from e" for m, t, i in (
    ("fused", "list_sum(t)", "list_sum(i)"), ("text", "list_sum(t)", "0"), ("vision", "0", "list_sum(i)"), ("flip", "list_sum(t)", "list_sum(list_transform(range(1, 33), lambda k: i[((k - 1) // 8) * 8 + 8 - ((k - 1) % 8)] * k))")
)))
def modality_masks(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("t"), F.slice("embedding", 33, 32).alias("i"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    parts = []
    for m in vectors.MASKS:
        t, i = vectors.masked(F.col("t"), F.col("i"), m, 8)
        i = F.transform(i, lambda x, k: x * (k + 1)) if m == "flip" else i
        parts.append(e.select("vec_id", F.lit(m).alias("mode"), (total(t) + 2 * total(i)).alias("seen")))
    return rounded(compare.union_rows(parts))


@query("with c as (select row_id, list_transform(cands, lambda x: substr(x, 2)::int) ids from mentions) select row_id, list_concat(coalesce(ids[1:6], []), list_transform(range(len(coalesce(ids[1:6], [])), 6), lambda x: -1)) ids, list_concat(list_transform(coalesce(ids[1:6], []), lambda x: 1), list_transform(range(len(coalesce(ids[1:6], [])), 6), lambda x: 0)) mask from c")
def padded_batches(spark, d):
    ids, mask = vectors.padded(F.transform("cands", lambda x: F.substring(x, 2, 20).cast("int")), 6, -1)
    return mentions(spark, d).select("row_id", ids.alias("ids"), mask.alias("mask"))


@query("with x as (select vec_id id, vec_id // 16 batch, embedding[1:32]::double[] m, embedding[33:64]::double[] e from embeddings), c as (select batch, e from x union all select batch, list_reverse(e) from x where id % 5 = 0), z as (select x.id, least(200.0, 100.0) * list_inner_product(x.m, c.e) z, least(200.0, 100.0) * list_inner_product(x.m, x.e) own from x join c using (batch)), t as (select id, max(z) top from z group by id) select id, round(max(top) + ln(sum(exp(z - top))) - max(own), 6) loss from z join t using (id) group by id")
def batch_loss(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 16).alias("batch"), F.slice("embedding", 1, 32).alias("m"), F.slice("embedding", 33, 32).alias("e"))
    e = e.withColumn("hard", F.when(F.col("id") % 5 == 0, F.array(F.reverse("e"))))
    return rounded(vectors.batch_loss(e, "batch", 200.0, "hard"))
