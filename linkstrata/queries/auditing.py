"""Queries on splits, images, gold labels and sanitised variants over ``mentions`` and the knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkstrata.functions import text
from linkstrata.operators import audit, gold, sampling, sanitize, vectors
from linkstrata.queries.registry import query, table

KB = "kb as (select * from kb_entity union all by name select * from seed_entity)"


def kb(spark, d):
    return table(spark, d, "kb_entity").unionByName(table(spark, d, "seed_entity"))


def mentions(spark, d):
    return table(spark, d, "mentions")


@query(f"with {KB}, t as (select entity_name title, max(id) id from kb group by entity_name) select m.row_id, coalesce(k.id, t.id) gold, case when k.id is not null then 'id' else 'title' end as by from mentions m left join kb k on upper(trim(m.answer)) = k.qid left join t on m.mentions = t.title where coalesce(k.id, t.id) is not null")
def gold_join_id_or_title(spark, d):
    return gold.resolve_gold(mentions(spark, d), kb(spark, d))


@query("select qid, arg_max(title, crawl_id) title, arg_max(source, crawl_id) source from crawl_entities where qid is not null group by qid")
def gold_join_last_wins(spark, d):
    return gold.last_wins(table(spark, d, "crawl_entities"), "qid", "crawl_id", "title", "source")


@query(f"with {KB}, c as (select row_id, list_filter(cands[1:10], lambda x: x <> coalesce(answer, '')) c from mentions where cands is not null), p as (select row_id, unnest(c) qid, generate_subscripts(c, 1) - 1 place from c) select row_id, place::int as place, id from p join kb using (qid)")
def candidate_pruning(spark, d):
    return gold.candidates(mentions(spark, d), kb(spark, d))


@query("with s as (select mentions, sentence, \"imgPath\", answer, arg_max(len(cands), row_id) n from mentions where cands is not null group by all) select m.row_id, s.n::int n_found from mentions m left join s on m.mentions is not distinct from s.mentions and m.sentence is not distinct from s.sentence and m.\"imgPath\" is not distinct from s.\"imgPath\" and m.answer is not distinct from s.answer")
def candidate_enrich(spark, d):
    m = mentions(spark, d)
    s = m.filter("cands is not null").withColumn("n", F.size("cands"))
    return gold.enrich(m, s, audit.KEYS["full_row"], "row_id", "n").select("row_id", "n_found")


@query(f"with {KB} select coalesce(case when answer is null then 'no answer' when upper(trim(answer)) = 'NIL' then 'nil' when k.qid is null then 'unknown entity' when coalesce(trim(\"imgPath\"), '') = '' then 'no image' end, 'kept') reason, count(*) n from mentions m left join kb k on upper(trim(m.answer)) = k.qid group by all")
def drop_reasons(spark, d):
    return gold.drop_reason(kb(spark, d), mentions(spark, d)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("select row_id, 'q_' || (row_number() over (order by row_id) - 1) query_id from mentions where answer is not null")
def surrogate_ids(spark, d):
    kept = mentions(spark, d).filter("answer is not null").select("row_id")
    return gold.dense_positions(kept, "row_id").select("row_id", F.concat(F.lit("q_"), F.col("position").cast("string")).alias("query_id"))


TRIM = "regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g')"


@query(f"with c as (select crawl_id, {TRIM.format('title')} t, {TRIM.format('\"desc\"')} b from crawl_entities) select crawl_id, concat_ws('. ', nullif(t, ''), nullif(left(b, 300), '')) text from c")
def build_text(spark, d):
    return table(spark, d, "crawl_entities").select("crawl_id", text.composed(F.col("title"), F.col("desc")).alias("text"))


@query(f"select source, count(*) filter (where coalesce(title, '') like 'List of%' or coalesce(title, '') like '%(disambiguation)%' or length({TRIM.format('\"desc\"')}) < 20) junk, count(*) n from crawl_entities group by source")
def junk_filter(spark, d):
    c = table(spark, d, "crawl_entities")
    return c.groupBy("source").agg(F.count_if(text.junk(F.col("title"), F.col("desc"))).alias("junk"), F.count("*").alias("n"))


@query("select crawl_id, len(list_filter(regexp_split_to_array(coalesce(\"desc\", ''), '\\s+'), lambda x: x <> ''))::int words from crawl_entities where len(list_filter(regexp_split_to_array(coalesce(\"desc\", ''), '\\s+'), lambda x: x <> '')) >= 20")
def weak_entity_filter(spark, d):
    c = table(spark, d, "crawl_entities").select("crawl_id", text.words(F.col("desc")).alias("words"))
    return c.filter("words >= 20")


PLAIN = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("select doc_id, " + PLAIN.format("text").replace("'\\s+'", "'[\\s\\p{Z}]+'").replace("_\\s]", "_\\s\\p{Z}]") + " as text from documents")
def normalize_text_sql(spark, d):
    return table(spark, d, "documents").select("doc_id", text.plain(F.col("text")).alias("text"))


@query()
def normalize_text_full(spark, d):
    return mentions(spark, d).select("row_id", text.full_normal(F.col("sentence")).alias("sentence"))


@query("select row_id, regexp_replace(regexp_replace(lower(trim(coalesce(\"imgPath\", ''))), '[\\\\/]+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g') file, split_part(list_extract(string_split(\"imgPath\", '/'), -1), '.', 1) || '.jpg' jpg from mentions")
def path_ops(spark, d):
    p = F.col("imgPath")
    return mentions(spark, d).select("row_id", text.same_file(p).alias("file"), text.jpg_name(p).alias("jpg"))


@query("select id, replace(url_decode(entity_name), '_', ' ') as name, replace(url_decode(entity_name), '_', ' ') || ' [SEP] ' || coalesce(\"desc\", '') as text from kb_entity")
def url_entity_text(spark, d):
    name = text.unquoted(F.col("entity_name"))
    return table(spark, d, "kb_entity").select("id", name.alias("name"), F.concat(name, F.lit(" [SEP] "), F.coalesce("desc", F.lit(""))).alias("text"))


@query("select split, count(*) as rows, count(distinct {'a': answer}) answers, count(distinct {'a': \"imgPath\"}) images, count(distinct {'a': mentions, 'b': sentence}) texts from mentions group by split")
def split_inventory(spark, d):
    return audit.inventory(mentions(spark, d), "split", {"answers": ["answer"], "images": ["imgPath"], "texts": ["mentions", "sentence"]})


@query(" union all ".join(f"select '{n}' as key, split, (count(*) - count(distinct {{{', '.join(f'{chr(39)}{c}{chr(39)}: \"{c}\"' for c in k)}}}))::bigint duplicates from mentions group by split" for n, k in audit.KEYS.items()))
def within_split_duplicates(spark, d):
    from linkstrata.operators.compare import union_rows

    return union_rows([audit.duplicates(mentions(spark, d), "split", k).withColumn("key", F.lit(n)) for n, k in audit.KEYS.items()])


def _overlap_sql(n, k):
    c = ", ".join(f'"{x}"' for x in k)
    size = lambda s: f"(select count(*) from (select distinct {c} from mentions where split = '{s}'))"
    out = []
    for a, b in (("dev", "test"), ("dev", "train"), ("test", "train")):
        both = f"(select count(*) from (select distinct {c} from mentions where split = '{a}' intersect select distinct {c} from mentions where split = '{b}'))"
        out.append(f"select '{n}' as key, '{a}' as left, '{b}' as right, {both} common, least({size(a)}, {size(b)}) smaller, round({both} * 100 / least({size(a)}, {size(b)})::double, 4) percent")
    return " union all ".join(out)


@query(" union all ".join(_overlap_sql(n, k) for n, k in audit.KEYS.items()))
def cross_split_overlap(spark, d):
    from linkstrata.operators.compare import union_rows

    return union_rows([audit.overlaps(mentions(spark, d), "split", k).withColumn("key", F.lit(n)) for n, k in audit.KEYS.items()])


@query("select sentence from (select sentence from mentions where split = 'train' intersect select sentence from mentions where split = 'test') order by sentence limit 20")
def overlap_sample(spark, d):
    return audit.overlap_sample(mentions(spark, d), "split", "train", "test", "sentence")


@query(f"with {KB} select split, count(*) mentions, count(*) filter (where coalesce(list_contains(image_list, \"imgPath\"), false)) leaked from mentions join kb on upper(trim(answer)) = qid group by split")
def gold_image_leakage(spark, d):
    return audit.gold_image_leakage(mentions(spark, d), kb(spark, d))


@query(f"with {KB} select count(*) n, count(*) filter (where contains(lower(coalesce(\"imgPath\", '')), lower(substr(qid, 2, 2)))) hits from mentions join kb on upper(trim(answer)) = qid")
def filename_contains_answer(spark, d):
    m = mentions(spark, d).withColumn("qid", F.upper(F.trim("answer"))).join(kb(spark, d).select("qid"), "qid")
    hit = F.contains(F.lower(F.coalesce("imgPath", F.lit(""))), F.lower(F.substring("qid", 2, 2)))
    return m.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))


def _dedupe_sql(keys, blank):
    rank = "case split when 'train' then 0 when 'dev' then 1 else 2 end"
    cond = []
    for _ in keys:
        cond.append(f"not exists (select 1 from r b where b.o < a.o and b.k{len(cond)} = a.k{len(cond)}" + ("" if blank else f" and a.k{len(cond)} <> ''") + ")")
    cols = ", ".join(f"{k} k{i}" for i, k in enumerate(keys))
    return f"with r as (select *, {rank} o, {cols} from mentions) select row_id, split from r a where " + " and ".join(cond)


@query(_dedupe_sql(["sentence", '"imgPath"'], False))
def dedupe_raw(spark, d):
    return sanitize.dedupe_splits(mentions(spark, d), [F.col("sentence"), F.col("imgPath")]).select("row_id", "split")


PATH = "regexp_replace(regexp_replace(lower(trim(coalesce(\"imgPath\", ''))), '[\\\\/]+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g')"
SENT = "trim(regexp_replace(lower(coalesce(sentence, '')), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'))"


@query(_dedupe_sql([SENT, PATH], False))
def dedupe_normalized(spark, d):
    return sanitize.dedupe_splits(mentions(spark, d), [text.spaced(F.col("sentence")), text.same_file(F.col("imgPath"))]).select("row_id", "split")


@query(_dedupe_sql([SENT, PATH], True))
def dedupe_normalized_blank(spark, d):
    return sanitize.dedupe_splits(mentions(spark, d), [text.spaced(F.col("sentence")), text.same_file(F.col("imgPath"))], keep_blank=False).select("row_id", "split")


@query(f"with {KB} select id, len(coalesce(image_list, []))::int before, 0 as after from kb")
def kb_strip_images(spark, d):
    gone = F.array().cast("array<string>")
    return kb(spark, d).select("id", F.size(F.coalesce("image_list", gone)).alias("before"), F.size(gone).alias("after"))


@query(
    f"with {KB}, b as (select distinct unnest(image_list) image from kb where id % 3 = 0), x as (select id, unnest(image_list) image, generate_subscripts(image_list, 1) i from kb), "
    "k as (select id, list(image order by i) l from x where image not in (select image from b where image is not null) group by id) select kb.id, case when kb.image_list is not null then coalesce(k.l, []) end image_list from kb left join k using (id)"
)
def kb_filter_images(spark, d):
    e = kb(spark, d)
    return sanitize.without_images(e, e.filter("id % 3 = 0").select(F.explode("image_list").alias("image")), "image").select("id", "image_list")


@query(f"with {KB} select k.id, c.crawl_id from kb k join crawl_entities c on sha256(k.\"desc\") = sha256(c.\"desc\")")
def exact_hash_pairs(spark, d):
    k = kb(spark, d).select("id", F.sha2("desc", 256).alias("sha"))
    return k.join(table(spark, d, "crawl_entities").select("crawl_id", F.sha2("desc", 256).alias("sha")), "sha").select("id", "crawl_id")


@query("select sha256(text) sha, min(doc_id) first_id, count(*) n from documents where text is not null group by all having count(*) > 1")
def hash_groups(spark, d):
    g = table(spark, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return g.filter("n > 1")


FP = """with f as (select cache_id, list_sum(list_transform(range(1, 33), lambda i: case when text_cls[i] > 0 then (1::bigint << (32 - i)::int) else 0 end))::bigint hi,
list_sum(list_transform(range(33, 65), lambda i: case when text_cls[i] > 0 then (1::bigint << (64 - i)::int) else 0 end))::bigint lo from entity_cache where text_cls is not null),
c as (select hi, lo, min(cache_id) rep, count(*) members from f group by hi, lo),
p as (select a.rep a, b.rep b, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) distance from c a join c b on a.rep < b.rep)
"""


def _classes(spark, d):
    hi, lo = audit.fingerprint(F.col("text_cls"))
    rows = table(spark, d, "entity_cache").filter("text_cls is not null").select(F.col("cache_id").alias("id"), hi.alias("hi"), lo.alias("lo"))
    return audit.hamming_classes(rows)


@query(FP + "select a, b, distance::int distance from p where distance <= 4")
def hamming_pairs(spark, d):
    c = _classes(spark, d)
    return audit.hamming_join(c, c, 4).filter("a < b").select("a", "b", F.col("distance").cast("int").alias("distance"))


@query(FP + "select rep, members from c where members > 1")
def hamming_members(spark, d):
    return _classes(spark, d).filter("members > 1").select("rep", "members")


@query(FP + "select distance::int distance, count(*) n from p where distance <= 4 group by all")
def hamming_histogram(spark, d):
    c = _classes(spark, d)
    return audit.hamming_join(c, c, 4).filter("a < b").groupBy(F.col("distance").cast("int").alias("distance")).agg(F.count("*").alias("n"))


@query(FP + "select distinct b.rep from c a, c b where a.rep % 100 = 0 and bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 4")
def hamming_blacklist(spark, d):
    c = _classes(spark, d)
    near = audit.hamming_join(c.filter("asks"), c, 4).select(F.col("b").alias("rep")).distinct()
    return c.join(near, "rep", "left_semi").select("rep")


@query(
    f"with {KB}, o as ({_overlap_sql('full_row', audit.KEYS['full_row'])}), g as (select count(*) filter (where coalesce(list_contains(image_list, \"imgPath\"), false)) leaked from mentions join kb on upper(trim(answer)) = qid), "
    "c as (select 'no common row ' || \"left\" || '-' || \"right\" as name, common = 0 passed from o union all select 'no gold image', leaked = 0 from g) select name, passed, (select bool_and(passed) from c) accepted from c"
)
def acceptance_gate(spark, d):
    o = audit.overlaps(mentions(spark, d), "split", audit.KEYS["full_row"])
    checks = o.select(F.concat(F.lit("no common row "), "left", F.lit("-"), "right").alias("name"), (F.col("common") == 0).alias("passed"))
    g = audit.gold_image_leakage(mentions(spark, d), kb(spark, d)).agg((F.sum("leaked") == 0).alias("passed")).select(F.lit("no gold image").alias("name"), "passed")
    return audit.gate(checks.unionByName(g))


@query("select id // 10000 as chunk, sha256('[' || string_agg('{\"id\":' || id || ',\"qid\":\"' || qid || '\"}', ',' order by id) || ']') sha from kb_entity group by all")
def order_hash(spark, d):
    return audit.order_hash(table(spark, d, "kb_entity"), "id", ["id", "qid"])


@query("select split, count(*) as rows, count(distinct id) ids, count(distinct answer) answers from mentions group by split")
def dataset_manifest(spark, d):
    return sanitize.manifest(mentions(spark, d), ["split"])


@query("select count(*) as rows, count(*) - count(distinct id) repeated, max(id) - min(id) + 1 = count(distinct id) and count(*) = count(distinct id) contiguous from kb_entity")
def id_contiguity(spark, d):
    return sanitize.contiguous(table(spark, d, "kb_entity"), "id")


@query("with t as (select count(*) n from crawl_entities), q as (select source, greatest(1, floor(200 * count(*) / (select n from t)))::bigint q from crawl_entities group by source) select crawl_id, c.source from (select *, row_number() over (partition by source order by md5(crawl_id || '-0'), crawl_id) r from crawl_entities) c join q on c.source is not distinct from q.source where r <= q")
def stratified_sample(spark, d):
    return sampling.stratified(table(spark, d, "crawl_entities"), "source", "crawl_id", 200).select("crawl_id", "source")


@query("with s as (select vec_id, embedding[1]::double score from embeddings), m as (select avg(score) m from s) select vec_id from ((select vec_id from s order by score desc, vec_id limit 10) union (select vec_id from s order by score, vec_id limit 10) union (select vec_id from s, m order by abs(score - m), vec_id limit 10))")
def difficulty_sample(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("score"))
    return sampling.by_difficulty(e, "score", "vec_id", 30, "mixed").select("vec_id")


@query("with x as (select row_id, unnest(cands) c from mentions where cands is not null) select row_id, list(c order by h, c) picked from (select *, row_number() over (partition by row_id order by h, c) r from (select row_id, c, md5(c || '-' || row_id || '-0') h from x)) where r <= 3 group by row_id")
def hard_negatives(spark, d):
    m = mentions(spark, d).filter("size(cands) > 0")
    return m.select("row_id", sampling.pick(F.col("cands"), F.col("row_id"), 3).alias("picked"))


@query("with b as (select unnest([2, 4, 8]) bits), s as (select unnest(['symmetric', 'affine']) scheme), r as (select unnest([true, false]) renormalise) select * from b, s, r")
def config_grid(spark, d):
    return sampling.grid(spark, bits=[2, 4, 8], scheme=["symmetric", "affine"], renormalise=[True, False])


@query("with g as (select distinct source grp from crawl_entities) select a.grp left_out, list(b.grp order by b.grp) kept from g a join g b on a.grp <> b.grp group by a.grp")
def layer_ablation(spark, d):
    return sampling.ablations(table(spark, d, "crawl_entities").select(F.col("source").alias("grp")).distinct())


NEIGHBOURS = """with e as (select vec_id, embedding::double[] v, list_transform(embedding::double[], lambda x: round(x * 4) / 4) w from embeddings), q as (select * from e where vec_id % 100 = 0),
s as (select q.vec_id qid, k.vec_id eid, round(list_inner_product(q.v, k.v), 9) s0, round(list_inner_product(q.w, k.w), 9) s1 from q join e k on k.vec_id <> q.vec_id)
"""


def _coarse(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("eid"), vectors.doubles(F.col("embedding")).alias("v"))
    return e, e.withColumn("v", F.transform("v", lambda x: F.round(x * 4) / 4))


@query(NEIGHBOURS + "select qid, count(*) filter (where r0 <= 10 and r1 <= 10) / 10.0::double overlap from (select *, row_number() over (partition by qid order by s0 desc, eid) r0, row_number() over (partition by qid order by s1 desc, eid) r1 from s) group by qid")
def neighbor_overlap(spark, d):
    a, b = (vectors.exact_topk(x.filter("eid % 100 = 0").withColumnRenamed("eid", "qid"), x, 10).select("qid", "eid") for x in _coarse(spark, d))
    return sampling.neighbour_overlap(a, b, 10)


@query(NEIGHBOURS + "select round(corr(s0, s1), 6) correlation, round(avg(abs(s0 - s1)), 6) mae, count(*) n from s")
def pairwise_cosine_corr(spark, d):
    from linkstrata.operators.metrics import corr_of

    a, b = _coarse(spark, d)
    e = a.join(b.withColumnRenamed("v", "w"), "eid")
    m = vectors.paired_moments(e.filter("eid % 100 = 0").withColumnRenamed("eid", "qid"), e)
    return m.select(F.round(corr_of(), 6).alias("correlation"), F.round(F.col("gap") / F.col("n"), 6).alias("mae"), "n")


@query("with e as (select embedding::double[] v, list_transform(embedding::double[], lambda x: round(x * 4) / 4) w from embeddings), c as (select list_inner_product(v, w) / (greatest(sqrt(list_inner_product(v, v)), 1e-12) * greatest(sqrt(list_inner_product(w, w)), 1e-12)) c from e) select round(avg(c), 6) mean, round(quantile_cont(c, 0.1), 6) p10, round(min(c), 6) least from c")
def self_alignment(spark, d):
    e = table(spark, d, "embeddings").select(vectors.doubles(F.col("embedding")).alias("v"))
    e = e.withColumn("w", F.transform("v", lambda x: F.round(x * 4) / 4)).select(vectors.cosine(F.col("v"), F.col("w")).alias("c"))
    return e.agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.percentile("c", 0.1), 6).alias("p10"), F.round(F.min("c"), 6).alias("least"))


@query()
def diverse_sample(spark, d):
    return sampling.diverse(table(spark, d, "embeddings"), "vec_id", "embedding", 20).select("vec_id")


@query()
def image_phash(spark, d):
    e = table(spark, d, "entity_cache").filter("text_cls is not null")
    return audit.phash(e.select("cache_id", F.concat("text_cls", "text_cls").alias("pixels"))).select("cache_id", "phash")
