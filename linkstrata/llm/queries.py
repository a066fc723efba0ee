"""The pN_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstrata.llm import graph, leaks, lookalike, mixing, names, refine, splits, subjects, truncation


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_t(spark, d, "crawl_entities"), "crawl_id", "desc", "source").filter("cut").select("crawl_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(_t(spark, d, "crawl_entities"), "crawl_id", "desc", "source")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_overlaps(_t(spark, d, "mentions")).select("id_a", "id_b")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.overlap_report(_t(spark, d, "mentions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    known = _t(spark, d, "kb_entity").select("qid", "entity_name").unionByName(_t(spark, d, "seed_entity").select("qid", "entity_name"))
    return names.link_names(_t(spark, d, "mentions").select("row_id", "mentions", "answer", "cands"), known)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cache = _t(spark, d, "entity_cache")
    return graph.nearest_pairs(cache, "cache_id", ["text_cls", "image_cls"]).select("field", "id_a", "id_b")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return refine.formatting_copies(refine.records(_t(spark, d, "mentions"), _t(spark, d, "raw_mention"))).select("first_id", "copy_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return refine.copy_counts(refine.records(_t(spark, d, "mentions"), _t(spark, d, "raw_mention")))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.twin_report(_t(spark, d, "mentions"), "row_id", ["mentions", "sentence"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.twin_pairs(lookalike.twin_classes(_t(spark, d, "mentions"), "row_id", ["mentions", "sentence"]))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "bench_item"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(_t(spark, d, "documents"), _t(spark, d, "bench_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(_t(spark, d, "documents"), _t(spark, d, "doc_label"), _t(spark, d, "subject_area")).select("doc_id", "subject")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return subjects.area_report(_t(spark, d, "documents"), _t(spark, d, "doc_label"), _t(spark, d, "subject_area"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_t(spark, d, "documents"), _t(spark, d, "mix_target"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(_t(spark, d, "documents"), _t(spark, d, "mix_target"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_report, p3_found, p4_found, p5_found, p5_report, p6_found, p6_report, p7_found, p7_report, p8_mixture, p8_report, p9_found, p9_report)}
_COPIES = """with r as (select row_id id, mentions, sentence, answer, "imgPath" p from mentions union all
select raw_id, json_extract_string(payload, '$.mentions'), json_extract_string(payload, '$.sentence'), json_extract_string(payload, '$.answer'), json_extract_string(payload, '$.imgPath') from raw_mention where json_valid(payload)),
k as (select id, regexp_replace(lower(coalesce(mentions, '')), '[^\\p{L}\\p{M}\\p{N}]+', '', 'g') a, regexp_replace(lower(coalesce(sentence, '')), '[^\\p{L}\\p{M}\\p{N}]+', '', 'g') b,
regexp_replace(lower(coalesce(answer, '')), '[^\\p{L}\\p{M}\\p{N}]+', '', 'g') c, regexp_replace(regexp_replace(lower(trim(coalesce(p, ''))), '[\\\\/]+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g') d from r),
g as (select id, min(id) over (partition by a, b, c, d) first_id from k)"""
SQL: dict[str, str] = {
    "p5_found": f"{_COPIES} select first_id, id as copy_id from g where id > first_id",
    "p5_report": f"{_COPIES} select first_id, count(*) as copies from g group by first_id",
}
