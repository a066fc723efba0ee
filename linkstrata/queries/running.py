"""Queries on timings, steps, result rows and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkstrata.operators import compare, gold, metrics
from linkstrata.queries.registry import query, table
from linkstrata.queries.retrieval import rounded


@query("select event_type, round(avg(value), 6) avg_v, round(median(value)::double, 6) p50, round(quantile_cont(value, 0.9)::double, 6) p90, round(quantile_cont(value, 0.95)::double, 6) p95, round(quantile_cont(value, 0.99)::double, 6) p99, round(min(value), 6) min_v, round(max(value), 6) max_v, count(value) n from events group by event_type")
def latency_percentiles(spark, d):
    return rounded(metrics.latency(table(spark, d, "events"), "value", ["event_type"]))


@query("select event_type, count(*) n, round(count(*) / greatest(sum(abs(value)), 1e-12), 6) per_second, round(sum(abs(value)) / sum(sum(abs(value))) over (), 6) share from events group by event_type")
def throughput(spark, d):
    from pyspark.sql import Window

    t = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.abs("value")).alias("t"))
    per = (F.col("n") / F.greatest("t", F.lit(1e-12))).alias("per_second")
    return rounded(t.select("event_type", "n", per, (F.col("t") / F.sum("t").over(Window.partitionBy())).alias("share")))


DAYS = "with s as (select date_trunc('day', ts)::date as day, round(avg(value), 6) m from events group by all)"


def _days(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("m"))


@query(DAYS + ", g as (select *, round(m - lag(m) over (order by day), 6) gain from s) select *, coalesce(sum((coalesce(abs(gain) < 0.05, false))::int) over (order by day), 0) > 0 stopped from g")
def progressive_stop(spark, d):
    return rounded(metrics.progressive(_days(spark, d), "day", "m", 0.05))


@query(
    DAYS
    + ", b as (select *, max(m) over (order by day) best from s), n as (select *, coalesce(best > lag(best) over (order by day), true)::int fresh from b), i as (select *, sum(fresh) over (order by day) island from n), r as (select day, m, best, row_number() over (partition by island order by day) - 1 bad from i) select *, bad >= 3 stop from r"
)
def patience_stop(spark, d):
    return metrics.patience(_days(spark, d), "day", "m", 3)


@query(DAYS + " select day, max(m) over (order by day) best from s")
def best_so_far(spark, d):
    return metrics.patience(_days(spark, d), "day", "m", 3).select("day", "best")


# Runs as groups of the line items: a chunk size and a mode each, with three measures.
VALUES = "with r as (select (l_linenumber * 1000)::int chunk, l_returnflag as mode, round(avg(l_quantity::double), 6) qps, round(avg(l_extendedprice::double), 6) as seconds, count(*)::double as mb from lineitem group by all)"


def _runs(spark, d):
    by = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") * 1000).cast("int").alias("chunk"), F.col("l_returnflag").alias("mode"))
    return rounded(by.agg(F.avg(F.col("l_quantity").cast("double")).alias("qps"), F.avg(F.col("l_extendedprice").cast("double")).alias("seconds"), F.count("*").cast("double").alias("mb")))


@query(VALUES + " select a.chunk, a.mode, round(a.qps - b.qps, 6) qps_delta, round(a.seconds - b.seconds, 6) seconds_delta from r a left join r b on a.chunk = b.chunk and b.mode = 'N'")
def same_chunk_deltas(spark, d):
    return rounded(compare.deltas(_runs(spark, d), F.col("mode") == "N", ["qps", "seconds"], ["chunk"]).select("chunk", "mode", "qps_delta", "seconds_delta"))


@query(VALUES + " select budget, arg_max(chunk, qps) chunk, arg_max(mode, qps) as mode, max(qps) qps from r join (select unnest([100, 300, 3000, 30000]) budget) b on r.mb <= b.budget group by budget")
def budget_table(spark, d):
    b = spark.createDataFrame([(100,), (300,), (3000,), (30000,)], "budget int")
    fits = _runs(spark, d).join(F.broadcast(b), F.col("mb") <= F.col("budget"))
    return fits.groupBy("budget").agg(F.max_by("chunk", "qps").alias("chunk"), F.max_by("mode", "qps").alias("mode"), F.max("qps").alias("qps"))


@query(VALUES + " select chunk, mode, qps, seconds, null::double as mb from r where chunk = 1000 union all select chunk, mode, null, null, mb from r where chunk <> 1000")
def union_by_name(spark, d):
    r = _runs(spark, d)
    return compare.union_rows([r.filter("chunk = 1000").drop("mb"), r.filter("chunk <> 1000").select("chunk", "mode", "mb")])


@query(VALUES + " select chunk, mode, metric, value from r unpivot (value for metric in (qps, seconds, mb))")
def metrics_unpivot(spark, d):
    return compare.tall(_runs(spark, d), ["chunk", "mode"], ["qps", "seconds", "mb"])


@query("select row_id, coalesce(try_cast(substr(id, 2, 4) as double), 0) as number, coalesce(try_cast(trunc(try_cast(substr(id, 2, 4) as double)) as int), 0) as whole from mentions")
def lenient_cast(spark, d):
    s = F.substring("id", 2, 4)
    return table(spark, d, "mentions").select("row_id", compare.lenient(s).alias("number"), compare.lenient(s, "int").alias("whole"))


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) r from events) where r = 1")
def first_seen_dedupe(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return gold.first_seen(e, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id")


@query("select raw_id, json_extract_string(payload, '$.mentions') mentions, json_extract_string(payload, '$.answer') answer from raw_mention where json_valid(payload)")
def raw_records(spark, d):
    from linkstrata.sources.records import parsed

    return parsed(table(spark, d, "raw_mention"), "payload", "mentions string, answer string").select("raw_id", "mentions", "answer")


@query("select split, source, count(*) n from mentions group by rollup (split, source)")
def slice_rollup(spark, d):
    return table(spark, d, "mentions").rollup("split", "source").agg(F.count("*").alias("n"))


@query("select id, count(*) n, min(row_id) row_id from mentions group by id")
def stream_dedupe(spark, d):
    from linkstrata.streaming.ranks import stream_first

    return stream_first(spark, f"{d}/mentions.parquet", ["id"], "row_id")


@query("select split, count(*) n, sum(len(sentence))::bigint chars from mentions group by split")
def stream_batches(spark, d):
    from linkstrata.streaming.ranks import stream_totals

    return stream_totals(spark, f"{d}/mentions.parquet")
