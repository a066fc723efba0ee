"""Formats, sources, sinks, runs and packing: hand-made cases and the edge cases that their docstrings define."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkstrata.functions import text
from linkstrata.operators import compare, coverage, gold, layers, metrics, quantize, runs, sanitize, vectors
from linkstrata.plans import staging
from linkstrata.sources import paged, records, sinks


def one(spark, kind, rows):
    return spark.createDataFrame(rows, kind)


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def test_formats(spark):
    r = one(spark, "i int, p string", [(1, "/a/./b//c"), (2, "x/../y/./z.png"), (3, "../up"), (4, None), (5, "")]).orderBy("i")
    assert values(r.select(text.resolved(F.col("p"), "/d/s", "/f").alias("x")), "x") == ["/a/b/c", "/d/s/y/z.png", "/d/up", None, "/d/s"]
    assert values(r.select(text.resolved(F.col("p"), "", "/f").alias("x")), "x")[1] == "/f/y/z.png"
    u = one(spark, "t string, u string", [("A b/c", "http://x.org/i.me/pic.JPG"), ("A", "http://x.org/none"), ("A", None), ("B", "http://x.org/.hidden")])
    assert values(u.select(text.file_name(F.col("t"), F.col("u")).alias("x")), "x") == ["A_b_c.JPG", "A", None, "B"]
    w = one(spark, "u string", [("https://en.x.org/wiki/A_b",), ("a/wiki/b/wiki/c",), ("nothing",), (None,)])
    assert values(w.select(text.page_id(F.col("u"), F.lit(7)).alias("x")), "x") == ["A_b", "c", "UNK_7", "UNK_7"]
    n = one(spark, "n bigint", [(0,), (1023,), (1536,), (5 * 1024**3,), (2 * 1024**5,), (None,)])
    assert values(n.select(text.binary_size(F.col("n")).alias("x")), "x") == ["0.0 B", "1023.0 B", "1.5 KiB", "5.0 GiB", "2.0 PiB", "?"]
    assert values(spark.range(1).select(text.percent(F.lit(0.5)).alias("x")), "x") == ["50.00%"]
    labels = one(spark, "a int, b int", [(0, None), (250, 0), (250, 500)])
    got = values(labels.select(text.run_label(F.lit("int4"), F.lit(1000), F.col("a"), F.col("b")).alias("x")), "x")
    assert got == ["int4_chunk_1000", "int4_chunk_1000_entity_tile_250", "int4_chunk_1000_entity_tile_250_tglu_tile_500"]
    c = one(spark, "c array<string>", [(["a", "b"],), ([],), (None,), ([None, "b"],)])
    assert values(c.select(text.first_of(F.col("c"), "-").alias("x")), "x") == ["a", "-", "-", "-"]
    assert values(c.select(text.chosen_image(F.col("c"), F.lit(1), 3).alias("x")), "x")[1:3] == [None, None]
    k = spark.range(1).select(text.sorted_key(b=F.lit(1), a=F.lit(None)).alias("x"), text.sorted_key(a=F.lit(None), b=F.lit(1)).alias("y"), text.joined_key(F.lit("a"), F.lit(1)).alias("z"))
    import hashlib

    x, y, z = k.first()
    assert x == y == hashlib.md5(b'{"a":null,"b":1}').hexdigest() and z == hashlib.md5(b"a_1").hexdigest()
    p = one(spark, "t string, k string, d string, i string", [("A", None, None, "x.PNG"), ("List of A", None, None, "x.png"), ("B", "disambiguation", "", "x.png"), ("B", None, "A Disambiguation page", "x.png"), ("C", None, None, "x.gif"), ("C", None, None, None), (None, None, None, "x.png")])
    assert values(p.select(text.pictured_page(*map(F.col, "tkdi")).alias("x")), "x") == [True] + 6 * [False]


def test_lookup_whatever_its_size(spark, monkeypatch):
    monkeypatch.setattr(staging, "HOT_SHARE", 10)
    rows = one(spark, "i int, k string", [(i, [None, "hot", "a", f"k{i}"][min(i % 6, 3)]) for i in range(300)])
    table = one(spark, "k string, v int", [("hot", 1), ("a", 2), ("k3", 3), ("none", 4)])
    want = sorted((i, {"hot": 1, "a": 2, "k3": 3}.get(k)) for i, k in values(rows, "i", "k"))
    for limit in (100, 0):
        got = staging.lookup(rows, table, "k", limit)
        assert sorted(values(got, "i", "v"), key=lambda x: x[0]) == want
    assert staging.lookup(rows, table.limit(0), "k", 0).count() == 300 and staging.lookup(rows.limit(0), table, "k", 0).count() == 0


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(staging, "HOT_SHARE", 10_000)
    a = one(spark, "k int, x int", [(1, i) for i in range(1200)] + [(2, 1), (3, 2), (None, 5)])
    b = one(spark, "k int, y int", [(1, 7), (1, 8), (2, 9), (4, 1), (None, 6)])
    got = staging.join_salted(a, b, ["k"])
    assert sorted(got.columns) == ["k", "x", "y"] and got.count() == 2401 and got.distinct().count() == 2401


def test_counters_and_new_entities(spark):
    r = one(spark, "g int, s string", [(0, "a"), (9, "a"), (10, "a"), (-1, "b"), (None, "b")])
    assert sorted(values(gold.known_gold(r, "g", 10), "g")) == [0, 9]
    assert sorted(values(gold.counted(r, F.col("g") < 10, ["s"]), "s", "seen", "kept", "skipped")) == [("a", 3, 2, 1), ("b", 2, 1, 1)]
    assert values(gold.counted(r.limit(0), F.col("g") < 10), "seen", "kept") == [(0, 0)]
    e = one(spark, "qid string, entity_name string", [("Q1", "A")])
    m = one(spark, "answer string, mentions string, row_id int", [("q1", "a", 1), (" q2", "late", 5), ("Q2", "first", 2), ("nil", "x", 3), (None, "y", 4)])
    assert sorted(values(gold.with_new_entities(e, m), "qid", "name")) == [("Q1", "A"), ("Q2", "first")]


def test_packing(spark):
    v = [[0.5, -1.0, 0.25, 0.0], [0.0] * 4, None, [1e-9, 0.0, 0.0, -1e-9]]
    r = one(spark, "i int, v array<double>", list(enumerate(v))).orderBy("i")
    got = values(r.select(quantize.packed(F.col("v"), "int8").alias("p")).select("p.q", "p.scale", "p.plain"), "q", "scale", "plain")
    s = float(np.float16(1.0 / 127))
    assert got[0][0] == [int(np.clip(np.rint(x / s), -127, 127)) for x in v[0]] and got[0][1] == s and got[0][2] is None
    assert got[1][0] == [0] * 4 and got[2] == (None, None, None) and got[3][0] == [0] * 4
    back = values(r.select(quantize.unpacked(quantize.packed(F.col("v"), "fp16")).alias("x")), "x")
    assert back[0] == v[0] and back[2] is None
    both = quantize.pack_tensors(r.withColumn("w", F.col("v")), {"v": "int4", "w": "fp32"}).filter("i = 0").first()
    assert both.v.q is not None and both.w.plain == v[0]
    w = one(spark, "layer string, row int, v array<double>", [("a.attn", 0, [1.0, 0.3]), ("a.attn", 1, [0.1, 0.01]), ("b.norm", 0, [0.3, 0.2])])
    q = quantize.quantize_layers(w, "int2", layers.selected(F.col("layer"), ["attn"], []))
    assert sorted(values(q, "row", "v")) == sorted([(0, [1.0, 0.0]), (1, [0.1, 0.0]), (0, [0.3, 0.2])])
    assert values(quantize.layer_counts(q), "layers", "chosen_layers", "parameters", "chosen_parameters") == [(2, 1, 6, 4)]
    assert values(quantize.layer_counts(q.limit(0)), "layers", "chosen_parameters") == [(0, 0)]


def test_outliers_and_straight_through(spark):
    x = [0.1 * i for i in range(-10, 11)] + [40.0]
    df = one(spark, "g int, x double", [(1, v) for v in x] + [(2, 5.0)])
    got = {how: {round(r.x, 3): r.q for r in quantize.with_outliers(df, "x", ["g"], 4, how).filter("g = 1").collect()} for how in ("clip", "absorb", "fp16")}
    m, s = np.mean(x), np.std(x, ddof=1)
    assert got["clip"][40.0] == pytest.approx(m + 3 * s) and got["absorb"][40.0] == pytest.approx(40.0) and got["fp16"][40.0] == 40.0
    assert got["absorb"][1.0] == 0.0 and got["fp16"][1.0] == pytest.approx(1.0)
    assert values(quantize.with_outliers(df.filter("g = 2"), "x", ["g"], 4, "clip"), "q") == [pytest.approx(5.0)]
    with pytest.raises(ValueError):
        quantize.with_outliers(df, "x", ["g"], 4, "drop")
    z = one(spark, "x double", [(0.0,), (0.0,)])
    assert values(quantize.straight_through(z, "x", 4), "q") == [0.0, 0.0] == values(quantize.straight_through(z, "x", 4, False), "q")
    a = values(quantize.straight_through(one(spark, "x double", [(-1.0,), (0.3,), (2.0,)]), "x", 2, False), "q")
    assert a == pytest.approx([-1.0, 0.0, 2.0])


def test_masks_padding_and_loss(spark):
    r = one(spark, "t array<double>, i array<double>", [([1.0, 2.0], [1.0, 2.0, 3.0, 4.0]), (None, [])])
    got = {m: [tuple(x) for x in r.select(*vectors.masked(F.col("t"), F.col("i"), m, 2)).collect()] for m in vectors.MASKS}
    assert got["fused"][0] == ([1, 2], [1, 2, 3, 4]) and got["text"][0] == ([1, 2], [0] * 4) and got["vision"][0] == ([0, 0], [1, 2, 3, 4]) and got["flip"][0] == ([1, 2], [2, 1, 4, 3])
    assert got["flip"][1] == (None, [])
    with pytest.raises(ValueError):
        vectors.masked(F.col("t"), F.col("i"), "sound")
    ids = one(spark, "x array<int>", [([1, 2, 3],), ([7],), ([],), (None,)])
    a, m = vectors.padded(F.col("x"), 2, -1)
    assert values(ids.select(a.alias("a"), m.alias("m")), "a", "m") == [([1, 2], [1, 1]), ([7, -1], [1, 0]), ([-1, -1], [0, 0]), ([-1, -1], [0, 0])]
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4, 2, 3))
    b = one(spark, "id int, batch int, m array<double>, e array<double>, hard array<array<double>>", [(i, i // 2, list(map(float, x[0])), list(map(float, x[1])), [[1.0, 0.0, 0.0]] if i == 3 else None) for i, x in enumerate(v)])
    z = min(500, 100) * np.array([v[3, 0] @ e for e in (v[2, 1], v[3, 1], [1, 0, 0])])
    want = z.max() + math.log(np.exp(z - z.max()).sum()) - z[1]
    assert dict(values(vectors.batch_loss(b, "batch", 500.0, "hard"), "id", "loss"))[3] == pytest.approx(want)


def test_comparisons(spark):
    r = one(spark, "mode string, m double, size bigint", [("fp32", 0.9, 100), ("int4", 0.8, 25), ("int4", 0.7, 20)])
    assert values(compare.find_one(r, mode="int4"), "m") == [0.7]
    with pytest.raises(LookupError):
        compare.find_one(r, mode="int2")
    c = compare.conservative(r, {"mode": "int4", "size": 25}, {"mode": "fp32"}, ["m"], "size").first()
    assert c.m_delta == pytest.approx(-0.1) and c.size_ratio == 4
    t = {x["size"]: x for x in compare.tradeoffs(r, "mode", "fp32", ["m"], "size").collect()}
    assert t[25].m_drop == pytest.approx(0.1) and t[25].saving == 75 and t[20].compression == 5
    d = values(layers.degradation(one(spark, "l string, acc double", [("a", 0.5)]), ["l"], ["acc"], 0.0), "degradation", "relative")
    assert d == [(-0.5, -0.5e8)]
    steps = one(spark, "s int, m double", [(1, 0.9), (2, 0.5), (3, 0.9), (4, 0.5), (5, 0.4), (6, None)])
    got = metrics.degraded(steps, "s", "m", 1.0, 0.2, 2).orderBy("s")
    assert values(got, "bad", "stop") == [(0, False), (1, False), (0, False), (1, False), (2, True), (0, False)]


def test_runs(spark):
    def work(row):
        if row["n"] == 1:
            raise ValueError("bad")
        if row["n"] == 2:
            raise RuntimeError("CUDA out of memory")
        return row["n"]

    got = {r.n: r for r in runs.isolated(spark.range(4).withColumnRenamed("id", "n"), work, "n").collect()}
    assert [got[i].status for i in range(4)] == ["ok", "error", "oom", "ok"] and got[1].message == "ValueError: bad" and got[3].value == 3
    assert runs.timed(lambda: None, repeats=2)["repeats"] == 2
    assert dict(values(runs.environment(spark), "name", "value"))["spark"] == spark.version
    c = one(spark, "version string", [("v1",), ("v1",)])
    assert runs.fresh(c, "v1").count() == 2
    for bad in (c.limit(0), c.unionByName(one(spark, "version string", [("v2",)]))):
        with pytest.raises(ValueError):
            runs.fresh(bad, "v1")
    assert values(runs.prioritised(one(spark, "priority int, seq int", [(1, 1), (5, 2), (5, 1), (None, 0)])), "priority", "seq") == [(5, 1), (5, 2), (1, 1), (None, 0)]


def test_written_and_read_again(spark, tmp_path):
    r = one(spark, "shard int, v array<double>, recall double", [(0, [1.0], 0.5), (1, [2.0], 0.9), (1, [3.0], 0.9)])
    sinks.pretty_json(r.select("shard", "recall"), f"{tmp_path}/r.json")
    sinks.pretty_json(r.select("shard").limit(1), f"{tmp_path}/r.json")
    content = open(f"{tmp_path}/r.json", encoding="utf-8").read()
    assert json.loads(content) == [{"shard": 0}] and content.endswith("]\n") and "\n  " in content and not [f for f in os.listdir(tmp_path) if f.endswith(".tmp")]
    sinks.tradeoff_csv(r.select("shard", "recall"), f"{tmp_path}/c", "recall", "shard")
    assert values(spark.read.option("header", True).csv(f"{tmp_path}/c"), "recall") == ["0.9", "0.9", "0.5"]
    for _ in range(2):
        sinks.append_lines(r.select("shard"), f"{tmp_path}/l")
    assert records.json_line_records(spark, f"{tmp_path}/l", "shard int").count() == 6
    sinks.with_manifest(r, f"{tmp_path}/p", "shard", {"v": "int8"}, "v1")
    got = records.by_manifest(spark, f"{tmp_path}/p", {"v": "int8"}, "v1")
    assert sorted(values(got, "part", "recall")) == [(0, 0.5), (1, 0.9), (1, 0.9)]
    for modes, version in (({"v": "int4"}, "v1"), ({"v": "int8"}, "v2")):
        with pytest.raises(ValueError):
            records.by_manifest(spark, f"{tmp_path}/p", modes, version)
    kept, todo = runs.resumable(spark.read.parquet(f"{tmp_path}/p.manifest"), one(spark, "tensor string, mode string", [("v", "int8"), ("v", "fp16")]), "v1")
    assert values(kept, "mode") == ["int8"] and values(todo, "mode") == ["fp16"]


def test_discovery_and_settings(spark, tmp_path):
    for f in ("x/train.json", "train_small.json", "a/test.json", "b/test.json"):
        os.makedirs(tmp_path / os.path.dirname(f), exist_ok=True)
        (tmp_path / f).write_text("{}")
    found = records.first_matches(spark, str(tmp_path), {s: [f"{s}_small.json", f"{s}.json", f"*/{s}.json"] for s in ("train", "valid", "test")})
    assert {k: v[len(f"file:{tmp_path}/") :] for k, v in found.items()} == {"train": "train_small.json", "test": "a/test.json"}
    assert records.two_level_config("a: 1 # x\nsec:\n  b: 'two'\n\tc: 3\nd: 4\n  e: 5\n\n# only\n") == {"a": "1", "sec": {"b": "two", "c": "3", "e": "5"}, "d": "4"}
    n = coverage.folder_counts(records.inventory(spark, str(tmp_path)), one(spark, "folder string", [("a",), ("gone",)]))
    assert dict(values(n, "folder", "files")) == {"a": 1, "gone": None}
    text_file = tmp_path / "rows.jsonl"
    text_file.write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n[1]\n')
    assert sorted(values(records.json_line_records(spark, str(text_file), "a int"), "a")) == [1, 2]


def test_pages_are_tried_again_and_keys_asked_in_batches(spark):
    calls = []

    def flaky(cursor):
        calls.append(cursor)
        if len(calls) < 3:
            raise OSError("busy")
        return [{"a": 1}], None

    assert paged._patient(flaky, 3, 0.0)(None) == ([{"a": 1}], None) and len(calls) == 3
    with pytest.raises(OSError):
        paged._patient(lambda c: (_ for _ in ()).throw(OSError("down")), 1, 0.0)(None)
    assert paged._rows([{"a": {"b": {"c": 5}}, "d": 1}, {}], ["a.b.c", "d", "a.x"]) == [(5, 1, None), (None, None, None)]

    def fetch(keys):
        assert len(keys) <= 50
        return {k: {"text": "x" * 400, "n": len(k)} for k in keys if k != "gone"}

    r = one(spark, "k string", [(f"k{i}",) for i in range(120)] + [("gone",), (None,), ("k1",)])
    got = {x.k: x for x in paged.looked_up(r, "k", fetch, "text string, n int").collect()}
    assert len(got) == 121 and len(got["k5"].text) == 300 and got["k5"].n == 2 and got["gone"].text is None


def test_image_totals(spark):
    e = one(spark, "id int, answer string, image_list array<string>", [(1, "a", ["x", "y"]), (2, "b", []), (3, None, None)])
    assert values(sanitize.image_total(e), "entities", "images", "without") == [(3, 2, 2)]
    assert values(sanitize.manifest(e.withColumn("s", F.lit(1)), ["s"], "image_list"), "rows", "images") == [(3, 2)]
