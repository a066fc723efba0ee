"""A third of all rows in one group, bucket or cell; results must be whole and what is held at once bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkstrata.llm import common, graph, leaks, lookalike, mixing, names, splits
from linkstrata.plans import staging
from tests.llm.test_problems import SENT, brute, filler, found, mention, rows


def test_copies_across_splits_are_one_entry(spark):
    data = filler(30) + [mention(i, "Victor Maru", SENT, None, "images/a.jpg", split="train" if i % 2 else "dev") for i in range(40)]
    got = found(splits.split_overlaps(rows(spark, data)), "id_a", "id_b")
    assert got == sorted((i, j) for i in range(40) for j in range(i + 1, 40) if i % 2 != j % 2)


def test_one_wording_with_many_images_never_pairs(spark):
    data = filler(30) + [mention(i, "Victor Maru", SENT, None, f"images/{i}.jpg", split="train" if i % 2 else "test") for i in range(300)]
    assert splits.split_overlaps(rows(spark, data)).count() == 0
    none = data + [mention(900, "Victor Maru", SENT, None, None, split="dev")]
    assert found(splits.split_overlaps(rows(spark, none)), "id_a", "id_b") == [(i, 900) for i in range(1, 300, 2)]


def test_hot_class_of_twins(spark):
    data = filler(60) + [mention(i, "Ann", "peace") for i in range(60)] + [mention(100, "Ann", "peаce")]
    got = found(lookalike.twin_pairs(lookalike.twin_classes(rows(spark, data), "row_id", ["mentions", "sentence"])), "id_a", "id_b")
    assert got == [(i, 100) for i in range(60)]


def test_one_spelling_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(staging, "HOT_SHARE", 10)
    e = spark.createDataFrame([("Q1", "Ursula Tarmelin"), ("Q2", "Ursula Dongorval"), ("Q3", "Walter Pelkrim"), ("Q4", "Walter Sandrovel")], "qid string, entity_name string")
    data = [mention(i, "U. Tarmelin", "s") for i in range(200)] + [mention(1000 + i, f"nobody {i}", "s") for i in range(300)]
    assert found(names.link_names(rows(spark, data), e), "row_id", "qid") == [(i, "Q1") for i in range(200)]


def test_a_third_of_all_vectors_alike(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD", 100)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x[:300] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cache_id bigint, v array<float>")
    got = graph.nearest(df, "cache_id", "v").filter("id < 300").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r.other)
    assert all(sorted(by[i]) == [j for j in range(6) if j != i][:5] for i in range(300))


@pytest.mark.parametrize("most, askers", [(2, 6), (4, 0.2), (10_000, 0.2)])
def test_cells_have_cells_of_their_own(spark, monkeypatch, most, askers):
    """A tree of centres and queries in lots lose little: 3000 vectors with shards of 50 and few centres at once."""
    monkeypatch.setattr(graph, "SHARD", 50)
    monkeypatch.setattr(graph, "MOST_SHARDS", most if most < 100 else 4096)
    monkeypatch.setattr(graph, "ASKERS", askers)
    monkeypatch.setattr(graph, "LOT", 400)
    rng = np.random.default_rng(10)
    centre = rng.normal(size=(90, 24))
    x = (centre[rng.integers(0, 90, 3000)] + 0.3 * rng.normal(size=(3000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cache_id bigint, v array<float>")
    if most == 2:
        monkeypatch.setattr(graph, "MOST_SHARDS", 30)  # two levels of thirty
    want = brute(list(range(3000)), x.astype(float))
    got = set(found(graph.nearest_pairs(df, "cache_id", ["v"]), "id_a", "id_b"))
    assert len(got & want) >= 0.9 * len(want)


def test_many_items_by_shuffle_and_a_small_filter(spark, monkeypatch):
    words = [f"w{i}" for i in range(3000)]
    items = [(i, "s", " ".join(words[i * 40 : i * 40 + 40])) for i in range(60)]
    docs = [(i, " ".join(words[i * 40 : i * 40 + 30])) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, suite string, text string")
    want = [(i, i) for i in range(60)]
    assert found(leaks.leaks(d, b), "doc_id", "item_id") == want
    monkeypatch.setattr(common, "MOST_BITS", 16)
    monkeypatch.setattr(leaks, "SENT_BYTES", 0)
    monkeypatch.setattr(leaks, "CHARS", 100)
    assert found(leaks.leaks(d, b), "doc_id", "item_id") == want


def test_one_phrase_in_all_documents(spark, monkeypatch):
    monkeypatch.setattr(staging, "HOT_SHARE", 10)
    monkeypatch.setattr(leaks, "SEEDS_SENT", 0)
    phrase = "for more about this please see the notes at the end of the page"
    own = lambda i: " ".join(f"x{i}y{j}" for j in range(20))
    items = [(i, f"{own(i)} {phrase}") for i in range(30)]
    docs = [(i, f"{own(i)} {phrase} and more {i}" if i < 20 else f"{phrase} {i}") for i in range(2000)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert found(leaks.leaks(d, b), "doc_id", "item_id") == [(i, i) for i in range(20)]


def test_large_classes_meet_by_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "PART", 7)
    pairs = spark.createDataFrame([("x", "y"), ("x", "z"), ("u", "z")], "class_a string, class_b string")
    a = spark.createDataFrame([(i, "xu"[i % 5 == 0]) for i in range(60)], "a bigint, class_a string")
    b = spark.createDataFrame([(100 + i, "yzw"[i % 3]) for i in range(60)], "b bigint, class_b string")
    want = sorted((i, 100 + j) for i in range(60) for j in range(60) if ("xu"[i % 5 == 0], "yzw"[j % 3]) in {("x", "y"), ("x", "z"), ("u", "z")})
    assert found(common.expand(pairs, a, b), "a", "b") == want


@pytest.mark.parametrize("group", [1000, 3])
def test_mixture_over_many_shards(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 500)
    monkeypatch.setattr(mixing, "GROUP", group)
    d = spark.createDataFrame([(i, f"a text of some words number {i} on the mill", "a" if i < 700 else "b") for i in range(1000)], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeat int")
    m = mixing.mixture(d, t, block=16)
    r = {x.source: x.t for x in m.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("t")).collect()}
    assert r["a"] == pytest.approx(r["b"], rel=0.03)
    assert m.filter("source = 'b'").agg(F.max("times")).first()[0] == 2 and m.count() == m.select("doc_id").distinct().count()
