"""Each operator against brute force, held-out data or hand-made cases, and the edge cases that its docstring defines."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkstrata.llm import common, graph, leaks, linear, lookalike, mixing, names, queries, refine, splits, subjects, truncation

MENTION = "row_id bigint, mentions string, sentence string, answer string, imgPath string, cands array<string>, split string, source string, m string, rec string, key string, n int"
LONG = "Among the long lists " * 20_000


def mention(i, m, s, a=None, p=None, c=None, split="train"):
    return (i, m, s, a, p, c, split, "web", "clash", "clash", "clash", 1)


def rows(spark, data):
    return spark.createDataFrame(data, MENTION)


def found(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# 5 ------------------------------------------------------------------------------------------------


def raw(spark, data):
    return spark.createDataFrame(data, "raw_id bigint, payload string, feed string")


def test_copies_by_hand(spark):
    m = rows(spark, [
        mention(3, "Ann Lee", "She, too, sang.", "Q1", "images/a/b.jpg"),
        mention(1, "ann  lee", "she too\nSANG", " q1 ", "./images//A/b.JPG"),
        mention(2, "Ann Lee", "She too sang", "Q1", "images\\a\\b.jpg"),
        mention(4, "Ann Lee", "She too sang", "Q2", "images/a/b.jpg"),
        mention(5, None, None, None, None), mention(6, "", " ", "", ""), mention(7, None, LONG), mention(8, "", LONG.upper()),
        mention(9, "Lee Ann", "She too sang", "Q1", "images/a/b.jpg"),
    ])
    r = raw(spark, [
        (100, '{"sentence": "She too sang!", "answer":"Q1", "mentions": "Ann Lee", "imgPath":"images/a/b.jpg"}', None),
        (101, '{"sentence": "She too sang!", "answer":"Q1", "mentions": "Ann L', "x"), (102, None, None), (103, "[]", None), (104, "", None),
    ])
    got = found(refine.formatting_copies(refine.records(m, r)), "first_id", "copy_id", "copies")
    assert got == [(1, 2, 4), (1, 3, 4), (1, 100, 4), (5, 6, 2), (7, 8, 2)]
    assert refine.formatting_copies(refine.records(m.limit(0), r.limit(0))).count() == 0


def test_copies_on_data(spark, small):
    m, r = spark.read.parquet(f"{small}/mentions.parquet"), spark.read.parquet(f"{small}/raw_mention.parquet")
    strip = lambda s: re.sub(r"[\W_]+", "", (s or "").lower())
    path = lambda p: re.sub(r"(^|/)(\./)+", r"\1", re.sub(r"[\\/]+", "/", (p or "").strip().lower()))
    groups = {}
    for x in refine.records(m, r).collect():
        groups.setdefault((strip(x.mentions), strip(x.sentence), strip(x.answer), path(x.imgPath)), []).append(x.id)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert found(queries.p5_found(spark, small), "first_id", "copy_id") == want and want


def test_hot_group_of_copies(spark):
    data = [mention(i, "Ann", "hot", "Q1") for i in range(3000)] + [mention(i, f"m{i}", f"s{i}") for i in range(3000, 6000)]
    got = found(refine.formatting_copies(refine.records(rows(spark, data), raw(spark, []))), "first_id", "copy_id")
    assert got == [(0, i) for i in range(1, 3000)]


# 6 ------------------------------------------------------------------------------------------------


def pairs(spark, data):
    return found(lookalike.twin_pairs(lookalike.twin_classes(rows(spark, data), "row_id", ["mentions", "sentence"])), "id_a", "id_b")


def test_twins(spark):
    plain = "Peace came to the Ottoman copse"
    base = [mention(i, "Ann Copse", f"{plain} {i}.") for i in range(100, 130)]
    same = [
        mention(1, "Ann Copse", plain), mention(2, "Ann Copse", plain.replace("e", "е")), mention(3, "Ａｎｎ　Ｃｏｐｓｅ", plain), mention(4, "Ann Co​pse", plain.replace(" ", " ")),
        mention(5, "Ann\tCopse", " " + plain.replace(" ", "  ")),
    ]
    other = [
        mention(10, "Ann Copse", plain.upper()), mention(11, "Ann Copse", plain + "."), mention(12, "Änn Copse", plain), mention(13, None, plain), mention(14, "Ann Copse", None),
        mention(15, "Ann Copse²", plain), mention(16, "Ann Copse2", plain),
    ]
    want = sorted(p for p in itertools.combinations(range(1, 6), 2) if p != (1, 5))
    assert pairs(spark, base + same + other) == want
    assert pairs(spark, []) == []


def test_twins_accents_and_scripts(spark):
    accents = [mention(1, "Café", "x"), mention(2, "Café", "x"), mention(3, "Cafe", "x"), mention(4, "ﬁx", "y"), mention(5, "fix", "y"), mention(6, "озеро", "z"), mention(7, "oзepo", "z"), mention(8, LONG, ""), mention(9, LONG.replace("o", "о"), "")]
    assert pairs(spark, accents) == [(1, 2), (4, 5), (6, 7), (8, 9)]


def test_viterbi_keeps_scripts_and_depends_on_looks_alone():
    words = ["озеро", "город", "река", "лес"] * 5 + ["river", "town", "copse", "house", "peace"] * 20
    counts = {}
    for w in words:
        s = lookalike.script(w[0])
        for a, b in zip("^" + w, w):
            counts[s, a, b] = counts.get((s, a, b), 0) + 1
    r = lookalike.Resolver(counts)
    assert r.token("oзepo") == "озеро" and r.token("pеасе") == "peace" and r.token("lακε") != "lake"
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("абвгдежзиaceopxyзйклABCEHk") for _ in range(rng.randint(1, 7)))
        v = "".join(rng.choice(lookalike.CLASSES.get(c, (c,))) for c in w)
        assert r.token(w) == r.token(v)
        assert len(r.token(w)) == len(w) and all(x in lookalike.CLASSES.get(y, (y,)) for x, y in zip(r.token(w), w))


def test_confusable_letters_of_the_public_table(spark):
    c = lookalike.confusable(spark)
    for a, b in zip("ASoouhnWIIlBH", "ᎪՏօοսհոᎳІΙӏΒН"):
        assert b in c[a] and c[a] == c[b] and c[a][0] == a, (a, b)
    assert all(sum(x < "\x80" for x in g) <= 1 for g in c.values()) and "I" not in c["l"] and set(lookalike.CLASSES) <= set(c)
    data = [mention(1, "Hous", "x"), mention(2, "Ηօսs", "x"), mention(3, "ՍՊԸ ՏԱՐ", "y"), mention(4, "ՍՊԸ SԱՐ", "y")]
    assert pairs(spark, data) == [(1, 2), (3, 4)]


def test_scores_decide_what_latin_cannot_spell():
    """A token with a letter of two alphabets on each side: the alphabet whose letter pairs it has wins."""
    counts = {}
    for w, n in (("роса", 50), ("гора", 50), ("ορος", 5), ("πορος", 5)):
        for a, b in zip("^" + w, w):
            counts[lookalike.script(w[0]), a, b] = counts.get((lookalike.script(w[0]), a, b), 0) + n
    both = {"Г": ("Г", "Γ"), "Γ": ("Г", "Γ"), "п": ("п", "π"), "π": ("п", "π"), **{k: v for k, v in lookalike.CLASSES.items() if k in "оοoрρp"}}
    r = lookalike.Resolver(counts, classes=both)
    assert r.token("пoρος") == r.token("πορoς") == "πορος"
    flipped = lookalike.Resolver({("C", a, b): n for (_, a, b), n in counts.items()} | {("C", "^", "п"): 90, ("C", "п", "о"): 90, ("C", "о", "р"): 90}, classes=both)
    assert flipped.token("πoρ") == "пор" and r.token("πoρ") == "πορ"


def test_twin_report_has_one_row_a_record(spark):
    data = filler(30) + [mention(i, "Ann", "peace") for i in range(5)] + [mention(100, "Ann", "peаce"), mention(101, None, "x")]
    got = lookalike.twin_report(rows(spark, data), "row_id", ["mentions", "sentence"]).collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4, 100] and {(r.variants, r.records) for r in got} == {(2, 6)}


# 2 ------------------------------------------------------------------------------------------------

SENT = "With help from Anna Bell the clinic measured 415 parts of the spectrum near Harrow and left the thermal solvent to Victor Maru in January 1988 before the rain came"


def overlap(spark, data):
    return found(splits.split_overlaps(rows(spark, data)), "id_a", "id_b")


def filler(n=60):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    return [mention(1000 + i, f"{word()} {word()}", " ".join(word() for _ in range(25)), split=("train", "dev", "test")[i % 3]) for i in range(n)]


def test_overlaps_by_hand(spark):
    changed = SENT.split()
    changed[4:6], changed[20] = ["Lena", "Wolf"], "February"
    far = SENT.split()
    for i in range(0, len(far), 4):
        far[i] = f"other{i}"
    data = [
        mention(1, "Victor Maru", SENT, None, "images/a.jpg"),
        mention(2, "victor maru!", SENT.upper().replace(" ", "  "), None, "./images//a.JPG", split="dev"),
        mention(3, "Victor Maruu", " ".join(changed), None, None, split="test"),
        mention(4, "Ann Lee", SENT, None, "images/a.jpg", split="test"), mention(5, "Victor Maru", SENT, None, "images/b.jpg", split="test"),
        mention(6, "Victor Maru", " ".join(far), None, "images/a.jpg", split="test"), mention(7, "Victor Maru", SENT, None, "images/a.jpg"),
        mention(8, None, None, split="dev"), mention(9, "Victor Maru", "", split="dev"), mention(10, "Victor Maru", LONG, split="test"), mention(11, "Victor Maru", LONG), mention(12, "", "", split=None),
    ]
    assert overlap(spark, filler() + data) == [(1, 2), (1, 3), (2, 7), (3, 7), (10, 11)]
    assert overlap(spark, []) == []
    report = splits.overlap_report(rows(spark, filler() + data)).collect()
    assert {(r.split, r.source): r.pairs for r in report} == {("dev", "web"): 2, ("test", "web"): 3}


def test_overlap_on_data(spark, small):
    data = spark.read.parquet(f"{small}/mentions.parquet").collect()
    word = lambda s: re.sub(r"[^\w]+|_", " ", (s or "").replace("&amp;", "&").lower()).split()
    file = lambda p: re.split(r"[\\/]+", (p or "").strip().lower())[-1]
    want = []
    for a, b in itertools.combinations(data, 2):
        if (a.split == "train") != (b.split == "train") and (file(a.imgPath) == file(b.imgPath) or not file(a.imgPath) or not file(b.imgPath)):
            x, y = "".join(word(a.mentions)), "".join(word(b.mentions))
            if splits.slips(x, y, splits.may_slip(x, y)) <= splits.may_slip(x, y):
                s, t = word(a.sentence), word(b.sentence)
                if splits.in_order(s, t) >= 0.8 * max(len(s), len(t)):
                    want.append((min(a.row_id, b.row_id), max(a.row_id, b.row_id)))
    assert found(queries.p2_found(spark, small), "id_a", "id_b") == sorted(want) and want


def test_overlap_of_common_words_but_one(spark):
    changed = SENT.split()
    changed[3] = "zarmolin"
    data = [mention(i, "Victor Maru", SENT) for i in range(20)] + [mention(50, "Victor Maru", " ".join(changed), split="dev")]
    assert overlap(spark, filler(400) + data) == [(i, 50) for i in range(20)]


SLIPPED = [("smith", "smyth"), ("Bronolilterhan", "Brxnolilterhxn"), ("abcdefghij", "abcdfeghij"), ("Kolrildilkam", "Kolxildilkaxm"), ("Maru", "Mrau")]


@pytest.mark.parametrize("meet", [256, 0])
def test_overlap_whatever_slips(spark, monkeypatch, meet):
    monkeypatch.setattr(splits, "MEET", meet)
    data = [mention(2 * i + j, m, SENT, split=("train", "test")[j]) for i, p in enumerate(SLIPPED) for j, m in enumerate(p)]
    assert overlap(spark, filler() + data) == [(2 * i, 2 * i + 1) for i in range(len(SLIPPED))]


def test_slips_at_every_position(spark):
    """A letter replaced, left out, doubled or swapped at every place of mentions of 4 to 20 letters, each with a sentence of its own and a word of it changed."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("bdfgklmnprstaeiou") for _ in range(n))
    data, want = filler(), []
    for n in range(4, 21):
        for i in range(n):
            m = word(n)
            for x in (m[:i] + "z" + m[i + 1 :], m[:i] + m[i + 1 :], m[:i] + m[i] + m[i:], m[: max(i - 1, 0)] + m[max(i - 1, 0) : i + 1][::-1] + m[i + 1 :]):
                if len(x) < 4:
                    continue
                s = [word(5) for _ in range(18)]
                t = list(s)
                t[rng.randrange(18)] = word(6)
                a = 10_000 + 2 * len(want)
                data += [mention(a, m, " ".join(s)), mention(a + 1, x, " ".join(t), split="test")]
                want.append((a, a + 1))
    got = set(overlap(spark, data))
    assert len(got & set(want)) >= 0.99 * len(want) and got <= set(want)


def test_parted_keys_survive_all_slips():
    rng = random.Random(5)
    for _ in range(3000):
        a = [rng.choice("abcdefghijklmnop\u00e9\u0436") for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + 2] = rng.choice([b[i : i + 2][::-1], ["q"] + b[i : i + 2], b[i + 1 : i + 2], ["z"] + b[i + 1 : i + 2]])
        a, b = "".join(a), "".join(b)
        k = splits.may_slip(a, b)
        if splits.slips(a, b, k) > k:
            continue
        x, y = ([splits.letters(m) for m in (a, b)], [len(a), len(b)])
        assert bin((x[0] ^ x[1]) & (1 << 64) - 1).count("1") <= 2 * k
        keys, at = splits.parted(np.array([7, 7], np.int64), np.array(x, np.int64), np.array(y, np.int32))
        assert set(keys[at == 0]) & set(keys[at == 1])


def test_slips_and_order():
    assert [splits.slips("maru", x, 2) for x in ("maru", "amru", "mar", "marru", "nara", "bella")] == [0, 1, 1, 1, 2, 3]
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = max(k for k in range(len(a) + 1) if any(all(c in it for c in x) for x in itertools.combinations(a, k) for it in [iter(b)]))
        assert splits.in_order(a, b) == best


# 3 ------------------------------------------------------------------------------------------------

ENTITIES = [
    ("Q1", "Alexander R. Helvetril"), ("Q2", "Zorbital%20Steel%20Works"), ("Q3", "Ursula_Beharforful"), ("Q4", "Francis Beharforful"), ("Q5", "Mount Krinfonran"),
    ("Q6", "University of Kelmorin"), ("Q7", None), (None, "Nobody Nowhere"), ("Q8", "Walter Zinnerdink"), ("Q9", "Michael Zunfarta"), ("Q10", "Alexander Tormalvin"), ("Q11", "Alexander Gundelbar"),
    ("Q12", "Korvelda Department of Health"), ("Q13", "Walter Pormingal"), ("Q14", "Boldrenga Steel Works"),
    *((f"Q{50 + i}", f"{a} {b}") for i, (a, b) in enumerate(itertools.product(("Ursula", "Francis", "Michael", "Mount", "University of"), ("Tarmelin", "Dongorval", "Pelkrim")))),
    ("Q90", "Tulmarven Department of Health"), ("Q91", "Fengaldur Department of Health"), ("Q92", "Rombelstan Department of Health"),
]
SPELLINGS = {
    "Alexander R. Helvetril": "Q1", "A. Helvétril": "Q1", "HELVETRIL Alexander": "Q1", "Helvetril, Sasha": "Q1", "Alexnder Helvetrril": "Q1", "Dr Alexander Helvetril": "Q1",
    "Zorbital Stl Wks": "Q2", "Zorbital SW": "Q2", "zorbital, steel works": "Q2", "F. Beharforful": "Q4", "Ursula Beharforfull": "Q3", "Krinfonran": "Q5", "Mоunt Krinfonran": "Q5",
    "Ｋｅｌｍｏｒｉｎ Ｕ": "Q6", "Univ. of Kelmorin": "Q6", "Zinnerdink, W.": "Q8", "Korvelda DH": "Q12",
    "Sasha Gondolarvo": None, "": None, "  ": None, "Beharforful": None, "Steel Works": None, "Olga Zinnerdink": None,
}


def test_names(spark):
    linked = [mention(500, "Sasha Tormalvin", "s", "Q10"), mention(501, "Sasha Gundelbar", "s", "q11 "), mention(502, "x", "s", "nil"), mention(503, None, "s")]
    data = [mention(i, m, "s") for i, m in enumerate(SPELLINGS)] + linked + [mention(600, "Beharforful", "s", c=["Q3", "Q9"]), mention(601, LONG, "s")]
    e = spark.createDataFrame([(*x, "clash", 1) for x in ENTITIES], "qid string, entity_name string, mentions string, n int")
    got = dict(found(names.link_names(rows(spark, data), e), "row_id", "qid"))
    want = {i: q for i, q in enumerate(SPELLINGS.values()) if q} | {600: "Q3"}
    assert got == want
    assert names.link_names(rows(spark, []), e).count() == 0
    assert names.link_names(rows(spark, data), e.limit(0)).count() == 0


def test_names_on_hidden_answers(spark):
    at = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{at}/kb_entity.parquet", f"{at}/seed_entity.parquet").select("qid", "entity_name")
    m = spark.read.parquet(f"{at}/mentions.parquet").withColumn("truth", F.upper(F.trim("answer")))
    m = m.withColumn("hide", (F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0) | (F.col("truth") == "NIL")).withColumn("answer", F.expr("if(hide, null, answer)"))
    truth = {r.row_id: r.truth for r in m.filter("hide and truth is not null").select("row_id", "truth").collect()}
    got = {i: q for i, q in found(names.link_names(m, e), "row_id", "qid") if i in truth}
    right = sum(truth[i] == q for i, q in got.items())
    assert right >= 0.97 * sum(q != "NIL" for q in truth.values()) and right >= 0.98 * len(got)


def test_short_words_and_two_slips_anywhere(spark):
    names_ = ["Martin Xu", "Bo Li", "Alexander Helvetril", "Martin Dongorval", "Bo Tarmelin", "Walter Li", "Alexander Pelkrim", "Ursula Zinnerdink", "Ursula Pormingal"]
    e = spark.createDataFrame([(f"Q{i}", n) for i, n in enumerate(names_)], "qid string, entity_name string")
    asks = ["Martin Xu", "Bo Li", "Alexander Hekvetrul", "Martin Xus", "Martin Xa", "Ursula Zimnerdunk", "Ursula Zimnxrdunq"]
    got = found(names.link_names(rows(spark, [mention(i, m, "s") for i, m in enumerate(asks)]), e), "row_id", "qid")
    assert got == [(0, "Q0"), (1, "Q1"), (2, "Q2"), (5, "Q7"), (6, "Q7")]


def test_merged_initials_and_aliases_make_profiles_richer(spark):
    names_ = ["Alexander Helvetril", "Martin Dongorval", "Alexander Tormalvin", "Alexander Gundelbar", "Alexander Pelkrim", "Ursula Zinnerdink"]
    e = spark.createDataFrame([(f"Q{i}", n) for i, n in enumerate(names_)], "qid string, entity_name string")
    linked = [mention(100, "A. R. Helvetril", "s", "Q0"), mention(101, "Sasha Tormalvin", "s", "Q2"), mention(102, "Sasha Gundelbar", "s", "Q3")]
    asks = [mention(0, "R. Helvetril", "s"), mention(1, "R. Dongorval", "s"), mention(2, "Sasha Pelkrim", "s"), mention(3, "Sasha Zinnerdink", "s")]
    assert found(names.link_names(rows(spark, linked + asks), e), "row_id", "qid") == [(0, "Q0"), (2, "Q4")]


def test_short_names_of_any_script(spark):
    e = spark.createDataFrame([("Q1", "Li Na"), ("Q2", "王伟"), ("Q3", "Bo Ek"), ("Q4", "Иван Ли"), ("Q5", "李娜 王")], "qid string, entity_name string")
    asks = ["Li Na", "王伟", "li na", "Иван Ли", "王", "Bo", "Na Li"]
    got = dict(found(names.link_names(rows(spark, [mention(i, m, "s") for i, m in enumerate(asks)]), e), "row_id", "qid"))
    assert got[0] == got[2] == got[6] == "Q1" and got[1] == "Q2" and got[3] == "Q4"


# 4 ------------------------------------------------------------------------------------------------


def brute(ids, x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k] if j != i and s[i, j] > -9}


def test_nearest_small_is_exact_with_copies_ties_and_unusable(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(60, 8)), 3).astype(np.float32)
    x[20:32] = x[3]
    x[40] = 4 * x[41]
    data = [(i + 1, [float(v) for v in r], "clash") for i, r in enumerate(x)]
    bad = [(900, None, "c"), (901, [0.0] * 8, "c"), (902, [float("nan")] * 8, "c"), (903, [1.0, 2.0], "c"), (904, [], "c"), (None, [1.0] * 8, "c")]
    df = spark.createDataFrame(data + bad, "cache_id bigint, v array<float>, node string")
    got = set(found(graph.nearest_pairs(df, "cache_id", ["v"]), "id_a", "id_b"))
    assert got == brute([i + 1 for i in range(60)], x.astype(float))
    assert graph.nearest_pairs(df.limit(0), "cache_id", ["v"]).count() == 0
    assert graph.nearest_pairs(df.filter("cache_id in (900, 901)"), "cache_id", ["v"]).count() == 0
    assert graph.nearest_pairs(df.filter("cache_id = 1"), "cache_id", ["v"]).count() == 0


def test_nearest_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD", 250)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(60, 24))
    x = (centre[rng.integers(0, 60, 2000)] + 0.35 * rng.normal(size=(2000, 24))).astype(np.float32)
    x[:650] = centre[0] + 0.35 * rng.normal(size=(650, 24))  # a third of all in one dense region
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cache_id bigint, v array<float>")
    want = brute(list(range(2000)), x.astype(float))
    got = set(found(graph.nearest_pairs(df, "cache_id", ["v"]), "id_a", "id_b"))
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("k", [1, 10, 20])
def test_nearest_follows_k(spark, k):
    x = np.random.default_rng(6).normal(size=(400, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cache_id bigint, v array<float>")
    want = brute(list(range(400)), x.astype(float), k)
    assert len(set(found(graph.nearest_pairs(df, "cache_id", ["v"], k), "id_a", "id_b")) & want) >= 0.97 * len(want)


def test_many_cells_part_few_neighbours(spark, monkeypatch):
    """Groups of eight in 150 cells of 20, which have many borders."""
    monkeypatch.setattr(graph, "SHARD", 20)
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(375, 64))
    x = (np.repeat(centre, 8, axis=0) + 0.8 * rng.normal(size=(3000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cache_id bigint, v array<float>")
    want = brute(list(range(3000)), x.astype(float))
    assert len(set(found(graph.nearest_pairs(df, "cache_id", ["v"]), "id_a", "id_b")) & want) >= 0.97 * len(want)


def test_pack_is_lossless():
    v = np.random.default_rng(1).normal(size=(7, 13)).astype(np.float32)
    assert (graph.unpack(graph.pack(v)) == v).all()


# 1 ------------------------------------------------------------------------------------------------


def test_truncation_of_new_cuts(spark):
    at = "/root/testdata/sf0.01"
    c = spark.read.parquet(f"{at}/crawl_entities.parquet")
    model = truncation.fit(c, "desc", "source")
    whole = [(r.desc, r.source) for r in c.filter("source = 'enwiki_extract' and desc rlike '[a-z]{3}\\\\.$'").collect()]
    rng = random.Random(99)
    cuts = [(t[: rng.randrange(20, len(t) - 3)], s) for t, s in whole]
    cuts = [x for x in cuts if not x[0].rstrip().endswith(".")]
    hit = (model.odds(*map(list, zip(*cuts))) > 0).mean()
    false = (model.odds(*map(list, zip(*whole))) > 0).mean()
    assert hit > 0.97 and false < 0.02


def test_truncation_edges(spark):
    kind = "crawl_id bigint, desc string, source string, odds double, t string"
    data = [(i, f"The mill of Harrow was built in {1700 + i}. It stands near the river and is open to all.", "a", 1.0, "clash") for i in range(40)]
    data += [(100, None, "a", None, None), (101, "", None, None, None), (102, "  \n", "a", None, None), (103, LONG, None, None, None), (104, "The mill of Harrow was built in 1800 and it", "a", None, None), (105, "The mill of Harrow was built i…", None, None, None)]
    df = spark.createDataFrame(data, kind)
    got = {r.crawl_id: r.cut for r in truncation.truncated(df, "crawl_id", "desc", "source").collect()}
    assert set(got) == {*range(40), 103, 104, 105} and got[104] and not any(got[i] for i in range(40))
    report = {r.source: r["rows"] for r in truncation.truncation_report(df, "crawl_id", "desc", "source").collect()}
    assert report == {"a": 43, None: 3}
    assert truncation.truncated(df.limit(0), "crawl_id", "desc", "source").count() == 0


# 7 ------------------------------------------------------------------------------------------------


def test_every_stretch_has_a_seed():
    """However one word in seven is replaced in 9 to 34 words, some mask reads agreeing words only; short items are sought by runs."""
    for n in range(1, 35):
        masks = [(leaks.MASKS + leaks.SHORT_MASKS)[m] for m in leaks.masks_of(2 * n)]
        for wrong in itertools.combinations(range(n), n // 7):
            bad = set(wrong)
            assert any(all(bit == "0" or at + i not in bad for i, bit in enumerate(mask)) for mask in masks for at in range(n - len(mask) + 1)), (n, wrong)


def test_filter_has_no_false_negative():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    bits = np.zeros(1 << 13, np.uint8)
    for at in common.Filter.places(h[:1000], np.uint64((1 << 16) - 1)):
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    f = common.Filter(bits)
    assert f.has(h[:1000]).all() and f.has(h[1000:]).mean() < 0.01


def test_leaks_of_short_items_and_repeated_words(spark):
    """Items of 1 to 40 words against a search of every stretch; texts of one word over and over."""
    rng = random.Random(9)
    vocab = [f"{a}{b}" for a in "bdgk" for b in ("ar", "el", "ik", "om", "un")]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 7, 9, 12, 13, 15, 16, 17, 18, 21, 30, 40])]
    items += [(50, "ho " * 30), (51, "ha hum " * 20), (52, "-")]
    docs = []
    for i, t in items:
        for k in range(6):
            ws = t.split()
            ws = ws[: max(1, len(ws) * (6 - k) // 6)]
            for j in rng.sample(range(len(ws)), min(len(ws), k % 3)):
                ws[j] = "other"
            docs.append((len(docs), "lead words here " + " ".join(ws) + " and then the rest"))
    docs += [(900, "ho " * 500), (901, "ho " * 10), (902, "ha hum " * 300)]
    want = set()
    for i, t in items:
        own = leaks.words(t)
        for d, x in docs:
            w = leaks.words(x)
            for shift in range(-len(own), len(w)):
                lo, hi = max(0, -shift), min(len(own), len(w) - shift)
                if hi > lo and own and leaks.covered(np.array([own[j] == w[j + shift] for j in range(lo, hi)], bool), -(-len(own) // 2)):
                    want.add((d, i))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert set(found(leaks.leaks(d, b), "doc_id", "item_id")) == want


def test_covered_is_the_definition():
    rng = random.Random(6)
    for _ in range(300):
        same = np.array([rng.random() < 0.8 for _ in range(rng.randint(0, 25))], bool)
        least = rng.randint(1, 12)
        want = any(7 * (j - i - same[i:j].sum()) <= j - i for i in range(len(same)) for j in range(i + least, len(same) + 1))
        assert leaks.covered(same, least) == want


def test_many_at_once_are_covered_as_one(spark):
    rng = np.random.default_rng(7)
    parts, codes, lo, n, want = [], [], [], [], []
    for _ in range(400):
        own = rng.integers(0, 9, rng.integers(1, 60)).astype(np.uint32)
        a = int(rng.integers(0, len(own)))
        part = own[a : a + int(rng.integers(1, len(own) - a + 1))].copy()
        part[rng.random(len(part)) < 0.14] = 77
        parts, codes, lo, n = parts + [part.tobytes()], codes + [own.tobytes()], lo + [a], n + [len(own)]
        want.append(leaks.covered(own[a : a + len(part)] == part, -(-len(own) // 2)))
    assert leaks.cover(parts, codes, np.array(lo), np.array(n)).tolist() == want and any(want) and not all(want)


def test_leaks(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    item = [rng.choice(vocab) for _ in range(60)]
    other = [rng.choice(vocab) for _ in range(60)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    half = item[10:42]
    for i in (3, 9, 17, 26):
        half[i] = "changed"
    less = item[10:32]
    docs = [
        (1, " ".join(text(50) + item + text(20))), (2, "<p>" + "<br/>\n".join(w.upper() + "," for w in text(9) + half + text(9)) + "</p>"), (3, " ".join(text(30) + less + text(30))),
        (4, None), (5, ""), (6, " ".join(text(5000) + item)), (7, " ".join(item[::2] + text(9))), (8, " ".join(other[:30] + item[:40])), (9, " ".join(item)),
    ]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame([(1, "s", " ".join(item)), (2, "s", " ".join(other)), (3, None, None), (4, "t", ""), (5, "t", " ".join(item))], "item_id bigint, suite string, text string")
    want = sorted([(x, i) for x in (1, 2, 6, 8, 9) for i in (1, 5)] + [(8, 2)])
    assert found(leaks.leaks(d, b), "doc_id", "item_id") == want
    assert leaks.leaks(d.limit(0), b).count() == 0 and leaks.leaks(d, b.limit(0)).count() == 0
    assert {(r.suite, r["items"], r.leaked) for r in leaks.leak_report(d, b).collect()} == {("s", 2, 2), ("t", 2, 1), (None, 1, 0)}


# 8 ------------------------------------------------------------------------------------------------


def test_sainte_lague_is_highest_quotients():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 8)
        w, c, s = [rng.choice([0, 1, 2, rng.random()]) for _ in range(n)], [rng.randint(0, 40) for _ in range(n)], rng.randint(0, 150)
        got = [0] * n
        for _ in range(min(s, sum(x for x, y in zip(c, w) if y > 0))):
            got[max((i for i in range(n) if got[i] < c[i] and w[i] > 0), key=lambda i: (w[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.sainte_lague(w, s, c) == got


def test_tokens_are_the_tokenizers(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.text] + ["a" * 9999, "x" + " " * 5000 + "y  z", "x" + "\n" * 3000 + "y", " " * 2000, "<|endoftext|> hi", "", LONG]
    assert [mixing.n_tokens(x) for x in texts] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_mixture(spark, small):
    d = spark.createDataFrame([(i, f"word number {i} of a longer text about mills " * (1 + i % 5), ["a", "B-x ", "b_x", None][i % 4], "clash") for i in range(400)] + [(900, None, "a", "c"), (901, "", "a", "c"), (902, LONG, "zz", "c")], "doc_id bigint, text string, source string, tokens string")
    t = spark.createDataFrame([("a", 0.7, 3), ("b x", 0.2, 1), ("none", 0.1, 2)], "source string, target_share double, max_repeat int")
    r = {x.source: x for x in mixing.mix_report(d, t).collect()}
    assert abs(r["a"].reached_share - 7 / 9) < 0.02 and abs(r["b_x"].reached_share - 2 / 9) < 0.02 and r["none"].tokens == 0
    assert r["a"].most_times <= 3 and r["b_x"].most_times == 1
    a, b = (found(mixing.mixture(d, t), "doc_id", "times") for _ in range(2))
    assert a == b and not {900, 901, 902} & {x for x, _ in a}
    assert found(mixing.mixture(d, t, seed=7), "doc_id", "times") != a
    assert mixing.mixture(d.limit(0), t).count() == 0 and mixing.mixture(d, t.limit(0)).count() == 0


# 9 ------------------------------------------------------------------------------------------------


def test_areas_on_held_out_labels(spark):
    """A fifth of the labels held out, which are noisy and do not name all areas: English as the labels allow, the languages with some 50 labelled documents less."""
    at = "/root/testdata/sf0.1"
    d, l, s = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "doc_label", "subject_area"))
    l = l.filter("subject is not null")
    held = {r.doc_id for r in l.filter("pmod(xxhash64(doc_id), 5) = 0").select("doc_id").collect()}
    model = subjects.fit(d, l.filter("pmod(xxhash64(doc_id), 5) <> 0"), s)
    text = {r.doc_id: (r.text, (r.lang or "").lower()) for r in d.filter(F.col("doc_id").isin(*held)).collect()}
    share, _ = model.shares([t for t, _ in text.values()])
    got = {(i, model.names[c]) for i, row in zip(text, share) for c in np.flatnonzero(row >= model.least - 1e-9)}
    want = {(r.doc_id, re.sub(r"\W", "", r.subject.lower())) for r in l.collect() if r.doc_id in text}
    of = lambda pairs, *lang: {x for x in pairs if text[x[0]][1] in lang}
    hit = lambda *lang: len(of(got & want, *lang))
    assert hit("en") >= 0.9 * len(of(want, "en")) and hit("en") >= 0.9 * len(of(got, "en"))
    assert hit("de", "fr") >= 0.4 * len(of(want, "de", "fr")) and hit("de", "fr") >= 0.9 * len(of(got, "de", "fr"))


def test_thresholds_are_those_of_the_labels():
    """Documents of ten sentences, of which the first area's is present from three sentences on, the second's from one on."""
    rng = np.random.default_rng(3)
    owners, odds, truth = [], [], []
    for d in range(400):
        n = rng.integers(0, 5, 2)
        owners.append(np.arange(10 * d, 10 * d + 10))
        odds += [[2.0 if i < n[c] else -2.0 for c in range(2)] for i in range(10)]
        truth.append([n[0] >= 2, n[1] >= 1])
    o, s = subjects.thresholds(np.array(odds), owners, np.array(truth))
    assert 0.1 < s[0] <= 0.2 and s[1] == 0.1 and (o == 0).all()


def test_sentences_become_slots_of_words_beginnings_and_pairs():
    known = subjects.coded({"law", "court", "courts", "#"})
    x = subjects.grams([["the", "court", "law"], [], ["courts"], ["unknown"]], known)
    assert x.n.tolist() == [3 * 2, 1, 3, 1]
    first, third = x.slots[:6], x.slots[7:10]
    assert len(set(first)) == 6 and third[1] == first[2] and third[0] != first[0]
    assert x.slots[6] == x.slots[5] == x.slots[10] == subjects.slot("bias")


def test_areas_edges(spark):
    d = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "The judge upheld the verdict. " * 3000, "c"), (4, "The judge upheld the appeal. The court sat.", "c"), (5, "The goal was scored. The match was lost.", "c"), (None, "x", "c")] + [(10 + i, "The judge upheld the verdict. The court sat." if i % 2 else "The goal was scored. The match was lost.", "c") for i in range(40)], "doc_id bigint, text string, share string")
    l = spark.createDataFrame([(10 + i, "LAW" if i % 2 else "sport ", "a") for i in range(30)] + [(4, None, "a"), (99, "law", "b"), (5, "weather", "b")], "doc_id bigint, subject string, annotator string")
    s = spark.createDataFrame([("law", 1), ("sport", 2), (None, 3)], "subject string, area_no int")
    got = set(found(subjects.subject_areas(d, l, s), "doc_id", "subject"))
    assert {(3, "law"), (4, "law"), (5, "sport")} <= got and not {x for x, _ in got} & {1, 2}
    assert subjects.subject_areas(d, l.limit(0), s).count() == 0 and subjects.subject_areas(d.limit(0), l, s).count() == 0 and subjects.subject_areas(d, l, s.limit(0)).count() == 0


def test_areas_learn_from_all_documents(spark, monkeypatch):
    """Of 20,600 labelled documents the hundred that come last by hash alone have an area's label, and of 60 more without a label it is found; also when sentences are parted among many models."""
    order = [r.id for r in spark.range(20_600).orderBy(F.xxhash64("id")).collect()]
    rare = set(order[-100:])
    kinds = [("law", "The judge number {} upheld the verdict. The court sat again."), ("sport", "The striker scored goal {} today. The match was lost."), ("film", "A director shot scene {} twice. The actress left the set.")]
    of = lambda i: 2 if i in rare else i % 2
    d = spark.createDataFrame([(i, kinds[of(i)][1].format(i)) for i in order] + [(100_000 + i, kinds[2][1].format(i)) for i in range(60)], "doc_id bigint, text string")
    l = spark.createDataFrame([(i, kinds[of(i)][0]) for i in order], "doc_id bigint, subject string")
    s = spark.createDataFrame([(x,) for x, _ in kinds], "subject string")
    want = {i for i in rare} | {100_000 + i for i in range(60)}
    for most in (subjects.PART_ROWS, 2):
        monkeypatch.setattr(subjects, "PART_ROWS", most)
        got = found(subjects.subject_areas(d, l, s).filter("subject = 'film'"), "doc_id")
        assert {i for i, in got} == want and len(got) == len(want)


def test_areas_learn_from_whole_documents(spark):
    """Two labelled documents of 1,505 sentences, of which all are handed on to training."""
    clerical = [f"The entry {' '.join(p)} was filed." for p in itertools.islice(itertools.permutations("alpha beta gamma delta epsilon zeta eta theta".split(), 5), 2990)]
    told = {"law": "The judge upheld the verdict", "sport": "The striker scored the goal"}
    texts = [(i, (" ".join(clerical[i :: 2] + [f"{told[a]} {'again ' * k}then." for k in range(10)]), a)) for i, a in enumerate(told)]
    d = spark.createDataFrame([(i, t) for i, (t, _) in texts] + [(10 + i, f"{told['law' if i % 2 else 'sport']} again then.") for i in range(8)], "doc_id bigint, text string")
    l = spark.createDataFrame([(i, a) for i, (_, a) in texts], "doc_id bigint, subject string")
    seen = subjects._fit(d, l, spark.createDataFrame([(a,) for a in told], "subject string"))[1]
    n = {r.doc_id: sum(r.times) for r in seen.collect()}
    assert n[0] == n[1] == 1505 and n[10] == 1


def test_folds_train_on_the_others(spark):
    """Each fold's model is the one of the rows outside it alone: a slot that only the fold's rows have weighs nothing and is counted in none."""
    x = linear.Rows([[1, 10 + i % 3] for i in range(600)])
    fold, y = np.arange(600) % 3, (np.arange(600) % 2)[:, None].astype(float)
    slots, times, w = linear.train_folds(x, y, np.ones(600), fold, 3, 2, 0.2, 1e-3)
    assert slots.tolist() == [1, 10, 11, 12]
    for f in range(3):
        assert times[f].tolist() == [400] + [0 if f == g else 200 for g in range(3)] and w[f, 1 + f, 0] == 0
    # One model of all rows, apart from the order of rows, is that of train.
    y = np.stack([np.arange(600) % 3 == 0, np.arange(600) % 3 != 2], 1).astype(float)
    slots, _, w = linear.train_folds(x, y, np.ones(600), fold, 1, 30, 0.2, 1e-3)
    assert np.array_equal(linear.score(w[0], linear.Rows([[0, 1 + i] for i in range(3)])) > 0, [[1, 1], [0, 1], [0, 0]])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert df.columns and df.count() > 0
