"""Problem 1: texts cut off by a field's limit or in transfer, by hashed logistic regression on closings."""

from __future__ import annotations

import bisect
import itertools
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.llm.linear import Rows, score, slot, train
from linkstrata.plans.staging import stage

SAMPLE = 24_000
"""At most so many different texts train the model."""
MOST_CHARS = 20_000
"""Of longer texts the closing so many characters train; they are scored whole."""
KNOWN_SHARE = 5e-4
"""A word in at least this share of the texts is known: at most a text's mean number of words / KNOWN_SHARE words."""
LIMIT_SHARE, SPIKE, AROUND = 0.01, 4, 8
"""A length is a source's limit if more than LIMIT_SHARE of its texts have it, SPIKE times as many as have lengths up to AROUND off, on average."""
ROUNDS = 3
CUT_WEIGHT = 0.25
"""Weight of a cut against a whole text, as each whole text gives up to three cuts."""

# How shortened texts are marked.
MARKERS = ["…", "...", " ...", " [...]", "… more", " … more", " (more)", " [more]", " Read more", "[…]"]
MARKED = re.compile(r"(?:…|\.\.\.+|\[(?:\.\.\.|…|more)\]|\(more\)|(?:…|\.\.\.)\s*(?:more|read more))\s*$", re.I)
WORD = re.compile(r"\w+(?:['’-]\w+)*|[^\w\s]")


def _shape(w: str) -> str:
    if w.isdigit():
        return "9"
    if not w[:1].isalnum():
        return w
    if len(w) == 1:
        return "A" if w.isupper() else "a"
    return ("A" if w[0].isupper() else "a") + ("a" if w[1:].islower() else "?")


BREAK = re.compile(r"[.!?]\s+(?=\S)")
ESCAPE = re.compile(r"&#?\w*$")
LAST_KEY = re.compile(r"(?:^|; )[^:;]+: [^:;]+$")


def _to_limit(source: str | None, text: str, limits: dict[tuple, list[int]]) -> str:
    """How far below the next limit of its source a text ends, in characters or bytes: 0, up to 2, 8 or 24, or '-'."""
    if not limits:
        return "-"
    best = 25
    for unit in "cb":
        if own := limits.get((source, unit)):
            n = len(text) if unit == "c" or text.isascii() else len(text.encode())
            i = bisect.bisect_left(own, n)
            best = min(best, own[i] - n) if i < len(own) else best
    return "0" if best == 0 else "2" if best <= 2 else "8" if best <= 8 else "24" if best <= 24 else "-"


def beginnings(known: dict[str, int]) -> set[str]:
    """What frequent words begin with, themselves left out."""
    return {w[:i] for w in known for i in range(1, len(w))}


def closing(text: str, source: str | None, known: dict[str, int] | set[str], limits: dict[tuple, list[int]], begun: set[str]) -> list[int]:
    """Hashed features of how a text closes; ``known``: frequent words; ``limits``: (source, unit) -> lengths that many texts have; ``begun``: ``beginnings``."""
    t = text.rstrip()
    tail = t[-420:]
    words = WORD.findall(tail[-240:])
    w = ["^"] * 4 + words
    a, b, c, d = (x.lower() if x.lower() in known or not x[:1].isalnum() else f"?{_shape(x)}" for x in (w[-1], w[-2], w[-3], w[-4]))
    whole = len(words) and words[-1].lower() in known
    keys = t.count(": ")
    ends = [m.end() for m in BREAK.finditer(tail)]
    many = bool(ends) or BREAK.search(t) is not None
    style = ("list" if keys and t.count(";") + 1 >= keys and ". " not in t else "many" if many else "one") + ("A" if t[:1].isupper() else "a")
    length = f"{min(len(WORD.findall(tail[ends[-1] if ends else 20:])), 24) // 4}"
    limit = _to_limit(source, text, limits)
    part = not whole and len(words) > 0 and words[-1].lower() in begun
    quotes = t.count('"') % 2, t.count("(") > t.count(")"), t.rfind("<") > t.rfind(">"), bool(ESCAPE.search(tail)), t.count("<b>") > t.count("</b>")
    end, before, third = _shape(w[-1]), _shape(w[-2]), _shape(w[-3])
    f = [
        f"end {end}", f"a {a}", f"b {b}", f"ab {a} {b}", f"abc {a} {b} {c}", f"bc {b} {c}", f"abcd {a} {b} {c} {d}",
        f"shapes {end} {before} {third}", f"known {whole} {end} {before}", f"style {style} {end}",
        f"style {style} {a}", f"style {style} {length} {end}", f"source {source} {end}", f"source {source} {style} {end}",
        f"source {source} {a} {b}", f"limit {limit}", f"limit {limit} {end}", f"open {quotes}", f"open {quotes} {end}",
        f"marked {bool(MARKED.search(tail))}", f"source {source} {a} {b} {c}", f"part {part} {end}", f"part {part} {style} {before}",
        f"last {len(w[-1])} {end} {whole}", f"keyed {style} {bool(LAST_KEY.search(tail))} {end}", "bias",
    ]
    return [slot(x) for x in f]


def cuts(text: str, rng: random.Random, lengths: list[int], sizes: list[int] = []) -> list[str]:  # noqa: B006
    """Artificial positives: ``text`` cut anywhere or at a limit, after a word, and after an initial, at times marked, and amid a character's bytes.

    ``lengths``: the source's limits in characters, ``sizes``: in bytes.
    """
    t = text.rstrip()
    ways = [
        lambda: rng.choice(lengths) if lengths and rng.random() < 0.4 else rng.randrange(max(2, len(t) // 4), max(3, len(t))),
        lambda: rng.choice([m.end() for m in re.finditer(r"\S+", t)][:-1] or [0]),
        lambda: rng.choice([m.end() for m in re.finditer(r"\b[A-Z]\.(?= )", t)] or [0]),
    ]
    out = []
    for way in ways:
        for _ in range(4):
            left = t[: way()]
            if 8 <= len(left) < len(t) - 1 and (not CLOSED.search(left.rstrip()) or re.search(r"\b[A-Z]\.$", left)):
                out.append(left + (rng.choice(MARKERS) if rng.random() < 0.2 else ""))
                break
    if not t.isascii():
        raw = t.encode()
        at = [i for i in range(8, len(raw)) if raw[i] & 0xC0 == 0x80] if len(raw) <= MOST_CHARS else []
        if at:
            out.append(raw[: rng.choice([i for i in at if i in sizes] or at)].decode(errors="replace"))
    return out


CLOSED = re.compile(r"[.!?][\"'’”»)]*$")


def _style(text: str) -> str:
    """How a value is built: a list of keys and values, sentences, or a phrase without a verb-like length."""
    t = text.rstrip()
    keys = t.count(": ")
    return "list" if keys and t.count(";") + 1 >= keys and ". " not in t else "text"


INITIAL = re.compile(r"[A-Z][\w'’-]+ [A-Z]\.$")
RARE_END = 0.1


def fragments(known: dict[str, int], ends: dict[str, float]) -> set[str]:
    """Frequent words that are mostly the last of their text and with which a word of at least their frequency begins: cut words, it may be."""
    order, out = sorted(known), set()
    for i, w in enumerate(order):
        if ends.get(w, 0.0) > 0.5 and len(w) > 1:
            longer = itertools.takewhile(lambda x, w=w: x.startswith(w), itertools.islice(order, i + 1, None))
            if any(known[x] >= known[w] for x in longer):
                out.add(w)
    return out


def _seeds(rows: list[tuple[str, str | None]], ends: dict[str, float], broken: set[str], begun: set[str]) -> list[tuple[str, str | None]]:
    """Where training begins: rows that look whole and close as most rows of their source and style do.

    The stop after an initial that follows a name is no close, and a bare last word must be one that ends texts often enough
    (``ends``: in which share of the texts that have it a frequent word is the last), none of ``broken``
    and no rare word with which a frequent one begins (``begun``).

    Where most of a source's values of a style end in a full stop, the others are left out; where most do not,
    a full stop is no sign, and all stay.
    """
    groups: dict[tuple, list] = {}
    for t, s in rows:
        groups.setdefault((s, _style(t)), []).append((t, s))
    out = []
    for group in groups.values():
        closed = [x for x in group if CLOSED.search(x[0].rstrip())]
        out += closed if 2 * len(closed) > len(group) else group

    def fair(t: str) -> bool:
        t = t.rstrip()
        last = re.split(r"\s", t[-400:])[-1].lower()
        return _looks_whole(t) and not INITIAL.search(t) and ends.get(last, 1.0) >= RARE_END and last not in broken and (last in ends or last not in begun)

    return [x for x in out if fair(x[0])]


def _looks_whole(text: str) -> bool:
    """No mark of shortening, nothing left open."""
    t = text.rstrip()
    return not MARKED.search(t) and t.count("(") <= t.count(")") and t.rfind("<") <= t.rfind(">") and not re.search(r"&#?\w*$", t)


class Model:
    """Weights, frequent words and limits; scores texts."""

    def __init__(self, weights: np.ndarray, known: dict[str, int] | set[str], limits: dict[tuple, list[int]]):
        self.weights, self.known, self.limits, self.begun = weights, known, limits, beginnings(known)

    def odds(self, texts: list[str], sources: list) -> np.ndarray:
        return score(self.weights, Rows([closing(t, s, self.known, self.limits, self.begun) for t, s in zip(texts, sources)]))


def fit(rows: DataFrame, text: str, source: str) -> Model | None:
    """The model of a table's closings; None where no text is long enough to be cut.

    Frequent words and lengths are counted over all rows; at most SAMPLE different texts, the first by hash, train. Texts that
    look whole are negatives, cuts of them positives. After each round, texts that the model finds cut leave
    the negatives, so that texts cut already do less and less harm.
    """
    texts = rows.select(F.col(text).alias("t"), F.col(source).alias("s")).filter("t is not null and trim(t) <> ''")
    total = texts.count()
    if not total:
        return None
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("t"), r"[^\p{L}\p{M}\p{N}'’-]+"))).alias("w"))
    known = {r.w: r.n for r in words.filter("w <> ''").groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= max(3, KNOWN_SHARE * total)).collect()}
    last = texts.select(F.lower(F.element_at(F.split(F.rtrim(F.regexp_replace("t", r"\s+", " ")), " "), -1)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    last = last.filter(F.col("n") >= max(3, KNOWN_SHARE * total)).collect()  # no more than there are known words
    ends = {r.w: min(1.0, r.n / known[r.w]) for r in last if r.w in known}
    ends = {w: ends.get(w, 0.0) for w in known}
    units = texts.select("s", F.explode(F.array(F.struct(F.lit("c").alias("u"), F.length("t").alias("n")), F.struct(F.lit("b").alias("u"), F.octet_length("t").alias("n")))).alias("x"))
    sizes = units.groupBy("s", "x.u", "x.n").agg(F.count("*").alias("k"))
    of = texts.groupBy("s").agg(F.count("*").alias("all"))
    sizes = stage(sizes, "p1-sizes")
    often = sizes.alias("a").join(of.alias("b"), F.expr("a.s <=> b.s")).filter((F.col("k") >= 5) & (F.col("k") > LIMIT_SHARE * F.col("all")))
    often = often.select("a.s", "u", "n", "k", F.explode(F.sequence(F.col("n") - AROUND, F.col("n") + AROUND)).alias("m"))  # fewer than 1 / LIMIT_SHARE lengths a source and unit
    near = often.alias("a").join(sizes.alias("b"), F.expr("a.s <=> b.s and a.u = b.u and a.m = b.n")).groupBy("a.s", "a.u", "a.n", "a.k").agg(F.sum("b.k").alias("all"))
    limits: dict[tuple, list[int]] = {}
    for r in near.filter(F.col("k") >= SPIKE * (F.col("all") - F.col("k")) / (2 * AROUND)).orderBy("s", "u", "n").collect():
        limits.setdefault((r.s, r.u), []).append(r.n)
    share = min(1.0, 1.2 * SAMPLE / total)
    closings = texts.select(F.expr(f"right(t, {MOST_CHARS})").alias("t"), "s")
    by = F.xxhash64("t", "s")
    some = closings.filter(F.pmod(by, F.lit(1_000_000)) < int(share * 1_000_000) + 1).distinct()
    sample = some.orderBy(by, "t", "s").limit(SAMPLE).toPandas().sort_values(["t", "s"], kind="stable")
    whole = [(t, None if pd.isna(s) else s) for t, s in zip(sample.t, sample.s) if len(t.strip()) >= 12]
    begun = beginnings(known)
    whole = _seeds(whole, ends, fragments(known, ends), begun)
    rng = random.Random(5)
    rows_ = [(t, s, i, 0.0) for i, (t, s) in enumerate(whole)]
    rows_ += [(x, s, i, 1.0) for i, (t, s) in enumerate(whole) for x in cuts(t, rng, limits.get((s, "c"), []), limits.get((s, "b"), []))]
    owner, y = np.array([r[2] for r in rows_], np.int64), np.array([r[3] for r in rows_])
    if not y.any():
        return None
    x = Rows([closing(t, s, known, limits, begun) for t, s, _, _ in rows_])
    kept, weights = np.ones(len(whole), bool), None
    for _ in range(ROUNDS):
        if weights is not None:
            kept &= score(weights, x)[: len(whole)] < 0
        use = np.flatnonzero(kept[owner])
        if not y[use].any():
            break
        weights = train(x, y, np.where(y > 0, CUT_WEIGHT, 1.0), epochs=8, use=use)
    return Model(weights, known, limits)


def truncated(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, odds, cut) of each row with a text; null and blank texts have no row. Every record is scored.

    A table in which nothing can be cut (no text of a dozen characters) has cut = false throughout.
    """
    model = fit(rows, text, source)

    @F.pandas_udf("double")
    def odds(t: pd.Series, s: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(t), -1.0))
        return pd.Series(model.odds(t.tolist(), [None if pd.isna(x) else x for x in s]))

    asked = rows.filter(F.col(text).isNotNull() & (F.trim(F.regexp_replace(text, r"\s+", " ")) != ""))
    return asked.select(key, source, odds(F.col(text), F.col(source)).alias("odds")).withColumn("cut", F.col("odds") > 0)


def truncation_report(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(source, rows, cut, share): of all rows of a source, those cut off. Null sources are one group."""
    found = truncated(rows, key, text, source).filter("cut").select(F.col(source).alias("s")).groupBy("s").agg(F.count("*").alias("cut"))
    of = rows.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("rows"))
    out = of.join(found, F.expr("source <=> s"), "left").select("source", "rows", F.coalesce("cut", F.lit(0)).alias("cut"))
    return out.withColumn("share", F.col("cut") / F.col("rows"))
