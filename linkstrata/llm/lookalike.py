"""Problem 6: one form for texts that look the same, by Viterbi search over look-alike lattices."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkstrata.functions.text import md5_key
from linkstrata.llm.common import expand
from linkstrata.plans.staging import join_by_count, stage

# Characters without any shape of their own.
IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
# Other punctuation that looks like an ASCII mark.
MARKS = {"‐": "-", "‑": "-", "˗": "-", "−": "-", ";": ";", "։": ":", "․": ".", "‚": ",", "ʼ": "’", "⁄": "/", "∕": "/", "ː": ":", "꞉": ":"}
COMPAT = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
PLAIN = r"^[\x09-\x0d\x20-\x7e¡-§©«¬®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž–—‘’“”]*$"
BLANKS = r"[\x09-\x0d\x20]+"


# Letters of Latin, Cyrillic and Greek that look alike; "" where a script has none.
ALIKE = [
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", "Ϲ"), ("E", "Е", "Ε"), ("H", "Н", "Η"), ("I", "І", "Ι"), ("J", "Ј", "Ϳ"),
    ("K", "К", "Κ"), ("M", "М", "Μ"), ("N", "", "Ν"), ("O", "О", "Ο"), ("P", "Р", "Ρ"), ("S", "Ѕ", ""), ("T", "Т", "Τ"),
    ("X", "Х", "Χ"), ("Y", "Ү", "Υ"), ("Z", "", "Ζ"), ("a", "а", "α"), ("c", "с", "ϲ"), ("d", "ԁ", ""), ("e", "е", ""),
    ("h", "һ", ""), ("i", "і", "ι"), ("j", "ј", "ϳ"), ("l", "ӏ", ""), ("o", "о", "ο"), ("p", "р", "ρ"), ("q", "ԛ", ""),
    ("s", "ѕ", ""), ("u", "", "υ"), ("v", "ѵ", "ν"), ("w", "ԝ", ""), ("x", "х", "χ"), ("y", "у", "γ"),
]
CLASSES = {x: tuple(y for y in group if y) for group in ALIKE for x in group if x}
# Code points of alphabets, with a sign for each: Greek, Cyrillic, Armenian, Cherokee, Latin.
ALPHABETS = [(0x370, 0x400, "G"), (0x400, 0x530, "C"), (0x531, 0x58A, "A"), (0x13A0, 0x1400, "K"), (0x1E00, 0x1F00, "L"), (0x1F00, 0x2000, "G"), (0xAB70, 0xABC0, "K")]


@lru_cache(maxsize=None)
def script(ch: str) -> str:
    """The sign of a letter's alphabet, or '' for what belongs to none of ALPHABETS."""
    o = ord(ch)
    if o < 0x250:
        return "L" if ch.isalpha() else ""
    return next((s for a, b, s in ALPHABETS if a <= o < b), "")


def confusable(spark: SparkSession) -> dict[str, tuple[str, ...]]:
    """Classes of letters that look alike: ALIKE, and letters of ALPHABETS with one skeleton in the Unicode table of confusables.

    The table is the one of the ICU library that comes with Spark. Within ASCII nothing is merged: where several ASCII letters have
    one skeleton (I and l), other letters join the one of their case. The first letter of a class is the ASCII one, if any.
    """
    ascii_ = [c for c in map(chr, range(128)) if c.isalpha()]
    others = [c for a, b, _ in ALPHABETS for c in map(chr, range(a, b)) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.normalize("NFKD", c) == c]
    letters = ascii_ + others
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    by: dict[str, list[str]] = {}
    for c, k in zip(letters, skeletons):
        by.setdefault(k, []).append(c)
    groups: dict[str, set[str]] = {x: set(CLASSES[x]) for x in CLASSES}

    def merge(cs: list[str]) -> None:
        whole = set().union(*(groups.get(c, {c}) for c in cs))
        if sum(c < "\x80" for c in whole) <= 1:
            for c in whole:
                groups[c] = whole

    for cs in by.values():
        plain = [c for c in cs if c < "\x80"]
        for c in cs if plain else cs[1:]:
            if c >= "\x80":
                like = plain if len(plain) == 1 else [p for p in plain if p.isupper() == c.isupper()] if plain else cs[:1]
                if len(like) == 1:
                    merge([like[0], c])
    return {c: tuple(sorted(g)) for c, g in groups.items() if len(g) > 1}


@lru_cache(maxsize=65536)
def _unfold(ch: str) -> str:
    """Compatibility form of one character where it looks the same; superscripts, fractions and the like stay."""
    if ch in MARKS:
        return MARKS[ch]
    d = unicodedata.decomposition(ch)
    return unicodedata.normalize("NFKC", ch) if d.startswith(COMPAT) else ch


def unfolded(text: str) -> str:
    """Compatibility-normalised, ignorable characters deleted, decomposed into letters and accents."""
    return unicodedata.normalize("NFD", "".join(map(_unfold, IGNORABLE.sub("", unicodedata.normalize("NFC", text)))))


class Resolver:
    """Viterbi over the look-alike lattice of a token.

    ``counts``: {(script, previous, next): n} over the corpus's one-script tokens, '^' before the first.
    The state of the search is the candidate letter; a step costs -log P(next | previous, script) and
    a change of script ``switch``. The result depends on the classes of the letters alone, so tokens
    that look the same get the same result. What can be read wholly in Latin letters is read so, without a search, as texts of
    plain characters never come here and have to get the same form; all other tokens are decided by their scores.
    """

    def __init__(self, counts: dict[tuple[str, str, str], int], switch: float = 12.0, classes: dict[str, tuple[str, ...]] = CLASSES):
        self.counts, self.switch, self.classes = counts, switch, classes
        total: dict[tuple[str, str], int] = {}
        for (s, a, _), n in counts.items():
            total[s, a] = total.get((s, a), 0) + n
        self.total = total
        self.cache: dict[str, str] = {}

    def cost(self, s: str, a: str, b: str) -> float:
        return -math.log((self.counts.get((s, a, b), 0) + 0.1) / (self.total.get((s, a), 0) + 10.0))

    def token(self, t: str) -> str:
        """``t``: letters and accents of one word, decomposed."""
        if (r := self.cache.get(t)) is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            r = self.cache[t] = self._token(t)
        return r

    def _token(self, t: str) -> str:
        lattice = [self.classes.get(ch, (ch,)) for ch in t]
        latin = [next((c for c in cs if script(c) in ("L", "")), None) for cs in lattice]
        if None not in latin:
            return "".join(latin)
        best = {("", "^"): (0.0, "")}
        for cs in lattice:
            step: dict[tuple[str, str], tuple[float, str]] = {}
            for c in cs:
                s = script(c)
                for (s0, a), (w, path) in best.items():
                    if not s:  # an accent, a digit: keeps the state
                        key, cost = (s0, a), w
                    else:
                        key, cost = (s, c), w + self.cost(s, a if s0 in (s, "") else "^", c) + self.switch * (s0 not in (s, ""))
                    if key not in step or (cost, path + c) < step[key]:
                        step[key] = (cost, path + c)
            best = step
        return min(best.values())[1]

    def text(self, text: str) -> str:
        """The one form of a whole text, white space of any width removed."""
        parts = _tokens(unfolded(text))
        return unicodedata.normalize("NFC", "".join(self.token(p) if p[:1].isalpha() else "".join(p.split()) for p in parts))


_WORD = re.compile(r"[^\W\d_][^\W\d_̀-ͯ]*(?:[̀-ͯ]+[^\W\d_]*)*|[̀-ͯ]+|(?:[^\w]|[\d_])", re.UNICODE)


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text)


def bigrams(texts: DataFrame) -> dict[tuple[str, str, str], int]:
    """Letter pairs by script over all texts; at most the sum of (letters of an alphabet)^2 rows reaches the driver.

    Only words of one script count. Words are counted in the JVM; Python sees batches of pre-aggregated words.
    """
    words = texts.select(F.explode(F.split("text", r"[^\p{L}\p{M}]+")).alias("w")).filter("w <> ''")
    words = words.groupBy("w").agg(F.count("*").alias("n"))

    def count(batches):
        for b in batches:
            out: dict[tuple[str, str, str], int] = {}
            for w, n in zip(b.w, b.n):
                w = [c for c in unfolded(w) if c.isalpha()]
                kinds = {script(c) for c in w}
                if len(kinds) == 1 and (s := kinds.pop()):
                    for a, c in zip(["^", *w], w):
                        out[s, a, c] = out.get((s, a, c), 0) + int(n)
            yield pd.DataFrame([(*k, v) for k, v in out.items()], columns=["s", "a", "b", "n"])

    rows = words.mapInPandas(count, "s string, a string, b string, n long").groupBy("s", "a", "b").agg(F.sum("n").alias("n"))
    return {(r.s, r.a, r.b): r.n for r in rows.collect()}


def one_form(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` with ``<field>_form`` for each field: the form that all texts looking the same share.

    Null gives null, '' gives ''. Texts of plain characters are their own form but for blanks and never leave
    the JVM; the others pass a pandas UDF with the corpus's letter-pair counts.
    """
    odd = rows.select(F.explode(F.array(*fields)).alias("text")).filter(F.col("text").isNotNull())
    counts, classes = bigrams(odd), confusable(rows.sparkSession)

    @F.pandas_udf(StringType())
    def resolve(s: pd.Series) -> pd.Series:
        r = Resolver(counts, classes=classes)
        return s.map(lambda t: None if t is None else r.text(t))

    forms = {}
    for f in fields:
        plain = F.regexp_replace(f, BLANKS, "")
        asked = F.when(~F.col(f).rlike(PLAIN), F.col(f))
        forms[f"{f}_form"] = F.coalesce(resolve(asked), plain)
    return rows.withColumns(forms)


def twin_classes(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, class, variant) of the rows whose class holds several spellings of the same-looking fields.

    Rows with a null in any field take no part. ``variant`` is a digest of the characters, blanks, tabs and
    line breaks aside.
    """
    formed = one_form(rows.dropna(subset=[key, *fields]).select(key, *fields), fields)
    slim = stage(
        formed.select(
            F.col(key).alias("id"),
            md5_key(*(F.col(f"{f}_form") for f in fields)).alias("class"),
            F.xxhash64(*(F.regexp_replace(f, BLANKS, "") for f in fields)).alias("variant"),
        ),
        "p6-slim",
    )
    several = slim.groupBy("class").agg(F.count("*").alias("n"), F.min("variant").alias("lo"), F.max("variant").alias("hi"))
    several = several.filter("lo <> hi").select("class", "n")
    return join_by_count(slim, several, ["class"], "n", slim.count())


def variant_pairs(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of variants (class_a, class_b) of one class, and rows (id, variant). Copies of a variant are one."""
    c = stage(classes.select("id", "class", F.xxhash64("class", "variant").alias("v"), "variant"), "p6-classes")
    each = c.select("class", "v", "variant").distinct()
    a, b = (each.select("class", F.col("v").alias(f"class_{x}"), F.col("variant").alias(f"v_{x}")) for x in "ab")
    return stage(a.join(b, "class").filter("v_a < v_b").select("class_a", "class_b"), "p6-variants"), c.select("id", "v")


def twin_pairs(classes: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of one class in different variants."""
    pairs, members = variant_pairs(classes)
    a, b = (members.select(F.col("id").alias(x), F.col("v").alias(f"class_{x}")) for x in "ab")
    return expand(pairs, a, b).filter("a <> b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def twin_report(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, class, variants, records): each row whose class holds several variants, with their number and that of the class's rows."""
    c = stage(twin_classes(rows, key, fields), "p6-twins")
    n = c.groupBy("class", "variant").agg(F.count("*").alias("k")).groupBy("class").agg(F.count("*").alias("variants"), F.sum("k").alias("records"))
    return join_by_count(c.select("id", "class"), n, ["class"], "records", c.count()).select("id", F.lower(F.hex("class")).alias("class"), "variants", "records")
