"""Problem 3: link spellings of names to entities, by merge-and-rematch resolution."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.llm.common import filter_of, hashed, slips
from linkstrata.llm.lookalike import CLASSES, script, unfolded
from linkstrata.plans.staging import hot_keys, join_by_count, join_salted, small, stage

# Words that say nothing about who is meant.
FILLERS = {"the", "late", "dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "of", "for", "and", "so", "called", "von", "de"}
# Letters whose base letter no decomposition gives.
BASE = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"})
WORD = re.compile(r"[^\W_]+")
LEAST_CORE = 4
ALIAS_SUPPORT = 2


@lru_cache(maxsize=200_000)
def _latin(word: str) -> str:
    """The word in Latin letters where each of its letters has a Latin look-alike."""
    if word.isascii():
        return word
    out = [next((c for c in CLASSES.get(x, (x,)) if script(c) in ("L", "")), None) for x in word]
    return word if None in out else "".join(out)


def name_words(name: str | None, quoted: bool = False) -> list[str]:
    """Folded words of a name: no case, accents, look-alikes, escapes or marks; null and blank give [].

    ``quoted``: the name may be URL-quoted with underscores for blanks.
    """
    if not name:
        return []
    if quoted:
        name = unquote(name).replace("_", " ")
    text = unfolded(html.unescape(name).replace("­", ""))
    words = (_latin(w) for w in re.split(r"[^\ẁ-ͯ]+", text.replace("'", "").replace("’", "")))
    return [w for x in words for w in WORD.findall("".join(c for c in x.lower() if not unicodedata.combining(c)).translate(BASE))]


def core_slips(n: int) -> int:
    """Slips that a distinctive word of n letters may have."""
    return 0 if n < LEAST_CORE else 1 if n < 8 else 2


def _shortened(a: str, b: str) -> bool:
    """a is a short form of b: it begins alike and its letters stand in b in order."""
    if len(a) >= len(b) or a[0] != b[0]:
        return False
    at = iter(b)
    return all(c in at for c in a)


def fit(words: list[str], core: str, rest: list[str], spelled: list[str], aliases: set[tuple[str, str]], initials: frozenset[str] | set[str] = frozenset()) -> float:
    """How well a mention's words fit a profile: 0 not at all, up to 10.

    ``core``: the distinctive word of the name; ``spelled``: spellings of it merged so far that block with the mention; ``rest``: the
    name's other words; ``initials``: those merged so far. Each word of the mention has to be the core (with slips, but as it is where either is short), a filler, or stand for
    another word of the name: the same, with a slip, shortened, an initial, a known alias, or an acronym.
    """
    own = [w for w in words if w not in FILLERS]
    best = 0.0
    rest = [w for w in rest if w not in FILLERS]
    for i, w in enumerate(own):
        near = (s for s in (core, *spelled) if min(len(w), len(s)) >= LEAST_CORE)
        d = 0.0 if w == core else 0.5 if w in spelled else min((slips(w, s, core_slips(len(w))) + (s != core) * 0.5 for s in near), default=9.0)
        if d > core_slips(len(w)) + 0.5:
            continue
        score, free, others = 6.0 - d, list(rest), own[:i] + own[i + 1 :]
        for x in others:
            hit = next((y for y in free if x == y), None)
            worth = 1.5
            if hit is None:
                hit, worth = next((y for y in free if (x, y) in aliases), None), 1.3
            if hit is None and len(x) >= 4:
                hit, worth = next((y for y in free if slips(x, y, 1 + (len(y) > 7)) <= 1 + (len(y) > 7)), None), 1.0
            if hit is None and len(x) >= 2:
                hit, worth = next((y for y in free if _shortened(x, y) or len(x) >= 3 and x[:3] == y[:3]), None), 0.9
            if hit is None and len(x) == 1:
                hit, worth = next((y for y in free if y[0] == x), None), 0.8
            if hit is None and len(x) == 1 and x in initials:
                score += 0.8
                continue
            if hit is None and 2 <= len(x) <= 4 and "".join(y[0] for y in free) == x:
                score, free = score + 1.0, []
                continue
            if hit is None and (x, x) in aliases and len(others) > 1:  # a second given name beside the full one
                continue
            if hit is None and others and any((x, y) in aliases for y in rest):
                continue
            if hit is None:
                score -= 4.0
            else:
                free.remove(hit)
                score += worth
        best = max(best, score - 0.1 * len([y for y in free if len(y) > 1]))
    return best


def _without(w: str) -> set[str]:
    """The word with one letter left out."""
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def _deletes(words: list[str]) -> list[str]:
    """Each word, and each of LEAST_CORE letters or more with one letter left out: words one slip apart share one. Short words are marked, so they meet only themselves."""
    own = {w for w in words if w and w not in FILLERS}
    return list({k for w in own for k in ((w, *_without(w)) if len(w) >= LEAST_CORE else (f"={w}",))})


def _deletes_twice(words: list[str]) -> list[str]:
    """The same and words of 8 letters or more with two letters left out: words that core_slips admits share one."""
    return list({*_deletes(words), *(k for w in words if core_slips(len(w)) > 1 and w not in FILLERS for x in _without(w) for k in _without(x))})


def _keys_in(f, sent):
    """A function of words to those of their keys that pass the filter ``sent``, so that keys no mention has are never sent on."""

    def run(s: pd.Series) -> pd.Series:
        lists = [f([w]) for w in s]
        flat = np.array([k for ks in lists for k in ks], dtype=object)
        ok = iter(sent.value.has(hashed(flat)).tolist() if len(flat) else [])
        return pd.Series([[k for k in ks if next(ok)] for ks in lists], dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")


def _udf(f, kind: str):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x if x is None or isinstance(x, str) else list(x)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def link_names(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(row_id, qid) for the rows of ``mentions`` without answer whose mention names an entity.

    ``mentions``: row_id, mentions, answer, cands; ``entities``: qid, entity_name. A profile starts as the
    entity's name: its distinctive word (the one in fewest names, the longest of these) and the others. Rows
    that are linked already merge into their entity's profile, adding spellings of the distinctive word, initials, and evidence
    for aliases of the other words. Spellings without a link are blocked on their words with one letter left out, scored against
    the profiles, and merged into the best one; the profiles that this makes richer, in spellings, initials or aliases, re-enter
    blocking against what is still open, until a
    round adds nothing. Then what is open is blocked with two letters left out of long words as well, again until a
    round adds nothing. Short words have to be as they are. Of equally good entities one
    that the row lists among its candidates wins; without such the row stays out. Null and wordless mentions name nothing.
    Spellings are rows of a table, never one row's list; of them a scored pair gets those that block with its mention.
    """
    names = entities.filter("qid is not null").groupBy("qid").agg(F.min("entity_name").alias("name"))
    names = names.select("qid", _udf(lambda s: name_words(s, True), "array<string>")("name").alias("words"))
    names = stage(names, "p3-names")
    each = stage(names.select("qid", F.explode(F.array_distinct("words")).alias("w")).filter(~F.col("w").isin(*FILLERS)), "p3-words")
    spread = join_by_count(each, each.groupBy("w").agg(F.count("*").alias("df")), ["w"], "df", each.count())
    cores = spread.groupBy("qid").agg(F.min(F.struct("df", -F.length("w"), "w")).alias("c")).select("qid", F.col("c.w").alias("core"))
    profiles = names.join(cores, "qid").select("qid", "core", F.array_remove("words", F.col("core")).alias("rest"))
    profiles = stage(profiles, "p3-profiles")

    answer = F.upper(F.trim("answer"))
    spelt = mentions.filter("mentions is not null").select("row_id", "mentions", answer.alias("qid"), "cands")
    linked = spelt.filter("qid is not null and qid <> 'NIL'").groupBy("mentions", "qid").agg(F.count("*").alias("n"))
    # Distinct spellings of one entity may be very many, so profiles meet them with that entity's parted.
    linked = stage(linked.select("qid", _udf(name_words, "array<string>")("mentions").alias("words")), "p3-linked")
    linked = stage(join_salted(linked, profiles, ["qid"]).select("qid", "core", "rest", "words"), "p3-linked")

    def learnt(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What linked mentions tell: (qid, s) spellings, (qid, i) initials, (w, full, qid) evidence for aliases."""
        token = rows.select("qid", "core", F.explode("words").alias("w"))
        near = F.levenshtein("w", "core", 3).between(1, 3) if rows is not linked else F.levenshtein("w", "core", 2).between(1, 2)
        spelled = token.filter((F.least(F.length("w"), F.length("core")) >= LEAST_CORE) & near).select("qid", F.col("w").alias("s")).distinct()
        initials = token.filter(F.length("w") == 1).select("qid", F.col("w").alias("i")).distinct()
        # A word that never looks like the distinctive one may be an alias of another word of the name.
        other = rows.filter(F.size("rest") > 0).select("qid", "core", F.element_at("rest", 1).alias("full"), F.explode("words").alias("w"))
        other = other.filter((F.length("w") > 2) & (F.length("w") < F.length("core") + 2) & (F.col("w") != F.col("full")) & ~F.col("w").isin(*FILLERS))
        evidence = other.filter((F.levenshtein("w", "core") > 3) & (F.levenshtein("w", "full") > 1)).select("w", "full", "qid").distinct()
        return spelled, initials, evidence

    free = spelt.filter("qid is null")
    open_ = stage(free.select("mentions").distinct().select("mentions", _udf(name_words, "array<string>")("mentions").alias("words")), "p3-open")
    spelled, initials, evidence = (stage(x, "p3-learnt") for x in learnt(linked))

    def aliases_of(evidence: DataFrame) -> DataFrame:
        return stage(evidence.groupBy("full", "w").agg(F.countDistinct("qid").alias("n")).filter(F.col("n") >= ALIAS_SUPPORT).select("full", "w"), "p3-aliases")

    def enriched(aliases: DataFrame, initials: DataFrame) -> DataFrame:
        """Profiles with the aliases of their other words and their initials (an alphabet's at most)."""
        known = aliases.groupBy("full").agg(F.collect_set("w").alias("known"))
        own = profiles.select("qid", F.explode("rest").alias("full")).distinct().join(small(known), "full").groupBy("qid").agg(F.collect_list(F.struct("full", "known")).alias("aliases"))
        return stage(profiles.join(own, "qid", "left").join(initials.groupBy("qid").agg(F.collect_set("i").alias("initials")), "qid", "left"), "p3-full")

    def score(words: pd.Series, core: pd.Series, rest: pd.Series, spelled: pd.Series, aliases: pd.Series, initials: pd.Series) -> pd.Series:
        out = []
        for w, c, r, s, a, i in zip(words, core, rest, spelled, aliases, initials):
            pairs = {(k, x["full"]) for x in (() if a is None else a) for k in x["known"]}
            out.append(fit(list(w), c, list(r), list(s), pairs, set() if i is None else set(i)))
        return pd.Series(out, dtype="float64")

    score = F.pandas_udf(score, "double")
    aliases = aliases_of(evidence)
    full = enriched(aliases, initials)
    whole = lambda: profiles.select("qid", F.col("core").alias("s")).unionByName(spelled)
    new, won, twice, left = whole(), [], False, None
    while True:
        keyed = _deletes_twice if twice else _deletes
        if left is None:  # made once for all rounds; mentions that are linked by then have no row in open_
            left = stage(open_.select("mentions", F.explode(_udf(keyed, "array<string>")("words")).alias("k")), "p3-keys")
            hot = hot_keys(left, ["k"])
            sent = mentions.sparkSession.sparkContext.broadcast(filter_of(left, "k", left.count()))
        right = new.select("qid", "s", F.explode(_keys_in(keyed, sent)("s")).alias("k"))
        # Only spellings that share a key with the mention go along, as an entity may have very many.
        pairs = join_salted(left, right, ["k"], hot=hot).groupBy("mentions", "qid").agg(F.collect_set("s").alias("spelled"))
        scored = pairs.join(open_, "mentions").join(full, "qid")
        scored = scored.select("mentions", "words", "qid", "core", "rest", score("words", "core", "rest", "spelled", "aliases", "initials").alias("score")).filter("score >= 3.5")
        scored = stage(scored, "p3-scored")
        top = scored.groupBy("mentions").agg(F.max("score").alias("best"), F.count("*").alias("n"))
        hits = stage(scored.join(top, "mentions").filter("score > best - 0.05").drop("n"), "p3-hits")
        won.append(hits.select("mentions", "qid"))
        open_ = stage(open_.join(hits.select("mentions").distinct(), "mentions", "left_anti"), "p3-open")
        sure = stage(hits.join(hits.groupBy("mentions").agg(F.count("*").alias("n")).filter("n = 1"), "mentions"), "p3-sure")
        more, letters, hints = learnt(sure)
        more = stage(more.join(spelled, ["qid", "s"], "left_anti"), "p3-more")
        letters = stage(letters.join(initials, ["qid", "i"], "left_anti"), "p3-letters")
        hints = stage(hints.join(evidence, ["w", "full", "qid"], "left_anti"), "p3-hints")
        richer = more.select("qid", "s")
        grown = letters.select("qid").distinct()
        if hints.head(1):
            evidence = stage(evidence.unionByName(hints), "p3-evidence")
            was, aliases = aliases, aliases_of(evidence)
            fresh = aliases.join(was, ["full", "w"], "left_anti").select("full").distinct()
            grown = grown.unionByName(profiles.select("qid", F.explode("rest").alias("full")).join(fresh, "full").select("qid")).distinct()
        grown = stage(grown, "p3-grown")
        spelled = stage(spelled.unionByName(more), "p3-spelled") if more.head(1) else spelled
        if grown.head(1):
            initials = stage(initials.unionByName(letters), "p3-initials")
            full = enriched(aliases, initials)
            richer = richer.unionByName(whole().join(grown, "qid")).distinct()
        if not richer.head(1):
            if twice:
                break
            new, twice, left = whole(), True, None
            continue
        new = richer
    found = won[0]
    for w in won[1:]:
        found = found.unionByName(w)
    found = stage(found.distinct(), "p3-found")
    spellings = free.groupBy("mentions").agg(F.count("*").alias("n"))
    found = found.withColumnRenamed("qid", "entity").join(spellings, "mentions")
    rows = join_by_count(free, found, ["mentions"], "n", mentions.count())
    listed = F.coalesce(F.array_contains("cands", F.col("entity")), F.lit(False)).cast("int")
    rows = rows.select("row_id", "entity", listed.alias("listed"))
    pick = rows.groupBy("row_id").agg(F.count("*").alias("n"), F.sum("listed").alias("l"), F.max(F.struct("listed", "entity")).alias("top"))
    return pick.filter("n = 1 or l = 1").select("row_id", F.col("top.entity").alias("qid"))
