"""Problem 9: subject areas of documents, by one-versus-rest linear classifiers on hashed word n-grams of sentences."""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
import zlib
from array import array
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.llm.common import MARKUP, in_chunks
from linkstrata.llm.linear import BITS, Rows, score, slot, train_folds
from linkstrata.plans.staging import lookup, small, stage

PART_ROWS, PART_WORDS = 100_000, 2_000_000
"""A task trains on so many distinct sentences, or so many words of them, at most; one sentence is never parted. The models of all parts are averaged."""
SLOTS = 4096
"""Slots of models that are averaged at once."""
KNOWN_SHARE = 1e-3
"""A word is known if it is in at least this share of a language's documents: at most a text's mean number of words / KNOWN_SHARE words a language."""
SHARE = 0.15
"""Where a document's share of sentences has to begin, unless the labels say better: between a tenth and a fifth."""
SHARES, ODDS = np.round(np.arange(0.10, 0.201, 0.01), 2), (-1.0, -0.5, 0.0, 0.5, 1.0)
"""Thresholds of which each area's are chosen."""
MISSED = 3
"""Unlabelled documents that have to hold a sentence, and labelled ones that are then expected to, for it to be taken to treat no area when none of these does."""
SEVERAL, BORNE = 5, 0.3
"""Of a sentence in SEVERAL labelled documents or more, at least the share BORNE must have an area for it to treat the area."""
CHARS = 1_000_000
"""Characters of texts that are classified at once (one text is never parted)."""
BEGINS = 5
"""Letters by which words are taken to be related."""
ROUNDS = 4
FOLDS = 3
L2 = 1e-3

SENTENCE = re.compile(r"(?<=[.!?])(?<!\b[A-Z]\.)[\"')\]]*\s+|\n+")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|#")
NUMBER = re.compile(r"\d+")


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as lower-case words, numbers as '#'; markup aside. Null gives []."""
    if not text:
        return []
    if "<" in text or "[" in text or "&" in text or "{" in text or "http" in text:
        text = MARKUP.sub(" ", html.unescape(text))
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    own = (WORD.findall(NUMBER.sub("#", s.lower())) for s in SENTENCE.split(text))
    return [ws for ws in own if len(ws) > 1]


def coded(known: set[str]) -> dict[str, int]:
    """For each known word 64 bits that are the same in every process: those of the word, and below them those of how it begins, which related words and languages share."""
    return {w: zlib.crc32(w.encode()) << 32 | zlib.crc32(f"{_bare(w)[:BEGINS]}*".encode()) for w in known}


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def grams(lists: list[list[str]], known: dict[str, int]) -> Rows:
    """Slots of each sentence's known words, of how they begin, then of pairs of neighbours, then a bias."""
    get = known.get
    own = [[x for w in ws if (x := get(w)) is not None] for ws in lists]
    n = np.array([len(x) for x in own], np.int64)
    return _grams(np.fromiter(itertools.chain.from_iterable(own), np.uint64, int(n.sum())), n)


def _grams(both: np.ndarray, n: np.ndarray) -> Rows:
    """``grams`` of the codes of all sentences' known words, one after the other, and how many each has."""
    code, begins = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    size = 3 * n + (n == 0)
    start, first = np.cumsum(size) - size, np.cumsum(n) - n
    out = np.empty(int(size.sum()), np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    at = start[row] + np.arange(len(code)) - first[row]
    out[at] = code
    out[at + n[row]] = begins
    inside = row[:-1] == row[1:]
    pair = (code[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ code[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
    out[(at[:-1] + 2 * n[row[:-1]])[inside]] = pair[inside]
    out[start + size - 1] = slot("bias")
    return Rows(slots=(out & np.uint64((1 << BITS) - 1)).astype(np.int64), n=size)


def _packed(sentences_: list[bytes], codes: np.ndarray) -> Rows:
    """``grams`` of sentences that are bytes of 32-bit numbers of known words; ``codes``: of each number."""
    n = np.array([len(x) // 4 for x in sentences_], np.int64)
    return _grams(codes[np.frombuffer(b"".join(sentences_), np.int32)], n)


def area_key(c):
    """One spelling for names of areas: letters only, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


class Areas:
    """One-versus-rest weights over the areas, with thresholds of each; ``of`` gives each document's shares."""

    def __init__(self, names: list[str], weights: np.ndarray, known: dict[str, int], odds: np.ndarray, least: np.ndarray):
        self.names, self.weights, self.known, self.odds, self.least = names, weights, known, odds, least

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(document, area) share of sentences that treat the area, and number of sentences."""
        split = [sentences(t) for t in texts]
        n = np.array([len(s) for s in split], np.int64)
        return self.shares_of(grams([s for ss in split for s in ss], self.known), n), n

    def shares_of(self, rows: Rows, n: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        """``shares`` of documents of ``n`` sentences each, whose grams are ``rows``; ``times``: how often each stands in its document."""
        if not n.sum():
            return np.zeros((len(n), len(self.names)))
        doc = np.repeat(np.arange(len(n)), n)
        times = np.ones(len(doc)) if times is None else times
        yes = (score(self.weights, rows) > self.odds) * times[:, None]
        total = np.stack([np.bincount(doc, yes[:, c], len(n)) for c in range(len(self.names))], 1)
        return total / np.maximum(np.bincount(doc, times, len(n)), 1)[:, None]


def thresholds(odds: np.ndarray, owners: list[np.ndarray], truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(odds, share) for each area, of ODDS and SHARES, under which documents get their labels best (F1).

    ``odds``: of sentences, by models that have not seen them; ``owners``: each document's sentences; ``truth``: (documents, areas).
    Labels are noisy, so of all thresholds that are at most one document short of the best the one nearest to 0 and SHARE is taken.
    """
    return _best(*_tally(odds, owners, truth))


def _tally(odds: np.ndarray, owners: list[np.ndarray], truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of ODDS and SHARES and each area the documents that get it rightly, and that get it; for each area those that have it. Tallies of parts of the documents add up."""
    k = truth.shape[1]
    doc, at = np.repeat(np.arange(len(owners)), [len(x) for x in owners]), np.concatenate(owners) if owners else np.zeros(0, np.int64)
    n = np.maximum(np.bincount(doc, minlength=len(owners)), 1)[:, None]
    hit, got = [], []
    for o in ODDS:
        share = np.stack([np.bincount(doc, odds[at, c] > o, len(owners)) for c in range(k)], 1) / n
        for s in SHARES:
            yes = share >= s - 1e-9
            hit.append((yes & truth).sum(0))
            got.append(yes.sum(0))
    return np.array(hit), np.array(got), truth.sum(0)


def _best(hit: np.ndarray, got: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = np.array([abs(s - SHARE) / 0.05 + abs(o) for o in ODDS for s in SHARES])
    f1 = 2 * hit / np.maximum(got + have, 1)
    good = f1 >= f1.max(0) - 1 / (have + 1)
    best = np.where(good, far[:, None], np.inf).argmin(0)
    return np.array(ODDS)[best // len(SHARES)], SHARES[best % len(SHARES)]


class Models:
    """For each fold the weights that training on the others gave, of the slots that any of them has."""

    def __init__(self, total: dict[int, tuple[np.ndarray, np.ndarray]], folds: int, k: int):
        """``total``: by fold and lot of SLOTS slots, the sum over parts of the rows that have a slot, and of weights times these."""
        n, w = np.zeros(folds << BITS), np.zeros((folds << BITS, k), np.float32)
        for lot, (rows, sums) in total.items():
            n[lot * SLOTS : (lot + 1) * SLOTS] = rows
            w[lot * SLOTS : (lot + 1) * SLOTS] = sums / np.maximum(rows, 1)[:, None]
        used = np.flatnonzero(n.reshape(folds, -1).any(0))
        self.place = np.full(1 << BITS, len(used), np.int32)
        self.place[used] = np.arange(len(used))
        self.weights = np.concatenate([w.reshape(folds, -1, k)[:, used], np.zeros((folds, 1, k), np.float32)], 1)

    def dense(self, fold: int = 0) -> np.ndarray:
        return self.weights[fold][self.place].astype(np.float64)

    def score(self, rows: Rows, fold: np.ndarray) -> np.ndarray:
        """Log-odds of each row by the model of its fold."""
        out = np.zeros((len(rows), self.weights.shape[2]))
        ends = np.flatnonzero(np.diff(fold, prepend=-1, append=-1))
        for a, b in zip(ends, ends[1:]):  # rows of a fold mostly lie together
            out[a:b] = score(self.weights[fold[a]], Rows(slots=self.place[rows.slots[rows.start[a] : rows.start[b]]], n=rows.n[a:b]))
        return out


class Part:
    """Distinct sentences with what documents say of them: the grams, labelled documents that have each, the shares of these that have each area, whether it treats none, and its fold."""

    def __init__(self, row, codes: np.ndarray, k: int):
        n = np.frombuffer(row.n, np.int32).astype(np.int64)
        self.x = _grams(codes[np.frombuffer(row.words, np.int32)], n)
        self.times, self.fold = np.frombuffer(row.times, np.int32), np.frombuffer(row.fold, np.int8)
        self.none = np.frombuffer(row.none, bool)
        self.y = np.zeros((len(n), k))
        self.y[self.times > 0] = np.frombuffer(row.y, np.float32).reshape(-1, k)

    def labels(self, models: list[Models]) -> tuple[np.ndarray, np.ndarray]:
        """(labels, weight) of the sentences after the rounds that gave ``models``."""
        y, times, none = self.y, self.times, self.none
        free, may, often = (times == 0) & ~none, y > 0.5, np.sqrt(np.minimum(times, 25))
        # A sentence in many labelled documents treats only what their labels bear out.
        settled = times >= SEVERAL
        borne = ~settled[:, None] | (y >= BORNE)
        weight = np.where(free, 0.0, np.where(none, 3.0, often))
        for m in models:
            odds = m.score(self.x, self.fold)
            best = odds.max(1)
            sure = (odds == best[:, None]) & (best > 1.0)[:, None]
            own = may & (odds > -1.0) & (odds > best[:, None] - 2.0)
            y = np.where(free[:, None], sure, np.where(none[:, None], False, (own | sure) & borne)).astype(float)
            clear = (best > 1.0) | (best < -1.0)
            weight = np.where(free, np.where(clear, 0.5, 0.0), np.where(none, 3.0, np.where(clear | settled | (y.sum(1) > 0), 1.0, 0.3) * often))
        return y, weight


def _trained(parts: DataFrame, codes, models: list, k: int, folds: int, epochs: int, seed: int) -> Models:
    """Models of each fold, or one of all rows (``folds`` 1): each part trains its own and these are averaged, a slot's by the part's rows that have it."""

    def learn(batches):
        total: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for row in b.itertuples():
                part = Part(row, codes.value, k)
                y, weight = part.labels([m.value for m in models])
                use = np.flatnonzero(weight > 0)
                x = Rows(slots=part.x.take(use)[0], n=part.x.n[use])
                # A sentence is judged by a model that has not seen its document.
                seen, times, w = train_folds(x, y[use], weight[use], part.fold[use], folds, epochs=epochs, rate=0.2, l2=L2, seed=seed)
                ends = np.searchsorted(seen, np.arange(0, (1 << BITS) + 1, SLOTS))
                for f, c in itertools.product(range(folds), np.flatnonzero(np.diff(ends))):
                    own, at = slice(ends[c], ends[c + 1]), seen[ends[c] : ends[c + 1]] - c * SLOTS
                    sums = total.setdefault((f << BITS) // SLOTS + int(c), [np.zeros(SLOTS), np.zeros((SLOTS, k))])
                    sums[0][at] += times[f, own]
                    sums[1][at] += w[f, own] * times[f, own, None]
        yield _sums(total)

    def unite(g: pd.DataFrame) -> pd.DataFrame:
        total: dict[int, list[np.ndarray]] = {}
        for lot, *sums in _read(g, k):
            for a, x in zip(total.setdefault(lot, [np.zeros(SLOTS), np.zeros((SLOTS, k))]), sums):
                a += x
        return _sums(total)

    kind = "lot int, slots binary, n binary, w binary"
    got = parts.mapInPandas(learn, kind).groupBy("lot").applyInPandas(unite, kind).toPandas()
    return Models({lot: (n, w) for lot, n, w in _read(got, k)}, folds, k)


def _sums(total: dict[int, list[np.ndarray]]) -> pd.DataFrame:
    rows = []
    for lot, (n, w) in total.items():
        at = np.flatnonzero(n)
        rows.append((lot, at.astype(np.int16).tobytes(), n[at].tobytes(), w[at].astype(np.float32).tobytes()))
    return pd.DataFrame(rows, columns=["lot", "slots", "n", "w"])


def _read(rows: pd.DataFrame, k: int):
    for r in rows.itertuples():
        at, n, w = np.frombuffer(r.slots, np.int16), np.zeros(SLOTS), np.zeros((SLOTS, k))
        n[at], w[at] = np.frombuffer(r.n), np.frombuffer(r.w, np.float32).reshape(-1, k)
        yield r.lot, n, w


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> Areas | None:
    """Classifiers of sentences from labels of documents; None without any label."""
    got = _fit(documents, labels, subjects)
    return got and got[0]


def _fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> tuple[Areas, DataFrame] | None:
    """``fit``, and the texts as distinct sentences of numbers of known words: (doc_id, sentences, times).

    All documents train, with all their sentences, each distinct one once.
    A labelled document's sentences start with all its labels; one that stands in many documents starts with the mean of theirs,
    so clerical phrases start with little of each. Each round trains on other documents' sentences
    and keeps for each sentence the labels that its score supports, so sentences that treat nothing or another
    of the document's areas lose the label, and wrong labels fade. Sentences of other documents are negatives where
    no area is likely, and take an area's label where it is very likely. Known words are counted over all documents, by language
    where ``documents`` has ``lang``. Sentences that unlabelled documents have often and labelled ones never treat no area. Last, each area's thresholds are calibrated on the documents' labels by the scores of models that
    have not seen them.
    """
    names = [r.subject for r in subjects.filter("subject is not null").select("subject").distinct().orderBy("subject").collect()]
    if not names:
        return None
    spark, k = documents.sparkSession, len(names)
    keys = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "subject string, area int").select("area", area_key(F.col("subject")).alias("k"))
    marks = labels.filter("doc_id is not null").select("doc_id", area_key(F.col("subject")).alias("k")).join(F.broadcast(keys), "k").select("doc_id", "area").distinct()
    tagged = stage(marks.groupBy("doc_id").agg(F.array_sort(F.collect_list("area")).alias("areas")), "p9-labels")
    if not tagged.head(1):
        return None
    lang = F.lower(F.trim("lang")) if "lang" in documents.columns else F.lit("")
    text = documents.filter("doc_id is not null and text is not null").select("doc_id", "text", F.coalesce(lang, F.lit("")).alias("lang"))
    of = stage(text.groupBy("lang").agg(F.greatest(F.lit(2.0), F.count("*") * F.lit(KNOWN_SHARE)).alias("enough")), "p9-languages")
    words = text.select("lang", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}'’-]+"))).alias("w"))
    words = words.groupBy("lang", "w").agg(F.count("*").alias("n")).join(small(of), "lang").filter("n >= enough")
    known = coded({"#"} | {r.w.strip("'’-") for r in words.select("w").distinct().collect()})
    number = {w: i for i, w in enumerate(sorted(known))}
    codes = spark.sparkContext.broadcast(np.array([known[w] for w in number], np.uint64))
    sent = spark.sparkContext.broadcast(number)

    def numbered(batches):
        get = sent.value.get
        for b in batches:
            for part in in_chunks(b.text.str.len().tolist(), CHARS):
                own = b.iloc[part]
                found = [Counter(array("i", [x for w in ws if (x := get(w)) is not None]).tobytes() for ws in sentences(t)) for t in own.text]
                yield own[["doc_id", "lang", "areas"]].assign(sentences=[list(c) for c in found], times=[list(c.values()) for c in found])

    kind = "doc_id long, lang string, areas array<int>, sentences array<binary>, times array<int>"
    texts = lookup(text, tagged, "doc_id").select("doc_id", "lang", "text", "areas").mapInPandas(numbered, kind)
    texts = stage(texts.withColumn("row", F.monotonically_increasing_id()), "p9-texts")
    # Labelled documents expected to hold a sentence, by how many of its language's unlabelled ones do.
    none = F.col("areas").isNull()
    worth = texts.groupBy("lang").agg((F.count_if(~none) / F.count_if(none)).alias("worth"))
    told = texts.join(small(stage(worth, "p9-worth")), "lang").select("doc_id", "areas", "worth", F.explode("sentences").alias("words"))
    # Area -1 is any label, -2 none; hot sentences are added up before they move.
    told = told.withColumn("area", F.explode(F.when(none, F.array(F.lit(-2))).otherwise(F.concat("areas", F.array(F.lit(-1))))))
    told = told.groupBy("words", "area").agg(F.count("*").alias("n"), F.sum("worth").alias("expected"), F.min("doc_id").alias("doc"))
    unlabelled, any_label = F.col("area") == -2, F.col("area") == -1
    told = told.groupBy("words").agg(
        F.coalesce(F.sum(F.when(any_label, F.col("n"))), F.lit(0)).cast("int").alias("times"),
        F.max(F.when(unlabelled, F.least("n", F.col("expected") + 1e-9))).alias("missed"),
        F.coalesce(F.min(F.when(any_label, F.col("doc"))), F.min("doc")).alias("doc"),
        F.collect_list(F.when(F.col("area") >= 0, F.struct("area", "n"))).alias("areas"),
    )
    # What documents without a label have so often that some with one would have it too, if it treated an area, treats none.
    none = (F.col("times") == 0) & (F.coalesce("missed", F.lit(0.0)) >= MISSED)
    fold = F.pmod(F.xxhash64("doc"), F.lit(FOLDS)).cast("int")
    told = stage(told.select("words", "times", none.alias("none"), fold.alias("fold"), F.col("areas.area").alias("areas"), F.col("areas.n").alias("ns")), "p9-sentences")
    size = told.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("bytes")).head()
    if not size.n:
        return None
    several = max(-(-size.n // PART_ROWS), -(-size.bytes // (4 * PART_WORDS)))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["fold", "words"])
        own = g[g.times > 0]
        y = np.zeros((len(own), k), np.float32)
        for i, (areas, ns, times) in enumerate(zip(own.areas, own.ns, own.times)):
            y[i, areas] = ns / times
        as_bytes = lambda x, kind: np.asarray(x, kind).tobytes()
        return pd.DataFrame({"words": [b"".join(g.words)], "n": [as_bytes(g.words.str.len() // 4, np.int32)], "times": [as_bytes(g.times, np.int32)],
                             "y": [y.tobytes()], "none": [as_bytes(g.none, bool)], "fold": [as_bytes(g.fold, np.int8)]})

    parts = told.groupBy(F.pmod(F.xxhash64("words"), F.lit(several)).alias("part")).applyInPandas(pack, "words binary, n binary, times binary, y binary, none binary, fold binary")
    parts = stage(parts, "p9-parts")
    models: list = []
    for r in range(ROUNDS):
        models.append(spark.sparkContext.broadcast(_trained(parts, codes, models, k, FOLDS, 3, r)))
    w = _trained(parts, codes, models, k, 1, 4, ROUNDS).dense()

    # Each labelled document's sentences, as the models of the last round see them that have not seen them.
    own = texts.filter("areas is not null").select("row", "areas", F.explode_outer(F.arrays_zip("sentences", "times")).alias("s")).select("row", "areas", "s.sentences", "s.times")
    own = lookup(own.withColumnRenamed("sentences", "words"), told.filter("times > 0").select("words", "fold"), "words")
    own = own.groupBy("row").agg(F.first("areas").alias("areas"), F.collect_list(F.when(F.col("words").isNotNull(), F.struct("words", "fold", "times"))).alias("s"))

    def tally(batches):
        last, total = models[-1].value, None
        for b in batches:
            for part in in_chunks([sum(map(len, ws)) for ws in b.words], CHARS):
                g = b.iloc[part]
                n = [len(x) for x in g.words]
                fold, times = (np.fromiter(itertools.chain.from_iterable(x), np.int64, sum(n)) for x in (g.fold, g.times))
                ws, by, odds = list(itertools.chain.from_iterable(g.words)), np.argsort(fold, kind="stable"), np.zeros((len(fold), k))
                odds[by] = last.score(_packed([ws[i] for i in by], codes.value), fold[by])
                ends = np.cumsum(n)
                truth = np.zeros((len(g), k), bool)
                for i, areas in enumerate(g.areas):
                    truth[i, areas] = True
                got = _tally(odds, [np.repeat(np.arange(a, e), times[a:e]) for a, e in zip([0, *ends[:-1]], ends)], truth)
                total = got if total is None else [x + y for x, y in zip(total, got)]
        if total is not None:
            yield pd.DataFrame({"counts": [np.concatenate([x.ravel() for x in total]).tolist()]})

    counts = own.select("areas", "s.words", "s.fold", "s.times").mapInPandas(tally, "counts array<long>")
    total = np.sum([r.counts for r in counts.collect()] or [np.zeros((2 * len(ODDS) * len(SHARES) + 1) * k, np.int64)], 0)
    hit, got = total[:-k].reshape(2, -1, k)
    return Areas(names, w, known, *_best(hit, got, total[-k:])), texts.select("doc_id", "sentences", "times")


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share): each area of each document with the share of its sentences that treat it.

    Null and empty texts have no area; without any label there is no classifier and no row. A whole text is
    read, however long.
    """
    got = _fit(documents, labels, subjects)
    if got is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, subject string, share double")
    model, texts = got
    sent = documents.sparkSession.sparkContext.broadcast((model, np.array([model.known[w] for w in sorted(model.known)], np.uint64)))

    def tell(batches):
        m, codes = sent.value
        for b in batches:
            for part in in_chunks([sum(map(len, ss)) for ss in b.sentences], CHARS):
                own = b.iloc[part]
                n = own.sentences.str.len().to_numpy(np.int64)
                times = np.fromiter(itertools.chain.from_iterable(own.times), np.int64, int(n.sum()))
                share = m.shares_of(_packed(list(itertools.chain.from_iterable(own.sentences)), codes), n, times)
                d, c = np.nonzero(share >= m.least - 1e-9)
                yield pd.DataFrame({"doc_id": own.doc_id.to_numpy()[d], "subject": [m.names[i] for i in c], "share": share[d, c]})

    return texts.mapInPandas(tell, "doc_id long, subject string, share double")


def area_report(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, documents, share): how many of all documents treat each area; areas without any have 0."""
    n = documents.count()
    got = subject_areas(documents, labels, subjects).groupBy("subject").agg(F.count("*").alias("documents"))
    return subjects.select("subject").join(got, "subject", "left").select(
        "subject", F.coalesce("documents", F.lit(0)).alias("documents"), (F.coalesce("documents", F.lit(0)) / F.lit(max(n, 1))).alias("share")
    )
