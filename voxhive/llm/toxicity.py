"""Toxicity by a weighted lexicon: folded texts, Aho-Corasick matches, exception phrases, length-normalised scores.

Folding undoes what hides a word: compatibility forms, case, invisible characters,
look-alike letters of other scripts, digits and signs standing for letters.

The lexicon is learned.  Entries are words, and word beginnings that several words
share.  An entry's weight is the log ratio of its share of toxic and of clean documents.
Support is counted in effective contexts (inverse concentration of the neighbouring
words), so copies of one text do not vote as many.  Phrases around an entry that clean
documents use are exceptions: matches inside them do not count.

Learning reads at most ``SAMPLE`` labelled rows per class and fold, taken by a hash of
doc_id; two folds of the training rows choose the entries, another one fits the three
coefficients that turn weight and weight per word into a probability.

Edge cases: null and empty texts hold no entry and get the score of such texts.  Rows
with a null id are held out.  Several labels of one id count as the highest; null labels
are no labels.  Without training labels every score is 0.0.  Long texts are scored whole;
equal texts get equal scores; other columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from voxhive.llm.common import stage

#: Labelled rows per class and fold that learning reads.
SAMPLE = 20_000
#: Lengths of word beginnings; least documents of an entry; entries looked at and kept.
BEGINNINGS = (4, 5, 6)
SUPPORT = 3
CANDIDATES, ENTRIES, EXCEPTIONS = 50_000, 5_000, 2_000
HELD = 200_000

# Letters of other scripts that look like a Latin one.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s",
    "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ѵ": "v", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r",
}
# Digits and signs written for a letter; signs only between letters or digits.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

_ALIKE, _DIGIT = str.maketrans(LOOKALIKES), str.maketrans(DIGITS)
_SIGN = re.compile(r"(?<=[^\W_])[@$!|€](?=[^\W_])")
_TOKEN = re.compile(r"[^\W_]+")


def fold_word(word: str) -> str:
    """Folded words inside one run of non-blanks, separated by a blank."""
    if not (word.isascii() and word.isalpha()):
        word = unicodedata.normalize("NFKC", word)
        word = "".join(c for c in word if unicodedata.category(c) not in ("Cf", "Mn", "Me"))
    word = word.lower()
    if word.isascii() and word.isalpha():
        return word
    word = _SIGN.sub(lambda m: SIGNS[m[0]], word.translate(_ALIKE))
    return " ".join(t.translate(_DIGIT) if any(c.isalpha() for c in t) else t for t in _TOKEN.findall(word))


class Folder:
    """Folds whole texts, remembering the words it has seen."""

    def __init__(self):
        self.known: dict[str, str] = {}

    def __call__(self, text: str | None) -> str:
        words = (text or "").split()
        known = self.known
        if len(known) > HELD:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = fold_word(w)
        folded = " ".join([f for w in words if (f := known[w])])
        return f" {folded} " if folded else " "


def features(word: str) -> Iterator[str]:
    """Patterns that can stand for a folded word: itself, and its beginnings (without the closing blank)."""
    yield f" {word} "
    for k in BEGINNINGS:
        if len(word) > k:
            yield f" {word[:k]}"


@dataclass
class Lexicon:
    """Pattern -> weight, exception patterns, and the coefficients of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, ...] | None = None

    def automaton(self):
        matcher = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            matcher.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            matcher.add_word(phrase, (len(phrase), None))
        if len(matcher):
            matcher.make_automaton()
        return matcher


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.matcher, self.fold = lexicon, lexicon.automaton(), Folder()

    def hits(self, folded: str) -> dict[int, float]:
        """Start of each matched word and the greatest weight found there, exception phrases left out."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(self.matcher):
            for end, (length, weight) in self.matcher.iter(folded):
                start = end - length + 1
                if weight is None:
                    spared.append((start, end))
                elif weight > found.get(start, 0.0):
                    found[start] = weight
        if spared and found:
            # Exceptions come by their ends; a word inside one starts before that end.
            found = {s: w for s, w in found.items() if not any(a <= s < b for a, b in spared)}
        return found

    def measures(self, text: str | None, folded: bool = False) -> tuple[float, float, float]:
        """log weight, log weight per 100 words, and whether anything matched."""
        body = text if folded else self.fold(text)
        total, words = sum(self.hits(body).values()), max(body.count(" ") - 1, 1)
        return math.log1p(total), math.log1p(100 * total / words), float(total > 0)

    def score(self, text: str | None) -> float:
        if self.lexicon.coefficients is None:
            return 0.0
        z = float(np.dot(self.lexicon.coefficients, (1.0, *self.measures(text))))
        return 1 / (1 + math.exp(-max(min(z, 500), -500)))


def fold_of(doc_id: Column) -> Column:
    """Remainder of the id's CRC-32 by five; 0 is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def sampled(docs: DataFrame, labels: DataFrame, sample: int, doc_id: str, text: str, label: str) -> tuple[DataFrame, dict]:
    """Folded texts of at most ``sample`` training rows per class and fold (``fit``: coefficients), and the sizes of all classes."""
    rows = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("_id")).agg((F.max(label) > 0).alias("_toxic"))
        .withColumn("_fold", fold_of(F.col("_id"))).where(F.col("_fold") != 0)
        .withColumn("_fit", F.col("_fold") == 4).select("_id", "_toxic", "_fit")
    )
    rows = stage(rows, "labels")
    sizes = {(r["_toxic"], r["_fit"]): r["n"] for r in rows.groupBy("_toxic", "_fit").agg(F.count("*").alias("n")).collect()}
    parts = [rows.where((F.col("_toxic") == F.lit(t)) & (F.col("_fit") == F.lit(f))).orderBy(F.xxhash64("_id"), "_id").limit(sample)
             for t in (False, True) for f in (False, True)]
    chosen = F.broadcast(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))  # at most four samples of ids
    met = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(chosen, "_id").select("_toxic", "_fit", "_text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Folder()
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["_toxic"], "fit": frame["_fit"], "body": frame["_text"].map(fold).astype(object)})

    return stage(met.mapInPandas(run, "toxic boolean, fit boolean, body string"), "sample"), sizes


def _tally(rows: DataFrame, keys_of, state=None) -> DataFrame:
    """(key, n): over rows, how often ``keys_of(body)`` lists each key; tasks add up before the shuffle.

    With ``state``, every task calls it once and hands the result to ``keys_of`` as well.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        more = (state(),) if state else ()
        for frame in frames:
            for body in frame["body"]:
                counts.update(keys_of(body, *more))
                if len(counts) > HELD:
                    yield pd.DataFrame({"key": list(counts), "n": list(counts.values())})
                    counts.clear()
        yield pd.DataFrame({"key": np.array(list(counts), object), "n": np.array(list(counts.values()), np.int64)})

    return rows.mapInPandas(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, limit: int) -> dict[str, int]:
    return {r["key"]: r["n"] for r in counts.orderBy(F.desc("n"), "key").limit(limit).collect()}


def surprise(p: float, n: float, toxic: int, clean: int) -> float:
    """Likelihood-ratio statistic of p toxic and n clean documents against the class sizes; negative if toxic is the rarer side."""
    share = toxic / (toxic + clean)
    expected = (p + n) * share, (p + n) * (1 - share)
    g = 2 * sum(x * math.log(x / e) for x, e in zip((p, n), expected) if x > 0)
    return g if p > expected[0] else -g


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), sample: int = SAMPLE, doc_id: str = "doc_id",
          text: str = "text", label: str = "toxic") -> Lexicon:
    """Lexicon, exception phrases (given ones first) and coefficients from the training rows."""
    rows, sizes = sampled(docs, labels, sample, doc_id, text, label)
    counts = {(r["toxic"], r["fit"]): r["n"] for r in rows.groupBy("toxic", "fit").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get((True, False), 0), counts.get((False, False), 0)
    spared = [f" {' '.join(Folder()(p).split())} " for p in exceptions]
    lexicon = Lexicon(exceptions=spared)
    if not counts:
        return lexicon
    if toxic and clean:
        lexicon.weights = _entries(rows, toxic, clean)
        lexicon.exceptions += _exceptions(rows, lexicon, toxic, clean)
    _fit(rows, lexicon, counts, sizes)
    return lexicon


def _entries(rows: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    learning = rows.where(~F.col("fit"))
    bad, good = learning.where("toxic"), learning.where(~F.col("toxic"))

    def different(body: str) -> set[str]:
        return {f for w in set(body.split()) for f in features(w)}

    seen = _top(_tally(bad, different).where(F.col("n") >= SUPPORT), CANDIDATES)
    if not seen:
        return {}
    asked = rows.sparkSession.sparkContext.broadcast(frozenset(seen))
    fair = _top(_tally(good, lambda body: different(body) & asked.value), CANDIDATES)
    # One in a hundred candidates without any meaning would pass by chance, at most.
    least = 2 * math.log(100 * len(seen))
    passed = {f: p for f, p in seen.items() if surprise(p, fair.get(f, 0), toxic, clean) >= least}
    asked = rows.sparkSession.sparkContext.broadcast(frozenset(passed))

    def places(body: str) -> list[str]:
        words, out = body.split(), []
        for i, w in enumerate(words):
            near = None
            for f in features(w):
                if f in asked.value:
                    if near is None:
                        near = xxhash.xxh64_hexdigest(" ".join((words[i - 1] if i else "", "", *words[i + 1:i + 2])))
                    out.append(f + "\n" + near)
        return out

    met = _tally(bad, places).withColumn("f", F.substring_index("key", "\n", 1)).groupBy("f").agg(
        (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("contexts"))
    support = {r["f"]: min(passed[r["f"]], r["contexts"]) for r in met.collect()}
    strong = {f: (p, surprise(p, fair.get(f, 0), toxic, clean)) for f, p in support.items()}
    strong = {f: v for f, v in strong.items() if v[1] >= least}
    # A beginning stands only where clearly more than its most frequent word is behind it.
    best: dict[str, float] = defaultdict(float)
    for f, (p, _) in strong.items():
        if f.endswith(" "):
            for start in features(f.strip()):
                best[start] = max(best[start], p)
    kept = [f for f, (p, _) in strong.items() if f.endswith(" ") or p >= 1.5 * best[f]]
    kept = sorted(kept, key=lambda f: (-strong[f][1], f))[:ENTRIES]
    return {f: math.log((strong[f][0] + 0.5) / (toxic + 1)) - math.log((fair.get(f, 0) + 0.5) / (clean + 1)) for f in kept}


def _exceptions(rows: DataFrame, lexicon: Lexicon, toxic: int, clean: int) -> list[str]:
    """Two-word phrases around an entry that clean documents hold more often than their share."""
    learning, shared = rows.where(~F.col("fit")), rows.sparkSession.sparkContext.broadcast(lexicon)

    def phrases(body: str, scorer: Scorer) -> set[str]:
        out = set()
        for start in scorer.hits(body):
            stop = body.find(" ", start + 1)
            before, behind = body.rfind(" ", 0, start), body.find(" ", stop + 1)
            if before >= 0:
                out.add(body[before:stop + 1])
            if behind >= 0:
                out.add(body[start:behind + 1])
        return out

    good = _top(_tally(learning.where(~F.col("toxic")), phrases, lambda: Scorer(shared.value)).where(F.col("n") >= SUPPORT), EXCEPTIONS)
    if not good:
        return []
    asked = rows.sparkSession.sparkContext.broadcast(frozenset(good))
    bad = _top(
        _tally(learning.where("toxic"), lambda body, scorer: phrases(body, scorer) & asked.value, lambda: Scorer(shared.value)), EXCEPTIONS)
    return sorted(p for p, n in good.items() if bad.get(p, 0) * clean < n * toxic)


def _fit(rows: DataFrame, lexicon: Lexicon, counts: dict, sizes: dict) -> None:
    """Logistic coefficients by Newton steps on the fold kept for it (on the other one if that is empty)."""
    fit = any(f for _, f in counts)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for frame in frames:
            m = [scorer.measures(b, folded=True) for b in frame["body"]]
            out = pd.DataFrame(m, columns=["a", "b", "c"], dtype=float)
            yield out.assign(toxic=frame["toxic"].to_numpy())

    seen = rows.where(F.col("fit") == F.lit(fit)).mapInPandas(measure, "a double, b double, c double, toxic boolean").toPandas()
    seen = seen.sort_values(["a", "b", "c", "toxic"])  # sums do not depend on the order of tasks
    x = np.column_stack([np.ones(len(seen)), seen[["a", "b", "c"]].to_numpy(float)])
    y = seen["toxic"].to_numpy(float)
    # A sampled class weighs as all of its rows.
    weight = np.where(y > 0, sizes.get((True, fit), 0) / max(y.sum(), 1), sizes.get((False, fit), 0) / max((1 - y).sum(), 1))
    beta = np.zeros(4)
    ridge = np.diag([1e-6, 0.1, 0.1, 0.1])
    beta[0] = math.log(((weight * y).sum() + 0.5) / ((weight * (1 - y)).sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        slope = x.T @ (weight * (y - p)) - ridge @ beta
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge
        step = np.linalg.solve(bend, slope)
        beta += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    lexicon.coefficients = tuple(float(b) for b in beta)


def with_scores(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """Add the toxicity of every whole text under a learned or given lexicon."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield texts.map(scorer.score, na_action=None).astype(float)

    return docs.withColumn(out, score(F.col(text)))


def scored(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document under the lexicon learned from the training labels."""
    lexicon = learn(docs, labels, exceptions, doc_id=doc_id, text=text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    done = with_scores(rows, lexicon, "_text").withColumn("held_out", fold_of(F.col("doc_id")) == 0)
    return done.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def matches(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, word (folded), weight: the matched words of every text, one row per match."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for frame in frames:
            for key, body in zip(frame["_id"], frame["_text"]):
                folded = scorer.fold(body)
                found = sorted(scorer.hits(folded).items())
                if found:
                    words = [folded[s + 1:folded.find(" ", s + 1)] for s, _ in found]
                    yield pd.DataFrame({"_id": [key] * len(found), "word": words, "weight": [w for _, w in found]})

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, word string, weight double").withColumnRenamed("_id", doc_id)
