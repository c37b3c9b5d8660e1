"""Collocations: phrases of two to five words scored by their weakest cut, counted by vertical partitioning.

Three passes over the texts.  The first counts words, the second pairs of frequent
words; what is frequent goes into two bit filters of fixed size.  A filter never
misses a frequent word or pair (a false hit only costs work), so the third pass can break
texts at everything that no candidate holds and emits one window of at most five words
per position left: the truncated suffixes.

Windows are partitioned vertically: every first word is a prefix, prefixes with more
different windows than a task's budget are lengthened by a word until they fit, and
prefixes are packed into groups of about one budget.  Each group builds its depth-truncated
suffix subtree on its own; a phrase's count is the sum of the leaves under its node.
Nodes above a lengthened prefix are summed over groups.

Edge cases: null texts count as empty, a null language is `und`; texts of any length;
equal texts and repeated ids all count; an empty table gives no rows; ties are broken by
count and then by the UTF-8 bytes of the phrase; columns beside ``lang`` and ``text`` are not read.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxhive.llm.common import running_total, stage
from voxhive.session import broadcast_if_small, spread

#: Longest phrase in words, least count of a candidate, phrases reported per language.
DEPTH, LEAST, TOP = 5, 100, 2000
#: Different windows that one group may hold.
BUDGET = 500_000
#: Different keys that a task counts before it passes them on, and answers that it remembers, of all languages together.
HELD = 400_000
#: Keys that leave a task in one frame.
PIECE = 50_000
#: Characters that are numbered at a time (a longer text is taken whole), pairs or windows that a task gathers before it sums them.
RUN, GATHERED = 1_000_000, 2_500_000
#: Bits of a filter (8 MB, whatever the corpus).
BITS = 26
SALTS = 64

BREAK = b"\xff"  # no byte of UTF-8
_FOLD = bytes(
    255 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words of a text in lower case, with a BREAK between pieces."""
    return text.encode("utf-8", "replace").translate(_FOLD).replace(BREAK, b" \xff ").split()


def _hash(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Filter:
    """Two bits per key in a table of ``2**BITS`` bits."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bytes, self.mask = table.astype("<u8").tobytes(), (1 << BITS) - 1

    def __contains__(self, h: int) -> bool:
        low, high = h & self.mask, h >> BITS & self.mask
        return bool(self.bytes[low >> 3] >> (low & 7) & self.bytes[high >> 3] >> (high & 7) & 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        """The same for many hashes."""
        mask, six = np.uint64(self.mask), np.uint64(6)
        low, high = h & mask, h >> np.uint64(BITS) & mask
        bits = self.table[low >> six] >> (low & np.uint64(63)) & self.table[high >> six] >> (high & np.uint64(63))
        return (bits & np.uint64(1)).astype(bool)


def filter_of(hashes: DataFrame, column: str) -> Filter:
    """Filter over a column of 64-bit hashes; Spark sets the bits, at most ``2**BITS / 64`` numbers reach the driver."""
    mask = F.lit((1 << BITS) - 1).cast("long")
    places = F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(F.col(column), BITS).bitwiseAND(mask))
    cells = (
        hashes.select(F.explode(places).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        .toPandas()
    )
    table = np.zeros(1 << BITS >> 6, np.uint64)
    table[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    return Filter(table)


class _Known(dict):
    """Answers of ``ask``, remembered until ``_forget``."""

    def __init__(self, ask):
        super().__init__()
        self.ask = ask

    def __missing__(self, key):
        answer = self[key] = self.ask(key)
        return answer


def _full(counts: dict[str, Counter]) -> bool:
    return sum(map(len, counts.values())) > HELD


def _drained(counts: dict[str, Counter]) -> Iterator[tuple[str, list[tuple]]]:
    """(language, up to ``PIECE`` keys with their counts) until ``counts`` is empty; a language is let go as soon as it is out."""
    while counts:
        lang, held = counts.popitem()
        rows = iter(held.items())
        while some := list(islice(rows, PIECE)):
            yield lang, some


def _forget(memories: list[_Known]) -> None:
    """Clear the answers of all languages once they are more than ``HELD`` together."""
    if sum(map(len, memories)) > HELD:
        for known in memories:
            known.clear()


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two words, from theirs."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return h ^ h >> np.uint64(32)


class _Numbers:
    """A task's numbers for the frequent words of a language, from 1; 0 is a rare word or the end of a piece."""

    def __init__(self, lang: str, kept: Filter):
        self.seed, self.kept = _hash(lang.encode(), 0), kept
        self.of = _Known(self._ask)
        self.clear()

    def _ask(self, word: bytes) -> int:
        h = _hash(word, self.seed)
        if word == BREAK or h not in self.kept:
            return 0
        self.words.append(word.decode() + " ")
        self.hashes.append(h)
        return len(self.words) - 1

    def __len__(self) -> int:
        return len(self.of)

    def clear(self) -> None:
        self.of.clear()
        self.words, self.hashes, self.table = [""], [0], np.zeros(1, np.uint64)

    def runs(self, texts: pd.Series) -> Iterator[np.ndarray]:
        """Numbers of the words of all texts, a few texts at a time, each text and the last one ended by 0."""
        some, size = [], 0
        for text in [*texts, None]:
            if text is not None:
                some.append(text)
                size += len(text) + 1
            if some and (text is None or size > RUN):
                words = words_of(".".join(some))
                yield np.append(np.fromiter(map(self.of.__getitem__, words), np.int64, len(words)), 0)
                some, size = [], 0

    def pairs(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words with another frequent one behind them, and the hashes of these pairs."""
        at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
        self.table = np.append(self.table, np.array(self.hashes[len(self.table):], np.uint64))
        return at, pair_hash(self.table[seq[at]], self.table[seq[at + 1]])


def _summed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and how often each stands there; rows of one key that meet in turns are told apart and stay several."""
    key = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        key = (key + column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    rows = rows[np.argsort(key)]
    first = np.flatnonzero(np.r_[len(rows) > 0, (rows[1:] != rows[:-1]).any(axis=1)])
    return rows[first], np.diff(np.r_[first, len(rows)])


def _pieces(**columns) -> Iterator[pd.DataFrame]:
    for at in range(0, len(columns["n"]), PIECE):
        yield pd.DataFrame({name: values[at:at + PIECE] for name, values in columns.items()})


def _by_language(frame: pd.DataFrame) -> Iterator[tuple[str, pd.Series]]:
    yield from frame.groupby("lang", sort=False)["text"]


def count_words(docs: DataFrame) -> DataFrame:
    """lang, h (hash of a word in its language), n of every word that occurs LEAST times; h null: all words of the language."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}

        def out() -> Iterator[pd.DataFrame]:
            for lang, some in _drained(counts):
                seed = _hash(lang.encode(), 0)
                some = [(_signed(_hash(w, seed)), n) for w, n in some if w != BREAK]
                yield pd.DataFrame({
                    "lang": np.full(len(some) + 1, lang, object), "h": pd.array([None, *[h for h, _ in some]], "Int64"),
                    "n": np.array([sum(n for _, n in some), *[n for _, n in some]], np.int64),
                })

        for frame in frames:
            for lang, texts in _by_language(frame):
                held = counts.setdefault(lang, Counter())
                for text in texts:
                    held.update(words_of(text))
                    if _full(counts):
                        yield from out()
                        held = counts.setdefault(lang, Counter())
        yield from out()

    sums = docs.mapInPandas(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    return stage(sums.where(F.col("h").isNull() | (F.col("n") >= LEAST)), "words")


def count_pairs(docs: DataFrame, words) -> DataFrame:
    """h (hash of two words in their language) of every pair of frequent words that occurs LEAST times."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers: dict[str, _Numbers] = {}
        gathered: list[np.ndarray] = []
        kept, size = Filter(words.value), 0

        def out() -> Iterator[pd.DataFrame]:
            h, n = np.unique(np.concatenate(gathered), return_counts=True)
            gathered.clear()
            yield from _pieces(h=h.view(np.int64), n=n)

        for frame in frames:
            for lang, texts in _by_language(frame):
                if lang not in numbers:
                    numbers[lang] = _Numbers(lang, kept)
                for seq in numbers[lang].runs(texts):
                    _, found = numbers[lang].pairs(seq)
                    gathered.append(found)
                    size += len(found)
                    _forget([*numbers.values()])
                    if size > GATHERED:
                        yield from out()
                        size = 0
        if gathered:
            yield from out()

    return docs.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def windows(docs: DataFrame, words, pairs) -> DataFrame:
    """lang, win (up to DEPTH frequent words, a blank behind each), n: the truncated suffixes and how often they occur."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers: dict[str, _Numbers] = {}
        gathered: dict[str, list[np.ndarray]] = {}
        alone: dict[str, list[np.ndarray]] = {}
        kept_words, kept_pairs, size = Filter(words.value), Filter(pairs.value), 0

        def out() -> Iterator[pd.DataFrame]:
            for lang in [*alone]:
                spoken = np.array(numbers[lang].words, object)
                ones = np.bincount(np.concatenate(alone.pop(lang)))
                at = np.flatnonzero(ones)
                yield from _pieces(lang=np.full(len(at), lang, object), win=spoken[at], n=ones[at])
                rows, n = _summed(np.concatenate(gathered.pop(lang)))
                win = spoken[rows[:, 0]]
                for column in rows.T[1:]:
                    win = win + spoken[column]
                yield from _pieces(lang=np.full(len(win), lang, object), win=win, n=n)

        for frame in frames:
            for lang, texts in _by_language(frame):
                if lang not in numbers:
                    numbers[lang] = _Numbers(lang, kept_words)
                own = numbers[lang]
                for seq in own.runs(texts):
                    at, found = own.pairs(seq)
                    on = np.zeros(len(seq) + DEPTH, bool)
                    on[at[kept_pairs.holds(found)]] = True
                    start = np.flatnonzero(on)
                    alone.setdefault(lang, []).append(seq[(seq > 0) & ~on[:len(seq)]].astype(np.int32))
                    rows, go = np.zeros((len(start), DEPTH), np.int32), np.ones(len(start), bool)
                    rows[:, 0] = seq[start]
                    for k in range(1, DEPTH):
                        go &= on[start + k - 1]
                        rows[go, k] = seq[start[go] + k]
                    gathered.setdefault(lang, []).append(rows)
                    size += len(rows) + len(alone[lang][-1]) // DEPTH
                    crowded = sum(map(len, numbers.values())) > HELD
                    if size > GATHERED or crowded:
                        yield from out()
                        size = 0
                    if crowded:  # no gathered row has a number any more
                        _forget([*numbers.values()])
        yield from out()

    sums = docs.mapInPandas(run, "lang string, win string, n long").groupBy("lang", "win").agg(F.sum("n").alias("n"))
    return stage(sums, "windows")


def first_words(phrase: Column, k: Column | int) -> Column:
    return F.substring_index(phrase, F.lit(" "), k) if isinstance(k, int) else F.call_function("substring_index", phrase, F.lit(" "), k)


def vertical_groups(found: DataFrame, budget: int | None = None) -> DataFrame:
    """Add ``depth`` (words of the row's prefix) and ``part``: prefixes lengthened until they fit, then packed."""
    budget = budget or BUDGET
    rows = found.withColumn("depth", F.lit(1))
    for depth in range(1, DEPTH):
        long = (
            rows.where(F.col("depth") == depth).groupBy("lang", F.substring_index("win", " ", depth).alias("prefix"))
            .count().where(F.col("count") > budget).select(F.col("lang").alias("_lang"), F.col("prefix").alias("_prefix"))
        )
        long = stage(long, "prefixes")
        if long.isEmpty():
            break
        hit = (F.col("lang") == F.col("_lang")) & (F.substring_index("win", " ", depth) == F.col("_prefix")) & (F.col("depth") == depth)
        rows = rows.join(broadcast_if_small(long), hit, "left").withColumn(
            "depth", F.when(F.col("_prefix").isNotNull(), depth + 1).otherwise(F.col("depth"))).drop("_lang", "_prefix")
    rows = rows.withColumn("prefix", F.call_function("substring_index", F.col("win"), F.lit(" "), F.col("depth")))
    sizes = rows.groupBy("lang", "prefix", "depth").agg(F.count("*").alias("rows")).withColumn("all", F.lit(0))
    packed = running_total(sizes, "all", ["lang", "prefix", "depth"], "rows", "before").select(
        F.col("lang").alias("_lang"), F.col("prefix").alias("_prefix"), F.floor(F.col("before") / budget).alias("part"))
    packed = stage(packed.distinct(), "groups")
    return rows.join(broadcast_if_small(packed), (F.col("lang") == F.col("_lang")) & (F.col("prefix") == F.col("_prefix"))).select(
        "part", "lang", "win", "n", "depth")


def subtree(frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the suffix subtree of one group: lang, phrase, k words, a (sum of its leaves), top (above the group's prefix)."""
    order = frame.sort_values(["lang", "win"], kind="stable")
    path: list[str] = []
    totals: list[int] = []
    tops: list[bool] = []
    nodes: list[tuple] = []
    last = None

    def leave(k: int) -> None:
        while len(path) > k:
            total, top = totals.pop(), tops.pop()
            if top or total >= LEAST:
                nodes.append((last, " ".join(path), len(path), total, top))
            if totals:
                totals[-1] += total
            path.pop()

    for lang, win, n, depth in zip(order["lang"], order["win"], order["n"], order["depth"]):
        words = win[:-1].split(" ")
        shared = 0
        if lang == last:
            for a, b in zip(path, words):
                if a != b:
                    break
                shared += 1
        leave(shared)
        last = lang
        for k in range(shared, len(words)):
            path.append(words[k])
            totals.append(0)
            tops.append(k + 1 < depth)
        totals[-1] += n
    leave(0)
    return pd.DataFrame(nodes, columns=["lang", "phrase", "k", "a", "top"])


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a) of all phrases of 1 to DEPTH words that occur LEAST times, and (lang, n) words of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    counted = count_words(rows)
    words = spark.sparkContext.broadcast(filter_of(counted.where(F.col("h").isNotNull()), "h").table)
    pairs = spark.sparkContext.broadcast(filter_of(count_pairs(rows, words), "h").table)
    parts = vertical_groups(windows(rows, words, pairs), budget)
    nodes = stage(
        spread(parts, "part").groupBy("part").applyInPandas(subtree, "lang string, phrase string, k int, a long, top boolean"), "nodes")
    upper = nodes.where("top").groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).where(F.col("a") >= LEAST)
    phrases = stage(nodes.where(~F.col("top")).select("lang", "phrase", "k", "a").union(upper), "phrases")
    return phrases, counted.where(F.col("h").isNull()).select("lang", "n")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with the parts l, r and the score of their weakest cut; those inside an equally frequent longer one are gone."""
    part = phrases.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("a").alias("_n"))
    longer = (
        phrases.where(F.col("k") > 2)
        .select("lang", "a", F.explode(F.array(
            F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k") - 1),
            F.call_function("substring_index", F.col("phrase"), F.lit(" "), 1 - F.col("k")))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    )
    many = phrases.where(F.col("k") > 1).join(longer, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (F.col("_longer") < F.col("a"))).drop("_longer")
    cuts = (
        many.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
        .withColumn("_left", F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("cut")))
        .withColumn("_right", F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("cut") - F.col("k")))
        .join(part.withColumnRenamed("_n", "l"), (F.col("lang") == F.col("_lang")) & (F.col("_left") == F.col("_part"))).drop("_lang", "_part")
        .join(part.withColumnRenamed("_n", "r"), (F.col("lang") == F.col("_lang")) & (F.col("_right") == F.col("_part"))).drop("_lang", "_part")
        .join(broadcast_if_small(totals), "lang")
    )

    def wide(c: str) -> Column:
        return F.col(c).cast("decimal(20,0)")

    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")), wide("l") * wide("r"))
    weakest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(weakest).select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP, budget: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    phrases, totals = frequent_phrases(docs, lang, text, budget)
    rows = scored(phrases, totals)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most candidates: each salt keeps its own first ones before they meet.
    some = Window.partitionBy("lang", "salt").orderBy(*order)
    best = (
        rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        .withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    )
    whole = Window.partitionBy("lang").orderBy(*order)
    return best.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


ROWS_SQL = f"""
WITH words AS (
  SELECT coalesce(lang, 'und') AS lang,
         list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), f AS (
  SELECT lang, k, phrase, count(*) AS a
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS t(k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, phrase, k, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS lp,
         array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS rp
  FROM f, range(1, 5) AS c(j) WHERE j < k
), best AS (
  SELECT c.lang, c.phrase, c.k, c.a, x.a AS l, y.a AS r, t.n,
         ((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp
  JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.j) = 1
), inner_ones AS (
  SELECT DISTINCT s.lang, s.phrase FROM f s JOIN f b ON b.lang = s.lang AND b.k > s.k AND s.k > 1 AND b.a >= s.a
    AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best ANTI JOIN inner_ones USING (lang, phrase)
QUALIFY rank <= 2000
"""
