"""Language identification with a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a segment of bytes from either end; a softmax over
both states labels every byte, and a document's probabilities are the mean over all
its bytes.  Texts are cut into segments of ``SEGMENT`` bytes, all of which are read.
The network is trained in numpy by backpropagation through time on at most
``PER_LANGUAGE`` windows per language, taken from the training fold in hash order.

Activations are the softsign x / (1 + |x|) and, for gates, its shift to [0, 1].

Edge cases: null texts and texts without a letter are ``und`` with score 0; without
a labelled training row everything is ``und``; equal texts get equal results; ties
between languages fall to the first in code point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SEGMENT = 128
HIDDEN = 8
#: Bound of the training sample: windows of SEGMENT bytes per language.
PER_LANGUAGE = 1500
STEPS, BATCH, RATE = 360, 192, 0.03
BLOCK = 2048
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """The test fold: a third of the ids by their check sum; null ids are not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def softsign(x: np.ndarray) -> np.ndarray:
    out = np.abs(x)
    out += 1
    np.divide(x, out, out=out)
    return out


class Reader:
    """One direction: gate inputs by byte (3H, 256) and recurrent weights (3H, H); rows are update, reset, candidate."""

    def __init__(self, table: np.ndarray, recur: np.ndarray):
        self.table, self.recur = table, recur

    @classmethod
    def fresh(cls, rng: np.random.Generator, hidden: int) -> Reader:
        table = rng.normal(0, 0.5, (3 * hidden, 256)).astype(np.float32)
        return cls(table, rng.normal(0, 0.4, (3 * hidden, hidden)).astype(np.float32))

    def run(self, columns: list[np.ndarray], keep: list | None = None) -> list[np.ndarray]:
        """States after each byte column (B,), in reading order; ``keep`` collects what the way back needs."""
        h = self.recur.shape[1]
        state = np.zeros((h, len(columns[0])), np.float32)
        states = []
        for column in columns:
            given = np.take(self.table, column, axis=1)
            past = self.recur @ state
            gates = given[:2 * h]
            gates += past[:2 * h]
            gates = softsign(gates)
            gates *= 0.5
            gates += 0.5
            update, reset = gates[:h], gates[h:]
            pre = past[2 * h:] * reset
            pre += given[2 * h:]
            candidate = softsign(pre)
            if keep is not None:
                keep.append((state, update, reset, past[2 * h:].copy(), candidate))
            candidate = candidate - state
            candidate *= update
            state = state + candidate
            states.append(state)
        return states

    def back(self, columns: list[np.ndarray], keep: list, d_states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and recur, through time."""
        h = self.recur.shape[1]
        d_table, d_recur = np.zeros_like(self.table), np.zeros_like(self.recur)
        carried = np.zeros_like(d_states[0])
        for t in range(len(columns) - 1, -1, -1):
            state, update, reset, past, candidate = keep[t]
            d = d_states[t] + carried
            slope = lambda y: (1 - np.abs(y)) ** 2  # noqa: E731  of softsign, from its value
            d_candidate = d * update * slope(candidate)
            d_update = d * (candidate - state) * 0.5 * slope(2 * update - 1)
            d_reset = d_candidate * past * 0.5 * slope(2 * reset - 1)
            d_pre = np.concatenate([d_update, d_reset, d_candidate * reset])
            carried = d * (1 - update) + self.recur.T @ d_pre
            d_recur += d_pre @ state.T
            given = np.concatenate([d_update, d_reset, d_candidate])
            hot = np.zeros((len(columns[t]), 256), np.float32)
            hot[np.arange(len(columns[t])), columns[t]] = 1
            d_table += given @ hot
        return d_table, d_recur


class Network:
    def __init__(self, languages: list[str], ahead: Reader, behind: Reader, out: np.ndarray, bias: np.ndarray):
        self.languages, self.ahead, self.behind, self.out, self.bias = languages, ahead, behind, out, bias

    def arrays(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.recur, self.behind.table, self.behind.recur, self.out, self.bias]

    @classmethod
    def of(cls, languages: list[str], arrays: list[np.ndarray]) -> Network:
        return cls(languages, Reader(*arrays[:2]), Reader(*arrays[2:4]), *arrays[4:])

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        out = rng.normal(0, 0.3, (len(languages), 2 * HIDDEN)).astype(np.float32)
        ahead, behind = (Reader.fresh(rng, HIDDEN) for _ in range(2))
        return cls(languages, ahead, behind, out, np.zeros((len(languages), 1), np.float32))

    def label(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Probabilities (L, B) at one position."""
        logits = self.out[:, :HIDDEN] @ first
        logits += self.out[:, HIDDEN:] @ second
        logits += self.bias
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def pooled(self, segments: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum of the labels over the bytes of each segment (N, T), longest first: (N, L)."""
        steps = int(lengths.max(initial=0))
        columns = [np.ascontiguousarray(segments[:, t]) for t in range(steps)]
        # read backwards from each segment's own end: shift shorter ones to the right edge
        shift = steps - lengths
        at = (np.arange(steps)[None, :] - shift[:, None]) % segments.shape[1]
        flushed = np.take_along_axis(segments, at, axis=1)
        from_end = self.behind.run([np.ascontiguousarray(flushed[:, t]) for t in range(steps - 1, -1, -1)])
        from_start = self.ahead.run(columns)
        total = np.zeros((len(self.languages), len(segments)), np.float32)
        same = not shift.any()
        ends = np.stack(from_end[::-1]) if not same else None
        for t in range(steps):
            if same:
                total += self.label(from_start[t], from_end[steps - 1 - t])
            else:
                place = np.minimum(t + shift, steps - 1)
                second = np.ascontiguousarray(ends[place, :, np.arange(len(segments))].T)
                total += self.label(from_start[t], second) * (t < lengths)
        return total.T

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 11) -> None:
        """Adam on the mean cross-entropy over all positions of full windows (N, T)."""
        rng = np.random.default_rng(seed)
        first, second = ([np.zeros_like(p) for p in self.arrays()] for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), min(batch, len(windows)))
            columns = [np.ascontiguousarray(c) for c in windows[pick].T]
            target = np.zeros((len(self.languages), len(pick)), np.float32)
            target[labels[pick], np.arange(len(pick))] = 1
            kept_a, kept_b = [], []
            a = self.ahead.run(columns, kept_a)
            b = self.behind.run(columns[::-1], kept_b)[::-1]
            d_out, d_bias = np.zeros_like(self.out), np.zeros_like(self.bias)
            d_a, d_b = [], []
            for x, y in zip(a, b):
                error = (self.label(x, y) - target) / (len(pick) * len(columns))
                d_out[:, :HIDDEN] += error @ x.T
                d_out[:, HIDDEN:] += error @ y.T
                d_bias += error.sum(axis=1, keepdims=True)
                d_a.append(self.out[:, :HIDDEN].T @ error)
                d_b.append(self.out[:, HIDDEN:].T @ error)
            slopes = [*self.ahead.back(columns, kept_a, d_a), *self.behind.back(columns[::-1], kept_b, d_b[::-1]), d_out, d_bias]
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(self.arrays(), slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """At most ``per_language`` full windows per language of the training fold, chosen and placed by hash."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(
        "lang", F.col("text").cast("binary").alias("body"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"),
    ).where(F.octet_length("body") >= SEGMENT)
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.empty((0, SEGMENT), np.uint8), np.empty(0, np.int64)
    # an expected half more than needed per language, then exactly the first ones in hash order
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, 1.5 * per_language / n) * (1 << 30)))])
    start = F.pmod(F.xxhash64("h"), F.octet_length("body") - (SEGMENT - 1)).cast("int") + 1
    near = usable.where(F.col("h") < share[F.col("lang")]).select(
        "lang", "h", F.substring(F.col("body"), start, F.lit(SEGMENT)).alias("window"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "window"))
    rows = near.withColumn("k", rank).where(F.col("k") <= per_language).select("lang", "h", "window").collect()
    rows.sort(key=lambda r: (r["lang"], r["h"], bytes(r["window"])))
    languages = sorted(sizes)
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, SEGMENT)
    return languages, windows, np.array([languages.index(r["lang"]) for r in rows])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    languages, windows, labels = training_windows(docs, per_language)
    if not languages:
        return None
    # every language weighs the same, however many windows it has
    counts = np.bincount(labels, minlength=len(languages))
    order = np.concatenate([np.resize(np.flatnonzero(labels == k), counts.max()) for k in range(len(languages)) if counts[k]])
    network = Network.fresh(languages)
    network.train(windows[order], labels[order])
    return network


def document_scores(network: Network, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities (N, L) over all bytes of each text; no text may be empty."""
    sizes = np.array([len(t) for t in texts])
    counts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), counts)
    padded = np.frombuffer(b"".join(t.ljust(c * SEGMENT, b" ") for t, c in zip(texts, counts)), np.uint8).reshape(-1, SEGMENT)
    lengths = np.full(len(owner), SEGMENT)
    lengths[np.cumsum(counts) - 1] = sizes - (counts - 1) * SEGMENT
    # full segments first, then the rests by length, so that blocks are nearly even
    order = np.argsort(-lengths, kind="stable")
    total = np.zeros((len(texts), len(network.languages)))
    for at in range(0, len(order), BLOCK):
        block = order[at:at + BLOCK]
        np.add.at(total, owner[block], network.pooled(padded[block], lengths[block]))
    return total / sizes[:, None]


def predicted(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score; only the text is read."""
    if network is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast((network.languages, network.arrays()))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, arrays = shared.value
        net = Network.of(languages, arrays)
        for texts in batches:
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            waiting, size = [], 0
            for i, t in enumerate([*texts, None]):
                if t and any(map(str.isalpha, t)):
                    waiting.append((i, t.encode("utf-8", "surrogatepass")))
                    size += len(waiting[-1][1])
                if waiting and (i == len(texts) or size > 4 * BLOCK * SEGMENT):
                    at = [w[0] for w in waiting]
                    p = document_scores(net, [w[1] for w in waiting])
                    best = p.argmax(axis=1)
                    names[at] = np.array(languages, object)[best]
                    scores[at] = np.clip(p[np.arange(len(at)), best], 0.0, 1.0)
                    waiting, size = [], 0
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn("_p", predict(F.col(text))).select("*", "_p.*").drop("_p")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    network = fit(docs)
    done = predicted(docs.select("doc_id", "text"), network)
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
