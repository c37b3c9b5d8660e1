"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest merged with a heap over linked bytes.

The rank file is a parameter.  Its perfect hash (hash and displace) has exactly one
slot per vocabulary entry; a pre-token that hits its own bytes is one token.  All
others are merged, cheapest pair first, leftmost on ties, as byte-level BPE defines.

Edge cases: a null or empty text has no tokens and the digest of nothing; long
texts are encoded in runs of pre-tokens; equal texts give equal ids.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Different pre-tokens a task remembers before the older half goes.
MEMORY = 150_000
#: Characters that are split into pre-tokens at a time.
RUN = 1_000_000
TRIES = 1 << 12


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in rank order from a rank file."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    vocabulary = [base64.b64decode(token) for token, _ in sorted(pairs, key=lambda p: int(p[1]))]
    if [int(r) for _, r in sorted(pairs, key=lambda p: int(p[1]))] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return vocabulary


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


def _slots(hashes: np.ndarray, displacement: np.ndarray, size: int) -> np.ndarray:
    """Slot of each hash under its displacement (broadcasting)."""
    x = hashes + displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of ``keys``: every key has its own slot among ``len(keys)``.

    Buckets are placed from the largest on; the last, single keys take the slots
    that are left, written as negative displacements.
    """

    def __init__(self, keys: list[bytes] | None = None, state: tuple[np.ndarray, np.ndarray] | None = None):
        if state:
            self.displacement, self.key_at = state
        else:
            self._build(keys)

    def _build(self, keys: list[bytes]) -> None:
        size, hashes = len(keys), _hashes(keys)
        if len(np.unique(hashes)) != size:
            raise ValueError("keys must differ")
        buckets = max(1, size // 4)
        of = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=buckets)
        ends = np.cumsum(counts)
        self.displacement = np.zeros(buckets, np.int64)
        self.key_at = np.full(size, -1, np.int64)
        for b in np.argsort(-counts, kind="stable"):
            members = order[ends[b] - counts[b]:ends[b]]
            if len(members) < 2:
                break
            first = 0
            while True:
                tries = np.arange(first, first + TRIES)
                slots = _slots(hashes[members][None, :], tries[:, None], size)
                ranked = np.sort(slots, axis=1)
                good = (self.key_at[slots] < 0).all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    break
                first += TRIES
            at = int(np.argmax(good))
            self.displacement[b] = first + at
            self.key_at[slots[at]] = members
        free = iter(np.flatnonzero(self.key_at < 0))
        for b in np.flatnonzero(counts == 1):
            slot = next(free)
            self.displacement[b] = -1 - slot
            self.key_at[slot] = order[ends[b] - 1]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of the one key each probe could be; the caller compares."""
        hashes = _hashes(keys)
        moved = self.displacement[(hashes % np.uint64(len(self.displacement))).astype(np.int64)]
        slots = np.where(moved < 0, -1 - moved, _slots(hashes, np.maximum(moved, 0), len(self.key_at)))
        return self.key_at[slots]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: linked byte pieces, pairs in a heap by (rank, place)."""
    n = len(word)
    end, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        if not middle or middle == n or end[middle] != stop:
            continue  # one of the two pieces has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank(word[i:end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        left = before[i]
        if left >= 0 and (r := rank(word[left:stop])) is not None:
            heappush(heap, (r, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:end[i]]])
        i = end[i]
    return ids


#: What a task keeps of a different pre-token: ids, their decimals joined by blanks, the bytes the ids decode to.
Fact = tuple[tuple[int, ...], str, bytes]


class Encoder:
    """Encodes runs of pre-tokens; facts of the last ``MEMORY`` to twice ``MEMORY`` different pre-tokens are kept."""

    def __init__(self, vocabulary: list[bytes], pattern: str, table: PerfectHash | None = None):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern)
        self.table = table or PerfectHash(vocabulary)
        self.ranks = {token: i for i, token in enumerate(vocabulary)}
        self.numerals = [str(i) for i in range(len(vocabulary))]
        self.known: dict[str, Fact] = {}
        self.older: dict[str, Fact] = {}

    def _fact(self, ids: tuple[int, ...]) -> Fact:
        numerals, vocabulary = self.numerals, self.vocabulary
        return ids, " ".join([numerals[i] for i in ids]), b"".join([vocabulary[i] for i in ids])

    def learn(self, pretokens: set[str]) -> None:
        new = pretokens - self.known.keys()
        if not new:
            return
        if len(self.known) > MEMORY:
            self.known, self.older, new = {}, self.known, pretokens
        for text in new & self.older.keys():
            self.known[text] = self.older[text]
        new = list(new - self.known.keys())
        words = [p.encode("utf-8", "surrogatepass") for p in new]
        for text, word, i in zip(new, words, self.table.find(words).tolist()):
            self.known[text] = self._fact((i,) if self.vocabulary[i] == word else tuple(merge(word, self.ranks)))

    def runs(self, text: str) -> Iterator[list[str]]:
        if len(text) <= RUN:
            yield self.split.findall(text)
            return
        found = (m.group() for m in self.split.finditer(text))
        while run := list(islice(found, RUN // 8)):
            yield run

    def facts(self, run: list[str]) -> list[Fact]:
        return list(map(self.known.__getitem__, run))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for run in self.runs(text or ""):
            self.learn(set(run))
            out += chain.from_iterable([ids for ids, _, _ in self.facts(run)])
        return out


def encoded(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            with_ids: bool = False) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256, decoded_sha256 (and the ids) of every whole text.

    A task holds one batch of texts, the pre-tokens of ``RUN`` characters and
    twice ``MEMORY`` different pre-tokens at a time; results leave in as small batches.
    An empty table gives no rows, repeated rows each their own.
    """
    vocabulary = read_ranks(rank_path)
    built = PerfectHash(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, built.displacement, built.key_at))
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kinds = {"n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()}
    if with_ids:
        kinds["ids"] = ArrayType(IntegerType())
    schema = StructType([*rows.schema.fields[:-1], *[StructField(k, t) for k, t in kinds.items()]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, displacement, key_at = shared.value
        coder = Encoder(tokens, pattern, PerfectHash(state=(displacement, key_at)))

        def result(batch: pa.RecordBatch, start: int, group: list[str]) -> pa.RecordBatch:
            counts, hashes, decoded, held = [], [], [], []
            parts = [list(coder.runs(t)) if len(t) <= RUN else None for t in group]
            coder.learn({p for runs in parts if runs for run in runs for p in run})
            for t, runs in zip(group, parts):
                ids_hash, text_hash, n, own = hashlib.sha256(), hashlib.sha256(), 0, []
                for run in runs if runs is not None else coder.runs(t):
                    if runs is None:
                        coder.learn(set(run))
                    if not run:
                        continue
                    ids, decimals, pieces = zip(*coder.facts(run))
                    ids_hash.update((" " * (n > 0) + " ".join(decimals)).encode())
                    text_hash.update(b"".join(pieces))
                    n += sum(map(len, ids))
                    if with_ids:
                        own.append(np.fromiter(chain.from_iterable(ids), np.int32))
                counts.append(n)
                hashes.append(ids_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
                held += own
            columns = [batch.column(c).slice(start, len(group)) for c in range(len(keep))]
            columns += [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = np.concatenate(held) if held else np.empty(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        # facts are many small tuples without cycles: the cycle collector would only walk them over and over
        collecting = gc.isenabled()
        gc.disable()
        try:
            for batch in batches:
                texts, start, group, size = batch.column(len(keep)), 0, [], 0
                for i in range(len(texts)):
                    group.append(texts[i].as_py() or "")
                    size += len(group[-1])
                    if size >= RUN or i == len(texts) - 1:
                        yield result(batch, start, group)
                        start, group, size = i + 1, [], 0
        finally:
            if collecting:
                gc.enable()

    return rows.mapInArrow(encode, schema)


def decode(ids: list[int], vocabulary: list[bytes]) -> bytes:
    return b"".join(map(vocabulary.__getitem__, ids))


def default_ranks(spark: SparkSession | None = None) -> tuple[str, str]:
    """Rank file and split pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
