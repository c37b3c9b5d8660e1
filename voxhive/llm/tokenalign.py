"""Alignment of two public tokenizers over the same bytes, with corpus-wide link counts.

Tokenizer A is a byte-level BPE (`tokenizers`), B a BPE with byte fallback
(`sentencepiece`).  The character offsets of A and the proto spans of B give coarse
cuts; where a token ends inside a character (bytes of one character dealt to several
tokens, byte-fallback pieces) the decoded bytes of the tokens refine them.

Texts are cut into units before a single space or line feed between two other
characters.  No token of either vocabulary reaches over such a place (checked when the
files are loaded, else a text is one unit), so both end there and a unit that is known
already need not be encoded again.

A link is a pair of token occurrences that end at the same byte.  Its count needs the
whole corpus: each chunk of texts lists its different id pairs once, Spark adds them up,
and the answers go back to the chunk, not to every link.

Edge cases: null and empty texts, and texts whose tokens do not give the bytes of
space + text (a text with U+2581, for one), have no tokens: zeros and ''.  A text may be
of any length (it is one chunk of its own).  Equal texts and repeated ids are rows of
their own and their links all count.  An empty table gives no rows.  Columns of ``docs``
that are not kept are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType,
)

from voxhive.llm.common import stage
from voxhive.session import spread

#: Characters of text whose links are counted together; a longer text is a chunk of its own.
CHUNK = 8_000_000
#: Characters cut at a time, units encoded at a time, and units that a task remembers.
RUN = 500_000
BATCH = 2_000
MEMORY = 400_000
#: Units that are encoded alone when their common text does not give its bytes.
ALONE = 32

#: A unit in front of those that are encoded as one text; its tokens are dropped.
HEAD = " a"

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write for it: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def byte_level_entries(definition: str) -> tuple[dict[int, bytes], bool]:
    """Bytes of every id of a byte-level vocabulary, and whether its texts may be cut into units."""
    parsed, of = json.loads(definition), byte_alphabet()
    entries = {i: bytes(of[c] for c in token) for token, i in parsed["model"]["vocab"].items() if all(c in of for c in token)}
    first = parsed.get("pre_tokenizer") or {}
    return entries, first.get("type") == "ByteLevel" and first.get("use_regex", True) and not parsed.get("normalizer")


def piece_entries(processor) -> tuple[list[bytes], bool]:
    """Bytes of every piece, and whether texts may be cut into units: no piece has a blank after another character."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    coded = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) and processor.is_byte(i) else p.replace("▁", " ").encode()
             for i, p in enumerate(pieces)]
    return coded, not any("▁" in p.lstrip("▁") or " " in p or "\n" in p for p in pieces)


def exact_ends(coarse: np.ndarray, clean: np.ndarray, widths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Byte ends of tokens, many units at once: the coarse cut where it is clean, else the last clean one and the tokens' own bytes.

    ``first`` marks the first token of each unit; its unit starts at byte 0.
    """
    n = len(widths)
    total = np.cumsum(widths)
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    own = total - (total - widths)[begin]
    last = np.maximum.accumulate(np.where(clean, np.arange(n), -1))
    moved = np.where(last >= begin, coarse[last] - own[last], 0)
    return own + moved


class Unit(NamedTuple):
    """Tokens of one unit: their numbers, its groups as text, and the id pairs that end together (64-bit, packed)."""

    n_a: int
    n_b: int
    groups: str
    links: bytes


class Tokens(NamedTuple):
    """Tokens of many units: ids, number a unit and character offsets of A; ids with byte spans, number a unit of B; wrong units."""

    flat_a: np.ndarray
    size_a: np.ndarray
    places: np.ndarray
    spot: np.ndarray
    size_b: np.ndarray
    bad: np.ndarray


class Aligner:
    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a, cut_a = byte_level_entries(definition)
        self.bytes_b, cut_b = piece_entries(self.b)
        self.cuts = cut_a and cut_b
        self.width_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)], np.int64)
        self.width_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.blank = self.b.piece_to_id("▁")
        # Every id as text with each mark that may stand behind it.
        self.ids = 1 + max(len(self.width_a), len(self.width_b))
        self.marked = [f"{i}{mark}" for mark in ",|;" for i in range(self.ids)]
        self.marked_size = np.fromiter(map(len, self.marked), np.int64, len(self.marked))
        self.known: dict[str, tuple | None] = {}

    def units(self, text: str) -> list[str]:
        """Units of space + text; one that starts with a line feed follows another unit."""
        if not self.cuts:
            return [" " + text]
        if " ".join(text.split()) == text.replace("\n", " "):
            return [w if w[0] == "\n" else " " + w for w in text.replace("\n", " \n").split(" ")]
        return _CUT.split(" " + text)

    def _apart(self, units: list[str]) -> Tokens:
        """Tokens of every unit, each encoded alone; ``bad`` marks units whose tokens do not give their bytes."""
        n, raws = len(units), [u.encode() for u in units]
        coded = self.a.encode_batch(units, add_special_tokens=False)
        spans = self.b.encode([u if u[0] == "\n" else u[1:] for u in units], return_type="proto")
        inner = np.fromiter((u[0] == "\n" for u in units), bool, n)
        size_a = np.fromiter((len(c.ids) for c in coded), np.int64, n)
        flat_a = np.fromiter(chain.from_iterable(c.ids for c in coded), np.int64, int(size_a.sum()))
        places = np.fromiter(chain.from_iterable(chain.from_iterable(c.offsets for c in coded)), np.int64, 2 * len(flat_a)).reshape(-1, 2)
        pieces = [s.pieces for s in spans]
        size_b = np.fromiter(map(len, pieces), np.int64, n)
        spot = np.array([(p.id, p.begin, p.end) for own in pieces for p in own], np.int64).reshape(-1, 3)
        # The blank that B puts in front of every text belongs to no inner unit.
        heads = (np.cumsum(size_b) - size_b)[inner]
        blank = size_b[inner] > 0
        blank[blank] = spot[heads[blank], 0] == self.blank
        bad = np.zeros(n, bool)
        bad[np.flatnonzero(inner)[~blank]] = True
        spot = np.delete(spot, heads[blank], axis=0)
        size_b[np.flatnonzero(inner)[blank]] -= 1
        spot[:, 1:] += np.repeat(~inner, size_b)[:, None]

        def marked(flat: np.ndarray, sizes: np.ndarray, widths: np.ndarray, entries) -> None:
            given = np.bincount(np.repeat(np.arange(n), sizes), widths, n).astype(np.int64)
            joined = b"".join(map(entries.__getitem__, flat.tolist()))
            lengths = np.fromiter(map(len, raws), np.int64, n)
            if joined != b"".join(raws) or (given != lengths).any():
                stops = np.cumsum(given)
                for k, (stop, size) in enumerate(zip(stops.tolist(), given.tolist())):
                    if joined[stop - size:stop] != raws[k]:
                        bad[k] = True

        marked(flat_a, size_a, self.width_a[flat_a], self.bytes_a)
        marked(spot[:, 0], size_b, self.width_b[spot[:, 0]], self.bytes_b)
        return Tokens(flat_a, size_a, places, spot, size_b, bad)

    def _together(self, units: list[str]) -> Tokens | None:
        """Tokens of plain units (none blank inside at either end), encoded as one text; None where it does not give its bytes.

        Both tokenizers end a token wherever one unit meets the next, as in the texts the units are from.
        """
        text = HEAD + "".join(units)
        raw = text.encode()
        coded, pieces = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        ids_a = coded.ids
        spot = np.array([(p.id, p.begin, p.end) for p in pieces], np.int64).reshape(-1, 3)
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, spot[:, 0].tolist())) != raw:
            return None
        flat_a = np.array(ids_a, np.int64)
        places = np.fromiter(chain.from_iterable(coded.offsets), np.int64, 2 * len(flat_a)).reshape(-1, 2)
        chars = np.fromiter(map(len, units), np.int64, len(units))
        sizes = chars if len(raw) == len(text) else np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
        stops = len(HEAD) + np.concatenate([[0], np.cumsum(sizes)])

        def cut(ends: np.ndarray) -> np.ndarray | None:
            at = np.searchsorted(ends, stops)
            return at + 1 if (ends[at] == stops).all() else None

        cut_a, cut_b = cut(np.cumsum(self.width_a[flat_a])), cut(np.cumsum(self.width_b[spot[:, 0]]))
        if cut_a is None or cut_b is None:
            return None
        size_a, size_b = np.diff(cut_a), np.diff(cut_b)
        flat_a, places, spot = flat_a[cut_a[0]:], places[cut_a[0]:], spot[cut_b[0]:]
        places -= np.repeat(len(HEAD) + np.cumsum(chars) - chars, size_a)[:, None]
        spot[:, 1:] -= np.repeat(stops[:-1], size_b)[:, None] - 1
        return Tokens(flat_a, size_a, places, spot, size_b, np.zeros(len(units), bool))

    def _aligned(self, units: list[str], tokens: Tokens) -> list[tuple | None]:
        """The units' alignment, as in ``Unit``, None for a unit whose tokens do not give its bytes."""
        flat_a, size_a, places, spot, size_b, bad = tokens
        if bad.any():
            own_a, own_b = np.repeat(~bad, size_a), np.repeat(~bad, size_b)
            flat_a, places, spot = flat_a[own_a], places[own_a], spot[own_b]
            size_a, size_b = np.where(bad, 0, size_a), np.where(bad, 0, size_b)
        flat_b, n = spot[:, 0], len(units)

        def laid(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Unit of each token, first tokens of the units."""
            of = np.repeat(np.arange(n), sizes)
            first = np.zeros(len(of), bool)
            first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            return of, first

        (of_a, first_a), (of_b, first_b) = laid(size_a), laid(size_b)
        # Byte place of every character of the units, one after the other.
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        bytes_at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        char_at = np.cumsum([0, *map(len, units)])[:-1]
        coarse = bytes_at[char_at[of_a] + places[:, 1]] - bytes_at[char_at[of_a]]
        follows = np.append(first_a[1:], True)
        clean = follows | (np.append(places[1:, 0], 0) == places[:, 1])
        ends_a = exact_ends(coarse, clean, self.width_a[flat_a], first_a)
        ends_b = exact_ends(spot[:, 2], spot[:, 1] < spot[:, 2], self.width_b[flat_b], first_b)
        # Both keys rise from token to token.
        key_a, key_b = of_a << 32 | ends_a, of_b << 32 | ends_b
        near = np.searchsorted(key_b, key_a)
        near[near == len(key_b)] = 0
        meets = key_b[near] == key_a if len(key_b) else np.zeros(len(key_a), bool)
        at_a, at_b = np.flatnonzero(meets), near[meets]
        links = (flat_a[at_a] << 32 | flat_b[at_b]).tobytes()
        stops = np.searchsorted(of_a[at_a], np.arange(n + 1))
        # The last tokens of a unit meet, so groups take up all tokens: those of A, then those of B, each with the mark behind it.
        last_b = np.zeros(len(flat_b), bool)
        last_b[at_b] = True
        group_a, group_b = np.cumsum(meets) - meets, np.cumsum(last_b) - last_b
        behind = np.empty(len(flat_a) + len(flat_b), np.int64)
        behind[np.arange(len(flat_a)) + np.concatenate([[0], at_b + 1])[group_a]] = flat_a + self.ids * meets
        behind[np.arange(len(flat_b)) + at_a[group_b] + 1] = flat_b + 2 * self.ids * last_b
        groups = "".join(map(self.marked.__getitem__, behind.tolist()))
        tokens_to = np.concatenate([[0], np.cumsum(size_a + size_b)])
        chars_to = np.concatenate([[0], np.cumsum(self.marked_size[behind])])[tokens_to]
        out = [
            (n_a, n_b, groups[i:j - 1], links[8 * low:8 * high])
            for n_a, n_b, i, j, low, high in zip(
                size_a.tolist(), size_b.tolist(), chars_to[:-1].tolist(), chars_to[1:].tolist(), stops[:-1].tolist(), stops[1:].tolist())
        ]
        for k in np.flatnonzero(bad).tolist():
            out[k] = None
        return out

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.known]
        if new and len(self.known) > MEMORY:
            self.known.clear()
            new = list(units)
        plain, rest = [], []
        for u in new:
            (rest if not self.cuts or u[-1].isspace() or u[1:2].isspace() else plain).append(u)
        packs = [plain[at:at + BATCH] for at in range(0, len(plain), BATCH)]
        while packs:
            some = packs.pop()
            tokens = self._together(some)
            if tokens is not None:
                self.known.update(zip(some, self._aligned(some, tokens)))
            elif len(some) > ALONE:  # a wrong unit takes few others with it
                packs += [some[:len(some) // 2], some[len(some) // 2:]]
            else:
                rest += some
        for at in range(0, len(rest), BATCH):
            some = rest[at:at + BATCH]
            self.known.update(zip(some, self._aligned(some, self._apart(some))))

    def text(self, text: str | None) -> list[Unit] | None:
        """Units of one text, None where it has no tokens."""
        if not text:
            return None
        units = self.units(text)
        self.learn(set(units))
        found = [self.known[u] for u in units]
        return None if None in found else [Unit(*u) for u in found]


def load(spark, a_path: str, b_path: str):
    """Broadcast of the two vocabulary files (a few MB, whatever the corpus)."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def _chunks(shared, keep: int, names: list[str]):
    """Task function: rows of texts, and behind every chunk one row of its units, pairs and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        numbers: dict[str, int] = {}
        links: list[bytes] = []
        groups: list[str] = []
        known = np.empty((0, 4), np.int64)  # n_a, n_b, links of a unit, whether it has tokens
        uses = np.zeros(1 << 10, np.int64)
        serial, size = TaskContext.get().partitionId() << 32, 0

        def rows(head, counts, digests, used, chunk) -> pa.RecordBatch:
            n = len(counts)
            none = pa.nulls(n, pa.list_(pa.int64()))
            cells = [pa.array(np.full(n, chunk), pa.int64()), *head]
            cells += [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(COUNTS))]
            ends = np.concatenate([[0], np.cumsum([len(u) for u in used])]).astype(np.int32)
            flat = np.concatenate(used) if used else np.empty(0, np.int32)
            cells += [pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
            return pa.RecordBatch.from_arrays([*cells, none, none, pa.nulls(n, pa.list_(pa.int32()))], names=names)

        def closing(types) -> pa.RecordBatch:
            sizes = np.fromiter(map(len, links), np.int32, len(links)) // 8
            flat = np.frombuffer(b"".join(links), np.int64)
            pairs, at = np.unique(flat, return_inverse=True)
            held = np.bincount(at, np.repeat(uses[:len(links)], sizes), len(pairs)).astype(np.int64)
            cells = [pa.array([serial], pa.int64()), *[pa.nulls(1, t) for t in types]]
            cells += [pa.array([None], pa.int64())] * len(COUNTS) + [pa.array([None], pa.string())]
            cells += [pa.array([sizes], pa.list_(pa.int32())), pa.array([pairs], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64())),
                      pa.array([at.astype(np.int32)], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(cells, names=names)

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(c).type for c in range(keep)]
            texts, start, at = batch.column(keep), 0, 0
            while at < len(texts):
                group, length = [], 0
                while at < len(texts) and length < RUN:
                    group.append(texts[at].as_py() or "")
                    length += len(group[-1]) + 64
                    at += 1
                if size and size + length > CHUNK:
                    yield closing(types)
                    numbers.clear(), links.clear(), groups.clear(), uses.fill(0)
                    known = known[:0]
                    serial, size = serial + 1, 0
                size += length
                parts = [aligner.units(t) if t else [] for t in group]
                wanted = set(chain.from_iterable(parts)).difference(numbers)
                aligner.learn(wanted)
                facts = []
                for u in wanted:
                    numbers[u] = len(links)
                    n_a, n_b, text, own = aligner.known[u] or (0, 0, "", b"")
                    links.append(own), groups.append(text)
                    facts.append((n_a, n_b, len(own) // 8, n_a > 0))
                known = np.concatenate([known, np.array(facts, np.int64).reshape(-1, 4)])
                if len(links) > len(uses):
                    uses = np.concatenate([uses, np.zeros(len(links) + len(uses), np.int64)])
                counts, digests, used = [], [], []
                for part in parts:
                    own = np.fromiter(map(numbers.__getitem__, part), np.int32, len(part))
                    told = known[own]
                    if not len(part) or not told[:, 3].all():
                        counts.append((0, 0, 0, 0)), digests.append(""), used.append(np.empty(0, np.int32))
                        continue
                    n_a, n_b, n_links, _ = told.sum(axis=0).tolist()
                    counts.append((n_a, n_b, n_links, n_links))
                    digests.append(hashlib.sha256(";".join([groups[i] for i in own.tolist()]).encode()).hexdigest())
                    used.append(own)
                if used:
                    uses[:len(links)] += np.bincount(np.concatenate(used), minlength=len(links))
                yield rows([batch.column(c).slice(start, len(group)) for c in range(keep)], counts, digests, used, serial)
                start = at
        if size:
            yield closing(types)

    return run


def _answers(names: list[str]):
    """Task function: sums of the counts of its links for every text of one chunk."""

    def run(rows: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        books = rows[rows["_pairs"].notna()]
        docs = rows[rows["_pairs"].isna()]
        out = docs[names].copy()
        out["n_best"] = np.int64(0)
        out["count_sum"] = np.int64(0)
        if len(books) and len(answer):
            book = books.iloc[0]
            order = np.argsort(answer["_place"].to_numpy())
            total = answer["_total"].to_numpy(np.int64)[order]
            best = answer["_best"].to_numpy(np.int64)[order]
            sizes, at = np.asarray(book["_units"], np.int64), np.asarray(book["_at"], np.int64)
            stops = np.concatenate([[0], np.cumsum(sizes)])
            # Running sums over the links of all units: a unit's sum is a difference.
            sums = np.concatenate([[0], np.cumsum(total[at])])[stops]
            bests = np.concatenate([[0], np.cumsum(best[at])])[stops]
            unit_sum, unit_best = np.diff(sums), np.diff(bests)
            out["n_best"] = [int(unit_best[np.asarray(u, np.int64)].sum()) for u in docs["_units"]]
            out["count_sum"] = [int(unit_sum[np.asarray(u, np.int64)].sum()) for u in docs["_units"]]
        return out

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every whole text.

    Memory: a chunk's units and pairs in the first pass; one chunk's rows in the second.
    """
    shared = load(docs.sparkSession, a_path, b_path)
    rows = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    kept = [StructField(f.name, f.dataType, True) for f in rows.schema.fields[:-1]]
    whole = [*kept, *[StructField(c, LongType(), True) for c in COUNTS], StructField("groups_sha256", StringType(), True)]
    schema = StructType([
        StructField("_chunk", LongType()), *whole, StructField("_units", ArrayType(IntegerType())), StructField("_pairs", ArrayType(LongType())),
        StructField("_held", ArrayType(LongType())), StructField("_at", ArrayType(IntegerType())),
    ])
    found = stage(rows.mapInArrow(_chunks(shared, len(keep), schema.names), schema), "aligned")
    asked = (
        found.where(F.col("_pairs").isNotNull())
        .select("_chunk", F.posexplode(F.arrays_zip("_pairs", "_held")).alias("_place", "_link"))
        .select("_chunk", "_place", F.col("_link._pairs").alias("_pair"), F.col("_link._held").alias("_n"))
    )
    totals = asked.groupBy("_pair").agg(F.sum("_n").alias("_total")).withColumn("_b", F.col("_pair").bitwiseAND(0xFFFFFFFF))
    totals = stage(totals, "pairs")
    highest = totals.groupBy("_b").agg(F.max("_total").alias("_top"))
    judged = totals.join(highest, "_b").select("_pair", "_total", (F.col("_total") == F.col("_top")).cast("long").alias("_best"))
    answers = asked.join(judged, "_pair").select(F.col("_chunk").alias("_of"), "_place", "_total", "_best")
    names = [f.name for f in whole]
    out = StructType([*whole, StructField("n_best", LongType()), StructField("count_sum", LongType())])
    done = (
        spread(found, "_chunk").groupBy("_chunk").cogroup(spread(answers, "_of").groupBy("_of"))
        .applyInPandas(_answers(names), out)
    )
    return done.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], *COUNTS, "n_best", "count_sum", "groups_sha256")


def alignment_spans(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per group: its number in the text, its byte range in space + text and the token ids of both sides."""
    shared = load(docs.sparkSession, a_path, b_path)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    ids = ArrayType(IntegerType())
    schema = StructType([
        rows.schema["_key"], StructField("group", LongType()), StructField("start", LongType()), StructField("end", LongType()),
        StructField("a_ids", ids), StructField("b_ids", ids),
    ])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(*shared.value)
        for frame in frames:
            for key_of, body in zip(frame["_key"], frame["_text"]):
                out, last = [], 0
                for unit in aligner.text(body) or ():
                    for group in unit.groups.split(";"):
                        a, b = (list(map(int, side.split(","))) for side in group.split("|"))
                        end = last + int(aligner.width_a[a].sum())
                        out.append((key_of, len(out), last, end, a, b))
                        last = end
                if out:
                    yield pd.DataFrame(out, columns=schema.names)

    return rows.mapInPandas(run, schema).withColumnRenamed("_key", key)


def default_vocabularies() -> tuple[str, str]:
    """Files of the public byte-level and byte-fallback vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
