"""Exact substring deduplication with suffix sorting (multikey sort to a shallow depth, then blind tries).

A byte goes if it lies in a string of ``LENGTH`` bytes that starts earlier as well.

1. Winnowing: the least hash of a ``GRAM``-byte gram in each window is its anchor.
   Equal strings have equal anchors, so strings without a repeated anchor are unique.
   A fragment is the run of starts that share one anchor, with the bytes they cover.
2. Fragments meet by anchor.  A fragment that occurs again (equal bytes) is marked
   whole, without its bytes being moved; only different fragments of one anchor go on.
3. Their bytes are fetched and all their suffixes sorted, in buckets of bounded size:
   a multikey sort with eight-byte characters to ``SHALLOW`` bytes, blind tries for
   groups with a longer common prefix.  Leaves are the classes of equal strings; all
   but the first member of a class are marked.  Strings of an anchor with more than
   ``CROWDED`` different fragments are not sorted: the first place of each string is a
   least value that tasks find for themselves before the shuffle, and every other place
   is marked by a join with it, so no task holds all places of a string.
4. Marks are merged per document and cut out of its text.

Copies inside one batch of a task are marked there, so a text that fills a third of
the corpus sends one row per batch to the shuffle.

Edge cases: null and empty texts, and texts under ``LENGTH`` bytes, lose nothing;
null ids stand before all others; rows that share an id are ordered by a hash of
their text, and rows that share id and text are one document with one result each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxhive.llm.common import partitions, running_total, set_aside, stage

LENGTH = 100
GRAM = 32
SHALLOW = 32
CHUNK = 1 << 20
#: Bytes of text whose fragments are compared inside a task before the shuffle.
BATCH = 12_000_000
#: Suffixes per sorting bucket, and different fragments of an anchor above which its strings meet by hash (128 bits) instead.
BUCKET = 400_000
CROWDED = 10_000

BASE = 0x9E3779B97F4A7C15 | 1
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Roller:
    """Hashes of all substrings of a chunk by prefix sums modulo 2**64."""

    def __init__(self):
        self.up = _powers(BASE, CHUNK + LENGTH + 1)
        self.down = _powers(pow(BASE, -1, 1 << 64), CHUNK + LENGTH + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=out[1:], dtype=np.uint64)
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (sums[stop] - sums[start]) * self.down[start]
        h ^= h >> np.uint64(29)
        h *= _SPREAD
        return h ^ (h >> np.uint64(32))


def fragments(data: np.ndarray, roll: Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, fragment hash, first start and number of starts of every fragment of one text."""
    parts = []
    for at in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        chunk = data[at:at + CHUNK + LENGTH - 1]
        sums = roll.sums(chunk)
        grams = np.arange(len(chunk) - GRAM + 1)
        h = roll.between(sums, grams, grams + GRAM)
        place = np.uint64((1 << 21) - 1)
        least = (h & ~place) | grams.astype(np.uint64)  # the leftmost of equal hashes is the least
        width, span = LENGTH - GRAM + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[:span - width], least[width - span:])
        anchor = (least & place).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        count = np.diff(np.r_[first, len(anchor)])
        anchor = anchor[first]
        whole = roll.between(sums, first, first + count + LENGTH - 1)
        whole ^= (count.astype(np.uint64) * _SPREAD) ^ ((anchor - first).astype(np.uint64) << np.uint64(48))
        parts.append((h[anchor], whole, first + at, count))
    if not parts:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    return tuple(np.concatenate(p) for p in zip(*parts))


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal disjoint runs (touching ones join)."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[first], reach[np.r_[first[1:] - 1, len(start) - 1]]


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, np.ndarray]]]:
    held, size = [], 0
    for frame in frames:
        for doc, text in zip(frame["doc"], frame["text"]):
            data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            if len(data) >= LENGTH:
                held.append((doc, data))
                size += len(data)
            if size > BATCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def list_fragments(docs: DataFrame) -> DataFrame:
    """(anchor, whole, doc, start, count, mark): fragments first seen in their batch; marks for the others, as intervals."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = Roller()
        for batch in _batches(frames):
            batch.sort(key=lambda b: b[0])
            found = [fragments(data, roll) for _, data in batch]
            doc = np.repeat(np.array([d for d, _ in batch], np.int64), [len(f[0]) for f in found])
            anchor, whole, start, count = (np.concatenate(p) for p in zip(*found))
            order = np.lexsort((np.arange(len(whole)), whole, anchor))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (anchor[order[1:]] == anchor[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
            new = ~again
            yield pd.DataFrame({
                "anchor": anchor[new].view(np.int64), "whole": whole[new].view(np.int64), "doc": doc[new],
                "start": start[new], "count": count[new], "mark": False,
            })
            if again.any():
                doc, start, stop = doc[again], start[again], start[again] + count[again] + LENGTH - 1
                edges = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])])
                low, high = start[edges], stop[np.r_[edges[1:] - 1, len(stop) - 1]]
                # an own key per interval: it meets nothing in the shuffle
                key = (doc[edges].astype(np.uint64) * np.uint64(BASE) + low.astype(np.uint64)) * _SPREAD
                yield pd.DataFrame({
                    "anchor": key.view(np.int64), "whole": key.view(np.int64), "doc": doc[edges], "start": low,
                    "count": high - low, "mark": True,
                })

    return docs.select("doc", "text").mapInPandas(
        scan, "anchor long, whole long, doc long, start long, count long, mark boolean")


def multikey_groups(words: np.ndarray, starts: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes, and where each group of ties begins; single ones are left out.

    Every pass splits all groups at once by the next eight-byte character.
    """
    live, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    begins = np.zeros(min(1, len(live)), np.int64)
    for at in range(0, depth, 8):
        character = words[starts[live] + at]
        order = np.lexsort((character, group))
        live, group, character = live[order], group[order], character[order]
        first = np.r_[True, (group[1:] != group[:-1]) | (character[1:] != character[:-1])] if len(live) else np.empty(0, bool)
        number = np.cumsum(first) - 1
        tied = np.bincount(number, minlength=1)[number] > 1 if len(live) else np.empty(0, bool)
        live, group = live[tied], number[tied]
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(live) else np.empty(0, np.int64)
    return live, begins


def blind_trie(keys: list[int]) -> list[int]:
    """Leaf number of each key in a blind (binary Patricia) trie; equal keys share a leaf.

    Inner nodes hold only the bit they branch on: a key walks down blindly, is compared
    with the leaf it reaches, and enters where the first differing bit belongs.
    """
    leaves, bit, zero, one, out, root = [keys[0]], [], [], [], [0], -1
    for key in keys[1:]:
        node = root
        while node >= 0:
            node = one[node] if key >> bit[node] & 1 else zero[node]
        differs = key ^ leaves[~node]
        if not differs:
            out.append(~node)
            continue
        top = differs.bit_length() - 1
        above, node = -1, root
        while node >= 0 and bit[node] > top:
            above, node = node, one[node] if key >> bit[node] & 1 else zero[node]
        leaf = ~len(leaves)
        leaves.append(key)
        out.append(~leaf)
        bit.append(top)
        zero.append(node if key >> top & 1 else leaf)
        one.append(leaf if key >> top & 1 else node)
        new = len(bit) - 1
        if above < 0:
            root = new
        elif key >> bit[above] & 1:
            one[above] = new
        else:
            zero[above] = new
    return out


def string_classes(text: bytes, starts: np.ndarray) -> np.ndarray:
    """Class number of the ``LENGTH``-byte string at each start; -1 for strings that no other start has."""
    data = np.frombuffer(text + bytes(8), np.uint8)
    words = np.zeros(len(text), np.uint64)
    for i in range(8):
        words |= data[i:i + len(text)].astype(np.uint64) << np.uint64(56 - 8 * i)
    live, begins = multikey_groups(words, starts)
    out, used = np.full(len(starts), -1, np.int64), 0
    ends = [*begins[1:].tolist(), len(live)]
    at = starts[live].tolist()
    for first, last in zip(begins.tolist(), ends):
        leaf = np.array(blind_trie([int.from_bytes(text[s:s + LENGTH], "big") for s in at[first:last]]))
        shared = np.bincount(leaf)[leaf] > 1  # a tie of the shallow sort can still be the only one of its kind
        out[live[first:last][shared]] = leaf[shared] + used
        used += last - first
    return out


def later_copies(docs: np.ndarray, starts: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, stop) intervals of the strings in the fragments that occur earlier in another one or the same."""
    sizes = np.array([len(r) for r in raw], np.int64)
    counts = sizes - LENGTH + 1
    fragment = np.repeat(np.arange(len(raw)), counts)
    inside = np.arange(len(fragment)) - np.repeat(np.cumsum(counts) - counts, counts)
    classes = string_classes(b"".join(raw), (np.cumsum(sizes) - sizes)[fragment] + inside)
    place = starts[fragment] + inside
    shared = np.flatnonzero(classes >= 0)
    order = shared[np.lexsort((place[shared], docs[fragment[shared]], classes[shared]))]
    later = np.zeros(len(fragment), bool)
    if len(order):
        later[order[1:]] = classes[order[1:]] == classes[order[:-1]]
    hit = np.flatnonzero(later)
    if not len(hit):
        return docs[:0], starts[:0], starts[:0]
    first = np.r_[True, (np.diff(hit) > 1) | (fragment[hit[1:]] != fragment[hit[:-1]])]
    begin, end = hit[first], hit[np.r_[first[1:], True]]
    return docs[fragment[begin]], place[begin], place[end] + LENGTH


def candidates(docs: DataFrame) -> DataFrame:
    """The fragments of ``list_fragments`` whose anchor occurs again, and all its marks.

    Fragments are listed twice, first for the anchors that repeat; the copies found inside a batch may differ
    between the two, but the first fragment of its kind is always listed.
    """
    again = list_fragments(docs).where("not mark").groupBy(F.col("anchor").alias("a_anchor")).agg(F.count(F.lit(1)).alias("n"))
    repeated = stage(again.where("n > 1").select("a_anchor"), "anchors")
    met = list_fragments(docs).join(repeated, F.col("anchor") == F.col("a_anchor"), "left")
    return stage(met.where("mark or a_anchor is not null").drop("a_anchor"), "candidates")


def first_places(strings: DataFrame) -> DataFrame:
    """(doc, start, stop) of every string but the first place of each; tasks find their least places before the shuffle."""
    first = strings.groupBy(F.col("h0").alias("f0"), F.col("h1").alias("f1")).agg(
        F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    least = stage(first.where("n > 1").select("f0", "f1", "first"), "first")
    met = strings.join(least, (F.col("h0") == F.col("f0")) & (F.col("h1") == F.col("f1")))
    return met.where(F.struct("doc", "start") != F.col("first")).select("doc", "start", (F.col("start") + LENGTH).alias("stop"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, spans): per document with any, the intervals to remove, possibly overlapping, from (doc, text)."""
    n = partitions(docs.sparkSession)
    found = candidates(docs)
    listed = found.where("not mark")
    wholes = stage(listed.groupBy("anchor", "whole").agg(
        F.min(F.struct("doc", "start", "count")).alias("first"), F.count(F.lit(1)).alias("n")), "wholes")
    copied = wholes.where("n > 1").select(F.col("anchor").alias("w_anchor"), F.col("whole").alias("w_whole"), "first")
    again = listed.join(copied, (F.col("anchor") == F.col("w_anchor")) & (F.col("whole") == F.col("w_whole"))).where(
        "doc <> first.doc or start <> first.start")
    whole = found.where("mark").select("doc", "start", (F.col("start") + F.col("count")).alias("stop")).union(
        again.select("doc", "start", (F.col("start") + F.col("count") + LENGTH - 1).alias("stop")))
    kinds = wholes.groupBy(F.col("anchor").alias("k_anchor")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = stage(wholes.join(kinds, F.col("anchor") == F.col("k_anchor")).select("anchor", "first.*", "kinds"), "mixed")
    buckets = max(n, -(-(mixed.where(F.col("kinds") <= CROWDED).agg(F.sum("count")).first()[0] or 0) // BUCKET))

    def fetched(part: DataFrame, rows_of, columns: str) -> DataFrame:
        """What ``rows_of`` (anchor, doc, start, bytes) makes of the fragments, whose bytes are fetched from their texts."""
        names = [c.split()[0] for c in columns.split(", ")]

        def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for doc, text, wanted in zip(frame["doc"], frame["text"], frame["wanted"]):
                    data = text.encode("utf-8", "surrogatepass")
                    for w in wanted:
                        rows += rows_of(w["anchor"], doc, w["start"], data[w["start"]:w["start"] + w["count"] + LENGTH - 1])
                        if len(rows) > 50_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

        wanted = part.groupBy(F.col("doc").alias("w_doc")).agg(F.collect_list(F.struct("anchor", "start", "count")).alias("wanted"))
        met = docs.select("doc", "text").join(wanted, F.col("doc") == F.col("w_doc"))
        return met.select("doc", "text", "wanted").mapInPandas(fetch, columns)

    def piece(anchor: int, doc: int, start: int, raw: bytes) -> list[tuple]:
        return [(anchor % buckets, doc, start, raw)]

    def strings(anchor: int, doc: int, start: int, raw: bytes) -> list[tuple]:
        digests = (xxhash.xxh3_128_digest(raw[i:i + LENGTH]) for i in range(len(raw) - LENGTH + 1))
        return [(int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), doc, start + i) for i, d in enumerate(digests)]

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        doc, start, stop = later_copies(frame["doc"].to_numpy(), frame["start"].to_numpy(), frame["raw"].tolist())
        return pd.DataFrame({"doc": doc, "start": start, "stop": stop})

    pieces = fetched(mixed.where(F.col("kinds") <= CROWDED), piece, "bucket long, doc long, start long, raw binary")
    out = whole.union(
        pieces.repartition(int(buckets), "bucket").groupBy("bucket").applyInPandas(sort, "doc long, start long, stop long"))
    crowded = mixed.where(F.col("kinds") > CROWDED)
    if not crowded.isEmpty():
        out = out.union(first_places(stage(fetched(crowded, strings, "h0 long, h1 long, doc long, start long"), "strings")))
    marks = stage(out, "marks")
    return marks.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``doc``, a number that orders documents as the rule says (the id itself where ids are unique), and one row of each document."""
    ids = docs.agg(
        F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.count_distinct("doc_id").alias("different")
    ).first()
    if ids["n"] == ids["known"] == ids["different"]:
        known = docs.withColumn("doc", F.col("doc_id").cast("long"))
        return known, known
    tie = F.xxhash64("text")
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.col("doc_id").isNotNull().cast("int").alias("known"), tie.alias("tie"))
    keys = keys.distinct().withColumn("all", F.lit(0)).withColumn("one", F.lit(1))
    rank = running_total(keys, "all", ["known", "id", "tie"], "one", "doc").select(
        F.col("id").alias("k_id"), F.col("known").alias("k_known"), F.col("tie").alias("k_tie"), F.col("doc").cast("long").alias("doc"))
    same = (
        (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) == F.col("k_id"))
        & (F.col("doc_id").isNotNull().cast("int") == F.col("k_known")) & (tie == F.col("k_tie"))
    )
    known = docs.join(rank, same).drop("k_id", "k_known", "k_tie")
    return known, known.dropDuplicates(["doc"])


def cut_repeats(docs: DataFrame, out: str = "cut", with_text: bool = False) -> DataFrame:
    """Add a struct of n_bytes, n_removed, n_spans, kept_sha256 (and the bytes that stay) to every document."""
    rows, columns = set_aside(docs, "doc_id", "text")
    known, once = numbered(rows)
    spans = repeated_spans(once).select(F.col("doc").alias("s_doc"), "spans")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, marks in zip(texts, spans):
            data = (text or "").encode("utf-8", "surrogatepass")
            start = stop = np.empty(0, np.int64)
            if marks is not None and len(marks):
                start, stop = merged(*np.array([(m["start"], m["stop"]) for m in marks], np.int64).T)
            keep = zip([0, *stop.tolist()], [*start.tolist(), len(data)])
            kept = b"".join(data[a:b] for a, b in keep)
            row = (len(data), int((stop - start).sum()), len(start), hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept) if with_text else row)
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:4 + with_text])

    met = known.join(spans, F.col("doc") == F.col("s_doc"), "left")
    return met.withColumn("result", cut(F.col("text"), F.col("spans"))).select(*columns, F.col("result").alias(out))
