"""Collocations against plain counting, with prefixes that must be lengthened."""

import re
from collections import Counter

import pytest

from voxhive.llm import collocations as c


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or any(l2 == lang and len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                             for (l2, q), b in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        rows = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(rows[:top], 1)]
    return sorted(ranked)


def table(spark, rows):
    rows = [(i, t, lang, 7) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, win int").repartition(3)


def run(docs, **how):
    return sorted(tuple(r) for r in c.collocations(docs, **how).collect())


ROWS = [
    ("en", "New York City is big. New York City, never York; a a a a a a a\tb"), ("en", "the New York Times of new york city"),
    ("fr", "pomme de terre: pomme de terre\x0bDE TERRE ÉTÉ été"), (None, "x y z x y z\r\n x y z"), ("en", None), ("en", ""),
    ("und", "x y z"), ("zh", "漢 字 漢 字 漢 字"), ("en", " ... "), ("en", "the cat and the hat and the bat and the \x01 mat \x01 mat"),
] * 3 + [("de", "der Hund " * 5000)]


@pytest.mark.parametrize("budget", [None, 4, 1])
def test_equals_plain_counting(spark, monkeypatch, budget):
    monkeypatch.setattr(c, "LEAST", 3)
    monkeypatch.setattr(c, "HELD", 20)
    got = run(table(spark, ROWS), budget=budget)
    assert got == plain(ROWS, 3, 2000)
    assert len(got) > 10


def test_first_rows_of_each_language(spark, monkeypatch):
    monkeypatch.setattr(c, "LEAST", 2)
    got = run(table(spark, ROWS), top=2)
    assert got == plain(ROWS, 2, 2)


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(c, "LEAST", 3)
    monkeypatch.setattr(c, "BITS", 6)
    assert run(table(spark, ROWS)) == plain(ROWS, 3, 2000)


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    phrases = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 7)], "lang string, phrase string, k int, a long")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    row = c.scored(phrases, totals).collect()[0]
    assert row.score == 1000 * big * 9 * big // ((big + 1) * (big + 7))


def test_empty_table(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string, lang string")) == []


def test_what_a_task_remembers_is_bounded_over_languages(monkeypatch):
    """Counts leave in pieces and a language's counts go with them; answers of all languages share one bound."""
    monkeypatch.setattr(c, "HELD", 10)
    monkeypatch.setattr(c, "PIECE", 3)
    counts = {lang: Counter({f"{lang}{i}": i for i in range(1, 8)}) for lang in ("de", "en")}
    assert c._full(counts) and not c._full({"de": counts["de"]})
    want = {(lang, w): n for lang, held in counts.items() for w, n in held.items()}
    got = {}
    for lang, some in c._drained(counts):
        assert len(some) <= 3 and lang not in counts
        got.update({(lang, w): n for w, n in some})
    assert got == want and not counts
    memories = [c._Known(str) for _ in range(3)]
    for known in memories:
        for i in range(4):
            known[i]
    c._forget(memories[:2])
    assert [len(known) for known in memories] == [4, 4, 4]
    c._forget(memories)
    assert [len(known) for known in memories] == [0, 0, 0]


def test_pairs_and_windows_are_counted_by_arrays(spark, monkeypatch):
    """Hashes meet the filter as they do one by one; equal windows are one row, also where keys clash; frames leave in pieces."""
    import numpy as np

    monkeypatch.setattr(c, "BITS", 8)
    rng = np.random.default_rng(3)
    kept = c.Filter(rng.integers(0, 1 << 63, 4).astype(np.uint64))
    h = rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(3)
    assert kept.holds(h).tolist() == [int(x) in kept for x in h] and 0 < kept.holds(h).sum() < 500
    rows = rng.integers(0, 3, (400, 5)).astype(np.int32)
    got, n = c._summed(rows)
    total = Counter()
    for row, times in zip(got.tolist(), n.tolist()):
        total[tuple(row)] += times
    assert total == Counter(map(tuple, rows.tolist()))
    got, n = c._summed(rows[:0])
    assert got.shape == (0, 5) and len(n) == 0
    monkeypatch.setattr(c, "PIECE", 7)
    assert [len(f) for f in c._pieces(n=np.arange(16))] == [7, 7, 2]


def test_numbers_forgotten_between_texts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(c, "LEAST", 3)
    monkeypatch.setattr(c, "HELD", 3)
    monkeypatch.setattr(c, "RUN", 5)
    monkeypatch.setattr(c, "GATHERED", 4)
    assert run(table(spark, ROWS)) == plain(ROWS, 3, 2000)


def test_language_without_a_frequent_word(spark, monkeypatch):
    monkeypatch.setattr(c, "LEAST", 3)
    rows = [*ROWS, ("it", "una volta sola"), ("pt", None), ("ro", " . ")]
    assert run(table(spark, rows)) == plain(rows, 3, 2000)
