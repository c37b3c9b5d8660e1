import random
import zlib

import numpy as np
import pytest

from voxhive.llm import langid

WORDS = {"aa": ["kala", "tumo", "piri", "so"], "bb": ["schrei", "wurst", "und", "zäh"], "cc": ["año", "luz", "que", "niño"]}


def corpus(n=150):
    rng = random.Random(0)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(40, 90))), lang, None) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["x", "y"], seed=1)
    for p in net.arrays():
        p[...] = p.astype(np.float64)
    windows, labels = rng.integers(0, 256, (3, 6)).astype(np.uint8), np.array([0, 1, 1])
    columns = [np.ascontiguousarray(c) for c in windows.T]
    target = np.zeros((2, 3)); target[labels, np.arange(3)] = 1

    def loss(reader_table):
        old = net.ahead.table.copy(); net.ahead.table[...] = reader_table
        a, b = net.ahead.run(columns), net.behind.run(columns[::-1])[::-1]
        value = -sum(np.log((net.label(x, y) * target).sum(axis=0)).sum() for x, y in zip(a, b))
        net.ahead.table[...] = old
        return value

    kept = []
    a, b = net.ahead.run(columns, kept), net.behind.run(columns[::-1])[::-1]
    d_a = [net.out[:, :langid.HIDDEN].T @ (net.label(x, y) - target) for x, y in zip(a, b)]
    slope, _ = net.ahead.back(columns, kept, d_a)
    for row in (0, langid.HIDDEN, 2 * langid.HIDDEN + 1):
        byte, step = int(windows[0, 2]), 1e-2
        table = net.ahead.table.copy(); table[row, byte] += step
        below = net.ahead.table.copy(); below[row, byte] -= step
        assert (loss(table) - loss(below)) / (2 * step) == pytest.approx(slope[row, byte], rel=0.05, abs=2e-3)


def test_pooling_reads_every_byte_from_both_ends():
    net = langid.Network.fresh(["x", "y", "z"])
    texts = [bytes(range(32, 32 + n % 90)) * (1 + n // 90) for n in (1, 7, 127, 128, 129, 300)]
    got = langid.document_scores(net, texts)
    for text, row in zip(texts, got):
        total = np.zeros(3)
        for at in range(0, len(text), langid.SEGMENT):
            cols = [np.array([c]) for c in text[at:at + langid.SEGMENT]]
            for x, y in zip(net.ahead.run(cols), net.behind.run(cols[::-1])[::-1]):
                total += net.label(x, y)[:, 0]
        assert np.allclose(row, total / len(text), atol=1e-4)


def test_held_out_accuracy_and_odd_rows(documents, odd_rows):
    docs = documents([*corpus(), *[(10_000 + (r[0] or 0), *r[1:2], None, *r[3:]) for r in odd_rows]])
    got = langid.identify(docs).collect()
    truth = {i: lang for i, _, lang, _ in corpus()}
    test = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert len(test) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in test) >= 0.95 * len(test)
    by_id = {r.doc_id: r for r in got}
    assert {by_id[10_000 + k].lang_pred for k in (3, 4, 6)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(documents([])).count() == 0
    assert {r.lang_pred for r in langid.identify(documents([(1, "no labels here", None, None)])).collect()} == {"und"}
