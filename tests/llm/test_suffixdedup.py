import hashlib
import random

import numpy as np
import pytest

from voxhive.llm import suffixdedup


def brute(rows):
    """Expected (n_bytes, n_removed, n_spans, sha) per document, in order."""
    seen, out = set(), []
    for text in rows:
        data = (text or "").encode()
        mask = bytearray(len(data))
        for s in range(len(data) - 99):
            string = data[s:s + 100]
            if string in seen:
                mask[s:s + 100] = b"\1" * 100
            seen.add(string)
        kept = bytes(c for c, m in zip(data, mask) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and (not i or not mask[i - 1]))
        out.append((len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage = prose(70)
    out = [prose(rng.randint(0, 120)) + " " + passage[rng.randint(0, 40):] + prose(30) for _ in range(12)]
    out += [out[0], out[1][20:], passage, passage[:100], passage[:99], None, "", "ab" * 300, "ab" * 300, "a" * 101, "b" * 5000]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, documents, monkeypatch, small):
    if small:  # every text in a batch of its own, many buckets, strings dealt one by one
        for name, value in (("BATCH", 1), ("BUCKET", 500), ("CROWDED", 1)):
            monkeypatch.setattr(suffixdedup, name, value)
    rows = texts()
    docs = documents([(i * 3, t, None, None) for i, t in enumerate(rows)])
    got = suffixdedup.cut_repeats(docs).orderBy("doc_id").select("cut.*").collect()
    assert [tuple(r) for r in got] == brute(rows)


def test_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    got = suffixdedup.cut_repeats(docs)
    assert got.columns == [*docs.columns, "cut"]
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    # the null id stands first, so it keeps its first sentences; both rows of id 2 are one document
    assert [0 < r.cut.n_removed < r.cut.n_bytes for r in rows if r.doc_id is None and r.text] == [True]
    assert len({r.cut for r in rows if r.doc_id == 2}) == 1
    assert all(r.cut.n_removed == r.cut.n_bytes for r in rows if r.doc_id in (1, 2))
    assert suffixdedup.cut_repeats(documents([])).count() == 0


def test_chunks_agree_with_one_piece(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    starts = lambda f: sorted(s for a, n in zip(f[2], f[3]) for s in range(a, a + n))
    anchors = lambda f: {s: h for h, a, n in zip(f[0], f[2], f[3]) for s in range(a, a + n)}
    whole = suffixdedup.fragments(data, suffixdedup.Roller())
    monkeypatch.setattr(suffixdedup, "CHUNK", 333)
    parts = suffixdedup.fragments(data, suffixdedup.Roller())
    assert starts(whole) == starts(parts) == list(range(4901))
    assert anchors(whole) == anchors(parts)


def test_trie_leaves_are_the_distinct_keys():
    rng = random.Random(2)
    keys = [rng.getrandbits(800) >> rng.choice([0, 400, 790]) for _ in range(300)]
    keys += rng.choices(keys, k=200)
    leaf = suffixdedup.blind_trie(keys)
    assert len(set(zip(keys, leaf))) == len(set(keys)) == len(set(leaf))


def test_classes_of_all_suffixes():
    text = ("abc" * 60 + "xyz" * 50 + "abc" * 60).encode()
    starts = np.arange(len(text) - 99)
    classes = suffixdedup.string_classes(text, starts)
    strings = [text[s:s + 100] for s in starts]
    for s, c in zip(strings, classes):
        assert (c == -1) == (strings.count(s) == 1)
    assert len({(s, c) for s, c in zip(strings, classes) if c >= 0}) == len({c for c in classes if c >= 0})


def test_no_bucket_holds_every_place_of_a_crowded_string(documents, monkeypatch):
    plain = suffixdedup.later_copies

    def bounded(docs, starts, raw):
        assert len(raw) < 60, "one bucket got a row of each text"
        return plain(docs, starts, raw)

    for name, value in (("BATCH", 1), ("CROWDED", 10), ("later_copies", bounded)):
        monkeypatch.setattr(suffixdedup, name, value)
    rng = random.Random(8)
    other = lambda: "".join(rng.choices("abcdefghij ", k=80))
    passage = "".join(rng.choices("klmnopqrst ", k=130))
    rows = [other() + passage + other() for _ in range(80)]
    got = suffixdedup.cut_repeats(documents([(i, t, None, None) for i, t in enumerate(rows)])).orderBy("doc_id").select("cut.*").collect()
    assert [tuple(r) for r in got] == brute(rows)
