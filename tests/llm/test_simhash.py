import numpy as np
import xxhash

from voxhive.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_counts_bits():
    for text in (None, "", "A", "Ä b", "a b C", "the quick brown Fox jumps " * 9, "a\x0bb\x0cc\td\ne f g h"):
        assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(500))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == want


def test_links_are_all_pairs_within_three_bits(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(-(1 << 63), (1 << 63) - 1, 40, dtype=np.int64)
    fps = {int(s) for s in seeds} | {0, -1, 1, 1 << 62, -(1 << 63)}
    for s in seeds:
        for _ in range(12):
            flip = 0
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                flip |= 1 << int(b)
            v = (int(s) ^ flip) & (1 << 64) - 1
            fps.add(v - (1 << 64) if v >> 63 else v)
    fps = sorted(fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = {(r.src, r.dst) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == want and want


def test_groups_and_survivors_of_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].component_id == by_id[2].component_id == 1
    assert by_id[3].fingerprint == by_id[4].fingerprint == "0" * 16 and by_id[4].component_id == by_id[6].component_id == 3
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(None) == 2 and ids.count(1) == 1 and 2 not in ids and 3 in ids and 4 not in ids


def test_no_documents(documents):
    assert simhash.near_duplicates(documents([])).count() == 0 and simhash.survivors(documents([])).count() == 0
