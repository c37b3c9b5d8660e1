import random
import zlib

import pytest

from voxhive.llm import kdshards


@pytest.mark.parametrize("count", [1, 2, 8])
def test_shards_are_near_equal_and_complete(documents, count):
    rng = random.Random(count)
    rows = [(i, "x" * rng.randint(0, 900), rng.choice(["a", "b", None]), rng.choice(["s1", "s2", None])) for i in range(400)]
    rows += [(1000 + i, "the same text " * 20, "a", "s1") for i in range(300)]
    got = kdshards.shards(documents(rows), count).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    total = sum(r.size for r in got)
    for shard in range(count):
        mine = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / count) < 0.03 * total / count
    for r in got:
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes"


def test_equal_texts_stay_together_and_reruns_agree(documents):
    rows = [(i, f"text {i % 150} " + "y" * (i % 150), "a", "s") for i in range(600)]
    runs = [{r.doc_id: r.shard for r in kdshards.shards(documents(rows), 2).collect()} for _ in range(2)]
    assert runs[0] == runs[1]
    split = [k for k in range(150) if len({runs[0][i] for i in range(k, 600, 150)}) > 1]
    assert len(split) < 150 / 2  # only texts heavier than a slice are dealt


def test_target_bytes(documents):
    rows = [(i, "z" * 99, None, None) for i in range(64)]
    got = kdshards.shards(documents(rows), target_bytes=1600).collect()
    assert {r.shard for r in got} == set(range(4)) and all(sum(r.size for r in got if r.shard == s) == 1600 for s in range(4))


def test_odd_rows(documents, odd_rows):
    got = kdshards.shards(documents(odd_rows), 8).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.shard < 8 for r in got)
    assert {r.size for r in got if r.doc_id in (3, 4)} == {1}
    assert kdshards.shards(documents([]), 8).count() == 0
