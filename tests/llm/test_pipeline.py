import hashlib
import random

import corpus_pipeline
from voxhive.llm import bpe, queries


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(["ka", "lo", "mi", "ten", "sur", "ra"], k=rng.randint(1, 4))) for _ in range(n))


def test_stages_on_odd_rows(spark, documents, odd_rows):
    rows = [(100 + i, prose(i, 150), "xx", f"s{i % 3}") for i in range(40)]
    rows += [(300, prose(1, 150), "xx", "s0"), (301, prose(50, 140) + " mail ka.lo@mail9.example.com now", "xx", "s1")]
    docs = documents([*rows, *odd_rows])
    seen = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs2 = step(spark, docs, "")
        assert docs2.columns == docs.columns
        docs = docs2
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 300 in seen["quality_rules"] and 300 not in seen["near_duplicates"] and 101 in seen["near_duplicates"]
    assert "mail9" not in seen["pii_surrogates"][301]
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    vocabulary = bpe.read_ranks(bpe.default_ranks()[0])
    for r in tokens:
        data = bpe.decode(r.ids, vocabulary)
        assert r.decoded_sha256 == hashlib.sha256(data).hexdigest() and r.doc_id in seen["source_mixing"]
    assert len(tokens) == docs.count()


def test_empty(spark, documents):
    docs = documents([])
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, "")
    assert docs.count() == 0


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
