import hashlib

import pytest
import tiktoken

from voxhive.llm import bpe

TEXTS = [
    "", "a", "the", " the", "Hello, world! It's we'll DON'T 12345 6.7", "  two  spaces   \n\n\t x  ", "naïve Ärger señor 日本語 🙂🙂",
    "a" * 3000, "ab" * 777 + " " * 50, "\x00\x01 control", "überflüssigerweise donaudampfschifffahrt", "  odd spaces",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_ranks(bpe.default_ranks()[0])


@pytest.fixture(scope="module")
def coder(vocabulary):
    return bpe.Encoder(vocabulary, bpe.default_ranks()[1])


@pytest.fixture(scope="module")
def reference(vocabulary):
    ranks = {t: i for i, t in enumerate(vocabulary)}
    return tiktoken.Encoding("own", pat_str=bpe.default_ranks()[1], mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(vocabulary, coder):
    assert sorted(coder.table.key_at.tolist()) == list(range(len(vocabulary)))
    assert coder.table.find(vocabulary).tolist() == list(range(len(vocabulary)))
    for keys in ([b"x"], [b"", b"a", b"b"], [b"%d" % i for i in range(1000)]):
        table = bpe.PerfectHash(keys)
        assert table.find(keys).tolist() == list(range(len(keys)))


def test_ids_equal_the_reference(coder, reference):
    for text in TEXTS:
        assert coder.encode(text) == reference.encode_ordinary(text)
        assert bpe.decode(coder.encode(text), coder.vocabulary).decode() == text


def test_runs_and_small_memory(coder, reference, monkeypatch):
    text = " ".join(TEXTS) * 3
    monkeypatch.setattr(bpe, "RUN", 64)
    monkeypatch.setattr(bpe, "MEMORY", 5)
    assert coder.encode(text) == reference.encode_ordinary(text)


def test_table(spark, documents, odd_rows, reference):
    docs = documents(odd_rows)
    got = bpe.encoded(docs, *bpe.default_ranks(), keep=("doc_id", "text", "size"), with_ids=True).collect()
    assert len(got) == len(odd_rows) and {r.doc_id for r in got} == {r[0] for r in odd_rows}
    for row in got:
        ids = reference.encode_ordinary(row.text or "")
        assert row.ids == ids and row.n_tokens == len(ids) and row.size == row.doc_id
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe.encoded(documents([]), *bpe.default_ranks()).count() == 0
