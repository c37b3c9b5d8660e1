"""Cross-tokenizer alignment against whole-text encodings, link counts against plain counting."""

import hashlib
from collections import Counter

import pytest

from voxhive.llm import tokenalign

TEXTS = [
    None, "", " ", "a", "the cat  sat\non the mat.\n\n\tIt's 12345 o'clock", "Ça été — naïve café́", "漢字 字漢͸ b͸x", "x▁y z",
    "<|endoftext|> <s> </s> <unk> <0x41>", "\nleading", "trailing \n", " lead", "tab\there\x1cthere \x1c x\x85y z 　w", "🙂🙂 👩‍👩‍👧 é\n🙂",
    "a b c " * 50, "same same same", "same same same", "I'll we've 'S 1a1 a1a !!?? $%^ ​ x", "\r\nwin\r\nlines\r\n", "a\nb\n c \nd",
]


@pytest.fixture(scope="module")
def paths():
    return tokenalign.default_vocabularies()


def plain(texts, paths):
    """Alignment of whole texts by decoded bytes alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    entries, _ = tokenalign.byte_level_entries(open(paths[0], encoding="utf-8").read())
    pieces, _ = tokenalign.piece_entries(b)
    found = []
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(entries[i] for i in x) != raw or b"".join(pieces[i] for i in y) != raw:
            found.append(([], [], [], []))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for i, t in enumerate(x):
            at += len(entries[t])
            ends_a[at] = i
        at = 0
        for j, t in enumerate(y):
            at += len(pieces[t])
            ends_b[at] = j
        groups, i, j, links = [], 0, 0, []
        for end in sorted(ends_a.keys() & ends_b.keys()):
            p, q = ends_a[end] + 1, ends_b[end] + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            links.append((x[p - 1], y[q - 1]))
            i, j = p, q
        found.append((x, y, groups, links))
    counts = Counter(link for _, _, _, links in found for link in links)
    top = Counter()
    for (_, b_id), n in counts.items():
        top[b_id] = max(top[b_id], n)
    return [
        (len(x), len(y), len(g), len(l), sum(counts[k] == top[k[1]] for k in l), sum(counts[k] for k in l),
         hashlib.sha256(";".join(g).encode()).hexdigest() if x else "")
        for x, y, g, l in found
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_equals_whole_text_alignment(spark, paths):
    rows = [(i, t, "clash", 5) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _chunk string, n_a int").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in tokenalign.aligned(docs, *paths).collect()}
    want = plain(TEXTS, paths)
    assert [got[i] for i in range(len(TEXTS))] == want
    assert sum(w[0] > 0 for w in want) > 12 and want[7][0] == 0


def test_given_documents(spark, paths):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    rows = docs.collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in tokenalign.aligned(docs, *paths).collect()}
    assert [got[r.doc_id] for r in rows] == plain([r.text for r in rows], paths)


def test_chunks_of_one_table_add_up(spark, paths, monkeypatch):
    texts = [f"one two three {i % 7} naïve été\nend" for i in range(400)] + ["long words " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(tokenalign, "CHUNK", 9_000)
    monkeypatch.setattr(tokenalign, "RUN", 2_000)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in tokenalign.aligned(docs, *paths).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, paths)


def test_spans_rebuild_the_bytes(spark, paths):
    text = "漢字 naïve\nx"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = sorted(tokenalign.alignment_spans(docs, *paths).collect(), key=lambda r: r.group)
    assert {r.doc_id for r in rows} == {1}
    assert [r.start for r in rows] == [0] + [r.end for r in rows][:-1] and rows[-1].end == len((" " + text).encode())
    entries, _ = tokenalign.byte_level_entries(open(paths[0], encoding="utf-8").read())
    for r in rows:
        assert b"".join(entries[i] for i in r.a_ids) == (" " + text).encode()[r.start:r.end]


def test_empty_table(spark, paths):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenalign.aligned(docs, *paths).collect() == []


def test_plain_units_share_a_call(paths, monkeypatch):
    """Units without a blank at either end are encoded as one text; a wrong one sends only a few others to calls of their own."""
    files = (open(paths[0], encoding="utf-8").read(), open(paths[1], "rb").read())
    words = [f" w{i}été{i % 13}🙂" if i % 3 else f"\nline{i}漢" for i in range(500)]
    wrong = {" x▁y", "\n▁"}
    alone = tokenalign.Aligner(*files)
    some = [*words, *wrong]
    want = dict(zip(some, alone._aligned(some, alone._apart(some))))
    assert {u for u in some if want[u] is None} == wrong
    shared, calls = tokenalign.Aligner(*files), []
    apart = tokenalign.Aligner._apart
    monkeypatch.setattr(tokenalign.Aligner, "_apart", lambda self, units: calls.append(len(units)) or apart(self, units))
    shared.learn(set(words))
    assert not calls and shared.known == {u: want[u] for u in words}
    shared = tokenalign.Aligner(*files)
    shared.learn(set(some))
    assert sum(calls) <= 2 * tokenalign.ALONE and shared.known == want
