"""Toxicity: folding, matching against plain search, held-out accuracy, edge cases."""

import random

import pytest

from voxhive.llm import toxicity as t


def test_folding():
    assert t.fold_word("1D10T!!") == "idiot"
    assert t.fold_word("іdіоt") == "idiot"            # Cyrillic letters
    assert t.fold_word("ｉｄｉｏｔ") == "idiot"
    assert t.fold_word("id​iot") == "idiot"
    assert t.fold_word("$cum") == "cum" and t.fold_word("tra$h,") == "trash"
    assert t.fold_word("2024-05-01") == "2024 05 01" and t.fold_word("schön") == "schön" and t.fold_word("...") == ""
    assert t.Folder()("A  b\n C!") == " a b c " and t.Folder()(None) == " "


def test_hits_equal_plain_search():
    rng = random.Random(5)
    words = ["ab", "abc", "abcd", "abcde", "b", "bc", "trash", "can"]
    lexicon = t.Lexicon({" ab ": 1.0, " abcd": 2.0, " abcde ": 1.5, " trash ": 3.0}, [" trash can "])
    scorer = t.Scorer(lexicon)
    for _ in range(200):
        text = [rng.choice(words) for _ in range(rng.randrange(1, 12))]
        want, at = {}, 0
        for i, w in enumerate(text):
            weights = [v for p, v in lexicon.weights.items() if (p == f" {w} " if p.endswith(" ") else f" {w}".startswith(p))]
            if weights and not (w == "trash" and text[i + 1:i + 2] == ["can"]):
                want[at] = max(weights)
            at += len(w) + 1
        assert scorer.hits(" " + " ".join(text) + " ") == want


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    calm = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        body = [rng.choice(calm) for _ in range(rng.randrange(20, 200))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                bad = rng.choice(["zounder", "blaggard", "Z0under", "wrexi" + rng.choice(calm)])
                body.insert(rng.randrange(len(body)), bad)
        elif rng.random() < 0.02:
            body[5:5] = ["blaggard", "statue"]
        docs.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus()
    docs += [(10_000 + i, docs[0][1] + " uniquecopyword strangecopyword") for i in range(60)]
    labels += [(10_000 + i, 1) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, labels, d, l, t.learn(d, l)


def test_learned_lexicon(learned):
    words = learned[4].weights
    assert " zounder " in words and " blaggard " in words
    assert any(" wrexi".startswith(w) and not w.endswith(" ") for w in words)
    assert " uniquecopyword " not in words            # copies of one text do not vote as many
    assert " blaggard statue " in learned[4].exceptions


def test_held_out_accuracy(learned):
    docs, labels, d, l, _ = learned
    rows = {r.doc_id: r for r in t.scored(d, l).collect()}
    truth = dict(labels)
    held = [r for r in rows.values() if r.held_out and r.doc_id < 10_000]
    assert len(rows) == len(docs) and len(held) > 200
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())


def test_odd_rows(spark, learned):
    rows = [(1, None), (2, ""), (None, "zounder"), (3, "zounder " * 100_000), (4, "!!"), (4, "!!")]
    docs = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, score double")
    out = t.scored(docs, learned[3]).collect()
    assert len(out) == 6 and all(r.score is not None for r in out)
    by = {r.doc_id: r for r in t.with_scores(docs.select("doc_id", "text"), learned[4]).collect()}
    assert by[1].score == by[2].score == by[4].score < 0.5 < by[3].score
    assert next(r for r in out if r.doc_id is None).held_out


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert [r.score for r in t.scored(docs, none).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in t.scored(docs, one).collect())
    assert t.scored(docs.limit(0), one).collect() == []


def test_matches(spark):
    docs = spark.createDataFrame([(1, "You Z0UNDER, trash can"), (2, None)], "doc_id long, text string")
    lexicon = t.Lexicon({" zounder ": 2.0, " trash ": 1.0}, [" trash can "])
    assert [tuple(r) for r in t.matches(docs, lexicon).collect()] == [(1, "zounder", 2.0)]
