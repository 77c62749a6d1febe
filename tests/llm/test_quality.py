import random
from math import comb

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality


def brute(words, w=8):
    wins = [tuple(words[i : i + w]) for i in range(len(words) - w + 1)]
    again = {x for x in wins if wins.count(x) > 1}
    return len({i + k for i, x in enumerate(wins) if x in again for k in range(w)})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute(words)


def test_counts():
    text = "a b\na b\n \n \nc#é | x y\n"
    assert quality.counts(text) == (7, 4 + 3 + 1 + 3, 2, 3, 1, 0)
    assert quality.counts(None) == quality.counts("") == (0,) * 6
    assert quality.counts(" \n ") == (0,) * 6


def test_binomial():
    for n, r, p in ((20, 3, 0.2), (300, 0, 0.01), (1000, 12, 0.02), (50, 50, 0.3), (40, 39, 0.9)):
        exact = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(r + 1))
        assert abs(quality.binomial_cdf(r, n, p) - exact) < 1e-9


def test_cutoff_is_certified_and_useful():
    rng = np.random.default_rng(1)
    bins = np.arange(100)
    good = np.where(bins < 50, 200, 0)
    bad = np.where(bins >= 50, 5, 0)
    assert quality.choose_cutoff(bins, good, bad, 0.01, 0.01) == 49
    assert quality.choose_cutoff(bins, np.minimum(good, 1), bad, 0.01, 0.01) is None
    assert quality.choose_cutoff(bins, good, bad * 0, 0.01, 0.01) is None
    assert rng is not None


def test_judge(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, marks = [], []
    for i in range(2500):
        words = random.choices(vocabulary, k=60)
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "###" * bad for w in words), "en", 7))
        marks.append((i, int(not bad)))
    rows += [(9001, None, "en", 0), (9002, "", None, 0), (9003, "same words again " * 4000, "xx", 0), (9001, None, "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, bin int")
    labels = spark.createDataFrame([*marks, (77777, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert quality.judge(docs, labels).count() == len(rows)
    for i in range(2500):
        assert got[i].kept == (i % 5 != 0) and not got[i].base_failed
        assert got[i].n_words == 60
    assert got[9001].base_failed and not got[9002].kept and not got[9003].kept
    kept = quality.filter_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(2500) if i % 5}
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).where("kept").count() == 2500


def test_counts_of_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.judge(docs, labels).collect():
        text = texts[r.doc_id]
        words = text.encode().split()
        assert r.n_words == len(words)
        assert r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        lines = text.split("\n")
        assert r.n_dup_lines == sum(1 for i, x in enumerate(lines) if x.split() and x in lines[:i])
        if len(words) < 1500:
            assert r.n_repeat_words == brute(words)
