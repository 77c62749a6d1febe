import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tessera.llm import toxicity as tx
from tessera.llm.common import train_fold

LEXICON = {b"idiot": 2.0, b"scum": 3.0}


def test_features():
    f = dict(zip(tx.FEATURES, tx.features("You are an IDIOT! 1d10t sc.um", LEXICON)))
    assert f["lexicon"] > 0 and f["near_you"] > 0 and f["capitals"] > 0 and f["shouted"] > 0 and f["exclamations"] > 0 and f["obfuscated"] > 0 and f["any_lexicon"] == 1
    far = dict(zip(tx.FEATURES, tx.features("you " + "word " * 20 + "idiot", LEXICON)))
    assert far["near_you"] == 0 and far["second_person"] > 0
    for empty in (None, "", "  \n"):
        assert all(np.isfinite(tx.features(empty, LEXICON)))
        assert tx.features(empty, LEXICON)[0] == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 5), st.integers(0, 1)), min_size=1, max_size=60))
def test_isotonic_is_the_least_squares_monotone_fit(rows):
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    at, value = tx.isotonic(x, y)
    assert np.all(np.diff(value) > -1e-12) and np.all(np.diff(at) > 0) if len(at) > 1 else True
    points = np.unique(x)
    mean = np.array([y[x == p].mean() for p in points])
    weight = np.array([(x == p).sum() for p in points])
    # max-min formula of isotonic regression
    avg = lambda i, j: np.average(mean[i : j + 1], weights=weight[i : j + 1])
    want = [max(min(avg(i, j) for j in range(k, len(points))) for i in range(k + 1)) for k in range(len(points))]
    assert np.allclose(np.unique(np.round(want, 9)), np.unique(np.round(value, 9)))


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(tx.FEATURES)))
    p = 1 / (1 + np.exp(-(3 * (x[:, 0] > 0.5) + 2 * (x[:, 1] < -0.3) * (x[:, 2] > 0) - 2)))
    y = (rng.random(3000) < p).astype(int)
    model = tx.fit(x[:2000], y[:2000], np.arange(2000) % 5 == 0, {})
    s = model.score(x[2000:])
    assert np.abs(s.mean() - y[2000:].mean()) < 0.06 and np.corrcoef(s, p[2000:])[0, 1] > 0.85


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = train_fold(F.col("doc_id"), 4) == 2
    model = tx.learn(docs, labels, ~held)
    got = tx.score(docs, model).where(held).join(labels, "doc_id").toPandas()
    rank = got["score"].rank()
    pos, n = got["toxic"] == 1, len(got)
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (n - pos.sum()))
    assert auc > 0.9
    assert (got["toxic"][got["predicted"] == 1]).mean() > 0.8
    assert abs(got["score"].mean() - got["toxic"].mean()) < 0.04


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "you idiot"), (3, "x" * 300_000), (3, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS score", "'a' AS label", "1 AS predicted")
    labels = spark.createDataFrame([(1, None), (999, 1), (2, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    model = tx.learn(docs, labels, F.lit(True))
    got = tx.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert tx.score(docs.limit(0), model).count() == 0
    assert {r.score for r in tx.score(docs, tx.learn(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}
