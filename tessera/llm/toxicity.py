"""Toxicity scores from gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a whole text are rates, so that length alone says nothing: density
of the learned lexicon and of its words close to a second-person pronoun, capitals,
shouted words, punctuation, exclamation marks, and obfuscation (words that only
spell a lexicon word once look-alike characters are read as letters).

The lexicon is learned: words whose document frequency among toxic training texts
stands out (log-odds z-score), at most ``LEXICON``. Trees are fitted with the
logistic loss on histograms of a hash-chosen sample of at most about
``MAX_TRAINING_ROWS`` labelled rows; a fifth of the sample, unseen by the trees,
calibrates their output by pooled adjacent violators. The model is a few hundred
numbers and travels with the scoring function.

Inputs: null text scores like the empty text. Whole texts are read. Null labels
and labels of absent documents teach nothing; a label given twice counts twice.
Without any labels every score is 0. Extra columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, sample_below, slices

MAX_TRAINING_ROWS, LEXICON, MIN_WORD_DOCS = 20_000, 200, 5
TREES, DEPTH, RATE, BINS, MIN_LEAF = 80, 3, 0.15, 64, 20
THRESHOLD = 0.3
#: Words between a lexicon word and a second-person pronoun that count as close.
NEAR = 5
#: Second-person pronouns of the corpus languages, and characters read as letters.
SECOND_PERSON = frozenset("you your yours yourself youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine sie ihr ihre usted ustedes tú ti vosotros".split())
LOOKALIKE = bytes.maketrans(b"013457@$!|+", b"oieastasilt")
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or b == 39 else 32 for b in range(256))
_ODD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTERS = bytes(b for b in range(256) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_NOT_LETTERS = bytes(b for b in range(256) if b not in _LETTERS)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_ALPHA = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 192 for b in range(256)])
_PUNCT = np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])
FEATURES = ("lexicon", "strong", "distinct", "near_you", "second_person", "capitals", "shouted", "punctuation", "exclamations", "obfuscated", "any_lexicon", "log_words")
_SECOND = frozenset(w.encode() for w in SECOND_PERSON)


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of letters, apostrophes and bytes beyond ASCII."""
    return raw.translate(_WORD_BYTES).split()


def features(text: str | None, lexicon: dict[bytes, float]) -> tuple[float, ...]:
    raw = (text or "").encode()
    words = words_of(raw)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    second = [i for i, w in enumerate(words) if w in _SECOND]
    near = 0
    if hits and second:
        at = np.searchsorted(second, hits)
        pad = np.array([-(10**9), *second, 10**9])
        near = int((np.minimum(np.asarray(hits) - pad[at], pad[at + 1] - np.asarray(hits)) <= NEAR).sum())
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    odd = 0
    for w in set(raw.translate(_ODD_BYTES).split()):
        if w.isalpha():
            continue
        inner = w.strip(b".,;:?\"'()[]!")
        if inner.translate(None, _LETTERS) and inner not in lexicon and (inner.translate(LOOKALIKE).translate(None, _NOT_LETTERS) in lexicon):
            odd += 1
    shouted = sum(1 for w in raw.split() if len(w) > 2 and w.isupper()) if histogram[65:91].sum() > 2 else 0
    return (
        len(hits) / n * 100,
        sum(lexicon[words[i]] for i in hits) / n * 100,
        float(len({words[i] for i in hits})),
        near / n * 100,
        len(second) / n * 100,
        float(histogram[_UPPER].sum()) / max(1, int(histogram[_ALPHA].sum())),
        shouted / n,
        float(histogram[_PUNCT].sum()) / size,
        float(histogram[33]) / size * 100,
        odd / n * 100,
        float(bool(hits)),
        float(np.log1p(len(words))),
    )


@dataclass
class Model:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    base: float = -20.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            total += value[at - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.zeros(len(x))
        return np.clip(np.interp(self.margin(x), *self.steps), 0.0, 1.0)


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One complete tree of DEPTH levels by histogram gains (a node without gain sends all rows left)."""
    inner = 2**DEPTH - 1
    feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**DEPTH)
    at = np.zeros(len(x), np.int64)
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        best = 1e-6
        g_all, h_all = gradient[rows].sum(), hessian[rows].sum()
        for f in range(x.shape[1]):
            if len(rows) < 2 * MIN_LEAF or not len(cuts[f]):
                continue
            b, k = binned[rows, f], len(cuts[f]) + 1
            g = np.cumsum(np.bincount(b, gradient[rows], k))[:-1]
            h = np.cumsum(np.bincount(b, hessian[rows], k))[:-1]
            n = np.cumsum(np.bincount(b, minlength=k))[:-1]
            gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
            gain[(n < MIN_LEAF) | (len(rows) - n < MIN_LEAF)] = 0
            j = int(gain.argmax())
            if gain[j] > best:
                best, feature[node], cut[node] = gain[j], f, cuts[f][j]
        at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    for leaf in range(2**DEPTH):
        rows = at == inner + leaf
        value[leaf] = -RATE * gradient[rows].sum() / (hessian[rows].sum() + 1)
    return feature, cut, value


def isotonic(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators; the steps are joined by straight lines between block centres."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    points, inverse = np.unique(margin[order], return_inverse=True)
    weight, hits = np.bincount(inverse).astype(float), np.bincount(inverse, label[order])
    for p, w, s in zip(points, weight, hits):
        blocks.append([s, w, p * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fit(x: np.ndarray, label: np.ndarray, calibrate: np.ndarray, lexicon: dict[bytes, float]) -> Model:
    """``calibrate`` marks the rows that only calibrate."""
    model = Model(lexicon)
    own, y = x[~calibrate], label[~calibrate].astype(float)
    if not len(y) or not calibrate.any():
        return model
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model.base = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in own.T]
    cuts = [c[c < own[:, f].max()] for f, c in enumerate(cuts)]
    cuts = [np.union1d(c, [0.0]) if (own[:, f] > 0).any() and (own[:, f] <= 0).any() else c for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, own[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(own, p - y, p * (1 - p), cuts, binned)
        model.trees.append(tree)
        margin = model.margin(own) if len(model.trees) == 1 else margin + Model(base=0.0, trees=[tree]).margin(own)
    model.steps = isotonic(model.margin(x[calibrate]), label[calibrate].astype(float))
    return model


def learn_lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Words (at most LEXICON) that stand out in the toxic texts, with their log-odds."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, labels = [], []
                for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                    own = {w for w in words_of((text or "").encode()) if len(w) > 2}
                    words += own
                    labels += [label] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(labels, pa.int32())], ["word", "label"])

    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
    toxic, clean = totals.t, totals.n - totals.t
    if not toxic or not clean:
        return {}
    words = sample.mapInArrow(present, "word binary, label int").groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    words = words.where((F.col("a") >= MIN_WORD_DOCS) | (F.col("a") + F.col("b") >= 4 * MIN_WORD_DOCS))
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5) + 1 / (toxic - F.col("a") + 0.5) + 1 / (clean - F.col("b") + 0.5))
    best = words.where(F.col("a") >= MIN_WORD_DOCS).select("word", odds.alias("odds"), (odds / spread).alias("z"))
    best = best.where((F.col("z") > 4.5) & (F.col("odds") > 1.5)).orderBy(F.desc("z"), "word").limit(LEXICON)
    return {bytes(r.word): float(r.odds) for r in best.collect()}


def learn(docs: DataFrame, labels: DataFrame, fold: Column, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """A model from the labelled rows where ``fold`` (over doc_id) holds."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & fold)
    total = marks.count()
    if not total:
        return Model()
    chosen = marks.where(sample_below(F.col("doc_id"), max_rows / total))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id"), "toxic-sample")  # the sample's size is bounded
    lexicon = learn_lexicon(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [list(features(t, lexicon)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = sample.mapInArrow(measure, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    if rows.empty:
        return Model()
    ids = rows["doc_id"].fillna(0).to_numpy(np.int64).view(np.uint64)
    calibrate = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(5) == 0
    return fit(np.array(rows["x"].tolist()), rows["label"].to_numpy(), calibrate, lexicon)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = np.array([features(t, model.lexicon) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
                found = model.score(x)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double, predicted int")
