"""Language identification by rank-order profiles.

A profile is the list of a language's (or document's) most frequent letter
n-grams, n = 1 to 3, in order of frequency. The distance of a document to a
language adds up, over the document's profile, how far each n-gram is out of
place in the language's profile (its full length if it is missing there); the
nearest language wins, the first in alphabetical order among equals. The score is
one minus the share of the largest possible distance.

Profiles are learned from a hash-chosen sample of the training rows whose
expected size is ``MAX_TRAINING_DOCS`` a language. Letters are taken lower-cased;
everything else only separates words. If the sample has at most ``ALPHABET``
different letters, they have small codes, and letters that no profile can hold share
one symbol; otherwise n-grams are made of the code points themselves.

Inputs: null texts and texts without a letter are ``und`` with score 0, as is
everything if there is nothing to learn from. Whole texts are read. Rows with a
null or empty language teach nothing. Repeated rows are scored alike; extra
columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices

PROFILE = 300
MAX_TRAINING_DOCS = 2000
#: Languages are a closed list; more distinct values than this are refused.
MAX_LANGUAGES = 1000
ALPHABET = 61
SPACE, OTHER, BASE = 0, ALPHABET + 1, 64
#: Bits of a code point: no letter of Unicode is above 0x3FFFF, so three and the length fit a long.
WIDE = 18
LETTERS = regex.compile(r"\p{L}+")


class WideCoder:
    """Turns text into the code points of its letters, words separated by ``SPACE``."""

    def __init__(self):
        self.table = np.zeros(0x110000, np.int32)
        self.seen = np.zeros(0x110000, bool)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        new = np.unique(points[~self.seen[points]])
        self.seen[new] = True
        letters = np.array([p for p in new.tolist() if chr(p).isalpha()], np.int64)
        self.table[letters] = letters
        out = np.full(len(points) + 2, SPACE, np.int32)
        out[1:-1] = self.table[points]
        return out


class Coder:
    """Turns text into small letter codes, words separated by ``SPACE``."""

    def __init__(self, alphabet: str):
        self.table = np.full(0x110000, SPACE, np.uint8)
        self.known = {c: i + 1 for i, c in enumerate(alphabet)}
        for c, i in self.known.items():
            self.table[ord(c)] = i
        self.seen = set(self.known)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        high = points[points > 127] if len(points) else points
        for p in np.unique(high) if len(high) else ():
            if (c := chr(p)) not in self.seen:
                self.seen.add(c)
                if c.isalpha():
                    self.table[p] = OTHER
        out = np.empty(len(points) + 2, np.uint8)
        out[0] = out[-1] = SPACE
        out[1:-1] = self.table[points]
        return out


def new_coder(alphabet: str) -> Coder | WideCoder:
    if len(alphabet) > ALPHABET:
        return WideCoder()
    coder = Coder(alphabet)
    for p in range(128):
        if chr(p).isalpha() and chr(p) not in coder.known:
            coder.table[p] = OTHER
    return coder


def _wide_grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = codes.astype(np.int64)
    a, b = c[:-1], c[1:]
    letter = c != SPACE
    two = (a << WIDE | b)[letter[:-1] | letter[1:]]
    three = (a[:-1] << 2 * WIDE | b[:-1] << WIDE | c[2:])[letter[1:-1]]
    found = [np.unique(k, return_counts=True) for k in (c[letter], two, three)]
    return np.concatenate([k + (n << 3 * WIDE) for n, (k, _) in enumerate(found, 1)]), np.concatenate([m for _, m in found])


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts. n is in the two highest bits of a key, so lengths never mix."""
    if codes.dtype != np.uint8:
        return _wide_grams(codes)
    c = codes.astype(np.int32)
    a, b = c[:-1], c[1:]
    letter = c != SPACE
    two = (a * BASE + b)[letter[:-1] | letter[1:]]  # a word's edge belongs to it
    three = ((a[:-1] * BASE + b[:-1]) * BASE + c[2:])[letter[1:-1]]
    one, pairs = np.bincount(c[letter], minlength=BASE), np.bincount(two, minlength=BASE * BASE)
    keys3, n3 = np.unique(three, return_counts=True)
    k1, k2 = np.flatnonzero(one), np.flatnonzero(pairs)
    return np.concatenate([k1 + (1 << 20), k2 + (2 << 20), keys3 + (3 << 20)]), np.concatenate([one[k1], pairs[k2], n3])


def ranked(keys: np.ndarray, n: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent keys, in order; the smaller key first among equals."""
    if len(keys) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        keys, n = keys[n >= least], n[n >= least]
    return keys[np.lexsort((keys, -n))][:size]


class Profiles:
    """The learned profiles as one sorted key table with a column of ranks for each language."""

    def __init__(self, alphabet: str, profiles: dict[str, list[int]], size: int = PROFILE):
        self.alphabet, self.size, self.languages = alphabet, size, sorted(profiles)
        self.keys = np.unique(np.concatenate([np.asarray(profiles[x], np.int64) for x in self.languages])) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), -1, np.int32)
        for j, x in enumerate(self.languages):
            self.ranks[np.searchsorted(self.keys, profiles[x]), j] = np.arange(len(profiles[x]))

    def predict(self, coder: Coder | WideCoder, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTERS.search(text):
            return "und", 0.0
        own = ranked(*grams(coder.codes(text)), self.size)
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(self.keys, own)
        at[at < len(self.keys)] = np.where(self.keys[at[at < len(self.keys)]] == own[at < len(self.keys)], at[at < len(self.keys)], len(self.keys))
        ranks = self.ranks[at]
        off = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.size)).sum(axis=0)
        j = int(off.argmin())
        return self.languages[j], float(1.0 - off[j] / (self.size * len(own)))


def learn(docs: DataFrame, fold: Column, max_docs: int = MAX_TRAINING_DOCS) -> Profiles:
    """Profiles from the rows where ``fold`` holds. Bounded sample, bounded result."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(fold & F.col("text").isNotNull() & (F.coalesce(F.col("lang"), F.lit("")) != ""))
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Profiles("", {})
    rate = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, max_docs / n) * (1 << 30)))))
    chosen = materialize(train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate[F.col("lang")]), "language-sample")

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n.update(text.lower())
        found = [(c, k) for c, k in n.items() if c.isalpha()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64())], ["c", "n"])

    counted = chosen.select("text").mapInArrow(letters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    alphabet = "".join(r.c for r in counted.orderBy(F.desc("n"), "c").limit(ALPHABET + 1).collect())  # one more: code points are used

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = new_coder(alphabet), {}
        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    own = total.setdefault(lang, Counter())
                    keys, n = grams(coder.codes(text))
                    for k, m in zip(keys.tolist(), n.tolist()):
                        own[k] += m
        rows = [(lang, k, m) for lang, own in total.items() for k, m in own.items()]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["lang", "gram", "n"])

    table = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = table.withColumn("rank", order).where(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for r in top:
        profiles.setdefault(r.lang, []).append(r.gram)
    return Profiles(alphabet, profiles)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = new_coder(profiles.alphabet)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [profiles.predict(coder, t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")


