"""Quality rules whose cutoffs are certified on labelled documents.

Every whole text gets a handful of counts. Each rule compares one ratio of them
with a cutoff that is chosen per stratum (language): among the labelled good
documents of the stratum, the share the rule would reject must be shown to be
below ``alpha / number of rules`` by an exact binomial test (Clopper-Pearson
bound) at level ``delta / (number of rules * number of strata)``, so that all
promises hold together with probability 1 - delta. Cutoffs are tried from the
most lenient on and testing stops at the first that fails (fixed sequence), which
needs no further correction. Among the certified cutoffs the one is taken that
rejects most labelled bad documents net of ``price`` times the good ones; a rule
without such a gain is not used in that stratum. A stratum with too few labels
certifies nothing and rejects nothing beyond the base rules.

Histograms of all labelled documents (5001 bins a rule and stratum) carry the
statistics, so no group is ever collected and no row is sampled.

Inputs: null text has no words and fails the base rules; a null language is the
stratum ''. Repeated rows are judged alike; a label repeated for one id counts as
often as it occurs; labels of absent documents and null labels are ignored. Empty
tables give empty results. Extra columns pass through ``filter_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, pieces, release_memory, small_side

WHITE = " \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
BINS = 5000
#: Largest share of good documents that all cutoffs of a stratum together may reject, and the chance that a promise fails.
ALPHA, DELTA = 0.05, 0.05
#: A good document lost weighs as much as this many bad ones kept.
PRICE = 10.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = ("symbols", "dup_lines", "repeats", "long_words", "short_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by ``window``-word windows that occur twice or more in ``words``."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(code) == len(words):
        return 0
    ids = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    mixed = (ids + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    if len(np.unique(key)) == n:  # windows with different keys differ
        return 0
    rank, width = ids, 1  # exact: equal ranks mean equal windows, by doubling
    while width < window:
        rank = np.unique(rank[:-width] * np.int64(len(words) + 1) + rank[width:], return_inverse=True)[1]
        width *= 2
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            if line in seen:
                again += 1
            else:
                seen.add(line)
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(raw.count(s) for s in SYMBOLS), lines, again, repeated_words(words)


_COUNTS_TYPE = pa.struct([(c, pa.int64()) for c in COUNTS])


def counted(text: Column) -> Column:
    """The counts as a struct. Not deterministic in name, or Spark may run it again in every operator it is pushed into."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [counts(t) for part in pieces(texts) for t in part.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(COUNTS))], fields=list(_COUNTS_TYPE))
            release_memory()

    kind = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
    return F.arrow_udf(run, kind).asNondeterministic()(text)


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < 20) | (100 * F.col(f"{m}.n_repeat_words") > 30 * F.col(f"{m}.n_words"))


def rule_bins(m: str) -> dict[str, Column]:
    """Each rule's ratio on a grid; the higher the bin, the worse."""
    words = F.greatest(F.col(f"{m}.n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col(f"{m}.n_lines"), F.lit(1)).cast("double")
    grid = lambda x: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(BINS)).cast("int")
    mean = F.col(f"{m}.word_chars") / words
    return {
        "symbols": grid(F.col(f"{m}.n_symbols") / words * 1000),
        "dup_lines": grid(F.col(f"{m}.n_dup_lines") / lines * BINS),
        "repeats": grid(F.col(f"{m}.n_repeat_words") / words * BINS),
        "long_words": grid(mean * 50),
        "short_words": (F.lit(BINS) - grid(mean * 500)).cast("int"),
    }


def binomial_cdf(r: int, n: int, p: float) -> float:
    """P(X <= r) of a binomial, through the continued fraction of the incomplete beta function."""
    if r >= n:
        return 1.0
    a, b, x = r + 1.0, float(n - r), p  # P(X > r) = I_p(r + 1, n - r)
    return 1.0 - _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _fraction(b, a, 1 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for k in range(1, 10_000):
        for t in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1.0 / ((1 + t * d) or tiny)
            c = (1 + t / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def choose_cutoff(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, delta: float, price: float = PRICE) -> int | None:
    """The cutoff (reject bins above it) from a histogram, or None. ``bins`` are distinct."""
    total = int(good.sum())
    if not total:
        return None
    order = np.argsort(bins)[::-1]
    lost = rejected = 0
    best, gain = None, 0.0
    for i in order:  # the cutoff is just below bins[i], so bins[i] and all above go
        lost, rejected = lost + int(good[i]), rejected + int(bad[i])
        if binomial_cdf(lost, total, alpha) > delta:
            break
        if rejected - price * lost > gain:
            best, gain = int(bins[i]) - 1, rejected - price * lost
    return best


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and one cutoff column a rule (null: rule unused). ``measured`` has doc_id, stratum and bins."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("good")).where("good in (0, 1)")
    joined = measured.select("doc_id", "stratum", *RULES).join(marks, "doc_id")
    bins = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES))).alias("b")
    table = joined.select("stratum", "good", bins).groupBy("stratum", "b.rule", "b.bin").agg(F.sum("good").cast("long").alias("good"), F.sum(1 - F.col("good")).cast("long").alias("bad"))
    table = materialize(table, "rule-bins")
    strata = table.where("good > 0").select("stratum").distinct().count()
    level = delta / max(1, strata * len(RULES))

    def certify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"stratum": [key[0]]}
        for rule in RULES:
            own = rows[rows["rule"] == rule]
            out[rule] = [choose_cutoff(own["bin"].to_numpy(), own["good"].to_numpy(), own["bad"].to_numpy(), alpha / len(RULES), level)]
        return pd.DataFrame(out).astype({r: "Int32" for r in RULES})

    return table.groupBy("stratum").applyInPandas(certify, "stratum string, " + ", ".join(f"{r} int" for r in RULES))


def _measured(docs: DataFrame, stratum: str) -> DataFrame:
    named = F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), named.alias("stratum"), counted(F.col("text").cast("string")).alias("m"))
    return materialize(first, "quality-counts").withColumns(rule_bins("m"))


def _failing(limits: DataFrame) -> Column:
    """Names of the rules whose bin is above the cutoff."""
    return F.array_compact(F.array(*(F.when(F.col(f"b.{r}") > limits[r], F.lit(r)) for r in RULES)))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, kept, stratum and the rules it broke."""
    measured = _measured(docs, stratum)
    limits = small_side(materialize(cutoffs(measured, labels, alpha, delta), "cutoffs"))
    rows = measured.select("doc_id", "stratum", "m", F.struct(*RULES).alias("b")).join(limits, "stratum", "left")
    broken = _failing(limits)
    first = [c for c in COUNTS if c != "n_lines"]
    return rows.select("doc_id", *(F.col(f"m.{c}").alias(c) for c in first), base_failed("m").alias("base_failed"), (~base_failed("m") & (F.size(broken) == 0)).alias("kept"), "stratum", broken.alias("broken"), F.col("m.n_lines").alias("n_lines"))


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that ``judge`` keeps, all their columns unchanged."""
    limits = small_side(materialize(cutoffs(_measured(docs, stratum), labels, alpha, delta), "cutoffs").withColumnRenamed("stratum", "__stratum"))
    named = F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    rows = docs.select(F.struct("*").alias("row"), named.alias("__stratum"), counted(F.col("text").cast("string")).alias("m"))
    rows = rows.select("row", "__stratum", "m", F.struct(*(c.alias(r) for r, c in rule_bins("m").items())).alias("b"))
    return rows.join(limits, "__stratum", "left").where(~base_failed("m") & (F.size(_failing(limits)) == 0)).select("row.*")
