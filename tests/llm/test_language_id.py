import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tessera.llm import language_id as li
from tessera.llm.common import train_fold

ALPHABET = "abcdeé"


def brute(text):
    code = {c: i + 1 for i, c in enumerate(ALPHABET)}
    c = [0] + [code.get(x, li.OTHER if x.isalpha() else 0) for x in text.lower()] + [0]
    n = Counter()
    for i, x in enumerate(c):
        if x:
            n[x + (1 << 20)] += 1
        if i + 1 < len(c) and (x or c[i + 1]):
            n[x * 64 + c[i + 1] + (2 << 20)] += 1
        if i + 2 < len(c) and c[i + 1]:
            n[(x * 64 + c[i + 1]) * 64 + c[i + 2] + (3 << 20)] += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abzé ñ.1\n", max_size=40))
def test_grams_and_order(text):
    keys, n = li.grams(li.new_coder(ALPHABET).codes(text))
    assert dict(zip(keys.tolist(), n.tolist())) == brute(text)
    for size in (3, 300):
        assert li.ranked(keys, n, size).tolist() == [k for k, _ in sorted(brute(text).items(), key=lambda x: (-x[1], x[0]))][:size]


def test_distance():
    coder = li.new_coder(ALPHABET)
    texts = {"p": "abc abd abe", "q": "cde ced dec"}
    learned = {k: li.ranked(*li.grams(coder.codes(t))).tolist() for k, t in texts.items()}
    profiles = li.Profiles(ALPHABET, learned)
    own = li.ranked(*li.grams(coder.codes("abc dec"))).tolist()
    off = {k: sum(abs(i - v.index(g)) if g in v else li.PROFILE for i, g in enumerate(own)) for k, v in learned.items()}
    best = min(sorted(off), key=off.get)
    lang, score = profiles.predict(coder, "abc dec")
    assert lang == best and np.isclose(score, 1 - off[best] / (li.PROFILE * len(own)))
    assert profiles.predict(coder, None) == profiles.predict(coder, "12 ²") == ("und", 0.0)
    assert profiles.predict(coder, "日本")[0] in ("p", "q")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = li.learn(docs, train_fold(F.col("doc_id"), 5) != 0)
    got = li.identify(docs, profiles).join(docs, "doc_id").where(train_fold(F.col("doc_id"), 5) == 0).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(1, None, None, 1), (2, "", "en", 2), (None, "hello there", "en", 3), (4, "x" * 300_000, None, 4), (4, "x" * 300_000, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    profiles = li.learn(docs, F.lit(True))
    got = li.identify(docs, profiles).collect()
    assert sorted((r.lang_pred for r in got)) == ["en", "en", "en", "und", "und"]
    assert li.identify(docs.limit(0), profiles).count() == 0
    nothing = li.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in li.identify(docs, nothing).collect()} == {"und"}


def test_many_scripts(spark):
    rng = random.Random(8)
    starts = {"en": (97, 26), "ru": (0x430, 32), "el": (0x3B1, 17), "zh": (0x4E00, 60), "ja": (0x3041, 80), "ko": (0xAC00, 60), "ar": (0x62A, 17), "hi": (0x915, 30), "th": (0xE01, 40)}
    rows = []
    for lang, (first, size) in starts.items():
        letters = [chr(first + i) for i in range(size)]
        for i in range(60 if lang in ("en", "ru", "el") else 12):
            rows.append((len(rows), " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(80)), lang, i % 4 == 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held boolean")
    profiles = li.learn(docs, ~F.col("held"))
    got = li.identify(docs.where("held"), profiles).join(docs, "doc_id").collect()
    assert len(got) > 50 and all(r.lang_pred == r.lang for r in got)


def test_wide_grams():
    keys, n = li.grams(li.new_coder("x" * 62).codes("日本 日1\U00020000"))
    a, b, c, w = ord("日"), ord("本"), 0x20000, li.WIDE
    one, two, three = (k << 3 * w for k in (1, 2, 3))
    want = {one + a: 2, one + b: 1, one + c: 1, two + a: 2, two + (a << w | b): 1, two + (b << w): 1, two + (a << w): 1, two + c: 1, two + (c << w): 1}
    want |= {three + (a << w | b): 1, three + (a << 2 * w | b << w): 1, three + (a << w): 1, three + (c << w): 1}
    assert dict(zip(keys.tolist(), n.tolist())) == want
