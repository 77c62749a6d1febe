import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simhash


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBc É\n\t ", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_text_in_steps(monkeypatch):
    text = " ".join(f"w{i % 97} z{i % 31}" for i in range(500))
    monkeypatch.setattr(simhash, "_STEP", 7)
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3), st.booleans())
def test_every_link_shares_a_key_whose_chain_holds(x, flips, wide):
    y = x
    for b in flips:
        y ^= 1 << b
    fp = np.array([x, y], np.uint64).view(np.int64)
    a, b = (set(r) for r in simhash.chain_keys(fp, wide).tolist())
    d = np.array([x ^ y], np.uint64)
    assert any(simhash.within_chain(d, k >> 36)[0] for k in a & b)


def test_chain_means_within_budget():
    rng = np.random.default_rng(0)
    d = rng.integers(0, 2**64, 20000, dtype=np.uint64) & rng.integers(0, 2**64, 20000, dtype=np.uint64) & rng.integers(0, 2**64, 20000, dtype=np.uint64) & rng.integers(0, 2**64, 20000, dtype=np.uint64)
    d &= rng.integers(0, 2**64, 20000, dtype=np.uint64)
    fine = np.any([simhash.within_chain(d, i) for i in range(4)], axis=0)
    assert np.array_equal(fine, np.bitwise_count(d) <= 3)


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("block,wide", [(2048, 1 << 22), (3, 1 << 22), (4, 0)])
def test_components_of_links(spark, block, wide):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randint(0, 63)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block, wide)).collect()}
    classes = defaultdict(set)
    for i, c in enumerate(brute_components(fps)):
        classes[c].add(signed[i])
    for members in classes.values():
        assert {got.get(x, x) for x in members} == {min(members)}


def test_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + " end"), (None, base), (7, None), (8, ""), (8, ""), (2, "other text altogether for sure " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS root", "3 AS component_id")
    fps = [slow_fingerprint(t) for _, t in rows]
    want = brute_components(fps)
    least = {c: min((d for (d, _), x in zip(rows, want) if x == c and d is not None), default=None) for c in want}
    got = simhash.classify(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted((str(d), f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, want))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.classify(docs.limit(0)).count() == 0
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [slow_fingerprint(t) for _, t in rows]
    want = {rows[i][0]: rows[c][0] for i, c in enumerate(brute_components(fps))}
    assert {r.doc_id: r.component_id for r in simhash.classify(docs).collect()} == want
