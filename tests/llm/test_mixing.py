import math
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import mixing

WEIGHTS = st.dictionaries(st.sampled_from("abcdefg"), st.integers(1, 60), min_size=1)


@settings(max_examples=200, deadline=None)
@given(WEIGHTS, st.booleans())
def test_any_prefix_deviates_by_less_than_one_block_from_the_target(weights, odd):
    weights = {s: w**0.37 if odd else float(w) for s, w in weights.items()}
    total, had = sum(map(Fraction, weights.values())), Counter()
    slots = mixing.one_phase(weights, {s: 400 for s in weights})
    for t, s in enumerate(slots, 1):
        had[s] += 1
        assert all(abs(had[x] - Fraction(w) / total * t) < 1 for x, w in weights.items())
    assert had[slots[-1]] == 400 == max(had.values())


def test_small_targets_and_many_periods():
    weights = {f"s{i}": 1.0 for i in range(20)} | {"rare": 0.0001, "odd": 0.3333}
    slots = mixing.one_phase(weights, dict.fromkeys(weights, 4000))
    total, had = sum(weights.values()), Counter()
    for t, s in enumerate(slots, 1):
        had[s] += 1
        if t % 97 == 0:
            assert all(abs(had[x] - w / total * t) < 1 for x, w in weights.items())
    assert len(slots) > 75_000 and had["rare"] <= 1


def slow(blocks, weights):
    """Slot by slot: of the blocks whose release has come the one with the earliest deadline."""
    left, out = dict(blocks), []
    while any(left.values()):
        active = {s: Fraction(weights.get(s, 0)) for s in left if left[s] and weights.get(s, 0) > 0} or {s: Fraction(1) for s in left if left[s]}
        total, done, t = sum(active.values()), Counter(), 0
        while all(left[s] for s in active):
            released = [s for s in active if math.floor(done[s] * total / active[s]) <= t]
            s = min(released, key=lambda s: (math.ceil((done[s] + 1) * total / active[s]), -active[s], s))
            left[s] -= 1
            done[s] += 1
            out.append(s)
            t += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(1, 300), min_size=1), WEIGHTS)
def test_schedule_places_every_block_once(blocks, weights):
    slots = mixing.schedule(blocks, {s: float(w) for s, w in weights.items()})
    assert slots == slow(blocks, weights) and Counter(slots) == blocks


def test_blocks_grow_with_the_corpus():
    assert mixing.block_size({"a": 1000, "b": 1}) == mixing.BLOCK
    many = {"a": 10**10, "b": 7}
    size = mixing.block_size(many)
    assert sum(math.ceil(n / size) for n in many.values()) <= mixing.MAX_SLOTS + len(many) and 1.01 * size * mixing.MAX_SLOTS > 10**10


@pytest.mark.parametrize("weights", [None, {"x": 3.0, "y": 1.0}])
def test_rows(spark, weights, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(i, f"t{i}", "x") for i in range(600)] + [(1000 + i, None, "y") for i in range(90)] + [(None, "", None), (5, "t5", "x"), (5, "t5", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS slot", "2 AS position", "3 AS first")
    got = mixing.place(docs, weights, block=4).orderBy("position").collect()
    assert len(got) == len(rows) == len({r.position for r in got})
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
    if weights:
        assert got[-1].source == ""
        had = Counter()
        for t, s in enumerate([r.source for r in got][::4][:90], 1):
            had[s] += 1
            assert abs(had["x"] - 0.75 * t) < 1
    mixed = mixing.mix(docs, weights, block=4)
    assert mixed.columns == docs.columns
    order = [r.doc_id for r in mixed.collect()]
    assert [str(x) for x in order if x != 5] == [str(r.doc_id) for r in got if r.doc_id != 5]
    assert mixing.place(docs.limit(0)).count() == 0 == mixing.mix(docs.limit(0)).count()
