import hashlib
import string
from collections import defaultdict

from tessera.llm import exact_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        groups[(text or "").translate(LOWER)].append((doc_id if doc_id is not None else -(1 << 63), -k, doc_id))
    return groups


ROWS = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (None, "abc"), (7, "É"), (8, "é"), (9, "x" * 200_000), (10, "X" * 200_000), (2, "aBC"), (None, "only"), (11, "q\n"), (12, "Q\n")]


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).selectExpr("*", "7 AS kept", "'s' AS sha", "doc_id AS rid")
    got = exact_dedup.classify(docs, **options).collect()
    assert len(got) == len(rows)
    groups = brute(rows)
    for r in got:
        assert r.group_size in {len(g) for g in groups.values()}
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in got:
        g = by_sha[r.text_sha256]
        assert r.group_size == len(g)
        assert r.keep_id == max(g)[2]
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    rest = exact_dedup.deduplicate(docs, **options)
    assert rest.columns == docs.columns
    assert sorted((r.text or "").translate(LOWER) for r in rest.collect()) == sorted(groups)


def test_small(spark):
    check(spark, ROWS)


def test_recursive_partitioning(spark):
    check(spark, ROWS + [(100 + i, f"text {i % 37}") for i in range(200)], bucket_bytes=2000)


def test_only_oversize_buckets_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TABLE_BYTES", 1500)  # the common text leaves every local table
    rows = ROWS[:8] + [(100 + i, "common " * 40 if i % 3 else f"text {i}") for i in range(300)]
    check(spark, rows, bucket_bytes=2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    _, levels = exact_dedup._partitioned(docs, F.struct("text"), 100)
    buckets = [{r.bucket for r in level.select("bucket").distinct().collect()} for level in levels]
    assert len(levels) > 1 and all(len(b) == len(next(iter(bs))) for bs in buckets if bs for b in bs)
    for shallow, deep in zip(buckets, buckets[1:]):
        assert not any(b.startswith(a) for a in shallow for b in deep)
    table = exact_dedup._Bucket(True)
    record = exact_dedup._records(1, *[[k] * 1 for k in (7,)], ["ab" * 32], [3], [5], [2], [4], exact_dedup.pa.array([{"text": "Same"}]))
    for _ in range(5000):
        table.add(record)
    assert table.size == [10000] and len(table.table.contents) == 1 and len(table.rows) == 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.classify(docs).count() == 0
    assert exact_dedup.deduplicate(docs).count() == 0


def test_equal_keys_are_settled_by_content():
    table = exact_dedup.OpenTable(4)
    assert [table.index(5, b"a"), table.index(5, b"b"), table.index(5, b"a"), table.index(9, b"a")] == [0, 1, 0, 2]
