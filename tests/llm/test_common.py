import os

import pyarrow as pa

from tessera.llm import common


def test_shuffle_files_go_with_the_table(spark):
    df = common.materialize(spark.range(1000).groupBy("id").count(), "probe")
    assert spark.conf.get(common._FILE_CLEANUP) in ("true", "false")
    path = common._path_of[id(df)].removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 1000
    common.discard(df)
    assert not os.path.isdir(path)


def test_join_hot_is_the_inner_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 0.3)
    left = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 7), (3, 8), (9, 9)], "k int, v int")
    right = spark.createDataFrame([(1, 6, "a"), (2, 1, "b"), (3, 1, "c"), (4, 0, "d")], "k int, n long, w string")
    got = common.join_hot(left, right, ["k"], "n", 9).select("k", "v", "w").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, left.join(right, "k").select("k", "v", "w").collect()))


def test_filter_of_ids_misses_none(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("if(id % 50 = 0, null, id) AS id", "id AS place", "'x' AS word")
    ids = spark.range(0, 3000, 7).selectExpr("id").union(spark.createDataFrame([(None,)], "id long"))
    for bits in (64, 1 << 26):  # a full filter only asks for more rows
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        got = common.maybe_among(rows, "id", ids, "maybe")
        assert got.columns == ["id", "place", "word", "maybe"] and got.count() == 3000
        found = {(r.id, r.place) for r in got.where("maybe").collect()}
        assert found >= {(None if p % 50 == 0 else p, p) for p in range(3000) if p % 50 == 0 or p % 7 == 0}
    assert len(found) < 600
    assert common.maybe_among(rows, "id", ids.limit(0), "maybe").where("maybe").count() == 0


def test_pieces_are_bounded():
    texts = pa.array(["ab" * n for n in range(300)] + [None, "", "x" * 100_000])
    parts = list(common.pieces(texts, 5000))
    assert pa.concat_arrays(parts).equals(texts) and all(p.nbytes < 9000 or len(p) == 1 for p in parts)
    assert [len(p) for p in common.pieces(texts.slice(0, 0))] == [0]
