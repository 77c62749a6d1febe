import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import exact_dedup, mixing, quality
from tessera.llm.queries import vocabulary_path
from tests.llm.test_exact_dedup import LOWER
from tests.llm.test_simhash import brute_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in documents.collect()}
    docs, ids = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out = docs.collect()
        ids.append([r.doc_id for r in out])
        if name != "BPE encoding":
            assert docs.columns == documents.columns and all(r == rows[r.doc_id] for r in out)
    judged = {r.doc_id: r.kept for r in quality.judge(documents, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(ids[0]) == {d for d, kept in judged.items() if kept}
    best = {}
    for d in ids[0]:
        key = rows[d].text.translate(LOWER)
        best[key] = max(best.get(key, d), d)
    assert sorted(ids[1]) == sorted(best.values())
    left = sorted(ids[1])
    components = brute_components([slow_fingerprint(rows[d].text) for d in left])
    assert sorted(ids[2]) == sorted({left[c] for c in components})
    assert sorted(ids[3]) == sorted(ids[2]) and ids[3] != sorted(ids[3])
    tokenizer = tokenizers.Tokenizer.from_file(vocabulary_path())
    for r in out:
        assert list(r.token_ids) == tokenizer.encode(rows[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)
    assert exact_dedup.normalized("Ab") == b"ab"


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert set(got.columns) == {"doc_id", "lang", "source", "n_chars", "token_ids", "n_tokens"} and got.count() > 50


def test_run_keeps_the_order_of_the_mixture(spark):
    # several files of different sizes: a scan reads the longest first
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = [r.doc_id for r in corpus_pipeline.run(spark, SF).collect()]
        kept = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(got))
        want = [r.doc_id for r in mixing.place(kept).orderBy("position").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


def test_stages_take_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "word " * 50_000, None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS row", "1 AS bucket", "2 AS fp", "3 AS position")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, odd, SF)
        assert out.count() <= 4
        assert stage(spark, odd.limit(0), SF).count() == 0
        if name != "BPE encoding":
            assert out.columns == odd.columns
    assert corpus_pipeline.STAGES[0][1](spark, odd, SF).count() == 0
