import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe
from tessera.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
PATH = vocabulary_path()
OURS = bpe.ByteBpe(open(PATH, "rb").read())
THEIRS = tokenizers.Tokenizer.from_file(PATH)
ODD = ["", " ", "\n\n  x", "Hello, world's  end\t\t!", "a" * 5000, "ab" * 3000, "é" * 400, "日本語テキスト 123４５", "x<|endoftext|>y <|endoftext|><|endoftext|>", "🙂🙂 ok  z", "don't we'll I'M", "\x00\x01", "1234567890" * 40]


@pytest.mark.parametrize("text", ODD)
def test_same_ids_as_the_library(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.decode(ids) == text


@given(st.text(alphabet="abcd eth", min_size=1, max_size=200))
@settings(max_examples=100, deadline=None)
def test_scan_and_heap_agree(word):
    parts = [OURS.base[b] for b in word.encode()]
    assert OURS._scan(list(parts)) == OURS._heap(list(parts))


def test_rows(spark):
    rows = [(1, "Hello world", "x"), (None, None, "y"), (1, "Hello world", "x"), (3, "", None), (4, "z " * 40_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = bpe.round_trip(docs, PATH).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "Hello world", None: "", 3: "", 4: "z " * 40_000}[r.doc_id]
        ids = THEIRS.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    coded = bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "token_ids", "n_tokens"]
    back = {(r.doc_id, r.text) for r in bpe.decode(coded, PATH).collect()}
    assert back == {(1, "Hello world"), (None, ""), (3, ""), (4, "z " * 40_000)}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.round_trip(docs, PATH).collect():
        ids = THEIRS.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
