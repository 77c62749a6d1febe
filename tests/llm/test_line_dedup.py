import random
from collections import defaultdict

import pyarrow as pa

from tessera.llm import line_dedup as ld


def brute(docs, min_docs=ld.MIN_DOCS):
    """The definition, over plain dictionaries: (document, line number) of every line that goes."""
    lines = [(d, k, tuple(ld.tokens_of(line))) for d, text in enumerate(docs) for k, line in enumerate((text or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    leaf = lambda t: (len(t), t[: ld.DEPTH])
    reach, have = defaultdict(set), defaultdict(set)
    for d, _, t in lines:
        reach[leaf(t)].add(d)
        have[t].add(d)
    support = defaultdict(int)
    for t, ds in have.items():
        for i, w in enumerate(t):
            support[leaf(t), i, w] += len(ds)
    def template(t):
        if len(reach[leaf(t)]) < min_docs:
            return None
        fixed = tuple((i, w) for i, w in enumerate(t) if w != ld.FIELD and support[leaf(t), i, w] >= min_docs)
        masked = sum(w == ld.FIELD for w in t)
        return (leaf(t), fixed) if fixed and len(fixed) >= ld.FIXED * len(t) and len(fixed) + masked >= ld.AGREE * len(t) else None
    of = defaultdict(set)
    for d, _, t in lines:
        if (x := template(t)) is not None:
            of[x].add(d)
    return {(d, k) for d, k, t in lines if (x := template(t)) is not None and len(of[x]) >= min_docs}


def make(rng, n):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzuvw"]
    docs = []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(3, 9))) for _ in range(rng.randint(0, 4))]
        if i % 3 == 0:
            lines.append(f"Page {i} of {n}")
        if i % 4 == 0:
            lines.insert(0, "Released under the open licence by its authors")
        if i % 5 == 0:
            lines.append(f"posted by user {rng.choice(words)}{rng.choice(words)} in the general group today")
        if i % 7 == 0:
            lines += ["", "  "]
        docs.append("\n".join(lines))
    return docs


def test_against_brute_force(spark):
    docs = make(random.Random(4), 150)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = brute(docs)
    assert {(r.doc_id, r.number) for r in ld.recurring(df).collect()} == want
    texts = {docs[d].split("\n")[k] for d, k in want}
    assert "Released under the open licence by its authors" in texts and any(t.startswith("Page ") for t in texts) and any(t.startswith("posted") for t in texts)
    for r in ld.deduplicate(df).collect():
        kept = [x for k, x in enumerate(docs[r.doc_id].split("\n")) if (r.doc_id, k) not in want]
        assert r.text == "\n".join(kept) and r.n_lines == len(docs[r.doc_id].split("\n")) and r.n_dropped == r.n_lines - len(kept)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    want = {(rows[d][0], k) for d, k in brute([t for _, t in rows])}
    assert {(r.doc_id, r.number) for r in ld.recurring(df).collect()} == want


def test_edges(spark):
    line = "the same line of text here"
    rows = [(None, line), (1, None), (2, ""), (3, line + "\n" + "w " * 100_000)] + [(7, line)] * 3 + [(8, line), (9, "x\n" + line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS mark", "2 AS numbers", "3 AS leaf")
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in ld.deduplicate(df).collect()), key=str)
    assert len(got) == len(rows)
    assert [g for g in got if g[0] == 7] == [(7, "", 1)] * 3 and (None, "", 1) in got and (1, None, 0) in got and (2, "", 0) in got
    assert next(g for g in got if g[0] == 3)[1] == "w " * 100_000
    assert ld.deduplicate(df.limit(0)).count() == 0


def test_lines_of_fields_that_recur_word_for_word(spark):
    often = ["Tel: 555 1234", "2024-01-01 12:00:00 GET 10.0.0.1 200", "2024-01-01", "https://a.example/b"]
    rows = [(i, f"{'abcdef'[i]}own\n" + "\n".join(often) + f"\n2023-02-0{i} 555 77{i}\n") for i in range(6)]
    rows += [(10 + i, "only 4 of 7 9 1") for i in range(ld.MIN_DOCS - 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ld.deduplicate(df).collect()}
    for i in range(6):
        assert got[i].text == f"{'abcdef'[i]}own\n2023-02-0{i} 555 77{i}\n" and got[i].n_dropped == len(often)
    assert all(got[10 + i].n_dropped == 0 for i in range(ld.MIN_DOCS - 1))


def test_tokens_of_many_lines_are_hashed_together(monkeypatch):
    lines = ["a bc <*> a", "<*>", "é\x85x bc", "w" * 200_000 + " bc"]
    bounds, hashes = ld.token_hashes(lines)
    assert bounds.tolist() == [0, 4, 5, 7, 9] and hashes[[2, 4]].tolist() == [-1, -1]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[6] == hashes[8] and len(set(hashes.tolist())) == 5 and (hashes[[0, 1, 5, 7]] >= 0).all()
    assert ld.token_hashes([])[0].tolist() == [0]
    seen, whole = [], ld._codes
    monkeypatch.setattr(ld, "_codes", lambda line: seen.append(line) or whole(line))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, None, 3], "mark": [5, 6, 7], "text": ["a 1\nb\n\nb", "b\n\na 1", None]})
    (got,) = ld._parse(iter([batch]))
    assert sorted(seen) == ["", "a 1", "b"]  # a line is taken apart once
    assert list(zip(*(got.column(c).to_pylist() for c in ("kind", "doc_id", "mark", "number", "in_leaf", "in_line", "tokens")))) == [
        *((0, 1, 5, k, first, first, None) for k, first in ((0, True), (1, True), (3, False))),
        *((0, None, 6, k, True, True, None) for k in (0, 2)),
        *((1, None, None, None, None, None, t.tolist()) for t in (ld.token_hashes(["a <*>"])[1], ld.token_hashes(["b"])[1])),
    ]
