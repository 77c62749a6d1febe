import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.scanner import ScanConfig, scan_bytes
from tessera.operators.scan import _totals_of, _slow_totals
from tessera.operators.vector_scan import vector_scan, vector_totals
from tessera.sources.samples import BROKEN, LOGBOOK, SCHEMA
from tests.test_scanner import DOCS

FIELDS = ("start", "end", "line", "parent", "name", "depth", "names", "checkpoints", "total_elements", "total_attributes", "max_depth", "line_count", "file_len")


def same(raw: bytes) -> bool:
    got = vector_scan(raw)
    if got is None:
        return False
    want = scan_bytes(raw, ScanConfig(contents=False))
    assert not want.errors
    for f in FIELDS:
        assert getattr(got, f) == getattr(want, f), f
    return True


@pytest.mark.parametrize("name", DOCS)
def test_agrees_or_declines(name):
    same(DOCS[name].encode())


def test_regular_documents_are_taken():
    assert same(LOGBOOK.encode()) and same(SCHEMA.encode()) and vector_scan(BROKEN.encode()) is None
    assert same(b"<a>" + b'<b x="1" y="2">t &amp; u</b>\n<c/>\n<d\n>&#65;</d >' * 400 + b"</a>\n<!-- x <y> & -->\n")
    assert same("﻿<?xml version='1.0'?>\n<é><ü k=\"'\">x</ü></é>".encode()) is False
    assert same("﻿<?xml version='1.0'?>\n<é><ü k=\"v\">x</ü></é>".encode())


PIECES = st.sampled_from(["<a>", "</a>", "<b>", "</b>", "<c/>", '<a k="1">', '<b k="1" j="&amp;">', '<a k="1" k="2">', "<a k='1'>", "text", " \n", "&lt;", "& ", ">", "]]>", "<!-- c -->", "<!-- - -->", "<![CDATA[<a>&]]>", "<?p x?>", "</a >", "<a\n>", '<a k = "x"/>', '<a k="1"j="2">', '<a k="1" "2">', "<1>", "< a>", "<!DOCTYPE a>", "<", "é", '<a k="1"/ >', "<a/b>"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=14), st.booleans())
def test_never_wrong(pieces, wrap):
    text = "".join(pieces)
    same((f"<r>{text}</r>" if wrap else text).encode())


TREE = st.recursive(st.sampled_from(["", "t&amp;", "<c/>", "<!--x-->", "<![CDATA[<]]>", '<c z="1" y="2"/>']), lambda inner: st.lists(inner, max_size=4).map(lambda x: f'<e k="v">{"".join(x)}</e>'), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(TREE)
def test_takes_every_regular_tree(tree):
    assert same(f"<root>{tree}</root>".encode())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=6).map("".join), min_size=1, max_size=5), st.booleans())
def test_documents_laid_end_to_end(texts, wrap):
    contents = [(f"<r>{t}</r>\n" if wrap else t).encode() for t in texts]
    got = vector_totals(contents)
    if got is not None:
        assert [(b, n, e, e, a, d, 0) for b, n, e, a, d in got] == [_slow_totals(c) for c in contents]


@settings(max_examples=150, deadline=None)
@given(st.lists(TREE, min_size=2, max_size=6))
def test_regular_documents_are_taken_together(trees):
    contents = [f"<?xml version=\"1.0\"?>\n<root>{t}</root>\n".encode() for t in trees]
    assert vector_totals(contents) is not None


def test_mixed_batches():
    contents = [(f"<r n=\"{i}\">" + "<x/>" * 300 + ("</r>" if i != 13 else "")).encode() for i in range(40)] + [b"", b"<a/>"]
    assert _totals_of(contents) == [_slow_totals(c) for c in contents]
