import random
import xml.parsers.expat

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.scanner import PENDING, ScanConfig, Scanner, scan_bytes
from tessera.sources.samples import BROKEN, LOGBOOK, SCHEMA

DOCS = {
    "logbook": LOGBOOK, "broken": BROKEN, "schema": SCHEMA,
    "bom": "﻿<a><b/></a>", "cdata": '<r><![CDATA[<not/> & "raw" ]]]><x/></r>', "comments": "<!-- lead --><r><!--in--><a/><!-- multi\nline --></r><!-- trail -->",
    "pi": '<?xml version="1.0"?><?php echo "x" ?><r><?target data?></r>', "doctype": "<!DOCTYPE r [ <!ELEMENT r (#PCDATA)> ]><r>text</r>",
    "entities": "<r>a &amp; b &lt;c&gt; &#65; &#x42; &unknown; &;</r>", "attrs": "<r a=\"1\" b='2' c = \"3\" d=\"&quot;q&quot;\" e=\"<bad\" />",
    "crlf": "<r>\r\n<a/>\r\n</r>\r\n", "utf8": "<r><t>Vardø … ключ … 海图 … 𝄞</t></r>", "nested": "<a>" + "<b>" * 40 + "x" + "</b>" * 40 + "</a>",
    "empty": "", "text": "hello", "unclosed": "<a><b", "bad_name": "<1bad/>", "mismatch": "<a></b>", "extra": "<a/></a>", "two": "<a/><b/>", "dup": '<a x="1" x="2"/>',
    "amp": "<a>tar & rope</a>", "lt": "<a>ebb < flood</a>", "unquoted": "<a k=v/>", "dashes": "<a><!--u--v--></a>", "gt": "<a>flood > ebb</a>", "many": "<r " + " ".join(f'a{i}="{i}"' for i in range(80)) + ' a3="x"/>',
    "brackets": "<a>]]&amp;> ]]> ]]]> ] ]></a>", "names": "<a\n x = '1'\n/><b></b\n>", "ends": "<a></ b></a x>", "bang": "<a><!x><!-x><![CDAT[x]]></a>", "dash3": "<a><!-- x ---></a><!---->",
    "ref": "<a>&" + "x" * 40 + "; &#xZZ; &é;</a>", "attr": "<a b c=d e = f g=\"1\"h='2' / ></a>", "slash": "<a / b='1'></a>", "nul": "<a>\x00</a>", "late": "<a><b></a>\n\n</a>\n",
}


def codes(text, **options):
    return [(e.code, e.fix) for e in scan_bytes(text.encode(), ScanConfig(**options)).errors]


@pytest.mark.parametrize("text", ['<?xml version="1.0" encoding="UTF-8"?><root/>', "<a><b x=\"1\" y='2'>t</b><b/></a>", DOCS["comments"], DOCS["pi"], DOCS["cdata"], DOCS["doctype"], DOCS["bom"], "<é>x</é>", "<a>]] ]]&gt; ]</a>", "<a>&#x1F600; &apos; &custom-ent;</a>", LOGBOOK, SCHEMA])
def test_well_formed(text):
    assert codes(text) == []


GOLDENS = {
    "": [("D25", "Add a root element")],
    "<p/><q/>": [("D01", "Wrap both elements in a single root element")],
    "ahoy<p/>": [("D04", "Remove the stray text or move it inside the root element")],
    "<p/>ahoy": [("D05", "Remove the stray text or move it inside the root element")],
    "<p>&#q1;</p>": [("D02", "Escape the ampersand as &amp;")],
    "<p>tar & rope</p>": [("D07", "Replace '&' with '&amp;'")],
    "<p>ebb < flood</p>": [("D08", "Escape the '<' as &lt;")],
    "<p>u ]]> v</p>": [("D03", "Escape as ]]&gt;")],
    "<p k='7' k='8'/>": [("D11", "Remove the duplicate attribute")],
    "<p k=v></p>": [("D14", "Enclose the value in double quotes")],
    "<p k='ebb < flood'/>": [("D15", "Escape as &lt;")],
    "<p><!-- u -- v --></p>": [("D23", "Replace '--' with '- -'")],
    "<p/></q>": [("D18", "Delete this end tag")],
    "<p><q></r></p>": [("D19", "Change to </q>")],
    "<p><q><r></p>": [("D19", "Insert </r></q>")],
    "<p><q><r>": [("D27", "Append </r></q></p>")],
    "<p><!-- adrift": [("D26", None), ("D27", "Append </p>")],
}


@pytest.mark.parametrize("text", GOLDENS)
def test_goldens(text):
    assert codes(text)[: len(GOLDENS[text])] == GOLDENS[text]
    assert codes(text, fast=False) == codes(text)


def test_broken_timetable():
    found = [(e.code, e.line) for e in scan_bytes(BROKEN.encode()).errors]
    assert found == [("D11", 3), ("D14", 4), ("D07", 5), ("D07", 5), ("D08", 6), ("D23", 7), ("D19", 8), ("D19", 9), ("D02", 10), ("D03", 11), ("D19", 13)]


def test_index():
    text = '<?xml version="1.0"?>\n<deck>\n  <crate no="1">\n<net/>\n  </crate></deck>\n'
    ix = scan_bytes(text.encode())
    assert (ix.total_elements, ix.total_attributes, ix.max_depth, ix.line_count) == (3, 1, 3, 6)
    assert (ix.parent, ix.depth, ix.line) == ([-1, 0, 1], [0, 1, 2], [2, 3, 4])
    assert ix.end[0] == len(text) - 1 and ix.children_of(0) == [1]
    assert scan_bytes(b'<a\n x="1"/>').line == [2]


def test_checkpoints_and_budget():
    text = "<r>\n" + "".join(f"<i n='{k}'/>\n" for k in range(200)) + "</r>"
    ix = scan_bytes(text.encode())
    starts = [0] + [k + 1 for k, c in enumerate(text) if c == "\n"]
    assert ix.checkpoints == starts[::32]
    assert ix.seek_line(70) == (ix.checkpoints[2], 6)
    rows = "<t>" + "<row><cell/></row>" * 50 + "</t>"
    ix = scan_bytes(rows.encode(), ScanConfig(max_indexed=40))
    assert (ix.total_elements, ix.indexed) == (101, 70) and all(d <= 1 for d in ix.depth[40:])
    bad = scan_bytes(("<a>" + "<b>x & y</b>" * 50 + "</a>").encode(), ScanConfig(max_errors=5))
    assert (len(bad.errors), bad.error_count) == (5, 50)


def state(text: bytes, cuts, **options):
    scanner, at = Scanner(ScanConfig(**options)), 0
    for cut in [*sorted(cuts), len(text)]:
        scanner.feed(text[at:cut])
        at = cut
    ix = scanner.finish()
    merged = []
    for c in ix.contents:  # a text run may be reported in pieces
        if merged and c[1] == "text" and merged[-1][1] == "text" and merged[-1][3] == c[2] and merged[-1][0] == c[0]:
            merged[-1] = (*merged[-1][:3], c[3])
        else:
            merged.append(c)
    return ix.start, ix.end, ix.line, ix.parent, ix.name, ix.depth, ix.names, ix.checkpoints, ix.errors, ix.attributes, merged, ix.total_elements, ix.total_attributes, ix.max_depth, ix.error_count, ix.line_count, ix.file_len


@pytest.mark.parametrize("name", DOCS)
def test_any_cut_gives_the_same(name):
    text = DOCS[name].encode()
    whole = state(text, [])
    assert state(text, [], fast=False) == whole
    for size in (1, 2, 3, 7, 64):
        assert state(text, range(size, len(text), size)) == whole
    rng = random.Random(name)
    for _ in range(5):
        assert state(text, sorted(rng.sample(range(len(text) + 1), min(6, len(text))))) == whole


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="<>/ab=\"'&; !-[]?CDAT\n", max_size=60), st.integers(1, 9))
def test_fast_path_and_cuts_agree_on_anything(text, size):
    raw = text.encode()
    whole = state(raw, [], fast=False)
    assert state(raw, []) == whole == state(raw, range(size, len(raw), size))


TREE = st.recursive(st.sampled_from(["", "t&amp;", "<c/>", "<!--x-->", "<![CDATA[<]]>"]), lambda inner: st.lists(inner, max_size=4).map(lambda x: f"<e k='v'>{''.join(x)}</e>"), max_leaves=12)


@settings(max_examples=100, deadline=None)
@given(TREE)
def test_agrees_with_expat(tree):
    text = f"<root>{tree}</root>"
    xml.parsers.expat.ParserCreate().Parse(text, True)
    ix = scan_bytes(text.encode())
    assert not ix.errors and ix.end[0] == len(text) and PENDING not in ix.end


def test_partial():
    text = ("<r>" + "<o><i/></o>" * 400 + "</r>").encode()
    scanner = Scanner()
    scanner.feed(text[:2048])
    ix = scanner.snapshot()
    assert ix.file_len == 2048 and ix.indexed > 100 and not ix.errors
    assert scanner.progress()["elements"] == ix.total_elements
