import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import scalars as fn
from tessera.operators import edits, navigate, schema, search, table, text, xslt
from tessera.operators.scan import scan, totals, validate, well_formed
from tessera.operators.scanner import ScanConfig, Scanner, scan_bytes
from tessera.sources import documents as docs
from tessera.sources import index_file
from tessera.sources.samples import BROKEN, LOGBOOK, NAMESPACE, SCHEMA, samples
from tessera.streaming import chunks


@pytest.fixture(scope="module")
def book(spark):
    s = scan(spark.createDataFrame([(1, LOGBOOK.encode())], "doc_id long, content binary")).persist()
    yield s
    s.unpersist()


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# scalars


def test_scalars():
    assert fn.decode_entities("&lt;a&gt; &#65;&#x42; &amp;lt; &unknown; &#x110000;") == "<a> AB &lt; &unknown; &#x110000;"
    assert fn.escape_xml('<a b="&">') == "&lt;a b=&quot;&amp;&quot;&gt;"
    assert fn.local_name("a:b:c") == "b:c"
    cases = {"1": "xs:positiveInteger", "0": "xs:integer", "-5": "xs:integer", "007": "xs:integer", "1.5": "xs:decimal", ".5": "xs:decimal", "2026-01-02": "xs:date", "2026-01-02T10:00:00Z": "xs:dateTime", "true": "xs:boolean", "https://x": "xs:anyURI", "1\n": "xs:string", "": "xs:string"}
    assert {v: fn.guess_type(v) for v in cases} == cases
    assert fn.merge_types(["xs:integer", "xs:decimal", "xs:positiveInteger"]) == "xs:decimal" and fn.merge_types(["xs:date", "xs:integer"]) == "xs:string" and fn.merge_types([]) is None
    assert [fn.parse_size(s) for s in ("1024", "2KiB", "1.5MiB", "10GiB")] == [1024, 2048, 1572864, 10 << 30]
    with pytest.raises(ValueError):
        fn.parse_size("banana")
    assert [fn.human(n) for n in (512, 2048, 3 << 30)] == ["512 B", "2.00 KiB", "3.00 GiB"]
    assert fn.short_size(2048) == "2.0 KiB" and fn.grouped(1234567) == "1,234,567"
    assert fn.leaf_text("<a k='v'> x &amp; <![CDATA[<x &amp;>]]><!--c--> </a>") == "x & <x &amp;>" and fn.leaf_text("<a/>") == ""


def test_columns_equal_scalars(spark):
    values = ["", "1", "0", "-5", "1.5", "x\n", "1\n", "2026-01-02", "true", "http://a", "&lt;&#65;&amp;amp;&#x41;", 'a<b>&"c"', "p:q:r", "plain"]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    for column, f in ((fn.guess_type_column, fn.guess_type), (fn.decode_column, fn.decode_entities), (fn.escape_column, fn.escape_xml), (fn.local_name_column, fn.local_name)):
        assert {r.v: r.o for r in df.select("v", column(F.col("v")).alias("o")).collect()} == {v: f(v) for v in values} | {None: None}
    sizes = [0, 1023, 1024, 1 << 20, 5 << 30, 3 << 41]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", fn.human_column(F.col("n")).alias("h")).collect()
    assert {r.n: r.h for r in got} == {n: fn.human(n) for n in sizes}
    merged = spark.createDataFrame([(["xs:integer", "xs:decimal"],), (["xs:date"],), (["xs:date", "xs:integer"],), ([],)], "t array<string>").select(fn.merge_types_column(F.col("t")).alias("m")).collect()
    assert [r.m for r in merged] == ["xs:decimal", "xs:date", "xs:string", None]
    fn.register(spark)
    assert spark.sql("SELECT xml_guess_type('12') t, xml_decode('&lt;') d").first() == ("xs:positiveInteger", "<")


# scan and sources


def test_scan_views(spark, book):
    assert book.elements.count() == 19 and book.attributes.where("name = 'at'").count() == 4
    assert book.stats.first().errors == 0 and book.diagnostics.count() == 0
    said = {r.text for r in book.elements.where("name in ('keeper', 'verdict')").collect()}
    assert said == {"Ólöf & crew", "level < 3 & falling"}
    all_docs = samples(spark)
    assert {r.name: r.ok for r in well_formed(all_docs).join(all_docs, "doc_id").collect()} == {"logbook.xml": True, "timetable-broken.xml": False, "logbook.xsd": True, "new.xml": True}
    report = scan(all_docs).report(all_docs).collect()
    assert len(report) == 11 and report[0].report.startswith("timetable-broken.xml:3:") and "SmartFix" in report[0].report
    assert {r.schema for r in validate(all_docs).collect()} == {"logbook.xsd", None}
    one = totals(all_docs).where("doc_id = 0").first()
    assert (one.elements, one.bytes) == (19, len(LOGBOOK.encode()))
    part = scan(docs.head(all_docs, 300), complete=False)
    assert part.diagnostics.count() < 11 and part.elements.where("end is null").count() > 0


def test_lines_and_ranges(spark):
    df = spark.createDataFrame([(1, "é\r\nb\n\nlast".encode())], "doc_id long, content binary")
    assert rows(docs.lines(df), "line", "start", "text") == [(1, 0, "é"), (2, 4, "b"), (3, 6, ""), (4, 7, "last")]
    assert rows(docs.lines(df, 2, 4), "line", "text") == [(2, "b"), (3, "")]
    assert docs.from_lines(docs.lines(df, keep_returns=True)).first().content == "é\r\nb\n\nlast".encode()
    assert df.select(docs.byte_range(F.col("content"), 0, 2)).first()[0] == "é"
    asked = spark.createDataFrame([(1, 0), (1, 4), (1, 6), (1, 9)], "doc_id long, offset long")
    assert sorted(rows(navigate.line_of_offset(asked, docs.lines(df)), "offset", "line", "col")) == [(0, 1, 1), (4, 2, 1), (6, 3, 1), (9, 4, 3)]
    assert docs.from_strings(spark.createDataFrame([(1, "xé")], "i long, t string"), "i", "t").first().n_bytes == 3


def test_generated_corpus(spark, tmp_path):
    made = docs.generate(spark, 3, 20)
    assert all(r.errors == 0 and r.elements == 201 and r.attributes == 81 for r in totals(made).collect())
    sized = docs.generate_size(spark, 100_000).first()
    assert 80_000 < sized.n_bytes <= 100_000
    for r in made.collect():
        (tmp_path / r["name"]).write_bytes(r.content)
    back = docs.read_documents(spark, str(tmp_path))
    assert back.count() == 3 and back.first().in_memory
    spark.dataSource.register(docs.ChunkSource)
    path = str(tmp_path / "corpus-0.xml")
    data = open(path, "rb").read()
    parts = spark.read.format("xml_chunks").option("path", path).option("chunk", "100").option("overlap", "7").load()
    assert b"".join(r.content[: r.own] for r in parts.orderBy("chunk_no").collect()) == data
    found = sorted(r.offset for r in search.search_chunks(parts, "report seq").collect())
    assert found == [i for i in range(len(data)) if data.startswith(b"report seq", i)] and os.path.exists(path)


def test_repeated_corpus_and_file_sink(spark, tmp_path):
    made = docs.generate_repeated(spark, 2, 60_000, 20_000)
    assert all(r.errors == 0 and r.bytes > 50_000 for r in totals(made).collect())
    spark.dataSource.register(docs.FileSink)
    made.select("name", "content").write.format("xml_files").mode("append").save(str(tmp_path / "out"))
    assert {(r["name"], r.content) for r in docs.read_documents(spark, str(tmp_path / "out")).collect()} == {(r["name"], r.content) for r in made.collect()}
    line = docs.lines(made)
    assert rows(docs.goto(line, 4), "line") == [(4,), (4,)] and docs.goto(line, 10**9).count() == 2 and rows(docs.goto(line, -5), "line") == [(1,), (1,)]


def test_progress_and_notes(spark):
    from pyspark.sql import Observation

    from tessera.plans.xpath_plan import notes

    seen, s = Observation(), scan(samples(spark), ScanConfig(max_indexed=5))
    assert s.observed(seen).count() == 4 and seen.get["documents"] == 4 and seen.get["errors"] == 11
    assert {r.doc_id: r.note for r in notes(s, "//a").collect()}[0].endswith("of 19 elements.")


@pytest.mark.parametrize("source", [LOGBOOK, BROKEN, SCHEMA, "", "<a>"])
def test_index_file(source):
    ix = scan_bytes(source.encode(), ScanConfig(contents=False))
    back, partial = index_file.decode(index_file.encode(ix, partial=True))
    assert partial and index_file.encode(back, True) == index_file.encode(ix, True)
    assert (back.start, back.end, back.parent, back.names, back.checkpoints) == (ix.start, ix.end, ix.parent, ix.names, ix.checkpoints)
    assert [(e.msg, e.fix) for e in back.errors] == [(e.msg, e.fix) for e in ix.errors]


def test_index_file_errors(spark):
    good = index_file.encode(scan_bytes(LOGBOOK.encode()))
    for bad, kind in ((b"garbage", index_file.Truncated), (b"NOPE" + good[4:], index_file.BadMagic), (good[:4] + b"\x09\x00" + good[6:], index_file.UnsupportedVersion), (good[:-20], index_file.Truncated)):
        with pytest.raises(kind):
            index_file.decode(bad)
    files = index_file.index_files(samples(spark))
    seen = {r.doc_id: r for r in index_file.inspect(files).collect()}
    assert seen[0].elements == 19 and seen[0].names[0] == "logbook" and not seen[0].partial


# navigation


def test_navigation(spark, book):
    e = book.elements
    assert rows(navigate.roots(e), "name") == [("logbook",)]
    kids = navigate.children(e, e.where("name = 'watch'"))
    assert sorted(rows(kids, "name", "child_no")) == [("reading", 1), ("reading", 1), ("reading", 2), ("reading", 3), ("verdict", 2)]
    inner = {r.elem_id for r in navigate.with_children(e).collect()}
    assert inner == {r.elem_id for r in navigate.has_children(e).where("has_children").collect()}
    assert navigate.leaves(e).count() == 19 - len(inner)
    pairs = navigate.descendants(e, e.where("name = 'watch'")).groupBy("ancestor_id").count().collect()
    assert sorted(r["count"] for r in pairs) == [4, 11]
    assert {(r.elem_id, r.path) for r in navigate.computed_paths(e).collect()} == {(r.elem_id, r.path) for r in e.collect()}
    info = {r.path: r for r in navigate.node_info(e, book.attributes).collect()}
    watch = info["/logbook[1]/watch[1]"]
    assert [a.name for a in watch.attrs] == ["no", "day", "open"] and watch.child_count == 3
    opened = e.where("depth = 0")
    assert sorted(rows(navigate.flatten(e, opened), "depth")) == [(0,), (1,), (1,), (1,)]
    assert rows(navigate.flatten(e, opened, cap=1), "more") == [(None,), (None,), (2,)]
    assert navigate.outer_xml(e.where("name = 'level'").limit(1), spark.createDataFrame([(1, LOGBOOK.encode())], "doc_id long, content binary")).first().xml.startswith("<level>")
    assert rows(navigate.seek_line(book.checkpoints, 14), "skip") == [(14,)]
    broken = scan(spark.createDataFrame([(1, BROKEN.encode())], "doc_id long, content binary"))
    assert {r.line: r.n for r in navigate.errors_by_line(broken.diagnostics).collect()}[5] == 2
    assert navigate.heap_bytes(book.stats).first().heap_bytes > 19 * 34


# search


def joins(df):
    """The joins of the plan that ran, where Spark may broadcast whatever it likes."""
    spark, key = df.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1g")
    try:
        df.collect()
        ran = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    finally:
        spark.conf.set(key, before)
    return [word for word in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "ShuffledHashJoin", "SortMergeJoin") for _ in range(ran.count(word))]


@pytest.fixture
def unkept(spark):
    """A scan that is not persisted, of documents with two ids."""
    return scan(spark.createDataFrame([(1, LOGBOOK.encode()), (2, b"<a><b/><c><b/></c></a>")], "doc_id long, content binary"))


def test_descendants_broadcast_no_table_of_elements(unkept):
    e = unkept.elements
    pairs = navigate.descendants(e, e)
    assert joins(pairs) == ["SortMergeJoin"]
    assert sorted((r.ancestor_id, r.elem_id) for r in pairs.where("doc_id = 2").collect()) == [(0, 1), (0, 2), (0, 3), (2, 3)]


def test_computed_paths_broadcast_no_table_of_elements(spark, unkept):
    found = navigate.computed_paths(unkept.elements)
    assert joins(found) == ["SortMergeJoin"]
    assert sorted(rows(found, "doc_id", "path")) == sorted(rows(unkept.elements, "doc_id", "path"))
    broken = scan(spark.createDataFrame([(1, b"<a><b><c/><b><c/></x></b>"), (2, b"<a/><a><b/></a>"), (None, b"<a><b/></a>")], "doc_id long, content binary")).elements
    kept = broken.where("doc_id is not null")
    assert sorted(rows(navigate.computed_paths(kept), "doc_id", "elem_id", "path")) == sorted(rows(kept, "doc_id", "elem_id", "path"))
    assert navigate.computed_paths(broken).count() == broken.count()


def test_leaves_need_no_join(unkept):
    found = navigate.leaves(unkept.elements)
    assert joins(found) == [] and found.columns == unkept.elements.columns
    assert sorted(rows(found.where("doc_id = 2"), "elem_id", "name")) == [(1, "b"), (3, "b")]
    inner = rows(navigate.with_children(unkept.elements), "doc_id", "elem_id")
    assert sorted(inner + rows(found, "doc_id", "elem_id")) == sorted(rows(unkept.elements, "doc_id", "elem_id"))


def test_search(spark):
    df = spark.createDataFrame([(1, b"<a>needle</a>\n<b>x needle y</b>\nneedle\n"), (2, b"aaaa NeEdLe"), (3, None)], "doc_id long, content binary")
    assert rows(search.search(df, "needle"), "doc_id", "line", "col") == [(1, 1, 4), (1, 2, 6), (1, 3, 1)]
    assert rows(search.search(df, "needle", ignore_case=True).where("doc_id = 2"), "offset") == [(5,)]
    assert rows(search.search(df, "aa"), "offset", "total") == [(0, 3), (1, 3), (2, 3)]
    assert rows(search.search(df, "aa", max_hits=2), "offset", "total") == [(0, 3), (1, 3)]
    assert search.search(df, "").count() == 0
    for needle, fold in (("needle", False), ("NEEDLE", True), ("aa", False), ("", False)):
        want = {d: search.search(df, needle, fold, None).where(f"doc_id = {d}").count() for d in (1, 2, 3)}
        assert {r.doc_id: r.n for r in search.count_hits(df, needle, fold).collect()} == want
    hits = search.search(df, "needle")
    assert rows(search.next_hit(hits, 1), "line") == [(2,)] and rows(search.next_hit(hits, 3), "line") == [(1,)]
    assert search.report(hits).first().report == "1:1:4: offset 3"
    assert hits.first().preview == "<a>needle</a> <b>x needle y</b> needle "


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab\nA", max_size=60), st.text(alphabet="abA", min_size=1, max_size=4), st.integers(1, 7), st.booleans())
def test_finder_in_pieces(content, needle, size, fold):
    raw = content.encode()
    whole, cut = search.Finder(needle.encode(), fold), search.Finder(needle.encode(), fold)
    whole.feed(raw)
    for i in range(0, len(raw), size):
        cut.feed(raw[i : i + size])
    want = [i for i in range(len(raw)) if (raw[i : i + len(needle)].lower() == needle.lower().encode() if fold else raw.startswith(needle.encode(), i))]
    assert whole.hits == cut.hits and [h[0] for h in whole.hits] == want
    assert all((line, col) == (raw.count(b"\n", 0, o) + 1, o - raw.rfind(b"\n", 0, o)) for o, line, col in whole.hits)


# schema and tables


def test_schema(book):
    s = schema.Schema(book)
    e = {r["name"]: r for r in s.elements().collect()}
    assert e["reading"]["count"] == 4 and e["wind"].text_type == "xs:positiveInteger" and e["level"].text_type == "xs:decimal" and e["reading"].parents == ["watch"]
    kids = {(r.parent, r.child): (r["min"], r["max"], r.ord) for r in s.children().collect()}
    assert kids["watch", "reading"] == (1, 3, 1) and kids["reading", "remark"][:2] == (0, 1) and kids["logbook", "watch"] == (2, 2, 2)
    attrs = {(r.element, r.attr): r for r in s.attribute_types().collect()}
    assert attrs["watch", "day"].type == "xs:date" and attrs["watch", "day"].required and attrs["watch", "open"].type == "xs:boolean" and attrs["reading", "at"].type == "xs:dateTime"
    assert rows(s.roots(), "name") == [("logbook",)]
    assert {r.child: r.occurs for r in s.occurrences().where("parent = 'watch'").collect()} == {"reading": "1..3", "verdict": "0..1"}
    text_ = s.xsd(NAMESPACE)
    assert not scan_bytes(text_.encode()).errors
    assert '<xs:element name="remark" type="xs:string" minOccurs="0"/>' in text_ and '<xs:element ref="reading" maxOccurs="3"/>' in text_ and text_.index('name="logbook"') < text_.index('name="watch"')
    sampled = schema.Schema(book, sampled=True)
    assert {tuple(r) for r in sampled.attribute_types().collect()} == {tuple(r) for r in s.attribute_types().collect()}


def test_attribute_types_need_no_join(spark):
    held = [(1, b'<a y="2" x="1"><b/><b x="1.5" x="no"/></a>'), (2, b'<a x="-3"><b x="2"/></a>')]
    s = scan(spark.createDataFrame(held, "doc_id long, content binary"))
    found = schema.Schema(s).attribute_types()
    assert joins(found) == []
    want = {("a", "y"): (1, "xs:positiveInteger", False, 1), ("a", "x"): (2, "xs:integer", True, 2), ("b", "x"): (2, "xs:decimal", False, 1)}
    assert {(r.element, r.attr): (r["count"], r.type, r.required, r.ord) for r in found.collect()} == want
    assert {tuple(r) for r in schema.Schema(s, sampled=True).attribute_types().collect()} == {tuple(r) for r in found.collect()}


def test_single_occurrence_of_order_documents_joins_no_elements(spark):
    found = queries.q15_single_occurrence(spark, "/root/testdata/sf0.001")
    assert len(joins(found)) == 1  # of orders with their lines
    assert rows(found, "parent", "child", "min", "max") == [("Order", "Lines", 1, 1)]


def test_bodies_of_order_documents_are_never_broadcast(spark):
    assert joins(queries.q15_single_occurrence(spark, "/root/testdata/sf0.001")) == ["SortMergeJoin"]
    assert joins(queries.order_documents(spark, "/root/testdata/sf0.001")) == ["SortMergeJoin"]


def test_child_bounds_need_no_join(spark, unkept):
    found = schema.Schema(unkept).children()
    assert joins(found) == []
    bounds = {(r.parent, r.child): (r.ord, r["min"], r["max"]) for r in found.collect()}
    assert {k: v for k, v in bounds.items() if k[0] in "abc"} == {("a", "b"): (1, 1, 1), ("a", "c"): (2, 1, 1), ("c", "b"): (1, 1, 1)}
    # an element inside its own kind; parents without the child
    nested = scan(spark.createDataFrame([(1, b"<a><a><a/><b/><b/></a></a>"), (2, b"<a/>")], "doc_id long, content binary"))
    found = {(r.parent, r.child): (r.ord, r["min"], r["max"]) for r in schema.Schema(nested).children().collect()}
    assert found == {("a", "a"): (1, 0, 1), ("a", "b"): (2, 0, 2)}


def test_element_inventory_needs_no_join(unkept):
    found = schema.Schema(unkept).elements()
    assert joins(found) == []
    want = {"logbook": [], "a": [], "b": ["a", "c"], "c": ["a"]}
    assert {r.name: r.parents for r in found.collect() if r.name in want} == want
    assert {r.name: r["count"] for r in found.collect() if r.name in want} == {"logbook": 1, "a": 1, "b": 2, "c": 1}


def test_table(book):
    e = book.elements
    readings = table.repeating(e, e.where("path = '/logbook[1]/watch[1]'"))
    assert readings.count() == 3
    wide = table.table(book, readings)
    assert table.columns(table.cells(book, readings)) == ["@at", "level", "wind", "remark", "gust"]
    assert rows(wide.orderBy("row_no"), "level", "remark") == [("2.41", None), ("3.07", "thick fog"), ("1.98", None)]
    assert rows(table.filter_rows(wide, "THICK"), "row_no") == [(2,)]
    assert rows(table.sort_rank(wide, "wind").orderBy("rank"), "wind") == [("4",), ("9",), ("12",)]
    watches = table.cells(book, e.where("name = 'watch'"))
    record = table.records(watches).orderBy("elem_id").first().record
    assert record["reading"] == "at=2025-03-02T12:00:00Z" and record["@day"] == "2025-03-02"


def test_element_rows_of_every_width(spark):
    """Null ids, empty and faulty documents, repeated attributes and children; the same rows persisted or not."""
    contents = [(1, "<a x='1' y='2'><b z='3'/><b>t</b><c><d/></c><e/></a>"), (2, ""), (None, "<a>u</a>"), (3, "<a k='1' k='2'"), (4, None), (4, "<a/>")]
    s = scan(spark.createDataFrame([(i, None if c is None else c.encode()) for i, c in contents], "doc_id long, content binary"))
    first = s.records.where("doc_id = 1 and depth = 0").first()
    assert [tuple(a) for a in first.attrs] == [("x", "1"), ("y", "2")]
    assert [tuple(k) for k in first.kids] == [("b", "z=3"), ("b", "t"), ("c", "(1 children)"), ("e", "")]
    wide = table.table(s, F.col("name") == "a", ["@x", "b", "#text", "none"])
    got = sorted((str(r.doc_id), str(r["@x"]), str(r.b), str(r["#text"]), str(r.none)) for r in wide.collect())
    assert got == [("1", "1", "t", "None", "None"), ("3", "None", "None", "None", "None"), ("4", "None", "None", "None", "None"), ("None", "None", "None", "u", "None")]
    counted = lambda: sorted((str(r.doc_id), r["count"]) for r in s.counts(F.col("name") == "b").collect())
    bare, rows_of = counted(), lambda df: sorted(map(str, df.collect()))
    assert bare == [("1", 2), ("2", 0), ("3", 0), ("4", 0), ("None", 0)]
    views = [rows_of(s.elements), rows_of(s.tagged), rows_of(s.records), rows_of(s.attributes)]
    s.persist()
    assert counted() == bare and views == [rows_of(s.elements), rows_of(s.tagged), rows_of(s.records), rows_of(s.attributes)]
    s.unpersist()
    assert table.table(s, F.col("name") == "absent", ["@x"]).count() == 0


def test_plans_scan_once(spark):
    s = scan(spark.createDataFrame([(1, b"<a><b k='1'/></a>")], "doc_id long, content binary"))
    from tessera.plans import xpath_plan

    for df in (table.table(s, F.col("name") == "b", ["@k"]), xpath_plan.select(s, "//b/@k"), xpath_plan.select(s, "//b"), xpath_plan.select(s, "count(//b)")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan


# text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="<>/a=\"'&; !-[]?CDAT", max_size=30), max_size=4))
def test_tokens_spell_the_line(lines):
    tokenizer = text.LineTokenizer()
    for line in lines:
        found = tokenizer(line)
        assert "".join(t for _, t in found) == line
        assert all(a[0] != b[0] for a, b in zip(found, found[1:])) and {k for k, _ in found} <= set(text.TOKEN_KINDS)


def test_tokens(spark):
    t = text.LineTokenizer()
    assert t("<a b='1'>x &amp; y</a><!-- c") == [("punct", "<"), ("name", "a"), ("text", " "), ("attr", "b"), ("punct", "="), ("val", "'1'"), ("punct", ">"), ("text", "x "), ("ent", "&amp;"), ("text", " y"), ("punct", "</"), ("name", "a"), ("punct", ">"), ("comment", "<!-- c")]
    assert t("d --><?pi?>") == [("comment", "d -->"), ("pi", "<?pi?>")]
    df = spark.createDataFrame([(1, b"<a>\r\nt</a>")], "doc_id long, content binary")
    assert [r.text for r in text.tokens(df).collect()] == ["<", "a", ">", "t", "</", "a", ">"]


def test_pretty(spark):
    assert text.pretty_print("<?xml?><a> <b>t</b><c/><d><e>x</e></d></a>") == "<?xml?>\n<a>\n  <b>t</b>\n  <c/>\n  <d>\n    <e>x</e>\n  </d>\n</a>\n"
    for source in (LOGBOOK, SCHEMA):
        once = text.pretty_print(source)
        assert text.pretty_print(once) == once and not scan_bytes(once.encode()).errors
    df = spark.createDataFrame([(b"<a><b/></a>",), (None,)], "c binary")
    assert [r.p for r in df.select(text.pretty(F.col("c")).alias("p")).collect()] == ["<a>\n  <b/>\n</a>\n", None]


# edits


def test_edits(spark, tmp_path):
    df = spark.createDataFrame([(1, b"a\r\nb\nc"), (2, b"untouched\r\n")], "doc_id long, content binary")
    e = spark.createDataFrame([(1, 2, 1, "set", "B"), (1, 2, 2, "set", "BB"), (1, 1, 3, "insert", "x"), (1, 1, 4, "insert", "y"), (1, 3, 5, "delete", None), (1, 1, 6, "set", "A")], "doc_id long, line long, seq long, op string, text string")
    got = lambda cursor=None: {r.doc_id: r.content for r in edits.apply(df, e, cursor).collect()}
    assert got() == {1: b"A\r\ny\nx\nBB", 2: b"untouched\r\n"}
    assert got(1)[1] == b"a\r\nB\nc" and got(0)[1] == b"a\r\nb\nc" and edits.count(e, 4).first().edits == 4
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert {r.doc_id: r.content for r in edits.commit(df, e).collect()} == got()
    t = spark.createDataFrame([("hello",)], "t string")
    assert t.select(edits.insert(F.col("t"), 1, "XY"), edits.delete(F.col("t"), 1, 3), edits.replace(F.col("t"), 0, 1, "J")).first() == ("hXYello", "ho", "Jello")


REPAIRED = {
    "<p><q></r></p>": "<p><q></q></p>", "<p><q><r></p>": "<p><q><r></r></q></p>", "<p/></q>": "<p/>", "<p><q>": "<p><q></q></p>", "<p k='1' j='2'  k='3'/>": "<p k='1' j='2'/>", "<p k = 7></p>": '<p k ="7"></p>',
    "<p>salt & oil</p>": "<p>salt &amp; oil</p>", "<p>&#x;</p>": "<p>&amp;#x;</p>", "<p><!-- u -- v --></p>": "<p><!-- u - - v --></p>", "<p>u]]>v</p>": "<p>u]]&gt;v</p>", "<p>ø < 3 & < 4</p>": "<p>ø &lt; 3 &amp; &lt; 4</p>",
}


@pytest.mark.parametrize("source", REPAIRED)
def test_repairs(source):
    content, made, left = edits.repair(source.encode())
    assert content.decode() == REPAIRED[source] and made and not left


def test_smart_fix(spark):
    df = spark.createDataFrame([(1, BROKEN.encode()), (2, b"<a/><b/>")], "doc_id long, content binary")
    got = {r.doc_id: r for r in edits.smart_fix(df).collect()}
    assert not scan_bytes(got[1].content).errors and got[1].repairs == 11
    assert got[2].repairs == 0 and got[2].left == ["Wrap both elements in a single root element"]


# transformation


def test_xslt(spark):
    html = xslt.transform(LOGBOOK.encode())
    assert html.startswith("<html><body><ul><li><b>logbook</b>") and html.count("<b>reading</b>") == 4 and "level &lt; 3 &amp; falling" in html
    sheet = f"""<xsl:stylesheet version="1.0" xmlns:xsl="{xslt.XSL}"><xsl:param name="p" select="'!'"/>
      <xsl:template match="/"><out n="{{count(//i)}}"><xsl:apply-templates select="//i"><xsl:sort select="@k" data-type="number" order="descending"/><xsl:with-param name="q" select="7"/></xsl:apply-templates><xsl:call-template name="end"/></out></xsl:template>
      <xsl:template match="i[@k > 1]" priority="2"><xsl:param name="q"/><big q="{{$q}}"><xsl:value-of select="position()"/><xsl:value-of select="$p"/></big></xsl:template>
      <xsl:template match="i"><xsl:choose><xsl:when test="@k = 1"><one/></xsl:when><xsl:otherwise><xsl:copy-of select="."/></xsl:otherwise></xsl:choose></xsl:template>
      <xsl:template name="end"><xsl:variable name="v"><z/></xsl:variable><xsl:element name="e{{1+1}}"><xsl:attribute name="a">x</xsl:attribute><xsl:copy-of select="$v"/></xsl:element><xsl:comment>c</xsl:comment></xsl:template>
    </xsl:stylesheet>"""
    assert xslt.transform(b"<r><i k='1'/><i k='10'/><i k='2'/><i k='0'><t>a&amp;b</t></i></r>", sheet) == '<out n="4"><big q="7">1!</big><big q="7">2!</big><one/><i k="0"><t>a&amp;b</t></i><e2 a="x"><z/></e2><!--c--></out>'
    df = spark.createDataFrame([(1, LOGBOOK.encode()), (2, BROKEN.encode())], "doc_id long, content binary")
    got = {r.doc_id: r for r in xslt.transform_documents(df).collect()}
    assert got[1].error is None and got[1].result == html and "not well-formed" in got[2].error
    with pytest.raises(xslt.XsltError):
        xslt.transform(b"<a/>", "<a/>")


# streams


def test_streams(spark, tmp_path):
    contents = {1: LOGBOOK.encode(), 2: BROKEN.encode(), 3: b""}
    df = spark.createDataFrame(list(contents.items()), "doc_id long, content binary")
    parts = chunks.chunk_documents(df, 97)
    source = str(tmp_path / "chunks")
    parts.where("chunk_no % 2 = 1").coalesce(1).write.parquet(source)
    parts.where("chunk_no % 2 = 0").coalesce(1).write.mode("append").parquet(source)
    for name, stream, mode in (("scanned", lambda s: chunks.scan_stream(s), "update"), ("found", lambda s: chunks.search_stream(s, "level"), "append")):
        incoming = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream(incoming).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    done = {r.doc_id: r for r in spark.table("scanned").where("finished").collect()}
    for d, content in contents.items():
        ix = scan_bytes(content)
        assert (done[d].elements, done[d].errors, done[d].lines, done[d].bytes) == (ix.total_elements, ix.error_count, ix.line_count, len(content))
    got = sorted((r.doc_id, r.offset, r.line, r.col) for r in spark.table("found").collect())
    assert got == sorted((r.doc_id, r.offset, r.line, r.col) for r in search.search(df, "level").collect())


def test_scanner_survives_pickling():
    import pickle

    s = Scanner()
    for i in range(0, len(LOGBOOK.encode()), 50):
        s.feed(LOGBOOK.encode()[i : i + 50])
        s = pickle.loads(pickle.dumps(s))
    assert s.finish().start == scan_bytes(LOGBOOK.encode()).start
