from tessera import cli
from tessera.functions import sql
from tessera.operators.scanner import scan_bytes
from tessera.sources.samples import BROKEN, LOGBOOK


def test_table_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(1, LOGBOOK.encode()), (2, b"<a>x\nx</a>"), (3, None)], "doc_id long, content binary").createOrReplaceTempView("docs")
    counted = spark.sql("SELECT d.doc_id, count(*) n FROM docs d, LATERAL xml_elements(d.content) e GROUP BY d.doc_id").collect()
    assert {r.doc_id: r.n for r in counted} == {1: 19, 2: 1}
    paths = spark.sql("SELECT e.path, e.text FROM docs d, LATERAL xml_elements(d.content) e WHERE e.name = 'remark'").collect()
    assert paths == [("/logbook[1]/watch[1]/reading[2]/remark[1]", "thick fog")]
    hits = spark.sql("SELECT h.line, h.col FROM docs d, LATERAL xml_search(d.content, 'X', true) h WHERE d.doc_id = 2").collect()
    assert hits == [(1, 4), (2, 1)]


def test_command_line(spark, tmp_path, capsys):
    good, bad, out = tmp_path / "good.xml", tmp_path / "bad.xml", str(tmp_path / "out")
    good.write_text(LOGBOOK)
    bad.write_text(BROKEN)
    run = lambda *args: cli.main([str(a) for a in args], spark)
    assert run("wf", good) == 0 and "19 elements" in capsys.readouterr().out
    assert run("wf", bad) == 1 and "bad.xml:4:17: error:" in capsys.readouterr().out
    assert run("index", good, bad, "--out", out) == 0 and run("info", out) == 0
    assert "logbook, keeper, watch" in capsys.readouterr().out
    assert run("search", "wind", good) == 0 and run("search", "WIND", good) == 1 and run("search", "-i", "WIND", good) == 0
    assert "offset" in capsys.readouterr().out
    assert run("gen", "--size", "100KiB", "--documents", "2", "--out", out) == 0
    made = spark.read.parquet(out).collect()
    assert len(made) == 2 and all(not scan_bytes(r.content).errors for r in made)
    assert run("wf", tmp_path / "missing.xml") == 2 and run("nothing") == 2 and run("gen", "--size", "banana", "--out", out) == 2


def test_frame_times(spark):
    df = spark.createDataFrame([(i, float(i % 100)) for i in range(300)], "seq long, ms double")
    row = cli.frame_times(df).first()
    last = sorted(float(i % 100) for i in range(60, 300))
    assert (row.p50, row.p99, row["max"]) == (last[120], last[237], last[-1])
