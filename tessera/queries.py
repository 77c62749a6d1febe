"""Registered queries of the XML engine, each beside the SQL that must give the same rows.

The tables hold no XML, so relational rows are rendered as documents, queried with
the engine, and compared with SQL over the original rows. An order document is

    <Order key="K" status="S"><Lines><Line n="1" part="P"><Qty>Q</Qty><Price>X</Price></Line>...</Lines></Order>
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import edits, navigate, schema, search, table, text, xslt
from tessera.operators.scan import Scan, scan, totals, well_formed
from tessera.operators.scanner import ScanConfig
from tessera.plans import xpath_plan
from tessera.sources import documents as docs
from tessera.sources import index_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LINES_SQL = """
    l AS (SELECT o_orderkey AS k, o_orderstatus AS s, l_orderkey IS NOT NULL AS has, l_partkey AS part,
                 CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS q, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS p,
                 row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord
          FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
    d AS (SELECT k, any_value(s) AS s, CAST(count(*) FILTER (WHERE has) AS BIGINT) AS n FROM l GROUP BY k)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("WITH_LINES", f"WITH {LINES_SQL}")
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_documents(spark: SparkSession, sf_dir: str, prefix: str = "", open_tag: Column | None = None) -> DataFrame:
    """Orders rendered as XML documents (doc_id, content)."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    items = read(spark, sf_dir, "lineitem")
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    p = prefix
    line = F.concat(F.lit(f'<{p}Line n="'), F.col("ord").cast("string"), F.lit('" part="'), F.col("l_partkey").cast("string"), F.lit(f'"><{p}Qty>'), money("l_quantity"), F.lit(f"</{p}Qty><{p}Price>"), money("l_extendedprice"), F.lit(f"</{p}Price></{p}Line>"))
    body = items.withColumn("ord", ord_).select("l_orderkey", "ord", line.alias("xml")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "xml"))), lambda x: x["xml"]), "").alias("body"))
    spaces = f' xmlns:{p[:-1]}="urn:orders"' if p else ""
    start = F.concat(F.lit(f'<{p}Order{spaces} key="'), F.col("o_orderkey").cast("string"), F.lit('" status="'), F.col("o_orderstatus"), F.lit('">')) if open_tag is None else open_tag
    content = F.concat(start, F.lit(f"<{p}Lines>"), F.coalesce("body", F.lit("")), F.lit(f"</{p}Lines></{p}Order>"))
    # merged: Spark estimates an order's body at 20 bytes, so it would have the driver gather all of them for a broadcast
    rendered = orders.join(body.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("doc_id"), content.cast("binary").alias("content"))
    # adaptive execution sizes partitions by bytes; a scan needs them by cores
    cores = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rendered.repartition(cores, "doc_id")


def order_scan(spark: SparkSession, sf_dir: str) -> Scan:
    return scan(order_documents(spark, sf_dir))


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.from_strings(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "content")


# XPath ----------------------------------------------------------------------


@query("WITH_LINES SELECT k AS doc_id, n AS count FROM d")
def q01_count_lines(spark, sf_dir):
    return xpath_plan.select(order_scan(spark, sf_dir), "count(//Line)")


@query("WITH_LINES SELECT k AS doc_id, 2 + 3 * n AS elements, 2 + 2 * n AS attributes, CASE WHEN n > 0 THEN CAST(4 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS max_depth, CAST(1 AS BIGINT) AS lines, CAST(0 AS BIGINT) AS errors FROM d")
def q02_document_totals(spark, sf_dir):
    return totals(order_documents(spark, sf_dir)).select("doc_id", "elements", "attributes", "max_depth", "lines", "errors")


@query("WITH_LINES SELECT k AS doc_id, CAST(part AS VARCHAR) AS value FROM l WHERE has")
def q03_attribute_values(spark, sf_dir):
    return xpath_plan.select(order_scan(spark, sf_dir), "//Line/@part").select("doc_id", "value")


@query("WITH_LINES SELECT k AS doc_id, q AS text FROM l WHERE has AND ord = 1")
def q04_positional_step(spark, sf_dir):
    return xpath_plan.select(order_scan(spark, sf_dir), "//Line[1]/Qty", "strict").select("doc_id", "text")


@query("WITH_LINES SELECT k AS doc_id, 'Lines' AS name, CAST(1 AS BIGINT) AS child_no FROM d UNION ALL SELECT k, 'Line', ord FROM l WHERE has")
def q05_children(spark, sf_dir):
    e = order_scan(spark, sf_dir).elements
    return navigate.children(e, e.where("name in ('Order', 'Lines')")).select("doc_id", "name", F.col("child_no").cast("long").alias("child_no"))


@query("WITH_LINES SELECT k AS doc_id, 'Order' AS ancestor_name, 1 + 3 * n AS n FROM d UNION ALL SELECT k, 'Lines', 3 * n FROM d WHERE n > 0 UNION ALL SELECT k, 'Line', 2 * n FROM d WHERE n > 0")
def q06_descendants(spark, sf_dir):
    e = order_scan(spark, sf_dir).elements
    return navigate.descendants(e, e.where("name in ('Order', 'Lines', 'Line')")).groupBy("doc_id", "ancestor_name").agg(F.count("*").alias("n"))


@query("WITH_LINES SELECT k AS doc_id, '/Order[1]/Lines[1]/Line[' || ord || ']' AS path, '/Order/Lines/Line' AS path_names FROM l WHERE has")
def q07_paths(spark, sf_dir):
    return order_scan(spark, sf_dir).elements.where("name = 'Line'").select("doc_id", "path", "path_names")


@query("WITH_LINES SELECT k AS doc_id, CASE WHEN n > 0 THEN 2 * n ELSE 1 END AS n FROM d")
def q08_leaves(spark, sf_dir):
    return navigate.leaves(order_scan(spark, sf_dir).elements).groupBy("doc_id").agg(F.count("*").alias("n"))


_TEXT_LINES = """
    t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, line, raw, CAST(coalesce(sum(octet_length(encode(raw)) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM t)"""


@query(f"WITH {_TEXT_LINES} SELECT doc_id, line, start, regexp_replace(raw, '\\r$', '') AS text FROM s")
def q09_lines(spark, sf_dir):
    return docs.lines(text_documents(spark, sf_dir))


@query(f"WITH {_TEXT_LINES} SELECT doc_id, CAST((line - 1) // 32 AS INTEGER) AS block, start FROM s WHERE (line - 1) % 32 = 0")
def q10_checkpoints(spark, sf_dir):
    return scan(text_documents(spark, sf_dir), ScanConfig(contents=False, max_errors=0)).checkpoints


# search -----------------------------------------------------------------------


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'tion', ''))) / 4 AS BIGINT) AS n FROM documents")
def q11_hit_counts(spark, sf_dir):
    return search.count_hits(text_documents(spark, sf_dir), "tion")


@query("WITH f AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents), c AS (SELECT doc_id, CAST((length(t) - length(replace(t, 'the ', ''))) / 4 AS BIGINT) AS total FROM f) SELECT * FROM c WHERE total > 0")
def q12_search_ignoring_case(spark, sf_dir):
    return search.search(text_documents(spark, sf_dir), "THE ", ignore_case=True, max_hits=None).groupBy("doc_id").agg(F.count("*").alias("total"))


@query(f"WITH {_TEXT_LINES}, c AS (SELECT doc_id, line, CAST((length(raw) - length(replace(raw, 'er ', ''))) / 3 AS BIGINT) AS n FROM s) SELECT * FROM c WHERE n > 0")
def q13_hits_by_line(spark, sf_dir):
    return search.search(text_documents(spark, sf_dir), "er ", max_hits=None).groupBy("doc_id", "line").agg(F.count("*").alias("n"))


# schema inference and tables --------------------------------------------------


@query("WITH_LINES SELECT 'Order' AS name, count(*) AS count, '' AS parent FROM d UNION ALL SELECT 'Lines', count(*), 'Order' FROM d UNION ALL SELECT 'Line', CAST(sum(n) AS BIGINT), 'Lines' FROM d UNION ALL SELECT 'Qty', CAST(sum(n) AS BIGINT), 'Line' FROM d UNION ALL SELECT 'Price', CAST(sum(n) AS BIGINT), 'Line' FROM d")
def q14_element_inventory(spark, sf_dir):
    return schema.Schema(order_scan(spark, sf_dir)).elements().select("name", "count", F.array_join("parents", ",").alias("parent"))


@query("WITH_LINES SELECT 'Order' AS parent, 'Lines' AS child, CAST(1 AS BIGINT) AS min, CAST(1 AS BIGINT) AS max FROM d LIMIT 1")
def q15_single_occurrence(spark, sf_dir):
    return schema.Schema(order_scan(spark, sf_dir)).children().where("parent = 'Order'").select("parent", "child", "min", "max")


@query("WITH_LINES SELECT 'Line' AS child, min(n) AS min, max(n) AS max FROM d")
def q15_occurrence_bounds(spark, sf_dir):
    return schema.Schema(order_scan(spark, sf_dir)).children().where("parent = 'Lines'").select("child", "min", "max")


@query("""WITH_LINES, v AS (SELECT 'Order' AS element, 'key' AS attr, CAST(k AS VARCHAR) AS x FROM d UNION ALL SELECT 'Order', 'status', s FROM d UNION ALL SELECT 'Line', 'n', CAST(ord AS VARCHAR) FROM l WHERE has UNION ALL SELECT 'Line', 'part', CAST(part AS VARCHAR) FROM l WHERE has),
    g AS (SELECT element, attr, CASE WHEN regexp_full_match(x, '[1-9][0-9]*') THEN 1 WHEN regexp_full_match(x, '-?[0-9]+') THEN 2 WHEN regexp_full_match(x, '-?[0-9]*\\.[0-9]+') THEN 3 ELSE 9 END AS r FROM v)
    SELECT element, attr, count(*) AS count, CASE max(r) WHEN 1 THEN 'xs:positiveInteger' WHEN 2 THEN 'xs:integer' WHEN 3 THEN 'xs:decimal' ELSE 'xs:string' END AS type, true AS required FROM g GROUP BY element, attr""")
def q16_attribute_types(spark, sf_dir):
    return schema.Schema(order_scan(spark, sf_dir)).attribute_types().select("element", "attr", "count", "type", "required")


@query('WITH_LINES SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY ord) AS row_no, CAST(ord AS VARCHAR) AS "@n", CAST(part AS VARCHAR) AS "@part", q AS "Qty", p AS "Price" FROM l WHERE has')
def q17_table_mode(spark, sf_dir):
    s = order_scan(spark, sf_dir)
    wide = table.table(s, F.col("name") == "Line", ["@n", "@part", "Qty", "Price"])
    return wide.select("doc_id", F.col("row_no").cast("long").alias("row_no"), "@n", "@part", "Qty", "Price")


@query("""WITH_LINES, f AS (SELECT * FROM l WHERE has AND (contains(CAST(ord AS VARCHAR), '5') OR contains(CAST(part AS VARCHAR), '5') OR contains(q, '5') OR contains(p, '5')))
    SELECT k AS doc_id, p AS "Price", row_number() OVER (PARTITION BY k ORDER BY CAST(p AS DOUBLE), p, ord) AS rank FROM f""")
def q18_filter_and_sort(spark, sf_dir):
    s = order_scan(spark, sf_dir)
    wide = table.table(s, F.col("name") == "Line", ["@n", "@part", "Qty", "Price"])
    return table.sort_rank(table.filter_rows(wide, "5"), "Price").select("doc_id", "Price", F.col("rank").cast("long").alias("rank"))


# scalars, edits, text -----------------------------------------------------------


@query("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, true AS same FROM documents")
def q19_escape_round_trip(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", "text", scalars.escape_column(F.col("text")).alias("escaped"))
    return t.select("doc_id", "escaped", (scalars.decode_column(F.col("escaped")) == F.col("text")).alias("same"))


_VALUES = "SELECT c_name AS v FROM customer UNION ALL SELECT CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) FROM customer UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT url FROM pages"


@query(f"""WITH v AS ({_VALUES}) SELECT v, CASE WHEN regexp_full_match(v, '[1-9][0-9]*') THEN 'xs:positiveInteger' WHEN regexp_full_match(v, '-?[0-9]+') THEN 'xs:integer' WHEN regexp_full_match(v, '-?[0-9]*\\.[0-9]+') THEN 'xs:decimal'
    WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'xs:date' WHEN regexp_full_match(v, 'https?://.*') THEN 'xs:anyURI' ELSE 'xs:string' END AS type, count(*) AS n FROM v GROUP BY v""")
def q20_lexical_types(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    v = customer.select(F.col("c_name").alias("v")).union(customer.select(F.col("c_nationkey").cast("string"))).union(customer.select(F.col("c_acctbal").cast("decimal(18,2)").cast("string")))
    v = v.union(read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd"))).union(read(spark, sf_dir, "pages").select("url"))
    return v.groupBy("v").agg(F.count("*").alias("n")).select("v", scalars.guess_type_column(F.col("v")).alias("type"), "n")


@query(f"WITH {_TEXT_LINES}, c AS (SELECT doc_id, line, CASE WHEN line % 3 = 0 THEN 'edited ' || line ELSE regexp_replace(raw, '\\r$', '') END AS text FROM s WHERE line % 7 != 0) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS line, text FROM c")
def q21_line_edits(spark, sf_dir):
    rows = docs.lines(text_documents(spark, sf_dir)).select("doc_id", "line", "text")
    changed = rows.where("line % 3 = 0").select("doc_id", "line", F.lit(1).alias("seq"), F.lit("set").alias("op"), F.concat(F.lit("edited "), F.col("line").cast("string")).alias("text"))
    gone = rows.where("line % 7 = 0").select("doc_id", "line", F.lit(2).alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("text"))
    return edits.overlay(rows, changed.unionByName(gone)).drop("edited")


@query("SELECT page_id AS doc_id, false AS ok FROM pages UNION ALL SELECT o_orderkey, true FROM orders")
def q22_well_formed(spark, sf_dir):
    pages = docs.from_strings(read(spark, sf_dir, "pages"), "page_id", "html").select("doc_id", "content")
    return well_formed(pages.unionByName(order_documents(spark, sf_dir))).select("doc_id", "ok")


@query("SELECT doc_id, CAST(length(text) - length(replace(text, '&', '')) - len(regexp_extract_all(text, '&(#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z_:][A-Za-z0-9_:.-]*);')) AS BIGINT) AS errors FROM documents WHERE NOT contains(text, '<') AND NOT contains(text, ']]>')")
def q23_raw_ampersands(spark, sf_dir):
    t = read(spark, sf_dir, "documents").where(~F.col("text").contains("<") & ~F.col("text").contains("]]>"))
    wrapped = t.select("doc_id", F.concat(F.lit("<d>"), "text", F.lit("</d>")).cast("binary").alias("content"))
    return totals(wrapped).select("doc_id", "errors")


@query("""WITH f AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m, length(CAST(o_orderkey AS VARCHAR)) AS w FROM orders)
    SELECT k AS doc_id, CASE m WHEN 0 THEN 'D11' WHEN 1 THEN 'D14' ELSE 'D07' END AS code, CAST(CASE m WHEN 0 THEN 14 + w WHEN 1 THEN 11 ELSE 12 + w END AS BIGINT) AS "offset", CAST(1 AS BIGINT) AS line,
           CAST(CASE m WHEN 0 THEN 15 + w WHEN 1 THEN 12 ELSE 13 + w END AS BIGINT) AS col, CASE m WHEN 0 THEN 'Remove the duplicate attribute' WHEN 1 THEN 'Enclose the value in double quotes' ELSE 'Replace ''&'' with ''&amp;''' END AS fix FROM f WHERE m < 3""")
def q24_injected_faults(spark, sf_dir):
    k, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    content = (
        F.when(kind == 0, F.concat(F.lit('<Order key="'), k, F.lit('" key="x"/>')))
        .when(kind == 1, F.lit("<Order key=?></Order>"))
        .when(kind == 2, F.concat(F.lit('<Order key="'), k, F.lit('& "/>')))
        .otherwise(F.concat(F.lit('<Order key="'), k, F.lit('"/>')))
    )
    found = scan(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), content.cast("binary").alias("content"))).diagnostics
    return found.where("seq = 0").select("doc_id", "code", "offset", "line", "col", "fix")


@query("WITH_LINES, c AS (SELECT k, unnest(['name','attr','val','punct','text']) AS type, unnest([4 + 6 * n, 2 + 2 * n, 2 + 2 * n, 0, 0]) AS n, n AS m FROM d) SELECT k AS doc_id, type, n FROM c WHERE type IN ('name', 'attr', 'val')")
def q25_tokens(spark, sf_dir):
    return text.tokens(order_documents(spark, sf_dir)).where("type in ('name', 'attr', 'val')").groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query("WITH_LINES SELECT k AS doc_id, 4 + 4 * n AS lines FROM d")
def q26_pretty_print(spark, sf_dir):
    shown = order_documents(spark, sf_dir).select("doc_id", text.pretty(F.col("content")).alias("t"))
    return shown.select("doc_id", (F.size(F.split("t", "\n", -1)) - 1).cast("long").alias("lines"))


@query("WITH_LINES SELECT k AS doc_id, 'smart' AS mode, n AS count FROM d UNION ALL SELECT k, 'strict', CAST(0 AS BIGINT) FROM d")
def q27_namespace_modes(spark, sf_dir):
    s = scan(order_documents(spark, sf_dir, prefix="o:"))
    one = lambda mode: xpath_plan.select(s, "count(//Line)", mode).select("doc_id", F.lit(mode).alias("mode"), "count")
    return one("smart").unionByName(one("strict"))


@query("WITH_LINES SELECT k AS doc_id, CAST(count(*) FILTER (WHERE has AND CAST(q AS DOUBLE) > 25 AND ord < 3) AS BIGINT) AS count FROM l GROUP BY k")
def q28_xpath_predicates(spark, sf_dir):
    return xpath_plan.evaluate(order_documents(spark, sf_dir), "//Line[Qty > 25 and @n < 3]").select("doc_id", "count")


@query("SELECT doc_id, text FROM documents")
def q29_line_round_trip(spark, sf_dir):
    back = docs.from_lines(docs.lines(text_documents(spark, sf_dir), keep_returns=True))
    return back.select("doc_id", F.col("content").cast("string").alias("text"))


@query("WITH_LINES SELECT k AS doc_id, 2 + 3 * n AS elements, least(2 + 3 * n, 5) AS indexed FROM d")
def q30_element_budget(spark, sf_dir):
    return scan(order_documents(spark, sf_dir), ScanConfig(max_indexed=5)).stats.select("doc_id", "elements", "indexed")


@query("WITH_LINES SELECT k AS doc_id, '<n k=\"' || k || '\">' || n || '</n>' AS result FROM d")
def q31_xslt(spark, sf_dir):
    sheet = f'<xsl:stylesheet version="1.0" xmlns:xsl="{xslt.XSL}"><xsl:template match="/Order"><n k="{{@key}}"><xsl:value-of select="count(Lines/Line)"/></n></xsl:template></xsl:stylesheet>'
    return xslt.transform_documents(order_documents(spark, sf_dir), sheet).select("doc_id", "result")


@query("WITH_LINES SELECT k AS doc_id, 2 + 3 * n AS elements, 2 + 2 * n AS attributes, false AS partial, CASE WHEN n > 0 THEN 'Order,Lines,Line,Qty,Price' ELSE 'Order,Lines' END AS names FROM d")
def q32_index_files(spark, sf_dir):
    files = index_file.index_files(order_documents(spark, sf_dir))
    return index_file.inspect(files).select("doc_id", "elements", "attributes", "partial", F.array_join("names", ",").alias("names"))


@query("WITH_LINES SELECT k AS doc_id, CAST(1 AS BIGINT) AS repairs, CAST(0 AS BIGINT) AS errors FROM d")
def q33_smart_fix(spark, sf_dir):
    unquoted = F.concat(F.lit("<Order key="), F.col("o_orderkey").cast("string"), F.lit(">"))
    spoilt = order_documents(spark, sf_dir, open_tag=unquoted)
    fixed = edits.smart_fix(spoilt)
    return fixed.select("doc_id", "repairs").join(totals(fixed).select("doc_id", "errors"), "doc_id")


@query("WITH_LINES SELECT k AS doc_id, '/Order[1]' AS path, CAST(1 AS BIGINT) AS child_count, 'key=' || k || ',status=' || s AS attrs FROM d UNION ALL SELECT k, '/Order[1]/Lines[1]', n, '' FROM d")
def q34_node_info(spark, sf_dir):
    s = order_scan(spark, sf_dir)
    info = navigate.node_info(s.elements, s.attributes, s.elements.where("depth < 2"))
    return info.select("doc_id", "path", "child_count", F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ",").alias("attrs"))


@query("WITH_LINES, p AS (SELECT k, '/Order[1]' AS path FROM d UNION ALL SELECT k, '/Order[1]/Lines[1]' FROM d UNION ALL SELECT k, '/Order[1]/Lines[1]/Line[' || ord || ']' FROM l WHERE has UNION ALL SELECT k, '/Order[1]/Lines[1]/Line[' || ord || ']/Qty[1]' FROM l WHERE has UNION ALL SELECT k, '/Order[1]/Lines[1]/Line[' || ord || ']/Price[1]' FROM l WHERE has) SELECT k AS doc_id, path FROM p")
def q35_paths_by_joins(spark, sf_dir):
    return navigate.computed_paths(order_scan(spark, sf_dir).elements).select("doc_id", "path")


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.2f KiB', n_chars / 1024.0) ELSE printf('%.2f MiB', n_chars / 1048576.0) END AS size FROM documents")
def q36_sizes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", scalars.human_column(F.col("n_chars")).alias("size"))


@query(f"WITH {_TEXT_LINES}, h AS (SELECT doc_id, line, start, octet_length(encode(left(raw, strpos(raw, 'tion') - 1))) AS at FROM s WHERE contains(raw, 'tion')), f AS (SELECT doc_id, min(line) AS line FROM h GROUP BY doc_id) SELECT h.doc_id, h.start + h.at AS \"offset\", h.line, CAST(h.at + 1 AS BIGINT) AS col FROM h JOIN f ON h.doc_id = f.doc_id AND h.line = f.line")
def q37_first_hit_as_of(spark, sf_dir):
    d = text_documents(spark, sf_dir)
    first = search.search(d, "tion", max_hits=1).select("doc_id", "offset")
    return navigate.line_of_offset(first, docs.lines(d).select("doc_id", "line", "start"))


@query("WITH_LINES SELECT k AS doc_id, '/Order[1]' AS path FROM d UNION ALL SELECT k, '/Order[1]/Lines[1]' FROM d")
def q38_flattened_tree(spark, sf_dir):
    e = order_scan(spark, sf_dir).elements
    return navigate.flatten(e, e.where("depth = 0")).select("doc_id", "path")


@query("WITH_LINES SELECT k AS doc_id, n AS count FROM d")
def q39_join_plan(spark, sf_dir):
    s = order_scan(spark, sf_dir)
    found = xpath_plan._stepwise(s.elements, xpath_plan.parse_subset("/Order/Lines//Line"), "smart").groupBy("doc_id").agg(F.count("*").alias("n"))
    return s.doc_ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("count"))


@query("SELECT CAST(i AS BIGINT) AS doc_id, CAST(501 AS BIGINT) AS elements, CAST(201 AS BIGINT) AS attributes, CAST(0 AS BIGINT) AS errors FROM range(40) r(i)")
def q40_generated_corpus(spark, sf_dir):
    return totals(docs.generate(spark, 40, 50)).select("doc_id", "elements", "attributes", "errors")


@query("WITH_LINES SELECT count(*) AS documents, CAST(sum(2 + 3 * n) AS BIGINT) AS elements FROM d")
def q41_xsd_source_counts(spark, sf_dir):
    return order_scan(spark, sf_dir).stats.agg(F.count("*").alias("documents"), F.sum("elements").alias("elements"))


# one planted fault a document -------------------------------------------------------

#: One document for each diagnostic: K stands for the order's key, ^ for the byte the fault is reported at. Beside it the
#: codes of all its faults, the planted one first in the list of its own code, and the repair suggested for that one.
FAULTS: dict[str, tuple[str, str, str | None]] = {
    "D01": ("<o>K</o>^<p/>", "D01", "Wrap both elements in a single root element"),
    "D02": ("<o>K ^&#q1;</o>", "D02", "Escape the ampersand as &amp;"),
    "D03": ("<o>K ^]]> v</o>", "D03", "Escape as ]]&gt;"),
    "D04": ("^K<o/>", "D04", "Remove the stray text or move it inside the root element"),
    "D05": ("<o/>^K", "D05", "Remove the stray text or move it inside the root element"),
    "D06": ("<o>K ^&abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz; v</o>", "D06", "Escape the ampersand as &amp;"),
    "D07": ("<o>K ^& v</o>", "D07", "Replace '&' with '&amp;'"),
    "D08": ("<o>K <^ v</o>", "D08", "Escape the '<' as &lt;"),
    "D09": ("<o>K<p^!></p></o>", "D09", None),
    "D10": ('<o k="K"^!></o>', "D10", "Quote attribute values and separate attributes with whitespace"),
    "D11": ('<o k="K" ^k="8"/>', "D11", "Remove the duplicate attribute"),
    "D12": ("<o aK^>v</o>", "D12", 'Insert =""'),
    "D13": ('<o aK ^j="7"/>', "D13", 'Insert =""'),
    "D14": ("<o k=^v>K</o>", "D14", "Enclose the value in double quotes"),
    "D15": ('<o k="K ^< 8"/>', "D15", "Escape as &lt;"),
    "D16": ('<o k="K"/^ ></o>', "D16", None),
    "D17": ("<o>K</^ o>", "D17,D20,D27", None),
    "D18": ("<o>K</o>^</p>", "D18", "Delete this end tag"),
    "D19": ("<o><p>K^</q></o>", "D19", "Change to </p>"),
    "D20": ("<o>K</o ^x>", "D20", None),
    "D21": ("<o>K<!^x></o>", "D21", None),
    "D22": ("<o>K<!-^x></o>", "D22", None),
    "D23": ("<o>K<!-- u ^-- v --></o>", "D23", "Replace '--' with '- -'"),
    "D24": ("<o>K<![C^x[v]></o>", "D24", None),
    "D25": ("^<!--K-->", "D25", "Add a root element"),
    "D26": ("<o>K<!-- v^", "D26,D27", None),
    "D27": ("<o><p>K^", "D27", "Append </p></o>"),
}
_quoted = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
_FAULTS_SQL = f"""f(no, code, body, codes, fix) AS (VALUES {", ".join(f"({i}, '{c}', {_quoted(t)}, '{all_}', {_quoted(fix)})" for i, (c, (t, all_, fix)) in enumerate(FAULTS.items()))}),
    m AS (SELECT o_orderkey AS k, f.*, replace(body, 'K', CAST(o_orderkey AS VARCHAR)) AS t FROM orders JOIN f ON no = o_orderkey % {len(FAULTS)})"""


def _by_key(key: Column, choices: list[str | None]) -> Column:
    return F.get(F.array(*(F.lit(c).cast("string") for c in choices)), (key % len(choices)).cast("int"))


def faulty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a document with one of the faults, by its key (doc_id, code, content)."""
    key = F.col("o_orderkey")
    body = F.replace(F.replace(_by_key(key, [t for t, _, _ in FAULTS.values()]), F.lit("^"), F.lit("")), F.lit("K"), key.cast("string"))
    return read(spark, sf_dir, "orders").select(key.alias("doc_id"), _by_key(key, list(FAULTS)).alias("code"), body.cast("binary").alias("content"))


@query(f'WITH {_FAULTS_SQL} SELECT k AS doc_id, code, codes, CAST(strpos(t, \'^\') - 1 AS BIGINT) AS "offset", CAST(1 AS BIGINT) AS line, CAST(strpos(t, \'^\') AS BIGINT) AS col, fix FROM m')
def q42_all_diagnostics(spark, sf_dir):
    planted = faulty_documents(spark, sf_dir)
    found = scan(planted).diagnostics.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "code", "offset", "line", "col", "fix"))).alias("all"))
    own = F.get(F.filter("all", lambda d: d["code"] == F.col("code")), F.lit(0))
    joined = found.join(planted.select("doc_id", "code"), "doc_id")
    return joined.select("doc_id", "code", F.array_join(F.col("all")["code"], ",").alias("codes"), *(own[c].alias(c) for c in ("offset", "line", "col", "fix")))


#: What the repair of each fault makes of the document; the codes that are not here have no repair of their own.
REPAIRED = {
    "D02": "<o>K &amp;#q1;</o>", "D03": "<o>K ]]&gt; v</o>", "D06": "<o>K &amp;abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz; v</o>",
    "D07": "<o>K &amp; v</o>", "D08": "<o>K &lt; v</o>", "D11": '<o k="K"/>', "D14": '<o k="v">K</o>', "D18": "<o>K</o>", "D19": "<o><p>K</p></o>",
    "D23": "<o>K<!-- u - - v --></o>", "D27": "<o><p>K</p></o>",
}


@query(f"""WITH {_FAULTS_SQL}, r(code, body) AS (VALUES {", ".join(f"('{c}', {_quoted(t)})" for c, t in REPAIRED.items())})
    SELECT k AS doc_id, m.code, replace(r.body, 'K', CAST(k AS VARCHAR)) AS repaired, CAST(1 AS BIGINT) AS repairs FROM m JOIN r ON r.code = m.code""")
def q43_all_repairs(spark, sf_dir):
    planted = faulty_documents(spark, sf_dir).where(F.col("code").isin(list(REPAIRED)))
    fixed = edits.smart_fix(planted.select("doc_id", "content")).select("doc_id", F.col("content").cast("string").alias("repaired"), F.col("repairs").cast("long").alias("repairs"))
    return planted.select("doc_id", "code").join(fixed, "doc_id")


# whole texts and node rows ------------------------------------------------------------


@query("""WITH_LINES, b AS (SELECT k, string_agg('    <Line n="' || ord || '" part="' || part || '">' || chr(10) || '      <Qty>' || q || '</Qty>' || chr(10) || '      <Price>' || p || '</Price>' || chr(10) || '    </Line>' || chr(10), '' ORDER BY ord) AS body FROM l WHERE has GROUP BY k)
    SELECT d.k AS doc_id, '<Order key="' || d.k || '" status="' || s || '">' || chr(10) || '  <Lines>' || chr(10) || coalesce(body, '') || '  </Lines>' || chr(10) || '</Order>' || chr(10) AS text FROM d LEFT JOIN b ON b.k = d.k""")
def q44_pretty_text(spark, sf_dir):
    return order_documents(spark, sf_dir).select("doc_id", text.pretty(F.col("content")).alias("text"))


@query("""WITH_LINES SELECT k AS doc_id, '/Order[1]/Lines[1]/Line[' || ord || ']' AS path, '<Line n="' || ord || '" part="' || part || '"><Qty>' || q || '</Qty><Price>' || p || '</Price></Line>' AS preview FROM l WHERE has AND CAST(q AS DOUBLE) > 25""")
def q45_xpath_nodes(spark, sf_dir):
    found = xpath_plan.evaluate(order_documents(spark, sf_dir), "/Order/Lines/Line[Qty > 25]", cap=None)
    return found.select("doc_id", F.inline("nodes")).select("doc_id", "path", "preview")


@query("""WITH_LINES
    SELECT k AS doc_id, count(*) AS n, max_by('n=' || ord || ' part=' || part, ord) AS last FROM l WHERE has AND ord <= 50 GROUP BY k""")
def q46_repeated_cells(spark, sf_dir):
    """The cells of an element whose children repeat: as many as it has children, the last of a name in the record."""
    cells = table.cells(order_scan(spark, sf_dir), F.col("name") == "Lines")
    return cells.groupBy("doc_id").agg(F.count("*").alias("n"), F.max_by("value", "ord").alias("last"))


@query("WITH_LINES SELECT k AS doc_id, (2 + 3 * n) * 34 + 8 + 24 * 2 + 10 + CASE WHEN n > 0 THEN 24 * 3 + 12 ELSE 0 END AS heap_bytes FROM d")
def q47_index_size(spark, sf_dir):
    s = order_scan(spark, sf_dir)
    return navigate.heap_bytes(s.stats, s.elements)


@query("WITH_LINES SELECT k AS doc_id, '@' || a AS attribute, v AS value, a || '=\"' || v || '\"' AS preview FROM (SELECT k, 'key' AS a, CAST(k AS VARCHAR) AS v FROM d)")
def q48_first_attribute(spark, sf_dir):
    found = xpath_plan.select(order_scan(spark, sf_dir), "/Order/@*", "strict")
    return found.select("doc_id", F.concat(F.lit("@"), "attribute").alias("attribute"), "value", "preview")
