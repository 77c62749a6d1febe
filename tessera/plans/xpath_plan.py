"""XPath over many documents.

``evaluate`` answers any XPath 1.0 expression with the per-document evaluator.
``select`` answers the subset ``count(...)``, ``/a//b[n]/@c`` with relational plans
over a scan. Every element row carries its path of names and its path with
ordinals, so a subset expression is first turned into one pattern over those
columns: no join at all. Only a position that counts other than same-named
siblings (a wildcard, or a smart match over several prefixes) needs the step-wise
plan of equi-joins on the parent and range joins on preorder intervals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scan import Scan
from tessera.operators.scanner import scan_bytes
from tessera.plans import xpath as xp
from tessera.plans.xpath_eval import Evaluator, Node, Tree, number_text, to_string

NODE_CAP, PREVIEW = 2000, 160
LITERAL_NOTE = "Index paths match literal QNames; namespaces are not resolved."
_RESULT = "doc_id long, kind string, value string, count long, nodes array<struct<id:int,name:string,line:long,path:string,preview:string>>, warning string, error string, ns_mode string, default_namespace string, effective_expr string"


def _free_prefix(taken: dict[str, str]) -> str:
    n, prefix = 0, "__dflt"
    while prefix in taken:
        n += 1
        prefix = f"__dflt{n}"
    return prefix


def evaluate_one(content: bytes, expr: str, ns_mode: str = "smart", cap: int | None = NODE_CAP) -> dict:
    """Result of an expression on one document, as the fields of the result rows (without doc_id)."""
    out: dict = {"kind": "value", "value": "", "count": 0, "nodes": [], "warning": None, "error": None, "ns_mode": ns_mode, "default_namespace": None, "effective_expr": None}
    expr = expr.strip()
    if not expr:
        return out
    index = scan_bytes(content)
    if index.error_count:
        return out | {"kind": "error", "value": None, "error": "Document is not well-formed; fix errors first."}
    tree = Tree(content, index)
    prefixes = tree.prefixes()
    roots = [n for n in tree.root.children if n.kind == "element"]
    default = roots[0].namespaces.get("", "") if roots else ""
    tried = expr
    if default and ns_mode == "smart":
        prefix = _free_prefix(prefixes)
        tried = xp.bind_default_namespace(expr, prefix)
        prefixes = prefixes | {prefix: default}
        if tried != expr:
            out |= {"default_namespace": default, "effective_expr": tried}
    evaluator, failures = Evaluator(tree, prefixes), []
    for attempt in dict.fromkeys((tried, expr)):  # as it was written, if the bound form cannot be evaluated
        try:
            value = evaluator(xp.parse(attempt), tree.root)
            break
        except (xp.XPathError, RecursionError) as e:
            failures.append(str(e))
    else:
        return out | {"kind": "error", "value": None, "error": failures[0]}
    if failures:
        out |= {"default_namespace": None, "effective_expr": None}
    empty = False
    if isinstance(value, list):
        value.sort(key=lambda n: n.order)
        shown = value if cap is None else value[:cap]
        out |= {"kind": "nodes", "value": None, "count": len(value), "nodes": [_shown(tree, n) for n in shown]}
        empty = not value
    else:
        out |= {"value": number_text(value) if isinstance(value, float) else to_string(value), "count": 1}
        empty = value == 0.0 and "count(" in expr and not isinstance(value, bool)
    if empty and ns_mode == "strict" and default and xp.bind_default_namespace(expr, "p") != expr:
        out["warning"] = f'No match: the document declares the default namespace "{default}", and unprefixed names in XPath 1.0 mean no namespace. Use smart mode or local-name().'
    return out


def _shown(tree: Tree, n: Node) -> dict:
    element = n.elem_id
    line = tree.index.line[element] if element >= 0 else 1
    if n.kind == "element":
        return {"id": element, "name": n.name, "line": line, "path": tree.path(element), "preview": tree.outer(element, PREVIEW)}
    name = f"@{n.name}" if n.kind == "attribute" else n.name if n.kind == "processing-instruction" else f"#{n.kind}"
    path = tree.path(element) + (f"/@{n.name}" if n.kind == "attribute" else "")
    return {"id": element, "name": name, "line": line, "path": path, "preview": n.text()[:PREVIEW]}


def evaluate(documents: DataFrame, expr: str, ns_mode: str = "smart", cap: int | None = NODE_CAP) -> DataFrame:
    """One row a document: its nodes or value, count, and what went wrong or may surprise."""
    if expr.strip():
        xp.parse(expr)  # a malformed expression fails here, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"doc_id": d, **evaluate_one(c.as_py() or b"", expr, ns_mode, cap)} for d, c in zip(batch.column("doc_id").to_pylist(), batch.column("content"))]
            yield pa.RecordBatch.from_pylist(rows, schema)

    node = pa.struct([("id", pa.int32()), ("name", pa.string()), ("line", pa.int64()), ("path", pa.string()), ("preview", pa.string())])
    text = lambda *names: [(n, pa.string()) for n in names]
    schema = pa.schema([("doc_id", pa.int64()), *text("kind", "value"), ("count", pa.int64()), ("nodes", pa.list_(node)), *text("warning", "error", "ns_mode", "default_namespace", "effective_expr")])
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content"))
    return narrow.mapInArrow(run, _RESULT)


# the subset -----------------------------------------------------------------


@dataclass(frozen=True)
class SubsetStep:
    anywhere: bool
    name: str
    position: int | None


@dataclass(frozen=True)
class Subset:
    steps: tuple[SubsetStep, ...]
    attribute: str | None
    count: bool


_STEP = re.compile(r"(//?)\s*(\*|[^\s/\[\]@()*]+)\s*(?:\[\s*(\d+)\s*\])?\s*")
_LAST_ATTRIBUTE = re.compile(r"(//?)\s*@\s*(\*|[^\s/\[\]@()*]+)\s*\Z")


def parse_subset(expr: str) -> Subset:
    """Absolute paths of child and descendant steps with names and positions, a last attribute, and count()."""
    body = expr.strip()
    counted = re.fullmatch(r"count\s*\(\s*(.*?)\s*\)", body, re.S)
    body = counted[1] if counted else body
    attribute = None
    if m := _LAST_ATTRIBUTE.search(body):
        if m[1] == "//" or not m.start():
            raise xp.XPathError(f"Unsupported expression: {expr!r}")
        attribute, body = m[2], body[: m.start()]
    if not body.startswith("/"):
        raise xp.XPathError(f"An absolute path is needed here: {expr!r}")
    steps, at = [], 0
    while at < len(body):
        m = _STEP.match(body, at)
        if not m or m[2] in (".", ".."):
            raise xp.XPathError(f"Unsupported expression near {body[at:]!r} in {expr!r}")
        steps.append(SubsetStep(m[1] == "//", m[2], int(m[3]) if m[3] else None))
        at = m.end()
    return Subset(tuple(steps), attribute, bool(counted))


def _local(name: str) -> str:
    return name.partition(":")[2] or name


def _name_pattern(name: str, smart: bool) -> str:
    if name == "*":
        return r"[^/\[]+"
    return rf"(?:{re.escape(name)}|(?:[^/:\[]+:)?{re.escape(_local(name))})" if smart else re.escape(name)


def pattern_of(subset: Subset, ns_mode: str) -> str | None:
    """A regular expression over ``path``, or None if a position needs the step-wise plan."""
    smart, out = ns_mode == "smart", ""
    for s in subset.steps:
        if s.position is not None and (s.name == "*" or smart):
            return None
        out += (r"(?:/[^/]+)*/" if s.anywhere else "/") + _name_pattern(s.name, smart) + (rf"\[{s.position}\]" if s.position is not None else r"\[\d+\]")
    return rf"\A{out}\z"


def name_test(name: str, ns_mode: str, column: Column | None = None) -> Column:
    c = F.col("name") if column is None else column
    if name == "*":
        return F.lit(True)
    if ns_mode != "smart":
        return c == name
    return (c == name) | (F.substr(c, F.instr(c, ":") + 1) == _local(name))  # after the first colon, as _local has it


def _stepwise(elements: DataFrame, subset: Subset, ns_mode: str) -> DataFrame:
    context: DataFrame | None = None
    for s in subset.steps:
        match = elements.where(name_test(s.name, ns_mode))
        if context is None:
            found = match if s.anywhere else match.where("depth = 0")
        else:
            up = context.select(F.col("doc_id").alias("__doc"), F.col("elem_id").alias("__id"), F.col("end").alias("__end"))
            inside = (F.col("doc_id") == F.col("__doc")) & ((F.col("elem_id") > F.col("__id")) & (F.col("start") < F.coalesce("__end", F.lit((1 << 63) - 1))) if s.anywhere else F.col("parent") == F.col("__id"))
            found = match.join(up, inside, "left_semi")  # a node-set: every node once
        if s.position is not None:
            order = Window.partitionBy("doc_id", "parent").orderBy("elem_id")
            found = found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == s.position).drop("__n")
        context = found
    return context


def notes(scan: Scan, expr: str, ns_mode: str = "smart") -> DataFrame:
    """doc_id and what to know about index results: literal names, and indexes that a budget cut short."""
    parse_subset(expr)
    short = F.when(F.col("indexed") < F.col("elements"), F.format_string("Index covers %d of %d elements.", "indexed", "elements"))
    literal = F.lit(LITERAL_NOTE) if ns_mode == "smart" else F.lit(None).cast("string")
    return scan.stats.select("doc_id", F.concat_ws(" ", literal, short).alias("note"))


def select(scan: Scan, expr: str, ns_mode: str = "smart", attribute_join: str = "inner", limit: int | None = None) -> DataFrame:
    """Rows (doc_id, elem_id, name, line, path, text, preview and, for attributes, attribute and value) or doc_id and count.

    ``attribute_join="left"`` keeps elements that lack the attribute.
    """
    subset = parse_subset(expr)
    pattern = pattern_of(subset, ns_mode)
    last = subset.steps[-1].name if subset.steps else None
    if not subset.steps:
        raise xp.XPathError(f"Unsupported expression: {expr!r}")
    test = None
    if len(subset.steps) == 1 and subset.steps[0].anywhere and subset.steps[0].position is None:
        test = name_test(last, ns_mode)
    elif pattern:
        test = name_test(last, ns_mode) & F.col("path").rlike(pattern)
    if test is not None and subset.count and not subset.attribute:
        return scan.counts(test)
    elements = scan.tagged
    found = elements.where(test) if test is not None else _stepwise(elements, subset, ns_mode)
    if subset.attribute:
        own = F.get("attrs", F.lit(0))
        if subset.attribute != "*":
            first = lambda test: F.get(F.filter("attrs", test), F.lit(0))
            own = F.coalesce(first(lambda a: a["name"] == subset.attribute), first(lambda a: F.substring_index(a["name"], ":", -1) == subset.attribute))
        found = found.withColumn("__own", own)
        if attribute_join == "inner":
            found = found.where(F.col("__own").isNotNull())
        found = found.withColumns({"attribute": F.col("__own")["name"], "value": F.col("__own")["value"]})
    if subset.count:
        counted = found.groupBy("doc_id").agg(F.count("*").alias("n"))
        return scan.doc_ids.join(counted, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
    columns = ["doc_id", "elem_id", "name", "line", "path", "text"]
    if subset.attribute:
        preview = F.when(F.col("attribute").isNull(), "(no such attribute)").otherwise(F.concat("attribute", F.lit('="'), "value", F.lit('"')))
        columns += ["attribute", "value"]
    else:
        shown = F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), a["value"], F.lit('"'))), "")
        preview = F.concat(F.lit("<"), F.col("name"), shown, F.lit(">"), F.left(F.coalesce("text", F.lit("")), F.lit(80)))
    out = found.select(*columns, preview.alias("preview"))
    return out.orderBy("doc_id", "elem_id").limit(limit) if limit is not None else out
