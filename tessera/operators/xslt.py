"""XSLT 1.0 per document: templates with modes and priorities, flow control, variables, sorting and construction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import escape_xml
from tessera.operators.scanner import scan_bytes
from tessera.plans.xpath import Expr, XPathError, parse
from tessera.plans.xpath_eval import Evaluator, Node, Tree, to_boolean, to_number, to_string

XSL = "http://www.w3.org/1999/XSL/Transform"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_AVT = re.compile(r"\{\{|\}\}|\{((?:[^{}'\"]|'[^']*'|\"[^\"]*\")*)\}")
_MAX_DEPTH = 300

#: A stylesheet that shows any document as an outline of elements, attributes and leaf texts.
OUTLINE = f"""<xsl:stylesheet version="1.0" xmlns:xsl="{XSL}">
  <xsl:output method="html"/>
  <xsl:template match="/"><html><body><ul><xsl:apply-templates select="*"/></ul></body></html></xsl:template>
  <xsl:template match="*">
    <li><b><xsl:value-of select="local-name()"/></b>
      <xsl:for-each select="@*"><i><xsl:text> </xsl:text><xsl:value-of select="name()"/>="<xsl:value-of select="."/>"</i></xsl:for-each>
      <xsl:if test="not(*) and normalize-space(.) != ''"><span><xsl:text> </xsl:text><xsl:value-of select="."/></span></xsl:if>
      <xsl:if test="*"><ul><xsl:apply-templates select="*"/></ul></xsl:if>
    </li>
  </xsl:template>
</xsl:stylesheet>"""


class XsltError(ValueError):
    pass


def _tree(content: bytes, what: str) -> Tree:
    index = scan_bytes(content)
    if index.error_count:
        raise XsltError(f"{what} is not well-formed: {index.errors[0]}")
    return Tree(content, index)


def _attribute(n: Node, name: str, default: str | None = None) -> str | None:
    return next((a.value for a in n.attributes if a.name == name), default)


class Fragment:
    """What a template builds: an element, text, comment or processing instruction with its content."""

    __slots__ = ("kind", "name", "attributes", "content", "text")

    def __init__(self, kind: str, name: str = "", text: str = ""):
        self.kind, self.name, self.text = kind, name, text
        self.attributes: dict[str, str] = {}
        self.content: list[Fragment] = []

    def string(self) -> str:
        return self.text if self.kind == "text" else "".join(c.string() for c in self.content)


def _priority(pattern: Expr) -> float:
    if pattern.op != "path" or pattern.args[0] == "root" or len(pattern.steps) != 1 or pattern.steps[0].predicates:
        return 0.5
    test = pattern.steps[0].test
    if test[0] == "name" or test[0] == "type" and test[1] == "processing-instruction" and test[2]:
        return 0.0
    return -0.25 if test[0] == "prefix" else -0.5


def _alternatives(e: Expr) -> list[Expr]:
    return _alternatives(e.args[0]) + _alternatives(e.args[1]) if e.op == "|" else [e]


class Stylesheet:
    def __init__(self, content: bytes):
        self.tree = _tree(content, "The stylesheet")
        root = next((n for n in self.tree.root.children if n.kind == "element"), None)
        if root is None or root.uri != XSL or root.local not in ("stylesheet", "transform"):
            raise XsltError("The stylesheet has no xsl:stylesheet root.")
        self.root = root
        self.parsed: dict[str, Expr] = {}
        self.rules: list[tuple[str | None, float, int, Expr, Node]] = []
        self.named: dict[str, Node] = {}
        self.globals: list[Node] = []
        self.method: str | None = None
        for order, n in enumerate(c for c in root.children if c.kind == "element" and c.uri == XSL):
            if n.local == "output":
                self.method = _attribute(n, "method", self.method)
            elif n.local in ("variable", "param"):
                self.globals.append(n)
            elif n.local == "template":
                if name := _attribute(n, "name"):
                    self.named[name] = n
                if match := _attribute(n, "match"):
                    for pattern in _alternatives(self.expr(match)):
                        given = _attribute(n, "priority")
                        self.rules.append((_attribute(n, "mode"), float(given) if given else _priority(pattern), order, pattern, n))
        self.rules.sort(key=lambda r: (-r[1], -r[2]))

    def expr(self, text: str) -> Expr:
        if text not in self.parsed:
            self.parsed[text] = parse(text)
        return self.parsed[text]


class Transformer:
    def __init__(self, sheet: Stylesheet, source: Tree):
        self.sheet, self.source = sheet, source
        self.matched: dict[int, frozenset[int]] = {}
        self.variables: dict[str, object] = {}
        for n in sheet.globals:
            self.variables[_attribute(n, "name")] = self._value(n, source.root, self.variables)

    def run(self) -> list[Fragment]:
        out = Fragment("root")
        self._apply([self.source.root], None, {}, out, 0)
        return out.content

    # patterns

    def _matches(self, k: int, n: Node) -> bool:
        if k not in self.matched:
            pattern, owner = self.sheet.rules[k][3], self.sheet.rules[k][4]
            evaluator = Evaluator(self.source, owner.namespaces, self.variables)
            if pattern.op == "path" and pattern.args[0] == "self":
                anywhere = parse("/descendant-or-self::node()").steps
                pattern = Expr("path", ("root",), anywhere + pattern.steps)
            self.matched[k] = frozenset(id(m) for m in evaluator(pattern, self.source.root))
        return id(n) in self.matched[k]

    def _apply(self, nodes: list[Node], mode: str | None, params: dict, out: Fragment, depth: int) -> None:
        if depth > _MAX_DEPTH:
            raise XsltError("Templates are nested too deeply.")
        for position, n in enumerate(nodes, 1):
            rule = next((r[4] for k, r in enumerate(self.sheet.rules) if r[0] == mode and self._matches(k, n)), None)
            if rule is not None:
                self._body(rule, n, position, len(nodes), dict(self.variables), out, depth + 1, params)
            elif n.kind in ("root", "element"):
                self._apply(n.children, mode, {}, out, depth + 1)
            elif n.kind in ("text", "attribute"):
                self._text(out, n.value)

    @staticmethod
    def _text(out: Fragment, text: str) -> None:
        if text and out.content and out.content[-1].kind == "text":
            out.content[-1].text += text
        elif text:
            out.content.append(Fragment("text", text=text))

    # expressions

    def _evaluate(self, owner: Node, text: str, n: Node, position: int, size: int, variables: dict):
        prefixes = {k: v for k, v in owner.namespaces.items() if k}
        values = {k: (v.string() if isinstance(v, Fragment) else v) for k, v in variables.items()}
        return Evaluator(self.source, prefixes, values, current=n)(self.sheet.expr(text), n, position, size)

    def _template(self, owner: Node, text: str, n: Node, position: int, size: int, variables: dict) -> str:
        """An attribute value template."""
        one = lambda m: m[0][0] if m[1] is None else to_string(self._evaluate(owner, m[1], n, position, size, variables))
        return _AVT.sub(one, text)

    def _value(self, owner: Node, n: Node, variables: dict, position: int = 1, size: int = 1, depth: int = 0):
        if select := _attribute(owner, "select"):
            return self._evaluate(owner, select, n, position, size, variables)
        if not owner.children:
            return ""
        built = Fragment("root")
        self._body(owner, n, position, size, dict(variables), built, depth + 1)
        return built

    def _sorted(self, owner: Node, nodes: list[Node], variables: dict) -> list[Node]:
        keys = [c for c in owner.children if c.kind == "element" and c.uri == XSL and c.local == "sort"]
        for key in reversed(keys):
            select, numeric = _attribute(key, "select", "."), _attribute(key, "data-type") == "number"
            value = {id(m): self._evaluate(key, select, m, i, len(nodes), variables) for i, m in enumerate(nodes, 1)}
            rank = (lambda m: (to_number(value[id(m)]) == to_number(value[id(m)]), to_number(value[id(m)]))) if numeric else (lambda m: to_string(value[id(m)]))
            nodes = sorted(nodes, key=rank, reverse=_attribute(key, "order") == "descending")
        return nodes

    # instructions

    def _body(self, owner: Node, n: Node, position: int, size: int, variables: dict, out: Fragment, depth: int, params: dict | None = None) -> None:
        for c in owner.children:
            if c.kind == "text":
                if c.value.strip():
                    self._text(out, c.value)
            elif c.kind == "element" and c.uri == XSL:
                self._instruction(c, n, position, size, variables, out, depth, params or {})
            elif c.kind == "element":
                made = Fragment("element", c.name)
                for k, uri in c.namespaces.items():
                    if uri not in (XSL,) and k != "xml" and (c.parent is None or c.parent.namespaces.get(k) != uri):
                        made.attributes[f"xmlns:{k}" if k else "xmlns"] = uri
                for a in c.attributes:
                    if a.uri != XSL:
                        made.attributes[a.name] = self._template(c, a.value, n, position, size, variables)
                out.content.append(made)
                self._body(c, n, position, size, dict(variables), made, depth, params)

    def _instruction(self, c: Node, n: Node, position: int, size: int, variables: dict, out: Fragment, depth: int, params: dict) -> None:
        get = lambda name, default=None: _attribute(c, name, default)
        evaluate = lambda text: self._evaluate(c, text, n, position, size, variables)
        expand = lambda text: self._template(c, text, n, position, size, variables)
        body = lambda target: self._body(c, n, position, size, dict(variables), target, depth, params)
        passed = lambda: {_attribute(p, "name"): self._value(p, n, variables, position, size, depth) for p in c.children if p.kind == "element" and p.uri == XSL and p.local == "with-param"}
        match c.local:
            case "value-of":
                self._text(out, to_string(evaluate(get("select", "."))))
            case "text":
                self._text(out, c.text())
            case "apply-templates":
                nodes = evaluate(get("select")) if get("select") else n.children
                nodes = sorted(nodes, key=lambda m: m.order)
                self._apply(self._sorted(c, nodes, variables), get("mode"), passed(), out, depth + 1)
            case "call-template":
                if get("name") not in self.sheet.named:
                    raise XsltError(f"no template named {get('name')!r}")
                if depth > _MAX_DEPTH:
                    raise XsltError("Templates are nested too deeply.")
                self._body(self.sheet.named[get("name")], n, position, size, dict(self.variables), out, depth + 1, passed())
            case "for-each":
                nodes = self._sorted(c, sorted(evaluate(get("select")), key=lambda m: m.order), variables)
                for i, m in enumerate(nodes, 1):
                    self._body(c, m, i, len(nodes), dict(variables), out, depth, params)
            case "if":
                if to_boolean(evaluate(get("test"))):
                    body(out)
            case "choose":
                for w in (w for w in c.children if w.kind == "element"):
                    if w.local == "otherwise" or to_boolean(self._evaluate(w, _attribute(w, "test"), n, position, size, variables)):
                        self._body(w, n, position, size, dict(variables), out, depth, params)
                        break
            case "variable":
                variables[get("name")] = self._value(c, n, variables, position, size, depth)
            case "param":
                name = get("name")
                variables[name] = params[name] if name in params else self._value(c, n, variables, position, size, depth)
            case "element":
                made = Fragment("element", expand(get("name")))
                out.content.append(made)
                body(made)
            case "attribute":
                built = Fragment("root")
                body(built)
                out.attributes[expand(get("name"))] = built.string()
            case "comment" | "processing-instruction":
                built = Fragment("root")
                body(built)
                out.content.append(Fragment(c.local, expand(get("name", "")), built.string()))
            case "copy":
                self._copy(n, out, lambda target: body(target))
            case "copy-of":
                value = evaluate(get("select"))
                if isinstance(value, list):
                    for m in sorted(value, key=lambda m: m.order):
                        self._deep(m, out)
                elif get("select", "").lstrip().startswith("$") and isinstance(variables.get(get("select").strip()[1:]), Fragment):
                    out.content += variables[get("select").strip()[1:]].content
                else:
                    self._text(out, to_string(value))
            case "number":
                same = [m for m in (n.parent.children if n.parent else [n]) if m.kind == n.kind and m.name == n.name]
                self._text(out, str(int(to_number(evaluate(get("value")))) if get("value") else 1 + next(i for i, m in enumerate(same) if m is n)))
            case "sort" | "with-param" | "fallback" | "message" | "strip-space" | "preserve-space":
                pass
            case other:
                raise XsltError(f"xsl:{other} is not supported")

    def _copy(self, n: Node, out: Fragment, fill) -> None:
        if n.kind == "element":
            made = Fragment("element", n.name)
            for k, uri in n.namespaces.items():
                if k != "xml" and (n.parent is None or n.parent.namespaces.get(k) != uri):
                    made.attributes[f"xmlns:{k}" if k else "xmlns"] = uri
            out.content.append(made)
            fill(made)
        elif n.kind == "root":
            fill(out)
        elif n.kind == "attribute":
            out.attributes[n.name] = n.value
        elif n.kind == "text":
            self._text(out, n.value)
        else:
            out.content.append(Fragment(n.kind, n.name, n.value))

    def _deep(self, n: Node, out: Fragment) -> None:
        def fill(made: Fragment) -> None:
            for m in [*n.attributes, *n.children]:
                self._deep(m, made)

        self._copy(n, out, fill)


def serialize(content: list[Fragment], method: str) -> str:
    out: list[str] = []

    def write(f: Fragment, raw: bool) -> None:
        if f.kind == "text":
            out.append(f.text if raw or method == "text" else f.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif f.kind == "comment":
            out.append(f"<!--{f.text}-->")
        elif f.kind == "processing-instruction":
            out.append(f"<?{f.name} {f.text}{'' if method == 'html' else '?'}>")
        elif f.kind == "element":
            if method != "text":
                out.append(f"<{f.name}" + "".join(f' {k}="{escape_xml(v)}"' for k, v in f.attributes.items()))
                if not f.content and (method != "html" or f.name.lower() in _VOID):
                    out.append(">" if method == "html" else "/>")
                    return
                out.append(">")
            for c in f.content:
                write(c, raw or method == "html" and f.name.lower() in ("script", "style"))
            if method != "text":
                out.append(f"</{f.name}>")

    for f in content:
        write(f, False)
    return "".join(out)


def transform(content: bytes, stylesheet: bytes | str = OUTLINE) -> str:
    sheet = Stylesheet(stylesheet.encode() if isinstance(stylesheet, str) else stylesheet)
    return _run(sheet, content)


def _run(sheet: Stylesheet, content: bytes) -> str:
    built = Transformer(sheet, _tree(content, "The document")).run()
    first = next((f for f in built if f.kind == "element"), None)
    method = sheet.method or ("html" if first is not None and first.name.lower() == "html" else "xml")
    return serialize(built, method)


def transform_documents(documents: DataFrame, stylesheet: str = OUTLINE) -> DataFrame:
    """doc_id, result and error (one of them null) of every document. A bad stylesheet fails on the driver."""
    Stylesheet(stylesheet.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sheet = Stylesheet(stylesheet.encode())
        for batch in batches:
            results, errors = [], []
            for raw in batch.column("content"):
                try:
                    result, error = _run(sheet, raw.as_py() or b""), None
                except (XsltError, XPathError, RecursionError, TypeError) as e:
                    result, error = None, str(e)
                results.append(result)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(results, pa.string()), pa.array(errors, pa.string())], ["doc_id", "result", "error"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content"))
    return narrow.mapInArrow(run, "doc_id long, result string, error string")
