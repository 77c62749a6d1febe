"""The scan as a DataFrame operator: documents in, one long table of nodes out, views of it by kind.

A document is a row, so documents scan in parallel; one pass produces every view.
``Scan.persist`` keeps that pass when more than one view is used.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.scalars import decode_entities
from tessera.operators.scanner import Index, ScanConfig, Scanner, scan_bytes
from tessera.operators.vector_scan import MIN_BYTES, vector_scan, vector_totals

_PAIR = pa.struct([("name", pa.string()), ("value", pa.string())])
_PAIRS = "array<struct<name:string,value:string>>"
FIELDS = (
    ("doc_id", "long", pa.int64()),
    ("kind", "string", pa.string()),
    ("elem_id", "int", pa.int32()),
    ("parent", "int", pa.int32()),
    ("depth", "int", pa.int32()),
    ("start", "long", pa.int64()),
    ("end", "long", pa.int64()),
    ("line", "long", pa.int64()),
    ("col", "long", pa.int64()),
    ("name", "string", pa.string()),
    ("value", "string", pa.string()),
    ("ord", "int", pa.int32()),
    ("path", "string", pa.string()),
    ("path_names", "string", pa.string()),
    ("fix", "string", pa.string()),
    ("counts", "array<long>", pa.list_(pa.int64())),
    ("attrs", _PAIRS, pa.list_(_PAIR)),
    ("kids", _PAIRS, pa.list_(_PAIR)),
)
SCHEMA = ", ".join(f"`{n}` {t}" for n, t, _ in FIELDS)
COUNTS = ("bytes", "lines", "elements", "indexed", "attributes", "max_depth", "errors")
FLUSH_ROWS = 50_000
_STRUCTURE = ScanConfig(contents=False)
#: Documents are laid end to end up to this size for the array scan.
GROUP_BYTES = 2 << 20


def paths(index: Index) -> tuple[list[str], list[str], list[int]]:
    """Absolute path, path of names, and ordinal among same-named siblings of every element."""
    full, plain, place = [], [], []
    seen: dict[tuple[int, int], int] = {}
    names = [n.decode("utf-8", "replace") for n in index.names]
    for parent, name in zip(index.parent, index.name):
        n = seen[parent, name] = seen.get((parent, name), 0) + 1
        shown = names[name]
        place.append(n)
        # roots are not siblings of each other
        full.append(f"{full[parent]}/{shown}[{n}]" if parent >= 0 else f"/{shown}[1]")
        plain.append(f"{plain[parent]}/{shown}" if parent >= 0 else f"/{shown}")
    return full, plain, place


def leaf_texts(index: Index, content: bytes) -> list[str | None]:
    """Trimmed text of the elements without child elements, None for the others."""
    parts: list[list[str] | None] = [[] for _ in index.start]
    for parent in index.parent:
        if parent >= 0:
            parts[parent] = None
    for parent, kind, start, end in index.contents:
        if parent >= 0 and kind in ("text", "cdata") and (own := parts[parent]) is not None:
            raw = content[start:end].decode("utf-8", "replace")
            own.append(decode_entities(raw) if kind == "text" else raw)
    return [None if p is None else "".join(p).strip() for p in parts]


_SHAPE = ("doc_id", "elem_id", "parent", "depth", "start", "end", "line", "name", "ord", "path", "path_names")
#: The groups of kinds a scan can be asked for, with the columns each fills. Element rows come in four widths: bare,
#: with leaf text, with their attributes too, and with what a table shows of their children.
GROUPS: dict[str, tuple[str, ...]] = {
    "shape": _SHAPE,
    "elem": (*_SHAPE, "value"),
    "tagged": (*_SHAPE, "value", "attrs"),
    "record": (*_SHAPE, "value", "attrs", "kids"),
    "attr": ("doc_id", "elem_id", "depth", "start", "end", "name", "value", "ord"),
    "content": ("doc_id", "kind", "parent", "start", "end", "name", "value", "ord"),
    "diag": ("doc_id", "start", "line", "col", "name", "value", "ord", "path", "fix"),
    "mark": ("doc_id", "start", "ord"),
    "stat": ("doc_id", "counts"),
}
ELEMENTS = ("shape", "elem", "tagged", "record")
_KINDS = {g: ("elem",) if g in ELEMENTS else (g,) for g in GROUPS} | {"content": ("text", "cdata", "comment", "pi")}
ALL = frozenset(GROUPS).difference(ELEMENTS[:-1])
_TYPES = {n: t for n, _, t in FIELDS}


class Pairs:
    """A column of lists of (name, value), kept flat."""

    def __init__(self) -> None:
        self.ends, self.names, self.values = [0], [], []

    def add(self, sizes: list[int], names: Iterable[str], values: Iterable[str]) -> None:
        self.ends += islice(accumulate(sizes, initial=self.ends[-1]), 1, None)
        self.names += names
        self.values += values

    def array(self) -> pa.Array:
        pairs = pa.StructArray.from_arrays([pa.array(self.names, pa.string()), pa.array(self.values, pa.string())], fields=list(_PAIR))
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pairs, pa.list_(_PAIR))


def shown_children(index: Index, texts: list[str | None], sizes: list[int], names: list[str], values: list[str]) -> tuple[list[list[int]], list[str]]:
    """Children of every element, and what a cell shows of each: its text, else its attributes, else how many children it has."""
    kids: list[list[int]] = [[] for _ in texts]
    for i, parent in enumerate(index.parent):
        if parent >= 0:
            kids[parent].append(i)
    shown, at = [], 0
    for text, size, below in zip(texts, sizes, kids):
        own = " ".join(f"{names[k]}={values[k]}" for k in range(at, at + size)) if size and not text else ""
        at += size
        shown.append(text or own or (f"({len(below)} children)" if below else ""))
    return kids, shown


class NodeColumns:
    """Node rows of many documents, gathered as columns by group of kinds."""

    def __init__(self, groups: frozenset[str]):
        self.groups = groups
        self.clear()

    def clear(self) -> None:
        self.columns = {g: {c: Pairs() if c in ("attrs", "kids") else [] for c in GROUPS[g]} for g in self.groups}
        self.rows = 0

    def _add(self, group: str, doc_id: int | None, n: int, **columns) -> None:
        own = self.columns[group]
        own["doc_id"] += [doc_id] * n
        for name, values in columns.items():
            own[name] += values
        self.rows += n

    def add(self, doc_id: int | None, content: bytes, index: Index) -> None:
        text = lambda a, b: content[a:b].decode("utf-8", "replace")
        groups, n = self.groups, len(index.start)
        names = [x.decode("utf-8", "replace") for x in index.names]
        attribute_names, attribute_values, sizes = [], [], [0] * n
        if groups & {"attr", "tagged", "record"}:
            attribute_names = [x.decode("utf-8", "replace") for _, x, _, _ in index.attributes]
            attribute_values = [decode_entities(text(i, j)) for _, _, i, j in index.attributes]
            for e, _, _, _ in index.attributes:
                sizes[e] += 1
        for group in groups.intersection(ELEMENTS):
            full, plain, place = paths(index)
            called = [names[k] for k in index.name]
            self._add(group, doc_id, n, elem_id=range(n), parent=index.parent, depth=index.depth, start=index.start, end=[e if e >= 0 else None for e in index.end], line=index.line, name=called, ord=place, path=full, path_names=plain)
            own = self.columns[group]
            if "value" in own:
                texts = leaf_texts(index, content)
                own["value"] += texts
            if "attrs" in own:
                own["attrs"].add(sizes, attribute_names, attribute_values)
            if "kids" in own:
                kids, shown = shown_children(index, texts, sizes, attribute_names, attribute_values)
                flat = [k for below in kids for k in below]
                own["kids"].add([len(below) for below in kids], [called[k] for k in flat], [shown[k] for k in flat])
        if "attr" in groups and index.attributes:
            element, _, start, end = zip(*index.attributes)
            number, last, numbers = 0, -1, []
            for e in element:
                number, last = (number + 1 if e == last else 1), e
                numbers.append(number)
            self._add("attr", doc_id, len(element), elem_id=element, depth=[index.depth[e] for e in element], start=start, end=end, name=attribute_names, value=attribute_values, ord=numbers)
        if "content" in groups and index.contents:
            parent, kind, start, end = zip(*index.contents)
            raw = [text(i, j) for i, j in zip(start, end)]
            split = [r.partition(" ") if k == "pi" else (None, None, decode_entities(r) if k == "text" else r) for k, r in zip(kind, raw)]
            self._add("content", doc_id, len(kind), kind=kind, parent=parent, start=start, end=end, name=[x[0] for x in split], value=[x[2] for x in split], ord=range(len(kind)))
        if "diag" in groups and index.errors:
            e = index.errors
            self._add("diag", doc_id, len(e), start=[x.offset for x in e], line=[x.line for x in e], col=[x.col for x in e], name=[x.code for x in e], value=[x.msg for x in e], ord=range(len(e)), path=[x.severity for x in e], fix=[x.fix for x in e])
        if "mark" in groups:
            self._add("mark", doc_id, len(index.checkpoints), start=index.checkpoints, ord=range(len(index.checkpoints)))
        if "stat" in groups:
            self._add("stat", doc_id, 1, counts=[[index.file_len, index.line_count, index.total_elements, index.indexed, index.total_attributes, index.max_depth, index.error_count]])

    def flush(self) -> Iterator[pa.RecordBatch]:
        for group, own in self.columns.items():
            n = len(own["doc_id"])
            if n:
                made = {c: values.array() if isinstance(values, Pairs) else pa.array(values, _TYPES[c]) for c, values in own.items()}
                made.setdefault("kind", pa.repeat(_KINDS[group][0], n))
                yield pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(n, t) for c, _, t in FIELDS], [c for c, _, _ in FIELDS])
        self.clear()


class Scan:
    """All relations of a scan. Unless the scan is persisted, each view scans for its own kinds of rows only."""

    def __init__(self, narrow: DataFrame, config: ScanConfig, complete: bool):
        self._documents, self._config, self._complete = narrow, config, complete
        self._all: DataFrame | None = None

    @property
    def nodes(self) -> DataFrame:
        """The long table of all rows."""
        return self._all if self._all is not None else _nodes(self._documents, self._config, self._complete, ALL)

    def persist(self) -> Scan:
        self._all = self.nodes.persist()
        return self

    def unpersist(self) -> Scan:
        if self._all is not None:
            self._all.unpersist()
            self._all = None
        return self

    @property
    def doc_ids(self) -> DataFrame:
        """The ids of all documents, without a scan."""
        return self._documents.select("doc_id")

    def _view(self, *groups: str) -> DataFrame:
        if self._all is None:
            return _nodes(self._documents, self._config, self._complete, frozenset(groups))
        return self._all.where(F.col("kind").isin([k for g in groups for k in _KINDS[g]]))

    @staticmethod
    def _elements(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("doc_id", "elem_id", "parent", "depth", "name", "start", "end", "line", F.col("ord").alias("sib_pos"), "path", "path_names", F.col("value").alias("text"), *more)

    @property
    def elements(self) -> DataFrame:
        return self._elements(self._view("elem"))

    @property
    def tagged(self) -> DataFrame:
        """``elements`` with ``attrs``: their (name, value) in order, so that no join is needed for them."""
        return self._elements(self._view("tagged"), "attrs")

    @property
    def records(self) -> DataFrame:
        """``tagged`` with ``kids``: (name, value) of the children in order, the value being what a table cell shows."""
        return self._elements(self._view("record"), "attrs", "kids")

    def counts(self, match: Column) -> DataFrame:
        """doc_id and the number of elements for which ``match`` (of name, depth, path, path_names) holds, 0 included.

        One pass and one partial aggregation. Documents that share an id, or have none, are counted together.
        """
        hit = (F.col("kind") == "elem") & match
        return self._view("shape", "stat").groupBy("doc_id").agg(F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias("count"))

    @property
    def attributes(self) -> DataFrame:
        return self._view("attr").select("doc_id", "elem_id", F.col("ord").alias("attr_no"), "name", "value", "depth")

    @property
    def texts(self) -> DataFrame:
        """Text, cdata, comment and pi nodes; elem_id is the element they are in (-1 outside the root)."""
        return self._view("content").select("doc_id", F.col("parent").alias("elem_id"), F.col("ord").alias("node_no"), "kind", "name", "value", "start", "end")

    @property
    def diagnostics(self) -> DataFrame:
        return self._view("diag").select("doc_id", F.col("ord").alias("seq"), F.col("name").alias("code"), F.col("start").alias("offset"), "line", "col", F.col("path").alias("severity"), F.col("value").alias("msg"), "fix")

    @property
    def checkpoints(self) -> DataFrame:
        return self._view("mark").select("doc_id", F.col("ord").alias("block"), "start")

    @property
    def stats(self) -> DataFrame:
        return self._view("stat").select("doc_id", *(F.col("counts")[i].alias(n) for i, n in enumerate(COUNTS)))

    def observed(self, observation: Observation) -> DataFrame:
        """``stats`` that also reports progress totals to an Observation while the action runs."""
        return self.stats.observe(observation, F.count(F.lit(1)).alias("documents"), F.sum("elements").alias("elements"), F.sum("errors").alias("errors"), F.sum("bytes").alias("bytes"))

    def report(self, names: DataFrame | None = None) -> DataFrame:
        """Lines of the form path:line:col: severity: message, with the repair below."""
        found = self.diagnostics
        found = found.join(names.select("doc_id", F.col("name").alias("file")), "doc_id", "left") if names is not None else found.withColumn("file", F.col("doc_id").cast("string"))
        fix = F.when(F.col("fix").isNotNull(), F.concat(F.lit("\n    SmartFix: "), F.col("fix"))).otherwise("")
        return found.select("doc_id", "seq", F.concat(F.format_string("%s:%d:%d: %s: %s", "file", "line", "col", "severity", "msg"), fix).alias("report"))


def scan(documents: DataFrame, config: ScanConfig = ScanConfig(), prefix: int | None = None, complete: bool = True) -> Scan:
    """Scan ``content`` (binary or string) of every row of ``documents`` (doc_id, content).

    ``prefix`` scans only the first bytes; with ``complete`` false the end is not
    checked and nothing is closed (a partial index). Null content scans like empty.
    """
    content = F.col("content").cast("binary")
    if prefix is not None:
        content = F.substring(content, 1, prefix)

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), content.alias("content"))
    return Scan(narrow, config, complete)


def _nodes(narrow: DataFrame, config: ScanConfig, complete: bool, groups: frozenset[str]) -> DataFrame:
    contents = config.contents and bool(groups & {"elem", "tagged", "record", "attr", "content"})
    config = replace(config, contents=contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = NodeColumns(groups)
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                raw = raw.as_py() or b""
                if complete and config == _STRUCTURE and len(raw) >= MIN_BYTES:
                    index = structure(raw)
                else:
                    scanner = Scanner(config)
                    scanner.feed(raw)
                    index = scanner.finish() if complete else scanner.snapshot()
                rows.add(doc_id, raw, index)
                if rows.rows >= FLUSH_ROWS:
                    yield from rows.flush()
        yield from rows.flush()

    return narrow.mapInArrow(run, SCHEMA)


def structure(content: bytes) -> Index:
    """The index of a document without contents; large regular documents take the array path."""
    if len(content) >= MIN_BYTES and (index := vector_scan(content)) is not None:
        return index
    return scan_bytes(content, _STRUCTURE)


def _totals_of(contents: list[bytes], tries: int = 2) -> list[tuple]:
    """Counters of documents: regular ones together in arrays, in halves if one of them is not, else one by one."""
    if sum(map(len, contents)) >= MIN_BYTES:
        if (found := vector_totals(contents)) is not None:
            return [(size, lines, elements, elements, attributes, depth, 0) for size, lines, elements, attributes, depth in found]
        if tries and len(contents) > 1:
            half = len(contents) // 2
            return _totals_of(contents[:half], tries - 1) + _totals_of(contents[half:], tries - 1)
    if len(contents) > 1:
        return [t for c in contents for t in (_totals_of([c], 0) if len(c) >= MIN_BYTES else [_slow_totals(c)])]
    return [_slow_totals(c) for c in contents]


def _slow_totals(content: bytes) -> tuple:
    ix = scan_bytes(content, _STRUCTURE)
    return ix.file_len, ix.line_count, ix.total_elements, ix.indexed, ix.total_attributes, ix.max_depth, ix.error_count


def totals(documents: DataFrame) -> DataFrame:
    """doc_id and the document counters only: no node rows are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            group, size = [], 0
            for raw in batch.column("content"):
                group.append(raw.as_py() or b"")
                size += len(group[-1])
                if size >= GROUP_BYTES:
                    out += _totals_of(group)
                    group, size = [], 0
            out += _totals_of(group)
            columns = list(zip(*out)) if out else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *COUNTS])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content"))
    return narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def well_formed(documents: DataFrame) -> DataFrame:
    """doc_id, errors and ok of every document."""
    return totals(documents).select("doc_id", "errors", (F.col("errors") == 0).alias("ok"))


def validate(documents: DataFrame) -> DataFrame:
    """Well-formedness, the schema a document names, and the note that schemas themselves are not checked."""
    head = documents.select("doc_id", F.col("content").cast("binary").cast("string").alias("text"))
    from tessera.functions.scalars import schema_location_column

    named = head.select("doc_id", schema_location_column(F.col("text")).alias("schema"))
    note = F.when(F.col("schema").isNull(), "No schema assigned. Only well-formedness was checked.").otherwise(F.format_string('Validation against "%s" needs an XSD validator. Only well-formedness was checked.', "schema"))
    return well_formed(documents).join(named, "doc_id").withColumn("warning", note)
