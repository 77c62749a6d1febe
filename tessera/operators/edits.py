"""Edits as relations: line overlays with undo, character edits, and the application of suggested repairs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scanner import Diagnostic, ScanConfig, scan_bytes
from tessera.sources.documents import from_lines, lines

# character edits ------------------------------------------------------------


def insert(text: Column, at: int, new: str) -> Column:
    return F.overlay(text, F.lit(new), at + 1, 0)


def delete(text: Column, at: int, n: int) -> Column:
    return F.overlay(text, F.lit(""), at + 1, n)


def replace(text: Column, at: int, n: int, new: str) -> Column:
    return F.overlay(text, F.lit(new), at + 1, n)


# line edits: rows (doc_id, line, seq, op, text) with op set, insert (after the line) or delete ---------------


def effective(edits: DataFrame, cursor: int | None = None) -> DataFrame:
    """The edits that count: up to ``cursor`` (undo and redo move it), of a line the last set or delete, every insert."""
    live = edits if cursor is None else edits.where(F.col("seq") <= cursor)
    lasting = live.where("op != 'insert'")
    last = F.row_number().over(Window.partitionBy("doc_id", "line").orderBy(F.desc("seq")))
    return lasting.withColumn("__n", last).where("__n = 1").drop("__n").unionByName(live.where("op = 'insert'"))


def overlay(rows: DataFrame, edits: DataFrame, cursor: int | None = None) -> DataFrame:
    """Lines (doc_id, line, text) with the edits applied: doc_id, line (renumbered), text, edited."""
    live = effective(edits, cursor)
    fixed = live.where("op != 'insert'").select("doc_id", "line", F.col("op").alias("__op"), F.col("text").alias("__new"))
    kept = rows.select("doc_id", "line", "text").join(fixed, ["doc_id", "line"], "left").where("__op is null or __op != 'delete'")
    ends = F.when(F.col("text").endswith("\r"), "\r").otherwise("")
    kept = kept.select("doc_id", "line", F.lit(0).alias("__after"), F.when(F.col("__op").isNotNull(), F.concat("__new", ends)).otherwise(F.col("text")).alias("text"), F.col("__op").isNotNull().alias("edited"))
    # a later insert after the same line comes first
    added = live.where("op = 'insert'").select("doc_id", "line", (1 + F.row_number().over(Window.partitionBy("doc_id", "line").orderBy(F.desc("seq")))).alias("__after"), "text", F.lit(True).alias("edited"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "__after"))
    return kept.unionByName(added).select("doc_id", number.cast("long").alias("line"), "text", "edited")


def apply(documents: DataFrame, edits: DataFrame, cursor: int | None = None) -> DataFrame:
    """Documents (doc_id, content) with the edits applied. Untouched documents and lines keep their bytes."""
    touched = documents.join(edits.select("doc_id").distinct(), "doc_id", "left_semi")
    rest = documents.join(edits.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.col("content").cast("binary").alias("content"))
    return rest.unionByName(from_lines(overlay(lines(touched, keep_returns=True), edits, cursor)))


def commit(documents: DataFrame, edits: DataFrame, cursor: int | None = None) -> DataFrame:
    """The edited documents as a new base: checkpointed, so later scans and searches do not replay the edits."""
    return apply(documents, edits, cursor).checkpoint()


def count(edits: DataFrame, cursor: int | None = None) -> DataFrame:
    live = edits if cursor is None else edits.where(F.col("seq") <= cursor)
    return live.groupBy("doc_id").agg(F.count("*").alias("edits"))


# repairs --------------------------------------------------------------------

#: Fixed value: what is said of a repair that nobody can make here.
MANUAL = "needs a schema-aware fixer"
_VALUE, _ATTRIBUTE, _CLOSING = (re.compile(p) for p in (rb"[^\s>/]+", rb"""[^\s=]+\s*=\s*(?:"[^"]*"|'[^']*')""", rb"</([^>\s]*)[^>]*>?"))

#: A repair takes the document, the offset of the fault and the text after the verb of its suggestion.
#: It returns the bytes [start, end) to replace and what to put there, or None if it finds something else there.
Change = tuple[int, int, bytes] | None


def _escape(found: bytes, escaped: bytes) -> Callable[[bytes, int, str], Change]:
    return lambda content, at, _: (at, at + len(found), escaped) if content.startswith(found, at) else None


def _quote(content: bytes, at: int, _: str) -> Change:
    if not (m := _VALUE.match(content, at)):
        return None
    head = content[:at].rstrip()
    return (len(head) if head.endswith(b"=") else at), m.end(), b'"' + m[0] + b'"'


def _drop_attribute(content: bytes, at: int, _: str) -> Change:
    m = _ATTRIBUTE.match(content, at)
    return m and (len(content[:at].rstrip()), m.end(), b"")


def _drop_end_tag(content: bytes, at: int, _: str) -> Change:
    m = _CLOSING.match(content, at)
    return m and (at, m.end(), b"")


def _close_other(content: bytes, at: int, suggestion: str) -> Change:
    """The end tag gets the open element's name, or the elements still open are closed before it."""
    verb, _, tags = suggestion.partition(" ")
    if verb == "Insert":
        return at, at, tags.encode()
    m = _CLOSING.match(content, at)
    return m and (at + 2, m.end(1), tags.removeprefix("to </").removesuffix(">").encode())


def _close_all(content: bytes, at: int, suggestion: str) -> Change:
    return len(content), len(content), suggestion.partition(" ")[2].encode()


_AMPERSAND = _escape(b"&", b"&amp;")
REPAIRS: dict[str, Callable[[bytes, int, str], Change]] = {
    "D02": _AMPERSAND, "D06": _AMPERSAND, "D07": _AMPERSAND,
    "D03": _escape(b"]]>", b"]]&gt;"), "D08": _escape(b"<", b"&lt;"), "D23": _escape(b"--", b"- -"),
    "D11": _drop_attribute, "D14": _quote, "D18": _drop_end_tag, "D19": _close_other, "D27": _close_all,
}


def repair_one(content: bytes, error: Diagnostic) -> bytes | None:
    """The document with the fault's suggestion applied; None if it cannot be applied."""
    at = error.offset - (error.code == "D08")  # reported at the byte after the '<'
    change = REPAIRS[error.code](content, at, error.fix) if error.fix and error.code in REPAIRS else None
    if not change or content[change[0] : change[1]] == change[2]:
        return None
    start, end, new = change
    return content[:start] + new + content[end:]


def repair(content: bytes, rounds: int = 1000) -> tuple[bytes, int, list[str]]:
    """Apply repairs one by one, scanning again after each: the content, repairs made, repairs left to people."""
    made, left, skip = 0, [], set()
    for _ in range(rounds):
        errors = [e for e in scan_bytes(content, ScanConfig(contents=False)).errors if e.fix]
        e = next((e for e in errors if (e.code, e.fix, e.offset) not in skip), None)
        if e is None:
            left = [e.fix for e in errors]
            break
        if (new := repair_one(content, e)) is None:
            skip.add((e.code, e.fix, e.offset))
        else:
            content, made = new, made + 1
    return content, made, left


def smart_fix(documents: DataFrame) -> DataFrame:
    """doc_id, content after all repairs that can be made, how many, and the repairs that were left (array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [repair(raw.as_py() or b"") for raw in batch.column("content")]
            content, made, left = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content, pa.binary()), pa.array(made, pa.int64()), pa.array(left, pa.list_(pa.string()))], ["doc_id", "content", "repairs", "left"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content"))
    return narrow.mapInArrow(run, "doc_id long, content binary, repairs long, left array<string>")
