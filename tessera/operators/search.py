"""Literal search over document bytes: overlapping matches, positions, previews and caps.

Case folding is ASCII only. Lines and columns are bytes and start at 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.arrow import RowBuffer

MAX_HITS, BEFORE, AFTER = 1000, 40, 60
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAKS = re.compile(r"[\r\n\t]+")


class Finder:
    """Search a document given in pieces; the result is the same for any cutting."""

    def __init__(self, needle: bytes, ignore_case: bool = False, max_hits: int | None = None):
        self.fold = FOLD if ignore_case else None
        self.needle = needle.translate(self.fold) if ignore_case else needle
        self.max_hits, self.total = max_hits, 0
        self.hits: list[tuple[int, int, int]] = []
        self.tail, self.seen = b"", 0
        self.line, self.line_start, self.counted = 1, 0, 0

    def feed(self, piece: bytes) -> None:
        if not self.needle:
            self.seen += len(piece)
            return
        data = self.tail + (piece.translate(self.fold) if self.fold else piece)
        base, at = self.seen - len(self.tail), -1
        while (at := data.find(self.needle, at + 1)) >= 0:
            self.total += 1
            if self.max_hits is None or len(self.hits) < self.max_hits:
                self._count(data, base, base + at)
                self.hits.append((base + at, self.line, base + at - self.line_start + 1))
        self.seen += len(piece)
        keep = min(len(self.needle) - 1, len(data))
        self._count(data, base, self.seen - keep)
        self.tail = data[len(data) - keep :] if keep else b""

    def _count(self, data: bytes, base: int, to: int) -> None:
        """Newlines up to the offset ``to``."""
        if to > self.counted:
            a, b = self.counted - base, to - base
            if n := data.count(b"\n", a, b):
                self.line += n
                self.line_start = base + data.rfind(b"\n", a, b) + 1
            self.counted = to

    def clear(self) -> None:
        self.hits = []


def preview(content: bytes, offset: int, size: int) -> str:
    raw = content[max(0, offset - BEFORE) : offset + size + AFTER]
    return _BREAKS.sub(" ", raw.decode("utf-8", "replace"))


def search(documents: DataFrame, needle: str, ignore_case: bool = False, max_hits: int | None = MAX_HITS) -> DataFrame:
    """Hits: doc_id, offset, line, col, preview, total (all hits of the document). An empty needle finds nothing."""
    wanted = needle.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pa.int64()
        rows = RowBuffer(("doc_id", number), ("offset", number), ("line", number), ("col", number), ("preview", pa.string()), ("total", number))
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                content = raw.as_py() or b""
                finder = Finder(wanted, ignore_case, max_hits)
                finder.feed(content)
                if n := len(finder.hits):
                    offset, line, col = zip(*finder.hits)
                    rows.add([doc_id] * n, offset, line, col, [preview(content, o, len(wanted)) for o in offset], [finder.total] * n)
                    yield from rows.ready()
        yield from rows.rest()

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content"))
    return narrow.mapInArrow(run, "doc_id long, offset long, line long, col long, preview string, total long")


def count_hits(documents: DataFrame, needle: str, ignore_case: bool = False) -> DataFrame:
    """doc_id and n (0 included), without positions. Needles that cannot overlap themselves stay in the JVM."""
    text = F.col("content").cast("binary").cast("string")
    fold = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if ignore_case else text
    wanted = needle.encode().translate(FOLD).decode() if ignore_case else needle
    overlaps = any(wanted.startswith(wanted[k:]) for k in range(1, len(wanted)))
    if not wanted:
        n = F.lit(0)
    elif overlaps:
        n = F.size(F.regexp_extract_all(fold, F.lit(f"(?=({re.escape(wanted)}))"), 1))
    else:
        n = (F.length(fold) - F.length(F.replace(fold, F.lit(wanted), F.lit("")))) / len(wanted)
    return documents.select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("n"))


def search_chunks(chunks: DataFrame, needle: str, ignore_case: bool = False) -> DataFrame:
    """Offsets in one huge file read by ``xml_chunks`` with an overlap of at least the needle less one byte."""
    wanted = needle.encode().translate(FOLD) if ignore_case else needle.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, own, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "base", "own", "content"))):
                data, at, found = raw.translate(FOLD) if ignore_case else raw, -1, []
                while wanted and (at := data.find(wanted, at + 1)) >= 0 and at < own:
                    found.append(base + at)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(found, pa.int64())], ["path", "offset"])

    return chunks.select("path", "base", "own", "content").mapInArrow(run, "path string, offset long")


def next_hit(hits: DataFrame, line: int) -> DataFrame:
    """Of each document the first hit after ``line``, or else its first hit."""
    order = Window.partitionBy("doc_id").orderBy((F.col("line") <= line).cast("int"), "offset")
    return hits.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def report(hits: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Lines of the form path:line:col: offset N."""
    named = hits.join(names.select("doc_id", F.col("name").alias("file")), "doc_id") if names is not None else hits.withColumn("file", F.col("doc_id").cast("string"))
    return named.select("doc_id", "offset", F.format_string("%s:%d:%d: offset %d", "file", "line", "col", "offset").alias("report"))
