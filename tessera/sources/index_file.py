"""The flat binary file of a structural index, version 1: read, write, inspect.

Little-endian. A header of 112 bytes holds totals and the offsets of nine sections,
each aligned to eight bytes: checkpoints, element starts, ends, lines, parents,
names, depths, the name table, and the diagnostics.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.scan import structure
from tessera.operators.scanner import PENDING, UNKNOWN, Diagnostic, Index, ScanConfig, Scanner

MAGIC, VERSION, HEADER_BYTES, PARTIAL = b"XSI1", 1, 112, 1
_HEADER = struct.Struct("<4sHHIIQQQQIIII10I")
_ERROR = struct.Struct("<QQIBB")
_SECTIONS = (("start", "<u8"), ("end", "<u8"), ("line", "<u8"), ("parent", "<i4"), ("name", "<u4"), ("depth", "<u2"))
_ENDS = {UNKNOWN: 2**64 - 1, PENDING: 2**64 - 2}


class IndexFileError(ValueError):
    pass


class BadMagic(IndexFileError):
    pass


class UnsupportedVersion(IndexFileError):
    pass


class Truncated(IndexFileError):
    pass


class BadUtf8(IndexFileError):
    pass


def encode(index: Index, partial: bool = False) -> bytes:
    out = bytearray(HEADER_BYTES)
    offsets: list[int] = []

    def section(data: bytes) -> None:
        out.extend(bytes(-len(out) % 8))
        offsets.append(len(out))
        out.extend(data)

    section(np.array(index.checkpoints, "<u8").tobytes())
    for name, kind in _SECTIONS:
        values = getattr(index, name)
        if name == "end":
            values = [_ENDS.get(v, v) for v in values]
        elif name == "depth":
            values = [min(v, 0xFFFF) for v in values]
        section(np.array(values, kind).tobytes())
    section(b"".join(struct.pack("<I", len(n)) + n for n in index.names))
    errors = [struct.pack("<I", len(index.errors))]
    for e in index.errors:
        msg, fix = e.msg.encode(), (e.fix or "").encode()
        errors += [_ERROR.pack(e.offset, e.line, e.col, int(e.severity != "error"), int(e.fix is not None)), struct.pack("<I", len(msg)), msg, struct.pack("<I", len(fix)), fix]
    section(b"".join(errors))
    _HEADER.pack_into(out, 0, MAGIC, VERSION, PARTIAL * partial, index.stride, index.indexed, index.file_len, index.line_count, index.total_elements, index.total_attributes, index.max_depth, len(index.checkpoints), len(index.names), index.error_count, *offsets, len(out))
    return bytes(out)


def decode(data: bytes) -> tuple[Index, bool]:
    """The index and whether it is partial."""
    if len(data) < HEADER_BYTES:
        raise Truncated("header")
    magic, version, flags, stride, n, file_len, lines, elements, attributes, depth, marks, names, errors, *offsets = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise BadMagic(magic)
    if version != VERSION:
        raise UnsupportedVersion(version)
    if offsets[-1] > len(data):
        raise Truncated("file")

    def array(at: int, count: int, kind: str, name: str) -> list[int]:
        size = np.dtype(kind).itemsize
        if at + count * size > len(data):
            raise Truncated(name)
        return np.frombuffer(data, kind, count, at).tolist()

    index = Index(checkpoints=array(offsets[0], marks, "<u8", "checkpoints"), stride=stride, total_elements=elements, total_attributes=attributes, max_depth=depth, error_count=errors, line_count=lines, file_len=file_len)
    for (name, kind), at in zip(_SECTIONS, offsets[1:]):
        setattr(index, name, array(at, n, kind, name))
    known = {v: k for k, v in _ENDS.items()}
    index.end = [known.get(v, v) for v in index.end]

    def text(at: int, section: str) -> tuple[bytes, int]:
        if at + 4 > len(data):
            raise Truncated(section)
        (size,) = struct.unpack_from("<I", data, at)
        if at + 4 + size > len(data):
            raise Truncated(section)
        return data[at + 4 : at + 4 + size], at + 4 + size

    at = offsets[7]
    for _ in range(names):
        name, at = text(at, "names")
        index.names.append(name)
    at = offsets[8]
    if at + 4 > len(data):
        raise Truncated("errors")
    (stored,) = struct.unpack_from("<I", data, at)
    at += 4
    for _ in range(stored):
        if at + _ERROR.size > len(data):
            raise Truncated("errors")
        offset, line, col, warning, fixed = _ERROR.unpack_from(data, at)
        msg, at = text(at + _ERROR.size, "errors")
        fix, at = text(at, "errors")
        try:
            index.errors.append(Diagnostic("", offset, line, col, msg.decode(), fix.decode() if fixed else None, "warning" if warning else "error"))
        except UnicodeDecodeError:
            raise BadUtf8("errors") from None
    return index, bool(flags & PARTIAL)


def index_files(documents: DataFrame, config: ScanConfig = ScanConfig(contents=False), partial: bool = False) -> DataFrame:
    """doc_id and the index file (binary) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("content"):
                content = raw.as_py() or b""
                if not partial and config == ScanConfig(contents=False):
                    out.append(encode(structure(content)))
                    continue
                scanner = Scanner(config)
                scanner.feed(content)
                out.append(encode(scanner.snapshot() if partial else scanner.finish(), partial))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "index_file"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content"))
    return narrow.mapInArrow(run, "doc_id long, index_file binary")


def inspect(files: DataFrame, names: int = 10) -> DataFrame:
    """Totals, size and first names of index files (doc_id, index_file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("index_file").to_pylist()):
                index, partial = decode(raw)
                rows.append({"doc_id": doc_id, "bytes": index.file_len, "lines": index.line_count, "elements": index.total_elements, "indexed": index.indexed, "attributes": index.total_attributes, "max_depth": index.max_depth, "errors": index.error_count, "partial": partial, "heap_bytes": index.heap_bytes(), "names": [n.decode("utf-8", "replace") for n in index.names[:names]]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    numbers = ("bytes", "lines", "elements", "indexed", "attributes", "max_depth", "errors")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in numbers), ("partial", pa.bool_()), ("heap_bytes", pa.int64()), ("names", pa.list_(pa.string()))])
    return files.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in numbers) + ", partial boolean, heap_bytes long, names array<string>")
