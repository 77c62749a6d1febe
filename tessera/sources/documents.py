"""Documents as rows: reading, slicing by bytes and lines, and generating corpora."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.sources.arrow import RowBuffer

#: Up to this size a document is handled in memory as one cell; larger ones are read in chunks.
IN_MEMORY_LIMIT = 16 << 20
HEAD_BYTES, CHUNK_BYTES = 2 << 20, 8 << 20
HARBOURS = ("Tórshavn", "Sète", "Ribe", "Gdańsk", "Vardø", "Hull")
SKIES = ("clear", "haze &amp; sun", "overcast", "squalls", "sleet")


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Files as documents: doc_id (hash of the path), name, content, n_bytes, in_memory."""
    files = spark.read.format("binaryFile").load([*paths] if len(paths) > 1 else paths[0])
    return files.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("length").alias("n_bytes"), (F.col("length") < IN_MEMORY_LIMIT).alias("in_memory"))


def from_strings(df: DataFrame, doc_id: str, content: str, name: str | None = None) -> DataFrame:
    """Any string or binary column as documents."""
    raw = F.col(content).cast("binary")
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(name) if name else F.col(doc_id).cast("string")).alias("name"), raw.alias("content"), F.octet_length(raw).cast("long").alias("n_bytes"))


def head(documents: DataFrame, n: int = HEAD_BYTES) -> DataFrame:
    """The first ``n`` bytes of every document, for a provisional index."""
    return documents.withColumn("content", F.substring(F.col("content").cast("binary"), 1, n))


def byte_range(content: Column, start: Column | int, end: Column | int) -> Column:
    """Text of the bytes [start, end)."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    raw = F.substring(content.cast("binary"), (lit(start) + 1).cast("int"), (lit(end) - lit(start)).cast("int"))
    return raw.cast("string")


def text_of(content: Column) -> Column:
    return content.cast("binary").cast("string")


def lines(documents: DataFrame, first: int | None = None, last: int | None = None, keep_returns: bool = False) -> DataFrame:
    """doc_id, line (from 1), start (byte) and text of every line, or of lines [first, last).

    A carriage return before the newline is not part of the text unless ``keep_returns``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = RowBuffer(("doc_id", pa.int64()), ("line", pa.int64()), ("start", pa.int64()), ("text", pa.string()))
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                parts = (raw.as_py() or b"").split(b"\n")
                lo, hi = max(0, (first or 1) - 1), len(parts) if last is None else max(0, last - 1)
                starts, at = [], 0
                for p in parts:
                    starts.append(at)
                    at += len(p) + 1
                kept = parts[lo:hi] if keep_returns else [p.removesuffix(b"\r") for p in parts[lo:hi]]
                n = len(kept)
                rows.add([doc_id] * n, range(lo + 1, lo + 1 + n), starts[lo : lo + n], [p.decode("utf-8", "replace") for p in kept])
                yield from rows.ready()
        yield from rows.rest()

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content"))
    return narrow.mapInArrow(run, "doc_id long, line long, start long, text string")


def from_lines(rows: DataFrame, order: str = "line", text: str = "text") -> DataFrame:
    """Documents back from lines (doc_id, order, text)."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy("doc_id").agg(joined.cast("binary").alias("content"))


def checkpoints(rows: DataFrame, stride: int = 32) -> DataFrame:
    """Start of every ``stride``-th line: doc_id, block, start."""
    return rows.where((F.col("line") - 1) % stride == 0).select("doc_id", ((F.col("line") - 1) / stride).cast("int").alias("block"), "start")


# generated corpora ------------------------------------------------------------

HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n<buoys xmlns="urn:sample:buoys">\n'
FOOTER = "</buoys>\n"
#: No report of ``buoy_report`` is longer than this.
REPORT_BYTES = 250


def buoy_report(i: Column) -> Column:
    """One report of ten elements and four attributes; its values are drawn from hashes of its number."""
    draw = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(n))
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (draw(salt, len(values)) + 1).cast("int"))
    text = (
        ' <report seq="%d"><buoy code="b%x" depth="%d"><port>%s</port><drift>%.3f</drift></buoy>\n'
        '  <sea><swell unit="m">%.1f</swell><period>%d</period></sea><air><sky>%s</sky><hpa>%d</hpa></air>\n </report>\n'
    )
    return F.format_string(text, i, draw("code", 1 << 20), draw("depth", 400), pick("port", HARBOURS), draw("drift", 90_000) / 1e3, draw("swell", 120) / 10.0, draw("period", 18) + 3, pick("sky", SKIES), draw("hpa", 90) + 960)


def _reports(first: Column, n: int) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: buoy_report(first + k)), "") if n else F.lit("")


def _documents(spark: SparkSession, n: int, kind: str, body: Column) -> DataFrame:
    made = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string(f"{kind}-%d.xml", "id").alias("name"), F.concat(F.lit(HEADER), body, F.lit(FOOTER)).cast("binary").alias("content"))
    return made.withColumn("n_bytes", F.octet_length("content").cast("long"))


def generate(spark: SparkSession, documents: int, records: int) -> DataFrame:
    """``documents`` documents of ``records`` reports each, made on the executors."""
    return _documents(spark, documents, "corpus", _reports(F.col("id") * records, records))


def generate_size(spark: SparkSession, size: int, documents: int = 1) -> DataFrame:
    """As ``generate``, for about ``size`` bytes in all (no more)."""
    around = len((HEADER + FOOTER).encode())
    return generate(spark, documents, max(0, (size // documents - around) // REPORT_BYTES))


def generate_repeated(spark: SparkSession, documents: int, size: int, template_bytes: int = 1 << 20) -> DataFrame:
    """Documents of about ``size`` bytes each: one template of reports, repeated (made on the executors)."""
    template = _reports(F.lit(0), max(1, min(size, template_bytes) // REPORT_BYTES))
    return _documents(spark, documents, "repeated", F.transform(F.array(template), lambda t: F.repeat(t, F.greatest(F.lit(1), F.round(F.lit(size) / F.octet_length(t)).cast("int"))))[0])


def goto(rows: DataFrame, line: int) -> DataFrame:
    """The line (doc_id, line, ...) with a number, or the nearest there is, of every document."""
    last = F.max("line").over(Window.partitionBy("doc_id"))
    return rows.withColumn("__last", last).where(F.col("line") == F.greatest(F.lit(1), F.least(F.lit(line), F.col("__last")))).drop("__last")


# files ------------------------------------------------------------------------


class FileSink(DataSource):
    """``write.format("xml_files")``: every row (name, content) as a file of its own below ``path``.

    Executors write, so ``path`` must be on storage all of them mount. A file appears
    whole or not at all, and a task that runs again writes the same bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "xml_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"].removeprefix("file://").removeprefix("file:"))


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import os
        import uuid

        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            target = os.path.join(self.path, os.path.basename(row["name"]))
            part = f"{target}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(bytes(row["content"] or b""))
            os.replace(part, target)
        return WriterCommitMessage()


# files too large for a cell ---------------------------------------------------


class ChunkSource(DataSource):
    """``format("xml_chunks")``: a file as rows (path, chunk_no, base, content, overlap) of ``chunk`` bytes.

    Files are read by every executor, so ``path`` must be on storage all of them mount.
    ``overlap`` more bytes follow each chunk, so that a search needs no neighbour.
    """

    @classmethod
    def name(cls) -> str:
        return "xml_chunks"

    def schema(self) -> str:
        return "path string, chunk_no int, base long, content binary, own int"

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(self.options["path"], int(self.options.get("chunk", CHUNK_BYTES)), int(self.options.get("overlap", 0)))


class _ChunkReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, overlap: int):
        self.path, self.chunk, self.overlap = path.removeprefix("file://").removeprefix("file:"), chunk, overlap

    def partitions(self) -> list[InputPartition]:
        import os

        size = os.path.getsize(self.path)
        return [InputPartition(k) for k in range(max(1, -(-size // self.chunk)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        k = partition.value
        with open(self.path, "rb") as f:
            f.seek(k * self.chunk)
            data = f.read(self.chunk + self.overlap)
        yield self.path, k, k * self.chunk, data, min(self.chunk, len(data))
