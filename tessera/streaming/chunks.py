"""Scan and search of documents that arrive in chunks, as stateful streaming operators.

The state of a document is the resumable scanner (or finder) itself. Chunks may
arrive in any order and in any batch: those ahead of the next expected one wait in
the state. The last chunk of a document has ``last`` set.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.scan import COUNTS
from tessera.operators.scanner import ScanConfig, Scanner
from tessera.operators.search import Finder

PROGRESS = "doc_id long, finished boolean, " + ", ".join(f"{c} long" for c in COUNTS)
HITS = "doc_id long, offset long, line long, col long"


def _in_order(waiting: dict[int, tuple[bytes, bool]], expected: int, pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple[bytes, bool]]:
    for pdf in pdfs:
        for r in pdf.itertuples(index=False):
            waiting.setdefault(int(r.chunk_no), (bytes(r.content), bool(r.last)))
    while expected in waiting:
        yield waiting.pop(expected)
        expected += 1


def scan_stream(chunks: DataFrame, config: ScanConfig = ScanConfig(contents=False)) -> DataFrame:
    """Counters of every document after each batch that brought chunks of it (update mode).

    ``chunks`` streams rows (doc_id, chunk_no, content, last). After the last chunk
    ``finished`` is true and the counters are those of the whole document.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scanner, waiting, expected = pickle.loads(state.get[0]) if state.exists else (Scanner(config), {}, 0)
        done = scanner.finished
        for content, last in _in_order(waiting, expected, pdfs):
            expected += 1
            if not done:
                scanner.feed(content)
                if last:
                    scanner.finish()
                    done = True
        ix = scanner.index if done else scanner.snapshot()
        state.update((pickle.dumps((scanner, waiting, expected)),))
        row = [key[0], done, ix.file_len, ix.line_count, ix.total_elements, ix.indexed, ix.total_attributes, ix.max_depth, ix.error_count]
        yield pd.DataFrame([row], columns=["doc_id", "finished", *COUNTS])

    return chunks.groupBy("doc_id").applyInPandasWithState(step, PROGRESS, "scanner binary", "update", GroupStateTimeout.NoTimeout)


def search_stream(chunks: DataFrame, needle: str, ignore_case: bool = False) -> DataFrame:
    """Hits as their chunks arrive (append mode), overlaps across chunk borders included."""
    wanted = needle.encode()

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        finder, waiting, expected = pickle.loads(state.get[0]) if state.exists else (Finder(wanted, ignore_case), {}, 0)
        for content, _ in _in_order(waiting, expected, pdfs):
            expected += 1
            finder.feed(content)
        found = finder.hits
        finder.clear()
        state.update((pickle.dumps((finder, waiting, expected)),))
        yield pd.DataFrame([(key[0], *h) for h in found], columns=["doc_id", "offset", "line", "col"]).astype("int64")

    return chunks.groupBy("doc_id").applyInPandasWithState(step, HITS, "finder binary", "append", GroupStateTimeout.NoTimeout)


def chunk_documents(documents: DataFrame, size: int) -> DataFrame:
    """Documents (doc_id, content) as chunk rows, for replay through a stream."""
    from pyspark.sql import functions as F

    content = F.col("content").cast("binary")
    n = F.greatest(F.ceil(F.octet_length(content) / F.lit(size)), F.lit(1)).cast("int")
    rows = documents.select("doc_id", content.alias("content"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return rows.select("doc_id", "chunk_no", F.expr(f"substring(content, chunk_no * {size} + 1, {size})").alias("content"), (F.col("chunk_no") == F.col("n") - 1).alias("last"))
