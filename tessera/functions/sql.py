"""The engine in SQL: scalar functions and two table functions for LATERAL joins.

    SELECT d.doc_id, e.* FROM documents d, LATERAL xml_elements(d.content) e
    SELECT d.doc_id, h.* FROM documents d, LATERAL xml_search(d.content, 'needle', false) h
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators.scan import leaf_texts, paths
from tessera.operators.scanner import scan_bytes
from tessera.operators.search import Finder, preview


def _bytes(content) -> bytes:
    return content.encode() if isinstance(content, str) else bytes(content or b"")


class ElementsOf:
    def eval(self, content) -> Iterator[tuple]:
        raw = _bytes(content)
        index = scan_bytes(raw)
        full, _, place = paths(index)
        texts = leaf_texts(index, raw)
        for i in range(index.indexed):
            end = index.end[i]
            yield i, index.parent[i], index.depth[i], index.name_of(i), index.start[i], end if end >= 0 else None, index.line[i], place[i], full[i], texts[i]


class HitsOf:
    def eval(self, content, needle: str, ignore_case: bool) -> Iterator[tuple]:
        raw, wanted = _bytes(content), needle.encode()
        finder = Finder(wanted, ignore_case)
        finder.feed(raw)
        for offset, line, col in finder.hits:
            yield offset, line, col, preview(raw, offset, len(wanted))


def register(spark: SparkSession) -> None:
    """xml_elements and xml_search, and the scalars (xml_decode, xml_escape, xml_local_name, xml_guess_type, xml_leaf_text)."""
    scalars.register(spark)
    spark.udtf.register("xml_elements", F.udtf(ElementsOf, returnType="elem_id int, parent int, depth int, name string, start bigint, end bigint, line bigint, sib_pos int, path string, text string"))
    spark.udtf.register("xml_search", F.udtf(HitsOf, returnType="offset bigint, line bigint, col bigint, preview string"))
