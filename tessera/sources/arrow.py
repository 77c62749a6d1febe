"""Rows of many documents gathered into record batches of a useful size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

FLUSH_ROWS = 50_000


class RowBuffer:
    """Columns in the order of ``fields``; ``add`` takes one iterable a column, all of one length."""

    def __init__(self, *fields: tuple[str, pa.DataType]):
        self.fields = fields
        self.columns: list[list] = [[] for _ in fields]

    def add(self, *columns: Iterable) -> None:
        for own, values in zip(self.columns, columns, strict=True):
            own += values

    def ready(self) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= FLUSH_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(self.columns, self.fields)], [n for n, _ in self.fields])
        self.columns = [[] for _ in self.fields]
