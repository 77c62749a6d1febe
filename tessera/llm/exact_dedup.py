"""Exact deduplication by Grace hash partitioning.

1. Every task dedupes what it reads in open-addressing tables of bounded size
   (equal keys are settled by comparing the complete content). A text that fills a
   third of the corpus leaves a task once for each table, not once for each row.
2. The remaining records go to bucket files by the leading digits of their content
   hash. A bucket whose distinct contents exceed ``bucket_bytes`` is partitioned
   again by one digit more, and so on; buckets that fit are left as they are. The
   files are Spark's own shuffle files.
3. A bucket then fits one open-addressing table, which compares complete content
   and picks the record that stays. Records stream through it: copies of a content
   that it holds are compared and forgotten, so a text that every task has sent
   needs the room of one copy.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of
equal texts the row with the largest doc_id stays (a null id is smallest); among
rows that repeat the same id and text the first read stays. Texts of any length
are compared whole. Empty tables give empty results; extra columns are carried
unread by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, release_memory, small_side

#: Input bytes of one local table (all carried columns), and distinct content bytes that a bucket may have.
TABLE_BYTES, BUCKET_BYTES = 48 << 20, 64 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LEAST = -(1 << 63)


class OpenTable:
    """Open addressing with linear probing over 64-bit keys; equal keys are decided by the contents."""

    def __init__(self, expected: int):
        self.keys: list[int] = []
        self.contents: list[bytes] = []
        self._spread(expected)

    def _spread(self, expected: int) -> None:
        self.mask = (1 << max(4, (2 * expected).bit_length())) - 1
        self.slots = [-1] * (self.mask + 1)
        for i, key in enumerate(self.keys):
            at = key & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = i

    def index(self, key: int, content: bytes) -> int:
        """The entry of ``content``, added if new."""
        at, slots = key & self.mask, self.slots
        while (i := slots[at]) >= 0:
            if self.keys[i] == key and self.contents[i] == content:
                return i
            at = (at + 1) & self.mask
        i = slots[at] = len(self.keys)
        self.keys.append(key)
        self.contents.append(content)
        if 2 * len(self.keys) > self.mask:
            self._spread(2 * len(self.keys))
        return i


def normalized(text: str | None) -> bytes:
    return (text or "").encode().translate(LOWER)


def _best(current: tuple[int, int] | None, doc_id: int | None, rid: int) -> tuple[int, int]:
    """Larger doc_id first, then the smaller row number (negated)."""
    new = (_LEAST if doc_id is None else doc_id, -rid)
    return new if current is None or new > current else current


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, doc_id, row) to members (kind 0) and one content record of each local group (kind 1)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        step = max(1, batch.num_rows * (TABLE_BYTES // 8) // max(batch.nbytes, 1))  # all carried columns count
        for start in range(0, batch.num_rows, step):
            held.append(part := batch.slice(start, step))
            size += part.nbytes
            if size >= TABLE_BYTES:
                yield from _flush(held)
                held, size = [], 0
    yield from _flush(held)
    release_memory()


def _flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = OpenTable(sum(b.num_rows for b in held))
    shas: list[str] = []
    first, best, n, where = [], [], [], []
    members: list[tuple[list[int], list[int], list[int | None]]] = []
    for at, batch in enumerate(held):
        rids, ids = batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist()
        of_row = []
        for k, text in enumerate(batch.column("row").field("text")):
            content = normalized(text.as_py())
            digest = hashlib.sha256(content).digest()
            i = table.index(int.from_bytes(digest[:8], "big"), content)
            if i == len(first):
                shas.append(digest.hex())
                first.append(rids[k])
                best.append(None)
                where.append(None)
                n.append(0)
            of_row.append(i)
            if (rank := _best(best[i], ids[k], rids[k])) != best[i]:
                best[i], where[i] = rank, (at, k, rids[k], ids[k])
            n[i] += 1
        members.append((of_row, rids, ids))
    sizes = list(map(len, table.contents))
    del table
    for batch, (of_row, rids, ids) in zip(held, members):
        m = len(rids)
        yield _records(0, [first[i] for i in of_row], [shas[i] for i in of_row], rids, ids, [1] * m, [0] * m, pa.nulls(m, batch.column("row").type))
    for at, batch in enumerate(held):
        if own := [i for i, w in enumerate(where) if w[0] == at]:
            rows = batch.column("row").take(pa.array([where[i][1] for i in own], pa.int64()))
            yield _records(1, *([x[i] for i in own] for x in (first, shas)), [where[i][2] for i in own], [where[i][3] for i in own], *([x[i] for i in own] for x in (n, sizes)), rows)


_RECORD = (("kind", pa.int32()), ("gid", pa.int64()), ("sha", pa.string()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("n_bytes", pa.int64()))


def _records(kind: int, gid: list, sha: list, rid: list, doc_id: list, n: list, n_bytes: list, rows: pa.Array) -> pa.RecordBatch:
    columns = ([kind] * len(gid), gid, sha, rid, doc_id, n, n_bytes)
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, (_, t) in zip(columns, _RECORD)), rows], [*(name for name, _ in _RECORD), "row"])


class _Bucket:
    """The open-addressing table of one bucket; of equal contents it holds one, however many records bring it."""

    def __init__(self, rows: bool):
        self.table = OpenTable(16)
        self.best: list[tuple[int, int]] = []
        self.size: list[int] = []
        self.gids: list[int] = []
        self.of: list[int] = []
        self.rows: list[pa.Array] | None = [] if rows else None
        self.row_of: list[int] = []
        self.n_rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        shas, rids, ids, n = (batch.column(c).to_pylist() for c in ("sha", "rid", "doc_id", "n"))
        better: dict[int, int] = {}
        for k, text in enumerate(batch.column("row").field("text")):
            i = self.table.index(int(shas[k][:16], 16), normalized(text.as_py()))
            if i == len(self.best):
                self.best.append(None)
                self.size.append(0)
                self.row_of.append(-1)
            if (rank := _best(self.best[i], ids[k], rids[k])) != self.best[i]:
                self.best[i], better[i] = rank, k
            self.size[i] += n[k]
            if self.rows is None:
                self.of.append(i)
        if self.rows is None:
            self.gids += batch.column("gid").to_pylist()
        elif better:
            self.rows.append(batch.column("row").take(pa.array(list(better.values()), pa.int64())))
            for i in better:
                self.row_of[i] = self.n_rows
                self.n_rows += 1
            if self.n_rows > 2 * len(self.best) + 1000:
                self.compact()

    def compact(self) -> None:
        """Forget rows that a better one has replaced."""
        self.rows = [pa.concat_arrays(self.rows).take(pa.array(self.row_of, pa.int64()))] if self.rows else []
        self.row_of, self.n_rows = list(range(len(self.row_of))), len(self.row_of)

    def groups(self) -> pa.RecordBatch:
        keep = [(None if d == _LEAST else d, -r) for d, r in self.best]
        columns = (self.gids, [keep[i][0] for i in self.of], [keep[i][1] for i in self.of], [self.size[i] for i in self.of])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gid", "keep_id", "keep_rid", "group_size"])


def _settled(batches: Iterator[pa.RecordBatch], rows: bool) -> Iterator[_Bucket]:
    """The buckets, one after another; the input is sorted by bucket and cut so that a bucket's content fits a table."""
    bucket, last = None, None
    for batch in batches:
        names = batch.column("bucket").to_pylist()
        start = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[start]:
                if bucket is None or names[start] != last:
                    if bucket is not None:
                        yield bucket
                    bucket, last = _Bucket(rows), names[start]
                bucket.add(batch.slice(start, i - start))
                start = i
    if bucket is not None:
        yield bucket
    release_memory()


def _partitioned(docs: DataFrame, carried, bucket_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """Members, and the content records of each level of the recursion in bucket order."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), carried.alias("row"))
    schema = T.StructType([T.StructField(c, t) for c, t in (("kind", T.IntegerType()), ("gid", T.LongType()), ("sha", T.StringType()), ("rid", T.LongType()), ("doc_id", T.LongType()), ("n", T.LongType()), ("n_bytes", T.LongType()))] + [T.StructField("row", rows.schema["row"].dataType)])
    stored = materialize(rows.mapInArrow(_local, schema), "exact", "kind")
    members = stored.where("kind = 0").select("gid", "sha", "rid", "doc_id")
    rest = stored.where("kind = 1").drop("kind")
    # what a bucket's table will hold: of equal contents one
    contents = materialize(rest.groupBy("sha").agg(F.max("n_bytes").alias("n_bytes"), F.count("*").alias("copies")), "contents")
    total, records = contents.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    digits = max(0, math.ceil(math.log2(max(total, 1) / bucket_bytes) / 4))
    default = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = []
    while True:
        label = F.substring("sha", 1, digits)
        over = contents.groupBy(label.alias("bucket")).agg(F.sum("n_bytes").alias("s"), F.count("*").alias("n")).where((F.col("s") > bucket_bytes) & (F.col("n") > 1)).select("bucket")
        over = materialize(over, "oversize") if digits < 64 else None
        last = over is None or over.limit(1).count() == 0
        here = rest.withColumn("bucket", label)
        fits = here if last else here.join(small_side(over), "bucket", "left_anti")
        parts = min(max(default, -(-total // (2 * bucket_bytes))), 16**min(digits, 15))  # follows the bytes, whatever the session's default
        levels.append((fits.repartition(parts, "bucket") if digits else fits.coalesce(1)).sortWithinPartitions("bucket"))
        if last:
            return members, levels
        rest = here.join(small_side(over), "bucket", "left_semi").drop("bucket")
        contents = contents.withColumn("bucket", label).join(small_side(over), "bucket", "left_semi").drop("bucket")
        digits += 1


def _over_levels(levels: list[DataFrame], run, schema) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, (level.mapInArrow(run, schema) for level in levels))


def classify(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``docs``: doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text)."""
    members, levels = _partitioned(docs, F.struct(F.col("text").cast("string").alias("text")), bucket_bytes)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _settled(batches, False):
            yield bucket.groups()

    groups = _over_levels(levels, settle, "gid long, keep_id long, keep_rid long, group_size long")
    joined = members.join(groups, "gid")  # a local group's rows at most share a key
    return joined.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged."""
    _, levels = _partitioned(docs, F.struct("*"), bucket_bytes)
    kind = levels[0].schema["row"].dataType

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _settled(batches, True):
            bucket.compact()
            for rows in bucket.rows:
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([rows.slice(at, 1000)], ["row"])

    return _over_levels(levels, settle, T.StructType([T.StructField("row", kind)])).select("row.*")
