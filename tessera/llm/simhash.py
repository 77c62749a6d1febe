"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has bit b set if more than half of its word shingles' hashes
have it. Two fingerprints link if they differ in at most ``TAU`` = 3 bits, and a
component is what links connect.

Candidates come from the pigeonring principle: with the 64 bits on a ring of four
segments, every pair within the budget has a segment from which each chain of l
segments differs in at most l * TAU / 4 bits in all: none in the first, at most
one in the first two, at most two in the first three. So the first segment and one
half of the second agree exactly; that is the join key (24 bits). When there are
more than ``WIDE_ABOVE`` distinct fingerprints, the second segment is compared with
one bit masked out (31 bits), which finds the same links with shorter buckets. Of
the pairs in a bucket only those whose whole chain is within budget reach the full
Hamming check.

Fingerprints, not rows, are compared: a group of copies is one entry. A bucket is
cut into blocks of at most ``BLOCK`` entries and every pair of blocks is a record of
its own, so no bucket lands in one task whole; a block pair emits a spanning forest
of its links, not the pairs. Components follow from alternating large-star and
small-star rounds over the forests' edges.

Inputs: null and wordless texts have fingerprint zero and link like any other.
Texts are read whole. Null ids belong to components too; a component without any
id has a null component_id. Repeated rows share a fingerprint. Extra columns pass
through ``deduplicate``. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import discard, join_hot, materialize, maybe_among, pieces, release_memory
from tessera.llm.exact_dedup import LOWER

SHINGLE, SEED, TAU, SEGMENTS, WIDTH = 3, 42, 3, 4, 16
BLOCK = 2048
WIDE_ABOVE = 1 << 22
#: Shingle hashes whose bits are counted at once.
_STEP = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pieces = map(joined.__getitem__, map(slice, starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(text: Column) -> Column:
    """The fingerprint as a signed long."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [np.fromiter(map(fingerprint, part.to_pylist()), np.uint64, len(part)) for part in pieces(texts)]
            yield pa.array(np.concatenate(found).view(np.int64), pa.int64())
            release_memory()

    return F.arrow_udf(run, "bigint").asNondeterministic()(text)


def _segment(bits: np.ndarray, i: int) -> np.ndarray:
    return (bits >> np.uint64(WIDTH * (SEGMENTS - 1 - i % SEGMENTS))) & np.uint64(0xFFFF)


def chain_keys(fp: np.ndarray, wide: bool) -> np.ndarray:
    """The keys of each fingerprint (a row each); two within the budget share one at least."""
    bits, out = fp.view(np.uint64), []
    for i in range(SEGMENTS):
        first, second = _segment(bits, i), _segment(bits, i + 1)
        if wide:
            variants = [(j, second & ~np.uint64(1 << j)) for j in range(WIDTH)]
        else:
            variants = [(0, second >> np.uint64(8)), (1, second & np.uint64(0xFF))]
        for j, rest in variants:
            out.append(np.uint64(i << 36 | j << 32) | first << np.uint64(16) | rest)
    return np.stack(out, axis=1).astype(np.int64)


def within_chain(difference: np.ndarray, i: int) -> np.ndarray:
    """True where every chain from segment i stays within its share of the budget, and so the whole ring does."""
    total, fine = np.zeros(difference.shape, np.int64), np.ones(difference.shape, bool)
    for length in range(1, SEGMENTS + 1):
        total += np.bitwise_count(_segment(difference, i + length - 1)).astype(np.int64)
        fine &= total * SEGMENTS <= length * TAU
    return fine


def forest(a: np.ndarray, b: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges that connect all links between entries of ``a`` and of ``b`` (sorted, distinct; maybe the same array)."""
    nodes = np.union1d(a, b)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges, at_b = [], np.searchsorted(nodes, b)
    for x, own in zip(np.searchsorted(nodes, a).tolist(), a.view(np.uint64)):
        difference = b.view(np.uint64) ^ own
        near = np.flatnonzero(np.bitwise_count(_segment(difference, start + 1)) <= 1)
        near = near[within_chain(difference[near], start)]
        for y in at_b[near].tolist():
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                edges.append((int(nodes[x]), int(nodes[y])))
    return edges


def links(distinct: DataFrame, block: int = BLOCK, wide_above: int = WIDE_ABOVE) -> DataFrame:
    """Edges u > v among the distinct fingerprints ``fp``; they connect exactly what the links within TAU connect."""
    wide = distinct.count() > wide_above

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            keys = chain_keys(fp, wide)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp, keys.shape[1]))], ["key", "fp"])

    rows = distinct.select("fp").mapInArrow(spread, "key long, fp long")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = rows.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    pairs = pairs.agg(F.collect_list(F.struct("own", "fp")).alias("entries"))  # two blocks at most

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[int, int]] = set()
            entries = batch.column("entries")
            own, fp = (entries.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("own", "fp"))
            ends = np.cumsum(entries.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]])
            for key, i, j, s, e in zip(batch.column("key").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), starts, ends):
                if e - s < 2:
                    continue
                a, b = np.sort(fp[s:e][own[s:e] == i]), np.sort(fp[s:e][own[s:e] == j])
                out.update((max(x, y), min(x, y)) for x, y in forest(a, b, key >> 36))
            u, v = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return pairs.mapInArrow(connect, "u long, v long").distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and hash sum, observed while they are written."""
    seen = Observation()
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), "edges")
    return table, (seen.get["n"], seen.get["s"])


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node with an edge. Large-star and small-star rounds."""
    edges, mark = _stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = small.select(F.col("u"), F.col("m").alias("v")).union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()
        new, found = _stored(new)
        discard(edges)
        if found == mark:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges, mark = new, found


def _grouped(rows: DataFrame) -> DataFrame:
    """fp, its rows, root and component_id, for the fingerprints ``fp`` of rows with ``doc_id``."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "fingerprints")
    found = components(links(distinct))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(best, "root").select("fp", "rows", "root", "component_id")


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row."""
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(F.col("text").cast("string")).alias("fp")), "simhash")
    joined = join_hot(rows, materialize(_grouped(rows), "components"), ["fp"], "rows", rows.count())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, all its columns unchanged.

    Rows without an id are kept only where a component has no id at all. Of rows that
    repeat the smallest id in one component the first in text order stays.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(F.col("text").cast("string")).alias("fp")), "simhash")
    placed = materialize(join_hot(rows, materialize(_grouped(rows), "components"), ["fp"], "rows", rows.count()).drop("rows"), "placed")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = placed.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"), F.max(stays).alias("__stays"))
    ids = materialize(ids, "kept-ids")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    # rows outside a filter of the dropped ids stay where they are; only the others move
    marked = maybe_among(whole, "doc_id", ids.where("not __stays or __n > 1").select("__id"), "__maybe")
    asked = marked.where("__maybe").drop("__maybe")
    sure = asked.join(ids.where("__stays and __n = 1"), asked["doc_id"].eqNullSafe(ids["__id"])).select("row.*")
    single = marked.where("not __maybe").select("row.*").unionByName(sure)
    kept = whole.join(ids.where("__stays and __n > 1"), whole["doc_id"].eqNullSafe(ids["__id"]))
    if ids.where("__stays and __n > 1").limit(1).count() == 0:
        return single
    again = kept.select("row", "doc_id", fingerprints(F.col("row.text").cast("string")).alias("fp"))
    again = again.join(placed.select("fp", "root", "component_id").distinct(), "fp").where(stays)
    return single.unionByName(again.groupBy("root").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row")).select("row.*"))
