"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in hash order, form blocks. With weight w (of all weights
together, exactly as given) its block j is released at slot floor(j / w) and has the
deadline ceil((j + 1) / w). Earliest deadline first among the released blocks meets
every deadline, so at any slot every source has had its share to within less than
one block.

The schedule is made on the driver, from the sources' sizes alone. It has at most
``MAX_SLOTS`` slots: a block holds ``BLOCK`` documents, or as many more as a larger
corpus needs to have no more blocks than that. Its slots are broadcast.

When a source has no blocks left the others go on with their weights scaled up
(a new phase); no document is dropped or repeated. Sources without a target weight
follow after all others, in equal shares.

Inputs: a null source is the source ''; null ids and repeated rows are placed like
any other row (each gets a position of its own). Without weights the target is the
``TEMPERATURE`` power of the sources' sizes. Texts are never read except for
breaking ties, so their length does not matter; blocks with the same deadline go by
the larger weight, then by the source's name. Extra columns pass through ``mix``.
Empty tables give empty results.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_side

BLOCK, TEMPERATURE = 16, 0.5
#: The schedule is made on the driver and broadcast; more sources are refused, and blocks grow before there are more slots.
MAX_SOURCES, MAX_SLOTS = 1000, 1 << 18
#: Documents of all sources that one task puts in order, about.
BUCKET_ROWS = 4_000


def block_size(counts: dict[str, int], block: int = BLOCK, max_slots: int = MAX_SLOTS) -> int:
    """Documents a block: ``block``, or the least number with which no more than ``max_slots`` (and one a source) are needed."""
    return max(block, ceil(sum(counts.values()) / max_slots))


def one_phase(weights: dict[str, float], left: dict[str, int]) -> list[str]:
    """The source of each slot until one of them has no blocks left: earliest deadline first among the blocks released."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    # block j of s is released at floor(j * up / down)
    pace = {s: ((total / w).numerator, (total / w).denominator) for s, w in exact.items()}
    later = [(0, s, 0) for s in sorted(exact)]  # release, source, block
    heapq.heapify(later)
    ready: list[tuple[int, Fraction, str, int]] = []
    slots: list[str] = []
    while True:
        while later and later[0][0] <= len(slots):
            _, s, j = heapq.heappop(later)
            up, down = pace[s]
            heapq.heappush(ready, (-(-(j + 1) * up // down), -exact[s], s, j))
        _, _, s, j = heapq.heappop(ready)
        slots.append(s)
        if j + 1 == left[s]:
            return slots
        up, down = pace[s]
        heapq.heappush(later, ((j + 1) * up // down, s, j + 1))


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> list[str]:
    """The source of every slot, until all blocks are placed."""
    left = {s: n for s, n in blocks.items() if n}
    slots: list[str] = []
    while left:
        active = {s: weights[s] for s in left if weights.get(s, 0.0) > 0} or dict.fromkeys(left, 1.0)
        phase = one_phase(active, left)
        for s in phase:
            left[s] -= 1
        left = {s: n for s, n in left.items() if n}
        slots += phase
    return slots


def slot_table(docs: DataFrame, slots: list[str]) -> DataFrame:
    """__source, __block and slot of every block."""
    had: dict[str, int] = {}
    block = []
    for s in slots:
        had[s] = had.get(s, 0) + 1
        block.append(had[s] - 1)
    columns = {"__source": pa.array(slots, pa.string()), "__block": pa.array(block, pa.int64()), "slot": pa.array(range(len(slots)), pa.int64())}
    return materialize(docs.sparkSession.createDataFrame(pa.table(columns)), "slots")


def _placed(docs: DataFrame, kept: list[Column], weights: dict[str, float] | None, block: int) -> DataFrame:
    named = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    tie = [F.col("text")] if "text" in docs.columns else []
    order = F.xxhash64(F.col("doc_id"), *tie)
    keyed = docs.select(*kept, named.alias("__source"), order.alias("__order"), F.col("doc_id").alias("__doc"))
    counts = {r[0]: r[1] for r in docs.select(named.alias("s")).groupBy("s").count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    target = {s: float(n) ** TEMPERATURE for s, n in counts.items()} if weights is None else weights
    block = block_size(counts, block)
    table = slot_table(docs, schedule({s: ceil(n / block) for s, n in counts.items()}, target))
    buckets = max(1, ceil(sum(counts.values()) / BUCKET_ROWS))
    dealt = keyed.withColumn("__bucket", F.pmod(F.col("__order"), F.lit(buckets)).cast("int"))
    sizes = docs.select(named.alias("__source"), F.pmod(order, F.lit(buckets)).cast("int").alias("__bucket")).groupBy("__source", "__bucket").count()
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = small_side(sizes.select("__source", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start")))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__order", "__doc")
    ranked = dealt.withColumn("__rank", F.row_number().over(inside)).join(starts, ["__source", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__start") + F.col("__rank") - 1).withColumn("__block", F.floor(F.col("__rank") / F.lit(block)))
    found = ranked.join(F.broadcast(table), ["__source", "__block"])  # MAX_SLOTS rows and one a source at most
    return found.withColumn("position", F.col("slot") * F.lit(block) + F.col("__rank") % F.lit(block))


def place(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, slot of its block and position in the mixture, of every row.

    Positions are distinct and ordered; gaps follow the last, partly filled block of a source.
    """
    out = _placed(docs, [], weights, block)
    return out.select(F.col("__doc").alias("doc_id"), F.col("__source").alias("source"), F.col("slot").cast("long").alias("slot"), F.col("position").cast("long").alias("position"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """All rows of ``docs``, in the order of the mixture (partitions follow each other, rows are sorted within)."""
    out = _placed(docs, [F.struct("*").alias("__row")], weights, block).select("__row", "position")
    return out.repartitionByRange("position").sortWithinPartitions("position").select("__row.*")
