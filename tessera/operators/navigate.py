"""Tree navigation as joins and windows over the element relation (keys doc_id, elem_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.documents import byte_range

ROOT_CAP, CHILD_CAP, SIBLING_CAP = 50, 200_000, 5000


def roots(elements: DataFrame, cap: int | None = ROOT_CAP) -> DataFrame:
    found = elements.where("depth = 0")
    if cap is None:
        return found
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("elem_id"))
    return found.withColumn("__n", n).where(F.col("__n") <= cap).drop("__n")


def _keys(of: DataFrame) -> DataFrame:
    return of.select(F.col("doc_id"), F.col("elem_id").alias("parent")).distinct()


def children(elements: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Child elements of the rows of ``of`` (all elements if not given), with ``child_no`` from 1."""
    found = elements.where("parent >= 0") if of is None else elements.join(_keys(of), ["doc_id", "parent"], "left_semi")
    return found.withColumn("child_no", F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("elem_id")))


def with_children(elements: DataFrame) -> DataFrame:
    """Elements that have a child element (semi-join)."""
    return elements.join(elements.select("doc_id", F.col("parent").alias("elem_id")), ["doc_id", "elem_id"], "left_semi")


def leaves(elements: DataFrame) -> DataFrame:
    """Elements without child elements: every element meets its children under its own key, in one pass and without a join."""
    keys = F.array(F.struct(F.col("elem_id").alias("id"), F.lit(0).alias("up")), F.struct(F.col("parent").alias("id"), F.lit(1).alias("up")))
    dealt = elements.withColumn("__key", F.explode(keys)).where("__key.id >= 0").withColumns({"__id": F.col("__key.id"), "__up": F.col("__key.up")})
    below = F.max("__up").over(Window.partitionBy("doc_id", "__id"))
    return dealt.withColumn("__below", below).where("__up = 0 and __below = 0").select(*elements.columns)


def has_children(elements: DataFrame) -> DataFrame:
    """All elements with ``has_children``, read off the next row in document order."""
    after = F.lead("parent").over(Window.partitionBy("doc_id").orderBy("elem_id"))
    return elements.withColumn("has_children", F.coalesce(after == F.col("elem_id"), F.lit(False)))


def descendants(elements: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (doc_id, ancestor_id, ancestor_name, descendant columns): an interval join within each document."""
    up = of.select(F.col("doc_id").alias("__doc"), F.col("elem_id").alias("ancestor_id"), F.col("name").alias("ancestor_name"), F.coalesce("end", F.lit((1 << 63) - 1)).alias("__end"))
    inside = (F.col("doc_id") == F.col("__doc")) & (F.col("elem_id") > F.col("ancestor_id")) & (F.col("start") < F.col("__end"))
    # neither side is ever small for certain: a table of all elements must not be gathered on the driver for a broadcast
    return elements.join(up.hint("merge"), inside).drop("__doc", "__end")


def ancestors(elements: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (doc_id, elem_id of ``of``, ancestor_id, ancestor_name, ancestor_depth)."""
    down = of.select(F.col("doc_id").alias("__doc"), F.col("elem_id").alias("of_id"), F.col("start").alias("__start"))
    holds = (F.col("doc_id") == F.col("__doc")) & (F.col("elem_id") < F.col("of_id")) & (F.coalesce("end", F.lit((1 << 63) - 1)) > F.col("__start"))
    found = elements.join(down, holds)
    return found.select("doc_id", F.col("of_id").alias("elem_id"), F.col("elem_id").alias("ancestor_id"), F.col("name").alias("ancestor_name"), F.col("depth").alias("ancestor_depth"))


def computed_paths(elements: DataFrame) -> DataFrame:
    """doc_id, elem_id and path, from joins alone (the scan already carries the same path)."""
    n = F.row_number().over(Window.partitionBy("doc_id", "parent", "name").orderBy("elem_id"))
    numbered = elements.withColumn("part", F.concat("name", F.lit("["), F.when(F.col("parent") < 0, 1).otherwise(n), F.lit("]")))
    up = numbered.select(F.col("doc_id").alias("__doc"), F.col("elem_id").alias("__above"), F.col("start").alias("__start"), F.coalesce("end", F.lit((1 << 63) - 1)).alias("__end"), F.col("depth").alias("__depth"), F.col("part").alias("__part"))
    # the bounds on depth and start are implied; with them both sides read the same columns, so Spark scans once for both
    holds = (F.col("doc_id") == F.col("__doc")) & (F.col("elem_id") > F.col("__above")) & (F.col("start") < F.col("__end")) & (F.col("start") >= F.col("__start")) & (F.col("depth") > F.col("__depth")) & (F.coalesce("end", F.lit((1 << 63) - 1)) > F.col("__start"))
    pairs = numbered.join(up.hint("merge"), holds, "left").groupBy("doc_id", "elem_id", "start", "part")
    above = F.transform(F.array_sort(F.collect_list(F.when(F.col("__depth").isNotNull(), F.struct("__depth", "__part")))), lambda x: x["__part"])
    return pairs.agg(above.alias("above")).select("doc_id", "elem_id", F.concat(F.lit("/"), F.array_join(F.concat("above", F.array("part")), "/")).alias("path"))


def node_info(elements: DataFrame, attributes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Every element (of ``of``) with its attributes in order, leaf text, child count and path."""
    kids = elements.where("parent >= 0").groupBy("doc_id", F.col("parent").alias("elem_id")).agg(F.count("*").alias("child_count"))
    own = attributes.groupBy("doc_id", "elem_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("attr_no", "name", "value"))), lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value"))).alias("attrs"))
    rows = elements if of is None else elements.join(of.select("doc_id", "elem_id"), ["doc_id", "elem_id"], "left_semi")
    out = rows.join(kids, ["doc_id", "elem_id"], "left").join(own, ["doc_id", "elem_id"], "left")
    none = F.array().cast("array<struct<name:string,value:string>>")
    return out.withColumns({"child_count": F.coalesce("child_count", F.lit(0)), "attrs": F.coalesce("attrs", none), "text": F.coalesce("text", F.lit(""))}).withColumn("has_children", F.col("child_count") > 0)


def outer_xml(elements: DataFrame, documents: DataFrame) -> DataFrame:
    """Elements with their markup; documents are joined only for the rows asked."""
    text = byte_range(F.col("content"), F.col("start"), F.coalesce("end", F.octet_length("content").cast("long")))
    return elements.join(documents.select("doc_id", "content"), "doc_id").withColumn("xml", text).drop("content")


def line_of_offset(offsets: DataFrame, lines: DataFrame) -> DataFrame:
    """As-of join: the line a byte offset (doc_id, offset) is on, with its column."""
    marks = lines.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("asked"), "line", F.col("start").alias("line_start"))
    asked = offsets.select("doc_id", F.col("offset").alias("at"), F.lit(1).alias("asked"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("long").alias("line_start"))
    w = Window.partitionBy("doc_id").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.union(asked).withColumns({"line": F.last("line", True).over(w), "line_start": F.last("line_start", True).over(w)})
    return found.where("asked = 1").select("doc_id", F.col("at").alias("offset"), "line", (F.col("at") - F.col("line_start") + 1).alias("col"))


def seek_line(checkpoints: DataFrame, line: int | Column, stride: int = 32) -> DataFrame:
    """Checkpoint before a line (from 0) and the lines to skip: doc_id, start, skip."""
    wanted = F.lit(line) if isinstance(line, int) else line
    last = F.max("block").over(Window.partitionBy("doc_id"))
    block = F.least(F.floor(wanted / stride), F.col("__last"))
    return checkpoints.withColumn("__last", last).where(F.col("block") == block).select("doc_id", "start", (wanted - F.col("block") * stride).cast("long").alias("skip"))


def flatten(elements: DataFrame, expanded: DataFrame, cap: int = SIBLING_CAP) -> DataFrame:
    """Visible rows of a tree whose rows ``expanded`` (doc_id, elem_id) are open, in document order.

    An element shows if all its ancestors are open. Past ``cap`` siblings one row
    with ``more`` stands for the rest.
    """
    shut = elements.join(expanded.select("doc_id", "elem_id"), ["doc_id", "elem_id"], "left_anti")
    hidden = descendants(elements, shut).select("doc_id", "elem_id")
    shown = elements.join(hidden, ["doc_id", "elem_id"], "left_anti")
    w = Window.partitionBy("doc_id", "parent")
    shown = shown.withColumns({"sibling": F.row_number().over(w.orderBy("elem_id")), "siblings": F.count("*").over(w)})
    more = F.when((F.col("sibling") == cap + 1), F.col("siblings") - cap)
    return shown.where(F.col("sibling") <= cap + 1).withColumn("more", more).drop("sibling", "siblings")


def errors_by_line(diagnostics: DataFrame) -> DataFrame:
    """doc_id, line, n and the messages of the line in order."""
    return diagnostics.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "msg"))), lambda x: x["msg"]).alias("messages"))


def heap_bytes(stats: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Approximate size of each packed index; with ``names`` (doc_id, name of any rows) the dictionary of names counts too."""
    blocks = F.floor((F.col("lines") - 1) / 32) + 1
    packed = stats.select("doc_id", (F.col("indexed") * 34 + blocks * 8).alias("heap_bytes"))
    if names is None:
        return packed
    held = names.select("doc_id", "name").distinct().groupBy("doc_id").agg(F.sum(F.octet_length("name") + 24).alias("__names"))
    return packed.join(held, "doc_id", "left").select("doc_id", (F.col("heap_bytes") + F.coalesce("__names", F.lit(0))).alias("heap_bytes"))
