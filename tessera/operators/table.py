"""Table mode: the repeating children of an element as records with discovered columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import leading_number_column
from tessera.operators.scan import Scan

FIELD_CAP, MAX_COLUMNS = 50, 2000


def repeating(elements: DataFrame, of: DataFrame) -> DataFrame:
    """Children of the rows of ``of`` that share the first child's name, where there are two or more children."""
    kids = elements.join(of.select("doc_id", F.col("elem_id").alias("parent")), ["doc_id", "parent"], "left_semi")
    w = Window.partitionBy("doc_id", "parent")
    kids = kids.withColumns({"__first": F.first_value("name").over(w.orderBy("elem_id")), "__n": F.count("*").over(w)})
    return kids.where("__n >= 2 and name = __first").drop("__first", "__n")


def _entries(scan: Scan, rows: DataFrame | Column, cap: int | None) -> DataFrame:
    """doc_id, elem_id and the cells of each element as an array of (ord, key, value): read off its own row, no join."""
    own = scan.records
    own = own.where(rows) if isinstance(rows, Column) else own.join(rows.select("doc_id", "elem_id"), ["doc_id", "elem_id"], "left_semi")
    cell = lambda at, key, value: F.struct(at.cast("int").alias("ord"), key.alias("key"), value.alias("value"))
    attributes = F.transform("attrs", lambda a, i: cell(i + 1, F.concat(F.lit("@"), a["name"]), a["value"]))
    text = F.array(cell(F.lit(1_000_000), F.lit("#text"), F.col("text")))
    text = F.filter(text, lambda x: F.coalesce(x["value"], F.lit("")) != "")
    kids = F.transform(F.col("kids") if cap is None else F.slice("kids", 1, cap), lambda k, i: cell(i + 2_000_001, k["name"], k["value"]))
    return own.select("doc_id", "elem_id", F.concat(attributes, text, kids).alias("cells"))


def cells(scan: Scan, rows: DataFrame | Column, cap: int | None = FIELD_CAP) -> DataFrame:
    """doc_id, elem_id, ord, key, value: @attributes, #text of a leaf, and children (text, or k=v of attributes, or (n children)).

    ``rows`` are elements, or a condition on the columns of ``Scan.elements`` (then one scan answers).
    """
    return _entries(scan, rows, cap).select("doc_id", "elem_id", F.inline("cells"))


def records(cell_rows: DataFrame) -> DataFrame:
    """doc_id, elem_id and the record as a map; of a repeated key the last value."""
    one = cell_rows.groupBy("doc_id", "elem_id", "key").agg(F.max_by("value", "ord").alias("value"), F.min("ord").alias("ord"))
    return one.groupBy("doc_id", "elem_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key", "value"))), lambda x: F.struct(x["key"], x["value"]))).alias("record"))


def columns(cell_rows: DataFrame) -> list[str]:
    """Keys in first-seen order. A table has few; more than MAX_COLUMNS are refused."""
    seen = cell_rows.groupBy("key").agg(F.min(F.struct("doc_id", "elem_id", "ord")).alias("at")).orderBy("at").limit(MAX_COLUMNS + 1).collect()
    if len(seen) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    return [r["key"] for r in seen]


def table(scan: Scan, rows: DataFrame | Column, keys: list[str] | None = None) -> DataFrame:
    """One row an element: doc_id, elem_id, row_no and a string column for each key (null where absent, the last if repeated)."""
    keys = columns(cells(scan, rows)) if keys is None else keys
    last_first = F.reverse("cells")
    found = _entries(scan, rows, FIELD_CAP).select("doc_id", "elem_id", F.transform(last_first, lambda c: c["key"]).alias("__keys"), F.transform(last_first, lambda c: c["value"]).alias("__values"))
    wide = found.select("doc_id", "elem_id", *(F.get("__values", (F.array_position("__keys", k) - 1).cast("int")).alias(k) for k in keys))
    return wide.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("elem_id")))


def _cell_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("doc_id", "elem_id", "row_no")]


def filter_rows(df: DataFrame, needle: str) -> DataFrame:
    """Rows with a cell that contains ``needle``, whatever the case."""
    if not needle:
        return df
    hit: Column = F.lit(False)
    for c in _cell_columns(df):
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f"`{c}`")), F.lit(needle.lower())), F.lit(False))
    return df.where(hit)


def sort_rank(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``rank``: numbers by value first, then texts, then absent cells; ties in document order."""
    c = F.col(f"`{column}`")
    number = leading_number_column(c)
    order = Window.partitionBy("doc_id").orderBy(c.isNull(), number.isNull(), number, c, "elem_id")
    return df.withColumn("rank", F.row_number().over(order))
