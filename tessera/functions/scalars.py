"""Scalar functions, each as plain Python and, where Spark can express it, as a Column expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The named entities in the order they are decoded (ampersand last), and the lexical types.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
NUMERIC_TYPES = ("xs:positiveInteger", "xs:integer", "xs:decimal")
#: (type, pattern); the first that matches wins. Patterns are anchored at both ends unless they end in '.*'.
LEXICAL_TYPES = (
    ("xs:positiveInteger", r"[1-9][0-9]*"),
    ("xs:integer", r"-?[0-9]+"),
    ("xs:decimal", r"-?[0-9]*\.[0-9]+"),
    ("xs:date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("xs:dateTime", r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}.*"),
    ("xs:boolean", r"(?:true|false)"),
    ("xs:anyURI", r"https?://.*"),
)
_TYPE_OF = [(name, re.compile(pattern, re.S)) for name, pattern in LEXICAL_TYPES]
_NUMERIC_REFERENCE = re.compile(r"&#(?:x([0-9a-fA-F]+)|([0-9]+));")
_CDATA, _COMMENT = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S), re.compile(r"<!--.*?-->", re.S)
_SIZE = re.compile(r"\s*([0-9]*\.?[0-9]+|[0-9]+\.)\s*([A-Za-z]*)\s*\Z")
UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "kib": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "mib": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "gib": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "tib": 1 << 40}


def _character(m: re.Match) -> str:
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def decode_entities(s: str) -> str:
    """The five named entities and numeric references; anything else stays as it is."""
    if "&" not in s:
        return s
    for entity, char in NAMED:
        s = s.replace(entity, char)
    return _NUMERIC_REFERENCE.sub(_character, s).replace("&amp;", "&")


def escape_xml(s: str) -> str:
    for char, entity in ESCAPES:
        s = s.replace(char, entity)
    return s


def local_name(qname: str) -> str:
    """What follows the first colon."""
    return qname.partition(":")[2] if ":" in qname else qname


def guess_type(value: str) -> str:
    """The narrowest lexical XSD type of a value."""
    return next((name for name, pattern in _TYPE_OF if pattern.fullmatch(value)), "xs:string")


def merge_types(types: Iterable[str]) -> str | None:
    """The narrowest type that covers all of them; None of nothing."""
    distinct = set(types)
    if len(distinct) < 2:
        return next(iter(distinct), None)
    return max(distinct, key=NUMERIC_TYPES.index) if distinct <= set(NUMERIC_TYPES) else "xs:string"


def leaf_text(outer: str) -> str:
    """Text of a childless element from its markup: CDATA unwrapped as it stands, comments dropped, trimmed, decoded."""
    start = outer.find(">")
    if start < 0 or outer[start - 1] == "/":
        return ""
    end = outer.rfind("</")
    inner = _COMMENT.sub("", outer[start + 1 : end if end > start else len(outer)])
    out, at = [], 0
    for m in _CDATA.finditer(inner):
        out += [decode_entities(inner[at : m.start()]), m[1]]
        at = m.end()
    return "".join([*out, decode_entities(inner[at:])]).strip()


def parse_size(text: str) -> int:
    """Bytes of '1.5MiB' and the like; ValueError for anything else."""
    m = _SIZE.match(text)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * UNITS[m[2].lower()])


def human(n: int) -> str:
    """512 B, 2.00 KiB, 3.00 GiB."""
    if n < 1024:
        return f"{n} B"
    size, unit = float(n), ""
    for unit in ("KiB", "MiB", "GiB", "TiB"):
        size /= 1024
        if size < 1024:
            break
    return f"{size:.2f} {unit}"


def short_size(n: int) -> str:
    """As ``human``, with one decimal below a GiB."""
    for unit, scale, digits in (("B", 1, 0), ("KiB", 1 << 10, 1), ("MiB", 1 << 20, 1)):
        if n < scale * 1024:
            return f"{n / scale:.{digits}f} {unit}"
    return f"{n / (1 << 30):.2f} GiB"


def grouped(n: int) -> str:
    return f"{n:,}"


# columns ------------------------------------------------------------------


def escape_column(c: Column) -> Column:
    for char, entity in ESCAPES:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def decode_column(c: Column) -> Column:
    """Named entities in the JVM; only texts with numeric references go through Python."""

    def numeric(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _NUMERIC_REFERENCE.sub(_character, t) for t in texts.to_pylist()], pa.string())

    for entity, char in NAMED:
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.when(c.contains("&#"), F.arrow_udf(numeric, "string")(F.when(c.contains("&#"), c))).otherwise(c)
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def local_name_column(c: Column) -> Column:
    return F.regexp_replace(c, r"\A[^:]*:", "")


def guess_type_column(c: Column) -> Column:
    out = F.lit("xs:string")
    for name, pattern in reversed(LEXICAL_TYPES):
        out = F.when(c.rlike(rf"(?s)\A{pattern}\z"), F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


def merge_types_column(types: Column) -> Column:
    """Over an array of distinct types (collect_set of guesses)."""
    rank = F.array_max(F.transform(types, lambda t: F.array_position(F.array(*map(F.lit, NUMERIC_TYPES)), t).cast("int")))
    numeric = F.forall(types, lambda t: t.isin(*NUMERIC_TYPES))
    return F.when(F.size(types) == 1, types[0]).when((F.size(types) > 1) & numeric, F.element_at(F.array(*map(F.lit, NUMERIC_TYPES)), rank)).when(F.size(types) > 1, F.lit("xs:string"))


def ascii_fold_column(c: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(c, upper, upper.lower())


def human_column(n: Column) -> Column:
    shown = lambda scale: F.bround(n / float(scale), 2)  # noqa: E731  half to even, like Python's format
    out = F.format_string("%.2f TiB", shown(1 << 40))
    for unit, scale in (("GiB", 1 << 30), ("MiB", 1 << 20), ("KiB", 1 << 10)):
        out = F.when(n < scale * 1024, F.format_string(f"%.2f {unit}", shown(scale))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def leading_number_column(c: Column) -> Column:
    """What a lenient number parser reads at the start of a text, or null."""
    return F.regexp_extract(c, r"\A\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")


def schema_location_column(text: Column) -> Column:
    """Last token of the first schemaLocation within the first 40 lines, or null."""
    head = F.array_join(F.slice(F.split(text, "\n", 41), 1, 40), "\n")
    value = F.regexp_extract(head, r'(?:xsi:)?(?:noNamespace)?[sS]chemaLocation\s*=\s*"([^"]+)"', 1)
    return F.when(value != "", F.element_at(F.split(F.trim(value), r"\s+"), -1))


def _vectorized(f: Callable[[str], object]) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    return run


def register(spark: SparkSession) -> None:
    """The scalars as SQL functions (xml_decode, xml_escape, ...)."""
    functions: dict[str, Callable[[str], object]] = {"xml_decode": decode_entities, "xml_escape": escape_xml, "xml_local_name": local_name, "xml_guess_type": guess_type, "xml_leaf_text": leaf_text}
    for name, f in functions.items():
        spark.udf.register(name, F.arrow_udf(_vectorized(f), "string"))
