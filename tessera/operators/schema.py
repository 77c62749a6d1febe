"""A schema from instances: three aggregations over a scan, and the XSD text they describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import escape_xml, guess_type_column, merge_types_column
from tessera.operators.scan import Scan

#: Sampling of interactive use: elements seen, parents of a name looked at, instances typed.
SAMPLE_ELEMENTS, SAMPLE_PARENTS, SAMPLE_INSTANCES = 100_000, 2001, 25
UNBOUNDED_ABOVE, MAX_COMPONENTS = 5, 100_000


def _first(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("doc_id", "elem_id")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


class Schema:
    """``sampled`` looks only at the first elements and instances, as an interactive tool would; the default is exact."""

    def __init__(self, scan: Scan, sampled: bool = False):
        self.sampled, self.scan = sampled, scan
        # an element's path holds its parent's name, so no join with the parents is needed
        parent_name = F.when(F.col("parent") >= 0, F.element_at(F.split("path_names", "/"), -2))
        rows = scan.elements.select("doc_id", "elem_id", "parent", "name", "text", parent_name.alias("parent_name"))
        self.rows = rows.where(F.col("elem_id") < SAMPLE_ELEMENTS) if sampled else rows

    def elements(self) -> DataFrame:
        """name, count, has_text, text_type, parents (sorted)."""
        kind = F.when(F.col("text") != "", guess_type_column(F.col("text")))
        counted = [F.count("*").alias("count"), F.array_sort(F.collect_set("parent_name")).alias("parents")]
        typed = merge_types_column(F.collect_set(kind)).alias("text_type")
        if self.sampled:
            out = self.rows.groupBy("name").agg(*counted).join(_first(self.rows, ["name"], SAMPLE_INSTANCES).groupBy("name").agg(typed), "name", "left")
        else:
            out = self.rows.groupBy("name").agg(*counted, typed)
        return out.select("name", "count", F.col("text_type").isNotNull().alias("has_text"), F.coalesce("text_type", F.lit("xs:string")).alias("text_type"), "parents")

    def children(self) -> DataFrame:
        """parent, child, ord (first seen), min and max occurrences over the parent's instances, absent ones included."""
        seen = ["parent_name", "name"]
        if self.sampled:
            instances = _first(self.rows.select("doc_id", "elem_id", "name"), ["name"], SAMPLE_PARENTS)
            rows = self.rows.join(instances.select("doc_id", F.col("elem_id").alias("parent")), ["doc_id", "parent"], "left_semi")
            size = instances.groupBy(F.col("name").alias("parent_name")).agg(F.count("*").alias("instances"))
        else:
            rows = self.rows
        each = rows.groupBy(*seen, "doc_id", "parent").agg(F.count("*").alias("n"), F.min("elem_id").alias("first"))
        pair = each.groupBy(*seen).agg(F.count("*").alias("with"), F.min("n").alias("least"), F.max("n").alias("max"), F.min(F.struct("doc_id", "first")).alias("seen"), F.sum("n").alias("__n"))
        if self.sampled:
            out = pair.join(size, "parent_name")
        else:
            # a pair counts among its parent's children and as instances of its own name: both meet under that name
            roles = F.array(F.struct(F.col("parent_name").alias("of"), F.lit(0).alias("own")), F.struct(F.col("name").alias("of"), F.col("__n").alias("own")))
            met = pair.withColumn("__role", F.explode(roles)).withColumns({"__of": F.col("__role.of"), "__own": F.col("__role.own")})
            out = met.withColumn("instances", F.sum("__own").over(Window.partitionBy("__of"))).where("__own = 0 and parent_name is not null")
        order = F.row_number().over(Window.partitionBy("parent_name").orderBy("seen", "name"))
        return out.withColumn("ord", order).select(F.col("parent_name").alias("parent"), F.col("name").alias("child"), F.col("ord").cast("long").alias("ord"), F.when(F.col("with") < F.col("instances"), 0).otherwise(F.col("least")).cast("long").alias("min"), F.col("max").cast("long").alias("max"))

    def attribute_types(self) -> DataFrame:
        """element, attr, count, type, required, ord (first seen)."""
        tagged = self.scan.tagged.select("doc_id", "elem_id", F.col("name").alias("element"), "attrs")
        looked = _first(tagged.where(F.col("elem_id") < SAMPLE_ELEMENTS), ["element"], SAMPLE_INSTANCES) if self.sampled else tagged
        # of attributes that repeat in an element the first counts; every element adds a row without attribute, to be counted itself
        own = F.transform("attrs", lambda a, i: F.struct(a["name"].alias("attr"), a["value"].alias("value"), i.alias("no")))
        once = F.filter(own, lambda a: F.array_position(F.col("attrs")["name"], a["attr"]) == a["no"] + 1)
        itself = F.array(F.struct(F.lit(None).cast("string").alias("attr"), F.lit(None).cast("string").alias("value"), F.lit(-1).alias("no")))
        dealt = looked.select("doc_id", "elem_id", "element", F.inline(F.concat(once, itself)))
        out = dealt.groupBy("element", "attr").agg(F.count("*").alias("count"), merge_types_column(F.collect_set(guess_type_column(F.col("value")))).alias("type"), F.min(F.struct("doc_id", "elem_id", "no")).alias("seen"))
        instances = F.max(F.when(F.col("attr").isNull(), F.col("count"))).over(Window.partitionBy("element"))
        out = out.withColumn("instances", instances).where("attr is not null")
        order = F.row_number().over(Window.partitionBy("element").orderBy("seen"))
        return out.withColumn("ord", order).select("element", "attr", "count", "type", (F.col("count") == F.col("instances")).alias("required"), F.col("ord").cast("long").alias("ord"))

    def roots(self) -> DataFrame:
        return self.elements().where(F.size("parents") == 0).select("name")

    def occurrences(self) -> DataFrame:
        """Children with their bounds as shown: 0..1, 1..∞."""
        high = F.when(F.col("max") > UNBOUNDED_ABOVE, "∞").otherwise(F.col("max").cast("string"))
        return self.children().withColumn("occurs", F.concat(F.col("min").cast("string"), F.lit(".."), high))

    def xsd(self, target_namespace: str | None = None) -> str:
        """The XSD text. The components of a schema are few; more than MAX_COMPONENTS are refused."""
        collect = lambda df, *order: df.orderBy(*order).limit(MAX_COMPONENTS + 1).collect()
        elements = {r["name"]: r for r in collect(self.elements(), "name")}
        if len(elements) > MAX_COMPONENTS:
            raise ValueError(f"more than {MAX_COMPONENTS} element names")
        children: dict[str, list] = {}
        for r in collect(self.children(), "parent", "ord"):
            children.setdefault(r["parent"], []).append(r)
        attributes: dict[str, list] = {}
        for r in collect(self.attribute_types(), "element", "ord"):
            attributes.setdefault(r["element"], []).append(r)
        return render_xsd(elements, children, attributes, target_namespace)


def _bounds(low: int, high: int) -> str:
    return ("" if low == 1 else f' minOccurs="{low}"') + ("" if high == 1 else f' maxOccurs="{"unbounded" if high > UNBOUNDED_ABOVE else high}"')


def render_xsd(elements: dict, children: dict[str, list], attributes: dict[str, list], target_namespace: str | None = None) -> str:
    """Global components: roots first, then every other element with children or attributes; plain leaves inline."""
    last = lambda name: name.rpartition(":")[2]
    simple = lambda name: name not in children and name not in attributes
    kind = lambda e: e["text_type"] if e["has_text"] else "xs:string"
    target = ""
    if target_namespace:
        uri = escape_xml(target_namespace)
        target = f' targetNamespace="{uri}" xmlns="{uri}" elementFormDefault="qualified"'
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"{target}>']

    def attribute_lines(name: str, indent: str) -> list[str]:
        return [f'{indent}<xs:attribute name="{a["attr"]}" type="{a["type"]}"{" use=" + chr(34) + "required" + chr(34) if a["required"] else ""}/>' for a in attributes.get(name, [])]

    def component(name: str) -> None:
        e, local = elements[name], last(name)
        if simple(name):
            out.append(f'  <xs:element name="{local}" type="{kind(e)}"/>')
            return
        leaf = e["has_text"] and name not in children
        out.extend([f'  <xs:element name="{local}">', f"    <xs:complexType{'' if leaf or not e['has_text'] else ' mixed=' + chr(34) + 'true' + chr(34)}>"])
        if leaf:
            out.append(f'      <xs:simpleContent><xs:extension base="{e["text_type"]}">')
            out.extend(attribute_lines(name, " " * 8))
            out.append("      </xs:extension></xs:simpleContent>")
        else:
            if name in children:
                out.append("      <xs:sequence>")
                for c in children[name]:
                    what = f'name="{last(c["child"])}" type="{kind(elements[c["child"]])}"' if simple(c["child"]) else f'ref="{last(c["child"])}"'
                    out.append(f"        <xs:element {what}{_bounds(c['min'], c['max'])}/>")
                out.append("      </xs:sequence>")
            out.extend(attribute_lines(name, " " * 6))
        out.extend(["    </xs:complexType>", "  </xs:element>"])

    first = [n for n, e in elements.items() if not e["parents"]]
    for name in first + [n for n in elements if n not in first and not simple(n)]:
        component(name)
    return "\n".join([*out, "</xs:schema>", ""])
