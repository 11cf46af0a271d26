"""Record binding: typed columns from documents, and documents from typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import never_broadcast
from . import nodes as nav


def scalar(text: Column, kind: T.DataType) -> Column:
    """A text as a scalar: strings as they are, the others trimmed; null where it can't be read."""
    if isinstance(kind, T.StringType):
        return text
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    if isinstance(kind, T.BooleanType):
        return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)
    if isinstance(kind, T.BinaryType):
        return F.encode(text, "UTF-8")
    good = r"^[+-]?[0-9]+$" if isinstance(kind, T.IntegralType) else r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|(?i)^[+-]?(?:inf(?:inity)?|nan)$"
    return F.when(t.rlike(good), t.try_cast(kind))


class _Binder:
    def __init__(self, nodes: DataFrame):
        nodes = never_broadcast(nodes)
        self.elements = nodes.filter("kind = 'element' and pre is not null").select("doc_id", "node_id", "parent_id", "ord", "name", "attrs")
        self.texts = nodes.filter("kind = 'text' and parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "value")))["value"], "").alias("_t"))

    def values(self, at: DataFrame, kind: T.DataType, out: str) -> DataFrame:
        """``at`` (doc_id, node_id) with a column of the value of each element as ``kind``."""
        if isinstance(kind, T.StructType):
            return self.struct(at, kind, out)
        if isinstance(kind, T.ArrayType):
            kids = self.elements.join(at.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"]).select("doc_id", "node_id", "parent_id", "ord")
            inner = self.values(kids, kind.elementType, "_item")
            rows = inner.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "_item")))["_item"].alias(out))
            return at.join(never_broadcast(rows), ["doc_id", "node_id"], "left").withColumn(out, F.coalesce(out, F.array().cast(kind)))
        if isinstance(kind, T.MapType):
            kids = self.elements.join(at.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"]).select("doc_id", "node_id", "parent_id", "ord", "name")
            inner = self.values(kids, kind.valueType, "_item")
            last = inner.groupBy("doc_id", "parent_id", "name").agg(F.max_by("_item", "ord").alias("_item"))
            rows = last.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("name"), F.col("_item")))).alias(out))
            return at.join(never_broadcast(rows), ["doc_id", "node_id"], "left")
        return at.join(self.texts, ["doc_id", "node_id"], "left").withColumn(out, scalar(F.coalesce("_t", F.lit("")), kind)).drop("_t")

    def struct(self, at: DataFrame, kind: T.StructType, out: str) -> DataFrame:
        """Fields: an attribute of that name, else the first child element of that name."""
        own = self.elements.select("doc_id", "node_id", F.col("attrs").alias("_attrs"))
        rows = at.join(own, ["doc_id", "node_id"])
        plain = [(f"{out}_{i}", f) for i, f in enumerate(kind) if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        if plain:  # the texts of all scalar fields in one pass
            kids = self.elements.filter(F.col("name").isin([f.name for _, f in plain])).join(at.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"])
            kids = kids.select("doc_id", "node_id", "parent_id", "ord", "name").join(self.texts, ["doc_id", "node_id"], "left")
            first = [F.min_by(F.when(F.col("name") == f.name, F.coalesce("_t", F.lit(""))), F.when(F.col("name") == f.name, F.col("ord"))).alias(name) for name, f in plain]
            rows = rows.join(never_broadcast(kids.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(*first)), ["doc_id", "node_id"], "left")
        made = []
        for i, f in enumerate(kind):
            name = f"{out}_{i}"
            if (name, f) in plain:
                made.append(F.coalesce(scalar(nav.attribute(F.col("_attrs"), f.name), f.dataType), scalar(F.col(name), f.dataType)).alias(f.name))
                continue
            kids = self.elements.filter(F.col("name") == f.name).join(at.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"])
            kids = kids.groupBy("doc_id", "parent_id").agg(F.min_by("node_id", "ord").alias("node_id"))
            found = self.values(kids, f.dataType, name).select("doc_id", F.col("parent_id").alias("node_id"), name)
            rows = rows.join(never_broadcast(found), ["doc_id", "node_id"], "left")
            made.append(F.col(name).alias(f.name))
        return rows.withColumn(out, F.struct(*made)).select(*at.columns, out)


def from_nodes(nodes: DataFrame, schema: T.StructType | str, elements: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, record): the root element of each document, or the given (doc_id, node_id), bound to a schema.

    Arrays are the child elements of the field's element, whatever their names; repeated siblings do not collect. What is missing or can't be read is null.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    at = elements if elements is not None else nav.root_elements(nodes).select("doc_id", "node_id")
    return _Binder(nodes).values(at.select("doc_id", "node_id"), kind, "record")


def escape(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def content(c: Column, kind: T.DataType) -> Column:
    """The inside of the element of a value: structs by field, arrays as ``<item>``, maps by key, null as nothing."""
    if isinstance(kind, T.StructType):
        out = F.concat(F.lit(""), *[F.concat(F.lit(f"<{f.name}>"), content(c[f.name], f.dataType), F.lit(f"</{f.name}>")) for f in kind])
    elif isinstance(kind, T.ArrayType):
        out = F.array_join(F.transform(c, lambda x: F.concat(F.lit("<item>"), content(x, kind.elementType), F.lit("</item>"))), "")
    elif isinstance(kind, T.MapType):
        out = F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(F.lit("<"), e["key"].cast("string"), F.lit(">"), content(e["value"], kind.valueType), F.lit("</"), e["key"].cast("string"), F.lit(">"))), "")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        from ..functions.coerce import number_to_text

        out = number_to_text(c)
    elif isinstance(kind, T.BinaryType):
        out = escape(F.decode(c, "UTF-8"))
    else:
        out = escape(c.cast("string"))
    return F.coalesce(out, F.lit(""))


def to_xml_record(df: DataFrame, columns: list[str] | None = None, root: str = "root", name: str = "xml") -> DataFrame:
    """``df`` with a column of the columns (all of them) as one document under ``root``. Expressions only."""
    fields = [df.schema[c] for c in columns or df.columns]
    body = F.concat(F.lit(f"<{root}>"), *[F.concat(F.lit(f"<{f.name}>"), content(F.col(f.name), f.dataType), F.lit(f"</{f.name}>")) for f in fields], F.lit(f"</{root}>"))
    return df.withColumn(name, body)
