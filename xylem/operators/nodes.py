"""Navigation over the node table: lookups, siblings, text, names and namespaces as filters, joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The predefined prefixes.
XML_URI = "http://www.w3.org/XML/1998/namespace"
XMLNS_URI = "http://www.w3.org/2000/xmlns/"


def attribute(attrs: Column, name: str) -> Column:
    """The value of the first attribute of that name, or null."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(1))["value"]


def has_attribute(attrs: Column, name: str) -> Column:
    return F.coalesce(F.exists(attrs, lambda a: a["name"] == name), F.lit(False))


def prefix(name: Column) -> Column:
    """Before the first colon, or null."""
    return F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1))


def local_name(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(":")), F.substring(name, F.instr(name, ":") + 1, F.length(name))).otherwise(name)


def get_node(nodes: DataFrame, doc_id, node_id: int) -> DataFrame:
    return nodes.filter((F.col("doc_id") == doc_id) & (F.col("node_id") == node_id))


def root_elements(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, name): the first element under each root."""
    top = nodes.filter("parent_id = 1 and kind = 'element'")
    return top.groupBy("doc_id").agg(F.min_by("node_id", "ord").alias("node_id"), F.min_by("name", "ord").alias("name"))


def children(nodes: DataFrame, parents: DataFrame, elements_only: bool = False) -> DataFrame:
    """The children of (doc_id, node_id), each with ``of``; order them by ``ord``."""
    found = nodes.join(parents.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"])
    return found.filter("kind = 'element'") if elements_only else found


def first_and_last_child(nodes: DataFrame, elements_only: bool = False) -> DataFrame:
    """(doc_id, node_id, first_child, last_child) of each node with children."""
    kids = nodes.filter("parent_id is not null")
    kids = kids.filter("kind = 'element'") if elements_only else kids
    return kids.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", "ord").alias("first_child"), F.max_by("node_id", "ord").alias("last_child")).select("doc_id", "node_id", "first_child", "last_child")


def siblings(nodes: DataFrame) -> DataFrame:
    """The nodes with ``previous_sibling`` and ``next_sibling``."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("ord")
    linked = F.col("parent_id").isNotNull()
    return nodes.withColumns({"previous_sibling": F.when(linked, F.lag("node_id").over(w)), "next_sibling": F.when(linked, F.lead("node_id").over(w))})


def text_content(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, node_id, text) for (doc_id, node_id): the text nodes, CDATA left out, under elements in document order; '' for leaf nodes that are no text."""
    asked = nodes.join(of.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"]).select("doc_id", "node_id", "pre", "end", "kind", "value")
    texts = nodes.filter("kind = 'text' and pre is not null").select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("value").alias("_v"))
    joined = asked.join(texts, (F.col("doc_id") == F.col("_d")) & (F.col("_p") >= F.col("pre")) & (F.col("_p") <= F.col("end")), "left")
    return joined.groupBy("doc_id", "node_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "_v"))))["_v"], "").alias("text"))


def elements_by_tag(nodes: DataFrame, name: str) -> DataFrame:
    """Elements of a literal name, or all for ``*``."""
    elements = nodes.filter("kind = 'element'")
    return elements if name == "*" else elements.filter(F.col("name") == name)


def element_by_id(nodes: DataFrame, value: str) -> DataFrame:
    """(doc_id, node_id): the first element whose ``id`` is ``value``."""
    return nodes.filter((F.col("kind") == "element") & (attribute(F.col("attrs"), "id") == value)).groupBy("doc_id").agg(F.min("node_id").alias("node_id"))


def attributes(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, pos, name, value)."""
    return nodes.filter("kind = 'element'").select("doc_id", "node_id", F.posexplode("attrs").alias("pos", "a")).select("doc_id", "node_id", "pos", "a.name", "a.value")


def declarations(nodes: DataFrame) -> DataFrame:
    """(d, dp, de, pos, p, uri): namespace declarations with the interval they hold for; p is '' for the default one."""
    some = nodes.filter((F.col("kind") == "element") & F.exists("attrs", lambda a: F.startswith(a["name"], F.lit("xmlns"))))
    rows = some.select(F.col("doc_id").alias("d"), F.col("pre").alias("dp"), F.col("end").alias("de"), F.posexplode("attrs").alias("pos", "a"))
    rows = rows.filter((F.col("a.name") == "xmlns") | F.startswith(F.col("a.name"), F.lit("xmlns:")))
    return rows.select("d", "dp", "de", "pos", F.when(F.col("a.name") == "xmlns", "").otherwise(F.substring("a.name", 7, 2**31 - 1)).alias("p"), F.col("a.value").alias("uri"))


def with_namespace(nodes: DataFrame, rows: DataFrame, prefix: Column) -> DataFrame:
    """``rows`` (doc_id, pre, ...) with ``ns_uri`` of a prefix (null: the default namespace): the nearest declaration at or above; an empty one is none."""
    keyed = rows.withColumn("_p", F.coalesce(prefix, F.lit("")))
    near = keyed.select("doc_id", "pre", "_p").distinct().join(declarations(nodes), (F.col("doc_id") == F.col("d")) & (F.col("_p") == F.col("p")) & (F.col("dp") <= F.col("pre")) & (F.col("pre") <= F.col("de")))
    found = near.groupBy("doc_id", "pre", "_p").agg(F.max_by("uri", "dp").alias("_uri"))
    fixed = F.when(F.col("_p") == "xml", XML_URI).when(F.col("_p") == "xmlns", XMLNS_URI)
    return keyed.join(found, ["doc_id", "pre", "_p"], "left").withColumn("ns_uri", F.coalesce(fixed, F.nullif(F.col("_uri"), F.lit("")))).drop("_p", "_uri")


def namespace_uris(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, name, prefix, local_name, ns_uri) of each element."""
    rows = nodes.filter("kind = 'element'").select("doc_id", "node_id", "pre", "name")
    return with_namespace(nodes, rows, prefix(F.col("name"))).select("doc_id", "node_id", "name", prefix(F.col("name")).alias("prefix"), local_name(F.col("name")).alias("local_name"), "ns_uri")


def lookup_prefix(nodes: DataFrame, uri: str) -> DataFrame:
    """(doc_id, node_id, prefix): the nearest prefix that is declared as ``uri`` at or above each element, the first of an element."""
    rows = nodes.filter("kind = 'element'").select("doc_id", "node_id", "pre")
    near = rows.join(declarations(nodes).filter(F.col("uri") == uri), (F.col("doc_id") == F.col("d")) & (F.col("dp") <= F.col("pre")) & (F.col("pre") <= F.col("de")))
    return near.groupBy("doc_id", "node_id").agg(F.max_by("p", F.struct("dp", -F.col("pos"))).alias("prefix"))


def elements_by_tag_ns(nodes: DataFrame, uri: str, local: str) -> DataFrame:
    """Elements by namespace and local name; ``*`` is any, '' no namespace."""
    rows = namespace_uris(nodes)
    if uri != "*":
        rows = rows.filter(F.col("ns_uri").isNull() if uri == "" else F.col("ns_uri") == uri)
    return rows if local == "*" else rows.filter(F.col("local_name") == local)


def namespaces_in_scope(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, namespaces): name and value of each prefix in scope of each element."""
    rows = nodes.filter("kind = 'element'").select("doc_id", "node_id", "pre")
    near = rows.join(declarations(nodes), (F.col("doc_id") == F.col("d")) & (F.col("dp") <= F.col("pre")) & (F.col("pre") <= F.col("de")))
    last = near.groupBy("doc_id", "node_id", "p").agg(F.max_by("uri", "dp").alias("uri")).filter("uri <> ''")
    own = last.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct(F.col("p").alias("name"), F.col("uri").alias("value")))).alias("_n"))
    xml = F.array(F.struct(F.lit("xml").alias("name"), F.lit(XML_URI).alias("value")))
    return rows.join(own, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.when(F.col("_n").isNull(), xml).otherwise(F.concat("_n", xml)).alias("namespaces"))


def kind_counts(nodes: DataFrame) -> DataFrame:
    """(kind, n) over all documents."""
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))
