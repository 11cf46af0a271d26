"""Documents made from relational tables, and their parsed nodes: the inputs of the registered queries.

All of it is DataFrame expressions over whole tables. Parsed nodes are written once in a session and read by every query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.serialize import escape_attribute, escape_text
from ..session import table
from ..sources.store import save_nodes
from ..sources.xml import nodes_of, parse_xml

_parsed: dict[tuple, DataFrame] = {}


def element(name: str, inner: Column, **attrs: Column) -> Column:
    pairs = [F.concat(F.lit(f' {k}="'), escape_attribute(v.cast("string")), F.lit('"')) for k, v in attrs.items()]
    return F.concat(F.lit(f"<{name}"), *pairs, F.lit(">"), inner, F.lit(f"</{name}>"))


def text(c: Column) -> Column:
    return escape_text(c.cast("string"))


def joined(order: list[str], piece: str) -> Column:
    """The pieces of a group, by the order columns."""
    return F.array_join(F.array_sort(F.collect_list(F.struct(*order, piece)))[piece], "")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def orders_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): a document for each order with its lines."""
    line = element("line", F.concat(element("qty", text(F.col("l_quantity").cast("bigint"))), element("cents", text(cents("l_extendedprice")))), n=F.col("l_linenumber"), flag=F.col("l_returnflag"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("x"))
    lines = lines.groupBy("l_orderkey").agg(joined(["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "x").alias("lines"))
    both = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select(F.col("o_orderkey").alias("doc_id"), element("order", element("lines", F.coalesce("lines", F.lit(""))), id=F.col("o_orderkey"), status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")).alias("xml"))


def catalog_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): a document for each brand with its parts, a comment before and an instruction after them."""
    part = element("part", F.concat(element("name", text(F.col("p_name"))), element("size", text(F.col("p_size"))), element("cents", text(cents("p_retailprice")))), id=F.col("p_partkey"), type=F.col("p_type"))
    parts = table(spark, sf_dir, "part").select(brand().alias("doc_id"), "p_brand", "p_partkey", part.alias("x"))
    return parts.groupBy("doc_id", "p_brand").agg(joined(["p_partkey"], "x").alias("parts")).select("doc_id", element("catalog", F.concat(F.lit("<!--parts-->"), "parts", F.lit("<?end of?>")), brand=F.col("p_brand")).alias("xml"))


def brand() -> Column:
    return F.regexp_extract("p_brand", r"#(\d+)", 1).cast("bigint")


def geo_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): a document for each region, with namespaces and languages; French below nations of even keys."""
    customer = element("x:customer", element("bal", text(cents("c_acctbal"))), id=F.concat(F.lit("c"), "c_custkey"), seg=F.col("c_mktsegment"))
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", customer.alias("x")).groupBy("c_nationkey").agg(joined(["c_custkey"], "x").alias("cs"))
    even = F.col("n_nationkey") % 2 == 0
    nation = F.concat(
        F.lit('<nation id="n'), F.col("n_nationkey").cast("string"), F.lit('" name="'), escape_attribute(F.col("n_name")), F.lit('"'), F.when(even, ' xml:lang="fr-FR"').otherwise(""), F.lit(">"), F.coalesce("cs", F.lit("")), F.lit("</nation>"),
    )
    nations = table(spark, sf_dir, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_regionkey", "n_nationkey", nation.alias("x")).groupBy("n_regionkey").agg(joined(["n_nationkey"], "x").alias("ns"))
    regions = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    head = F.concat(F.lit('<geo xmlns="urn:geo" xmlns:x="urn:x" xml:lang="en"><region id="r'), F.col("r_regionkey").cast("string"), F.lit('" name="'), escape_attribute(F.col("r_name")), F.lit('">'))
    return regions.select(F.col("r_regionkey").cast("bigint").alias("doc_id"), F.concat(head, F.coalesce("ns", F.lit("")), F.lit("</region></geo>")).alias("xml"))


def rules_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): a document for each part that breaks rules in ways that depend on its columns."""
    key, size = F.col("p_partkey"), F.col("p_size")
    body = F.concat(
        F.when(size % 3 != 0, element("name", text(F.col("p_name")))).otherwise(""), element("size", F.when(size % 7 == 0, "many").otherwise(text(size))),
        F.when(size % 5 == 0, "<tag>new</tag><tag>old</tag><tag>odd</tag>").otherwise("<tag>new</tag>"), F.when(size % 4 == 0, "<void>full</void>").otherwise("<void/>"),
        element("flag", F.when(size % 6 == 0, "yes").otherwise("true")), F.when(size % 9 == 0, "<fax/>").otherwise("<mail/>"),
        element("ref", F.lit(""), to=F.when(size % 8 == 0, "nowhere").otherwise(F.concat(F.lit("i"), key))), F.when(size % 10 == 0, element("twin", F.lit(""), id=F.concat(F.lit("i"), key))).otherwise(""),
    )
    kind = F.when(size % 11 == 0, F.lit("")).otherwise(F.concat(F.lit(' kind="'), escape_attribute(F.col("p_type")), F.lit('"')))
    return table(spark, sf_dir, "part").select(key.alias("doc_id"), F.concat(F.lit('<part id="i'), key.cast("string"), F.lit('"'), kind, F.lit(">"), body, F.lit("</part>")).alias("xml"))


MAKERS = {"orders": orders_xml, "catalog": catalog_xml, "geo": geo_xml, "rules": rules_xml}


def saved(docs: DataFrame) -> DataFrame:
    """The nodes of documents, parsed and written once."""
    return save_nodes(nodes_of(parse_xml(docs)), docs.sparkSession.sparkContext.defaultParallelism)


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The nodes of a corpus, parsed once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _parsed:
        _parsed[key] = saved(MAKERS[name](spark, sf_dir))
    return _parsed[key]
