"""Sinks: node tables back to text, pretty, compact or canonical.

Each node gives an opening fragment at its pre-order place and elements a closing one after their last descendant; fragments are gathered
by document in order and joined. No recursion and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements deeper than this are left out, as their ancestors' content.
MAX_DEPTH = 512


@dataclass(frozen=True)
class SerializeOptions:
    pretty_print: bool = True
    indent_step: int = 2
    omit_xml_declaration: bool = False
    quote_char: str = '"'
    self_close_empty: bool = True


def _replace(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_text(c: Column) -> Column:
    return _replace(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def escape_attribute(c: Column, quote: str = '"') -> Column:
    return _replace(escape_text(c), ((quote, "&quot;" if quote == '"' else "&apos;"),))


def canonical_text(c: Column) -> Column:
    return _replace(escape_text(c), (("\r", "&#xD;"),))


def canonical_attribute(c: Column) -> Column:
    return _replace(c, (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")))


def _joined(fragments: DataFrame, name: str) -> DataFrame:
    """(doc_id, text) of (doc_id, pre, last, back, text): by place, openings before closings, inner closings first."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "back", "text")))
    return fragments.groupBy("doc_id").agg(F.array_join(ordered["text"], "").alias(name))


def _pieces(rows: DataFrame, opening: Column, closing: Column) -> DataFrame:
    """An opening at ``pre``; a closing after ``end``, that of the deepest element first."""
    both = F.array(
        F.struct(F.col("pre").alias("place"), F.lit(-(2**31)).alias("back"), opening.alias("text")),
        F.struct(F.col("end").alias("place"), (-F.col("depth")).alias("back"), closing.alias("text")),
    )
    return rows.select("doc_id", F.explode(F.filter(both, lambda p: p["text"].isNotNull() & (p["text"] != ""))).alias("p")).select("doc_id", "p.*")


def to_xml_text(nodes: DataFrame, options: SerializeOptions = SerializeOptions(), name: str = "xml") -> DataFrame:
    """(doc_id, xml): declaration, prolog and root of each document. DOCTYPE and detached nodes are not written.

    Pretty printing keeps elements with text alone on one line, and puts any other child on a line of its own.
    """
    linked = nodes.filter(F.col("pre").isNotNull())
    kids = linked.filter("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"), F.sum((~F.col("kind").isin("text", "cdata")).cast("int")).alias("other"))
    rows = linked.filter(F.col("depth") <= MAX_DEPTH + 1).join(kids, ["doc_id", "node_id"], "left").withColumns({"kids": F.coalesce("kids", F.lit(0)), "other": F.coalesce("other", F.lit(0))})
    parents = rows.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), ((F.col("kind") == "element") & (F.col("other") == 0)).alias("inline"))
    rows = rows.join(parents, (F.col("doc_id") == F.col("_d")) & (F.col("parent_id") == F.col("_n")), "left").withColumn("inline", F.coalesce("inline", F.lit(False)))
    q = options.quote_char
    line = F.lit("\n" if options.pretty_print else "")
    pad = F.when(F.col("inline"), "").otherwise(F.repeat(F.lit(" "), (F.col("depth") - 1) * options.indent_step)) if options.pretty_print else F.lit("")
    newline = F.when(F.col("inline"), "").otherwise(line)
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.lit("=" + q), escape_attribute(a["value"], q), F.lit(q))), "")
    head = F.concat(F.lit("<"), F.col("name"), attrs)
    void = F.concat(head, F.lit("/>")) if options.self_close_empty else F.concat(head, F.lit("></"), F.col("name"), F.lit(">"))
    quoted = lambda label, v: F.concat(F.lit(f" {label}={q}"), v, F.lit(q))
    decl = F.concat(F.lit("<?xml"), quoted("version", F.col("decl.version")), F.coalesce(quoted("encoding", F.col("decl.encoding")), F.lit("")), F.coalesce(quoted("standalone", F.when(F.col("decl.standalone"), "yes").otherwise(F.when(~F.col("decl.standalone"), "no"))), F.lit("")), F.lit("?>\n"))
    kind = F.col("kind")
    data = F.when(F.col("value") == "", "").otherwise(F.concat(F.lit(" "), F.col("value")))
    opening = (
        F.when(kind == "element", F.when(F.col("kids") == 0, F.concat(pad, void, newline)).otherwise(F.concat(pad, head, F.lit(">"), F.when(F.col("other") > 0, line).otherwise(""))))
        .when(kind == "text", F.concat(pad, escape_text(F.col("value")), newline)).when(kind == "cdata", F.concat(pad, F.lit("<![CDATA["), F.col("value"), F.lit("]]>"), newline))
        .when(kind == "comment", F.concat(pad, F.lit("<!--"), F.col("value"), F.lit("-->"), newline)).when(kind == "pi", F.concat(pad, F.lit("<?"), F.col("name"), data, F.lit("?>"), newline))
        .when(kind == "declaration", decl if not options.omit_xml_declaration else F.lit(None).cast("string"))
    )
    closing = F.when((kind == "element") & (F.col("kids") > 0), F.concat(F.when(F.col("other") > 0, pad).otherwise(""), F.lit("</"), F.col("name"), F.lit(">"), newline))
    return _joined(_pieces(rows, opening, closing), name)


def canonicalize(nodes: DataFrame, with_comments: bool = False, name: str = "c14n") -> DataFrame:
    """(doc_id, c14n) of the root element: namespace declarations first, then attributes by name; no self-closing tags, CDATA as text."""
    root = nodes.filter("parent_id = 1 and kind = 'element'").groupBy(F.col("doc_id").alias("_d")).agg(F.min("pre").alias("_from"), F.min_by("end", "pre").alias("_to"))
    rows = nodes.filter(F.col("pre").isNotNull() & (F.col("depth") <= MAX_DEPTH + 1)).join(root, (F.col("doc_id") == F.col("_d")) & (F.col("pre") >= F.col("_from")) & (F.col("pre") <= F.col("_to")))
    order = F.transform("attrs", lambda a: F.struct((~F.startswith(a["name"], F.lit("xmlns"))).alias("late"), a["name"].alias("name"), a["value"].alias("value")))
    attrs = F.array_join(F.transform(F.array_sort(order), lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), canonical_attribute(a["value"]), F.lit('"'))), "")
    kind = F.col("kind")
    data = F.when(F.col("value") == "", "").otherwise(F.concat(F.lit(" "), F.col("value")))
    opening = F.when(kind == "element", F.concat(F.lit("<"), F.col("name"), attrs, F.lit(">"))).when(kind.isin("text", "cdata"), canonical_text(F.col("value"))).when(kind == "pi", F.concat(F.lit("<?"), F.col("name"), data, F.lit("?>")))
    if with_comments:
        opening = opening.when(kind == "comment", F.concat(F.lit("<!--"), F.col("value"), F.lit("-->")))
    closing = F.when(kind == "element", F.concat(F.lit("</"), F.col("name"), F.lit(">")))
    return _joined(_pieces(rows, opening, closing), name)


def write_xml(nodes: DataFrame, path: str, options: SerializeOptions = SerializeOptions()) -> None:
    """One text per document, written as Spark's text files (compact: one line each if texts hold no line ends)."""
    to_xml_text(nodes, options).select("xml").write.text(path)
