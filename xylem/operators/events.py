"""Pull events: a tokenizer in DataFrame functions, one row for each event, without checks of well-formedness and without entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.xml import unix_lines

# Contiguous: it stops at markup that is never closed.
TOKEN = r"(?s)\G(?:<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<[^>]*>|[^<]+)"
ATTRIBUTE = r"\G\s*([^=]*?)\s*=\s*(\"[^\"]*\"|'[^']*')"
UNCLOSED = "Unclosed XML markup or tag at EOF"


def raw_attributes(raw: Column) -> Column:
    """array of (name, value) of an attribute text; it stops at the first malformed one."""
    pairs = F.arrays_zip(F.regexp_extract_all(raw, F.lit(ATTRIBUTE), F.lit(1)).alias("name"), F.regexp_extract_all(raw, F.lit(ATTRIBUTE), F.lit(2)).alias("value"))
    return F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), F.substring(p["value"], F.lit(2), F.length(p["value"]) - 2).alias("value")))


def declared(token: Column, name: str) -> Column:
    """The value of a pseudo-attribute of a declaration, or null."""
    return F.nullif(F.regexp_extract(token, rf"(?s)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 1), F.lit(""))


def pull_events(df: DataFrame, xml: str = "xml", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, pos, event, name, attr_raw, text, target, data, version, encoding, standalone, error).

    Events: StartDocument-less Declaration, DocType, StartElement, EndElement, Text, CData, Comment, ProcessingInstruction and, where markup is not
    closed at the end, Error. ``<a/>`` gives a start and an end. A null or empty document has no events. One projection, no shuffle.
    """
    text = unix_lines(F.col(xml).cast("string"))
    rows = df.select(F.col(doc_id).alias("doc_id"), text.alias("_x"))
    rows = rows.select("doc_id", "_x", F.regexp_extract_all("_x", F.lit(TOKEN), F.lit(0)).alias("_t"))
    used = F.aggregate("_t", F.lit(0), lambda a, t: a + F.length(t))
    marked = F.when(used < F.length("_x"), F.concat("_t", F.array(F.lit("<!")))).otherwise(F.col("_t"))
    rows = rows.select("doc_id", F.posexplode(marked).alias("_p", "t"))
    t = F.col("t")
    starts = lambda s: F.startswith(t, F.lit(s))
    ends = lambda s: F.endswith(t, F.lit(s))
    kind = (
        F.when(t == "<!", "Error").when(~starts("<"), "Text").when(starts("<!--") & ends("-->") & (F.length(t) >= 7), "Comment")
        .when(starts("<![CDATA[") & ends("]]>"), "CData").when(starts("<?xml") & ends("?>"), "Declaration").when(starts("<?") & ends("?>"), "ProcessingInstruction")
        .when(starts("<!DOCTYPE"), "DocType").when(starts("</"), "EndElement").otherwise("StartElement")
    )
    # A self-closing tag is a start and an end.
    rows = rows.withColumn("k", kind).withColumn("event", F.explode(F.when((F.col("k") == "StartElement") & ends("/>"), F.array(F.lit("StartElement"), F.lit("EndElement"))).otherwise(F.array("k"))))
    e = F.col("event")
    inner = F.substring(t, F.lit(2), F.length(t) - F.when(ends("/>"), 3).otherwise(2))
    tag = F.regexp_extract(inner, r"(?s)^\s*(\S*)", 1)
    name = (
        F.when((e == "EndElement") & starts("</"), F.trim(F.regexp_replace(F.substring(t, F.lit(3), F.length(t) - 3), r"(?U)^\s+|\s+$", "")))
        .when(e.isin("StartElement", "EndElement"), tag).when(e == "DocType", F.regexp_extract(t, r"(?s)^<!DOCTYPE\s*([^\s>\[]*)", 1))
    )
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    body = F.substring(t, F.lit(3), F.length(t) - 4)
    return rows.select(
        "doc_id", (F.col("_p") * 2 + F.when((e == "EndElement") & ~starts("</"), 1).otherwise(0)).alias("pos"), "event", name.alias("name"),
        F.when(e == "StartElement", trimmed(F.regexp_replace(inner, r"(?s)^\s*\S*", ""))).alias("attr_raw"),
        F.when(e == "Text", t).when(e == "Comment", F.substring(t, F.lit(5), F.length(t) - 7)).when(e == "CData", F.substring(t, F.lit(10), F.length(t) - 12)).alias("text"),
        F.when(e == "ProcessingInstruction", F.regexp_extract(body, r"(?s)^(\S*)", 1)).alias("target"),
        F.when(e == "ProcessingInstruction", trimmed(F.regexp_replace(body, r"(?s)^\S*", ""))).alias("data"),
        F.when(e == "Declaration", F.coalesce(declared(t, "version"), F.lit("1.0"))).alias("version"), F.when(e == "Declaration", declared(t, "encoding")).alias("encoding"),
        F.when(e == "Declaration", declared(t, "standalone")).alias("standalone"), F.when(e == "Error", UNCLOSED).alias("error"),
    )


def event_attributes(events: DataFrame) -> DataFrame:
    """(doc_id, pos, name, value) of the start events."""
    some = events.filter("event = 'StartElement' and attr_raw <> ''")
    return some.select("doc_id", "pos", F.explode(raw_attributes(F.col("attr_raw"))).alias("a")).select("doc_id", "pos", "a.name", "a.value")
