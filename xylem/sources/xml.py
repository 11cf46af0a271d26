"""Sources: decoding bytes, reading files, and the parse stage that turns documents into the node table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import never_broadcast, prepare
from .parser import ParseOptions, Parser, XmlProblem, position
from .plain import plain_nodes, slices

NODES = (
    "node_id int, parent_id int, ord int, depth int, pre int, `end` int, kind string, name string, value string, leaf_text string, "
    "attrs array<struct<name:string,value:string>>, decl struct<version:string,encoding:string,standalone:boolean>, "
    "doctype struct<public_id:string,system_id:string,internal_subset:string>, error struct<kind:string,message:string,line:int,col:int>"
)
ERROR = "#error"

# Windows-1252 bytes 0x80-0x9F that differ from ISO-8859-1, in order, and what they stand for; five bytes are undefined.
CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
# Names of encodings.
NAMES = {
    "utf8": ("UTF-8", "UTF8"), "latin1": ("ISO-8859-1", "ISO_8859_1", "LATIN1", "LATIN-1"),
    "cp1252": ("WINDOWS-1252", "WINDOWS_1252", "CP1252"), "ascii": ("US-ASCII", "ASCII"),
}


def unix_lines(text: Column) -> Column:
    """CRLF and CR become LF; texts without CR are left alone."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def detect_format(data: Column) -> Column:
    """utf8bom, utf16le, utf16be by their marks, else utf8."""
    return (
        F.when(F.hex(F.substring(data, 1, 3)) == "EFBBBF", "utf8bom").when(F.hex(F.substring(data, 1, 2)) == "FFFE", "utf16le")
        .when(F.hex(F.substring(data, 1, 2)) == "FEFF", "utf16be").otherwise("utf8")
    )


def decode_bytes(data: Column, encoding: str | None = None) -> tuple[Column, Column, Column]:
    """(text, format, problem) of a binary column: by its mark, or in a named encoding.

    A null has null text. What can't be decoded has null text and a problem; an odd last byte of UTF-16 is dropped.
    """
    if encoding is not None:
        kind = next((k for k, names in NAMES.items() if encoding.upper() in names), None)
        if kind is None:
            return F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(f"Unsupported character encoding: {encoding}")
        if kind == "utf8":
            good = F.is_valid_utf8(data.cast("string"))
            return F.when(good, data.cast("string")), F.lit(kind), F.when(~good, "Invalid UTF-8 data")
        latin = F.decode(data, "ISO-8859-1")
        if kind == "latin1":
            return latin, F.lit(kind), F.lit(None).cast("string")
        if kind == "cp1252":
            return F.translate(latin, CP1252_BYTES, CP1252_CHARS), F.lit(kind), F.lit(None).cast("string")
        bad = latin.rlike("[^\\x00-\\x7F]")
        return F.when(~bad, latin), F.lit(kind), F.when(bad, "Invalid US-ASCII byte")
    kind = detect_format(data)
    rest3, rest2 = F.substring(data, F.lit(4), F.octet_length(data)), F.substring(data, F.lit(3), F.octet_length(data))
    even = F.substring(rest2, F.lit(1), (F.octet_length(rest2) / 2).cast("int") * 2)
    body = F.when(kind == "utf8bom", rest3).otherwise(data)
    good = (kind == "utf16le") | (kind == "utf16be") | F.is_valid_utf8(body.cast("string"))
    text = F.when(kind == "utf16le", F.decode(even, "UTF-16LE")).when(kind == "utf16be", F.decode(even, "UTF-16BE")).when(good, body.cast("string"))
    return text, kind, F.when(~good, "Invalid UTF-8 data")


def read_xml_files(spark: SparkSession, path: str, encoding: str | None = None, max_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """(path, xml, format, problem) of files; a file above ``max_bytes`` has a problem and no text."""
    files = spark.read.format("binaryFile").load(path)
    text, kind, problem = decode_bytes(F.col("content"), encoding)
    fits = F.col("length") <= max_bytes
    return files.select("path", F.when(fits, text).alias("xml"), kind.alias("format"), F.when(fits, problem).otherwise(f"Stream exceeds {max_bytes} bytes").alias("problem"))


def parse_xml(df: DataFrame, xml: str = "xml", doc_id: str = "doc_id", options: ParseOptions = ParseOptions()) -> DataFrame:
    """The node table of the documents: a row for each node, or one ``#error`` row for a document that can't be parsed.

    A null document has an error row, too. Other columns of ``df`` are not kept. ``leaf_text`` is the text of elements without child elements.
    Joins of the nodes are never broadcast by the planner's estimate (see ``session.never_broadcast``).
    """
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, {NODES}"
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _Rows(arrow)
            keys, texts = b.column(0).cast(arrow.field("doc_id").type), b.column(1)
            for at, end in slices(texts):
                made, other = plain_nodes(keys[at:end], texts[at:end], arrow, options)
                if made is not None:
                    yield made
                left = pa.array(np.flatnonzero(other) + at)
                for k, text in zip(keys.take(left).to_pylist(), texts.take(left).to_pylist(), strict=True):
                    if text is None:
                        rows.error(k, "Syntax", "No document", None, None)
                        continue
                    try:
                        rows.add(k, Parser(text, options).run())
                    except XmlProblem as e:
                        rows.error(k, e.kind, e.message, *position(text, e.at))
                    if rows.n > 50_000:
                        yield rows.batch()
                        rows = _Rows(arrow)
            if rows.n:
                yield rows.batch()

    prepare(df.sparkSession)
    texts = df.select(F.col(doc_id).alias("doc_id"), unix_lines(F.col(xml).cast("string")).alias("xml"))
    return never_broadcast(texts.mapInArrow(run, schema))


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


class _Rows:
    """Columns of nodes under way to an Arrow batch."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.n = schema, 0
        self.cols: dict[str, list] = {f.name: [] for f in schema}
        self.names: list[str] = []
        self.values: list[str] = []
        self.offsets: list[int] = [0]
        self.no_attrs: list[bool] = []

    def _attrs(self, attrs) -> None:
        for name, value in attrs or ():
            self.names.append(name)
            self.values.append(value)
        self.offsets.append(len(self.names))
        self.no_attrs.append(attrs is None)
        self.n += 1

    def add(self, key, nodes) -> None:
        c = self.cols
        c["doc_id"] += [key] * len(nodes)
        c["node_id"] += range(len(nodes))
        for name in ("parent", "ord", "depth", "pre", "end", "kind", "name", "value"):
            c["parent_id" if name == "parent" else name] += [getattr(n, name) for n in nodes]
        c["leaf_text"] += ["".join(n.texts or ()) if n.kind == "element" and not n.elements else n.value if n.kind in ("text", "cdata") else "" if n.kind in ("comment", "pi") else None for n in nodes]
        c["decl"] += [dict(zip(("version", "encoding", "standalone"), n.extra, strict=True)) if n.kind == "declaration" else None for n in nodes]
        c["doctype"] += [dict(zip(("public_id", "system_id", "internal_subset"), n.extra, strict=True)) if n.kind == "doctype" else None for n in nodes]
        c["error"] += [None] * len(nodes)
        for n in nodes:
            self._attrs(n.attrs)

    def error(self, key, kind: str, message: str, line: int | None, col: int | None) -> None:
        for name, column in self.cols.items():
            if name != "attrs":
                column.append({"doc_id": key, "node_id": -1, "kind": ERROR, "error": {"kind": kind, "message": message, "line": line, "col": col}}.get(name))
        self._attrs(None)

    def batch(self) -> pa.RecordBatch:
        item = self.schema.field("attrs").type.value_type
        pairs = pa.StructArray.from_arrays([pa.array(self.names, pa.string()), pa.array(self.values, pa.string())], fields=[item.field(0), item.field(1)])
        lists = pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pairs, type=self.schema.field("attrs").type, mask=pa.array(self.no_attrs))
        return pa.RecordBatch.from_arrays([lists if f.name == "attrs" else pa.array(self.cols[f.name], f.type) for f in self.schema], schema=self.schema)


def nodes_of(parsed: DataFrame) -> DataFrame:
    """The nodes alone, without error rows."""
    return parsed.filter(F.col("kind") != ERROR).drop("error")


def errors_of(parsed: DataFrame) -> DataFrame:
    """(doc_id, kind, message, line, col) of the documents that failed."""
    return parsed.filter(F.col("kind") == ERROR).select("doc_id", "error.*")


def docs_of(parsed: DataFrame) -> DataFrame:
    """(doc_id, root_elem_id, decl_id, dtd_id, n_nodes, error) of each document."""
    at = lambda test: F.min(F.when(test, F.col("node_id")))
    return parsed.groupBy("doc_id").agg(
        at((F.col("kind") == "element") & (F.col("parent_id") == 1)).alias("root_elem_id"), at(F.col("kind") == "declaration").alias("decl_id"),
        F.max(F.when(F.col("kind") == "doctype", F.col("node_id"))).alias("dtd_id"), F.count(F.when(F.col("kind") != ERROR, 1)).alias("n_nodes"), F.first("error", ignorenulls=True).alias("error"),
    )
