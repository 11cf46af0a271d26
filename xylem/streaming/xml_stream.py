"""Documents that arrive as files: the parse stage as an append-only stream.

Parsing looks at one document at a time, so the stream needs no state and no watermark; windows and watermarks come after a projection, as Spark's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import pull_events
from ..session import prepare
from ..sources.parser import ParseOptions
from ..sources.xml import parse_xml


def xml_file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of (doc_id, xml): the path and whole text of each file that comes into a folder."""
    prepare(spark)
    files = spark.readStream.schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", max_files).format("text").load(path)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("xml"))


def node_stream(stream: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """The node table of a stream of (doc_id, xml)."""
    return parse_xml(stream, options=options)


def event_stream(stream: DataFrame) -> DataFrame:
    """The pull events of a stream of (doc_id, xml)."""
    return pull_events(stream)


def register_udtf(spark: SparkSession, name: str = "parse_xml_nodes") -> None:
    """A table function for SQL: ``SELECT ... FROM docs, LATERAL parse_xml_nodes(xml)``."""
    from pyspark.sql.functions import udtf

    from ..sources.parser import Parser, XmlProblem

    class Nodes:
        def eval(self, xml: str):
            if xml is None:
                return
            try:
                for i, n in enumerate(Parser(xml.replace("\r\n", "\n").replace("\r", "\n")).run()):
                    yield i, n.parent, n.ord, n.depth, n.pre, n.end, n.kind, n.name, n.value
            except XmlProblem as e:
                yield -1, None, None, None, None, None, "#error", e.kind, e.message

    prepare(spark)
    spark.udtf.register(name, udtf(Nodes, returnType="node_id int, parent_id int, ord int, depth int, pre int, `end` int, kind string, name string, value string"))
