from xylem.sources.xml import errors_of, nodes_of, parse_xml


def docs(spark, *xml):
    return spark.createDataFrame(list(enumerate(xml)), "doc_id long, xml string")


def nodes(spark, *xml, **how):
    return nodes_of(parse_xml(docs(spark, *xml), **how)).cache()


def errors(spark, *xml, **how):
    return {r["doc_id"]: r for r in errors_of(parse_xml(docs(spark, *xml), **how)).collect()}
