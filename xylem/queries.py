"""The registered queries over documents made from the tables, and the same questions in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bind, events, mutate, nodes as nav, serialize, validate
from .plans.corpora import catalog_xml, corpus, orders_xml, saved
from .plans.xpath import XPath
from .session import prepare, table
from .sources.parser import ParseOptions
from .sources.xml import decode_bytes, docs_of, errors_of, nodes_of, parse_xml, unix_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Parts with their place in their brand's document.
P = "p AS (SELECT CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS BIGINT) doc_id, *, CAST(round(p_retailprice * 100) AS BIGINT) cents, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) rn, count(*) OVER (PARTITION BY p_brand) n FROM part)"
B = f"{P}, b AS (SELECT doc_id, any_value(p_brand) p_brand, count(*) n FROM p GROUP BY doc_id)"
# The catalog's text, from its parts.
PART = "'<part id=\"' || p_partkey || '\" type=\"' || p_type || '\"><name>' || p_name || '</name><size>' || p_size || '</size><cents>' || cents || '</cents></part>'"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _values(x: XPath, path: str) -> DataFrame:
    """(doc_id, value): the text of each node of the set."""
    return x.nodes(path).select("doc_id", F.col("leaf_text").alias("value"))


def _scalar(x: XPath, expression: str, kind: str = "bigint") -> DataFrame:
    return x.evaluate(expression).select("doc_id", F.col("value").cast(kind).alias("value"))


def _several(x: XPath, expressions: dict[str, str], kind: str = "string") -> DataFrame:
    return _union([_scalar(x, e, kind).select(F.lit(name).alias("fn"), "doc_id", "value") for name, e in expressions.items()])


# -- the flagship, parsing, decoding ------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey doc_id, coalesce(sum(CASE WHEN l_quantity > 30 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END), 0)::BIGINT AS value
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")
def xp_order_cents(spark, sf_dir):
    return _scalar(XPath(corpus(spark, sf_dir, "orders")), "sum(//line[qty > 30]/cents)")


@query("""
SELECT kind, n::BIGINT n FROM (
  SELECT 'prolog' kind, count(*) n FROM orders UNION ALL SELECT 'root', count(*) FROM orders
  UNION ALL SELECT 'element', (SELECT 2 * count(*) FROM orders) + (SELECT 3 * count(*) FROM lineitem) UNION ALL SELECT 'text', (SELECT 2 * count(*) FROM lineitem))
""")
def parse_node_counts(spark, sf_dir):
    parsed = parse_xml(orders_xml(spark, sf_dir))
    return parsed.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey doc_id, 2 root_elem_id, 4 + 5 * count(l_orderkey) n_nodes FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def parse_docs(spark, sf_dir):
    return docs_of(corpus(spark, sf_dir, "orders").withColumn("error", F.lit(None).cast("struct<kind:string,message:string,line:int,col:int>"))).select("doc_id", "root_elem_id", "n_nodes")


@query("""
SELECT * FROM (SELECT o_orderkey doc_id, CASE o_orderkey % 4 WHEN 1 THEN 'Mismatched closing tag: expected </b>, found </a>' WHEN 2 THEN 'Duplicate attribute ''k'' on element <a>' WHEN 3 THEN 'Forbidden XML character ''\\u{1}''' END message,
  1 line, CASE o_orderkey % 4 WHEN 1 THEN 10 WHEN 2 THEN 15 WHEN 3 THEN 4 END col, 'Syntax' kind FROM orders) WHERE message IS NOT NULL
""")
def parse_error_rows(spark, sf_dir):
    bad = F.when(F.col("o_orderkey") % 4 == 1, "<a><b></a>").when(F.col("o_orderkey") % 4 == 2, "<a k='1' k='2'/>").when(F.col("o_orderkey") % 4 == 3, "<a>\x01</a>").otherwise("<a/>")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), bad.alias("xml"))
    return errors_of(parse_xml(docs)).select("doc_id", "message", "line", "col", "kind")


@query("SELECT count(*) n, count(*) failed FROM pages")
def parse_html_fails(spark, sf_dir):
    parsed = parse_xml(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("xml")))
    return parsed.filter("kind in ('#error', 'root')").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "#error", 1)).alias("failed"))


@query("SELECT doc_id, enc, md5(text || CASE enc WHEN 'cp1252' THEN '€™' ELSE '' END) digest, enc AS format FROM documents, (VALUES ('utf8'), ('utf8bom'), ('utf16le'), ('utf16be'), ('latin1'), ('cp1252')) e(enc)")
def decode_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forms = {
        "utf8": (F.encode("text", "UTF-8"), None), "utf8bom": (F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")), None), "utf16le": (F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")), None),
        "utf16be": (F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")), None), "latin1": (F.encode("text", "ISO-8859-1"), "LATIN1"), "cp1252": (F.concat(F.encode("text", "ISO-8859-1"), F.unhex(F.lit("8099"))), "Windows-1252"),
    }
    out = []
    for enc, (data, name) in forms.items():
        text, kind, _ = decode_bytes(F.col("b"), name)
        out.append(docs.select("doc_id", data.alias("b")).select("doc_id", F.lit(enc).alias("enc"), F.md5(text).alias("digest"), kind.alias("format")))
    return _union(out)


@query("SELECT doc_id, md5(text) digest FROM documents")
def eol_normalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(unix_lines(F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r\n "), F.lit("\r ")))).alias("digest"))


@query("SELECT doc_id, md5(text) digest FROM documents")
def ent_expand(spark, sf_dir):
    """Escaped texts, one letter as a numeric reference and one through a declared entity, come back as they were."""
    escaped = F.replace(F.replace(serialize.escape_text(F.col("text")), F.lit("e"), F.lit("&#x65;")), F.lit("n"), F.lit("&en;"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('<!DOCTYPE d [\n<!ENTITY en "n">\n]><d>'), escaped, F.lit("</d>")).alias("xml"))
    return parse_xml(docs).filter("kind = 'element'").select("doc_id", F.md5("leaf_text").alias("digest"))


# -- events --------------------------------------------------------------------------------------------------------------

TOKENS = "t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>|<\\?.*?\\?>|<[^>]*>|[^<]+')) t FROM pages)"
KIND = "CASE WHEN t NOT LIKE '<%' THEN 'Text' WHEN t LIKE '<!--%' THEN 'Comment' WHEN t LIKE '<!DOCTYPE%' THEN 'DocType' WHEN t LIKE '</%' THEN 'EndElement' ELSE 'StartElement' END"


def _page_events(spark, sf_dir) -> DataFrame:
    return events.pull_events(table(spark, sf_dir, "pages"), "html", "page_id")


@query(f"WITH {TOKENS} SELECT {KIND} event, count(*) n FROM t GROUP BY 1")
def ev_kind_counts(spark, sf_dir):
    return _page_events(spark, sf_dir).groupBy("event").agg(F.count("*").alias("n"))


@query(rf"""WITH {TOKENS}, a AS (SELECT unnest(regexp_extract_all(t, '([^\s=<]+)\s*=\s*("[^"]*"|''[^'']*'')', 1)) AS name FROM t WHERE {KIND} = 'StartElement') SELECT name, count(*) n FROM a GROUP BY 1""")
def ev_attributes(spark, sf_dir):
    return events.event_attributes(_page_events(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS} SELECT page_id doc_id, sum(CASE WHEN {KIND} = 'Text' THEN length(t) END)::BIGINT chars, count(CASE WHEN {KIND} = 'StartElement' THEN 1 END) starts FROM t GROUP BY 1")
def ev_text_chars(spark, sf_dir):
    e = _page_events(spark, sf_dir)
    return e.groupBy("doc_id").agg(F.sum(F.when(F.col("event") == "Text", F.length("text"))).cast("bigint").alias("chars"), F.count(F.when(F.col("event") == "StartElement", 1)).alias("starts"))


@query("SELECT p_partkey doc_id, 2 * 2::BIGINT starts, 2 * 2::BIGINT AS ends, p_name AS attr FROM part")
def ev_selfclosing(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<p><q name='"), "p_name", F.lit("'/><r/><s></s></p>")).alias("xml"))
    e = events.pull_events(docs)
    n = lambda k: F.count(F.when(F.col("event") == k, 1))
    counts = e.groupBy("doc_id").agg(n("StartElement").alias("starts"), n("EndElement").alias("ends"))
    return counts.join(events.event_attributes(e).select("doc_id", F.col("value").alias("attr")), "doc_id")


# -- XPath: axes and tests -----------------------------------------------------------------------------------------------


def _xpath(name: str, path: str, sql: str) -> None:
    def run(spark, sf_dir):
        return _values(XPath(corpus(spark, sf_dir, "catalog")), path)

    run.__name__ = name
    query(sql)(run)


def _xcount(name: str, expression: str, sql: str, on: str = "catalog") -> None:
    def run(spark, sf_dir):
        return _scalar(XPath(corpus(spark, sf_dir, on)), expression)

    run.__name__ = name
    query(sql)(run)


_sel = lambda value, where="true": f"WITH {P} SELECT doc_id, {value} AS value FROM p WHERE {where}"
_cnt = lambda value: f"WITH {B} SELECT doc_id, ({value})::BIGINT AS value FROM b"
_xpath("xp_child", "/catalog/part/name", _sel("p_name"))
_xpath("xp_descendant", "//size", _sel("p_size::VARCHAR"))
_xcount("xp_descendant_or_self", "count(/descendant-or-self::node())", _cnt("1 + 1 + 1 + 7 * n + 1"))
_xpath("xp_parent", "//name/../@id", _sel("p_partkey::VARCHAR"))
_xcount("xp_ancestor", "count(//size/ancestor::*)", _cnt("1 + n"))
_xcount("xp_ancestor_or_self", "count(//size/ancestor-or-self::*)", _cnt("1 + 2 * n"))
_xpath("xp_following_sibling", "//part[1]/following-sibling::part/@id", _sel("p_partkey::VARCHAR", "rn > 1"))
_xpath("xp_preceding_sibling", "//part[last()]/preceding-sibling::part[1]/@id", _sel("p_partkey::VARCHAR", "rn = 1 AND n > 1"))
_xcount("xp_following", "count(//part[last()]/following::node())", _cnt("7"))
_xcount("xp_preceding", "count(//part[1]/preceding::node())", _cnt("4"))
_xpath("xp_attribute", "//part/@type", _sel("p_type"))
_xpath("xp_self", "//part/self::part/@id", _sel("p_partkey::VARCHAR"))
_xcount("xp_root", "count(/)", _cnt("1"))
_xcount("xp_namespace", "count(//nation/namespace::*)", "SELECT r_regionkey::BIGINT doc_id, (3 * count(n_nationkey))::BIGINT AS value FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1", "geo")
_xcount("xp_test_wildcard", "count(//*)", _cnt("1 + 4 * n"))
_xcount("xp_test_node", "count(//node())", _cnt("3 + 7 * n"))
_xcount("xp_test_text", "count(//text())", _cnt("3 * n"))
_xcount("xp_test_comment", "count(//comment())", _cnt("1"))
_xcount("xp_test_pi", "count(//processing-instruction())", _cnt("1"))
_xcount("xp_test_any_attribute", "count(//@*)", _cnt("1 + 2 * n"))
_xpath("xp_pred_position", "//part[2]/@id", _sel("p_partkey::VARCHAR", "rn = 2"))
_xpath("xp_pred_last", "//part[last()]/@id", _sel("p_partkey::VARCHAR", "rn = n"))
_xpath("xp_pred_range", "//part[position() <= 3]/name", _sel("p_name", "rn <= 3"))
_xpath("xp_pred_attr_eq", "//part[@type = 'ECONOMY']/@id", _sel("p_partkey::VARCHAR", "p_type = 'ECONOMY'"))
_xpath("xp_pred_exists", "//part[size][not(colour)]/@id", _sel("p_partkey::VARCHAR"))
_xpath("xp_pred_string", "//part[@id]/@id", _sel("p_partkey::VARCHAR"))
_xpath("xp_pred_chained", "//part[size > 25][1]/@id", f"WITH {P}, q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rn) k FROM p WHERE p_size > 25) SELECT doc_id, p_partkey::VARCHAR AS value FROM q WHERE k = 1")
_xpath("xp_pred_nested", "//part[size[. > 40]]/@id", _sel("p_partkey::VARCHAR", "p_size > 40"))
_xpath("xp_op_or_and", "//part[(size < 10 or size > 45) and @type != 'ECONOMY']/@id", _sel("p_partkey::VARCHAR", "(p_size < 10 OR p_size > 45) AND p_type <> 'ECONOMY'"))
_xpath("xp_op_eq", "//part[size = 7]/@id", _sel("p_partkey::VARCHAR", "p_size = 7"))
_xpath("xp_op_rel", "//part[size >= 10 and size <= 12]/@id", _sel("p_partkey::VARCHAR", "p_size BETWEEN 10 AND 12"))
_xcount("xp_op_arith", "sum(//size) * 2 + count(//part) - 3", f"WITH {P} SELECT doc_id, (sum(p_size) * 2 + count(*) - 3)::BIGINT AS value FROM p GROUP BY 1")
_xcount("xp_op_div_mod", "floor(sum(//size) div 7) * 10 + sum(//size) mod 7", f"WITH {P} SELECT doc_id, (floor(sum(p_size) / 7) * 10 + sum(p_size) % 7)::BIGINT AS value FROM p GROUP BY 1")
_xcount("xp_op_neg", "-sum(//size) - -1", f"WITH {P} SELECT doc_id, (1 - sum(p_size))::BIGINT AS value FROM p GROUP BY 1")
_xcount("xp_op_union", "count(//size | //name | //part/size)", _cnt("2 * n"))
_xpath("xp_group_position", "(//size)[3]", _sel("p_size::VARCHAR", "rn = 3"))


@query(f"""WITH {P} SELECT doc_id, CASE WHEN p_size > 40 THEN 'big' ELSE p_name END AS value FROM p WHERE rn = 1""")
def xp_var(spark, sf_dir):
    x = XPath(corpus(spark, sf_dir, "catalog"))
    x.set_variable("limit", 40)
    x.register_function("pick", lambda a, b, c: F.when(a, b).otherwise(c), "str")
    return _scalar(x, "pick(//part[1]/size > $limit, 'big', string(//part[1]/name))", "string")


@query(f"WITH {P} SELECT doc_id, (p_size * p_size)::BIGINT AS value FROM p WHERE rn = 1")
def xp_custom_fn(spark, sf_dir):
    x = XPath(corpus(spark, sf_dir, "catalog"))
    x.register_function("square", lambda a: a * a)
    return _scalar(x, "square(number(//part[1]/size))")


# -- XPath: functions ----------------------------------------------------------------------------------------------------

_N = "//part[1]/name"
_STRINGS = {
    "string": (f"string({_N})", "p_name"), "concat": (f"concat({_N}, '-', //part[1]/size)", "p_name || '-' || p_size"), "substring": (f"substring({_N}, 2, 3)", "substr(p_name, 2, 3)"),
    "substring2": (f"substring({_N}, 3)", "substr(p_name, 3)"), "before": (f"substring-before({_N}, ' ')", "CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE '' END"),
    "after": (f"substring-after({_N}, ' ')", "CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END"), "normalize": (f"normalize-space(concat('  ', {_N}, '   x '))", "p_name || ' x'"),
    "translate": (f"translate({_N}, 'aeix', 'AE')", "translate(p_name, 'aeix', 'AE')"), "lower": (f"lower-case(upper-case({_N}))", "lower(p_name)"), "upper": (f"upper-case({_N})", "upper(p_name)"),
    "replace": (f"replace({_N}, 'e', 'oo')", "replace(p_name, 'e', 'oo')"), "length": (f"string(string-length({_N}))", "length(p_name)::VARCHAR"), "contains": (f"string(contains({_N}, 'wid'))", "CASE WHEN contains(p_name, 'wid') THEN 'true' ELSE 'false' END"),
    "starts": (f"string(starts-with({_N}, 'r'))", "CASE WHEN starts_with(p_name, 'r') THEN 'true' ELSE 'false' END"), "ends": (f"string(ends-with({_N}, 't'))", "CASE WHEN suffix(p_name, 't') THEN 'true' ELSE 'false' END"),
    "decimal": ("string(//part[1]/size div 4)", "CASE WHEN p_size % 4 = 0 THEN (p_size // 4)::VARCHAR ELSE (p_size / 4.0)::DOUBLE::VARCHAR END"),
}


@query(" UNION ALL ".join(f"(WITH {P} SELECT '{k}' fn, doc_id, {v} AS value FROM p WHERE rn = 1)" for k, (_, v) in _STRINGS.items()))
def xp_fn_strings(spark, sf_dir):
    return _several(XPath(corpus(spark, sf_dir, "catalog")), {k: e for k, (e, _) in _STRINGS.items()})


_NUMBERS = {
    "count": ("count(//part)", "count(*)"), "sum": ("sum(//size)", "sum(p_size)"), "floor": ("floor(sum(//size) div 8)", "floor(sum(p_size) / 8)"), "ceiling": ("ceiling(sum(//size) div 8)", "ceil(sum(p_size) / 8)"),
    "round": ("round(sum(//size) div 8)", "floor(sum(p_size) / 8 + 0.5)"), "round_neg": ("round(-0.5 - count(//part))", "-(count(*) + 1)"), "number": ("number('1e2') + count(//part)", "count(*) + 100"), "boolean": ("number(boolean(//part)) + number(not(//nothing))", "2"),
}


@query(" UNION ALL ".join(f"(WITH {P} SELECT '{k}' fn, doc_id, ({v})::BIGINT AS value FROM p GROUP BY doc_id)" for k, (_, v) in _NUMBERS.items()))
def xp_fn_numbers(spark, sf_dir):
    return _several(XPath(corpus(spark, sf_dir, "catalog")), {k: e for k, (e, _) in _NUMBERS.items()}, "bigint")


@query("""SELECT fn, r_regionkey::BIGINT doc_id, v AS value FROM region, (VALUES ('name', 'geo'), ('prefixed', 'x:customer'), ('uri', 'urn:geo'), ('uri2', 'urn:x')) f(fn, v) WHERE fn IN ('name', 'uri')
OR r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON n_nationkey = c_nationkey)""")
def xp_fn_names(spark, sf_dir):
    x = XPath(corpus(spark, sf_dir, "geo"))
    first = "//x:customer[1]"
    out = _several(x, {"name": "name(/*)", "prefixed": f"name({first})", "uri": "namespace-uri(/*)", "uri2": f"namespace-uri({first})"})
    return out.filter("fn in ('name', 'uri') or value in ('x:customer', 'urn:x')")


@query("SELECT n_regionkey::BIGINT doc_id, ('c' || c_custkey) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0")
def xp_fn_lang(spark, sf_dir):
    return _values(XPath(corpus(spark, sf_dir, "geo")), "//x:customer[lang('FR')]/@id")


@query("SELECT n_regionkey::BIGINT doc_id, n_name AS value FROM nation WHERE n_nationkey IN (0, 3, 7)")
def xp_fn_id(spark, sf_dir):
    return _values(XPath(corpus(spark, sf_dir, "geo")), "id('n3 n0  n7 zz')/@name")


@query("SELECT n_regionkey::BIGINT doc_id, n_name AS value FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def xp_deep_predicate(spark, sf_dir):
    return _values(XPath(corpus(spark, sf_dir, "geo")), "//nation[x:customer/bal[. > 900000]]/@name")


# -- navigation ----------------------------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT doc_id, p_partkey::VARCHAR id, lag(p_partkey) OVER w::VARCHAR AS before, lead(p_partkey) OVER w::VARCHAR AS after FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY rn)")
def nav_siblings(spark, sf_dir):
    n = corpus(spark, sf_dir, "catalog")
    parts = nav.siblings(n.filter("name = 'part' and kind = 'element'"))
    ids = n.filter("name = 'part'").select("doc_id", "node_id", nav.attribute(F.col("attrs"), "id").alias("id"))
    named = lambda c, out: ids.select("doc_id", F.col("node_id").alias(c), F.col("id").alias(out))
    out = parts.join(named("previous_sibling", "before"), ["doc_id", "previous_sibling"], "left").join(named("next_sibling", "after"), ["doc_id", "next_sibling"], "left")
    return out.select("doc_id", nav.attribute(F.col("attrs"), "id").alias("id"), "before", "after")


@query(f"WITH {B} SELECT doc_id, 4 first_child, (4 + 7 * (n - 1))::INTEGER last_child, n kids, (n + 2)::BIGINT all_kids FROM b")
def nav_children(spark, sf_dir):
    n = corpus(spark, sf_dir, "catalog")
    root = nav.root_elements(n)
    ends = nav.first_and_last_child(n, elements_only=True).join(root.select("doc_id", "node_id"), ["doc_id", "node_id"])
    kids = nav.children(n, root).groupBy("doc_id").agg(F.count(F.when(F.col("kind") == "element", 1)).alias("kids"), F.count("*").alias("all_kids"))
    return ends.join(kids, "doc_id").select("doc_id", "first_child", "last_child", "kids", "all_kids")


@query(f"WITH {P} SELECT doc_id, string_agg(p_name || p_size || cents, '' ORDER BY rn) AS text FROM p GROUP BY 1")
def nav_text_content(spark, sf_dir):
    n = corpus(spark, sf_dir, "catalog")
    return nav.text_content(n, nav.root_elements(n)).select("doc_id", "text")


@query("SELECT n_regionkey::BIGINT doc_id, n_name AS name FROM nation WHERE n_nationkey = 7")
def nav_by_id(spark, sf_dir):
    n = corpus(spark, sf_dir, "geo")
    return n.join(nav.element_by_id(n, "n7"), ["doc_id", "node_id"]).select("doc_id", nav.attribute(F.col("attrs"), "name").alias("name"))


@query(f"WITH {B} SELECT doc_id, n parts, (1 + 4 * n)::BIGINT all_elements FROM b")
def nav_by_tag(spark, sf_dir):
    n = corpus(spark, sf_dir, "catalog")
    return nav.elements_by_tag(n, "part").groupBy("doc_id").agg(F.count("*").alias("parts")).join(nav.elements_by_tag(n, "*").groupBy("doc_id").agg(F.count("*").alias("all_elements")), "doc_id")


@query(f"WITH {P} SELECT doc_id, p_partkey::VARCHAR AS value, 0 pos, 'id' AS name FROM p UNION ALL SELECT doc_id, p_type, 1, 'type' FROM p")
def nav_attributes(spark, sf_dir):
    n = corpus(spark, sf_dir, "catalog")
    return nav.attributes(n.filter("name = 'part'")).select("doc_id", "value", "pos", "name")


@query("""SELECT coalesce(prefix, '') prefix, local_name, ns_uri, n::BIGINT n FROM (
  SELECT NULL prefix, 'geo' local_name, 'urn:geo' ns_uri, count(*) n FROM region UNION ALL SELECT NULL, 'region', 'urn:geo', count(*) FROM region UNION ALL SELECT NULL, 'nation', 'urn:geo', count(*) FROM nation
  UNION ALL SELECT 'x', 'customer', 'urn:x', count(*) FROM customer UNION ALL SELECT NULL, 'bal', 'urn:geo', count(*) FROM customer)""")
def ns_uri(spark, sf_dir):
    return nav.namespace_uris(corpus(spark, sf_dir, "geo")).groupBy(F.coalesce("prefix", F.lit("")).alias("prefix"), "local_name", "ns_uri").agg(F.count("*").alias("n"))


@query("SELECT 'urn:x' uri, count(*) n FROM customer UNION ALL SELECT 'any', (SELECT count(*) FROM customer) UNION ALL SELECT 'none', 0")
def ns_by_tag_ns(spark, sf_dir):
    n = corpus(spark, sf_dir, "geo")
    one = lambda label, uri, local: nav.elements_by_tag_ns(n, uri, local).agg(F.count("*").alias("n")).select(F.lit(label).alias("uri"), "n")
    return _union([one("urn:x", "urn:x", "*"), one("any", "*", "customer"), one("none", "", "*")])


@query("SELECT r_regionkey::BIGINT doc_id, 'x' AS prefix FROM region")
def ns_lookup_prefix(spark, sf_dir):
    n = corpus(spark, sf_dir, "geo")
    return nav.lookup_prefix(n, "urn:x").join(nav.root_elements(n).select("doc_id", "node_id"), ["doc_id", "node_id"]).select("doc_id", "prefix")


# -- validation ----------------------------------------------------------------------------------------------------------

DTD = """<!ELEMENT part (name, size, tag)>
<!ELEMENT void EMPTY>
<!ELEMENT flag ANY>
<!ATTLIST part id ID #REQUIRED>
<!ATTLIST part kind CDATA #REQUIRED>
<!ATTLIST twin id ID #IMPLIED>
<!ATTLIST ref to IDREF #REQUIRED>
<!ATTLIST ref how CDATA "soft">
<!ATTLIST void env CDATA #FIXED "prod">"""
XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
<xs:element name="part"><xs:complexType><xs:sequence><xs:element name="name" type="xs:string"/><xs:element name="size" type="xs:integer"/><xs:element name="tag" maxOccurs="2"/></xs:sequence>
<xs:attribute name="kind" type="xs:string" use="required"/></xs:complexType></xs:element>
<xs:element name="flag" type="xs:boolean"/>
<xs:element name="name"><xs:simpleType><xs:restriction base="xs:string"><xs:minLength value="8"/><xs:maxLength value="10"/></xs:restriction></xs:simpleType></xs:element>
<xs:element name="size"><xs:simpleType><xs:restriction base="xs:integer"><xs:minInclusive value="5"/><xs:maxInclusive value="40"/></xs:restriction></xs:simpleType></xs:element>
<xs:element name="tag"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="new"/><xs:enumeration value="old"/></xs:restriction></xs:simpleType></xs:element>
</xs:schema>"""


@query("""SELECT p_partkey doc_id, rule FROM part, (VALUES ('REQUIRED', 11), ('CHILDREN', 3), ('EMPTY', 4), ('IDREF', 8), ('ID', 10)) r(rule, m)
WHERE CASE WHEN rule = 'CHILDREN' THEN p_size % 3 = 0 ELSE p_size % m = 0 END""")
def dtd_violations(spark, sf_dir):
    return validate.dtd_violations(corpus(spark, sf_dir, "rules"), validate.Dtd().load(DTD)).select("doc_id", "rule")


@query("""SELECT p_partkey doc_id, CASE WHEN p_size % 10 = 0 THEN 'Duplicate ID value ''i' || p_partkey || ''' in element <twin>' WHEN p_size % 3 = 0 THEN 'Element <part> missing required child element <name>'
WHEN p_size % 11 = 0 THEN 'Required attribute ''kind'' missing on element <part>' WHEN p_size % 4 = 0 THEN 'Element <void> declared EMPTY but contains child content'
ELSE 'IDREF ''nowhere'' in attribute ''to'' of <ref> does not match any declared ID' END message FROM part WHERE p_size % 10 = 0 OR p_size % 3 = 0 OR p_size % 11 = 0 OR p_size % 4 = 0 OR p_size % 8 = 0""")
def dtd_first_error(spark, sf_dir):
    found = validate.dtd_violations(corpus(spark, sf_dir, "rules"), validate.Dtd().load(DTD))
    return validate.first_violations(found).select("doc_id", "message")


@query("SELECT name, sum(n)::BIGINT injected FROM (SELECT 'ref' AS name, count(*) n FROM part UNION ALL SELECT 'void', count(*) FROM part) GROUP BY 1")
def dtd_defaults(spark, sf_dir):
    done = validate.apply_dtd_defaults(corpus(spark, sf_dir, "rules"), validate.Dtd().load(DTD))
    return done.filter("injected > 0").groupBy("name").agg(F.sum("injected").cast("bigint").alias("injected"))


@query("""SELECT p_partkey doc_id, rule FROM part, (VALUES ('attribute'), ('occurs'), ('occurs2'), ('boolean'), ('length'), ('integer'), ('range'), ('enumeration')) r(rule) WHERE CASE rule
WHEN 'attribute' THEN p_size % 11 = 0 WHEN 'occurs' THEN p_size % 3 = 0 WHEN 'occurs2' THEN p_size % 5 = 0 WHEN 'boolean' THEN p_size % 6 = 0 WHEN 'length' THEN p_size % 3 <> 0 AND length(p_name) NOT BETWEEN 8 AND 10
WHEN 'integer' THEN p_size % 7 = 0 WHEN 'range' THEN p_size % 7 <> 0 AND p_size NOT BETWEEN 5 AND 40 ELSE p_size % 5 = 0 END""")
def xsd_violations(spark, sf_dir):
    found = validate.validate_xsd(corpus(spark, sf_dir, "rules"), XSD)
    return found.select("doc_id", F.when(F.col("message").contains("exceeds maxOccurs"), "occurs2").otherwise(F.col("rule")).alias("rule"))


@query("SELECT p_partkey doc_id FROM part WHERE p_size % 9 = 0")
def xsd_choice(spark, sf_dir):
    schema = '<xs:schema xmlns:xs="u"><xs:element name="part"><xs:complexType><xs:choice>' + "".join(f'<xs:element name="{n}"/>' for n in ("name", "size", "tag", "void", "flag", "mail", "ref", "twin")) + "</xs:choice></xs:complexType></xs:element></xs:schema>"
    return validate.validate_xsd(corpus(spark, sf_dir, "rules"), schema).filter("rule = 'choice'").select("doc_id")


# -- sinks and binding ---------------------------------------------------------------------------------------------------

BODY = f"{P}, d AS (SELECT doc_id, any_value(p_brand) brand, string_agg({PART}, '' ORDER BY rn) parts FROM p GROUP BY 1)"
WHOLE = "'<catalog brand=\"' || brand || '\"><!--parts-->' || parts || '<?end of?></catalog>'"


@query(f"WITH {BODY} SELECT doc_id, md5({WHOLE}) digest FROM d")
def ser_compact(spark, sf_dir):
    return serialize.to_xml_text(corpus(spark, sf_dir, "catalog"), serialize.SerializeOptions(pretty_print=False)).select("doc_id", F.md5("xml").alias("digest"))


@query(f"""WITH {P}, d AS (SELECT doc_id, any_value(p_brand) brand, string_agg('  <part id="' || p_partkey || '" type="' || p_type || '">\n    <name>' || p_name || '</name>\n    <size>' || p_size || '</size>\n    <cents>' || cents || '</cents>\n  </part>\n', '' ORDER BY rn) parts FROM p GROUP BY 1)
SELECT doc_id, md5('<catalog brand="' || brand || '">\n  <!--parts-->\n' || parts || '  <?end of?>\n</catalog>\n') digest FROM d""")
def ser_pretty(spark, sf_dir):
    return serialize.to_xml_text(corpus(spark, sf_dir, "catalog")).select("doc_id", F.md5("xml").alias("digest"))


@query(f"WITH {BODY} SELECT doc_id, sha256(replace({WHOLE}, '<!--parts-->', '')) digest, sha256({WHOLE}) with_comments FROM d")
def c14n_sha256(spark, sf_dir):
    n = corpus(spark, sf_dir, "catalog")
    one, two = serialize.canonicalize(n), serialize.canonicalize(n, with_comments=True, name="c")
    return one.join(two, "doc_id").select("doc_id", F.sha2("c14n", 256).alias("digest"), F.sha2("c", 256).alias("with_comments"))


@query("SELECT p_partkey doc_id, p_partkey id, p_name AS name, p_size AS size, p_retailprice price, p_size > 25 AS big, p_brand || ',' || p_type tags, {'a': p_size, 'b': p_name}::VARCHAR AS pair FROM part")
def bind_round_trip(spark, sf_dir):
    """Typed columns to documents and back."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).alias("big"), F.array("p_brand", "p_type").alias("tags"), F.struct(F.col("p_size").alias("a"), F.col("p_name").alias("b")).alias("pair"))
    docs = bind.to_xml_record(rows, root="part").select(F.col("id").alias("doc_id"), "xml")
    back = bind.from_nodes(saved(docs), rows.schema)
    return back.select("doc_id", "record.*").withColumn("tags", F.array_join("tags", ",")).withColumn("pair", F.concat(F.lit("{'a': "), F.col("pair.a").cast("string"), F.lit(", 'b': "), F.col("pair.b"), F.lit("}")))


@query("SELECT p_partkey id, md5('<part><p_partkey>' || p_partkey || '</p_partkey><p_name>' || p_name || '</p_name><tags><item>' || p_brand || '</item><item>' || p_type || '</item></tags></part>') digest FROM part")
def bind_to(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.array("p_brand", "p_type").alias("tags"))
    return bind.to_xml_record(rows, root="part").select(F.col("p_partkey").alias("id"), F.md5("xml").alias("digest"))


# -- edits ---------------------------------------------------------------------------------------------------------------


def _edited(name: str, ops: list[tuple], sql: str, compacted: bool = False) -> None:
    """A query that applies the same edits to each catalog and gives the digest of its text."""

    def run(spark, sf_dir):
        n = corpus(spark, sf_dir, "catalog")
        batch = spark.createDataFrame([(i, *op) for i, op in enumerate(ops)], "seq int, op string, node_id int, other_id int, ref_id int, name string, value string")
        edits = n.select("doc_id").distinct().crossJoin(F.broadcast(batch))  # a few edits for each document
        done = mutate.apply_edits(n, edits).filter("kind <> '#error'")
        done = mutate.compact(done) if compacted else done
        return serialize.to_xml_text(done, serialize.SerializeOptions(pretty_print=False)).select("doc_id", F.md5("xml").alias("digest"))

    run.__name__ = name
    query(f"WITH {P}, d AS (SELECT doc_id, any_value(p_brand) brand, string_agg(CASE WHEN rn = 1 THEN {PART} ELSE '' END, '' ORDER BY rn) first, string_agg(CASE WHEN rn > 1 THEN {PART} ELSE '' END, '' ORDER BY rn) rest FROM p GROUP BY 1) SELECT doc_id, md5({sql}) digest FROM d")(run)


_HEAD, _TAIL = "'<catalog brand=\"' || brand || '\"><!--parts-->'", "'<?end of?></catalog>'"
# In each catalog node 2 is the root element, 3 the comment, 4 the first part, 5 its name and 6 the name's text.
_edited("dom_append", [("create_element", None, -1, None, "new", None), ("set_attribute", -1, None, None, "k", "v<"), ("append_child", 2, -1, None, None, None)], f"{_HEAD} || first || rest || '<?end of?><new k=\"v&lt;\"/></catalog>'")
_edited("dom_insert", [("create_element", None, -1, None, "new", None), ("insert_before", 2, -1, 4, None, None)], f"{_HEAD} || '<new/>' || first || rest || {_TAIL}")
_edited("dom_replace", [("create_text", None, -1, None, None, "t & u"), ("replace_child", 2, -1, 4, None, None)], f"{_HEAD} || 't &amp; u' || rest || {_TAIL}")
_edited("dom_remove", [("remove_child", 2, 4, None, None, None), ("detach", 3, None, None, None, None)], f"replace({_HEAD}, '<!--parts-->', '') || rest || {_TAIL}", True)
_edited("dom_set_text", [("set_text_content", 4, None, None, None, "gone"), ("set_text_content", 3, None, None, None, "note")], f"replace({_HEAD}, 'parts', 'note') || regexp_replace(first, '>.*<', '>gone<') || rest || {_TAIL}", True)
_edited("dom_clone", [("clone_node", 4, -1, None, None, "deep"), ("append_child", 2, -1, None, None, None), ("append_child", 4, 2, None, None, None)], f"{_HEAD} || first || rest || '<?end of?>' || first || '</catalog>'")


@query(f"WITH {BODY} SELECT doc_id, md5(replace(replace({WHOLE}, ' type=\"', ' kind=\"'), 'id=\"', 'seen=\"1\" id=\"')) digest FROM d")
def dom_set_attribute(spark, sf_dir):
    """Attribute edits of whole corpora are expressions: here all parts get a marker first and a renamed type."""
    n = corpus(spark, sf_dir, "catalog")
    part = F.col("name") == "part"
    kind = nav.attribute(F.col("attrs"), "type")
    n = mutate.set_attribute(n, part, "kind", kind)
    n = mutate.remove_attribute(n, part, "type")
    n = n.withColumn("attrs", F.when(part, F.concat(F.array(F.struct(F.lit("seen").alias("name"), F.lit("1").alias("value"))), "attrs")).otherwise(F.col("attrs")))
    return serialize.to_xml_text(n, serialize.SerializeOptions(pretty_print=False)).select("doc_id", F.md5("xml").alias("digest"))


@query(f"WITH {B} SELECT doc_id, (n * 7 - 2)::BIGINT n, (n * 7 - 3)::INTEGER AS last FROM b")
def dom_compact(spark, sf_dir):
    """Removing the first part and compacting leaves dense ids."""
    n = corpus(spark, sf_dir, "catalog")
    edits = n.select("doc_id").distinct().selectExpr("doc_id", "1 seq", "'remove_child' op", "2 node_id", "4 other_id", "cast(null as int) ref_id", "cast(null as string) name", "cast(null as string) value")
    done = mutate.compact(mutate.apply_edits(n, edits).filter("kind <> '#error'"))
    return done.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("node_id").alias("last"))


@query(f"WITH {BODY} SELECT doc_id, md5({WHOLE}) digest FROM d")
def corpus_catalog(spark, sf_dir):
    prepare(spark)
    return catalog_xml(spark, sf_dir).select("doc_id", F.md5("xml").alias("digest"))


# -- limits, declarations and rules over a document for each order -----------------------------------------------------------


def _per_order(spark, sf_dir, *cases) -> DataFrame:
    """(doc_id, xml): the case that the order's key chooses."""
    xml = F.lit(cases[0])
    for i, c in enumerate(cases[1:], 1):
        xml = F.when(F.col("o_orderkey") % len(cases) == i, c).otherwise(xml)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), xml.alias("xml"))


@query("""
SELECT * FROM (SELECT o_orderkey doc_id, 'SecurityLimitExceeded' kind, CASE o_orderkey % 7 WHEN 1 THEN 'Maximum nesting depth of 2 exceeded' WHEN 2 THEN 'Maximum element count of 4 exceeded'
  WHEN 3 THEN 'Maximum attribute count of 2 exceeded on element <a>' WHEN 4 THEN 'Maximum total attribute count of 3 exceeded' WHEN 5 THEN 'Text node size exceeds maximum of 20 bytes'
  WHEN 6 THEN 'XML size exceeds maximum of 80 bytes' END message FROM orders) WHERE message IS NOT NULL
""")
def limit_errors(spark, sf_dir):
    limits = ParseOptions(max_xml_size=80, max_nesting_depth=2, max_element_count=4, max_attribute_count=2, max_total_attribute_count=3, max_text_node_size=20)
    docs = _per_order(spark, sf_dir, "<a/>", "<a><a><a><a/></a></a></a>", "<a><b/><b/><b/><b/></a>", '<a i="1" j="2" k="3"/>', '<a i="1" j="2"><a i="1" j="2"/></a>', f"<a>{'x' * 30}</a>", f"<a><!--{'x' * 80}--></a>")
    return errors_of(parse_xml(docs, options=limits)).select("doc_id", "kind", "message")


@query("SELECT o_orderkey doc_id, CASE WHEN o_orderkey % 10 < 5 THEN 8 * (o_orderkey % 10 + 1) ELSE -1 END::BIGINT AS n_chars FROM orders")
def ent_bomb(spark, sf_dir):
    """Text that entities hold counts towards the limit of an expansion (40 bytes here); beyond it there is an error row (-1)."""
    inner = F.repeat(F.lit("&a;"), (F.col("o_orderkey") % 10 + 1).cast("int"))
    xml = F.concat(F.lit('<!DOCTYPE s [\n<!ENTITY a "wave">\n<!ENTITY b "'), inner, F.lit('">\n]><s>&b;&b;</s>'))
    parsed = parse_xml(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), xml.alias("xml")), options=ParseOptions(max_total_entity_expansion_size=40))
    return parsed.filter("kind in ('element', '#error')").select("doc_id", F.coalesce(F.length("leaf_text"), F.lit(-1)).cast("bigint").alias("n_chars"))


@query("""
SELECT o_orderkey doc_id, 'declaration' kind, 0 parent_id, '1.1' AS value FROM orders UNION ALL SELECT o_orderkey, 'cdata', 3, '<' || o_orderstatus || '&>' FROM orders
UNION ALL SELECT o_orderkey, 'comment', 1, o_orderkey::VARCHAR FROM orders UNION ALL SELECT o_orderkey, 'pi', 1, 'at ' || o_custkey FROM orders
""")
def parse_prolog_epilog(spark, sf_dir):
    """Declaration, CDATA section, and what follows the root element."""
    xml = F.concat(F.lit('<?xml version="1.1" encoding="x" standalone="yes"?><r><![CDATA[<'), "o_orderstatus", F.lit("&>]]></r><!--"), F.col("o_orderkey").cast("string"), F.lit("--><?done at "), F.col("o_custkey").cast("string"), F.lit("?>"))
    parsed = parse_xml(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), xml.alias("xml")))
    return parsed.filter("kind in ('declaration', 'cdata', 'comment', 'pi')").select("doc_id", "kind", "parent_id", F.coalesce("decl.version", "value").alias("value"))


@query("""
WITH n AS (SELECT o_orderkey doc_id, count(l_orderkey) n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT fn, doc_id, CASE fn WHEN 'true' THEN n WHEN 'false' THEN 0 WHEN 'following' THEN greatest(n - 2, 0) WHEN 'preceding' THEN greatest(n - 1, 0) WHEN 'even' THEN n // 2 WHEN 'ancestor' THEN least(n, 1) WHEN 'parent' THEN n WHEN 'exists' THEN n ELSE 2 * n END::BIGINT AS value
FROM n, unnest(['true', 'false', 'following', 'preceding', 'even', 'ancestor', 'parent', 'exists', 'self']) f(fn)
""")
def xp_order_axes(spark, sf_dir):
    """Axes, positions and boolean functions over a document for each order."""
    return _several(XPath(corpus(spark, sf_dir, "orders")), {
        "true": "count(//line[true()])", "false": "count(//line[false()])", "following": "count(//line[2]/following-sibling::line)", "preceding": "count(//line[last()]/preceding-sibling::line)",
        "even": "count(//line[position() mod 2 = 0])", "ancestor": "count(//qty/ancestor::order)", "parent": "count(//cents/..)", "exists": "count(//line[qty])", "self": "count(//line/*/self::*)",
    }, "bigint")


@query("""
SELECT o_orderkey doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'Required attribute ''k'' missing on element <a>' ELSE 'Required attribute ''flag'' missing on element <a>' END message FROM orders WHERE o_orderkey % 3 < 2
""")
def dtd_own_subsets(spark, sf_dir):
    """Rules from internal subsets and from a resolver; ANY and enumerated types are never violated."""
    docs = _per_order(spark, sf_dir, "<!DOCTYPE a [\n<!ATTLIST a k CDATA #REQUIRED>\n]><a/>", '<!DOCTYPE a SYSTEM "ext.dtd"><a/>', '<!DOCTYPE a [\n<!ELEMENT a ANY>\n<!ATTLIST a k (x|y) #FIXED "x">\n]><a k="z"><b/></a>')
    found = validate.validate_dtd(saved(docs), resolver=lambda system, public: "<!ATTLIST a flag CDATA #REQUIRED>" if system == "ext.dtd" else None)
    return found.select("doc_id", "message")


@query("""
SELECT o_orderkey doc_id, CASE o_orderkey % 3 WHEN 1 THEN 'Element <m> requires at least 1 occurrence(s) of child <q>' ELSE 'Element <m> child <p> exceeds maxOccurs (1)' END message FROM orders WHERE o_orderkey % 3 > 0
""")
def xsd_all(spark, sf_dir):
    """xs:all in any order, once each; a pattern is no violation unless asked for."""
    part = '<xs:element name="{0}"><xs:simpleType><xs:restriction base="xs:string"><xs:pattern value="[A-Z]+"/></xs:restriction></xs:simpleType></xs:element>'
    schema = f'<xs:schema xmlns:xs="u"><xs:element name="m"><xs:complexType><xs:all>{part.format("p")}{part.format("q")}</xs:all></xs:complexType></xs:element></xs:schema>'
    docs = _per_order(spark, sf_dir, "<m><q>low</q><p/></m>", "<m><p/></m>", "<m><p/><p/><q/></m>")
    return validate.validate_xsd(nodes_of(parse_xml(docs)), schema).select("doc_id", "message")
