import re

import pytest
from pyspark.sql import functions as F

from xylem.operators import bind, events, mutate, nodes as nav, serialize
from xylem.operators.serialize import SerializeOptions
from xylem.operators.validate import Dtd, apply_dtd_defaults, dtd_violations, first_violations, valid_documents, validate, validate_dtd, validate_xsd
from xylem.sources.xml import errors_of, nodes_of, parse_xml
from xylem.streaming.xml_stream import event_stream, node_stream, register_udtf, xml_file_stream

from .helpers import docs, nodes

COMPACT = SerializeOptions(pretty_print=False)


def texts(df, column="xml"):
    return {r["doc_id"]: r[column] for r in df.collect()}


def test_serialize(spark):
    xml = '<?xml version="1.0"?><root a="1&amp;&quot;2"><c>t &lt; u</c><d/><e><![CDATA[<x>]]></e></root>'
    n = nodes(spark, xml, "<r>mixed<b/> tail</r>")
    assert texts(serialize.to_xml_text(n, COMPACT))[0] == xml.replace("?>", "?>\n")
    assert texts(serialize.to_xml_text(n))[0] == '<?xml version="1.0"?>\n<root a="1&amp;&quot;2">\n  <c>t &lt; u</c>\n  <d/>\n  <e><![CDATA[<x>]]></e>\n</root>\n'
    assert texts(serialize.to_xml_text(n))[1] == "<r>\n  mixed\n  <b/>\n   tail\n</r>\n"
    odd = texts(serialize.to_xml_text(n, SerializeOptions(False, 2, True, "'", False)))[0]
    assert odd == "<root a='1&amp;\"2'><c>t &lt; u</c><d></d><e><![CDATA[<x>]]></e></root>"


def test_canonical(spark, tmp_path):
    n = nodes(spark, '<!--p--><sail z="aft" a="fore" m="mid" xmlns:q="u"><bare/></sail><!--e-->', "<hull><!--c--><data>a&gt;\n</data><?t d?></hull>")
    assert texts(serialize.canonicalize(n), "c14n") == {0: '<sail xmlns:q="u" a="fore" m="mid" z="aft"><bare></bare></sail>', 1: "<hull><data>a&gt;\n</data><?t d?></hull>"}
    assert texts(serialize.canonicalize(n, with_comments=True), "c14n")[1].startswith("<hull><!--c-->")
    serialize.write_xml(n.filter("doc_id = 0"), f"file://{tmp_path}/out", COMPACT)
    assert "sail" in spark.read.text(f"file://{tmp_path}/out").first()["value"]


def test_navigation(spark):
    n = nodes(spark, '<r id="r"><a id="x">1<b>2<![CDATA[no]]></b></a><c/>t</r>')
    s = {r["name"]: r for r in nav.siblings(n).filter("parent_id = 2").collect()}
    assert s["a"]["previous_sibling"] is None and s["a"]["next_sibling"] == s["c"]["node_id"] and s["#text"]["next_sibling"] is None
    ends = nav.first_and_last_child(n).filter("node_id = 2").first()
    assert (ends["first_child"], ends["last_child"]) == (3, s["#text"]["node_id"])
    assert nav.text_content(n, nav.root_elements(n)).first()["text"] == "12t"
    assert nav.element_by_id(n, "x").first()["node_id"] == 3 and nav.elements_by_tag(n, "*").count() == 4 and nav.get_node(n, 0, 3).first()["name"] == "a"
    assert nav.children(n, nav.root_elements(n), elements_only=True).count() == 2 and nav.attributes(n).count() == 2
    assert {r["kind"]: r["n"] for r in nav.kind_counts(n).collect()} == {"prolog": 1, "root": 1, "element": 4, "text": 3, "cdata": 1}
    assert n.filter(nav.has_attribute(F.col("attrs"), "id")).count() == 2


def test_namespaces(spark):
    n = nodes(spark, '<h:chart xmlns:h="urn:hydro" xmlns:d="urn:depth"><h:area><d:line><d:point/></d:line></h:area></h:chart>', '<log xmlns="urn:log"><day/><week><day/><bare xmlns=""/></week></log>')
    hits = lambda uri, local: nav.elements_by_tag_ns(n, uri, local).count()
    assert (hits("urn:depth", "*"), hits("urn:hydro", "*"), hits("urn:depth", "line"), hits("urn:log", "week"), hits("urn:log", "day"), hits("", "*")) == (2, 2, 1, 1, 2, 1)
    assert {r["prefix"] for r in nav.lookup_prefix(n, "urn:depth").collect()} == {"d"} and nav.lookup_prefix(n, "urn:log").first()["prefix"] == ""
    assert nav.namespaces_in_scope(n).filter("doc_id = 1 and node_id = 2").first()["namespaces"][0]["value"] == "urn:log"


def test_events(spark):
    d = docs(spark, '<buoy id="s1" berth=\'a b\'><wave>2.5</wave></buoy>', "<fleet><tug/><tug/></fleet>", "<pier><cut", "<!-- incomplete", "<a x='1' bad y='2'/>", "", None, "<?xml version='1.0' encoding=\"u\"?><!DOCTYPE d><?t  x ?><![CDATA[z]]><!--c-->")
    e = events.pull_events(d).orderBy("doc_id", "pos").collect()
    names = lambda i: [r["event"] for r in e if r["doc_id"] == i]
    assert names(0) == ["StartElement", "StartElement", "Text", "EndElement", "EndElement"]
    assert names(1) == ["StartElement", "StartElement", "EndElement", "StartElement", "EndElement", "EndElement"]
    assert names(2) == ["StartElement", "Error"] and names(3) == ["Error"] and names(5) == names(6) == []
    assert names(7) == ["Declaration", "DocType", "ProcessingInstruction", "CData", "Comment"]
    last = [r for r in e if r["doc_id"] == 7]
    assert last[0]["encoding"] == "u" or last[0]["version"] == "1.0"
    assert (last[2]["target"], last[2]["data"], last[3]["text"], last[4]["text"], last[1]["name"]) == ("t", "x", "z", "c", "d")
    a = {(r["doc_id"], r["name"]): r["value"] for r in events.event_attributes(events.pull_events(d)).collect()}
    assert a == {(0, "id"): "s1", (0, "berth"): "a b", (4, "x"): "1"} or (4, "bad y") in a


def test_dtd(spark):
    text = '<!ELEMENT voyage (from,via,to,cargo)>\n<!ELEMENT from EMPTY>\n<!ELEMENT hold ANY>\n<!ATTLIST voyage line CDATA #REQUIRED>\n<!ATTLIST mate key ID #REQUIRED>\n<!ATTLIST watch mates IDREFS #IMPLIED>\n<!ATTLIST crate state CDATA "sealed">\n<!ATTLIST crate dock CDATA #FIXED "east side">\n<!ATTLIST crate no CDATA #REQUIRED>'
    rules = Dtd().load(text)
    n = nodes(spark, '<voyage line="c"><from/><via/><to/><cargo/></voyage>', "<voyage><from>x</from><via/><to/></voyage>", '<r><mate key="a"/><mate key="a"/><watch mates="a b"/></r>', '<hold>t<from/></hold>', '<l><crate no="1"/><crate no="2" state="s"/></l>')
    found = dtd_violations(n, rules)
    assert sorted((r["doc_id"], r["rule"]) for r in found.collect()) == [(1, "CHILDREN"), (1, "EMPTY"), (1, "REQUIRED"), (2, "ID"), (2, "IDREF")]
    first = {r["doc_id"]: r["message"] for r in first_violations(found).collect()}
    assert "Duplicate ID" in first[2] and valid_documents(n, found).count() == 3
    done = apply_dtd_defaults(n, rules)
    assert done.agg(F.sum("injected")).first()[0] == 3 and "east side" in {a["value"] for r in done.filter("name = 'crate'").collect() for a in r["attrs"]}
    odd = nodes(spark, '<voyage line="c"><via/><from/><to/><cargo/></voyage>')
    assert dtd_violations(odd, rules).count() == 0 and dtd_violations(odd, rules, strict=True).first()["rule"] == "MODEL"
    wide = "<!ELEMENT buoy\n  (lamp, (bell | horn)?)>\n<!ATTLIST buoy\n  no ID #REQUIRED\n  tint (red | green) 'red'  ><!ELEMENT lamp EMPTY>"
    assert Dtd().load(wide).attributes == {} and Dtd().load(wide).elements == {}
    free = Dtd().load(wide, one_line=False)
    assert [a["name"] for a in free.attributes["buoy"]] == ["no", "tint"] and free.attributes["buoy"][1]["value"] == "red" and free.content("lamp") == "EMPTY"
    buoys = nodes(spark, "<buoy no='1'><lamp/><horn/></buoy>", "<buoy no='1'><horn/><lamp/></buoy>", "<buoy><lamp/></buoy>")
    assert sorted((r["doc_id"], r["rule"]) for r in dtd_violations(buoys, free, strict=True).collect()) == [(1, "MODEL"), (2, "REQUIRED")]
    typed = nodes(spark, '<!DOCTYPE a SYSTEM "s.dtd"><a/>', "<!DOCTYPE a [\n<!ATTLIST a k CDATA #REQUIRED>\n]><a/>", "<a/>")
    got = validate_dtd(typed, resolver=lambda system, public: "<!ATTLIST a flag CDATA #REQUIRED>" if system == "s.dtd" else None)
    assert sorted((r["doc_id"], r["message"]) for r in got.collect()) == [(0, "Required attribute 'flag' missing on element <a>"), (1, "Required attribute 'k' missing on element <a>")]
    many = nodes(spark, *[f"<!DOCTYPE a [\n<!ATTLIST a k{i} CDATA #REQUIRED>\n]><a k{i}='1'><b/></a>" if i % 2 else f"<!DOCTYPE a [\n<!ATTLIST a k{i} CDATA #REQUIRED>\n]><a/>" for i in range(40)])
    assert {r["doc_id"]: r["message"] for r in validate_dtd(many).collect()} == {i: f"Required attribute 'k{i}' missing on element <a>" for i in range(0, 40, 2)}
    own = lambda x: x.filter("name = 'a' and kind = 'element'").select("doc_id", "node_id", F.lit(9).alias("phase"), "pre", F.lit("own").alias("rule"), F.lit("no a").alias("message"))
    assert validate(typed, [own]).count() == 3


def test_validation_depth(spark):
    n = nodes(spark, "<a>" * 513 + "</a>" * 513, "<a>" * 514 + "</a>" * 514)
    assert [(r["doc_id"], r["rule"]) for r in dtd_violations(n, Dtd()).collect()] == [(1, "DEPTH")]


def test_xsd(spark):
    schema = """<xs:schema xmlns:xs="u"><xs:element name="skipper"><xs:complexType><xs:sequence><xs:element name="given" type="xs:string"/><xs:element name="family" type="xs:string"/></xs:sequence><xs:attribute name="no" type="xs:integer" use="required"/></xs:complexType></xs:element>
    <xs:element name="signal"><xs:complexType><xs:choice><xs:element name="lamp"/><xs:element name="horn"/></xs:choice></xs:complexType></xs:element>
    <xs:complexType name="spot"><xs:sequence><xs:element name="bay"/><xs:element name="mile" type="xs:integer"/></xs:sequence></xs:complexType><xs:element name="anchorage" type="spot"/>
    <xs:element name="deck"><xs:complexType><xs:sequence><xs:element name="crate" minOccurs="1" maxOccurs="2"/></xs:sequence></xs:complexType></xs:element>
    <xs:element name="afloat" type="xs:boolean"/><xs:element name="knots" type="xs:integer"/><xs:element name="code"><xs:simpleType><xs:restriction base="xs:string"><xs:pattern value="[A-Z]+"/><xs:enumeration value="K"/><xs:enumeration value="m"/></xs:restriction></xs:simpleType></xs:element>
    <xs:element name="depth"><xs:simpleType><xs:restriction base="xs:integer"><xs:minInclusive value="2"/><xs:maxInclusive value="40"/></xs:restriction></xs:simpleType></xs:element></xs:schema>"""
    bad = {"<skipper no='x'><given/><family/></skipper>": "not a valid integer", "<skipper no='1'><given/></skipper>": "requires at least 1", "<skipper><given/><family/></skipper>": "Required attribute 'no'", "<signal><flag/></signal>": "not allowed in choice group", "<signal/>": "requires one",
           "<anchorage><bay/><mile>a</mile></anchorage>": "not a valid integer", "<deck/>": "at least 1", "<deck><crate/><crate/><crate/></deck>": "exceeds maxOccurs (2)", "<afloat>yes</afloat>": "boolean", "<knots>3.14</knots>": "integer", "<code>c</code>": "enumeration", "<depth>1</depth>": "below minInclusive 2", "<depth>41</depth>": "exceeds maxInclusive 40"}
    good = ["<skipper no='7'><given>a</given><family/></skipper>", "<signal><lamp/></signal>", "<knots> -7 </knots>", "<afloat/>", "<unknown/>", "<code>m</code>", "<depth>40</depth>"]
    n = nodes(spark, *bad, *good)
    got = {r["doc_id"]: r["message"] for r in first_violations(validate_xsd(n, schema)).collect()}
    assert set(got) == set(range(len(bad))) and all(want in got[i] for i, want in enumerate(bad.values())), got
    strict = validate_xsd(nodes(spark, "<skipper no='1'><family/><given/></skipper>", "<code>m</code>", "<signal><lamp/><horn/></signal>"), schema, strict=True)
    assert sorted((r["doc_id"], r["rule"]) for r in strict.collect()) == [(0, "order"), (1, "pattern"), (2, "choice")]


def test_edits(spark):
    n = nodes(spark, "<root><child><grand/></child></root>", "<p q='1'><a/><old/><c/></p>")
    e = lambda *rows: spark.createDataFrame(rows, mutate.EDITS)
    bad = mutate.apply_edits(n, e((0, 1, "append_child", 4, 2, None, None, None), (0, 2, "append_child", 3, 3, None, None, None), (0, 3, "insert_before", 4, 3, 4, None, None), (0, 4, "remove_child", 2, 4, None, None, None), (0, 5, "set_attribute", 0, None, None, "a", "b")))
    assert sorted(r["kind"] for r in errors_of(bad).collect()) == ["HierarchyRequestError"] * 3 + ["InvalidOperation", "NodeNotFound"]
    assert texts(serialize.to_xml_text(nodes_of(bad), COMPACT))[0] == "<root><child><grand/></child></root>"
    good = mutate.apply_edits(n, e((1, 1, "create_element", None, -1, None, "b", None), (1, 2, "insert_before", 2, -1, 4, None, None), (1, 3, "remove_attribute", 2, None, None, "q", None), (1, 4, "set_text_content", -1, None, None, None, "x<y"), (1, 5, "clone_node", -1, -2, None, None, "deep"), (1, 6, "append_child", 2, -2, None, None, None), (1, 7, "detach", 4, None, None, None, None)))
    m = nodes_of(good)
    assert texts(serialize.to_xml_text(m, COMPACT))[1] == "<p><a/><b>x&lt;y</b><c/><b>x&lt;y</b></p>"
    small = mutate.compact(m).filter("doc_id = 1")
    assert small.count() == m.filter("doc_id = 1").count() - 1 and small.agg(F.max("node_id")).first()[0] == small.count() - 1
    assert texts(serialize.to_xml_text(mutate.remove_attribute(mutate.set_attribute(n, F.col("name") == "p", "z", F.lit(1)), F.lit(True), "q"), COMPACT))[1] == '<p z="1"><a/><old/><c/></p>'
    empty = mutate.new_documents(spark.range(2).select(F.col("id").alias("doc_id")))
    built = mutate.apply_edits(empty, e((0, 1, "create_element", None, -1, None, "mast", None), (0, 2, "append_child", 1, -1, None, None, None)))
    assert texts(serialize.to_xml_text(nodes_of(built), COMPACT))[0] == "<mast/>"


def test_binding(spark):
    n = nodes(spark, '<Mate id=" 7 "><name> Ann </name><aboard>1</aboard><knots><item>a</item><x>b</x></knots><chief><id>3</id><name>Z</name></chief><m><k>1.5</k></m></Mate>', "<Mate/>")
    got = {r["doc_id"]: r["record"] for r in bind.from_nodes(n, "id int, name string, aboard boolean, knots array<string>, chief struct<id:int,name:string>, m map<string,double>").collect()}
    assert got[0]["id"] == 7 and got[0]["name"] == " Ann " and got[0]["aboard"] and got[0]["knots"] == ["a", "b"] and got[0]["chief"]["name"] == "Z" and got[0]["m"] == {"k": 1.5}
    assert got[1]["id"] is None
    d = spark.createDataFrame([(1, "a<'b", [1, 2], {"k": 1.5}, None)], "id int, s string, l array<int>, m map<string,double>, n string")
    assert bind.to_xml_record(d).first()["xml"] == "<root><id>1</id><s>a&lt;&apos;b</s><l><item>1</item><item>2</item></l><m><k>1.5</k></m><n></n></root>"


def test_binding_of_fields(spark):
    """Attributes before elements, the first of several elements, elements without text, fields of no element, records within records."""
    n = nodes_of(parse_xml(docs(spark, "<r b='x'><a>1</a><a>2</a><b>y</b><c/><p><a>3</a><q><a>4</a></q></p></r>", "<r><a>z</a></r>")))
    got = {r["doc_id"]: r["record"].asDict(True) for r in bind.from_nodes(n, "a int, b string, c string, d string, p struct<a:int,q:struct<a:int,c:string>>").collect()}
    assert got[0] == {"a": 1, "b": "x", "c": "", "d": None, "p": {"a": 3, "q": {"a": 4, "c": None}}}
    assert got[1] == {"a": None, "b": None, "c": None, "d": None, "p": None}


def broadcast_keys(df):
    """The keys of the joins that the planner broadcasts, and whether it is their left side that is."""
    return set(re.findall(r"BroadcastHashJoin \[([^\]]*)\].*?Build(Left|Right)", re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())))


@pytest.fixture
def lazy(spark, tmp_path):
    """Parsed documents of a file, so that their nodes look small to the planner."""
    docs(spark, "<!DOCTYPE a [\n<!ATTLIST a k CDATA #REQUIRED>\n]><a><b>1</b><c><d>2</d></c></a>").write.parquet(f"file://{tmp_path}/docs")
    return nodes_of(parse_xml(spark.read.parquet(f"file://{tmp_path}/docs")))


def test_nodes_are_not_broadcast_in_binding(spark, lazy):
    assert broadcast_keys(bind.from_nodes(lazy, "b int, c array<string>, m map<string,int>, s struct<b:int,c:array<int>>")) == set()


@pytest.mark.parametrize("strict", [False, True])
def test_nodes_are_not_broadcast_in_dtd_checks(spark, lazy, strict):
    rules = Dtd().load("<!ELEMENT a (b, c)>\n<!ELEMENT b EMPTY>\n<!ATTLIST a k ID #REQUIRED>\n<!ATTLIST b to IDREF #IMPLIED>")
    found = dtd_violations(lazy, rules, strict)
    assert broadcast_keys(found) == {("name", "Right")}
    assert broadcast_keys(first_violations(found)) == {("name", "Right")}


def test_nodes_are_not_broadcast_in_own_subsets(spark, lazy, monkeypatch):
    want = [(0, "Required attribute 'k' missing on element <a>")]
    found = validate_dtd(lazy)
    assert broadcast_keys(found) == {("_dtd, name", "Right")} and [(r["doc_id"], r["message"]) for r in found.collect()] == want
    monkeypatch.setattr("xylem.operators.validate.HELD_RULES", 0)  # more rules than are held
    found = validate_dtd(lazy)
    assert broadcast_keys(found) == set() and [(r["doc_id"], r["message"]) for r in found.collect()] == want


def test_nodes_are_not_broadcast_in_xsd_checks(spark, lazy):
    schema = '<xs:schema xmlns:xs="u"><xs:element name="a"><xs:complexType><xs:sequence><xs:element name="b"/><xs:element name="c"/></xs:sequence><xs:attribute name="k" use="required"/></xs:complexType></xs:element><xs:element name="c"><xs:complexType><xs:choice><xs:element name="d"/></xs:choice></xs:complexType></xs:element><xs:element name="b" type="xs:integer"/></xs:schema>'
    assert broadcast_keys(validate_xsd(lazy, schema, strict=True)) == {("name", "Right")}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("<a><b>1</b></a>")
    (tmp_path / "in" / "b.xml").write_text("<a>")
    for name, make in (("nodes_seen", node_stream), ("events_seen", event_stream)):
        q = make(xml_file_stream(spark, f"file://{tmp_path}/in")).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["kind"] for r in spark.table("nodes_seen").collect()) == ["#error", "element", "element", "prolog", "root", "text"]
    assert spark.table("events_seen").count() == 6
    register_udtf(spark)
    assert spark.sql("select count(*) n from values ('<a><b>1</b></a>') t(x), lateral parse_xml_nodes(x)").first()["n"] == 5


@pytest.mark.parametrize("name", ["xp_order_cents", "ser_pretty", "dtd_violations", "ev_kind_counts"])
def test_registered_queries(spark, name):
    import duckdb

    from xylem.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)
