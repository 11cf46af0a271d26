from dataclasses import replace

import pytest

from xylem.sources.parser import Entities, ParseOptions, Parser, XmlProblem
from xylem.sources.xml import decode_bytes, docs_of, parse_xml, read_xml_files

from .helpers import docs, errors, nodes

O = ParseOptions()


def run(text, **limits):
    return Parser(text, replace(O, **limits)).run()


def fails(text, message="", kind=None, **limits):
    with pytest.raises(XmlProblem) as e:
        run(text, **limits)
    assert message in e.value.message
    assert kind is None or e.value.kind == kind


def test_ids_order_and_intervals():
    n = run('<?xml version="1.0" encoding="x" standalone="yes"?><!--c--><?t action="run"?><r a="1"><a/><b>x<c/>y</b></r><!--e--><?p?>')
    assert [x.kind for x in n] == ["prolog", "root", "declaration", "comment", "pi", "element", "element", "element", "text", "element", "text", "comment", "pi"]
    assert n[2].extra == ("1.0", "x", True) and n[4].value == 'action="run"' and n[5].attrs == [("a", "1")]
    assert [x.pre for x in n] == [0, 4, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12]
    assert (n[0].end, n[1].end, n[5].end, n[7].end) == (3, 12, 10, 10) and n[1].children == 3


def test_attributes_and_text():
    n = run("<A number='1' away = \"  15  \" flat='x&amp;y'>t &lt; &#x20AC;&#65;<![CDATA[<raw & x>]]></A>")
    assert n[2].attrs == [("number", "1"), ("away", "  15  "), ("flat", "x&y")]
    assert n[3].value == "t < €A" and n[4].value == "<raw & x>" and n[4].kind == "cdata"
    assert run("<note title='测试'>𝄞</note>")[3].value == "𝄞"
    assert run("<a>&e;</a>".replace("&e;", ""))[2].children == 0


def test_entities():
    dtd = '<!DOCTYPE log [\n<!ENTITY port "Kiel">\n<!ENTITY mark "pier 7">\n]><log>&port;, &mark;</log>'
    assert run(dtd)[4].value == "Kiel, pier 7"
    e = Entities()
    e.names |= {"berth": "B &side; 2", "side": "lee", "a": "&b;", "b": "&a;"}
    assert e.expand("&berth;") == "B lee 2"
    for bad in ("&adrift;", "&a;", "&#xD800;", "&#zz;", "& no end"):
        with pytest.raises(XmlProblem):
            e.expand(bad)
    fails("<!DOCTYPE l [\n<!ENTITY a \"&lt;&lt;&lt;\">\n]><l>&a;&a;</l>", "expansion size", "SecurityLimitExceeded", max_total_entity_expansion_size=5)
    fails('<!DOCTYPE r [\n<!ENTITY x SYSTEM "chart.txt">\n]><r>&x;</r>', "External entity", "SecurityLimitExceeded")


def test_entity_bombs():
    """Every byte of an expansion counts, plain text of the entities included; what fits the limit is expanded."""
    wave = lambda levels: "<!DOCTYPE s [\n" + "\n".join(f'<!ENTITY w{i} "{"&w%d;" % (i - 1) * 10 if i else "foam"}">' for i in range(levels)) + f"\n]><s>&w{levels - 1};</s>"
    fails(wave(6), "expansion size", "SecurityLimitExceeded", max_total_entity_expansion_size=1000)
    fails(wave(12), "expansion size", "SecurityLimitExceeded")
    assert run(wave(3))[4].value == "foam" * 100
    fails(wave(3), "expansion size", "SecurityLimitExceeded", max_total_entity_expansion_size=399)
    assert run(wave(3), max_total_entity_expansion_size=400)[4].value == "foam" * 100
    fails("<!DOCTYPE s [\n<!ENTITY w \"åä\">\n]><s k='&w;&w;'/>", "expansion size", "SecurityLimitExceeded", max_total_entity_expansion_size=7)


def test_external_entities_by_a_resolver():
    text = '<!DOCTYPE s [\n<!ENTITY x SYSTEM "chart.txt">\n<!ENTITY y PUBLIC "p" "missing">\n]><s>&x;</s>'
    known = {"chart.txt": "depth &lt; 4"}
    n = Parser(text, replace(O, allow_external_entities=True, entity_resolver=lambda public, system: known.get(system))).run()
    assert [x.value for x in n if x.kind == "text"] == ["depth < 4"]
    with pytest.raises(XmlProblem) as e:
        Parser(text.replace("&x;", "&y;"), replace(O, allow_external_entities=True, entity_resolver=lambda public, system: known.get(system))).run()
    assert e.value.kind == "Entity"


def test_plain_documents_read_as_others(spark):
    """The fast way of plain documents gives what the parser gives, and leaves all others to it."""
    import random

    from xylem.sources.xml import nodes_of

    rnd = random.Random(3)
    parts = ["<a>", "</a>", "<b/>", '<b x="1">', "</b>", "t", " ", "<a y='2' z=\"&amp;\"/>", "<!--c-->", '<a x="1" x="2"/>', ">", "<c >", "</c >", "\n", '<a k="" j="<">', "é", "<é/>", "\x01"]
    some = ["".join(rnd.choice(parts[:12] if rnd.random() < 0.7 else parts) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    some = [f"<a>{t}</a>" if rnd.random() < 0.9 else t for t in some] + ["", " ", "<a>" * 1100 + "</a>" * 1100]
    got: dict = {}
    for r in parse_xml(docs(spark, *some)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    kept = 0
    for i, t in enumerate(some):
        rows = sorted(got[i], key=lambda r: r["node_id"])
        try:
            want = Parser(t).run()
        except XmlProblem as e:
            assert [(r["kind"], r["error"]["message"]) for r in rows] == [("#error", e.message)], t
            continue
        kept += 1
        assert [(r["parent_id"], r["ord"], r["depth"], r["pre"], r["end"], r["kind"], r["name"], r["value"], None if r["attrs"] is None else [tuple(a) for a in r["attrs"]]) for r in rows] == [(n.parent, n.ord, n.depth, n.pre, n.end, n.kind, n.name, n.value, n.attrs) for n in want], t
        assert [r["leaf_text"] for r in rows if r["kind"] == "element"] == ["".join(n.texts or ()) if not n.elements else None for n in want if n.kind == "element"], t
    assert kept > 300 and nodes_of(parse_xml(docs(spark, "<a/>"))).count() == 3


@pytest.mark.parametrize(("text", "message"), [
    ("<root><child>", "Unclosed element <child>"), ("<root></other>", "Mismatched closing tag: expected </root>, found </other>"), ("<first/><second/>", "Multiple root elements"),
    ("<a/>tail", "Unexpected trailing content"), ("<a>\x01</a>", "Forbidden XML character '\\u{1}'"), ("<a x='1' x='2'/>", "Duplicate attribute 'x' on element <a>"), ("<a x/>", ""), ("<a x=1/>", ""),
    ("<a x='1/>", ""), ("<a><![CDATA[x</a>", "Unterminated CDATA section"), ("<a><!-- x</a>", ""), ("<a><?pi x</a>", ""), ("<!DOCTYPE a [ <a/>", "Unclosed DOCTYPE declaration"), ("", ""), ("  ", ""), ("text", ""),
    ("<?xml version='1.0'", "Unclosed XML declaration"), ("<a></a", "Expected '>'"),
])
def test_malformed(text, message):
    fails(text, message, "Syntax")


def test_limits():
    deep = "<a>" * 50 + "</a>" * 50
    fails(deep, "nesting depth", "SecurityLimitExceeded", max_nesting_depth=20)
    fails("<a>" * 1050 + "</a>" * 1050, "", "SecurityLimitExceeded", max_nesting_depth=100)
    assert len(run(deep)) == 52
    fails("<a><b/><b/></a>", "", "SecurityLimitExceeded", max_element_count=2)
    fails("<a x='1' y='2'/>", "", "SecurityLimitExceeded", max_attribute_count=1)
    fails("<a x='1' y='2'><b x='1' y='2'/></a>", "", "SecurityLimitExceeded", max_total_attribute_count=3)
    fails("<a>" + "x" * 30 + "</a>", "", "SecurityLimitExceeded", max_text_node_size=20)
    fails("<a>" + "x" * 30 + "</a>", "", "SecurityLimitExceeded", max_xml_size=20)


def test_parse_stage(spark):
    got = errors(spark, "<a>\r\n<b>\r</a>", "<a/>", None, "<x></y>")
    assert set(got) == {0, 2, 3} and (got[0]["line"], got[0]["kind"]) == (3, "Syntax") and got[2]["message"] == "No document"
    parsed = parse_xml(docs(spark, "<?xml version='1.1'?><!DOCTYPE r SYSTEM 's.dtd'><r k='v'>a\r\nb<c>t<![CDATA[u]]></c></r>", "<x"))
    rows = {r["node_id"]: r for r in parsed.collect() if r["doc_id"] == 0}
    assert rows[5]["value"] == "a\nb" and rows[6]["leaf_text"] == "tu" and rows[3]["doctype"]["system_id"] == "s.dtd" and rows[2]["decl"]["version"] == "1.1" and rows[4]["leaf_text"] is None
    d = {r["doc_id"]: r for r in docs_of(parsed).collect()}
    assert (d[0]["root_elem_id"], d[0]["decl_id"], d[0]["dtd_id"], d[0]["n_nodes"]) == (4, 2, 3, 9) and d[1]["error"]["kind"] == "Syntax" and d[1]["n_nodes"] == 0
    assert parse_xml(docs(spark, "<a/>").limit(0)).count() == 0
    assert nodes(spark, "<a/>", "<a/>").filter("kind = 'element'").count() == 2


def test_decoding(spark, tmp_path):
    def decoded(data, encoding=None):
        df = spark.createDataFrame([(bytearray(data),)], "b binary")
        return tuple(df.select(*[c.alias(n) for c, n in zip(decode_bytes(df.b, encoding), "tkp", strict=True)]).first())

    assert decoded("é".encode()) == ("é", "utf8", None)
    assert decoded(b"\xef\xbb\xbf<a/>") == ("<a/>", "utf8bom", None)
    assert decoded(b"\xff\xfe" + "<é/>".encode("utf-16-le") + b"x") == ("<é/>", "utf16le", None)
    assert decoded(b"\xfe\xff" + "<é/>".encode("utf-16-be")) == ("<é/>", "utf16be", None)
    assert decoded(b"\xff\xff")[0] is None and decoded(b"\xff\xff")[2]
    assert decoded("München".encode("latin-1"), "latin1")[0] == "München"
    assert decoded(b"\x80 \x99 \x81", "CP1252")[0] == "€ ™ \x81"
    assert decoded(b"a\xff", "ascii")[2] and decoded(b"ab", "US-ASCII")[0] == "ab"
    assert "Unsupported" in decoded(b"a", "koi8")[2]
    (tmp_path / "a.xml").write_bytes(b"<a>1</a>")
    (tmp_path / "b.xml").write_bytes(b"<a>" + b"1" * 2000 + b"</a>")
    got = {r["path"][-5:]: r for r in read_xml_files(spark, f"file://{tmp_path}/*.xml", max_bytes=1024).collect()}
    assert got["a.xml"]["xml"] == "<a>1</a>" and got["b.xml"]["xml"] is None and "exceeds" in got["b.xml"]["problem"]


def test_expand_entities(spark):
    from pyspark.sql import functions as F

    from xylem.functions.entities import expand_entities

    rows = [("a &lt; &x; &#65;",), ("plain",), (None,), ("&nope;",)]
    got = spark.createDataFrame(rows, "t string").select(expand_entities(F.col("t"), {"x": "y &amp; z"}).alias("o")).collect()
    assert [r["o"] for r in got] == ["a < y & z A", "plain", None, None]
