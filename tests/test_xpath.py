import math

import pytest
from pyspark.sql import functions as F

from xylem.functions import coerce, strings
from xylem.plans.xpath import XPath
from xylem.plans.xpath_syntax import XPathError, parse

from .helpers import nodes

HARBOUR = """<harbour><ship class="ferry"><name flag="se">Alva</name><crew>12</crew><built>1998</built><draft>4.5</draft></ship>
<ship class="cargo"><name flag="no">Brage</name><crew>9</crew><crew>3</crew><built>2007</built><draft>11.25</draft></ship>
<ship class="cargo"><name flag="se">Ceres</name><built>2007</built><draft>9</draft></ship>
<tug class="inner"><name flag="dk">Dag</name><draft>2.75</draft></tug></harbour>"""
LOG = """<log xmlns="urn:log" xmlns:t="urn:tide"><entry id="n7" xml:lang="sv-FI">lugnt<em>hav</em></entry><entry id="n8" xml:lang="da">storm</entry><t:mark/><wind id="w1" speed="4"/><wind id="w2" speed="19"/><!--slut--><?ring bell?></log>"""


@pytest.fixture(scope="module")
def harbour(spark):
    return XPath(nodes(spark, HARBOUR))


@pytest.fixture(scope="module")
def log(spark):
    return XPath(nodes(spark, LOG))


def count(x, q):
    return x.nodes(q).count()


def value(x, q):
    return x.evaluate(q).first()["value"]


def test_paths(harbour):
    many = {"/harbour": 1, "//ship": 3, "/harbour/*": 4, "//ship/name": 3, "//*[@class='cargo']": 2, "/harbour/ship[2]/following-sibling::*": 2, "//anchor": 0, "//ship[crew[2]]": 1, "//crew | //draft": 7,
            "(//name)[4]": 1, "//crew/ancestor::*": 3, "//*[name/@flag='se']": 2, "//ship[last()]": 1, "//ship[position() < 3]/built": 2, "//name[@flag='dk']/..": 1, "//ship/draft/preceding-sibling::*": 9,
            "//ship[not(crew)]": 1, "//ship[built = 2007][2]": 1, "//draft[. > 5]/parent::ship/name": 2}
    assert {q: count(harbour, q) for q in many} == many


def test_counts_and_errors(harbour):
    assert value(harbour, "count(//ship)") == 3 and value(harbour, "count(//crew)") == 3
    assert value(harbour, "contains(/harbour/ship[1]/name,'lv')") is True
    assert value(harbour, "sum(//draft)") == pytest.approx(27.5)
    for bad in ("//ship[", "sail()", "", "ceiling()", "$none", "//tug]"):
        with pytest.raises(XPathError):
            harbour.evaluate(bad)
    with pytest.raises(XPathError, match="maximum nesting depth"):
        parse("(" * 140 + "7" + ")" * 140)


def test_namespaces_lang_ids(log):
    assert value(log, "namespace-uri(//t:mark)") == "urn:tide" and value(log, "namespace-uri(/*)") == "urn:log"
    assert count(log, "id('n8')") == 1 and count(log, "id('n8 w1 q')") == 2
    ids = lambda q: {r["value"] for r in log.nodes(q + "/@id").collect()}
    assert ids("//entry[lang('sv')]") == {"n7"} and ids("//entry[lang('DA')]") == {"n8"}
    log.set_variable("limit", 10)
    assert ids("//wind[@speed > $limit]") == {"w2"}
    assert count(log, "//comment()") == 1 and count(log, "//processing-instruction('ring')") == 1 and count(log, "//@*") == 10 and value(log, "string(//entry[1])") == "lugnthav"


def test_modes(spark):
    n = nodes(spark, "<r xmlns:q='u'><a/><q:b><c/></q:b><d/></r>")
    ref, w3c = XPath(n), XPath(n, "w3c")
    assert value(ref, "local-name(//q:b)") == "q:b" and value(w3c, "local-name(//q:b)") == "b"
    assert count(ref, "//q:b/following::*") == 2 and count(w3c, "//q:b/following::*") == 1
    assert count(ref, "//d/preceding::*") == 4 and count(w3c, "//d/preceding::*") == 3
    assert [x.nodes("//d/preceding-sibling::*[1]").first()["name"] for x in (ref, w3c)] == ["a", "q:b"]


def test_context_and_custom(harbour):
    ships = harbour.n.filter("name = 'ship' and kind = 'element'").select("doc_id", "node_id")
    got = {r["ctx_id"]: r["value"] for r in harbour.evaluate("count(crew)", ships).collect()}
    assert sorted(got.values()) == [0, 1, 2]
    assert harbour.evaluate("/harbour", ships).count() == 3
    harbour.register_function("half", lambda a: a / 2)
    assert value(harbour, "half(9)") == 4.5
    harbour.set_variable("set", harbour.n.filter("name = 'draft'"))
    assert value(harbour, "count($set)") == 4


@pytest.fixture(scope="module")
def plain(spark):
    return XPath(nodes(spark, "<tide><level>Low Water 7</level></tide>"))


SCALARS = {
    "floor(-0.2)": -1.0, "ceiling(6.01)": 7.0, "round(2.5)": 3.0, "round(-4.5)": -5.0, "concat('ebb','-','flow')": "ebb-flow", "substring('seaweed',4,4)": "weed", "substring-before('18:45','8')": "1",
    "substring-after('18:45',':')": "45", "normalize-space('  low   tide ')": "low tide", "translate('a-b-c','-','')": "abc", "ends-with('harbour','our')": True, "lower-case('NorTH')": "north", "upper-case('east')": "EAST",
    "replace('seesaw','s','z')": "zeezaw", "substring(//level,-3,2)": "", "substring(//level,2,-1)": "", "substring(//level,5,99999)": "Water 7", "substring(//level,4,0)": "", "2 = 2.0": True, "'3.0' = 3": False, "true() = 1": False,
    "5 div 0": math.inf, "-5 div 0": -math.inf, "-8 mod 3": -2.0, "string(0.00002)": "0.00002", "string(1e3)": None, "boolean('')": False, "not(0)": True, "string(1 div 0)": "inf", "string(0 div 0)": "NaN", "string(12.125)": "12.125", "3 < 0 div 0": False,
    "string-length('åäö')": 3.0, "starts-with('harbour','har')": True, "substring-before('b','')": "", "substring-after('b','')": "b", "replace('pq','','+')": "+p+q+", "concat()": "", "string()": "Low Water 7", "count('x')": 0.0, "- - 4": 4.0,
}


def test_scalars(plain):
    for q, want in SCALARS.items():
        if want is None:
            with pytest.raises(XPathError):
                plain.evaluate(q)
        else:
            assert value(plain, q) == want, q
    for q in ("number(' 5 ')", "number('5d')", "0 div 0", "5 mod 0"):
        assert math.isnan(value(plain, q)), q


def test_number_texts(spark):
    pairs = [(1.0, "1"), (39.95, "39.95"), (1e21, "1000000000000000000000"), (1e-7, "0.0000001"), (-1.5e-10, "-0.00000000015"), (1.25e9, "1250000000"), (123456789012.5, "123456789012.5"), (float("nan"), "NaN"), (float("inf"), "inf"), (-0.5, "-0.5")]
    got = spark.createDataFrame(pairs, "x double, s string").select("x", "s", coerce.number_to_text(F.col("x")).alias("t"), coerce.text_to_number(F.col("s")).alias("y")).collect()
    assert all(r["t"] == r["s"] for r in got), got
    assert all(r["y"] == r["x"] or math.isnan(r["x"]) for r in got)
    odd = spark.createDataFrame([("+5",), ("1e5",), ("inf",), ("-inf",), (" 5",), ("5d",), ("",), (".5",)], "s string").select(coerce.text_to_number(F.col("s")).alias("y")).collect()
    assert [r["y"] for r in odd][:4] == [5, 1e5, math.inf, -math.inf] and all(math.isnan(odd[i]["y"]) for i in (4, 5, 6)) and odd[7]["y"] == 0.5
    assert spark.range(1).select(strings.translate(F.lit("aabb"), F.lit("aab"), F.lit("xyz")).alias("t")).first()["t"] == "xxzz"
