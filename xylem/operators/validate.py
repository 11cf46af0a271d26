"""DTD and XSD validation: rules become small frames, each check one join, and violations are rows.

A document is valid if it has no row. ``first_violations`` gives the one that a validator which stops at the first problem would report.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise, never_broadcast, prepare
from ..sources.parser import Parser

VIOLATION = ["doc_id", "node_id", "phase", "pre", "rule", "message"]
MAX_DEPTH = 512
#: Rows of rules that executors and the driver hold, at most; more are joined by a shuffle.
HELD_RULES = 10_000


def _violation(rows: DataFrame, phase: int, rule: str, message) -> DataFrame:
    return rows.select("doc_id", "node_id", F.lit(phase).alias("phase"), "pre", F.lit(rule).alias("rule"), message.alias("message"))


def _union(spark, frames: list[DataFrame]) -> DataFrame:
    out = frames[0] if frames else spark.createDataFrame([], "doc_id long, node_id int, phase int, pre int, rule string, message string")
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def first_violations(violations: DataFrame) -> DataFrame:
    """(doc_id, node_id, rule, message): the first one of each document."""
    first = violations.groupBy("doc_id").agg(F.min(F.struct("phase", "pre", "node_id", "rule", "message")).alias("v"))
    return first.select("doc_id", "v.node_id", "v.rule", "v.message")


def valid_documents(nodes: DataFrame, violations: DataFrame) -> DataFrame:
    return nodes.select("doc_id").distinct().join(violations.select("doc_id"), "doc_id", "left_anti")


def validate(nodes: DataFrame, validators: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Violations of all validators, own ones included: callables from nodes to (doc_id, node_id, phase, pre, rule, message)."""
    return _union(nodes.sparkSession, [v(nodes).select(VIOLATION) for v in validators])


def _too_deep(elements: DataFrame) -> DataFrame:
    """Elements below the depth that validation goes to, the root element at 0."""
    return _violation(elements.filter(F.col("depth") > MAX_DEPTH + 1), 0, "DEPTH", F.lit(f"Maximum validation depth of {MAX_DEPTH} exceeded"))


def _child_names(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, names): the names of each element's child elements, in order."""
    kids = nodes.filter("kind = 'element' and parent_id is not null")
    return kids.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "name")))["name"].alias("names"))


# -- DTD -------------------------------------------------------------------------------------------------------------

DECLARATION = re.compile(r"<!(ELEMENT|ATTLIST)\s+([^\s>]+)\s*((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>")
ATTRIBUTE_RULE = re.compile(r"([^\s\"']+)\s+(\([^)]*\)|\w+(?:\s*\([^)]*\))?)\s*(#REQUIRED|#IMPLIED|(?:#FIXED\s+)?(?:\"[^\"]*\"|'[^']*'))?")
MODEL_PART = re.compile(r"#?[\w:.\-]+|[(),|?*+]")
RULES = "dtd long, name string, what string, rule_no int, child string, type string, required boolean, model string"


@dataclass
class Dtd:
    """Rules of document types: content models by element, and attributes in the order of their declarations.

    With ``one_line`` (as documented for this engine) a declaration is one that stands on a line of its own, with one attribute; without
    it, declarations go over any number of lines and an ATTLIST holds any number of attributes.
    """

    elements: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, list[dict]] = field(default_factory=dict)

    def load(self, subset: str, one_line: bool = True) -> Dtd:
        for piece in subset.split("\n") if one_line else (subset,):
            found = DECLARATION.match(piece.strip()) if one_line else None
            for kind, name, rest in [found.groups()] if found else [] if one_line else DECLARATION.findall(piece):
                if kind == "ELEMENT":
                    self.elements[name] = " ".join(rest.split())
                    continue
                listed = ATTRIBUTE_RULE.findall(rest)
                for attr, kind_, default in listed[:1] if one_line else listed:
                    quoted = re.search(r"([\"'])(.*)\1$", default, re.S)
                    self.attributes.setdefault(name, []).append({"name": attr, "type": kind_, "default": default or "#IMPLIED", "value": quoted[2] if quoted else None})
        return self

    def content(self, name: str) -> str:
        """EMPTY, ANY, MIXED (character data) or CHILDREN."""
        model = self.elements[name]
        return model if model in ("EMPTY", "ANY") else "MIXED" if "#PCDATA" in model else "CHILDREN"

    def required_children(self, name: str) -> list[str]:
        """Names that a sequence without optional parts asks for; other models are not checked by presence."""
        parts = MODEL_PART.findall(self.elements[name])
        if self.content(name) != "CHILDREN" or "," not in parts or {"*", "?", "|"} & {*parts}:
            return []
        return [p for p in parts if p not in ("(", ")", ",", "+")]

    def pattern(self, name: str) -> str | None:
        """The content model as a regular expression over ``name,`` strings, for strict checking."""
        parts, content = MODEL_PART.findall(self.elements[name]), self.content(name)
        if content == "MIXED":
            allowed = [re.escape(p) + "," for p in parts if p[0] not in "#()|?*+,"]
            return "(?:" + "|".join(allowed) + ")*" if allowed else ""
        if content != "CHILDREN":
            return None
        return "".join("" if p == "," else "(?:" if p == "(" else p if p in ")|?*+" else f"(?:{re.escape(p)},)" for p in parts)

    def rows(self, key: int = 0) -> list[tuple]:
        """The rules as rows of ``RULES``, under the key of the document type."""
        out: list[tuple] = []
        for name in self.elements:
            if self.content(name) == "EMPTY":
                out.append((key, name, "empty", 0, None, None, None, None))
            out += [(key, name, "child", i, child, None, None, None) for i, child in enumerate(self.required_children(name))]
            if (model := self.pattern(name)) is not None:
                out.append((key, name, "model", 0, None, None, None, model))
        for name, listed in self.attributes.items():
            out += [(key, name, "attribute", i, a["name"], a["type"], a["default"] == "#REQUIRED", None) for i, a in enumerate(listed)]
        return out


def _dtd_checks(nodes: DataFrame, rules: DataFrame, strict: bool) -> DataFrame:
    """Violations of the nodes, which carry the key of their document type in ``_dtd``, against the rules (``RULES``): one join for each kind of rule."""
    nodes = never_broadcast(nodes)
    elements = nodes.filter((F.col("kind") == "element") & F.col("pre").isNotNull())
    of = lambda what: elements.join(rules.filter(F.col("what") == what).withColumnsRenamed({"dtd": "_dtd"}).drop("what"), ["_dtd", "name"])
    full = nodes.filter("kind in ('element', 'text')").select("doc_id", F.col("parent_id").alias("node_id"))
    out = [
        _too_deep(elements),
        _violation(of("empty").join(full, ["doc_id", "node_id"], "left_semi"), 1, "EMPTY", F.concat(F.lit("Element <"), "name", F.lit("> declared EMPTY but contains child content"))),
    ]
    if strict:
        found = of("model").join(_child_names(nodes), ["doc_id", "node_id"], "left")
        shown = F.concat(F.array_join(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.concat(n, F.lit(","))), ""), F.lit(""))
        out.append(_violation(found.filter(~F.regexp_like(shown, F.concat(F.lit("^(?:"), "model", F.lit(")$")))), 1, "MODEL", F.concat(F.lit("Content of element <"), "name", F.lit("> does not match its content model"))))
    else:
        there = nodes.filter("kind = 'element'").select("doc_id", F.col("parent_id").alias("node_id"), F.col("name").alias("child"))
        out.append(_violation(of("child").join(there, ["doc_id", "node_id", "child"], "left_anti"), 1, "CHILDREN", F.concat(F.lit("Element <"), "name", F.lit("> missing required child element <"), "child", F.lit(">"))))
    held = of("attribute").withColumn("v", F.try_element_at(F.filter("attrs", lambda a: a["name"] == F.col("child")), F.lit(1))["value"])
    out.append(_violation(held.filter("required and v is null"), 1, "REQUIRED", F.concat(F.lit("Required attribute '"), "child", F.lit("' missing on element <"), "name", F.lit(">"))))
    typed = held.filter(F.col("type").isin("ID", "IDREF", "IDREFS") & F.col("v").isNotNull())
    ids = typed.filter("type = 'ID'")
    again = ids.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "v").orderBy("pre", "rule_no"))).filter("n > 1")
    out.append(_violation(again, 0, "ID", F.concat(F.lit("Duplicate ID value '"), "v", F.lit("' in element <"), "name", F.lit(">"))))
    refs = typed.filter("type <> 'ID'").withColumn("v", F.explode(F.when(F.col("type") == "IDREFS", F.filter(F.split("v", r"(?U)\s+"), lambda x: x != "")).otherwise(F.array("v"))))
    out.append(_violation(refs.join(never_broadcast(ids.select("doc_id", "v")), ["doc_id", "v"], "left_anti"), 2, "IDREF", F.concat(F.lit("IDREF '"), "v", F.lit("' in attribute '"), "child", F.lit("' of <"), "name", F.lit("> does not match any declared ID"))))
    return _union(nodes.sparkSession, out)


def dtd_violations(nodes: DataFrame, dtd: Dtd, strict: bool = False) -> DataFrame:
    """Violations of (doc_id, node_id): EMPTY, required children, required attributes, ID uniqueness, IDREF targets.

    ``strict`` checks order and cardinality of content models, too.
    """
    rules = F.broadcast(nodes.sparkSession.createDataFrame(dtd.rows(), RULES))  # of one document type
    return _dtd_checks(nodes.withColumn("_dtd", F.lit(0).cast("long")), rules, strict)


def validate_dtd(nodes: DataFrame, dtd: Dtd | None = None, resolver: Callable[[str, str | None], str | None] | None = None, strict: bool = False, one_line: bool = True) -> DataFrame:
    """Violations against loaded rules, the external subset that ``resolver`` (system id, public id) gives, and each document's own internal subset.

    Documents are told apart by a hash of their document type. The different types become rows of rules where they stand, are written once and joined,
    however many there are; up to ``HELD_RULES`` rows are broadcast, the driver sees none of more. A resolver that raises leaves its documents with the loaded rules and their internal subset.
    """
    prepare(nodes.sparkSession)
    base = dtd or Dtd()
    own = nodes.filter("kind = 'doctype'").groupBy("doc_id").agg(F.max_by("doctype", "node_id").alias("t"))
    own = own.select("doc_id", "t", (F.xxhash64("t.public_id", "t.system_id", "t.internal_subset").bitwiseOR(1)).alias("_dtd"))

    def parsed(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for key, public, system, subset in b.itertuples(index=False, name=None):
                rules = Dtd(dict(base.elements), {k: list(v) for k, v in base.attributes.items()})
                if system is not None and resolver is not None:
                    try:
                        rules.load(resolver(system, public) or "", one_line)
                    except Exception:  # noqa: BLE001  any failure of a resolver: not there
                        pass
                rows += rules.load(subset or "", one_line).rows(int(key))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULES.split(", ")])

    kinds = own.groupBy("_dtd").agg(F.first("t").alias("t")).select("_dtd", "t.public_id", "t.system_id", "t.internal_subset")
    rules = nodes.sparkSession.createDataFrame(base.rows(), RULES).unionByName(kinds.mapInPandas(parsed, RULES))
    rules = broadcast_if_small(materialise(rules, "rules"), HELD_RULES)
    keyed = never_broadcast(nodes).join(never_broadcast(own.select("doc_id", "_dtd")), "doc_id", "left").withColumn("_dtd", F.coalesce("_dtd", F.lit(0).cast("long")))
    return _dtd_checks(keyed, rules, strict)


def apply_dtd_defaults(nodes: DataFrame, dtd: Dtd) -> DataFrame:
    """The nodes with missing attributes that have a default, and ``injected``: how many each node got."""
    pairs = [(e, [{"name": a["name"], "value": a["value"]} for a in rules if a["value"] is not None]) for e, rules in dtd.attributes.items()]
    rules = F.broadcast(nodes.sparkSession.createDataFrame(pairs, "name string, defaults array<struct<name:string,value:string>>"))
    joined = nodes.join(rules, "name", "left")
    missing = F.when((F.col("kind") == "element") & F.col("defaults").isNotNull(), F.filter("defaults", lambda d: ~F.exists("attrs", lambda a: a["name"] == d["name"])))
    joined = joined.withColumn("_m", missing).withColumn("attrs", F.when(F.col("_m").isNull(), F.col("attrs")).otherwise(F.concat("attrs", "_m")))
    return joined.withColumn("injected", F.coalesce(F.size("_m"), F.lit(0))).select(*nodes.columns, "injected")


# -- XSD -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Particle:
    """An element declaration: its name, type, how often it may stand in its group, and the facets of its own simple type."""

    name: str
    type: str
    least: int
    most: int | None
    facets: dict
    inline: int | None


def _count(text: str | None, default: int, other: int | None) -> int | None:
    """An occurrence: the default where it is absent, ``other`` where it is no number (as for unbounded)."""
    return default if text is None else int(text) if re.fullmatch(r"\+?\d+", text) else other


class Xsd:
    """A schema as flat tables, filled in one pass over its nodes: what a node means follows from its own name and its parent's.

    ``members``, ``group`` and ``attributes`` are keyed by the node of their complex type. Elements are looked up by name: the top-level ones,
    and what named types and types of top-level elements hold; among equal names a top-level element counts, else the first.
    """

    NUMBERS = frozenset(("minInclusive", "maxInclusive", "minLength", "maxLength"))

    def __init__(self, schema: str):
        tree = Parser(schema).run()
        local = [n.name.rpartition(":")[2] if n.kind == "element" else "" for n in tree]
        given = [dict(reversed(n.attrs or [])) for n in tree]

        def above(i: int, *names: str) -> bool:
            """Whether these are the names of the parent, its parent and so on."""
            for name in names:
                i = tree[i].parent
                if i is None or local[i] != name:
                    return False
            return True

        root = next(i for i, n in enumerate(tree) if n.kind == "element")
        nearest: dict[int, int] = {}
        inline: dict[int, int] = {}
        base: dict[int, str] = {}
        facets: dict[int, dict] = {}
        self.group: dict[int, str] = {}
        self.attributes: dict[int, list[tuple[str, str, bool]]] = {}
        held: dict[int, tuple[int, list[int]]] = {}
        for i, n in enumerate(tree):
            if n.kind != "element":
                continue
            up, own, what = n.parent, given[i], local[i]
            nearest[i] = i if what == "element" else nearest.get(up, i)
            if what == "complexType" and above(i, "element"):
                inline.setdefault(up, i)
            elif what in ("sequence", "choice", "all") and above(i, "complexType"):
                self.group[up], held[up] = what, (i, [])
            elif what == "element" and local[up] in ("sequence", "choice", "all") and held.get(tree[up].parent, (None,))[0] == up:
                held[tree[up].parent][1].append(i)
            elif what == "attribute" and above(i, "complexType"):
                self.attributes.setdefault(up, []).append((own.get("name", ""), own.get("type", "xs:string"), own.get("use") == "required"))
            elif what == "restriction" and above(i, "simpleType", "element"):
                base.setdefault(nearest[i], own.get("base"))
            elif "value" in own:
                mine = facets.setdefault(nearest[i], {})
                if what == "enumeration":
                    mine.setdefault(what, []).append(own["value"])
                elif what == "pattern" or (what in self.NUMBERS and re.fullmatch(r"[+-]?\d+", own["value"])):
                    mine[what] = own["value"] if what == "pattern" else int(own["value"])
        particle = {
            i: Particle(given[i].get("name", ""), given[i].get("type") or base.get(i) or "xs:string", _count(given[i].get("minOccurs"), 1, 1), _count(given[i].get("maxOccurs"), 1, None), facets.get(i, {}), inline.get(i))
            for i in nearest if local[i] == "element"
        }
        self.members = {k: [particle[i] for i in own] for k, (_, own) in held.items()}
        top = [i for i in nearest if tree[i].parent == root]
        self.types = {given[i]["name"]: i for i in top if local[i] == "complexType" and "name" in given[i]}
        holders = [inline.get(i) if local[i] == "element" else i for i in top if local[i] == "element" or "name" in given[i]]
        nested = [p for i in holders for p in self.members.get(i, ())]
        self.elements: dict[str, Particle] = {p.name: p for p in reversed(nested)} | {particle[i].name: particle[i] for i in top if local[i] == "element" and particle[i].name}

    def complex_of(self, rule: Particle) -> int | None:
        """The node of an element's complex type, if it has one."""
        return rule.inline if rule.inline is not None else self.types.get(rule.type)


INT64 = r"^[+-]?[0-9]+$"


def xsd_violations(nodes: DataFrame, xsd: Xsd, strict: bool = False) -> DataFrame:
    """Violations: attributes, sequence, all, choice, integers, booleans, ranges, lengths and enumerations; unknown elements are valid.

    ``strict`` also checks the order in a sequence, how often a choice is taken, and patterns.
    """
    spark, nodes = nodes.sparkSession, never_broadcast(nodes)
    elements = nodes.filter((F.col("kind") == "element") & F.col("pre").isNotNull())
    out = [_too_deep(elements)]
    attrs, kids, comps, simple = [], [], [], []
    for name, rule in xsd.elements.items():
        c = xsd.complex_of(rule)
        if c is not None:
            group, members = xsd.group.get(c), xsd.members.get(c, [])
            attrs += [(name, attr, kind == "xs:integer", needed) for attr, kind, needed in xsd.attributes.get(c, ())]
            if group:
                comps.append((name, group, [e.name for e in members], any(e.least > 0 for e in members), "".join(f"(?:{re.escape(e.name)},){{{e.least},{'' if e.most is None else e.most}}}" for e in members)))
            if group in ("sequence", "all"):
                kids += [(name, i, e.name, e.least, e.most if e.most is not None else (1 if group == "all" else None)) for i, e in enumerate(members)]
        else:
            f = rule.facets
            prefix, _, plain = rule.type.rpartition(":")
            simple.append((name, plain if prefix in ("xs", "xsd") else "", f.get("minInclusive"), f.get("maxInclusive"), f.get("minLength"), f.get("maxLength"), f.get("enumeration"), f.get("pattern")))
    small = lambda rows, ddl: F.broadcast(spark.createDataFrame(rows, ddl))  # noqa: E731  rules of the schema, not of the data
    text = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])
    if attrs:
        held = elements.join(small(attrs, "name string, attr string, whole boolean, required boolean"), "name").withColumn("v", F.try_element_at(F.filter("attrs", lambda a: a["name"] == F.col("attr")), F.lit(1))["value"])
        out.append(_violation(held.filter("required and v is null"), 1, "attribute", text("Required attribute '", "attr", "' missing on element <", "name", ">")))
        out.append(_violation(held.filter(F.col("whole") & F.col("v").isNotNull() & (~F.col("v").rlike(INT64) | F.col("v").try_cast("bigint").isNull())), 1, "attribute", text("Attribute '", "attr", "' on element <", "name", "> is not a valid integer")))
    if kids:
        counts = nodes.filter("kind = 'element'").groupBy("doc_id", F.col("parent_id").alias("node_id"), F.col("name").alias("child")).agg(F.count("*").alias("n"))
        held = elements.join(small(kids, "name string, rule_no int, child string, least int, most int"), "name").join(counts, ["doc_id", "node_id", "child"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        out.append(_violation(held.filter("n < least"), 2, "occurs", text("Element <", "name", "> requires at least ", "least", " occurrence(s) of child <", "child", ">")))
        out.append(_violation(held.filter("n > most"), 2, "occurs", text("Element <", "name", "> child <", "child", "> exceeds maxOccurs (", "most", ")")))
    choices = [c[:4] for c in comps if c[1] == "choice"]
    if choices:
        held = elements.join(small(choices, "name string, compositor string, allowed array<string>, needed boolean"), "name").join(_child_names(nodes), ["doc_id", "node_id"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
        out.append(_violation(held.filter("needed and size(names) = 0"), 2, "choice", text("Element <", "name", "> requires one of its choice elements")))
        odd = held.select("*", F.explode("names").alias("child")).filter(~F.array_contains("allowed", F.col("child")))
        out.append(_violation(odd, 2, "choice", text("Element <", "child", "> is not allowed in choice group of <", "name", ">")))
        if strict:
            out.append(_violation(held.filter("size(names) > 1"), 2, "choice", text("Element <", "name", "> holds more than one choice")))
    if strict and any(c[1] == "sequence" for c in comps):
        held = elements.join(small([(c[0], c[4]) for c in comps if c[1] == "sequence"], "name string, model string"), "name").join(_child_names(nodes), ["doc_id", "node_id"], "left")
        shown = F.concat(F.array_join(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.concat(n, F.lit(","))), ""), F.lit(""))
        out.append(_violation(held.filter(~F.regexp_like(shown, F.concat(F.lit("^"), "model", F.lit("$")))), 2, "order", text("Children of <", "name", "> are not in the order of its sequence")))
    if simple:
        rules = small(simple, "name string, type string, low long, high long, short int, long int, options array<string>, pattern string")
        texts = nodes.filter("kind = 'text'").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "value")))["value"], "").alias("t"))
        held = elements.join(rules, "name").join(texts, ["doc_id", "node_id"], "left").withColumn("t", F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)^\s+|\s+$", ""))
        held = held.withColumn("i", F.when(F.col("t").rlike(INT64), F.col("t").try_cast("bigint")))
        full = F.col("t") != ""
        number = (F.col("type") == "integer") & full
        for test, rule, message in (
            (number & F.col("i").isNull(), "integer", text("Element <", "name", "> value '", "t", "' is not a valid integer")),
            (number & (F.col("i") < F.col("low")), "range", text("Element <", "name", "> value ", "i", " is below minInclusive ", "low")),
            (number & (F.col("i") > F.col("high")), "range", text("Element <", "name", "> value ", "i", " exceeds maxInclusive ", "high")),
            ((F.col("type") == "boolean") & full & ~F.col("t").isin("true", "false", "1", "0"), "boolean", text("Element <", "name", "> value '", "t", "' is not a valid boolean")),
            (F.length("t") < F.col("short"), "length", text("Element <", "name", "> length is below minLength ", "short")),
            (F.length("t") > F.col("long"), "length", text("Element <", "name", "> length exceeds maxLength ", "long")),
            (F.col("options").isNotNull() & ~F.array_contains("options", F.col("t")), "enumeration", text("Element <", "name", "> value '", "t", "' is not in the enumeration")),
            *(((F.col("pattern").isNotNull() & ~F.regexp_like("t", F.concat(F.lit("^(?:"), "pattern", F.lit(")$"))), "pattern", text("Element <", "name", "> value '", "t", "' does not match its pattern")),) if strict else ()),
        ):
            out.append(_violation(held.filter(test), 3, rule, message))
    return _union(spark, out)


def validate_xsd(nodes: DataFrame, schema: str | Xsd, strict: bool = False) -> DataFrame:
    return xsd_violations(nodes, schema if isinstance(schema, Xsd) else Xsd(schema), strict)
