"""XPath over the node table: expressions become joins, windows and aggregates on ``doc_id``.

A context frame has a row for each context node: (doc_id, cid, node columns), with ``cid`` telling contexts apart. A step joins the nodes on
``doc_id`` and the axis' condition on parents, order among siblings or pre-order intervals; predicates that need positions are windows over
(doc_id, cid, context node), the others are filters or semi joins. Strings of elements that hold child elements are put together only where an
expression consumes them.

``mode="reference"`` keeps the documented deviations (``following`` with descendants, ``preceding-sibling[1]`` as the first in document order,
``local-name()`` with its prefix); ``mode="w3c"`` follows the recommendation.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce, strings
from ..operators import nodes as nav
from .xpath_syntax import XPathError, parse, uses_position

NODE = ["node_id", "parent_id", "ord", "depth", "pre", "end", "kind", "name", "value", "leaf_text", "attrs", "apos"]
KEYS = ["doc_id", "cid"]
_number = itertools.count()


@dataclass
class Value:
    """``kind``: num, str, bool (a column of the frame), or nodes (a frame of its own)."""

    kind: str
    column: Column | None = None
    frame: DataFrame | None = None
    unique: bool = False


class XPath:
    """Evaluates expressions over one node table, which should be partitioned by ``doc_id`` where many are asked."""

    def __init__(self, nodes: DataFrame, mode: str = "reference"):
        self.n = nodes.withColumn("apos", F.lit(0))
        self.w3c = mode == "w3c"
        self.functions: dict[str, tuple[Callable, str]] = {}
        self.variables: dict[str, object] = {}

    # -- what users call -------------------------------------------------------------------------------------------

    def register_function(self, name: str, fn: Callable[..., Column], returns: str = "num") -> None:
        """A function of columns (converted arguments: texts and numbers) to a column; built-in names win. ``returns``: num, str or bool."""
        self.functions[name] = (fn, returns)

    def set_variable(self, name: str, value) -> None:
        """A number, text, boolean, or a DataFrame (doc_id, node_id)."""
        self.variables[name] = value

    def evaluate(self, query: str, context: DataFrame | None = None) -> DataFrame:
        """(doc_id, ctx_id, value) of a scalar expression, (doc_id, ctx_id, node columns) of a node set; contexts (doc_id, node_id) default to the root."""
        frame, value = self._top(query, context)
        ctx = F.element_at("cid", 1).alias("ctx_id")
        if value.kind == "nodes":
            return value.frame.select("doc_id", ctx, *NODE)
        return frame.select("doc_id", ctx, value.column.alias("value"))

    def nodes(self, query: str, context: DataFrame | None = None) -> DataFrame:
        """The node set of an expression; none for a scalar one."""
        out = self.evaluate(query, context)
        return out if "node_id" in out.columns else self.n.select("doc_id", F.lit(1).alias("ctx_id"), *NODE).filter(F.lit(False))

    def _top(self, query: str, context: DataFrame | None) -> tuple[DataFrame, Value]:
        e = parse(query)
        rows = self.n.filter("node_id = 1") if context is None else self.n.join(context.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"])
        frame = rows.select("doc_id", F.array("node_id").alias("cid"), *NODE, F.lit(1).alias("pos"), F.lit(1).alias("size"))
        self._root = frame if context is None else None
        return self._value(e, frame)

    # -- expressions -----------------------------------------------------------------------------------------------

    def _value(self, e, frame: DataFrame) -> tuple[DataFrame, Value]:
        kind = e[0]
        if kind == "num":
            return frame, Value("num", F.lit(e[1]))
        if kind == "str":
            return frame, Value("str", F.lit(e[1]))
        if kind == "neg":
            frame, x = self._as("num", e[1], frame)
            return frame, Value("num", F.lit(0.0) - x)
        if kind == "var":
            return frame, self._variable(e[1], frame)
        if kind == "path":
            return self._path(e, frame)
        if kind == "bin":
            return self._binary(e, frame)
        return self._call(e[1], e[2], frame)

    def _variable(self, name: str, frame: DataFrame) -> Value:
        if name not in self.variables:
            raise XPathError(f"Unbound variable reference '${name}'")
        v = self.variables[name]
        if isinstance(v, DataFrame):
            rows = frame.select(*KEYS).join(v.select("doc_id", "node_id").distinct(), "doc_id").join(self.n, ["doc_id", "node_id"])
            return Value("nodes", frame=rows.select(*KEYS, *NODE))
        return Value("bool" if isinstance(v, bool) else "str" if isinstance(v, str) else "num", F.lit(v if isinstance(v, (bool, str)) else float(v)))

    def _as(self, want: str, e, frame: DataFrame) -> tuple[DataFrame, Column]:
        frame, v = self._value(e, frame)
        if v.kind == "nodes":
            if want == "bool":
                return self._attach(frame, v.frame, F.lit(True), F.lit(False))
            frame, text = self._first_text(frame, v.frame)
            return frame, text if want == "str" else coerce.text_to_number(text)
        how = {"num": coerce.to_number, "str": coerce.to_text, "bool": coerce.to_bool}[want]
        return frame, how(v.column, v.kind)

    def _attach(self, frame: DataFrame, rows: DataFrame, aggregate: Column, default: Column) -> tuple[DataFrame, Column]:
        """A column of the frame from an aggregate of ``rows`` by context, with a default for contexts without rows."""
        name = f"_v{next(_number)}"
        found = rows.groupBy(*KEYS).agg((F.max(aggregate) if aggregate is not None and _is_literal(aggregate) else aggregate).alias(name))
        return frame.join(found, KEYS, "left"), F.coalesce(F.col(name), default)

    def _first_text(self, frame: DataFrame, rows: DataFrame) -> tuple[DataFrame, Column]:
        first = rows.groupBy(*KEYS).agg(F.min(F.struct("node_id", "apos", "pre", "end", "kind", "leaf_text")).alias("_f")).select(*KEYS, "_f.*")
        return self._attach(frame, self._strings(first), F.max("_text"), F.lit(""))

    def _strings(self, rows: DataFrame) -> DataFrame:
        """``_text``: the string value of each row's node."""
        texts = self.n.filter("kind in ('text', 'cdata') and pre is not null").select("doc_id", F.col("pre").alias("_tp"), F.col("value").alias("_tv"))
        wide = rows.filter("leaf_text is null and apos = 0 and kind in ('element', 'root', 'prolog')").select("doc_id", "pre", "end").distinct()
        joined = wide.join(texts, "doc_id").filter("_tp > pre and _tp <= end").groupBy("doc_id", "pre").agg(F.array_sort(F.collect_list(F.struct("_tp", "_tv"))).alias("_parts"))
        joined = joined.select("doc_id", F.col("pre").alias("_p"), F.array_join("_parts._tv", "").alias("_whole")).withColumnRenamed("doc_id", "_d")
        return rows.join(joined, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_p")) & F.col("leaf_text").isNull(), "left").withColumn("_text", F.coalesce("leaf_text", "_whole", F.lit(""))).drop("_d", "_p", "_whole")

    def _binary(self, e, frame: DataFrame) -> tuple[DataFrame, Value]:
        _, op, l, r = e
        if op == "|":
            frame, a = self._value(l, frame)
            frame, b = self._value(r, frame)
            if a.kind != "nodes" or b.kind != "nodes":
                raise XPathError("Union of something that is no node set")
            both = a.frame.select(*KEYS, *NODE).unionByName(b.frame.select(*KEYS, *NODE))
            return frame, Value("nodes", frame=both.dropDuplicates([*KEYS, "node_id", "apos"]))
        want = "bool" if op in ("or", "and") else "str" if op in ("=", "!=") else "num"
        frame, a = self._as(want, l, frame)
        frame, b = self._as(want, r, frame)
        if want == "bool":
            return frame, Value("bool", a | b if op == "or" else a & b)
        if want == "str":
            return frame, Value("bool", a == b if op == "=" else a != b)
        if op in ("<", "<=", ">", ">="):
            return frame, Value("bool", coerce.compare(op, a, b))
        make = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "div": lambda: coerce.divide(a, b), "mod": lambda: coerce.remainder(a, b)}
        return frame, Value("num", make[op]())

    # -- paths -----------------------------------------------------------------------------------------------------

    def _path(self, e, frame: DataFrame) -> tuple[DataFrame, Value]:
        _, absolute, start, steps, preds = e
        if start is None and not absolute and len(steps) == 1 and steps[0][0] == "attribute" and steps[0][1][0] == "name" and not self.w3c:
            return frame, Value("str", nav.attribute(F.col("attrs"), steps[0][1][1]))
        at_root = False
        if start is not None:
            frame, v = self._value(start, frame)
            if v.kind != "nodes":
                raise XPathError("A path or predicate after something that is no node set")
            rows, unique = v.frame, v.unique
            for p in preds:
                rows = self._predicate(rows.withColumn("c_node", F.lit(0)).withColumn("c_apos", F.lit(0)), p, [F.col("node_id"), F.col("apos")])
            rows = rows.select(*KEYS, *NODE)
        elif absolute:
            at_root = frame is self._root
            rows = frame.select(*KEYS, *NODE) if at_root else frame.select(*KEYS).join(self.n.filter("node_id = 1"), "doc_id").select(*KEYS, *NODE)
            unique = True
        else:
            at_root = frame is self._root
            rows, unique = frame.select(*KEYS, *NODE), True
        for i, (axis, test, step_preds) in enumerate(steps):
            rows, unique = self._step(rows, axis, test, step_preds, unique, at_root and i == 0)
        return frame, Value("nodes", frame=rows, unique=unique)

    def _step(self, rows: DataFrame, axis: str, test, preds, unique: bool, at_root: bool) -> tuple[DataFrame, bool]:
        if at_root and axis in ("descendant", "child"):
            # From the root of each document: a filter on the nodes and no join.
            where = "parent_id = 1" if axis == "child" else "pre is not null and node_id > 1 and parent_id <> 0"
            joined = self.n.filter(where).withColumn("cid", F.array(F.lit(1))).withColumn("c_node", F.lit(1)).withColumn("c_apos", F.lit(0))
            order, keeps = [F.col("ord" if axis == "child" else "pre")], True
        elif axis == "self":
            joined = rows.withColumn("c_node", F.col("node_id")).withColumn("c_apos", F.col("apos"))
            order, keeps = [F.col("node_id")], True
        elif axis in ("attribute", "namespace"):
            joined, order, keeps = self._attributes(rows, axis), [F.col("apos")], True
        else:
            joined, order, keeps = self._axis(rows, axis)
        joined = joined.filter(self._test(test, axis))
        for p in preds:
            joined = self._predicate(joined, p, order)
        out = joined.select(*KEYS, *NODE)
        if unique and keeps:
            return out, True
        return out.dropDuplicates([*KEYS, "node_id", "apos"]), True

    def _axis(self, rows: DataFrame, axis: str) -> tuple[DataFrame, list[Column], bool]:
        c = rows.select(
            F.col("doc_id").alias("c_doc"), "cid", F.col("node_id").alias("c_node"), F.col("parent_id").alias("c_parent"), F.col("ord").alias("c_ord"),
            F.col("pre").alias("c_pre"), F.col("end").alias("c_end"), F.col("apos").alias("c_apos"), F.col("kind").alias("c_kind"),
        )
        n = F.col
        whole = n("c_apos") == 0
        conditions = {
            "child": whole & (n("parent_id") == n("c_node")),
            "descendant": whole & (n("pre") > n("c_pre")) & (n("pre") <= n("c_end")),
            "descendant-or-self": whole & (n("pre") >= n("c_pre")) & (n("pre") <= n("c_end")),
            "parent": n("node_id") == F.when(whole, n("c_parent")).otherwise(n("c_node")),
            "ancestor": (n("pre") < n("c_pre")) & (n("c_pre") <= n("end")),
            "ancestor-or-self": (n("pre") <= n("c_pre")) & (n("c_pre") <= n("end")),
            "following-sibling": whole & (n("parent_id") == n("c_parent")) & (n("ord") > n("c_ord")),
            "preceding-sibling": whole & (n("parent_id") == n("c_parent")) & (n("ord") < n("c_ord")),
            "following": (n("pre") > n("c_end")) if self.w3c else n("node_id") > n("c_node"),
            "preceding": (n("end") < n("c_pre")) if self.w3c else n("node_id") < n("c_node"),
        }
        joined = c.join(self.n, (n("c_doc") == n("doc_id")) & conditions[axis]).drop("c_doc")
        down = [F.col("node_id")]
        if axis in ("ancestor", "ancestor-or-self", "preceding") or (axis == "preceding-sibling" and self.w3c):
            down = [F.desc("node_id")]
        elif axis.endswith("sibling") or axis == "child":
            down = [F.col("ord")]
        return joined, down, axis == "child"

    def _attributes(self, rows: DataFrame, axis: str) -> DataFrame:
        base = rows.filter("apos = 0 and kind = 'element'")
        if axis == "namespace":
            base = base.drop("attrs").join(nav.namespaces_in_scope(self.n).withColumnRenamed("namespaces", "attrs"), ["doc_id", "node_id"])
        out = base.select("*", F.col("node_id").alias("c_node"), F.lit(0).alias("c_apos"), F.posexplode("attrs").alias("_at", "_a"))
        return out.withColumns({"kind": F.lit(axis), "name": F.col("_a.name"), "value": F.col("_a.value"), "leaf_text": F.col("_a.value"), "apos": F.col("_at") + 1, "attrs": F.lit(None).cast(self.n.schema["attrs"].dataType)}).drop("_at", "_a")

    def _test(self, test, axis: str) -> Column:
        kind = F.col("kind")
        if test[0] == "node":
            return F.lit(True)
        if axis in ("attribute", "namespace"):
            return F.lit(True) if test[0] == "any" else F.col("name") == test[1] if test[0] == "name" else F.lit(False)
        if test[0] == "any":
            return kind == "element"
        if test[0] in ("text", "comment"):
            return kind == test[0]
        if test[0] == "pi":
            return (kind == "pi") & (F.lit(True) if test[1] is None else F.col("name") == test[1])
        if test[1].endswith(":*"):
            return (kind == "element") & F.startswith("name", F.lit(test[1][:-1]))
        return kind.isin("element", "pi", "doctype") & (F.col("name") == test[1])

    def _predicate(self, rows: DataFrame, p, order: list[Column]) -> DataFrame:
        """Rows (doc_id, cid, c_node, c_apos, node columns) that a predicate keeps, with positions by the axis' order."""
        group = Window.partitionBy("doc_id", "cid", "c_node", "c_apos")
        place = F.row_number().over(group.orderBy(*order))
        columns = rows.columns
        if p[0] == "num":
            n = int(p[1]) if abs(p[1]) < 2**31 else -1
            return rows.withColumn("_r", place).filter(F.col("_r") == n).select(columns)
        inner = rows.withColumn("outer_cid", F.col("cid"))
        numeric = uses_position(p) or p[0] in ("var", "neg", "call", "bin")
        inner = inner.withColumns({"pos": place if numeric else F.lit(1), "size": F.count("*").over(group) if numeric else F.lit(1)})
        inner = inner.withColumn("cid", F.concat("cid", F.array("c_node", "c_apos", "node_id", "apos")))
        root, self._root = self._root, None
        inner, v = self._value(p, inner)
        self._root = root
        if v.kind == "nodes":
            kept = inner.join(v.frame.select(*KEYS).distinct(), KEYS, "left_semi")
        elif v.kind == "num":
            kept = inner.filter(F.when(F.isnan(v.column), F.lit(False)).otherwise(F.signum(v.column) * F.floor(F.abs(v.column)) == F.col("pos")))
        else:
            kept = inner.filter(coerce.to_bool(v.column, v.kind))
        return kept.withColumn("cid", F.col("outer_cid")).select(columns)

    # -- functions -------------------------------------------------------------------------------------------------

    def _call(self, name: str, args: tuple, frame: DataFrame) -> tuple[DataFrame, Value]:
        if name in _SCALAR:
            kinds, least, returns, make = _SCALAR[name]
            if not least <= len(args) <= len(kinds) and name != "concat":
                raise XPathError(f"{name}() expects {least if least == len(kinds) else f'{least} to {len(kinds)}'} argument(s)")
            if not args and name in ("string", "string-length", "normalize-space", "number"):
                args = (("path", False, None, (("self", ("node",), ()),), ()),)
            columns = []
            for i, a in enumerate(args):
                frame, c = self._as(kinds[min(i, len(kinds) - 1)], a, frame)
                columns.append(c)
            return frame, Value(returns, make(*columns))
        if name in ("true", "false"):
            return frame, Value("bool", F.lit(name == "true"))
        if name in ("position", "last"):
            return frame, Value("num", F.col("pos" if name == "position" else "size").cast("double"))
        if name in ("count", "sum"):
            self._arity(name, args, 1, 1)
            frame, v = self._value(args[0], frame)
            if v.kind != "nodes":
                return frame, Value("num", F.lit(0.0))
            if name == "count":
                frame, c = self._attach(frame, v.frame, F.count("*").cast("double"), F.lit(0.0))
            else:
                x = coerce.text_to_number(F.col("_text"))
                frame, c = self._attach(frame, self._strings(v.frame), F.sum(F.when(F.isnan(x), 0.0).otherwise(x)), F.lit(0.0))
            return frame, Value("num", c)
        if name in ("name", "local-name", "namespace-uri"):
            return self._name(name, args, frame)
        if name == "id":
            return self._id(args, frame)
        if name == "lang":
            return self._lang(args, frame)
        if name in self.functions:
            fn, returns = self.functions[name]
            columns = []
            for a in args:
                frame, v = self._value(a, frame)
                if v.kind == "nodes":
                    frame, c = self._first_text(frame, v.frame)
                else:
                    c = v.column
                columns.append(c)
            return frame, Value(returns, fn(*columns))
        raise XPathError(f"Unknown XPath function: '{name}'")

    @staticmethod
    def _arity(name: str, args: tuple, least: int, most: int) -> None:
        if not least <= len(args) <= most:
            raise XPathError(f"{name}() expects {most} argument(s)")

    def _name(self, name: str, args: tuple, frame: DataFrame) -> tuple[DataFrame, Value]:
        """Of the first node of the set, or of the context node if the set is empty or not given."""
        self._arity(name, args, 0, 1)
        own = frame.select(*KEYS, "node_id", "pre", "name", "kind")
        if args:
            frame, v = self._value(args[0], frame)
            if v.kind != "nodes":
                return frame, Value("str", F.lit(""))
            first = v.frame.groupBy(*KEYS).agg(F.min(F.struct("node_id", "apos", "pre", "name", "kind")).alias("_f")).select(*KEYS, "_f.node_id", "_f.pre", "_f.name", "_f.kind")
            own = first if name == "namespace-uri" else own.join(first.select(*KEYS, F.struct("node_id", "pre", "name", "kind").alias("_f")), KEYS, "left").select(*KEYS, *[F.coalesce(F.col("_f")[c], F.col(c)).alias(c) for c in ("node_id", "pre", "name", "kind")])
        if name == "namespace-uri":
            uri = nav.with_namespace(self.n, own.filter("kind = 'element'"), prefix=nav.prefix(F.col("name")))
            frame, c = self._attach(frame, uri, F.max("ns_uri"), F.lit(""))
        else:
            text = nav.local_name(F.col("name")) if name == "local-name" and self.w3c else F.col("name")
            frame, c = self._attach(frame, own, F.max(text), F.lit(""))
        return frame, Value("str", c)

    def _id(self, args: tuple, frame: DataFrame) -> tuple[DataFrame, Value]:
        self._arity("id", args, 1, 1)
        frame, text = self._as("str", args[0], frame)
        wanted = frame.select(*KEYS, F.explode(F.split(strings.normalize(text), " ")).alias("_id"))
        ids = self.n.filter("kind = 'element'").select("doc_id", nav.attribute(F.col("attrs"), "id").alias("_id"), "node_id").filter("_id is not null").groupBy("doc_id", "_id").agg(F.min("node_id").alias("node_id"))
        rows = wanted.join(ids, ["doc_id", "_id"]).select(*KEYS, "node_id").distinct().join(self.n, ["doc_id", "node_id"]).select(*KEYS, *NODE)
        return frame, Value("nodes", frame=rows, unique=True)

    def _lang(self, args: tuple, frame: DataFrame) -> tuple[DataFrame, Value]:
        self._arity("lang", args, 1, 1)
        frame, want = self._as("str", args[0], frame)
        marked = self.n.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_lp"), F.col("end").alias("_le"), nav.attribute(F.col("attrs"), "xml:lang").alias("_l")).filter("_l is not null")
        near = frame.select(*KEYS, "pre").join(marked, (F.col("doc_id") == F.col("_d")) & (F.col("_lp") <= F.col("pre")) & (F.col("pre") <= F.col("_le")))
        frame, here = self._attach(frame, near, F.max_by("_l", "_lp"), F.lit(None).cast("string"))
        low, ask = F.lower(here), F.lower(want)
        return frame, Value("bool", F.coalesce((low == ask) | F.startswith(low, F.concat(ask, F.lit("-"))), F.lit(False)))


def _is_literal(c: Column) -> bool:
    return str(c) in ("Column<'true'>", "Column<'false'>")


# name: (kinds of the arguments, how many at least, kind of the result, expression)
_SCALAR = {
    "string": (["str"], 0, "str", lambda a: a),
    "concat": (["str"], 0, "str", lambda *a: F.concat(*a) if a else F.lit("")),
    "contains": (["str"] * 2, 2, "bool", lambda a, b: F.contains(a, b)),
    "starts-with": (["str"] * 2, 2, "bool", lambda a, b: F.startswith(a, b)),
    "ends-with": (["str"] * 2, 2, "bool", lambda a, b: F.endswith(a, b)),
    "substring": (["str", "num", "num"], 2, "str", strings.substring),
    "substring-before": (["str"] * 2, 2, "str", strings.before),
    "substring-after": (["str"] * 2, 2, "str", strings.after),
    "string-length": (["str"], 0, "num", lambda a: F.length(a).cast("double")),
    "normalize-space": (["str"], 0, "str", strings.normalize),
    "translate": (["str"] * 3, 3, "str", strings.translate),
    "lower-case": (["str"], 1, "str", F.lower),
    "upper-case": (["str"], 1, "str", F.upper),
    "replace": (["str"] * 3, 3, "str", strings.replace),
    "boolean": (["bool"], 1, "bool", lambda a: a),
    "not": (["bool"], 1, "bool", lambda a: ~a),
    "number": (["num"], 0, "num", lambda a: a),
    "floor": (["num"], 1, "num", lambda a: coerce.whole(a, "floor")),
    "ceiling": (["num"], 1, "num", lambda a: coerce.whole(a, "ceil")),
    "round": (["num"], 1, "num", lambda a: coerce.whole(a, "round")),
}
