"""Edits as transforms: nodes in, nodes out.

Attribute edits, compaction and new documents are DataFrame expressions. Structural edits come as a frame and are applied document by document, in order;
an edit that is not allowed gives an ``#error`` row and leaves its document as it was before it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare
from ..sources.xml import ERROR, NODES, _arrow_schema

#: An edit: ``node_id`` is the parent or the node itself, ``other_id`` the child or new node, ``ref_id`` the place. Negative ids name nodes that the same batch makes.
EDITS = "doc_id long, seq int, op string, node_id int, other_id int, ref_id int, name string, value string"


class EditError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind, self.message = kind, message


class Tree:
    """One document while it is edited."""

    def __init__(self, rows: list[dict]):
        self.nodes = {r["node_id"]: dict(r) for r in rows}
        self.kids: dict[int, list[int]] = {i: [] for i in self.nodes}
        for r in sorted(rows, key=lambda r: (r["ord"] is None, r["ord"] or 0)):
            if r["parent_id"] is not None:
                self.kids[r["parent_id"]].append(r["node_id"])
        self.made: dict[int, int] = {}

    def at(self, i: int | None) -> int:
        i = self.made.get(i, i) if i is not None else None
        if i not in self.nodes:
            raise EditError("NodeNotFound", f"Node {i} not found")
        return i

    def add(self, handle: int | None, **fields) -> int:
        i = max(self.nodes, default=-1) + 1
        self.nodes[i] = dict.fromkeys(next(iter(self.nodes.values()), {"doc_id": None})) | {"node_id": i, "parent_id": None} | fields
        self.kids[i] = []
        if handle is not None:
            self.made[handle] = i
        return i

    def guard(self, parent: int, new: int) -> None:
        i: int | None = parent
        while i is not None:
            if i == new:
                raise EditError("HierarchyRequestError", "HierarchyRequestError: a node can't be put under itself or its descendants")
            i = self.nodes[i]["parent_id"]

    def detach(self, i: int) -> None:
        p = self.nodes[i]["parent_id"]
        if p is not None:
            self.kids[p].remove(i)
            self.nodes[i]["parent_id"] = None

    def put(self, parent: int, i: int, place: int | None = None) -> None:
        self.kids[parent].insert(len(self.kids[parent]) if place is None else place, i)
        self.nodes[i]["parent_id"] = parent

    def child(self, parent: int, i: int) -> int:
        if i not in self.kids[parent]:
            raise EditError("NodeNotFound", f"Child node {i} not found on parent {parent}")
        return self.kids[parent].index(i)

    def element(self, i: int) -> dict:
        if self.nodes[i]["kind"] != "element":
            raise EditError("InvalidOperation", f"Node {i} is not an Element")
        return self.nodes[i]

    def clone(self, i: int, deep: bool) -> int:
        old = self.nodes[i]
        new = self.add(None, **{k: v for k, v in old.items() if k not in ("node_id", "parent_id", "doc_id")}, doc_id=old["doc_id"])
        if deep:
            for k in list(self.kids[i]):
                self.put(new, self.clone(k, True))
        return new

    def apply(self, e: dict) -> None:
        op, name, value = e["op"], e["name"], e["value"]
        doc = next(iter(self.nodes.values()))["doc_id"] if self.nodes else e["doc_id"]
        if op == "create_element":
            self.add(e["other_id"], doc_id=doc, kind="element", name=name, attrs=[])
        elif op == "create_text":
            self.add(e["other_id"], doc_id=doc, kind="text", name="#text", value=value)
        elif op == "append_child":
            parent, new = self.at(e["node_id"]), self.at(e["other_id"])
            self.guard(parent, new)
            if self.nodes[new]["parent_id"] != parent:
                self.detach(new)
                self.put(parent, new)
        elif op == "remove_child":
            parent, old = self.at(e["node_id"]), self.at(e["other_id"])
            self.child(parent, old)
            self.detach(old)
        elif op in ("insert_before", "replace_child"):
            parent, new, ref = self.at(e["node_id"]), self.at(e["other_id"]), self.at(e["ref_id"])
            self.guard(parent, new)
            self.child(parent, ref)
            self.detach(new)
            place = self.child(parent, ref)
            self.put(parent, new, place)
            if op == "replace_child":
                self.detach(ref)
        elif op in ("detach", "remove_node"):
            self.detach(self.at(e["node_id"]))
        elif op == "set_attribute":
            node = self.element(self.at(e["node_id"]))
            same = [a for a in node["attrs"] if a["name"] == name]
            if same:
                node["attrs"] = [a if a is not same[0] else {"name": name, "value": value} for a in node["attrs"]]
            else:
                node["attrs"] = [*node["attrs"], {"name": name, "value": value}]
        elif op == "remove_attribute":
            node = self.element(self.at(e["node_id"]))
            node["attrs"] = [a for a in node["attrs"] if a["name"] != name]
        elif op == "set_text_content":
            i = self.at(e["node_id"])
            if self.nodes[i]["kind"] == "element":
                for k in list(self.kids[i]):
                    self.detach(k)
                self.put(i, self.add(None, doc_id=doc, kind="text", name="#text", value=value))
            elif self.nodes[i]["kind"] in ("text", "cdata", "comment"):
                self.nodes[i]["value"] = value
            else:
                raise EditError("InvalidOperation", f"Cannot set text content of node {i}")
        elif op == "clone_node":
            self.made[e["other_id"]] = self.clone(self.at(e["node_id"]), value == "deep")
        else:
            raise EditError("InvalidOperation", f"Unknown edit {op}")

    def rows(self) -> list[dict]:
        """All nodes with places computed anew; what hangs nowhere has none."""
        for n in self.nodes.values():
            n.update(ord=None, pre=None, end=None, depth=0, leaf_text=n["value"] if n["kind"] in ("text", "cdata") else "" if n["kind"] in ("comment", "pi") else None)
        at, order = 0, []
        todo = [(i, 0, None) for i in (1, 0) if i in self.nodes]
        while todo:
            i, depth, place = todo.pop()
            self.nodes[i].update(pre=at, depth=depth, ord=place)
            order.append(i)
            at += 1
            todo += [(k, depth + 1, j) for j, k in reversed(list(enumerate(self.kids[i])))]
        for i in reversed(order):
            n = self.nodes[i]
            n["end"] = max([n["pre"], *(self.nodes[k]["end"] for k in self.kids[i])])
        for i, n in self.nodes.items():
            if n["pre"] is None and n["parent_id"] is not None:
                n["ord"] = self.kids[n["parent_id"]].index(i)
            if n["kind"] == "element" and not any(self.nodes[k]["kind"] == "element" for k in self.kids[i]):
                n["leaf_text"] = "".join(self.nodes[k]["value"] for k in self.kids[i] if self.nodes[k]["kind"] in ("text", "cdata"))
        return [self.nodes[i] for i in sorted(self.nodes)]


def apply_edits(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """The nodes after the edits, and an ``#error`` row for each edit that failed; see :data:`EDITS`. Documents without edits stay as they are."""
    spark = nodes.sparkSession
    prepare(spark)
    kind = nodes.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, {NODES}"
    schema = _arrow_schema(spark, ddl)
    # New names and back: edits are often made from the nodes, and a cogroup can't tell their columns apart then.
    edits = edits.select(*[F.col(c).alias(f"_{c}") for c in edits.columns]).toDF(*edits.columns)
    touched = edits.select(F.col("doc_id").alias("_doc")).distinct()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tree, out = Tree(left.to_pylist()), []
        doc = (left if left.num_rows else right).column("doc_id")[0].as_py()
        for e in sorted(right.to_pylist(), key=lambda e: e["seq"]):
            try:
                tree.apply(e)
            except EditError as x:
                out.append({"doc_id": doc, "node_id": -1, "kind": ERROR, "error": {"kind": x.kind, "message": x.message, "line": None, "col": None}})
        rows = [{f.name: r.get(f.name) for f in schema} for r in [*tree.rows(), *out]]
        return pa.Table.from_pylist(rows, schema=schema)

    changed = nodes.join(touched, F.col("doc_id") == F.col("_doc"), "left_semi").groupBy("doc_id").cogroup(edits.groupBy("doc_id")).applyInArrow(run, ddl)
    same = nodes.join(touched, F.col("doc_id") == F.col("_doc"), "left_anti")
    if "error" not in same.columns:
        same = same.withColumn("error", F.lit(None).cast(changed.schema["error"].dataType))
    return same.select(changed.columns).unionByName(changed)


def set_attribute(nodes: DataFrame, where: Column, name: str, value: Column) -> DataFrame:
    """Set an attribute of the elements that ``where`` picks: in place where it is there, at the end otherwise."""
    pair = F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    have = F.exists("attrs", lambda a: a["name"] == name)
    done = F.when(have, F.transform("attrs", lambda a: F.when(a["name"] == name, pair).otherwise(a))).otherwise(F.concat("attrs", F.array(pair)))
    return nodes.withColumn("attrs", F.when((F.col("kind") == "element") & where, done).otherwise(F.col("attrs")))


def remove_attribute(nodes: DataFrame, where: Column, name: str) -> DataFrame:
    return nodes.withColumn("attrs", F.when((F.col("kind") == "element") & where, F.filter("attrs", lambda a: a["name"] != name)).otherwise(F.col("attrs")))


def compact(nodes: DataFrame) -> DataFrame:
    """Without the nodes that hang nowhere; ids become dense, in the order that they had. One window and one join by document."""
    order = Window.partitionBy("doc_id").orderBy("node_id")
    kept = nodes.filter(F.col("pre").isNotNull()).withColumn("new_id", F.row_number().over(order) - 1)
    names = kept.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col("new_id").alias("_new"))
    out = kept.join(names, (F.col("doc_id") == F.col("_d")) & (F.col("parent_id") == F.col("_n")), "left")
    return out.withColumn("node_id", F.col("new_id")).withColumn("parent_id", F.col("_new")).select(nodes.columns)


def new_documents(ids: DataFrame) -> DataFrame:
    """The node table of empty documents (doc_id): a prolog and a root each."""
    two = F.array(
        *[F.struct(F.lit(i).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(None).cast("int").alias("ord"), F.lit(0).alias("depth"), F.lit(i).alias("pre"), F.lit(i).alias("end"), F.lit(k).alias("kind"), F.lit(n).alias("name")) for i, k, n in ((0, "prolog", "#prolog"), (1, "root", "#document"))]
    )
    rest = [f"cast(null as {t}) as `{n}`" for n, t in (("value", "string"), ("leaf_text", "string"), ("attrs", "array<struct<name:string,value:string>>"), ("decl", "struct<version:string,encoding:string,standalone:boolean>"), ("doctype", "struct<public_id:string,system_id:string,internal_subset:string>"))]
    return ids.select("doc_id", F.explode(two).alias("n")).select("doc_id", "n.*").selectExpr("*", *rest)
