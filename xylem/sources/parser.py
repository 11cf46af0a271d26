"""The document parser that runs inside the parse stage: text in, columns of nodes out.

A scanner over compiled expressions; one pass gives ids, parents, order among siblings, depth and the pre-order interval of every node, so that no
window or shuffle is needed later to derive them. Problems become an error row, never an exception.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

WS = " \t\r\n"
NAME = re.compile(r"[\w:.\-]*")
ATTRIBUTE = re.compile(r"([\w:.\-]*)[ \t\r\n]*=[ \t\r\n]*(?:\"([^\"]*)\"|'([^']*)')")
# A whole opening tag without references; whatever else it is goes the long way, which also finds what is wrong.
PLAIN_TAG = re.compile(r"<([\w:.\-]+)((?:[ \t\r\n]+[\w:.\-]+[ \t\r\n]*=[ \t\r\n]*(?:\"[^\"&]*\"|'[^'&]*'))*)[ \t\r\n]*(/?)>")
SPACE = re.compile(r"[ \t\r\n]*")
EXTERNAL = re.compile(r"(?:SYSTEM|PUBLIC\s+(\"[^\"]*\"|'[^']*'))\s+(\"[^\"]*\"|'[^']*')")
FORBIDDEN = re.compile("[^\t\n\r\\x20-\\uD7FF\\uE000-\\uFFFD\\U00010000-\\U0010FFFF]")
# Predefined entities.
PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


@dataclass(frozen=True)
class ParseOptions:
    """Limits of one document; sizes in bytes."""

    max_xml_size: int = 100 * 1024 * 1024
    max_nesting_depth: int = 1000
    max_element_count: int = 1_000_000
    max_attribute_count: int = 10_000
    max_total_attribute_count: int = 1_000_000
    max_text_node_size: int = 1024 * 1024
    max_entity_expansion_depth: int = 512
    max_total_entity_expansion_size: int = 10 * 1024 * 1024
    allow_external_entities: bool = False
    #: Called with the public and system id of an external entity, if these are allowed; gives its text, or None.
    entity_resolver: Callable[[str | None, str], str | None] | None = None


class XmlProblem(Exception):
    """kind: Syntax, SecurityLimitExceeded or Entity; at: offset in the text, if any."""

    def __init__(self, kind: str, message: str, at: int | None = None):
        super().__init__(message)
        self.kind, self.message, self.at = kind, message, at


class Entities:
    """Named entities of one document and their bounded expansion."""

    def __init__(self, max_depth: int = 512, max_size: int = 10 * 1024 * 1024):
        self.names: dict[str, str] = {}
        self.max_depth, self.max_size = max_depth, max_size

    def expand(self, text: str) -> str:
        if "&" not in text:
            return text
        self.grown = 0
        return self._expand(text, 0)

    def _grow(self, n: int) -> None:
        self.grown += n
        if self.grown > self.max_size:
            raise XmlProblem("SecurityLimitExceeded", f"Maximum cumulative entity expansion size of {self.max_size} bytes exceeded")

    def _expand(self, text: str, depth: int) -> str:
        if depth > self.max_depth:
            raise XmlProblem("SecurityLimitExceeded", "Maximum entity expansion depth exceeded (possible XML Bomb/Billion Laughs)")
        first, *rest = text.split("&")
        out = [first]
        self._grow(len(first.encode("utf-8", "surrogatepass")))
        for part in rest:
            name, semicolon, after = part.partition(";")
            if not semicolon:
                raise XmlProblem("Entity", "Unterminated entity reference missing ';'")
            if name.startswith("#"):
                out.append(self._number(name[1:], name))
            elif name in PREDEFINED:
                self._grow(1)
                out.append(PREDEFINED[name])
            elif name in self.names:
                out.append(self._expand(self.names[name], depth + 1))
            else:
                raise XmlProblem("Entity", f"Undeclared entity reference: &{name};")
            self._grow(len(after.encode("utf-8", "surrogatepass")))
            out.append(after)
        return "".join(out)

    def _number(self, code: str, name: str) -> str:
        digits, base = (code[1:], 16) if code[:1] in ("x", "X") else (code, 10)
        if not re.fullmatch(r"\+?[0-9a-fA-F]+" if base == 16 else r"\+?[0-9]+", digits) or int(digits, base) > 0xFFFFFFFF:
            raise XmlProblem("Entity", f"Malformed numeric entity reference: &{name};")
        point = int(digits, base)
        if point > 0x10FFFF or 0xD800 <= point <= 0xDFFF:
            raise XmlProblem("Entity", f"Invalid character reference code point: {code}")
        self._grow(len(chr(point).encode()))
        return chr(point)


@dataclass(slots=True)
class Node:
    parent: int | None
    kind: str
    name: str
    value: str | None = None
    attrs: list[tuple[str, str]] | None = None
    extra: tuple | None = None
    ord: int | None = None
    depth: int = 0
    pre: int | None = None
    end: int | None = None
    children: int = 0
    elements: int = 0
    texts: list[str] | None = None


class Parser:
    """Parses one document; ``nodes`` by id after :meth:`run`."""

    def __init__(self, text: str, options: ParseOptions = ParseOptions()):
        self.s, self.o, self.at = text, options, 0
        self.entities = Entities(options.max_entity_expansion_depth, options.max_total_entity_expansion_size)
        self.nodes = [Node(None, "prolog", "#prolog"), Node(None, "root", "#document")]
        self.attributes = self.elements = 0

    def fail(self, message: str, at: int | None = None, kind: str = "Syntax") -> XmlProblem:
        return XmlProblem(kind, message, self.at if at is None else at)

    def limit(self, message: str) -> XmlProblem:
        return XmlProblem("SecurityLimitExceeded", message)

    def space(self) -> None:
        self.at = SPACE.match(self.s, self.at).end()

    def add(self, parent: int | None, node: Node) -> int:
        self.nodes.append(node)
        if parent is not None:
            p = self.nodes[parent]
            node.parent, node.ord, node.depth = parent, p.children, p.depth + 1
            p.children += 1
        return len(self.nodes) - 1

    def until(self, mark: str, message: str) -> str:
        end = self.s.find(mark, self.at)
        if end < 0:
            self.at = len(self.s)
            raise self.fail(message)
        out, self.at = self.s[self.at : end], end + len(mark)
        return out

    def run(self) -> list[Node]:
        s, o = self.s, self.o
        if len(s) > o.max_xml_size // 4 and len(s.encode("utf-8", "surrogatepass")) > o.max_xml_size:
            raise self.limit(f"XML size exceeds maximum of {o.max_xml_size} bytes")
        self.space()
        if s.startswith("<?xml", self.at):
            self.declaration()
        self.misc(0, doctype=True)
        if self.at >= len(s):
            raise self.fail("No root element found")
        if s[self.at] != "<":
            raise self.fail("Expected '<' at the root element")
        self.content()
        self.misc(1, doctype=False)
        if self.at < len(s):
            raise self.fail("Multiple root elements forbidden in XML document" if s[self.at] == "<" else "Unexpected trailing content after root element")
        self.number()
        return self.nodes

    def declaration(self) -> None:
        self.at += 5
        self.space()
        version, encoding, standalone = "1.0", None, None
        while self.at < len(self.s) and not self.s.startswith("?>", self.at):
            name, value = self.attribute(None)
            if name == "version":
                version = value
            elif name == "encoding":
                encoding = value
            elif name == "standalone":
                standalone = value == "yes"
            self.space()
        if self.at >= len(self.s):
            raise self.fail("Unclosed XML declaration")
        self.at += 2
        self.add(0, Node(0, "declaration", "xml", extra=(version, encoding, standalone)))

    def misc(self, parent: int, doctype: bool) -> None:
        while True:
            self.space()
            if self.s.startswith("<!--", self.at):
                self.comment(parent)
            elif self.s.startswith("<?", self.at):
                self.instruction(parent)
            elif doctype and self.s.startswith("<!DOCTYPE", self.at):
                self.doctype()
            else:
                return

    def comment(self, parent: int) -> None:
        self.at += 4
        self.add(parent, Node(parent, "comment", "#comment", self.until("-->", "Unterminated comment")))

    def instruction(self, parent: int) -> None:
        self.at += 2
        m = NAME.match(self.s, self.at)
        if not m[0]:
            raise self.fail("Expected name")
        self.at = m.end()
        self.space()
        self.add(parent, Node(parent, "pi", m[0], self.until("?>", "Unterminated processing instruction")))

    def quoted(self) -> str:
        quote = self.s[self.at : self.at + 1]
        if quote not in ('"', "'") or not quote:
            raise self.fail("Expected quoted string")
        self.at += 1
        return self.until(quote, "Unterminated quoted string")

    def doctype(self) -> None:
        self.at += 9
        self.space()
        m = NAME.match(self.s, self.at)
        if not m[0]:
            raise self.fail("Expected name")
        self.at = m.end()
        self.space()
        public = system = subset = None
        if self.s.startswith("PUBLIC", self.at):
            self.at += 6
            self.space()
            public = self.quoted()
            self.space()
            system = self.quoted()
        elif self.s.startswith("SYSTEM", self.at):
            self.at += 6
            self.space()
            system = self.quoted()
        self.space()
        if self.s.startswith("[", self.at):
            end = self.s.find("]", self.at)
            end = len(self.s) if end < 0 else end
            subset, self.at = self.s[self.at + 1 : end], min(end + 1, len(self.s))
        self.space()
        if not self.s.startswith(">", self.at):
            raise self.fail("Unclosed DOCTYPE declaration")
        self.at += 1
        for line in (subset or "").split("\n"):
            line = line.strip()
            words = line.split()
            if line.startswith("<!ENTITY") and len(words) >= 3:
                if ("SYSTEM" in line or "PUBLIC" in line) and not self.o.allow_external_entities:
                    raise self.limit("External entity references in DOCTYPE are forbidden by security policy")
                external = EXTERNAL.search(line)
                if external and self.o.entity_resolver is not None:
                    found = self.o.entity_resolver(*(None if q is None else q[1:-1] for q in external.groups()))
                    if found is not None:
                        self.entities.names[words[1]] = found
                    continue
                self.entities.names[words[1]] = " ".join(words[2:]).strip("\"'>")
        self.add(0, Node(0, "doctype", m[0], extra=(public, system, subset)))

    def attribute(self, element: str | None) -> tuple[str, str]:
        m = ATTRIBUTE.match(self.s, self.at)
        if m and m[1]:
            self.at = m.end()
            return m[1], self.entities.expand(m[2] if m[2] is not None else m[3])
        name = NAME.match(self.s, self.at)
        if not name[0]:
            raise self.fail("Expected name")
        self.at = name.end()
        self.space()
        if not self.s.startswith("=", self.at):
            raise self.fail(f"Expected '=' after attribute name '{name[0]}'")
        self.at += 1
        self.space()
        quote = self.s[self.at : self.at + 1]
        if quote not in ('"', "'") or not quote:
            raise self.fail(f"Expected quote for attribute value of '{name[0]}'")
        self.at += 1
        return name[0], self.entities.expand(self.until(quote, "Unterminated attribute value"))

    def text(self, raw: str, at: int) -> None:
        bad = FORBIDDEN.search(raw)
        if bad:
            raise self.fail(f"Forbidden XML character '\\u{{{ord(bad[0]):x}}}'", at + bad.start())
        if len(raw) > self.o.max_text_node_size // 4 and len(raw.encode("utf-8", "surrogatepass")) > self.o.max_text_node_size:
            raise self.limit(f"Text node size exceeds maximum of {self.o.max_text_node_size} bytes")

    def content(self) -> None:
        """The root element and all it holds, without recursion."""
        s, o, stack = self.s, self.o, [1]
        while True:
            if self.at >= len(s):
                raise self.fail(f"Unclosed element <{self.nodes[stack[-1]].name}>")
            if s[self.at] != "<":
                end = s.find("<", self.at)
                end = len(s) if end < 0 else end
                raw = s[self.at : end]
                self.text(raw, self.at)
                start, self.at = self.at, end
                value = self.entities.expand(raw)
                linked = stack[-1] if value else None
                self.add(linked, Node(None, "text", "#text", value))
                continue
            after = s[self.at + 1 : self.at + 2]
            if after == "/":
                self.at += 2
                m = NAME.match(s, self.at)
                self.at = m.end()
                self.space()
                node = self.nodes[stack[-1]]
                if m[0] != node.name:
                    raise self.fail(f"Mismatched closing tag: expected </{node.name}>, found </{m[0]}>")
                if not s.startswith(">", self.at):
                    raise self.fail(f"Expected '>' after closing tag </{m[0]}>")
                self.at += 1
                stack.pop()
            elif after == "!" and s.startswith("<!--", self.at):
                self.comment(stack[-1])
            elif after == "!" and s.startswith("<![CDATA[", self.at):
                self.at += 9
                value = self.until("]]>", "Unterminated CDATA section")
                if len(value.encode("utf-8", "surrogatepass")) > o.max_text_node_size:
                    raise self.limit(f"Text node size exceeds maximum of {o.max_text_node_size} bytes")
                self.add(stack[-1], Node(None, "cdata", "#cdata", value))
            elif after == "?":
                self.instruction(stack[-1])
            else:
                self.at += 1
                if self.open_tag(stack):
                    stack.append(len(self.nodes) - 1)
            if len(stack) == 1:
                return

    def open_tag(self, stack: list[int]) -> bool:
        """An opening tag; whether the element stays open."""
        s, o = self.s, self.o
        if len(stack) - 1 > o.max_nesting_depth:
            raise self.limit(f"Maximum nesting depth of {o.max_nesting_depth} exceeded")
        self.elements += 1
        if self.elements > o.max_element_count:
            raise self.limit(f"Maximum element count of {o.max_element_count} exceeded")
        m = PLAIN_TAG.match(s, self.at - 1)
        if m:
            attrs = [(name, one or two) for name, one, two in ATTRIBUTE.findall(m[2])] if m[2] else []
            n = len(attrs)
            if len({name for name, _ in attrs}) == n <= o.max_attribute_count and self.attributes + n <= o.max_total_attribute_count:
                self.attributes += n
                self.at = m.end()
                self.add(stack[-1], Node(None, "element", m[1], attrs=attrs))
                return not m[3]
        m = NAME.match(s, self.at)
        if not m[0]:
            raise self.fail("Expected element name")
        self.at = m.end()
        attrs: list[tuple[str, str]] = []
        seen = set()
        self.space()
        while self.at < len(s) and s[self.at] not in "/>":
            name, value = self.attribute(m[0])
            if name in seen:
                raise self.fail(f"Duplicate attribute '{name}' on element <{m[0]}>")
            seen.add(name)
            attrs.append((name, value))
            self.attributes += 1
            if len(attrs) > o.max_attribute_count:
                raise self.limit(f"Maximum attribute count of {o.max_attribute_count} exceeded on element <{m[0]}>")
            if self.attributes > o.max_total_attribute_count:
                raise self.limit(f"Maximum total attribute count of {o.max_total_attribute_count} exceeded")
            self.space()
        self.add(stack[-1], Node(None, "element", m[0], attrs=attrs))
        if s.startswith("/>", self.at):
            self.at += 2
            return False
        if not s.startswith(">", self.at):
            raise self.fail(f"Expected '>' at the end of tag <{m[0]}>")
        self.at += 1
        return True

    def number(self) -> None:
        """Pre-order intervals: the prolog's items first, then the root's. Ids rise in document order in each."""
        nodes, at = self.nodes, 0
        prolog = [0, *(i for i, n in enumerate(nodes) if n.parent == 0 and i)]
        for i in prolog:
            nodes[i].pre = nodes[i].end = at
            at += 1
        nodes[0].end = at - 1
        for i in range(1, len(nodes)):
            n = nodes[i]
            if n.parent == 0 or (n.parent is None and i != 1):
                continue
            n.pre = n.end = at
            at += 1
        for i in range(len(nodes) - 1, 1, -1):
            n = nodes[i]
            if n.parent:
                p = nodes[n.parent]
                p.end = max(p.end, n.end)
                p.elements += n.kind == "element"
                if n.kind in ("text", "cdata") and p.kind == "element":
                    p.texts = p.texts or []
                    p.texts.append(n.value)
        for n in nodes:
            if n.texts:
                n.texts.reverse()


def position(text: str, at: int | None) -> tuple[int | None, int | None]:
    """1-based line and column of an offset."""
    if at is None:
        return None, None
    at = min(at, len(text))
    return text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1
