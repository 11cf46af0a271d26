"""Main text of web pages by union-free wrapper inference.

Pages are read as streams of tags and text. The block structure of each page is folded (equal neighbours become a repeated group) and
aligned with that of other pages of its host: elements that match are merged, elements that are missing on one side become optional, and
strings are compared: those that all pages have at a place are template, the rest makes it a slot. The result is one regular expression without
unions for each host. How much text varies in its parts, over all pages of the host, tells which part is the article. Each page is then matched
against the wrapper, and its text is what fills the slots of that part, without the elements that are boilerplate by tag or by name.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Elements whose content is no text of the page; without an end tag, only scripts and styles go on to the end of the page.
RAW = frozenset("script style noscript template svg iframe textarea title object canvas".split())
END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/><]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\"><])*+)>", re.S | re.I)  # fmt: skip
ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)

# HTML elements by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body head article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "nav header footer aside form fieldset address details summary dialog menu hgroup center hr".split())  # fmt: skip
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table body html div section article".split())
BAD_TAGS = frozenset("head nav footer aside menu dialog button select option label input".split())
#: Boilerplate by a weaker test: not what an article lies in, nor what most of the page's text lies in.
WEAK_TAGS = frozenset("header form fieldset".split())
#: A class, id or role is a name of boilerplate if all its parts are of these two kinds, and one of the first at least.
BAD_PARTS = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|sidebars?|side|menus?|nav|navbar|navigation|breadcrumbs?|cookies?|consent|notices?|banners?|popups?|modal|alerts?|"
    r"comments?|disqus|respond|replies|reply|footers?|headers?|masthead|share|sharing|social|newsletter|subscribe|signup|login|related|recommended|pagination|pager|skip|copyright|"
    r"complementary|contentinfo|search|widgets?|toolbar", re.I)  # fmt: skip
PLAIN_PARTS = re.compile(r"|\d+|site|top|bottom|left|right|main|global|primary|secondary|user|post|posts|entry|area|list|section|box|block|bar|form|container|wrapper|wrap|inner|outer|links?|buttons?|icons?|items?|stories|slot|unit|to", re.I)
#: Of these, a block is boilerplate even if most of the page's text is there.
ALWAYS = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|comments?|disqus|respond|replies|reply", re.I)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|main|content|post|entry|story|body|text)(?=$|[\s_-])", re.I)
#: Levels of nesting that the structure tells apart; deeper elements count with their ancestor there. No text is lost by it.
DEPTH = 40
#: Wrappers are sent to all executors up to so many bytes; beyond, they are joined by host.
BROADCAST_BYTES = 8_000_000
#: Groups that the pages of one host are dealt into before the groups' wrappers are merged.
GROUPS = 32
#: Different pages that have a string in the same place before it is template: fewer are too little to compare.
PAGES = 3
#: The share of a host's text, and of that in its article, that may be template; beyond, the pages are copies of one another and comparing them tells nothing.
TEMPLATE, ARTICLE_TEMPLATE = 0.9, 0.5


def bad_names(name: str) -> tuple[bool, bool]:
    """Whether one of the names is one of boilerplate, and whether it is so for any amount of text."""
    bad = always = False
    for word in name.split():
        parts = re.split("[_-]", word)
        if any(map(BAD_PARTS.fullmatch, parts)) and all(BAD_PARTS.fullmatch(p) or PLAIN_PARTS.fullmatch(p) for p in parts):
            bad, always = True, always or any(map(ALWAYS.fullmatch, parts))
    return bad, always


class Page:
    """The blocks of a page: (path, boilerplate, text), and the structure: [sign, children], with the number of the block for a text."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, bool, str]] = []
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.known: dict[tuple[int, str], int] = {}
        self.root: list = ["", []]
        stack: list[tuple] = [("", 0, (False, ()), self.root)]  # bad: whether for sure, and the weak ones that it lies in
        inner: list[tuple] = []
        weak = 0
        gone: set[str] = set()  # raw elements without a further end tag
        opened: Counter = Counter()  # by tag: a search of the stack is for something that is there

        def close(i: int) -> None:
            for entry in stack[i:]:
                opened[entry[0]] -= 1
            del stack[i:]

        text: list[str] = []
        at = 0

        def flush() -> None:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                _, path, bad, node = stack[-1]
                node[1].append(len(self.blocks))
                self.blocks.append((path, bad[0], whole))
                inner.append(bad[1])

        while m := TOKEN.search(source, at):
            if m.start() > at:
                text.append(_html.unescape(source[at : m.start()]))
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in RAW:
                if not m["end"] and tag not in gone and (tag in ("script", "style") or source[at - 2] != "/"):
                    if found := END[tag].search(source, at):
                        at = found.end()
                    elif tag in ("script", "style"):
                        at = len(source)
                    else:
                        gone.add(tag)
            elif tag == "br":
                text.append(" ")
            elif m["end"]:
                if tag in BLOCK:
                    flush()
                    if opened[tag] > 0:
                        close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            elif tag in BLOCK:
                flush()
                shut = CLOSES.get(tag, {"p"} if tag not in ("html", "body", "head") else set())
                for i in range(len(stack) - 1, 0, -1) if any(opened[t] > 0 for t in shut) else ():
                    if stack[i][0] in shut:
                        close(i)
                        break
                    if stack[i][0] in SCOPES:
                        break
                if tag in VOID:
                    continue
                names = {k.lower(): (v or "").strip("\"'") for k, v in ATTR.findall(m["attrs"])} if "=" in m["attrs"] or "hidden" in m["attrs"] else {}
                name = " ".join(v for k, v in names.items() if k in ("class", "id", "role", "itemprop"))
                _, path, bad, node = stack[-1]
                kept = tag in ("article", "main") or "articlebody" in name.lower().split() or "main" in names.get("role", "").lower().split()
                headed = tag == "header" and any(s[0] in ("article", "main") for s in stack)
                named, always = bad_names(name) if name and not kept and tag not in ("html", "body") else (False, False)
                sure = bad[0] or tag in BAD_TAGS or always or "hidden" in names or names.get("aria-hidden") == "true"
                if kept:
                    bad = sure, ()
                elif (named or (tag in WEAK_TAGS and not headed)) and len(bad[1]) < DEPTH:
                    weak += 1
                    bad = sure, (*bad[1], weak)
                else:
                    bad = sure, bad[1]
                child = node
                if len(stack) < DEPTH:
                    sign = tag + ("." + re.sub(r"\d+", "0", name)[:60] if name else "")
                    child = [sign, []]
                    node[1].append(child)
                    path = self.known.setdefault((path, sign), len(self.paths))
                    if path == len(self.paths):
                        self.paths.append((stack[-1][1], sign))
                stack.append((tag, path, bad, child))
                opened[tag] += 1
        if at < len(source):
            text.append(_html.unescape(source[at:]))
        flush()
        under: Counter = Counter()
        for (_, bad, whole), own in zip(self.blocks, inner, strict=True):
            if not bad:
                under.update(dict.fromkeys((0, *own), len(whole)))
        most = {k for k, n in under.items() if 2 * n > under[0]}
        self.blocks = [(path, bad or not most.issuperset(own), whole) for (path, bad, whole), own in zip(self.blocks, inner, strict=True)]

    def name(self, path: int) -> str:
        parts = []
        while path > 0:
            path, sign = self.paths[path]
            parts.append(sign)
        return "/".join(reversed(parts))


def mark(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def fold(page: Page) -> list:
    """The wrapper of one page: equal neighbours become one repeated element.

    An element is [sign, children, optional, repeated]; a text is ["#", strings, pages, varies, n, mass]: the marks and lengths (without
    boilerplate) of the strings that all pages have there, the marks of some of these pages, whether there are other strings, the number of pages, and the characters that aren't boilerplate.
    """
    own = mark("\n".join(text for _, _, text in page.blocks))

    def folded(node: list) -> list:
        children: list = []
        for c in node[1]:
            if isinstance(c, int):
                _, bad, text = page.blocks[c]
                n = 0 if bad else len(text)
                c = ["#", {mark(text): n}, [own], False, 1, n]
            else:
                c = folded(c)
            if children and c[0] == children[-1][0]:
                children[-1] = both(children[-1], c, True)
            else:
                children.append(c)
        return [node[0], children, False, False]

    return folded(page.root)


def both(a: list, b: list, within: bool = False) -> list:
    """What two nodes of equal sign become: of one page (``within``), or of different pages."""
    if a[0] != "#":
        out = merge(a, b, within)
        return [*out[:3], True] if within else out
    if within:
        return ["#", {k: a[1].get(k, 0) + b[1].get(k, 0) for k in {**a[1], **b[1]}}, sorted({*a[2], *b[2]})[:PAGES], a[3] or b[3], max(a[4], b[4]), a[5] + b[5]]
    return ["#", {k: min(n, b[1][k]) for k, n in a[1].items() if k in b[1]}, sorted({*a[2], *b[2]})[:PAGES], a[3] or b[3] or a[1].keys() != b[1].keys(), a[4] + b[4], a[5] + b[5]]


def merge(a: list, b: list, within: bool = False) -> list:
    """The wrapper of what two elements of equal sign match: their children aligned, mismatches optional."""
    left, right = [c[0] for c in a[1]], [c[0] for c in b[1]]
    if left == right:
        return [a[0], [both(x, y, within) if x[0] == "#" else merge(x, y, within) for x, y in zip(a[1], b[1], strict=True)], a[2] or b[2], a[3] or b[3]]
    out: list = []
    for op, i, j, k, l in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if op == "equal":
            out += [both(x, y, within) if x[0] == "#" else merge(x, y, within) for x, y in zip(a[1][i:j], b[1][k:l], strict=True)]
        else:
            out += [c if c[0] == "#" else [c[0], c[1], True, c[3]] for c in (*a[1][i:j], *b[1][k:l])]
    tidy: list = []
    for c in out:  # neighbours of equal sign are one repeated group
        if tidy and tidy[-1][0] == c[0]:
            tidy[-1] = both(tidy[-1], c, within) if c[0] == "#" else [*merge(tidy[-1], c, within)[:3], True]
        else:
            tidy.append(c)
    return [a[0], tidy, a[2] or b[2], a[3] or b[3]]


def expression(node: list) -> str:
    """The wrapper as a regular expression over tags, text slots (#) and texts that are the same on all pages (=)."""
    if node[0] == "#":
        return "=" if node[1] and not node[3] else "#"
    body = "".join(expression(c) for c in node[1])
    whole = f"<{node[0]}>{body}</>" if node[0] else body
    return f"({whole}){'*' if node[2] and node[3] else '?' if node[2] else '+'}" if node[2] or node[3] else whole


def slots(node: list, path: str = "") -> Iterator[tuple[str, list]]:
    """(path, text node) for each text of a wrapper."""
    for c in node[1]:
        if c[0] == "#":
            yield path, c
        else:
            yield from slots(c, f"{path}/{c[0]}" if path else c[0])


def inside(path: str, part: str) -> bool:
    return not part or path == part or path.startswith(part + "/")


def settle(root: list) -> str:
    """The path of the article in the wrapper of a host, whose strings become those that are template."""
    full: dict[str, float] = defaultdict(float)
    fixed: dict[str, float] = defaultdict(float)
    for path, slot in slots(root):
        if len(slot[2]) < PAGES:
            slot[1] = {}
        full[path] += slot[5]
        fixed[path] += min(slot[5], slot[4] * sum(slot[1].values()))
    varied = {p: n - fixed[p] for p, n in full.items() if n > fixed[p]}
    copies = sum(fixed.values()) > TEMPLATE * sum(full.values())
    part = main_part({p: n for p, n in full.items() if n} if copies else varied)
    under = lambda mass: sum(n for p, n in mass.items() if inside(p, part))
    if copies or under(fixed) > ARTICLE_TEMPLATE * under(full):
        for path, slot in slots(root):
            if copies or inside(path, part):
                slot[1] = {}
    return part


def template(page: Page, root: list) -> set[int]:
    """The blocks of a page that its host's wrapper has as template: from left to right, an element matches the next place of its sign."""
    out: set[int] = set()

    def match(node: list, wrapper: list) -> None:
        at, last, places = 0, None, wrapper[1]
        for c in node[1]:
            sign = "#" if isinstance(c, int) else c[0]
            if sign != last:
                found = next((i for i in range(at, len(places)) if places[i][0] == sign), None)
                if found is None:
                    continue
                at, last = found + 1, sign
            if sign != "#":
                match(c, places[at - 1])
            elif places[at - 1][1] and mark(page.blocks[c][2]) in places[at - 1][1]:
                out.add(c)

    match(page.root, root)
    return out


def main_part(mass: dict[str, float]) -> str:
    """The path of the article among the paths of a host and the characters directly in each (boilerplate left out)."""
    under: dict[str, float] = defaultdict(float)
    for path, n in mass.items():
        parts = path.split("/")
        for i in range(1, len(parts) + 1):
            under["/".join(parts[:i])] += n
    named = lambda test: [p for p in under if test(p.rsplit("/", 1)[-1])]
    for test in (lambda s: re.match(r"article(\.|$)", s), lambda s: re.match(r"main(\.|$)", s) or "articlebody" in s.lower() or s.endswith(" main"), lambda s: "." in s and GOOD_NAMES.search(s.split(".", 1)[1])):
        if found := [p for p in named(test) if under[p] >= 0.25 * max(under.values(), default=0)]:
            return max(found, key=lambda p: (under[p], -len(p), p))
    at = ""
    while True:  # down to where the text spreads out
        below = [p for p in under if p.startswith(at + "/" if at else "") and p.count("/") == (at.count("/") + 1 if at else 0) and p != at]
        best = max(below, key=lambda p: (under[p], p), default=None)
        if best is None or under[best] < 0.6 * (under[at] if at else sum(mass.values())) or re.match(r"(p|h[1-6]|li|td|tr|ul|ol|blockquote|pre)(\.|$)", best.rsplit("/", 1)[-1]):
            return at
        at = best


def masses(page: Page) -> dict[str, float]:
    out: dict[str, float] = defaultdict(float)
    for path, bad, text in page.blocks:
        if not bad:
            out[page.name(path)] += len(text)
    return out


def article(page: Page, root: list | None, part: str) -> str:
    """The text in the slots of that part of the wrapper; where the page has none there, in the part that the page alone suggests."""
    names = {i: page.name(i) for i in {b[0] for b in page.blocks}}
    fixed = template(page, root) if root else set()
    take = lambda p: " ".join(t for k, (i, bad, t) in enumerate(page.blocks) if not bad and k not in fixed and inside(names[i], p))
    return take(part) or take(main_part(masses(page)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _merged(items: list[list]) -> list:
    """One wrapper of several."""
    whole = items[0]
    for w in items[1:]:
        whole = merge(whole, w)
    return whole


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, part, tree) for each host of (host, html): the expression inferred from all its pages, the path of its article, and the wrapper as JSON."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mine: dict[str, list] = {}
            for name, source in zip(b["host"], b["html"], strict=True):
                page = fold(Page(source or ""))
                mine[name] = merge(mine[name], page) if name in mine else page
            yield pd.DataFrame([(name, json.dumps(w)) for name, w in mine.items()], columns=["host", "tree"])

    def join(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(b["host"].iloc[0], json.dumps(_merged([json.loads(w) for w in sorted(b["tree"])])))], columns=["host", "tree"])

    def close(b: pd.DataFrame) -> pd.DataFrame:
        root = _merged([json.loads(w) for w in sorted(b["tree"])])
        part = settle(root)
        return pd.DataFrame([(b["host"].iloc[0], expression(root), part, json.dumps(root))], columns=["host", "wrapper", "part", "tree"])

    schema = "host string, tree string"
    first = pages.mapInPandas(read, schema).withColumn("g", F.pmod(F.xxhash64("tree"), F.lit(GROUPS)))
    return first.groupBy("host", "g").applyInPandas(lambda b: join(b), schema).groupBy("host").applyInPandas(close, "host string, wrapper string, part string, tree string")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, wrapper) for each page: the main text, and the wrapper of its host.

    A null or empty page has the text ''. Pages without a host share the host ''. Repeated rows have equal results, an empty table gives none.
    """
    rows = pages.select(F.col(key).cast("string").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"), host(F.col(url)).alias("host"))
    found = materialise(wrappers(rows.select("host", "html")), "wrappers")
    size = found.agg(F.sum(F.length("host") + F.length("wrapper") + F.length("part") + F.length("tree")).alias("n")).first()["n"] or 0
    both = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")
    schema = "page_id string, url string, text string, n_chars long, wrapper string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            trees = {t: json.loads(t) for t in b["tree"].dropna().unique()}
            texts = [article(Page(s or ""), trees.get(t), p or "") for s, p, t in zip(b["html"], b["part"], b["tree"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts], "wrapper": b["wrapper"]})

    return both.mapInPandas(run, schema).withColumn("page_id", F.col("page_id").cast(pages.schema[key].dataType))
