"""Plain documents (elements, attributes and text; no references, comments or declarations), many at once.

Arrow's own functions cut the texts into tokens; levels, parents, intervals and sibling numbers then come from array operations over the tokens of
all documents, and no string but those of attributes becomes a Python object. A document that is anything else, or not well formed, is left to the parser, which also says what is wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .parser import ATTRIBUTE, ParseOptions

# What stands in a tag without references and with names in ASCII; a quoted part of an attribute; characters that no document may have.
TAG = r"^(?P<shut>/?)(?P<name>[\w:.\-]+)(?P<given>(?:[ \t\r\n]+[\w:.\-]+[ \t\r\n]*=[ \t\r\n]*(?:\"[^\"]*\"|'[^']*'))*)[ \t\r\n]*(?P<empty>/?)$"
QUOTED = r"\"[^\"]*\"|'[^']*'"
NEVER = "[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]"
KINDS = pa.array(["prolog", "root", "element", "text"])
#: Bytes of documents that are parsed at once.
CHUNK = 4_000_000


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``CHUNK`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK)))
        yield at, end
        at = end


def plain_nodes(keys: pa.Array, texts: pa.Array, schema: pa.Schema, o: ParseOptions) -> tuple[pa.RecordBatch | None, np.ndarray]:
    """The nodes of those of the documents that are plain, well formed and within all limits; and which ones are not."""
    odd = pc.or_(pc.match_substring(texts, "&"), pc.match_substring_regex(texts, NEVER))
    odd = pc.or_(odd, pc.or_(pc.match_substring_regex(texts, "<[!?]"), pc.greater(pc.binary_length(texts), min(o.max_text_node_size, o.max_xml_size))))
    other = pc.fill_null(odd, True).to_numpy(zero_copy_only=False).copy()
    while not other.all():
        here = np.flatnonzero(~other)
        made, bad = _nodes(keys.take(pa.array(here)), texts.take(pa.array(here)), schema, o)
        if made is not None:
            return made, other
        other[here[bad]] = True
    return None, other


def _true(x: pa.Array) -> np.ndarray:
    return pc.fill_null(x, False).to_numpy(zero_copy_only=False)


def _nodes(keys: pa.Array, texts: pa.Array, schema: pa.Schema, o: ParseOptions) -> tuple[pa.RecordBatch | None, np.ndarray]:
    """The nodes, or which documents stand in the way."""
    n_docs = len(texts)
    cut = pc.split_pattern(texts, "<")
    counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64) - 1
    bad = (counts < 1) | (counts > o.max_element_count) | _true(pc.match_substring_regex(pc.list_element(cut, 0), "[^ \\t\\r\\n]"))
    if bad.any():
        return None, bad
    doc = np.repeat(np.arange(n_docs), counts)
    first = np.cumsum(counts) - counts
    parts = pc.split_pattern(cut.flatten().take(pa.array(np.arange(len(doc)) + doc + 1)), ">", max_splits=1)
    broken = pc.list_value_length(parts).to_numpy(zero_copy_only=False) < 2
    if broken.any():
        bad[doc[broken]] = True
        return None, bad
    text = pc.list_element(parts, 1)
    tag = pc.extract_regex(pc.list_element(parts, 0), TAG)
    closes, single, attributed = (_true(pc.not_equal(pc.struct_field(tag, f), "")) for f in ("shut", "empty", "given"))
    broken = _true(pc.is_null(tag)) | (closes & (single | attributed))
    bad[doc[broken]] = True
    bad |= _true(pc.match_substring_regex(text.take(pa.array(first + counts - 1)), "[^ \\t\\r\\n]"))
    if bad.any():
        return None, bad
    opens, has_text = ~closes, _true(pc.not_equal(text, ""))
    step = (opens & ~single).astype(np.int64) - closes
    after = np.cumsum(step)
    after -= (after[first] - step[first])[doc]
    # The root element is the only one at its level, and closes last.
    bad = (np.minimum.reduceat(after, first) < 0) | (np.add.reduceat((after == 0).astype(np.int64), first) != 1) | (after[first + counts - 1] != 0)
    bad |= np.maximum.reduceat(after + single, first) > o.max_nesting_depth
    if bad.any():
        return None, bad
    # Of equal level, opening and closing tags take turns.
    level = after - step
    starts, ends = np.flatnonzero(opens & ~single), np.flatnonzero(closes)
    starts, ends = starts[np.argsort(after[starts], kind="stable")], ends[np.argsort(level[ends], kind="stable")]
    coded = pc.struct_field(tag, "name").dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    off = code[starts] != code[ends]
    if off.any():
        bad[doc[starts[off]]] = True
        return None, bad
    given = pc.struct_field(tag, "given")
    many = pc.count_substring_regex(given, QUOTED).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = ATTRIBUTE.findall("".join(given.filter(pa.array(attributed)).to_pylist()))
    at_ = 0
    for i, n in [(i, int(many[i])) for i in np.flatnonzero(many)]:
        if n > 1 and (n > o.max_attribute_count or len({a[0] for a in flat[at_ : at_ + n]}) < n):
            bad[doc[i]] = True
        at_ += n
    bad |= np.add.reduceat(many, first) > o.max_total_attribute_count
    if bad.any():
        return None, bad
    # Places of the nodes: two for the document, then the element and the text of each token.
    has_text &= after > 0
    made = opens.astype(np.int64) + has_text
    before = np.cumsum(made) - made + 2 * (doc + 1)
    total = int(made.sum()) + 2 * n_docs
    element, place = before[opens], (before + opens)[has_text]
    begin = before[first] - 2
    of = np.repeat(np.arange(n_docs), np.diff(np.append(begin, total)))
    kind, depth = np.zeros(total, np.int8), np.zeros(total, np.int32)
    kind[begin + 1], kind[element], kind[place] = 1, 2, 3
    depth[element], depth[place] = level[opens] + 1, after[has_text] + 1
    last = np.arange(total)
    last[before[starts]] = before[ends] - 1
    last[begin + 1] = np.append(begin[1:], total) - 1
    parent = np.full(total, -1)
    order = np.argsort(depth, kind="stable")
    edge = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    for d in range(1, len(edge) - 1):
        upper, own = order[edge[d - 1] : edge[d]], order[edge[d] : edge[d + 1]]
        parent[own] = upper[np.searchsorted(upper, own) - 1]
    child = np.flatnonzero(parent >= 0)
    by = child[np.argsort(parent[child], kind="stable")]
    new = np.flatnonzero(np.diff(parent[by], prepend=-2))
    rank = np.zeros(total, np.int32)
    rank[by] = np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by))))
    local = begin[of]
    inner = np.bincount(parent[element], minlength=total) > 0
    # Texts by the token that they follow.
    value = np.full(total, -1)
    value[place] = np.flatnonzero(has_text)
    leaf = np.where((kind == 2) & ~inner, len(text), value)
    own = place[~inner[parent[place]]]
    leaf[parent[own]] = value[own]
    pool = pa.concat_arrays([text, pa.array([""], text.type)])
    title = np.zeros(total, np.int64)
    title[begin + 1], title[place], title[element] = 1, 2, 3 + code[opens]
    titles = pa.concat_arrays([pa.array(["#prolog", "#document", "#text"], coded.dictionary.type), coded.dictionary])
    held = np.zeros(total, np.int64)
    held[element] = many[opens]
    item = schema.field("attrs").type.value_type
    pairs = pa.StructArray.from_arrays([pa.array([a[0] for a in flat], pa.string()), pa.array([a[1] or a[2] for a in flat], pa.string())], fields=[item.field(0), item.field(1)])
    offsets = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
    ints = lambda x, none=None: pa.array(x.astype(np.int32), pa.int32(), mask=none)
    at = lambda p, i: p.take(pa.array(i, mask=i < 0))
    rootless = parent < 0
    columns = {
        "doc_id": keys.take(pa.array(of)), "node_id": ints(np.arange(total) - local), "pre": ints(np.arange(total) - local),
        "parent_id": ints(parent - local, rootless), "ord": ints(rank, rootless), "depth": ints(depth), "end": ints(last - local), "kind": KINDS.take(pa.array(kind)), "name": titles.take(pa.array(title)),
        "value": at(pool, value), "leaf_text": at(pool, leaf), "attrs": pa.ListArray.from_arrays(offsets, pairs, type=schema.field("attrs").type, mask=pa.array(kind != 2)),
    }
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(total, f.type) for f in schema], schema=schema), bad
