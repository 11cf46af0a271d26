"""Exact repeats of long byte strings, by a distributed difference cover.

A difference cover modulo v holds, for any two positions, a shift below v that takes both onto sampled residues. So any two
equal strings of 400 bytes hold a pair of sampled positions, equally far in, with the same bytes after them. The cover is re-phased at
content-defined boundaries: a boundary is sampled itself (equal strings have it at the same place), and the cover is laid only where no
boundary came for a while, which it does for any two phases. The steps:

1. sample each document's positions, name each by the bytes that must agree there, and by its whole window
   (everything that a 400-byte string which meets at this sample can touch);
2. sort the names; sampled positions with equal neighbours form groups. Equal windows settle all strings through them at once;
3. where a group has different windows, one position of each window stands for it, and the strings through it (the non-sampled
   positions, merged in by their distance to the sample) are named in full and compared;
4. what is covered is cut out of each document.

Names are fingerprints of bounded prefixes (96 bits in step 2, 80 in step 3), not ranks: the question is only
whether 400 bytes agree, so ranks of unbounded suffixes, and the recursion that gives them, are not needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .hashing import Prefixes

LENGTH = 400
#: Words of a passage that counts as repeated, whatever its bytes.
PASSAGE = 51
_LOW = np.uint64((1 << 48) - 1)


@lru_cache(maxsize=8)
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """(v, residues): a perfect difference set of q + 1 residues modulo v = q*q + q + 1, for a prime q.

    Singer's construction: powers of a generator of the cubic extension of the field of q elements that lie in a plane.
    """
    v = q * q + q + 1
    for c in range(q**3):
        a0, a1, a2 = c % q, c // q % q, c // q // q  # x^3 = a0 + a1 x + a2 x^2
        x, found, seen = (1, 0, 0), [], set()
        for i in range(v):
            line = next((tuple(pow(lead, -1, q) * t % q for t in x) for lead in x if lead), None)
            if line is None or line in seen:
                break
            seen.add(line)
            if x[2] == 0:
                found.append(i)
            x = (a0 * x[2] % q, (x[0] + a1 * x[2]) % q, (x[1] + a2 * x[2]) % q)
        if len(seen) == v and len({(a - b) % v for a in found for b in found}) == v:
            return v, tuple(found)
    raise ValueError(f"{q} is no prime")


class Cover:
    """Where to sample for strings of ``length`` bytes.

    ``context``: bytes before a position that decide whether it is a boundary, one in ``mean`` positions. ``wait``: bytes without a boundary
    after which the cover starts. A string that starts at p meets another one at its first boundary from p + context on, or, if there is
    none in the next ``wait + v`` bytes, at a position of the cover ``wait`` bytes further or more. ``need`` bytes after a sample always agree.
    """

    def __init__(self, length: int):
        self.length, self.context, self.mean, self.wait = length, max(2, length // 25), max(4, length * 12 // 100), length * 8 // 25
        self.v, residues = difference_cover(max(q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31) if q == 2 or 3 * (q * q + q + 1) <= length))
        self.steps = np.array(residues, np.int64)
        self.span = self.context + self.wait + self.v
        self.need = length - self.span + 1

    def samples(self, first: np.ndarray, name: Prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(texts i, positions x, distances l and m) for texts laid one after another, where text i has first[i] to first[i + 1]: strings of it that start in [x - l, x - m] meet at x."""
        c, n = self.context, int(first[-1])
        edges = np.flatnonzero(name.runs(c)[:-1] < np.uint64(2**64 // self.mean)) + c if n > c else np.zeros(0, np.int64)
        of = np.searchsorted(first, edges, "right") - 1
        edges, of = edges[edges - first[of] >= c], of[edges - first[of] >= c]
        before = np.maximum(np.append(0, edges[:-1]), first[of]) if len(edges) else edges
        # Where no boundary comes for a while: the cover from there, for all such places at once.
        starts = np.sort(np.concatenate([first[:-1], edges]))
        sizes = np.diff(np.append(starts, n))
        starts, sizes = starts[sizes > self.wait], sizes[sizes > self.wait]
        steps = (np.arange(self.wait // self.v * self.v, sizes.max(initial=0), self.v)[:, None] + self.steps).ravel()
        steps = steps[steps >= self.wait]
        many = np.searchsorted(steps, sizes)
        last = np.repeat(starts, many)
        t = last + steps[np.arange(len(last)) - np.repeat(np.cumsum(many) - many, many)]
        x, last = np.concatenate([edges, t]), np.concatenate([before, last])
        m = np.concatenate([np.full(len(edges), c), np.full(len(t), c + self.wait)])
        of = np.concatenate([of, np.searchsorted(first, t, "right") - 1])
        begin, end = first[of], first[of + 1]
        l = np.minimum(np.minimum(x - last + c - 1, self.span - 1), x - begin)
        keep = (l >= m) & (x - l + self.length <= end) & (x + self.need <= end)
        return of[keep], (x - begin)[keep], l[keep], m[keep]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


#: Bytes of texts that are laid one after another, at most, unless one text has more: arrays of as many numbers stay in a core's cache.
TOGETHER = 1 << 16
#: Rows that go to Spark together.
ROWS = 200_000
FOLDED = "k long, x long, n0 long, n1 {}, others array<long>"
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def laid(keys: pa.Array, texts: pa.Array, words: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, keys, units, first) for some texts of a column at a time: their bytes (or words) one after another, text i of them from first[i] to first[i + 1].

    The bytes are those of the Arrow column. A null text has none.
    """
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    keys, i = keys.to_numpy(zero_copy_only=False), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + TOGETHER, "right")) - 1)
        own, first = data[at[i] : at[j]], at[i : j + 1] - at[i]
        yield slice(i, j), keys[i:j], *(word_units(own, first) if words else (own, first))
        i = j


def word_units(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (split at ASCII white space) of texts that are laid one after another, and the place of each text's first word."""
    gap = np.append(SPACE[data], True)
    head = ~gap[:-1]  # a word begins after white space or with its text, and ends at white space or with its text
    head[1:] &= gap[:-2]
    inside = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(data))]
    head[inside] = ~gap[inside]
    tail = ~gap[:-1] & gap[1:]
    tail[inside - 1] = ~gap[inside - 1]
    begin, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return Prefixes(data)(begin, end), np.searchsorted(begin, first)


def folded(names: list[np.ndarray], k: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Rows of equal names in a chunk become one, which carries the others (keys and positions in turn): a hot name is a row for each chunk, not for each place."""
    order = np.argsort(names[0] * 0x2545F4914F6CDD1D + names[1])
    names, k, x = [n[order] for n in names], k[order], x[order]
    new = np.ones(len(k), bool)
    new[1:] = np.logical_or.reduce([n[1:] != n[:-1] for n in names])
    first = np.flatnonzero(new)
    more = np.diff(np.append(first, len(k))) - 1
    pairs = pa.array(np.stack([k[~new], x[~new]], axis=1).ravel())
    others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(2 * more)).astype(np.int32)), pairs, mask=pa.array(more == 0))
    return pa.RecordBatch.from_arrays([pa.array(a[first]) for a in (k, x, *names)] + [others], ["k", "x", "n0", "n1", "others"])


def _gathered(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Folded rows of (k, x, first name, second name), ``ROWS`` or a little more at a time."""
    out, have = [], 0
    for part in parts:
        out.append(part)
        have += len(part[0])
        if have > ROWS:
            k, x, *names = (np.concatenate(p) for p in zip(*out, strict=True))
            yield folded(names, k, x)
            out, have = [], 0
    if out:
        k, x, *names = (np.concatenate(p) for p in zip(*out, strict=True))
        yield folded(names, k, x)


def all_places(rows: DataFrame, *more: str) -> DataFrame:
    """A row (k, x) for each place that the rows stand for."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("others"), F.lit(2)), lambda i: F.struct(F.element_at("others", i).alias("k"), F.element_at("others", i + 1).alias("x")))
    own = F.array(F.struct("k", "x"))
    return rows.select(F.explode(F.when(F.col("others").isNull(), own).otherwise(F.concat(own, pairs))).alias("_p"), *more).select("_p.k", "_p.x", *more)


def samples(df: DataFrame, length: int, words: bool = False) -> DataFrame:
    """(k, x, h, w, others) for the sampled positions of each text (k, t): names of the bytes (or words) that must agree around x and of the window around it.

    x is packed: the position and, in its low 24 bits, the two distances of the strings that meet there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Cover(length)

        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                for _, keys, data, first in laid(b.column("k"), b.column("t"), words):
                    name = Prefixes(data)
                    of, x, l, m = cover.samples(first, name)
                    at = x + first[of]
                    w = name(at - l, np.minimum(at - m + length, first[of + 1])) + l.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    h = name(at - m, at + cover.need) + m.astype(np.uint64)
                    yield keys[of], (x << 24) + (l << 12) + m, (h & _LOW).view(np.int64), (w & _LOW).view(np.int64)

        yield from _gathered(parts())

    return df.select("k", "t").mapInArrow(run, FOLDED.format("long")).withColumnsRenamed({"n0": "h", "n1": "w"})


def through(df: DataFrame, length: int, words: bool = False) -> DataFrame:
    """(k, x, a, b, others): 80-bit names of the strings that meet at the samples in ``stand`` of each text (k, t, stand); x is where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                stands = b.column("stand")
                for rows, keys, data, first in laid(b.column("k"), b.column("t"), words):
                    own = stands.slice(rows.start, len(keys))
                    of = np.repeat(np.arange(len(keys)), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                    x, l, m = unpacked(own.flatten().to_numpy(zero_copy_only=False), 1 << 39)
                    keep = x < first[of + 1] - first[of]
                    x, l, m, of = x[keep] + first[of[keep]], l[keep], m[keep], of[keep]
                    mark = np.zeros(len(data) + 1, np.int32)
                    np.add.at(mark, x - l, 1)
                    np.add.at(mark, x - m + 1, -1)
                    p = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                    of = np.searchsorted(first, p, "right") - 1
                    keep = p + length <= first[of + 1]
                    p, of = p[keep], of[keep]
                    one, two = Prefixes(data), Prefixes(data, 1)
                    for i in range(0, len(p), ROWS):
                        q, own_of = p[i : i + ROWS], of[i : i + ROWS]
                        yield keys[own_of], q - first[own_of], one(q, q + length).view(np.int64), (two(q, q + length) & np.uint64(0x7FFF)).astype(np.int16)

        yield from _gathered(parts())

    return df.select("k", "t", "stand").mapInArrow(run, FOLDED.format("short")).withColumnsRenamed({"n0": "a", "n1": "b"})


def unpacked(packed, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions within a text of ``n`` bytes and their distances."""
    v = np.asarray([] if packed is None else packed, np.int64)
    v = v[v >> 24 < n]
    return v >> 24, v >> 12 & 0xFFF, v & 0xFFF


def covered(cover, again, n: int, length: int) -> np.ndarray:
    """Whether each of ``n`` positions is covered: by windows around ``cover``, or by strings at ``again``."""
    mark = np.zeros(n + 1, np.int32)
    x, l, m = unpacked(cover, n)
    p = np.asarray([] if again is None else again, np.int64)
    p = p[p + length <= n]
    for start, end in ((x - l, np.minimum(x - m + length, n)), (p, p + length)):
        np.add.at(mark, start, 1)
        np.add.at(mark, end, -1)
    return np.cumsum(mark[:-1]) > 0


CUT_SCHEMA = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"


def cut(df: DataFrame, length: int, keep: bool) -> DataFrame:
    """Cut the covered bytes out of each text (k, t, cover, again)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, cover, again in zip(b["k"], b["t"], b["cover"], b["again"], strict=True):
                data = _bytes(t)
                gone = covered(cover, again, len(data), length)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                left = data[~gone].tobytes()
                rows.append((k, len(data), int(gone.sum()), len(edge) // 2, hashlib.sha256(left).hexdigest(), [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()] if keep else None, left if keep else None))
            yield pd.DataFrame(rows, columns=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return df.mapInPandas(run, CUT_SCHEMA)


def places(base: DataFrame, length: int, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """Where strings of ``length`` bytes (or words) of the texts (k, t) start that also start anywhere else.

    Two tables: (k, t, cover, stand) of the texts that have any, and (k, again). A text's covered positions follow from ``cover`` and ``again``.
    """
    named = samples(base.filter(F.octet_length("t") >= (2 * length - 1 if words else length)), length, words)
    group, window = Window.partitionBy("h"), Window.partitionBy("h", "w")
    many = F.col("others").isNotNull()
    seen = named.withColumn("most", F.max("w").over(group)).withColumn("least", F.min("w").over(group)).withColumn("members", F.count("*").over(group)).filter((F.col("members") > 1) | many)
    seen = seen.withColumn("turn", F.row_number().over(window.orderBy("k", "x"))).withColumn("same", F.count("*").over(window))
    seen = seen.select("k", "x", "others", ((F.col("same") > 1) | many).alias("cover"), ((F.col("most") != F.col("least")) & (F.col("turn") == 1)).alias("stand")).filter("cover or stand")
    # Whoever stands for a window stands alone; those it stands for are covered.
    placed = F.array(F.struct("k", "x", "stand"))
    rest = F.transform(F.sequence(F.lit(1), F.size("others"), F.lit(2)), lambda i: F.struct(F.element_at("others", i).alias("k"), F.element_at("others", i + 1).alias("x"), F.lit(False).alias("stand")))
    seen = seen.select("cover", F.explode(F.when(F.col("others").isNull(), placed).otherwise(F.concat(placed, rest))).alias("_p")).select("_p.*", "cover")
    lists = seen.groupBy("k").agg(F.collect_list(F.when(F.col("cover"), F.col("x"))).alias("cover"), F.collect_list(F.when(F.col("stand"), F.col("x"))).alias("stand"))
    lists = materialise(lists, "lists").filter(F.size("cover") + F.size("stand") > 0)  # all; a filter lets Spark put a Bloom filter on the texts
    touched = materialise(base.join(lists, "k"), "touched")
    full = through(touched.filter(F.size("stand") > 0).select("k", "t", "stand"), length, words)
    twice = full.withColumn("n", F.count("*").over(Window.partitionBy("a", "b"))).filter((F.col("n") > 1) | F.col("others").isNotNull())
    return touched, materialise(all_places(twice).groupBy("k").agg(F.collect_set("x").alias("again")), "again")


def repeated_passages(base: DataFrame, words: int = PASSAGE) -> DataFrame:
    """(k, n_passage_words) for the texts (k, t) with passages of ``words`` words that also start anywhere else: the words that they cover.

    The same steps over words instead of bytes: a passage of short words holds no string of 400 bytes, and counts here all the same.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "n": [int(covered(c, a, len(_bytes(t).tobytes().split()), words).sum()) for t, c, a in zip(b["t"], b["cover"], b["again"], strict=True)]})

    touched, again = places(base, words, True)
    rows = touched.select("k", "t", "cover").join(again, "k", "left").mapInPandas(run, "k long, n long")
    return materialise(rows.groupBy("k").agg(F.max("n").alias("n_passage_words")).filter("n_passage_words > 0"), "passages")


def repeated_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: bool = False, passage: int | None = None) -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which also starts anywhere else.

    Result: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep`` the removed spans and the bytes kept. ``passage`` adds
    ``n_passage_words``: words in passages of so many words that also start anywhere else; they are reported, not removed.
    Null and empty texts have no bytes. Keys are integers above -2^62 and tell texts apart; repeated rows are copies of one another, and so lose
    everything if long enough. Rows with a null key are told apart by their texts. An empty table gives an empty result.
    """
    nameless = F.lit(-(2**62)) - F.xxhash64(F.col(text).cast("string")).bitwiseAND(2**61 - 1)
    base = docs.select(F.coalesce(F.col(key).cast("long"), nameless).alias("k"), F.col(text).cast("string").alias("t"))
    touched, again = places(base, length)
    done = cut(touched.select("k", "t", "cover").join(again, "k", "left"), length, keep)
    whole = base.select("k", F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce(F.encode("t", "UTF-8"), F.lit(b"")), 256).alias("kept_sha256"), *([F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.coalesce(F.encode("t", "UTF-8"), F.lit(b"")).alias("kept")] if keep else []))
    names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if keep else [])]
    out = done.select(names).unionByName(whole.join(touched.select("k").distinct(), "k", "left_anti").select(names))
    if passage:
        out = out.join(repeated_passages(base, passage), "k", "left").withColumn("n_passage_words", F.coalesce("n_passage_words", F.lit(0)).cast("long"))
        names.append("n_passage_words")
    return out.select(F.when(F.col("k") > -(2**62), F.col("k")).alias("doc_id"), *names[1:])
