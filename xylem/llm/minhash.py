"""Near-duplicate documents by b-bit MinHash.

Each document's set of word shingles gives 192 minima. Their low bits are packed into a signature, and 32 bands of six
minima give bucket keys. Equal sets are folded first. Within a bucket, members are compared with a pivot, round after
round, and those joined already need no more comparing; what is left after the rounds is compared in tiles of bounded size.
A candidate pair must first agree in enough signature bits (similarity corrected for chance collisions), then its link is
confirmed on the full sets. Components come from contraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, key_text, materialise
from .graph import components
from .hashing import Prefixes, random64

WORDS = 5
BANDS, ROWS, BITS = 32, 6, 2
#: An estimate this much below the threshold still goes on to the exact check: over six standard deviations.
MARGIN = 0.2
PIVOT_ROUNDS = 2
TILE = 1500
#: A set that more documents have finds its representative by a broadcast (there are at most as many such sets as rows, divided by this).
HOT_COPIES = 500
#: Keys to remove are broadcast up to this number.
BROADCAST_ROWS = 500_000
_N = BANDS * ROWS
_A = (random64(_N, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (random64(_N, 12) >> np.uint64(32)).astype(np.uint32)
_KEY = random64(ROWS + 1, 13) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: A-Z lower-cased, words split at ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    data = np.frombuffer(b" ".join(parts), np.uint8)
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(parts) - words + 1)
    return np.unique(Prefixes(data)(starts[:n], ends[len(parts) - n :]))


def minima(h: np.ndarray) -> np.ndarray:
    """The minima of 192 permutations of 32 bits of the hashes."""
    low = np.full(_N, 0xFFFFFFFF, np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(low, (x[at : at + 4096, None] * _A + _B).min(axis=0), out=low)
    return low


def pack(low: np.ndarray) -> bytes:
    """The low two bits of each minimum: first all lowest bits, then all second ones."""
    return b"".join(np.packbits((low >> np.uint32(i)) & np.uint32(1)).tobytes() for i in range(BITS))


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the b-bit values agree, for rows of packed signatures."""
    half = a.shape[-1] // BITS
    off = a ^ b
    differ = off[..., :half]
    for i in range(1, BITS):
        differ = differ | off[..., i * half : (i + 1) * half]
    return _N - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64)


def similarity(agree: np.ndarray) -> np.ndarray:
    """Jaccard similarity estimated from agreements, corrected for values that agree by chance."""
    chance = 1 / 2**BITS
    return (agree / _N - chance) / (1 - chance)


def signatures(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"], strict=True):
                h = shingles(t, words)
                if not len(h):
                    rows.append((k, 0, None, None, None))
                    continue
                low = minima(h)
                bands = (low.reshape(BANDS, ROWS).astype(np.uint64) * _KEY[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * _KEY[ROWS]
                rows.append((k, len(h), hashlib.md5(h.tobytes()).digest(), pack(low), bands.view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "n", "digest", "sig", "bands"])

    return df.select(key_text(key).alias("k"), F.col(text).cast("string").alias("t")).mapInPandas(run, "id string, n long, digest binary, sig binary, bands array<long>").withColumn("id", F.col("id").cast("long"))


def shingle_sets(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["k"].to_numpy(), "hashes": [shingles(t, words).tobytes() for t in b["t"]]})

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInPandas(run, "id long, hashes binary")


def likely(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose packed signatures agree often enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(len(b), -1) for c in ("sa", "sb"))
                yield b.loc[similarity(agreements(x, y)) >= least, ["a", "b"]]

    left, right = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs with 100 * intersection >= percent * union on the full sets (id, hashes)."""
    left, right = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["ha"], b["hb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInPandas(run, "a long, b long")


def spanning(ids: np.ndarray, comps: np.ndarray, parts: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], least: float, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a tile's members wherever any pair across them (and across the two parts) is linked."""
    comps, sizes = comps.copy(), np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(flat.max() + 1, np.int32)
    two = parts.min() != parts.max()
    out = []
    for x in range(len(ids)):
        if two and parts[x] != parts[0]:
            continue
        other = np.flatnonzero((comps != comps[x]) & ((parts != parts[x]) if two else (ids > ids[x])))
        if not len(other) or not (similarity(agreements(sigs[x], sigs[other])) >= least).any():
            continue
        own = flat[starts[x] : starts[x] + sizes[x]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts)[other]
        mark[own] = 0
        linked = other[100 * both >= percent * (sizes[x] + sizes[other] - both)]
        for y in linked:
            if comps[y] != comps[x]:
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                comps[comps == comps[y]] = comps[x]
    return out


def tiles(members: DataFrame, least: float, percent: int) -> DataFrame:
    """Links across components among (key, id, component, sig, hashes): each bucket in tiles of bounded size, no pairs as rows."""
    sized = members.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    sized = members.join(sized, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", "id", "component", "sig", "hashes", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        sigs = np.frombuffer(b"".join(b["sig"]), np.uint8).reshape(len(b), -1)
        sets = [np.frombuffer(h, np.uint64) for h in b["hashes"]]
        links = spanning(b["id"].to_numpy(), b["component"].to_numpy(), b["part"].to_numpy(), sigs, sets, least, percent)
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Sets: distinct shingles of ``words`` words; fewer words make one shingle; a null or empty text has the empty set and
    is linked with nothing. Keys are taken to be unique integers; repeated rows are copies of one another and share a
    component. An empty table gives no rows. A pair with similarity just at 0.8 misses all bands with probability 6e-5, at 0.85 with 3e-7.
    """
    least = percent / 100 - MARGIN
    signed = materialise(signatures(docs, key, text, words), "signatures")
    full = signed.filter("n > 0")
    folded = full.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = materialise(full.join(folded, (F.col("id") == F.col("rep")) & (full["digest"] == folded["digest"]), "left_semi").select("id", "sig", "bands").dropDuplicates(["id"]), "sets")
    sigs = reps.select("id", "sig")
    banded = reps.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    buckets = materialise(banded.join(shared, "key"), "buckets")
    # How central a member is: the more company it has in its buckets, the more likely its links join what is there.
    central = materialise(buckets.groupBy("id").agg(F.sum("m").alias("company")), "members")
    sets = materialise(shingle_sets(docs.join(central.filter("company > 1").select(F.col("id").alias("__xylem_id")), F.col(key) == F.col("__xylem_id"), "left_semi"), key, text, words).dropDuplicates(["id"]), "hashes")
    buckets = materialise(buckets.join(central, "id"), "buckets")
    links, labels, tested = None, None, None
    for turn in range(PIVOT_ROUNDS + 1):
        if labels is None:
            now = buckets.withColumn("component", F.col("id"))
        else:
            now = buckets.join(labels.withColumnRenamed("v", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        first = F.col("company") if turn == 0 else F.xxhash64("id", F.lit(turn))
        split = now.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max(F.struct(first, "id", "component")).alias("pivot")).filter("least <> most")
        if turn < PIVOT_ROUNDS:
            mine = now.join(split, "key").filter("component <> pivot.component")
            pairs = mine.select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            tested = materialise(likely(pairs, sigs, least), "likely")
            found = confirmed(tested, sets, percent)
        else:  # buckets of two were decided by the first pivot
            left = now.filter("m > 2").join(split.select("key"), "key", "left_semi").select("key", "id", "component")
            found = tiles(left.join(sigs, "id").join(sets, "id"), least, percent)
        found = materialise(found, "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        labels = components(links)
    rep = materialise(folded.filter("copies > 1"), "copies")
    hot = broadcast_if_small(materialise(rep.filter(F.col("copies") > HOT_COPIES).select("digest", F.col("rep").alias("hot")), "hot"), BROADCAST_ROWS)
    out = signed.select("id", "n", "digest").join(hot, "digest", "left")
    # Whoever has one, or has no set, needs no other row.
    alone = F.when(F.col("hot").isNull() & F.col("digest").isNotNull(), F.col("digest")).otherwise(F.unhex(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))))
    out = out.withColumn("digest", alone).join(rep.filter(F.col("copies") <= HOT_COPIES).select("digest", "rep"), "digest", "left").withColumn("rep", F.coalesce("hot", "rep", "id")).drop("hot")
    if labels is not None:
        out = out.join(labels.select(F.col("v").alias("rep"), "component"), "rep", "left")
    else:
        out = out.withColumn("component", F.col("rep"))
    component = F.coalesce("component", "rep")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The documents without those that a smaller key of their group stands for; same columns, whole rows."""
    gone = near_duplicates(docs, key, text, percent=percent).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("__xylem_gone"))
    gone = broadcast_if_small(materialise(gone, "gone"), BROADCAST_ROWS)
    return docs.join(gone, F.col(key) == F.col("__xylem_gone"), "left_anti")
