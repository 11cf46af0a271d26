"""Best-fit packing by a length histogram.

Documents become token pieces. The driver sees only how many pieces each
length has (and each of a fixed number of buckets within it), packs the counts
best-fit decreasing, and gets a plan of runs: "pieces of length n with ranks
a..b go to sequences s..s+b-a at offset o". Pieces take their slots by joining
on rank within length. The plan is bounded by the sequence length, the
bucket starts by it and a row for each half million pieces.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import key_text, materialise

CAPACITY = 2048
#: Buckets within a length, at least: ranks are counted within a bucket, so a length that a third of all pieces have spreads over so many groups.
BUCKETS = 64
#: Pieces of a bucket, about: a length of more pieces than its buckets should hold gets more buckets.
BUCKET_ROWS = 500_000
SPECIAL = "<|endoftext|>"

_encoders: dict = {}


def encoder(path: str):
    """A function from texts to lists of ids, equal to what ``tokenizers`` gives for the byte-level BPE file at ``path``.

    The ranks are read from that file; texts that hold the special token go through ``tokenizers`` itself.
    """
    if path not in _encoders:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {c: chr(c) for c in plain} | {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in plain)}
        back = {v: k for k, v in chars.items()}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole: list = []

        def ids(text: str) -> list[int]:
            if any(a in text for a in added):
                if not whole:
                    whole.append(Tokenizer.from_file(path))
                return whole[0].encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[path] = ids
    return _encoders[path]


def pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: ids and a closing 0, longer ones cut into ``capacity`` ids, the first piece shorter.

    A null or empty text is one piece with the closing 0. Repeated rows give repeated pieces.
    """
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for b in batches:
            rows = []
            for k, t in zip(b["doc_id"], b["text"], strict=True):
                ids = np.array([*encode(t or ""), 0], dtype="<u4")
                n = len(ids)
                first = n % capacity or capacity
                for i, at in enumerate([0, *range(first, n, capacity)] if n > first else [0]):
                    part = ids[at : first if i == 0 else at + capacity]
                    rows.append((k, i, at, len(part), zlib.crc32(part.tobytes()), *([part.astype("int32")] if keep_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    return df.select(key_text(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, last rank, first sequence, offset).

    ``open_`` holds, for each free space, runs of sequences with just that much room; a length takes the tightest
    spaces first, whole runs at a time, and then opens new sequences with as many copies each as fit.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    spaces: list[int] = []
    made = 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if not open_[space]:
                bisect.insort(spaces, space)
            open_[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(spaces, length)
            if i == len(spaces):
                per = capacity // length
                new = -(-left // per)
                put(capacity, made, new)
                made += new
                continue
            space = spaces[i]
            first, n = open_[space].pop()
            if not open_[space]:
                spaces.pop(i)
            take = min(n, left)
            fits = min(space // length, -(-left // n)) if take == n else 1
            at = capacity - space
            for j in range(fits):
                now = min(n, left)
                rows.append((length, rank, rank + now - 1, first, at + j * length))
                rank, left = rank + now, left - now
                if now < n:  # the rest of the run has one piece less
                    put(space - j * length, first + now, n - now)
                    put(space - (j + 1) * length, first, now)
                    break
            else:
                put(space - fits * length, first, n)
    return rows


def best_fit(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Result: the pieces with ``sequence_id`` and ``offset``. Ranks are by key and piece, ties (repeated rows) in any order:
    they are equal pieces. An empty table gives an empty result. A null key stays null.
    """
    cut = materialise(pieces(df, tokenizer, key, text, capacity, keep_ids), "pieces")
    large = [(r["length"], -(-r["count"] // BUCKET_ROWS)) for r in cut.groupBy("length").count().filter(F.col("count") > buckets * BUCKET_ROWS).collect()]
    more = F.try_element_at(F.create_map(*[F.lit(x) for pair in large for x in pair]), F.col("length")) if large else F.lit(None)
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce(more, F.lit(buckets))).cast("int"))
    histogram = cut.groupBy("length", "_bucket").count().collect()  # at most capacity x buckets rows, and one for each BUCKET_ROWS pieces
    starts, total = [], defaultdict(int)
    for r in sorted(histogram):
        starts.append((r["length"], r["_bucket"], total[r["length"]]))
        total[r["length"]] += r["count"]
    spark = df.sparkSession
    runs = spark.createDataFrame(pd.DataFrame(plan(dict(total), capacity), columns=["_length", "_first", "_last", "_sequence", "_offset"]).astype("int64"), "_length long, _first long, _last long, _sequence long, _offset long")
    base = spark.createDataFrame(pd.DataFrame(starts, columns=["_length", "_b", "_start"]).astype("int64"), "_length long, _b long, _start long")
    ranked = cut.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1)
    # Both right sides are bounded by capacity and buckets.
    ranked = ranked.join(F.broadcast(base), (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_b"))).withColumn("_rank", F.col("_in") + F.col("_start")).drop("_length", "_b")
    lists = runs.groupBy("_length").agg(F.array_sort(F.collect_list(F.struct("_first", "_last", "_sequence", "_offset"))).alias("_runs"))
    slot = F.element_at(F.filter("_runs", lambda r: (r["_first"] <= F.col("_rank")) & (F.col("_rank") <= r["_last"])), 1)
    return (
        ranked.join(F.broadcast(lists), F.col("length") == F.col("_length"))
        .withColumn("_slot", slot)
        .select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), (F.col("_slot._sequence") + F.col("_rank") - F.col("_slot._first")).alias("sequence_id"), F.col("_slot._offset").alias("offset"))
    )
