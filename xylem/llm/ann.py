"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by its norm times a sum of full-dimensional codewords, one from each of several codebooks. Codebooks are
trained on residuals of a bounded sample of directions; every vector is encoded by beam search over them, and its norm is stored. A query's
inner products with all codewords form a lookup table, by which codes are scored; the best are then ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BOOKS, WORDS, BEAM = 24, 256, 4
#: Vectors that the codebooks are fitted on, at most: those with the smallest hashes of their keys.
TRAIN_ROWS = 20_000
SWEEPS = 8
#: Candidates that go on to the exact ranking, for each of those asked for.
RERANK = 20
#: Queries and codes of one block; a block pair's scores are one matrix in one task.
QUERY_BLOCK, CODE_BLOCK = 512, 16_384


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNull(), False).otherwise(~bad & F.exists(vector, lambda x: x != 0))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    size = (words * words).sum(axis=1)
    return np.concatenate([(size - 2 * x[i : i + 8192] @ words.T).argmin(axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, sweeps: int = SWEEPS, seed: int = 3) -> np.ndarray:
    """Codebooks (books, words, dimensions): each fitted by Lloyd's sweeps to the residuals that those before it leave."""
    rng = np.random.default_rng(seed)
    rest, out = x.astype(np.float32), np.zeros((books, words, x.shape[1]), np.float32)
    for m in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy() if len(rest) else out[m]
        for _ in range(sweeps):
            near = _nearest(rest, c)
            n = np.bincount(near, minlength=words)
            total = np.stack([np.bincount(near, rest[:, d], minlength=words) for d in range(rest.shape[1])], axis=1)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
        out[m] = c
        rest = rest - c[_nearest(rest, c)] if len(rest) else rest
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) by beam search: after each codebook the ``beam`` sums nearest to the vector go on."""
    n, (m, k, d) = len(x), books.shape
    codes, cost, rest = np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1), np.float32), x.astype(np.float32)[:, None, :]
    for c in books:
        step = ((c * c).sum(axis=1) - 2 * (rest.reshape(-1, d) @ c.T)).reshape(n, -1, k) + cost[:, :, None]
        step = step.reshape(n, -1)
        b = min(beam, step.shape[1])
        best = np.argpartition(step, b - 1, axis=1)[:, :b]
        cost = np.take_along_axis(step, best, axis=1)
        word = best % k
        rest = np.take_along_axis(rest, (best // k)[:, :, None], axis=1) - c[word]
        codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
    return codes[np.arange(n), cost.argmin(axis=1)]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def train(vectors: DataFrame, rows: int = TRAIN_ROWS, **how) -> np.ndarray:
    """Codebooks from the directions of a bounded sample of (id, v): at most ``rows`` with the smallest hashes."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toPandas()["v"]
    x = _matrix(sample)
    return fit(x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else np.zeros((0, 1)), **how)


def index(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, norm, code) for every row of (id, v): a byte for each codebook and the stored norm."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["v"])
                norm = np.sqrt((x * x).sum(axis=1))
                codes = np.concatenate([encode((x[i : i + 512] / norm[i : i + 512, None]).astype(np.float32), sent.value) for i in range(0, len(x), 512)])
                yield pd.DataFrame({"id": b["id"].to_numpy(), "norm": norm, "code": [c.tobytes() for c in codes]})

    return vectors.mapInPandas(run, "id long, norm double, code binary")


def shortlist(queries: DataFrame, codes: DataFrame, books: np.ndarray, n_codes: int, n_queries: int, depth: int) -> DataFrame:
    """(query_id, id): each query's ``depth`` best codes by lookup tables.

    Queries meet codes in blocks: both sides are dealt into blocks by hash, a query goes to each block of codes and a code to each
    block of queries, and a task scores one pair of blocks. The blocks' bests are merged by query.
    """
    sent = queries.sparkSession.sparkContext.broadcast(books)
    m, k, d = books.shape
    qb, cb = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_codes // CODE_BLOCK))
    left = queries.select(F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("cb"), F.col("id"), F.col("v"))
    right = codes.select(F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(cb)).cast("int").alias("cb"), "id", "norm", "code")

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "id": [], "s": []}).astype({"query_id": "int64", "id": "int64", "s": "float64"})
        c = c.sort_values("id", ignore_index=True)
        ids, norm = c["id"].to_numpy(), c["norm"].to_numpy(np.float32)
        code = np.ascontiguousarray(np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), m).T.astype(np.intp))
        lookup = (_matrix(q["v"]).astype(np.float32) @ sent.value.reshape(m * k, d).T).reshape(-1, m, k)
        keep = min(depth + 1, len(ids))
        out = []
        for qid, table in zip(q["id"], lookup, strict=True):
            s = table[0][code[0]]
            for j in range(1, m):
                s += table[j][code[j]]
            s *= norm
            low = np.partition(s, len(s) - keep)[len(s) - keep]
            best = np.flatnonzero(s >= low)  # in order of id
            best = best[np.argsort(-s[best], kind="stable")][:keep]
            out.append(pd.DataFrame({"query_id": qid, "id": ids[best], "s": s[best].astype(np.float64)}))
        return pd.concat(out)

    scored = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(run, "query_id long, id long, s double")
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "id")
    return scored.filter("query_id <> id").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= depth).select("query_id", "id")


def dot(a: str, b: str) -> Column:
    """The inner product of two arrays in double precision, added from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row that ``queries`` picks, among all other rows.

    Nearness is the inner product on the original vectors, ties go to smaller keys. Vectors that are null, zero or have null or
    non-finite components take no part, neither do null keys. Fewer candidates than ``k`` are all returned. Repeated rows (equal key and
    vector) count once; vectors of another length than the most common one take no part. An empty table gives no rows.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), queries.alias("is_query")).filter(F.col("id").isNotNull() & usable(F.col("v"))).dropDuplicates(["id"])
    spark = df.sparkSession
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == lengths["d"])
    books = train(rows.select("id", "v"))
    codes = materialise(index(rows.select("id", "v"), books), "codes")
    asked = rows.filter("is_query").select("id", "v")
    near = shortlist(asked, codes, books, lengths["n"], lengths["q"] or 0, k * rerank)
    exact = near.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").join(rows.select("id", "v"), "id").select("query_id", "id", dot("q", "v").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
