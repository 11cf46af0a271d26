"""Language identification by multilingual mixture inference.

Letters' trigrams, hashed into a fixed number of buckets, are counted for each language over all training documents. A document's
words are drawn from a mixture of languages: expectation-maximisation over the words' trigram likelihoods estimates the
proportions, and languages join the document's set one by one while the penalised likelihood rises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: log2 of the trigram buckets; the model has as many numbers for each language, whatever the size of the corpus.
BUCKET_BITS = 16
SMOOTHING = 0.2
#: Log-likelihood that a further language must bring, for each natural logarithm of the number of words.
PENALTY = 3.0
#: A language that a mixture of all gives no more than this share is not tried for a document's set.
LEAST_SHARE = 1e-3
ROUNDS = 8
#: Characters worked on at once.
CHUNK = 1_000_000

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def crc_rest(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def split_text(text: str, limit: int = CHUNK) -> Iterator[str]:
    """The text in pieces of at most ``limit`` characters, cut at a blank where there is one in the last part."""
    at = 0
    while len(text) - at > limit:
        end = text.rfind(" ", at + limit // 2, at + limit) + 1 or at + limit
        yield text[at:end]
        at = end
    yield text[at:]


def trigrams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter, where words start among them, and the piece of each word."""
    low = [p.lower() for p in pieces]
    c = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[np.minimum(c, 0x10FFFF)]
    c = np.where(is_letter, c, np.uint32(32))
    at = np.flatnonzero(is_letter)
    h = c[at - 1] * np.uint32(0x9E3779B1) + c[at] * np.uint32(0x85EBCA6B) + c[at + 1] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h = h >> np.uint32(32 - BUCKET_BITS)
    starts = np.flatnonzero(~is_letter[at - 1])
    ends = np.cumsum([len(p) + 1 for p in low])
    return h, starts, np.searchsorted(ends, at[starts], "right")


def chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of pieces of texts, of bounded size, with the number of the text of each."""
    of, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        for p in split_text(t or ""):
            if size + len(p) > CHUNK and pieces:
                yield of, pieces
                of, pieces, size = [], [], 0
            of.append(i)
            pieces.append(p)
            size += len(p)
    if pieces:
        yield of, pieces


def count_trigrams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all rows, summed within a task before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, rows in b.groupby("lang"):
                mine = sums.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
                for _, pieces in chunks(rows["text"].tolist()):
                    mine += np.bincount(trigrams(pieces)[0], minlength=1 << BUCKET_BITS)
        for name, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pd.DataFrame({"lang": name, "bucket": at.astype(np.int32), "n": mine[at]})

    rows = df.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    return rows.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket and language) from all rows with a text and a language.

    The driver receives at most 2^16 numbers for each language.
    """
    got = count_trigrams(df, text, lang).toPandas()
    names = sorted(got["lang"].unique())
    counts = np.zeros((1 << BUCKET_BITS, len(names)))
    counts[got["bucket"].to_numpy(int), np.searchsorted(np.array(names, object), got["lang"].to_numpy(object)) if names else []] = got["n"].to_numpy()
    total = counts.sum(axis=0)
    return names, np.log((counts + SMOOTHING) / (total + SMOOTHING * len(counts))).astype(np.float32)


def word_likelihoods(texts: list[str | None], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of each word by language, and the text of each word (ascending)."""
    ll, of = [np.zeros((0, logp.shape[1]), np.float32)], [np.zeros(0, np.int64)]
    for number, pieces in chunks(texts):
        h, starts, piece = trigrams(pieces)
        if len(starts):
            ll.append(np.add.reduceat(logp[h], starts, axis=0))
            of.append(np.array(number, np.int64)[piece])
    return np.concatenate(ll), np.concatenate(of)


def maximise(p: np.ndarray, first: np.ndarray, of: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after rounds of expectation-maximisation, and each text's log of the mixture. Zero shares stay zero."""
    n = np.diff(np.append(first, len(p)))[:, None]
    for _ in range(ROUNDS):
        part = p * shares[of]
        part /= part.sum(axis=1, keepdims=True)
        shares = np.add.reduceat(part, first, axis=0) / n
    return shares, np.add.reduceat(np.log((p * shares[of]).sum(axis=1)), first)


def infer(texts: list[str | None], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions by text and language after selection, number of words); a text without letters has zeros."""
    langs = logp.shape[1]
    ll, word_text = word_likelihoods(texts, logp)
    out, words = np.zeros((len(texts), langs)), np.bincount(word_text, minlength=len(texts))
    if not len(ll) or not langs:
        return out, words
    here = np.flatnonzero(words)
    of = np.searchsorted(here, word_text)
    first = np.searchsorted(word_text, here)
    p = np.maximum(np.exp((ll - ll.max(axis=1, keepdims=True)).astype(np.float32)), np.float32(1e-30))
    flat, _ = maximise(p, first, of, np.full((len(here), langs), 1 / langs, np.float32))
    single = np.add.reduceat(np.log(p), first, axis=0)
    best = single.argmax(axis=1)
    rows = np.arange(len(here))
    chosen = np.zeros((len(here), langs), np.float32)
    chosen[rows, best] = 1
    score = single[rows, best]
    flat[rows, best] = 2
    ranked = np.argsort(-flat, axis=1, kind="stable")
    need = PENALTY * np.log(1 + words[here])
    for step in range(1, langs):  # the likelier ones first; one that does not pay leaves the set as it was
        live = np.flatnonzero(flat[rows, ranked[:, step]] > LEAST_SHARE)
        if not len(live):
            break
        mine = np.isin(of, live) if len(live) < len(here) else slice(None)
        sub_of = np.searchsorted(live, of[mine])
        start = chosen[live] * np.float32(0.8)
        start[np.arange(len(live)), ranked[live, step]] = 0.2
        shares, mixed = maximise(p[mine], np.searchsorted(sub_of, np.arange(len(live))), sub_of, start)
        better = mixed - score[live] > need[live]
        live, shares = live[better], shares[better]
        chosen[live], score[live] = shares, mixed[better]
    out[here] = chosen
    return out, words


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (its proportion) and ``lang_set`` (name:proportion, largest first); such columns are replaced.

    A text that is null or has no letters, or a model without languages, gives ``und``, 0 and ''. Equal texts get equal results.
    """
    names, logp = model
    sent = df.sparkSession.sparkContext.broadcast((names, logp))
    df = df.drop("lang_pred", "score", "lang_set")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = sent.value
        for b in batches:
            shares, _ = infer(b.column(b.schema.get_field_index(text)).to_pylist(), logp)
            top = shares.argmax(axis=1) if names else np.zeros(len(shares), int)
            score = shares.max(axis=1) if names else np.zeros(len(shares))
            pred = [names[i] if s > 0 else "und" for i, s in zip(top, score, strict=True)]
            sets = [",".join(f"{names[j]}:{row[j]:.3f}" for j in np.argsort(-row, kind="stable") if row[j] > 0) for row in shares]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(sets, pa.string())], names=[*b.schema.names, "lang_pred", "score", "lang_set"])

    return df.mapInArrow(run, schema)


def train_and_identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the documents whose crc32(key) mod 5 is not 0, and identify all."""
    return identify(docs, learn(docs.filter(crc_rest(F.col(key), 5) != 0), text, lang), text)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents with a language of their own, which replaces the one in ``lang``; those without letters go."""
    found = train_and_identify(docs, key, text, lang).filter("lang_pred <> 'und'")
    return found.withColumn(lang, F.col("lang_pred")).select(docs.columns)
