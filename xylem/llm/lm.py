"""A gated recurrent language model for scoring whole documents.

Words are counted over all training documents. The most frequent ones are the model's vocabulary, sorted into classes by frequency; the
output is a softmax over classes times a softmax within the class, and a word outside the vocabulary is the unknown word times its share of
the rest. The model is warmed up on a bounded sample, then every shard of the training documents trains a copy by truncated
backpropagation, and the copies are averaged. For scoring, documents are laid into lanes and the state is carried from window
to window, so each gets the likelihood of all its words.
"""

from __future__ import annotations

import ctypes
import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import groupby, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .language import crc_rest

HIDDEN, CLASSES, CLASS_SIZE = 32, 64, 64
#: Words whose counts all executors hold; the counts of others are joined.
HEAD = 150_000
#: Words of the warm-up sample (a bounded one); the distributed training takes all training documents.
WARM_TOKENS = 400_000
LANES, WINDOW, RATE = 128, 32, 0.2
#: Words of one shard of the distributed training, and copies that are averaged at once.
SHARD_TOKENS, FAN_IN = 4_000_000, 8
SCORE_LANES, SCORE_WINDOW = 256, 128
#: Words that a scoring task gathers before it lays them into lanes: the more, the fewer lanes stand empty beside a long document.
SCORE_TOKENS = 2_000_000
#: Distinct words that a counting task holds before it passes them on.
COUNTED = 400_000
#: Bytes of texts whose words are counted at once.
COUNTED_BYTES = 8 << 20
#: Bytes of rows that are encoded at once, so that the table of the head's words, which Arrow makes each time, is small beside them.
ENCODED_BYTES = 4 << 20
#: Rows of a softmax that are scored at once, so that they stay in a core's cache.
BLOCK = 4096
END = b""


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The :func:`words` of many texts, one after another, and where each text's begin (and the last one's end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    flat, bounds = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    real = pc.binary_length(flat).to_numpy() > 0
    if not real.all():  # a text without words is split into one empty one
        flat, bounds = flat.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[bounds]
    return flat, bounds


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size`` bytes or more."""
    own, have = [], 0
    for b in batches:
        own.append(b)
        have += b.nbytes
        if have >= size:
            yield from pa.Table.from_batches(own).combine_chunks().to_batches()
            own, have = [], 0
    if own:
        yield from pa.Table.from_batches(own).combine_chunks().to_batches()


def _added(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(["word", "c"])


def count_words(df: DataFrame) -> DataFrame:
    """(word, c) over all rows of (text); the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, more, ends = [], 0, 0
        for b in _gathered(batches, COUNTED_BYTES):
            ends += len(b)
            found = pc.value_counts(cut(b.column(0))[0])
            mine.append(pa.table({"word": found.field("values"), "c": found.field("counts")}))
            more += len(found)
            if more > COUNTED:
                mine, more = [_added(mine)], 0
                if len(mine[0]) > COUNTED:
                    yield from mine.pop().to_batches()
        if ends:
            mine.append(pa.table({"word": pa.array([END], pa.binary()), "c": np.array([ends], np.int64)}))
            yield from _added(mine).to_batches()

    return df.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """``x``: input weights by word (3 gates); ``u``: recurrent weights; ``wc``, ``bc``: classes; ``wo``, ``bo``: words within their class."""

    x: np.ndarray
    u: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    wo: np.ndarray
    bo: np.ndarray

    NAMES = ("x", "u", "wc", "bc", "wo", "bo")

    @staticmethod
    def start(freq: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 5) -> Model:
        """Small random weights, and biases that make it the unigram model of ``freq`` (by id, most frequent first)."""
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        by = np.maximum(freq, 0.5).reshape(classes, -1)
        return Model(small(len(freq), 3 * hidden), small(hidden, 3 * hidden), small(hidden, classes) * 0, np.log(by.sum(axis=1) / by.sum()).astype(np.float32), small(len(freq), hidden) * 0, np.log(by / by.sum(axis=1, keepdims=True)).astype(np.float32).ravel())

    @property
    def hidden(self) -> int:
        return len(self.u)

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Input and recurrent weights by gate (update and reset, halved, then candidate), each one block of memory."""
        x, u = (np.ascontiguousarray(w.reshape(len(w), 3, self.hidden).swapaxes(0, 1)) for w in (self.x, self.u))
        for w in (x, u):
            w[:2] *= 0.5  # a gate is (1 + tanh(its input / 2)) / 2
        return x, u

    def run(self, ids: np.ndarray, h: np.ndarray, end: int, keep: bool = False, gates: tuple[np.ndarray, np.ndarray] | None = None):
        """Hidden states for inputs (steps, lanes) from state ``h``, which starts anew at each end; with ``keep`` also what training needs. ``gates``: what :meth:`gates` gives, if at hand."""
        (steps, lanes), size, kind = ids.shape, self.hidden, self.u.dtype
        weights, u = gates or self.gates()
        x = np.take(weights, ids, axis=1) if keep else np.empty((3, 1, lanes, size), kind)  # a step's inputs turn into its gates and its candidate
        ended = ids == end
        any_ended = ended.any(axis=1).tolist()
        hs = np.empty((steps, lanes, size), kind)
        before, a = np.empty((steps if keep else 1, lanes, size), kind), np.empty((steps if keep else 1, lanes, size), kind)
        own, more = np.empty((2, lanes, size), kind), np.empty((lanes, size), kind)
        for t in range(steps):
            at = t if keep else 0
            if not keep:
                np.take(weights, ids[t], axis=1, out=x[:, 0], mode="clip")  # unlike the usual mode it fills the place itself
            b, to_cand, zr, cand = before[at], a[at], x[:2, at], x[2, at]
            b[...] = h
            if any_ended[t]:
                b[ended[t]] = 0
            np.matmul(b, u[:2], out=own)
            np.matmul(b, u[2], out=to_cand)
            zr += own
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            cand += np.multiply(zr[1], to_cand, out=more)
            np.tanh(cand, out=cand)
            h = np.subtract(b, cand, out=hs[t])
            h *= zr[0]
            h += cand
        return (hs, h, (before, a, x), (ended, any_ended), u) if keep else (hs, h)

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of words ``y`` after states ``h``: the class, then the word in its class."""
        size = len(self.bo) // len(self.bc)
        c, out = y // size, np.empty(len(y), h.dtype)
        for b in range(0, len(y), BLOCK):
            s = h[b : b + BLOCK] @ self.wc
            s += self.bc
            out[b : b + BLOCK] = s[np.arange(len(s)), c[b : b + BLOCK]] - _log_sum(s)
        order, bounds = _by_class(c, len(self.bc))
        h, y, more = np.take(h, order, axis=0), y[order], np.empty_like(out)
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(k * size, (k + 1) * size)
            to = np.ascontiguousarray(self.wo[part].T)
            for b in range(bounds[k], bounds[k + 1], BLOCK):
                e = min(b + BLOCK, bounds[k + 1])
                s = h[b:e] @ to
                s += self.bo[part]
                more[b:e] = s[np.arange(e - b), y[b:e] - k * size] - _log_sum(s)
        out[order] += more
        return out


def _sums(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Exponentials of the values, the sum of each row, and what was taken from each row before: nothing, or its maximum where a sum would leave the range of the type."""
    ones = np.ones(s.shape[1], s.dtype)
    with np.errstate(over="ignore"):
        e = np.exp(s)
        total = e @ ones
    if not len(total) or (total.min() > 1e-30 and total.max() < 1e30):
        return e, total, None
    top = s.max(axis=1)
    np.exp(np.subtract(s, top[:, None], out=e), out=e)
    return e, e @ ones, top


def _log_sum(s: np.ndarray) -> np.ndarray:
    """The log of the sum of exponentials of each row."""
    _, total, top = _sums(s)
    out = np.log(total, out=total)
    return out if top is None else out + top


def _by_class(c: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by class, and where each class begins there."""
    order = np.argsort(c.astype(np.min_scalar_type(classes)), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(c, minlength=classes))])


def _shares(s: np.ndarray, scale: float) -> np.ndarray:
    """The softmax of each row times ``scale``."""
    e, total, _ = _sums(s)
    e *= (scale / total)[:, None]
    return e


def _by_word(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``ids``, those that stand there least often first, and for each the sum (parts, words, size) of its columns of ``x`` (parts, ids, size).

    Words that stand there equally often are one block of memory, whose sums are taken at once; those that stand there often are summed one by one.
    """
    order = np.argsort(ids, kind="stable")
    sorted_ = ids[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    times = np.diff(np.append(first, len(ids)))
    by = np.argsort(times, kind="stable")
    first, times = first[by], times[by]
    starts = np.cumsum(times) - times
    x = np.take(x, order[np.repeat(first - starts, times) + np.arange(len(ids))], axis=1)
    out = np.empty((len(x), len(first), x.shape[2]), x.dtype)
    ones = np.ones(int(times[-1]), x.dtype)
    few = np.searchsorted(times, np.arange(1, 10))
    for n, (b, e) in enumerate(zip(few.tolist(), few[1:].tolist()), 1):
        if b < e:
            part = x[:, int(starts[b]) : int(starts[b]) + n * (e - b)].reshape(len(x), e - b, n, -1)
            np.add.reduce(part, axis=2, out=out[:, b:e])
    for k in range(int(few[-1]), len(first)):
        np.matmul(ones[: times[k]], x[:, starts[k] : starts[k] + times[k]], out=out[:, k])
    return sorted_[first], out


@lru_cache(maxsize=1)
def keep_memory() -> None:
    """Let this process keep up to 64 MB of what it frees. By default glibc gives a window's arrays back to the system and each window
    faults them in again, page by page: 0.88 of 3.1 microseconds a word of training."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):  # another C library
        return
    mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
    mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def _places(lookup: dict[bytes, int], own: list[bytes]) -> np.ndarray:
    """The place of each word in the head, -1 outside."""
    return np.fromiter(map(lookup.get, own, repeat(-1)), np.int64, len(own))


class Trainer:
    """Truncated backpropagation with per-weight step sizes (the root of summed squared gradients)."""

    def __init__(self, model: Model, end: int, rate: float = RATE):
        self.m, self.end, self.rate = replace(model, **{k: getattr(model, k).copy() for k in Model.NAMES}), end, rate
        self.sums = {k: np.full_like(getattr(model, k), 1e-2) for k in Model.NAMES}
        self.x = model.gates()[0]  # input weights by gate, kept up with those of the model
        self.seen = 0

    def _step(self, name: str, grad: np.ndarray, rows=slice(None)) -> None:
        w, s = getattr(self.m, name), self.sums[name]
        total = grad * grad
        if isinstance(rows, slice):
            s += total
            np.sqrt(s, out=total)
        else:
            total += np.take(s, rows, axis=0)
            s[rows] = total
            np.sqrt(total, out=total)
        np.divide(grad, total, out=total)
        total *= self.rate
        w[rows] -= total

    def window(self, ids: np.ndarray, y: np.ndarray, h: np.ndarray, full: int = 0) -> np.ndarray:
        """Learn from one window (steps, lanes); the state goes on, gradients stop at its start. One of fewer than ``full`` words counts for as much less."""
        m, size = self.m, self.m.hidden
        hs, last, (before, a, x), (ended, any_ended), u = m.run(ids, h, self.end, True, (self.x, replace(m, x=m.x[:0]).gates()[1]))
        flat, yf = hs.reshape(-1, size), y.ravel()
        n = len(yf)
        every, scale = np.arange(n), 16 / max(n, full)
        classes, per = len(m.bc), len(m.bo) // len(m.bc)
        # Words in the order of their classes: each class is one block of rows.
        c = yf // per
        order, bounds = _by_class(c, classes)
        c, f, ones = c[order], np.take(flat, order, axis=0), np.ones(n, hs.dtype)
        p = f @ m.wc
        p += m.bc
        p = _shares(p, scale)
        p[every, c] -= scale
        gwc, gbc = f.T @ p, ones @ p
        q, d = np.empty((n, per), hs.dtype), np.empty_like(f)
        here = np.flatnonzero(np.diff(bounds))
        gwo, gbo = (np.empty_like if len(here) == classes else np.zeros_like)(m.wo), np.zeros_like(m.bo)
        own = [(slice(bounds[k], bounds[k + 1]), slice(k * per, (k + 1) * per)) for k in here.tolist()]
        for at, part in own:
            np.matmul(f[at], m.wo[part].T, out=q[at])
            q[at] += m.bo[part]
        q = _shares(q, scale)
        q[every, yf[order] - c * per] -= scale
        for at, part in own:
            np.matmul(q[at], m.wo[part], out=d[at])
            np.matmul(q[at].T, f[at], out=gwo[part])
            np.matmul(ones[at], q[at], out=gbo[part])
        d += p @ m.wc.T
        dh = np.empty_like(d)
        dh[order] = d
        dh = dh.reshape(hs.shape)
        # What does not depend on later steps is computed for all steps at once.
        z, r, cand = x
        rest = 1 - z
        to_z = before - cand
        to_z *= z
        to_z *= rest
        to_cand = cand * cand
        np.subtract(1, to_cand, out=to_cand)
        to_cand *= rest
        to_r = np.subtract(1, r, out=rest)
        to_r *= r
        to_r *= a
        d = np.empty((4, *hs.shape), hs.dtype)  # of the candidate's recurrent part, of the two gates and of the candidate
        after, parts, back = np.zeros_like(before[0]), np.empty((3, *before[0].shape), hs.dtype), np.ascontiguousarray(u[[2, 0, 1]].swapaxes(1, 2))
        back[1:] *= 2
        for t in range(len(ids) - 1, -1, -1):
            g = dh[t]
            g += after
            dn = np.multiply(g, to_cand[t], out=d[3, t])
            np.multiply(dn, r[t], out=d[0, t])
            np.multiply(g, to_z[t], out=d[1, t])
            np.multiply(dn, to_r[t], out=d[2, t])
            np.matmul(d[:3, t], back, out=parts)
            g *= z[t]
            np.add(parts[0], parts[1], out=after)
            after += parts[2]
            after += g
            if any_ended[t]:
                after[ended[t]] = 0
        d = d.reshape(4, n, size)
        gu = before.reshape(n, size).T @ d[:3]
        rows, gx = _by_word(ids.ravel().astype(np.min_scalar_type(len(m.x))), d[1:])
        self._step("x", np.concatenate(list(gx), axis=1), rows)
        for name, grad in (("u", np.concatenate([gu[1], gu[2], gu[0]], axis=1)), ("wc", gwc), ("bc", gbc), ("wo", gwo), ("bo", gbo)):
            self._step(name, grad)
        for own, new in zip(self.x, replace(m, x=np.take(m.x, rows, axis=0)).gates()[0], strict=True):
            own[rows] = new
        self.seen += n
        return last

    def learn(self, stream: Iterator[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> None:
        """Learn from texts (ids with the end), laid into lanes of nearly the same length, in each one in the order of the stream; at the end the lanes that still hold words go on."""
        keep_memory()
        texts = list(stream)
        own = _dealt([len(t) for t in texts], lanes)
        flat = [np.concatenate([texts[i] for i in sorted(k)]) if k else np.empty(0, np.int64) for k in own]
        del texts
        sizes = np.array([len(f) for f in flat])
        h, prev = np.zeros((lanes, self.m.hidden), np.float32), np.full(lanes, self.end)
        at = 0
        while len(live := np.flatnonzero(sizes > at)):
            steps = min(window, int(sizes[live].min()) - at)
            y = np.stack([flat[k][at : at + steps] for k in live], axis=1).astype(np.int64)
            x = np.concatenate([prev[None, live], y[:-1]])
            prev[live] = y[-1]
            h[live] = self.window(x, y, h[live], lanes * window)
            at += steps


def _dealt(sizes: list[int], lanes: int) -> list[list[int]]:
    """Texts by lane: the longest first, each into the emptiest lane."""
    heap, own = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n, k = heapq.heappop(heap)
        own[k].append(i)
        heapq.heappush(heap, (n + sizes[i], k))
    return own


def lane_scores(model: Model, texts: list[np.ndarray], end: int, lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
    """Natural log-likelihood of each text (ids with the end): longest texts first into the emptiest lane, states carried on."""
    keep_memory()
    out = np.zeros(len(texts))
    lanes = min(lanes, len(texts))
    if not lanes:
        return out
    mine = _dealt([len(t) for t in texts], lanes)
    gates = model.gates()
    mine.sort(key=lambda own: -sum(len(texts[i]) for i in own))
    flat = [np.concatenate([texts[i] for i in own]) for own in mine]
    of = [np.repeat(np.array(own, np.int32), [len(texts[i]) for i in own]) for own in mine]
    sizes = np.array([len(f) for f in flat])
    h, prev = np.zeros((lanes, model.hidden), np.float32), np.full(lanes, end)
    for at in range(0, int(sizes[0]), window):
        k = int((sizes > at).sum())
        steps = min(window, int(sizes[0]) - at)
        y, doc = np.full((steps, k), end), np.full((steps, k), -1)
        for j in range(k):
            part = flat[j][at : at + steps]
            y[: len(part), j], doc[: len(part), j] = part, of[j][at : at + steps]
        x = np.concatenate([prev[None, :k], y[:-1]])
        hs, h = model.run(x, h[:k], end, gates=gates)
        prev = y[-1]
        real = doc.ravel() >= 0
        out += np.bincount(doc.ravel()[real], model.log_probs(hs.reshape(-1, model.hidden)[real], y.ravel()[real]), len(texts))
    return out


@dataclass
class Vocabulary:
    """Head words with their counts, the model's id of each, and the totals."""

    head: list[bytes]
    counts: np.ndarray
    ids: np.ndarray
    unknown: int
    end: int
    freq: np.ndarray
    tokens: int
    distinct: int
    rest_tokens: int
    rest_distinct: int

    @staticmethod
    def of(head: list[tuple[bytes, int]], tokens: int, distinct: int, size: int) -> Vocabulary:
        head = sorted(((w, c) for w, c in head), key=lambda x: (-x[1], x[0]))
        inside = [(w, c) for w, c in head if w != END][: size - 2]
        ends = next((c for w, c in head if w == END), 0)
        rest = tokens - ends - sum(c for _, c in inside)
        ranked = sorted([*inside, (None, rest), (END, ends)], key=lambda x: (-x[1], x[0] is None, x[0] or b""))
        place = {w: i for i, (w, _) in enumerate(ranked)}
        freq = np.zeros(size)
        freq[: len(ranked)] = [c for _, c in ranked]
        words_ = [w for w, _ in head]
        return Vocabulary(words_, np.array([c for _, c in head], np.int64), np.array([place.get(w, place[None]) for w in words_], np.int64), place[None], place[END], freq, tokens, distinct, rest, max(0, distinct - len(inside) - (ends > 0)))

    def lookup(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.head)}


def _ids(v: Vocabulary, places: dict[bytes, int], text: str | None) -> np.ndarray:
    at = _places(places, words(text))
    return np.append(np.where(at >= 0, v.ids[at], v.unknown) if len(at) and len(v.ids) else np.full(len(at), v.unknown), v.end)


def _kind(v: Vocabulary) -> np.dtype:
    """What the model's ids are stored as."""
    return np.min_scalar_type(max(1, len(v.freq) - 1))


def _order() -> Column:
    """The place of a row (key, text) in training."""
    return F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def vocabulary(counts: DataFrame, head: int = HEAD, size: int = CLASSES * CLASS_SIZE) -> Vocabulary:
    """The head: all words down to the lowest count that keeps it within ``head`` words (found from the histogram of counts), and the end."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    histogram = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(head).collect()
    least, have = None, 0
    for r in histogram:
        have += r["n"]
        if have > head and least is not None:
            break
        least = r["c"]
    rows = counts.filter((F.col("c") >= F.lit(least or 0)) | (F.length("word") == 0)).toPandas() if least is not None else pd.DataFrame({"word": [], "c": []})
    pairs = [(bytes(w), int(c)) for w, c in zip(rows["word"], rows["c"], strict=True)]
    return Vocabulary.of(pairs, int(total["n"] or 0), int(total["v"]), size)


MODEL_SCHEMA = "shard long, n long, blob binary"


def _packed(shard: int, t: Trainer) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "n": [t.seen], "blob": [pickle.dumps({k: getattr(t.m, k) for k in Model.NAMES})]})


def _mean(b: pd.DataFrame) -> pd.DataFrame:
    """One copy for several, weighted by their words, summed in the order of their shards."""
    b, total = b.sort_values("shard"), {}
    n = int(b["n"].sum())
    for weight, blob in zip(b["n"] / n, b["blob"], strict=True):
        for k, w in pickle.loads(blob).items():
            total[k] = total.get(k, 0) + w.astype(np.float64) * weight
    return pd.DataFrame({"shard": [int(b["shard"].iloc[0])], "n": [n], "blob": [pickle.dumps({k: w.astype(np.float32) for k, w in total.items()})]})


def train(docs: DataFrame, v: Vocabulary, warm_tokens: int = WARM_TOKENS, shard_tokens: int = SHARD_TOKENS) -> Model:
    """A model of the training rows, (key, text) or (o, ids) as :func:`score` has encoded them: warmed up on a bounded sample, trained by shard on all rows, averaged.

    Rows are dealt to shards by a hash of key and text (``o``), and sorted by it there, so the model does not depend on how the input is
    partitioned, and a task that runs again gives what it gave. Copies are averaged in a tree: a task holds the sum and one copy, the driver ``FAN_IN``.
    """
    spark = docs.sparkSession
    what = "ids" if "ids" in docs.columns else "text"
    docs = docs if what == "ids" else docs.select("text", _order().alias("o"))
    sent = spark.sparkContext.broadcast(replace(v, head=[]) if what == "ids" else v)

    def texts(rows: Iterator) -> Iterator[np.ndarray]:
        places = sent.value.lookup()
        kind = _kind(sent.value)
        for t in rows:
            yield np.frombuffer(t, kind) if what == "ids" else _ids(sent.value, places, t)

    def warm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Trainer(Model.start(sent.value.freq), sent.value.end)

        def some() -> Iterator[np.ndarray]:
            n = 0
            for ids in texts(x for b in batches for x in b[what]):
                yield ids
                n += len(ids)
                if n >= warm_tokens:
                    return

        t.learn(some())
        yield _packed(0, t)

    if not int(v.freq[v.end]):
        return Model.start(v.freq)
    parts = max(1, v.tokens // max(1, warm_tokens))  # of which one is the sample
    sample = docs.select(what, "o").filter(F.pmod(F.xxhash64("o", F.lit("warm")), F.lit(parts)) == 0)
    warmed = sample.repartition(1).sortWithinPartitions("o", what).select(what).mapInPandas(warm, MODEL_SCHEMA).first()
    first = Model(**pickle.loads(warmed["blob"])) if warmed else Model.start(v.freq)
    begun = spark.sparkContext.broadcast(first)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shards stand one after another in a partition; each trains a copy of its own."""
        rows = ((s, x) for b in batches for s, x in zip(b["shard"], b[what], strict=True))
        for shard, own in groupby(rows, key=lambda r: r[0]):
            t = Trainer(begun.value, sent.value.end, RATE / 2)
            t.learn(texts(x for _, x in own))
            yield _packed(int(shard), t)

    shards = max(1, -(-v.tokens // shard_tokens))
    dealt = docs.select(what, "o").withColumn("shard", F.pmod(F.xxhash64("o", F.lit("shard")), F.lit(shards)))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "o", what).select("shard", what)
    level = materialise(dealt.mapInPandas(each, MODEL_SCHEMA), "trained")
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        level = materialise(level.withColumn("g", F.pmod("shard", F.lit(shards))).groupBy("g").applyInPandas(lambda b: _mean(b).assign(shard=b["g"].iloc[0]), MODEL_SCHEMA), "trained")
    last = level.toPandas()
    return Model(**pickle.loads(_mean(last)["blob"][0])) if len(last) else first


ENCODED = "key string, held_out boolean, o long, n_tokens long, n_known long, base double, score double, ids binary, n_rest long, rest array<struct<word:binary,n:long>>"
SCORED = "key string, held_out boolean, n_tokens long, n_known long, base double, score double, row long"


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held: int = 2, of: int = 7) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row, log10.

    Learns from the rows whose crc32(key) mod ``of`` is not ``held``. A null text is an empty one and has only its end; repeated rows have equal
    results; with no training rows all counts are 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), (crc_rest(F.col(key), of) == held).alias("held_out"))
    counts = materialise(count_words(rows.filter("not held_out")), "counts")
    v = vocabulary(counts)
    sent = spark.sparkContext.broadcast(v)
    all_base, all_rest = math.log10(v.tokens + v.distinct + 1), math.log10(v.rest_tokens + v.rest_distinct + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        head, kind = pa.array(v.head, pa.binary()), _kind(v)
        end_at = v.head.index(END) if END in v.head else -1  # there were no training rows: the end is as unseen as all else
        counted = np.log10(np.append(v.counts, 0) + 1.0)  # the last one is for words outside the head, whose place is -1
        ids = np.append(v.ids, v.unknown)
        outside = ids == v.unknown
        for b in _gathered(batches, ENCODED_BYTES):
            if not len(b):
                continue
            flat, bounds = cut(b["text"])
            here = pc.fill_null(pc.index_in(flat, value_set=head), -1).to_numpy()
            ends = bounds[1:] + np.arange(len(b))  # each text's end comes after its words
            starts, word = bounds[:-1] + np.arange(len(b)), np.ones(len(here) + len(b), bool)
            word[ends] = False
            at = np.full(len(word), end_at)
            at[word] = here
            n, logs, rare = ends - starts + 1, counted[at], outside[at] & word
            ids_ = ids[at]
            ids_[ends] = v.end
            base = np.add.reduceat(logs, starts) - n * all_base
            share = np.add.reduceat(logs * rare, starts) - np.add.reduceat(rare, starts, dtype=np.int64) * all_rest
            # A row's words outside the head, each once with its number.
            loose = here < 0
            found = flat.filter(pa.array(loose)).dictionary_encode()
            distinct = max(1, len(found.dictionary))
            pairs, times = np.unique(np.repeat(np.arange(len(b)), bounds[1:] - bounds[:-1])[loose] * distinct + found.indices.to_numpy(), return_counts=True)
            upto = np.searchsorted(pairs, np.arange(len(b) + 1) * distinct)
            packed = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((np.append(starts, len(word)) * kind.itemsize).astype(np.int32)), pa.py_buffer(ids_.astype(kind))])
            rest = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([found.dictionary.take(pa.array(pairs % distinct)), pa.array(times, pa.int64())], ["word", "n"]))
            columns = [b["key"], b["held_out"], b["o"], n, np.add.reduceat(at >= 0, starts, dtype=np.int64), base, share, packed, np.diff(upto), rest]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in ENCODED.split(", ")])

    # Words are looked up once; training and scoring take the ids, 2 bytes a word.
    encoded = materialise(rows.withColumn("o", _order()).withColumn("key", F.col("key").cast("string")).mapInArrow(encode, ENCODED).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = spark.sparkContext.broadcast(train(encoded.filter("not held_out").select("o", "ids"), v))
    last, kind = v.end, _kind(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(frames: list[pd.DataFrame], seqs: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            got = lane_scores(model.value, seqs, last) / math.log(10)
            at = 0
            for frame in frames:
                frame["score"] += got[at : at + len(frame)]
                at += len(frame)
                yield frame

        frames, seqs, have = [], [], 0
        for b in batches:
            seqs += [np.frombuffer(x, kind).astype(np.int32) for x in b["ids"]]
            have += int(b["n_tokens"].sum())
            frames.append(b.drop(columns="ids"))
            if have >= SCORE_TOKENS:
                yield from emit(frames, seqs)
                frames, seqs, have = [], [], 0
        yield from emit(frames, seqs)

    scored = materialise(encoded.select(*[c.split()[0] for c in SCORED.split(", ")], "ids").mapInPandas(run, SCORED).withColumn("key", F.col("key").cast("long")), "scored")
    # Words outside the head meet their counts.
    loose = encoded.filter("n_rest > 0").select("row", F.inline("rest"))
    found = loose.join(counts, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("more_known"))
    both = scored.join(found, "row", "left").withColumn("more", F.coalesce("more", F.lit(0.0))).orderBy("row")  # as read: files are read by size, which depends on the words found
    return both.select(
        F.col("key").alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("more")).alias("base_score"), (F.col("score") + F.col("more")).alias("score"),
    )
