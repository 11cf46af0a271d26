"""Results against brute force, exact round trips and held-out accuracy, on the smallest tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from xylem.llm import ann, html, language, lm, media, minhash, mixing, packing, pii, repeats
from xylem.llm.queries import ORACLES, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def frame(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in ddl.split(", ")]), ddl)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    key = lambda d: sorted(map(str, d[sorted(want.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


# -- 1 -------------------------------------------------------------------------------------------------------------------


def test_codes():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.fit(x, books=3, words=4, sweeps=4)
    near = lambda codes: ((x - sum(books[j][codes[:, j]] for j in range(3))) ** 2).sum(axis=1)
    wide, narrow = near(ann.encode(x, books, beam=64)), near(ann.encode(x, books, beam=1))
    every = np.array(np.meshgrid(*[range(4)] * 3)).T.reshape(-1, 3)
    best = np.min([((x - sum(books[j][c[j]] for j in range(3))) ** 2).sum(axis=1) for c in every], axis=0)
    assert np.allclose(wide, best, atol=1e-5) and wide.mean() <= narrow.mean()


def test_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(e, F.col("vec_id") % 20 == 0).toPandas()
    p = e.toPandas()
    x, ids = np.stack(p["embedding"]).astype(float), p["vec_id"].to_numpy()
    found = {k: set(g["vec_id"]) for k, g in got.groupby("query_id")}
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hits.append(len(found[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert np.mean(hits) >= 0.9 and len(got) == 20 * len(hits)


# -- 2 -------------------------------------------------------------------------------------------------------------------


def test_language_accuracy(spark):
    r = QUERIES["op2_mixture_lid"](spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet"), on="doc_id")
    held = r[r["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and r["score"].between(0, 1).all()
    assert (r["held_out"] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in r["doc_id"]]).all()


def test_language_mixture(spark, docs):
    names, logp = model = language.learn(spark.createDataFrame(docs[["text", "lang"]]))
    one = {k: " ".join(docs[docs["lang"] == k]["text"])[:4000] for k in ("en", "fr")}
    shares, _ = language.infer([one["en"] + " " + one["fr"], one["en"], "12 !"], logp)
    assert 0.3 < shares[0][names.index("en")] < 0.7 and shares[0][names.index("fr")] > 0.3 and shares[1][names.index("en")] > 0.95 and not shares[2].any()
    long = " ".join(["the cat"] * 10)
    pieces = list(language.split_text(long * 40, 100))
    assert "".join(pieces) == long * 40 and max(map(len, pieces)) <= 100 and model


def test_language_sets_of_many(spark):
    """A mixture of five languages keeps all five; a sixth one stays out."""
    rnd = random.Random(4)
    names = ["aa", "bb", "cc", "dd", "ee", "ff"]
    words = lambda i, n: " ".join("".join(rnd.choice("abcdefghijklmnopqr"[3 * i : 3 * i + 3]) for _ in range(rnd.randint(3, 7))) for _ in range(n))
    known, logp = language.learn(spark.createDataFrame([(words(i, 300), k) for i, k in enumerate(names) for _ in range(3)], "text string, lang string"))
    shares, _ = language.infer([" ".join(words(i, 80) for i in range(5)), words(5, 50)], logp)
    assert known == names and all(0.15 < x < 0.25 for x in shares[0][:5]) and shares[0][5] == 0 and shares[1][5] == 1


def test_maximise_is_plain_em():
    rng = np.random.default_rng(6)
    p, sizes = rng.random((40, 4)), [25, 15]
    got, log = language.maximise(p, np.array([0, 25]), np.repeat([0, 1], sizes), np.full((2, 4), 0.25))
    for d, rows in enumerate(np.split(p, [25])):
        share = [0.25] * 4
        for _ in range(language.ROUNDS):
            sums = [0.0] * 4
            for row in rows:
                total = sum(s * x for s, x in zip(share, row, strict=True))
                sums = [a + s * x / total for a, s, x in zip(sums, share, row, strict=True)]
            share = [a / len(rows) for a in sums]
        assert np.allclose(got[d], share) and math.isclose(log[d], sum(math.log(sum(s * x for s, x in zip(share, row, strict=True))) for row in rows), rel_tol=1e-9)


# -- 3 -------------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            odd = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in odd) % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713. +12 +1+23456789", "😀 a.b@c-d.e.f 😀 10.0.0.1😀", "@@ a@b a@.b +(12", "1" * 50 + " " + "a" * 300 + "@" + "b." * 100 + "c", "", None, "+1.2.3.4.55 6.7.8.9"]


def test_base_spans(spark, docs):
    texts = [*TRICKY, *docs["text"], *pd.read_parquet("/root/testdata/sf0.01/documents.parquet")["text"]]
    got = {r["doc_id"]: r for r in pii.digest(pii.extract(frame(spark, list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), (t, shown, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE] and got[i]["spans"].startswith(shown)


def test_discovery(spark):
    rows = [(i, f"words here account 10.0.{i}.7 closed now") for i in range(12)] + [(100, "other words account 300.1.1.{0} closed today".format(4444)), (101, "nothing 2024-01-01 here"), (102, "room 300.1.1.4444 is clean")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.extract(frame(spark, rows))).collect()}
    assert got[100] == "context:20:32" and got[101] == "" and got[0].startswith("ip:")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    assert clean[100] == "other words account <CONTEXT> closed today" and clean[3] == "words here account <IP> closed now" and clean[101] == rows[13][1]


def test_discovery_goes_on(spark):
    a, b, c = ([f"300.1.{k}.{4000 + i}" for i in range(n)] for k, n in ((1, 40), (2, 8), (3, 1)))
    rows = [f"first account 10.0.{i}.7 closed now" for i in range(240)] + [f"first account {v} closed now" for v in a]
    rows += [f"one order {v} sent off" for v in (*a, *b)] + [f"a badge {v} shown here" for v in (*b, *c)] + ["none 300.1.9.4000 other"]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.extract(frame(spark, list(enumerate(rows))))).collect()}
    assert all(got[i].startswith("context:") for i, t in enumerate(rows) if t.startswith(("one", "a badge"))) and got[len(rows) - 1] == ""


def test_keys_are_found_by_their_context(spark):
    """Strings of the shape of a key count where a confident pattern has them; the pattern then finds others, of any context length."""
    long = "q" * 200
    rows = [(i, f"some words {long}token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and more") for i in range(6)]
    rows += [(50, f'and {long}TOKEN = "k{"9a8b7c" * 3}" then'), (51, "see commit " + "0a" * 20), (52, f"{long}token = maybe 2024 or so"), (53, "the word deadbeef1234 alone")]
    got = {r["doc_id"]: r for r in pii.digest(pii.extract(frame(spark, rows))).collect()}
    assert all(got[i]["n_context"] == 1 for i in (*range(6), 50)) and all(got[i]["n_spans"] == 0 for i in (51, 52, 53))
    assert all(got[i]["base_sha256"] == hashlib.sha256(b"").hexdigest() for i in got)


# -- 6 -------------------------------------------------------------------------------------------------------------------


def test_poisson_tables(spark):
    """Rates from 0.01 to 100,000 against sums of exact terms, and counts of the right mean and spread."""
    rates = [0.0, 0.01, 0.7, 1.0, 30.0, 399.9, 400.0, 745.2, 2000.0, 1e5]
    rows = spark.createDataFrame([(r,) for r in rates], "rate double").select("rate", *mixing.poisson_table(F.col("rate"))).collect()
    for rate, first, cdf in rows:
        total = 0.0
        for k in range(first + len(cdf)):
            total += math.exp(-rate + (k * math.log(rate) if rate else 0) - math.lgamma(k + 1)) if rate or not k else 0
            if k >= first and (k - first) % 97 == 0:
                assert abs(cdf[k - first] - total) < 1e-9, (rate, k)
        assert abs(cdf[-1] - 1) < 1e-9
    docs = spark.createDataFrame([(i, "x" * (1 if i < 150 else 10_000_000 // 50), "s" if i < 150 else "t", "e") for i in range(200)], "doc_id long, text string, source string, lang string")
    for want in (800, 2000):
        weights = spark.createDataFrame([("s", want * 150.0), ("t", 10_000_150.0 - want * 150.0)], "source string, weight double")
        n = mixing.poisson_mix(docs, weights=weights).filter("source = 's'").groupBy("doc_id").count().toPandas()["count"]
        assert len(n) == 150 and abs(n.mean() - want) < 5 * math.sqrt(want / 150) and 0.7 < n.std() / math.sqrt(want) < 1.3


# -- 4 -------------------------------------------------------------------------------------------------------------------


def test_counts_and_base(spark, docs):
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs["doc_id"]}
    c = Counter()
    for k, t in zip(docs["doc_id"], docs["text"], strict=True):
        if not held[k]:
            c.update([*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), b""])
    n, v = sum(c.values()), len(c)
    got = lm.score(spark.createDataFrame(docs)).toPandas().set_index("doc_id")
    for k, t in zip(docs["doc_id"], docs["text"], strict=True):
        own = [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), b""]
        r = got.loc[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    assert np.isfinite(got["score"]).all()


def test_head_and_rest_agree(spark, docs, monkeypatch):
    want = lm.score(spark.createDataFrame(docs)).toPandas().set_index("doc_id")
    v = lm.vocabulary
    monkeypatch.setattr(lm, "vocabulary", lambda counts: v(counts, head=500, size=lm.CLASSES * lm.CLASS_SIZE))
    got = lm.score(spark.createDataFrame(docs)).toPandas().set_index("doc_id")
    assert (got["n_known"] == want["n_known"]).all() and np.allclose(got["base_score"].loc[want.index], want["base_score"])


def test_model_learns_and_sums_to_one(spark):
    sf = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score(spark.createDataFrame(sf)).toPandas()
    held = r[r["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
    m = lm.Model.start(np.arange(16, 0, -1.0), hidden=4, classes=4)
    m.wc += 0.3
    m.wo += np.random.default_rng(0).standard_normal(m.wo.shape).astype(np.float32)
    h = np.random.default_rng(1).standard_normal((1, 4)).astype(np.float32)
    assert math.isclose(np.exp([m.log_probs(h, np.array([i]))[0] for i in range(16)]).sum(), 1, rel_tol=1e-5)


def test_training_sees_every_document(spark, monkeypatch):
    docs = frame(spark, [(i, " ".join(f"w{(i * j) % 50}" for j in range(40))) for i in range(640)]).repartition(2).withColumnRenamed("doc_id", "key")
    counts = lm.count_words(docs)
    v, seen = lm.vocabulary(counts), []
    table = lm.materialise
    monkeypatch.setattr(lm, "materialise", lambda df, name: seen.append((name, out := table(df, name))) or out)
    lm.train(docs, v)
    n = sum(r["n"] for name, df in seen if name == "trained" for r in df.select("n").collect())
    assert v.tokens == 640 * 41 and n == v.tokens


def test_training_does_not_depend_on_the_partitioning(spark):
    docs = frame(spark, [(i, " ".join(f"w{(i * j) % 50}" for j in range(40))) for i in range(300)]).withColumnRenamed("doc_id", "key")
    v = lm.vocabulary(lm.count_words(docs))
    one, two = (lm.train(d, v, 2000, 1000) for d in (docs.repartition(7), docs.orderBy(F.desc("key")).coalesce(1)))
    assert all(np.array_equal(getattr(one, k), getattr(two, k)) for k in lm.Model.NAMES)
    assert not np.array_equal(one.wo, lm.Model.start(v.freq).wo)


def test_mean_of_copies_in_any_order():
    m = lm.Model.start(np.arange(16, 0, -1.0), hidden=4, classes=4)
    t = lm.Trainer(m, 7)
    t.seen = 3
    copies = pd.concat([lm._packed(k, t) for k in (2, 1, 0)], ignore_index=True)
    mean = lm._mean(copies)
    assert mean["shard"].tolist() == [0] and mean["n"].tolist() == [9] and mean.index.tolist() == [0]
    assert np.allclose(lm.pickle.loads(mean["blob"][0])["u"], m.u)


def test_scores_do_not_depend_on_how_many_words_are_gathered(spark, monkeypatch):
    docs = frame(spark, [(i, " ".join(f"w{(i * j) % 50}" for j in range(1 + i % 90))) for i in range(300)]).coalesce(1)
    whole = lm.score(docs).orderBy("doc_id").toPandas()
    monkeypatch.setattr(lm, "SCORE_TOKENS", 500)
    parts = lm.score(docs).orderBy("doc_id").toPandas()
    assert whole["doc_id"].tolist() == parts["doc_id"].tolist() == list(range(300))
    assert np.allclose(whole["score"], parts["score"], rtol=1e-4)


@pytest.mark.parametrize("sizes", [[5], [40] * 7, [3, 9_000, 50, 1], [60] * 100])
def test_training_empties_its_lanes(sizes):
    m = lm.Model.start(np.arange(16, 0, -1.0), hidden=4, classes=4)
    texts = [np.append(np.full(n, i % 7), 7) for i, n in enumerate(sizes)]
    t, taught = lm.Trainer(m, 7), Counter()
    window = t.window
    t.window = lambda x, y, h, *full: (taught.update(y.ravel().tolist()), window(x, y, h, *full))[1]
    t.learn(iter(texts))
    assert t.seen == sum(map(len, texts)) and taught == Counter(np.concatenate(texts).tolist())


def test_words_are_looked_up_once(spark, docs, monkeypatch):
    """Training gets the ids that scoring has encoded, not texts to split again, and learns the same from them."""
    rows, seen = spark.createDataFrame(docs[["doc_id", "text"]]), []
    monkeypatch.setattr(lm, "train", lambda d, v, real=lm.train: seen.append((d.columns, v, real(d, v))) or seen[0][2])
    lm.score(rows)
    columns, v, model = seen[0]
    assert "text" not in columns
    own = rows.withColumnRenamed("doc_id", "key").filter("crc32(cast(key as string)) % 7 <> 2")
    monkeypatch.undo()
    again = lm.train(own, v)
    assert all(np.array_equal(getattr(model, k), getattr(again, k)) for k in lm.Model.NAMES)


def test_words_are_cut_many_texts_at_once():
    texts = [" A\x0bB  c\x1cd\x85É ", "", None, "  ", "x\ty\nz", "İ K", "\x00a \x1f\x20b\r\n", " ", "\u2003 a"]
    for own in (pa.array(texts), pa.array(["gone", *texts, "gone"]).slice(1, len(texts)), pa.array([], pa.string()), pa.array([None, ""])):
        flat, bounds = lm.cut(own)
        flat = flat.to_pylist()
        assert [flat[b:e] for b, e in zip(bounds[:-1], bounds[1:], strict=True)] == [lm.words(t) for t in own.to_pylist()]


def test_words_outside_the_head_stand_once_with_their_number(spark, monkeypatch):
    """A row's repeated words outside the head meet their counts as one row, without a shuffle that adds them up first."""
    v, table, seen = lm.vocabulary, lm.materialise, {}
    monkeypatch.setattr(lm, "vocabulary", lambda counts: v(counts, head=1))
    monkeypatch.setattr(lm, "materialise", lambda df, name: seen.setdefault(name, table(df, name)))
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    taught = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 != 2)
    got = lm.score(frame(spark, [(taught, "the the the a a b"), (held, "a zz the A zz zz"), (held + 1000, None)])).toPandas().set_index("doc_id").loc[held]
    rest = next(r["rest"] for r in seen["encoded"].collect() if r["key"] == str(held))
    assert sorted((bytes(r["word"]), r["n"]) for r in rest) == [(b"a", 2), (b"zz", 3)]
    assert got["n_known"] == 4  # a twice, the, the end


def test_lanes_are_of_nearly_the_same_length():
    """A long text at the end of the stream gets no windows of its own, beside empty lanes: these cost half as much as full ones."""
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(0, 7, n), 7) for n in [*rng.integers(1, 60, 600).tolist(), 500]]
    t, sizes = lm.Trainer(lm.Model.start(np.arange(16, 0, -1.0), hidden=4, classes=4), 7), []
    window = t.window
    t.window = lambda x, y, h, *full: (sizes.append(y.size), window(x, y, h, *full))[1]
    t.learn(iter(texts), lanes=16, window=8)
    assert sum(sizes) == sum(map(len, texts)) and len(sizes) <= sum(sizes) / (16 * 8) + 16


def test_gradients_are_added_up_by_word():
    rng = np.random.default_rng(5)
    for ids in (rng.zipf(1.5, 900) % 50, np.arange(5), np.zeros(40, int)):
        x = rng.standard_normal((3, len(ids), 4))
        rows, got = lm._by_word(ids, x)
        assert sorted(rows.tolist()) == sorted(set(ids.tolist()))
        assert all(np.allclose(got[:, k], x[:, ids == w].sum(axis=1)) for k, w in enumerate(rows))


def test_sums_of_exponentials_of_any_range():
    for s in ([[-200.0, -201.0], [0.0, 1.0]], [[200.0, 90.0], [0.0, 1.0]], [[-200.0, 200.0], [5.0, 5.0]]):
        s = np.array(s, np.float32)
        top = s.max(axis=1, keepdims=True).astype(float)
        want = np.log(np.exp(s - top).sum(axis=1)) + top[:, 0]
        assert np.allclose(lm._log_sum(s.copy()), want, rtol=1e-5) and np.allclose(lm._shares(s.copy(), 1), np.exp(s - want[:, None]), atol=1e-6)


def test_windows_keep_their_memory():
    """A window's arrays come from memory that the process has: faulting them in again took a quarter of the time."""
    import resource

    ids = np.random.default_rng(1).integers(0, 4096, (60, lm.LANES * lm.WINDOW))
    t = lm.Trainer(lm.Model.start(np.arange(4096, 0, -1.0)), 7)
    t.learn(iter(ids[:10].reshape(lm.LANES, -1)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    t.learn(iter(ids.reshape(lm.LANES, -1)))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 60 * 200


def test_gradients():
    m = lm.Model.start(np.arange(16, 0, -1.0), hidden=4, classes=4)
    rng = np.random.default_rng(2)
    for k in lm.Model.NAMES:
        setattr(m, k, (getattr(m, k) + rng.standard_normal(getattr(m, k).shape) * 0.2).astype(np.float64))
    x, y = rng.integers(0, 16, (5, 3)), rng.integers(0, 16, (5, 3))

    def loss():
        hs, _ = m.run(x, np.zeros((3, 4)), end=7)
        return -m.log_probs(hs.reshape(-1, 4).astype(np.float64), y.ravel()).sum() * 16 / y.size

    grads = {}
    t = lm.Trainer(m, 7)
    t._step = lambda name, g, rows=slice(None): grads.setdefault(name, np.zeros_like(getattr(m, name))).__setitem__(rows, g)
    t.window(x, y, np.zeros((3, 4)))
    for name in ("u", "wc", "wo", "x", "bo"):
        w = getattr(m, name)
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        old, eps = w[at], 1e-3
        w[at] = old + eps
        up = loss()
        w[at] = old - eps
        down = loss()
        w[at] = old
        assert math.isclose((up - down) / (2 * eps), grads[name][at], rel_tol=0.02), name


def test_state_is_carried():
    m = lm.Model.start(np.arange(16, 0, -1.0), hidden=4, classes=4)
    m.wc, m.wo = (np.random.default_rng(3).standard_normal(a.shape).astype(np.float32) for a in (m.wc, m.wo))
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(0, 7, n), 7) for n in (300, 5, 0, 80, 200, 1)]
    got = lm.lane_scores(m, texts, 7, lanes=2, window=16)
    for t, g in zip(texts, got, strict=True):
        hs, _ = m.run(np.append(7, t[:-1])[:, None], np.zeros((1, 4), np.float32), 7)
        assert math.isclose(m.log_probs(hs[:, 0], t).sum(), g, rel_tol=1e-4)


# -- 5 -------------------------------------------------------------------------------------------------------------------


def test_components_of_a_large_near_group(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    base = [rnd.choice(words) for _ in range(150)]
    rows = []
    for i in range(400):
        own = list(base)
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(150)] = rnd.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(rnd.choice(words) for _ in range(80))) for i in range(100)] + [(2000, rows[5][1].upper()), (2001, "one two"), (2002, "ONE  two"), (2003, None)]
    sets = {k: set(zip(*[(t or "").lower().split()[i:] for i in range(5)])) or ({tuple((t or "").lower().split())} if t else set()) for k, t in rows}
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, _) in enumerate(rows):
        for b, _ in rows[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, rows), percent=85).collect()}
    assert got == {k: (len(sets[k]), find(k), find(k) == k) for k, _ in rows}


def test_estimates():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for j in (0.2, 0.5, 0.85):
        n = int(2000 * (1 - j) / (1 + j))
        a, b = (np.frombuffer(minhash.pack(minhash.minima(x)), np.uint8) for x in (h[:2000], h[n : 2000 + n]))
        assert abs(minhash.similarity(minhash.agreements(a, b)) - j) < 0.15


# -- 7 -------------------------------------------------------------------------------------------------------------------


def brute(rows, length):
    data = {k: (t or "").encode() for k, t in rows}
    seen = Counter(d[i : i + length] for d in data.values() for i in range(len(d) - length + 1))
    out = {}
    for k, d in data.items():
        mark = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark[:-1]) > 0
        edges = np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[k] = (len(d), int(gone.sum()), edges // 2, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("length", [20, 60, 400])
def test_repeats(spark, docs, length):
    rnd = random.Random(length)
    base = "".join(rnd.choice("abcdefgh é") for _ in range(3000))
    rows = []
    for i in range(60):
        s = list(base[rnd.randint(0, 1500) : rnd.randint(1500, 3000)])
        for _ in range(rnd.randint(0, 6)):
            s[rnd.randrange(len(s))] = "Z"
        rows.append((i, "".join(s)))
    rows += [(100, None), (101, ""), (102, "a" * 1000), (103, "a" * 450), (104, "ab" * 300), (105, "x" * (length - 1)), *((200 + k, t) for k, t in zip(docs["doc_id"], docs["text"], strict=True) if length == 400)]
    got = repeats.repeated_strings(frame(spark, rows), length=length, keep=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute(rows, length)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_repeated_passages(spark):
    """Passages of 51 words against brute force: short words hold no 400 bytes, and 50 words are too few."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3)))
    shared = [[word() + str(i) for i in range(n)] for n in (50, 51, 60, 400)]
    rows = [(0, None), (1, ""), (2, "x"), (3, "y " * 51), (4, "y " * 52)]
    for i, p in enumerate([*shared, *shared, shared[2], shared[3][:45], shared[3][:300]]):
        own = [f"w{i}_{j}" for j in range(rnd.randint(0, 90))]
        rows.append((10 + i, " ".join([*own, *p, *[f"v{i}_{j}" for j in range(rnd.randint(0, 90))]])))
    seen = Counter(tuple(w[i : i + 51]) for _, t in rows for w in [(t or "").split()] for i in range(len(w) - 50))
    want = {}
    for k, t in rows:
        w = (t or "").split()
        hit = {j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}
        want[k] = len(hit)
    got = repeats.repeated_strings(frame(spark, rows), passage=repeats.PASSAGE)
    assert {r["doc_id"]: r["n_passage_words"] for r in got.collect()} == want and want[10] == 0 and want[11] == 51 and want[3] == 51
    assert got.filter("doc_id in (11, 15)").agg({"n_removed": "sum"}).first()[0] == 0


class Captured:
    """A table that hands the batches of a Python step to the test."""

    def __init__(self, **columns):
        self.batch = pa.RecordBatch.from_pydict(columns)

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        self.out = list(run([self.batch]))
        return self

    def withColumnsRenamed(self, names):
        return self


@pytest.mark.parametrize("words", [False, True])
def test_samples_of_many_texts_at_once(words, monkeypatch):
    """Texts are sampled together, not one by one: what is hashed anew for each text was most of the step's time. Alone they give the same."""
    rnd = random.Random(4)
    texts = ["", " ", *(" ".join(rnd.choice(["é", "und", "x\ty", "wort", "\n"]) for _ in range(rnd.randint(0, 300))) for _ in range(100)), ""]
    made = []
    monkeypatch.setattr(repeats, "Prefixes", lambda *a, real=repeats.Prefixes: made.append(1) or real(*a))

    def rows(keys, own):
        return [(r["k"], r["x"], r["n0"], r["n1"]) for b in repeats.samples(Captured(k=pa.array(keys, pa.int64()), t=own), 51 if words else 100, words).out for r in b.to_pylist() if r["others"] is None]

    together = rows(list(range(len(texts))), texts)
    assert len(made) < 10 and len(together) > 100
    alone = {x for k, t in enumerate(texts) for x in rows([k], [t])}
    assert {*together} <= alone


def test_words_of_texts_laid_together():
    texts = ["", "a b", "b", " a\x0b", "", "a\u00a0b", "b\n", "a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    hashes, first = repeats.word_units(data, np.append(0, np.cumsum([len(t.encode()) for t in texts])))
    parts = [t.encode().split() for t in texts]
    assert np.diff(first).tolist() == [len(p) for p in parts]
    flat = [w for p in parts for w in p]
    assert all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_difference_covers():
    for q in (2, 3, 5, 7, 11):
        v, d = repeats.difference_cover(q)
        assert len(d) == q + 1 and {(a - b) % v for a in d for b in d} == set(range(v))


# -- 8 -------------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    whole = {k: [*t.encode(x, add_special_tokens=False).ids, 0] for k, x in zip(docs["doc_id"], docs["text"], strict=True)}
    got = packing.best_fit(spark.createDataFrame(docs), tokenizer_path(), keep_ids=True).toPandas()
    for k, g in got.groupby("doc_id"):
        g = g.sort_values("piece")
        assert [i for ids in g["ids"] for i in ids] == whole[k] and list(g["start"]) == list(np.cumsum([0, *g["length"][:-1]])) and (g["length"].iloc[1:] == 2048).all()
        assert all(zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == c for ids, c in zip(g["ids"], g["ids_crc32"], strict=True))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == list(np.cumsum([0, *g["length"][:-1]])) and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 1.03 * got["length"].sum() / 2048 + 1


def test_large_lengths_get_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    rows = [(i, None) for i in range(200)] + [(1000 + i, "word " * (i % 5 + 1)) for i in range(100)]
    got = packing.best_fit(frame(spark, rows), tokenizer_path(), capacity=16, buckets=4).toPandas()
    assert len(got) == 300 and got.groupby("sequence_id")["length"].sum().max() <= 16
    assert all((own["offset"] == own["length"].cumsum() - own["length"]).all() for _, own in got.sort_values("offset").groupby("sequence_id"))


def test_plans():
    for seed in range(150):
        rnd = random.Random(seed)
        cap = rnd.choice([7, 20, 100, 2048])
        counts = {rnd.randint(1, cap): rnd.randint(1, rnd.choice([3, 50, 1000])) for _ in range(rnd.randint(1, 200))}
        fill, ranks = {}, {}
        for n, a, b, s, o in packing.plan(counts, cap):
            ranks.setdefault(n, []).extend(range(a, b + 1))
            for k in range(a, b + 1):
                fill.setdefault(s + k - a, []).append((o, n))
        assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
        for parts in fill.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= cap


# -- 9 -------------------------------------------------------------------------------------------------------------------

PAGES = {
    "<div id=content><div class=post><h2>T</h2><p>one &lt;b&gt;<p>two<ul><li>x<li>y</ul><div class='share'>Share</div></div><div id='comments-area'><p>no</p></div></div><div class='sidebar'>s</div>": "T one <b> two x y",
    "<main><header class='site-header'>no</header><section><p>a\n  b<br>c</p></section><form>f</form></main><footer>no</footer>": "a b c",
    "<header>no</header><article><header><h1>Title</h1></header><p>x<b>y</b>z &amp;amp; &#233;</p><aside>no</aside><!-- no --><script>var a='<p>no</p>'</script></article><div class=cookie-notice>no</div>": "Title xyz &amp; é",
    "<body><table><tr><td>cell one<td>cell two</table></body>": "cell one cell two", "plain text": "plain text",
}


def test_pages(spark):
    rows = [(i, f"http://h{i}.example/{j}", p) for i, p in enumerate(PAGES) for j in range(2)]
    got = html.main_text(frame(spark, rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == dict(enumerate(PAGES.values())) and len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)


def test_wrappers(spark):
    one = "<html><body><nav><ul><li>a<li>b</ul></nav><article><p>x<p>y</article></body></html>"
    two = "<html><body><nav><ul><li>a</ul></nav><article><p>x<p>y<p>z</article><div class='ad'>ad</div></body></html>"
    rows = spark.createDataFrame([("h", one), ("h", two), ("h", None)], "host string, html string")
    w = html.wrappers(rows).first()
    assert w["part"] == "html/body/article" and "(<li>#</>)" in w["wrapper"] and "(<div.ad>#</>)?" in w["wrapper"] and "(<p>#</>)+" in w["wrapper"]


STORY = "a long story of many words " * 4
WHOLE = [
    *[f"<body><div class='{name}'><article><p>{STORY}</p></article></div></body>" for name in ("layout has-sidebar", "no-sidebar", "with-menu", "page-header", "search-results", "related-content", "sidebar")],
    *[f"<body><div class='{name}'><div class=text><p>{STORY}</p></div></div><div class=sidebar>no</div></body>" for name in ("has-sidebar", "header", "search")],
    f"<form><div><p>{STORY}</p></div></form>", f"<nav>no</nav><form><article><p>{STORY}</p><div class='cookie-notice'>no</div></article></form>",
    *[f"<article><{tag}><p>{STORY}</p></article>" for tag in ("svg/", "svg", "object data=x", "iframe/", "title-bar", "canvas", "script-x")],
    f"<article><svg><text>no</text></svg><p>{STORY}</p><script>no</article>",
]


@pytest.mark.parametrize("page", WHOLE)
def test_articles_are_no_boilerplate(page):
    read = html.Page(page)
    assert html.article(read, None, html.main_part(html.masses(read))) == STORY.strip()


def test_text_comes_from_the_slots(spark):
    page = "<body><article><p>Our house style, always here.</p><p>{0}</p><div class=x>Thanks for reading</div></article><div class=y>{1}</div></body>"
    rows = [(i, "http://h/", page.format(f"story {i} " * 20, "The same long line on each page. " * 40)) for i in range(4)]
    rows += [(10 + i, f"http://copies{i % 2}/", page.format("one story " * 20, i)) for i in range(8)]
    got = {r["page_id"]: (r["text"], r["wrapper"]) for r in html.main_text(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert all(got[i][0] == " ".join([f"story {i}"] * 20) for i in range(4)) and "<div.x>=</>" in got[0][1] and "(<p>#</>)+" in got[0][1]
    assert all(got[10 + i][0].startswith("Our house style, always here. one story") for i in range(8))  # copies of one page show no template


def test_pages_of_the_tables(spark):
    import html as unescape

    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = QUERIES["op9_wrapper_text"](spark, SF).toPandas().set_index("page_id")["text"]
    for k, source in zip(pages["page_id"], pages["html"], strict=True):
        inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
        assert got[k] == " ".join(unescape.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


# -- 10 ------------------------------------------------------------------------------------------------------------------


def test_audio_round_trip(spark, docs):
    got = media.texts_as_telephony(spark.createDataFrame(docs), keep_media=True).collect()
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    for r in got:
        raw = text[r["doc_id"]].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        tag, rate, _, data = media.read_wav(r["media"])
        assert (tag, rate, data) == (media.MULAW, 8000, payload) and r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) == 576 * max(1, -(-len(raw) // 576))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        tag, rate, _, pcm = media.read_wav(r["pcm"])
        assert (tag, rate) == (1, 16000) and np.array_equal(np.frombuffer(pcm, "<i2")[::2], media.MULAW_PCM[np.frombuffer(payload, np.uint8)])


def test_audio_tables():
    # The ends of the two companding laws.
    assert (media.MULAW_PCM[[0, 0x7F, 0x80, 0xFF]] == [-32124, 0, 32124, 0]).all()
    assert (media.ALAW_PCM[[0x2A, 0xAA, 0x55, 0xD5]] == [-32256, 32256, -8, 8]).all()

    def slow(block):
        value, index = struct.unpack_from("<hB", block)
        out = [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.IMA_STEPS[index])
                diff = (step * (2 * (code & 7) + 1)) >> 3
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(media.IMA_MOVES[code & 7])))
                out.append(value)
        return out

    rng = random.Random(1)
    blocks = [struct.pack("<hBB", rng.randint(-3000, 3000), rng.randint(0, 88), 0) + rng.randbytes(60) for _ in range(20)]
    assert media.ima_decode(np.frombuffer(b"".join(blocks), np.uint8).reshape(20, 64)).tolist() == [slow(b) for b in blocks]
    assert len(media.decode_wav(media.wav(media.IMA, b"".join(blocks), align=64, bits=4, samples=20 * 121))[0]) == 20 * 121
