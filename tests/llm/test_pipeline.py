"""The pipeline's stages against plain versions on the smallest documents."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from xylem.llm import minhash, mixing, pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('pipeline')}/{name}"
        before = docs
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs)
    return out


def test_columns_and_order(stages):
    assert list(stages) == ["language", "near_duplicates", "personal_data", "mixing", "packing"]
    assert all(after.columns == ["doc_id", "text", "lang", "source", "n_chars"] for name, (_, after) in stages.items() if name != "packing")


def test_language(stages):
    before, after = (d.toPandas().set_index("doc_id") for d in stages["language"])
    lettered = before[[any(c.isalpha() for c in t) for t in before["text"]]]
    assert set(after.index) == set(lettered.index) and (after["text"] == lettered["text"].loc[after.index]).all() and (after["lang"] == lettered["lang"].loc[after.index]).mean() > 0.95


def test_near_duplicates(stages):
    before, after = (d.toPandas() for d in stages["near_duplicates"])
    rows = [(k, set(minhash.shingles(t).tolist())) for k, t in zip(before["doc_id"], before["text"], strict=True)]
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert sorted(after["doc_id"]) == sorted(k for k, _ in rows if find(k) == k)


def test_personal_data(stages, spark):
    before, after = stages["personal_data"]
    left = pii.digest(pii.extract(after)).agg(*[F.sum(f"n_{k}") for k in ("email", "ip", "phone")]).first()
    assert sum(left) == 0 and before.count() == after.count()
    b, a = (d.toPandas().set_index("doc_id") for d in (before, after))
    hit = pii.digest(pii.extract(before)).filter("spans <> ''").toPandas()["doc_id"]
    clean = b.index.difference(pd.Index(hit))
    assert (a["text"].loc[clean] == b["text"].loc[clean]).all() and (a["text"].loc[hit] != b["text"].loc[hit]).all() and (a["n_chars"] == a["text"].str.len()).all()


def test_mixing_and_packing(stages, spark):
    before, after = stages["mixing"]
    want = mixing.poisson_mix(before).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert after.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict() == want
    before, after = stages["packing"]
    p = after.toPandas()
    assert p[p["piece"] == 0].groupby("doc_id").size().to_dict() == want and p.groupby("sequence_id")["length"].sum().max() <= 2048
    whole = corpus_pipeline.run(spark, SF).toPandas()
    key = lambda d: sorted(map(tuple, d[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist()))
    assert key(whole) == key(p)
