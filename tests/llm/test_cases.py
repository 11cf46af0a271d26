"""Odd inputs for every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest

from xylem.llm import ann, html, language, lm, media, minhash, mixing, packing, pii, repeats
from xylem.llm.queries import tokenizer_path
from pyspark.sql import functions as F

LONG = "word " * 30_000 + "x" * 50_000
ROWS = [
    (1, "The cat sat on the mat with the hat and +1 (017) 555-7713 then", "en", "a"), (1, "The cat sat on the mat with the hat and +1 (017) 555-7713 then", "en", "a"), (2, "The cat sat on the mat with the hat and +1 (017) 555-7713 then", None, "a"),
    (3, None, "en", None), (4, "", "fr", "a"), (5, "   \n\t ", "fr", "b"), (None, "le chat est sur la table avec le chapeau", "fr", "b"), (None, None, None, None), (6, LONG, "en", "a"), (7, "123 456 !!!", "de", "b"),
    (8, "le chat est sur la table avec le chien et la souris", "fr", "b"), (9, "émile à paris 😀 naïve", "fr", "c"), (10, "<|endoftext|> der hund und die katze", "de", "c"),
]
CLASH = ("id", "k", "h", "key", "rate", "copy", "score", "lang_pred", "component_id", "_spans", "_k", "sequence_id", "piece", "row", "word", "pre", "host", "rank", "v", "bands")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    for i, name in enumerate(CLASH):
        df = df.withColumn(name, F.when(F.rand(i) > 0.3, F.lit(f"c{i}")))
    return df.cache()


def both(odd, run, rows=len(ROWS)):
    assert run(odd.limit(0)).collect() == []
    got = run(odd).collect()
    assert rows is None or len(got) == rows
    return got


def test_language(odd):
    got = both(odd, language.train_and_identify)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 5, 7))
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "de", "und"} and all(0 <= r["score"] <= 1 for r in got)
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == 8


def test_pii(odd):
    got = both(odd, lambda d: pii.digest(pii.extract(d)))
    assert [r["n_phone"] for r in got if r["doc_id"] in (1, 2)] == [1, 1, 1]
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and clean.count() == len(ROWS) and clean.filter("text like '%<PHONE>%'").count() == 3 and clean.filter("text is null").count() == 2


def test_lm(odd):
    got = both(odd, lm.score)
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (3, 4, 5)) and all(r["base_score"] < 0 and r["score"] < 0 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1


def test_minhash(odd):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in both(odd, minhash.near_duplicates)}
    assert {(2, 10, 1, False), (1, 10, 1, True), (3, 0, 3, True), (5, 0, 5, True)} <= got
    assert minhash.keep_one(odd).columns == odd.columns and minhash.keep_one(odd).filter("doc_id = 2").count() == 0


def test_mixing(odd, spark):
    got = both(odd, mixing.poisson_mix, None)
    assert len({r["n_copies"] for r in got if r["doc_id"] == 1}) <= 1
    weights = spark.createDataFrame([("a", 0.0), ("b", 3.0), ("zz", 1.0), (None, None)], "source string, weight double")
    assert {r["source"] for r in mixing.poisson_mix(odd, weights=weights, budget=5.0).collect()} == {"b"}


def test_repeats(odd):
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in both(odd, lambda d: repeats.repeated_strings(d, length=40))}
    assert {(1, 62, 62), (2, 62, 62), (3, 0, 0), (4, 0, 0)} <= got
    assert [r["n_removed"] for r in repeats.repeated_strings(odd).collect() if r["doc_id"] == 6] == [200_000]


def test_packing(odd):
    got = both(odd, lambda d: packing.best_fit(d, tokenizer_path(), keep_ids=True), None)
    assert all(r["length"] == 1 for r in got if r["doc_id"] in (3, 4)) and [r["ids"][0] for r in got if r["doc_id"] == 10] == [50256]
    long = sorted((r["piece"], r["length"]) for r in got if r["doc_id"] == 6)
    assert all(n == 2048 for _, n in long[1:])


def test_media(odd, spark):
    got = both(odd, media.texts_as_telephony)
    assert all(r["payload_bytes"] == 576 for r in got if r["doc_id"] in (3, 4)) and len({tuple(r)[1:] for r in got if r["doc_id"] in (1, 2)}) == 1
    files = spark.createDataFrame([(1, None, "p"), (2, bytearray(b"junk"), "p"), (3, bytearray(media.wav(media.ALAW, bytes(range(256)))), None)], "i int, media binary, pcm string")
    assert [r["pcm"] is None for r in media.decode_telephony(files).orderBy("i").collect()] == [True, True, False]


def test_html(spark):
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>a &amp; b</p></article></body></html>"
    rows = [(1, "http://h/1", page), (1, "http://h/1", page), (2, None, None), (None, "x", ""), (3, "http://h/2", "<p>" * 5000 + "deep"), (4, "http://h/3", "no tags & " * 5000), (6, "http://h/5", "<center>" * 20_000 + "low" + "</nav>" * 20_000), (5, "http://h/4", "<a<a<a '\"<")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    got = html.main_text(df).collect()
    assert len(got) == len(rows) and html.main_text(df.limit(0)).collect() == []
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "T a & b" and by[2] == "" and by[None] == "" and by[3] == "deep" and by[4].startswith("no tags &") and by[6] == "low"


def test_ann(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [0.5, 0.5]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "vec_id long, embedding array<float>, rank string, score string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") % 20 == 0, k=3).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 8, 0.5)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
