"""The registered queries of this subpackage: one for each operator, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import ann, html, language, lm, media, minhash, mixing, packing, pii, repeats


def op1_additive_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP1_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b, 0.0::DOUBLE) score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op2_mixture_lid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.train_and_identify(docs)
    return found.select("doc_id", (language.crc_rest(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "lang_set")


def op3_bootstrap_pii(spark, sf_dir):
    return pii.digest(pii.extract(table(spark, sf_dir, "documents")))


def op4_gru_lm(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op5_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) END sh FROM w),
e AS (SELECT doc_id, len(sh) n, unnest(sh) x FROM s),
p AS (SELECT a.doc_id a, b.doc_id b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id v, doc_id c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a WHERE r.c < l.b),
c AS (SELECT v, min(c) c FROM r GROUP BY v)
SELECT s.doc_id, len(sh) n_shingles, c.c component_id, s.doc_id = c.c kept FROM s JOIN c ON s.doc_id = c.v
"""


def op7_difference_cover(spark, sf_dir):
    return repeats.repeated_strings(table(spark, sf_dir, "documents"), passage=repeats.PASSAGE)


def op8_best_fit(spark, sf_dir):
    return packing.best_fit(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path() -> str:
    """Where the public byte-level BPE file stands on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_wrapper_text(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_telephony(spark, sf_dir):
    return media.texts_as_telephony(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_additive_ann": op1_additive_ann,
    "op2_mixture_lid": op2_mixture_lid,
    "op3_bootstrap_pii": op3_bootstrap_pii,
    "op4_gru_lm": op4_gru_lm,
    "op5_minhash": op5_minhash,
    "op6_poisson_mix": mixing.op6_query,
    "op7_difference_cover": op7_difference_cover,
    "op8_best_fit": op8_best_fit,
    "op9_wrapper_text": op9_wrapper_text,
    "op10_telephony": op10_telephony,
}
ORACLES = {"op1_additive_ann": OP1_SQL, "op5_minhash": OP5_SQL, "op6_poisson_mix": mixing.OP6_SQL}
