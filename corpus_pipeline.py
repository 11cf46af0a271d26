"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's documents. All but the last
keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm import language, minhash, mixing, packing, pii
from xylem.llm.queries import tokenizer_path
from xylem.session import materialise, prepare, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: ``lang`` becomes the one found; documents without a language (no letters) go."""
    prepare(spark)
    return language.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-duplicates of 0.8 or more: the smallest doc_id of each group stays."""
    prepare(spark)
    return minhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: each span is replaced by its kind; ``n_chars`` follows."""
    prepare(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson replication to tempered source weights, shuffled globally."""
    prepare(spark)
    return mixing.poisson_mix(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 ids."""
    prepare(spark)
    return packing.best_fit(docs, tokenizer_path())


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("personal_data", redact), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language inference has no form in SQL; tests hold the stages against plain Python versions.
ORACLE_SQL = None
