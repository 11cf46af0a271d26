"""Mixing sources to target weights by Poisson replication.

Each document gets a uniform number from a hash of a seed and its key, and the
inverse of the Poisson distribution with its source's repetition rate turns
that into a count. Documents are exploded by the count and shuffled globally
by another hash. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise

#: Weight of a source: its share of characters to this power (below 1 evens sources out).
TEMPERATURE = 0.7
#: Characters drawn for each character there.
BUDGET = 1.0
SEED = 17
#: Sources up to this number are broadcast with their rates, so that no text is shuffled by source.
BROADCAST_ROWS = 50_000


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) with 48 bits, from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def poisson_table(rate: Column) -> tuple[Column, Column]:
    """(first, cdf): the distribution function at first, first + 1, ... as far as a 48-bit uniform number can reach on either side.

    Logarithms of the probabilities are summed up, so that rates of any size work; below 400 the table starts at 0. Beyond, it starts 12
    standard deviations (and 24) below the mean, with Stirling's series for the factorial there, and is divided by its sum.
    """
    first = F.when(rate < 400, F.lit(0)).otherwise(F.floor(rate - 12 * F.sqrt(rate) - 24)).cast("int")
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    n = F.greatest(first, F.lit(1)).cast("double")
    log_factorial = F.when(first == 0, 0.0).otherwise((n + 0.5) * F.log(n) - n + 0.5 * math.log(2 * math.pi) + 1 / (12 * n) - 1 / (360 * n * n * n))
    begin = -rate + F.when(first == 0, 0.0).otherwise(first * F.log(rate)) - log_factorial
    summed = F.aggregate(
        F.sequence(first, last),
        F.struct(begin.alias("p"), F.lit(0.0).alias("c"), F.expr("cast(array() as array<double>)").alias("o")),
        lambda a, k: F.struct((a["p"] + F.log(rate) - F.log(k + F.lit(1.0))).alias("p"), (a["c"] + F.exp(a["p"])).alias("c"), F.concat(a["o"], F.array(a["c"] + F.exp(a["p"]))).alias("o")),
        lambda a: F.when(first == 0, a["o"]).otherwise(F.transform(a["o"], lambda c: c / a["c"])),
    )
    return first, F.when(rate > 0, summed).otherwise(F.array(F.lit(1.0)))


def source_rates(df: DataFrame, source: str, size: Column, temperature: float = TEMPERATURE, budget: float = BUDGET, weights: DataFrame | None = None) -> DataFrame:
    """A row for each source: its size, weight and mean repetition rate.

    ``weights`` (source, weight) overrides the tempered shares; sources without a positive
    weight get the rate 0. Sources of size 0 get the rate 0.
    """
    sums = df.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("chars"))
    if weights is None:
        sums = sums.withColumn("w", F.pow(F.col("chars").cast("double"), F.lit(temperature)))
    else:
        w = weights.select(F.col("source").alias("__xylem_s"), F.col("weight").cast("double").alias("w"))
        sums = sums.join(w, F.col("source").eqNullSafe(F.col("__xylem_s")), "left").drop("__xylem_s").withColumn("w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)))
    total = sums.agg(F.sum("chars").alias("all_chars"), F.sum("w").alias("all_w"))
    return sums.crossJoin(F.broadcast(total)).select(  # one row on the right
        "source", "chars",
        F.when((F.col("chars") > 0) & (F.col("all_w") > 0), F.lit(budget) * F.col("all_chars") * F.col("w") / F.col("all_w") / F.col("chars")).otherwise(0.0).alias("rate"),
    )


def poisson_mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, temperature: float = TEMPERATURE, budget: float = BUDGET, weights: DataFrame | None = None) -> DataFrame:
    """Replicate documents to the target mixture and shuffle the copies globally.

    Adds ``rate``, ``n_copies``, ``copy`` (from 0) and ``shuffle_key``; columns with these names are replaced.
    A null source is a source of its own, a null text has size 0, equal keys get equal counts, and a null key
    counts as the key ''. Sources hold any share of the rows: the table of rates is one row for each source and
    is broadcast up to a checked number of them; above it, adaptive execution splits the skewed sources of a shuffled join.
    Copies are dealt by the hash of their shuffle key, and sorted by it in each partition: partitions are random samples in random order.
    """
    df = df.drop("rate", "n_copies", "copy", "shuffle_key")
    rates = source_rates(df, source, F.coalesce(F.length(F.col(text)), F.lit(0)), temperature, budget, weights)
    first, cdf = poisson_table(F.col("rate"))
    rates = rates.select(F.col("source").alias("__xylem_source"), F.col("rate"), F.coalesce(first, F.lit(0)).alias("__xylem_first"), cdf.alias("__xylem_cdf"))
    rates = broadcast_if_small(materialise(rates, "rates"), BROADCAST_ROWS)
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    counted = (
        df.join(rates, F.col(source).eqNullSafe(F.col("__xylem_source")))
        .withColumn("__xylem_u", unit_hash(F.lit(str(seed)), k))
        .withColumn("n_copies", F.col("__xylem_first") + F.size(F.filter("__xylem_cdf", lambda c: c <= F.col("__xylem_u"))))
        .drop("__xylem_source", "__xylem_first", "__xylem_cdf", "__xylem_u")
        .filter("n_copies > 0")
    )
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}s"), k, F.col("copy").cast("string"))))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op6_query(spark, sf_dir):
    from ..session import table

    docs = table(spark, sf_dir, "documents")
    return poisson_mix(docs).select("doc_id", "source", "copy", "n_copies", F.round("rate", 9).alias("rate"), "shuffle_key")


OP6_SQL = f"""
WITH s AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT chars FROM documents GROUP BY source),
t AS (SELECT sum(chars) all_chars, sum(pow(chars::DOUBLE, {TEMPERATURE})) all_w FROM s),
r AS (SELECT source, CASE WHEN chars > 0 AND all_w > 0 THEN {BUDGET} * all_chars * pow(chars::DOUBLE, {TEMPERATURE}) / all_w / chars ELSE 0.0::DOUBLE END rate FROM s, t),
p AS (SELECT source, rate, k, sum(exp(-rate + CASE WHEN i = 0 THEN 0 ELSE i * ln(rate) - lgamma(i + 1) END)) cdf
      FROM r, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) a(k), unnest(range(0, k + 1)) b(i) WHERE rate > 0 GROUP BY source, rate, k),
u AS (SELECT doc_id, source, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / {float(2**48)} u FROM documents),
c AS (SELECT d.doc_id, d.source, any_value(p.rate) rate, (count(*) FILTER (p.cdf <= d.u)) n
      FROM (SELECT *, row_number() OVER () rid FROM u) d JOIN p ON d.source IS NOT DISTINCT FROM p.source GROUP BY d.rid, d.doc_id, d.source)
SELECT doc_id, source, copy::INTEGER copy, n::INTEGER n_copies, round(rate, 9) rate,
       md5('{SEED}s:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) shuffle_key
FROM c, unnest(range(0, n)) x(copy)
"""
