"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shelter, sheltered

SEED = 17
#: A mean above this is drawn as a sum of independent Poisson numbers with at most this mean each.
LARGEST_MEAN = 8.0
#: Terms of the distribution function; beyond them lies less than 1e-15 for the largest mean.
TERMS = 48


def uniform(key: Column, salt: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5 of seed, salt and key, the same in any engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), salt.cast("string"), key).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) > u for X Poisson with this mean, which must not be above LARGEST_MEAN."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("below"), F.lit(0).alias("k"))
    step = lambda acc, i: F.struct((acc["term"] * mean / i).alias("term"), (acc["below"] + acc["term"] * mean / i).alias("below"), (acc["k"] + (acc["below"] <= u).cast("int")).alias("k"))
    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["k"])).otherwise(0)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, size: Column | None = None, alpha: float = 0.5) -> DataFrame:
    """mixed_source, mean: the mean number of times that each source's documents are repeated.

    A source with weight w gets epochs * total * w / sum of weights, in `size` (rows, if null), so its documents are
    repeated that over the source's own size. weights null: a source of size n weighs n^alpha
    (0: all sources alike, 1: as they are). Sources missing from
    weights get 0; null is a source of its own. Grouped by source after a partial sum in each task, so one source with
    a third of all rows makes no large task.
    """
    amount = F.lit(1).cast("double") if size is None else size.cast("double")
    sums = docs.groupBy(F.col("source").alias("mixed_source")).agg(F.sum(amount).alias("n"))
    if weights is None:
        w = F.pow(F.col("n"), F.lit(float(alpha)))
    else:
        w = F.lit(0.0)
        for name, x in weights.items():
            w = F.when(F.col("mixed_source").isNull() if name is None else F.col("mixed_source") == name, F.lit(float(x))).otherwise(w)
    sums = sums.withColumn("w", F.when(F.col("n") > 0, w).otherwise(0.0))
    total = sums.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    return sums.join(F.broadcast(total)).select("mixed_source", F.when((F.col("n") > 0) & (F.col("all_w") > 0), F.lit(float(epochs)) * F.col("all_n") * F.col("w") / F.col("all_w") / F.col("n")).otherwise(0.0).alias("mean"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, key: Column | None = None, order: bool = True, alpha: float = 0.5) -> DataFrame:
    """Each document as often as a Poisson number says, with mix_mean, n_copies, copy_no (from 0) and shuffle_key.

    The number inverts the Poisson distribution with its source's mean at a hash of the document's key (doc_id as
    text; null ids: the text), so a second run, a retried task or another engine draws the same. Rows with the same
    key are drawn alike. Documents drawn 0 times are not in the result; that is what the target weights ask for.
    If order, rows are dealt by a hash of shuffle_key, itself a hash of key and copy_no, and sorted by it: reading the
    files in order is a global shuffle, for which nothing has to be sampled. The means are a table with one row per source, joined on it; Spark broadcasts it
    only if it is small, and splits a hot source otherwise. Columns of docs with the names of the results are replaced.
    """
    columns, used = docs.columns, ("doc_id", "text", "source")
    docs = shelter(docs, *used)
    if key is None:
        key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    means = rates(docs, weights, epochs, alpha=alpha)
    joined = docs.withColumn("mixed_key", key).join(means, docs["source"].eqNullSafe(means["mixed_source"]), "left").withColumn("mix_mean", F.coalesce("mean", F.lit(0.0)))
    parts = F.greatest(F.ceil(F.col("mix_mean") / LARGEST_MEAN).cast("int"), F.lit(1))
    drawn = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, i: acc + poisson(uniform(F.col("mixed_key"), i), F.col("mix_mean") / parts))
    out = joined.withColumn("n_copies", drawn).where(F.col("n_copies") > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(SEED)), F.lit("order"), F.col("copy_no").cast("string"), F.col("mixed_key")).cast("binary")))
    if order:
        out = out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return sheltered(out, columns, used, "mix_mean", "n_copies", "copy_no", "shuffle_key")


def op4_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.round("mix_mean", 9).alias("mix_mean"), "n_copies", "copy_no", "shuffle_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


#: The same in DuckDB, for means of LARGEST_MEAN at most.
OP4_SQL = """
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
m AS (SELECT source, (SELECT sum(n) FROM s)::DOUBLE * pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM s) / n AS mean FROM s),
p(source, mean, k, term, below) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM m
  UNION ALL SELECT source, mean, k + 1, term * mean / (k + 1), below + term * mean / (k + 1) FROM p WHERE k < 48),
d AS (SELECT doc_id, source, text, ((('0x' || substr(md5('17:1:' || doc_id::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
c AS (SELECT d.doc_id, d.source, d.text, m.mean, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM d.source AND p.k < 48 AND p.below <= d.u) AS n_copies
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, source, round(mean, 9) AS mix_mean, n_copies::INT AS n_copies, i::INT AS copy_no,
  md5('17:order:' || i::VARCHAR || ':' || doc_id::VARCHAR) AS shuffle_key, md5(coalesce(text, '')) AS text_md5
FROM (SELECT *, unnest(range(0, n_copies)) AS i FROM c WHERE n_copies > 0)
"""
