"""Comparison of two runs: findings, fields, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finding_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Codes of both runs with status new, no_longer_detected, changed or unchanged.

    A finding changed if its severity, count or set of affected keys did. Both need code, severity, count and
    affected (an array); codes are unique in a run.
    """
    a = before.select("code", F.col("severity").alias("severity_a"), F.col("count").alias("count_a"), F.col("affected").alias("affected_a"), F.lit(True).alias("in_a"))
    b = after.select("code", F.col("severity").alias("severity_b"), F.col("count").alias("count_b"), F.col("affected").alias("affected_b"), F.lit(True).alias("in_b"))
    both = a.join(b, "code", "full_outer")
    added, removed = F.array_except("affected_b", "affected_a"), F.array_except("affected_a", "affected_b")
    same = F.col("severity_a").eqNullSafe(F.col("severity_b")) & F.col("count_a").eqNullSafe(F.col("count_b")) & (F.size(added) == 0) & (F.size(removed) == 0)
    status = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "no_longer_detected").when(same, "unchanged").otherwise("changed")
    return both.select("code", status.alias("status"), "count_a", "count_b", F.coalesce(F.size(added), F.lit(0)).cast("long").alias("n_added"), F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"))


def metric_deltas(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, before, after, delta of two one-row summaries."""
    long = lambda df, name: df.select(*(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([], metrics, "metric", name)
    return long(before, "before").join(long(after, "after"), "metric").select("metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def canonical(value):
    """A JSON-like value in a form that does not depend on the order of lists or keys, for evidence equality."""
    import json

    if isinstance(value, dict):
        return json.dumps({k: canonical(v) for k, v in value.items()}, sort_keys=True)
    if isinstance(value, (list, tuple)):
        return json.dumps(sorted(map(str, map(canonical, value))))
    return value
