"""Stored runs: metadata and findings as appended Parquet, listed newest first."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_META = "run_id string, created_at string, label string, location string, n_documents long"


def save_run(spark: SparkSession, store: str, findings: DataFrame, inventory: DataFrame, location: str, label: str = "") -> str:
    """Appends a run; its findings are written before its metadata, so a run that is listed is whole."""
    run_id = str(uuid.uuid4())
    findings.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{store}/findings")
    n = inventory.first()["n_documents"]
    row = (run_id, datetime.now(timezone.utc).isoformat(), label[:200], location, n)
    spark.createDataFrame([row], _META).write.mode("append").parquet(f"{store}/runs")
    return run_id


def list_runs(spark: SparkSession, store: str, limit: int = 20, offset: int = 0) -> DataFrame:
    return spark.read.schema(_META).parquet(f"{store}/runs").orderBy(F.desc("created_at"), "run_id").offset(offset).limit(limit)


def load_findings(spark: SparkSession, store: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{store}/findings").where(F.col("run_id") == run_id)
