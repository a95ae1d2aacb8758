"""Execution logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("success", "warning", "error", "skipped")


def step_summary(logs: DataFrame) -> DataFrame:
    """Runs and durations by node and status of ``logs`` (node_name, status, duration_ms)."""
    return logs.groupBy("node_name", "status").agg(F.count("*").alias("runs"), F.round(F.sum("duration_ms"), 4).alias("total_ms"), F.max("duration_ms").alias("max_ms"))


def session_summary(logs: DataFrame) -> DataFrame:
    """Steps, warnings and errors of each session."""
    return logs.groupBy("session_id").agg(F.count("*").alias("steps"), F.count_if(F.col("status") == "warning").alias("warnings"), F.count_if(F.col("status") == "error").alias("errors"), F.max("timestamp").alias("last_step"))
