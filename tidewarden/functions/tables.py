"""Cutting lineage in loops: tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a temporary folder on a local master, and on
    a cluster one beside the warehouse's tables, which all machines see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        root = tempfile.gettempdir() if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        found = f"{root}/tidewarden-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/tidewarden/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if it has few rows; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "low", 0).when(severity == "medium", 1).when(severity == "high", 2).when(severity == "critical", 3)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 0, "low").when(rank == 1, "medium").when(rank == 2, "high").when(rank == 3, "critical")
