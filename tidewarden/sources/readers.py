"""Sources: JSON lines, labelled fixtures, evidence, artifacts with checksums, and adapters."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.artifacts import load_artifact
from ..operators.ingest import severity_of


class Collector(Protocol):
    def collect(self, spark: SparkSession) -> DataFrame:
        """(arrival_seq, raw)"""


@dataclass(frozen=True)
class JsonLines:
    """One JSON object a line; blank lines are skipped. strict: any bad line fails the read."""

    path: str
    strict: bool = True

    def numbered(self, spark: SparkSession) -> DataFrame:
        """Line numbers follow file name and position; one row for each part of a file sets its base."""
        lines = spark.read.text(self.path).select(F.col("value").alias("raw"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("i"))
        lines = lines.withColumn("part", F.shiftright("i", 33))
        parts = lines.groupBy("file", "part").agg(F.count("*").alias("n"))
        base = parts.select("file", "part", F.coalesce(F.sum("n").over(Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        local = F.row_number().over(Window.partitionBy("file", "part").orderBy("i"))
        return lines.withColumn("local", local).join(base, ["file", "part"]).select((F.col("base") + F.col("local")).alias("arrival_seq"), "raw")

    def collect(self, spark: SparkSession) -> DataFrame:
        rows = self.numbered(spark).where(F.trim("raw") != "")
        good = F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False))
        if not self.strict:
            return rows.where(good)
        checked = F.when(good, F.col("raw")).otherwise(F.raise_error(F.format_string("%s:%d: not a JSON object", F.lit(self.path), F.col("arrival_seq"))))
        return rows.select("arrival_seq", checked.alias("raw"))

    def quarantine(self, spark: SparkSession) -> DataFrame:
        good = F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False))
        return self.numbered(spark).where((F.trim("raw") != "") & ~good)

    def stream(self, spark: SparkSession) -> DataFrame:
        """The same lines as a replay stream; arrival_seq follows file time, then position."""
        return spark.readStream.text(self.path).where(F.trim("value") != "").select(F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_name").alias("file"))


def labeled_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Labelled vectors, flat or nested under "vector"."""
    numbered = JsonLines(path).collect(spark)
    inner = "event_id string, entity_id string, entity_type string, timestamp string, features map<string,double>"
    r = F.from_json("raw", f"{inner}, vector struct<{inner}>, is_anomalous boolean")
    df = numbered.withColumn("r", r)
    pick = lambda c: F.coalesce(f"r.vector.{c}", f"r.{c}")
    need = lambda c, name: F.coalesce(c, F.raise_error(F.format_string("line %d: missing %s", F.col("arrival_seq"), F.lit(name))))
    return df.select(
        "arrival_seq", need(pick("event_id"), "event_id").alias("event_id"), need(pick("entity_id"), "entity_id").alias("entity_id"), F.coalesce(pick("entity_type"), F.lit("unknown")).alias("entity_type"),
        F.coalesce(pick("timestamp"), F.lit("2026-08-13T12:00:00Z")).cast("timestamp").alias("timestamp"), need(pick("features"), "features").alias("features"), need(F.col("r.is_anomalous"), "is_anomalous").alias("is_anomalous"),
    )


def evidence(spark: SparkSession, path: str, request_id: str = "request") -> DataFrame:
    """Evidence references from a JSON array of objects; anything else, or a reference without its fields, fails."""
    whole = spark.read.text(path, wholetext=True)
    kind = F.schema_of_variant(F.try_parse_json("value"))
    checked = F.when(F.coalesce(kind.startswith("ARRAY"), F.lit(False)), F.col("value")).otherwise(F.raise_error(F.lit(f"{path}: not a JSON array")))
    each = whole.select(F.explode(F.from_json(checked, "array<struct<reference_type:string,reference_id:string,source:string>>")).alias("x")).select("x.*")
    need = lambda c: F.coalesce(c, F.raise_error(F.lit(f"{path}: a reference without {c}"))).alias(c)
    return each.select(F.lit(request_id).alias("request_id"), need("reference_type"), need("reference_id"), "source")


@dataclass(frozen=True)
class Settings:
    """Typed settings from environment-like mappings."""

    endpoint: str | None = None
    timeout_seconds: float = 10.0
    max_retries: int = 2
    api_keys: tuple[tuple[str, str], ...] = ()
    store_path: str | None = None

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ, prefix: str = "TIDEWARDEN_") -> Settings:
        keys = tuple(tuple(x.split(":", 1)) for x in env.get(f"{prefix}API_KEYS", "").split(",") if x)
        if any(len(k) != 2 or k[1] not in ("investigator", "operator", "admin") for k in keys):
            raise ValueError("API keys are key:role pairs")
        timeout, retries = float(env.get(f"{prefix}TIMEOUT", 10)), int(env.get(f"{prefix}RETRIES", 2))
        if not 0 < timeout <= 60 or not 0 <= retries <= 3:
            raise ValueError("timeout must be in (0, 60], retries in 0..3")
        return cls(env.get(f"{prefix}ENDPOINT"), timeout, retries, keys, env.get(f"{prefix}STORE"))


def table_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as canonical events (actions and attributes derived from its columns)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    action = F.when(F.col("event_type").isin("error", "signup"), "login").when(F.col("event_type") == "purchase", "role_change").when(F.col("event_type") == "view", "read").otherwise("export")
    result = F.when(F.col("event_type") == "error", "failure").otherwise("success")
    bag = F.parse_json(F.to_json(F.struct(F.round(F.col("value") * 100000).cast("long").alias("bytes"), F.col("value").alias("request_rate"), k.alias("k"))))
    df = e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("timestamp"), action.alias("action"), result.alias("result"), k.alias("__k"), bag.alias("attributes"))
    return df.select(
        F.col("event_id").alias("arrival_seq"), F.col("event_id").cast("string").alias("event_id"), "timestamp", F.lit(0).alias("ts_offset_seconds"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor_id"),
        F.lit("user").alias("actor_type"), F.lit(None).cast("string").alias("source_ip"), F.lit(None).cast("string").alias("device_id"), "action", F.concat(F.lit("resource-"), (F.col("__k") % 10).cast("string")).alias("resource"),
        "result", "attributes", severity_of(F.lit(None).cast("string"), F.col("action"), F.col("result")).alias("severity"), F.lit("events-table").alias("source"), F.lit("1.0").alias("schema_version"),
    )


def commerce_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a multi-hop graph from the commerce tables."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, i, kind, s, t, c: df.select(i.alias("edge_id"), F.lit(kind).alias("edge_type"), s.alias("source_node_id"), t.alias("target_node_id"), F.lit("{}").alias("properties"), F.lit(None).cast("timestamp").alias("observed_at"), c.cast("double").alias("confidence"))
    customer, nation, supplier = read("customer"), read("nation"), read("supplier")
    lowest = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("low"))
    edges = edge(customer, F.concat(F.lit("c"), F.col("c_custkey").cast("string")), "has_role", name("customer", "c_custkey"), name("nation", "c_nationkey"), 0.5 + (F.col("c_custkey") % 50) / 100)
    edges = edges.unionByName(edge(nation, F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "grants", name("nation", "n_nationkey"), name("region", "n_regionkey"), F.lit(0.9)))
    edges = edges.unionByName(edge(lowest, F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "can_reach", name("region", "n_regionkey"), name("nation", "low"), F.lit(0.6)))
    edges = edges.unionByName(edge(supplier, F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), "reads", name("nation", "s_nationkey"), name("supplier", "s_suppkey"), 0.4 + (F.col("s_suppkey") % 60) / 100))
    node = lambda df, i, kind, c: df.select(i.alias("node_id"), F.lit(kind).alias("node_type"), i.alias("label"), F.lit("{}").alias("properties"), c.cast("int").alias("criticality"))
    zero = F.lit(0)
    nodes = node(customer, name("customer", "c_custkey"), "user", zero).unionByName(node(nation, name("nation", "n_nationkey"), "role", zero)).unionByName(node(read("region"), name("region", "r_regionkey"), "service", zero))
    return nodes.unionByName(node(supplier, name("supplier", "s_suppkey"), "database", F.col("s_suppkey") % 101)), edges


__all__ = ["Collector", "JsonLines", "Settings", "commerce_graph", "evidence", "labeled_fixture", "load_artifact", "schemas", "table_events"]
