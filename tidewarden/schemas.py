"""Relations of the engine, and validators that split rows into valid ones and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS = (
    "arrival_seq long, event_id string, timestamp timestamp, ts_offset_seconds int, actor_id string, actor_type string, source_ip string, device_id string, action string, resource string, "
    "result string, attributes variant, severity string, source string, schema_version string"
)
RULE_MATCHES = "arrival_seq long, rule_index int, rule_id string, rule_version int, event_id string, actor_id string, resource string, matched_at timestamp, severity string, evidence string, fingerprint string"
SEQUENCE_MATCHES = (
    "signature_id string, signature_version int, actor_id string, event_ids array<string>, started_at timestamp, completed_at timestamp, completed_seq long, start_seq long, "
    "evidence array<struct<step_id:string,event_id:string,timestamp:string,action:string,resource:string,result:string>>, severity string"
)
LABELED = "event_id string, entity_id string, entity_type string, timestamp timestamp, features map<string,double>, is_anomalous boolean"
NODES = "arrival_seq long, pos int, node_id string, node_type string, label string, properties string, criticality int"
EDGES = "arrival_seq long, edge_id string, edge_type string, source_node_id string, target_node_id string, properties string, observed_at timestamp, confidence double"

ACTOR_TYPES = ["user", "service_account", "api_client", "device", "unknown"]
RESULTS = ["success", "failure", "unknown"]
SEVERITIES = ["low", "medium", "high", "critical"]
NODE_TYPES = ["user", "credential", "device", "ip", "role", "permission", "api", "service", "container", "database", "table", "secret", "repository"]
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ID_PATTERN = "^[a-zA-Z0-9:._/-]+$"


def split(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine); quarantine gets `problems`, the names of the checks that failed."""
    problems = F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("problems", problems)
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def valid_events(df: DataFrame, uuids: bool = True) -> tuple[DataFrame, DataFrame]:
    checks = {c: F.length(c) > 0 for c in ("actor_id", "action", "resource", "source")}
    checks |= {"timestamp": F.col("timestamp").isNotNull(), "actor_type": F.col("actor_type").isin(ACTOR_TYPES), "result": F.col("result").isin(RESULTS), "severity": F.col("severity").isin(SEVERITIES)}
    if uuids:
        checks["event_id"] = F.col("event_id").rlike(UUID_PATTERN)
    return split(df, checks)


def valid_nodes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(df, {"node_id": F.col("node_id").rlike(ID_PATTERN), "criticality": F.col("criticality").between(0, 100)})


def valid_edges(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(df, {"edge_id": F.col("edge_id").rlike(ID_PATTERN), "confidence": F.col("confidence").between(0, 1)})


def valid_risk_inputs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(
        df,
        {
            "severity": F.col("severity").isin(SEVERITIES), "anomaly_score": F.col("anomaly_score").between(0, 100), "sequence_confidence": F.col("sequence_confidence").between(0, 1),
            "graph_risk_score": F.col("graph_risk_score").between(0, 100), "evidence_count": F.col("evidence_count").between(0, 1000),
        },
    )
