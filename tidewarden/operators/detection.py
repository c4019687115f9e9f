"""Rule evaluation and incidents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import incident_id
from ..functions.tables import severity_name, severity_rank
from ..rules import Rule, compile_conditions


def evaluate(events: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One row per event and enabled rule that matches: one scan for all rules, no join."""
    enabled = [r for r in rules if r.enabled]
    found = []
    for i, r in enumerate(enabled):
        test, evidence = compile_conditions(r.conditions, r.match_mode)
        found.append(F.when(test, F.struct(F.lit(i).alias("rule_index"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.version).alias("rule_version"), F.lit(r.severity).alias("severity"), evidence.alias("evidence"))))
    match = F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())) if found else F.explode(F.expr("cast(array() as array<struct<rule_index:int,rule_id:string,rule_version:int,severity:string,evidence:string>>)"))
    out = events.select("arrival_seq", "event_id", "actor_id", "resource", F.col("timestamp").alias("matched_at"), match.alias("m"))
    return out.select("arrival_seq", "m.rule_index", "m.rule_id", "m.rule_version", "event_id", "actor_id", "resource", "matched_at", "m.severity", "m.evidence", F.concat_ws(":", "actor_id", "resource").alias("fingerprint"))


def anomaly_matches(events: DataFrame, scores: DataFrame, rule_index: int = 1_000_000) -> DataFrame:
    """Anomalous scores as matches of one built-in rule; critical from a score of 10 on."""
    joined = events.alias("e").join(scores.where("is_anomalous").alias("s"), (F.col("e.event_id") == F.col("s.event_id")) & (F.col("e.actor_id") == F.col("s.entity_id")))
    evidence = F.to_json(F.struct(F.col("s.score").alias("anomaly_score"), "s.baseline_observation_count", F.lit("z_score").alias("detector"), F.col("s.features").alias("feature_scores"), "s.top_contributors"))
    return joined.select(
        "e.arrival_seq", F.lit(rule_index).alias("rule_index"), F.lit("behavioral_anomaly").alias("rule_id"), F.lit(1).alias("rule_version"), "e.event_id", "e.actor_id", "e.resource", F.col("e.timestamp").alias("matched_at"),
        F.when(F.col("s.score") >= 10, "critical").otherwise("high").alias("severity"), evidence.alias("evidence"), F.concat_ws(":", "e.actor_id", "e.resource").alias("fingerprint"),
    )


def first_of(matches: DataFrame) -> DataFrame:
    """Replays dropped: of each (rule, event) the first arrival stays."""
    order = Window.partitionBy("rule_id", "event_id").orderBy("arrival_seq", "rule_index")
    return matches.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def sequence_signals(sequences: DataFrame) -> DataFrame:
    """Sequence matches in the shape that incidents are folded from; replayed matches dropped."""
    order = Window.partitionBy("signature_id", "signature_version", "event_ids").orderBy("completed_seq", "start_seq")
    s = sequences.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return s.select(
        F.concat_ws(":", F.lit("sequence"), "signature_id", "actor_id").alias("fingerprint"), F.col("completed_seq").alias("arrival_seq"), F.col("start_seq").alias("rule_index"),
        F.concat(F.lit("sequence:"), "signature_id", F.lit(":v"), F.col("signature_version").cast("string")).alias("rule_id"), "actor_id", F.transform("evidence", lambda x: x["resource"]).alias("resources"), "event_ids",
        F.col("started_at").alias("first_at"), F.col("completed_at").alias("last_at"), "severity", F.transform("evidence", lambda x: F.to_json(x)).alias("evidence"),
    )


def rule_signals(matches: DataFrame) -> DataFrame:
    return matches.select(
        "fingerprint", "arrival_seq", F.col("rule_index").cast("long").alias("rule_index"), "rule_id", "actor_id", F.array("resource").alias("resources"), F.array("event_id").alias("event_ids"),
        F.col("matched_at").alias("first_at"), F.col("matched_at").alias("last_at"), "severity", F.array("evidence").alias("evidence"),
    )


def facts(signals: DataFrame, prefix: str = "tidewarden:incident:") -> DataFrame:
    """What an incident is without its lists: bounded aggregates alone, combined before the shuffle.

    A fingerprint may hold any share of all signals.
    """
    order = F.struct("arrival_seq", "rule_index", "rule_id")
    out = signals.groupBy("fingerprint").agg(F.min_by("first_at", order).alias("first_seen"), F.max("last_at").alias("last_seen"), severity_name(F.max(severity_rank(F.col("severity")))).alias("severity"), F.count("*").alias("match_count"))
    return out.select(incident_id(F.col("fingerprint"), prefix).alias("incident_id"), "fingerprint", F.lit("open").alias("status"), "first_seen", "last_seen", "severity", "match_count")


def links(signals: DataFrame, prefix: str = "tidewarden:incident:") -> DataFrame:
    """An incident's events, a row each: incident_id, event_id, arrival_seq of the first signal that has it. For
    incidents too large for the lists that ``fold`` makes."""
    each = signals.select("fingerprint", "arrival_seq", F.explode("event_ids").alias("event_id")).groupBy("fingerprint", "event_id").agg(F.min("arrival_seq").alias("arrival_seq"))
    return each.select(incident_id(F.col("fingerprint"), prefix).alias("incident_id"), "event_id", "arrival_seq")


def fold(signals: DataFrame, prefix: str = "tidewarden:incident:") -> DataFrame:
    """Signals of one fingerprint as an incident.

    first_seen is that of the first arrival, last_seen the largest; lists keep arrival order. The lists
    hold all of an incident's events in one row; ``facts`` and ``links`` have the same without such a row.
    """
    order = F.struct("arrival_seq", "rule_index", "rule_id")
    listed = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(c).alias("v")))), lambda x: x["v"])))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return signals.groupBy("fingerprint").agg(
        F.min_by("first_at", order).alias("first_seen"), F.max("last_at").alias("last_seen"), severity_name(F.max(severity_rank(F.col("severity")))).alias("severity"),
        F.sort_array(F.collect_set("rule_id")).alias("rule_ids"), listed("event_ids").alias("event_ids"), F.sort_array(F.collect_set("actor_id")).alias("actor_ids"), union("resources").alias("resources"),
        F.count("*").alias("match_count"), listed("evidence").alias("evidence"),
    ).select(incident_id(F.col("fingerprint"), prefix).alias("incident_id"), "fingerprint", F.lit("open").alias("status"), "first_seen", "last_seen", "severity", "rule_ids", "event_ids", "actor_ids", "resources", "match_count", "evidence", F.lit("1.0").alias("schema_version"))


def incidents(matches: DataFrame, sequences: DataFrame | None = None, prefix: str = "tidewarden:incident:") -> DataFrame:
    signals = rule_signals(first_of(matches))
    if sequences is not None:
        signals = signals.unionByName(sequence_signals(sequences))
    return fold(signals, prefix)


def apply_risk(found: DataFrame, audits: DataFrame) -> DataFrame:
    """Attach each incident's last audit (by recorded_seq) as risk_score, risk_band and risk_audit."""
    last = audits.groupBy("incident_id").agg(F.max_by(F.struct("risk_score", "band", "components", "recorded_at"), "recorded_seq").alias("risk_audit"))
    return found.join(last, "incident_id", "left").withColumns({"risk_score": F.col("risk_audit.risk_score"), "risk_band": F.col("risk_audit.band")})
