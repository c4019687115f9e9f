"""Whole flows: events to incidents, and the query functions a service would expose."""

from __future__ import annotations

import hmac
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import behavior, detection, investigate, risk, sequences
from ..rules import load_rules
from ..sources import sinks
from ..sources.sinks import IncidentStore

ROLES = {"investigator": 0, "operator": 1, "admin": 2}


def build_pipeline(rules=None, signatures=None, anomaly_scorer: Callable[[DataFrame], DataFrame] | None = None, ordered: bool | None = None, prefix: str = "tidewarden:incident:") -> Callable[[DataFrame], DataFrame]:
    """events -> incidents: rules, then anomalies, then sequences, folded once.

    ordered: whether arrival follows event time and ids don't repeat; None looks, by one more scan, and
    takes the exact machine if not.
    """
    rules = load_rules() if rules is None else rules
    signatures = sequences.load_sequences() if signatures is None else signatures

    def run(events: DataFrame) -> DataFrame:
        matches = detection.evaluate(events, rules)
        if anomaly_scorer is not None:
            matches = matches.unionByName(detection.anomaly_matches(events, anomaly_scorer(events)))
        look_ahead = sequences.is_ordered(events) if ordered is None else ordered
        found = (sequences.in_order if look_ahead else sequences.replay)(events, signatures)
        return detection.incidents(matches, found, prefix)

    return run


def z_scorer(threshold: float = 3.0, minimum_observations: int = 2) -> Callable[[DataFrame], DataFrame]:
    """Scores against baselines of the same events."""

    def run(events: DataFrame) -> DataFrame:
        vectors = behavior.extract_features(events)
        return behavior.score(vectors, behavior.baselines(vectors, behavior.NAMES), threshold, minimum_observations)

    return run


def risk_inputs(found: DataFrame, scores: DataFrame) -> DataFrame:
    """An incident's inputs: least(100, 10 * its events' largest z), whether a sequence completed, its events."""
    top = found.select("incident_id", F.explode("event_ids").alias("event_id")).join(scores.select("event_id", "score"), "event_id").groupBy("incident_id").agg(F.max("score").alias("top"))
    return found.join(top, "incident_id", "left").select(
        "incident_id", "severity", F.least(F.lit(100.0), 10 * F.coalesce("top", F.lit(0.0))).alias("anomaly_score"), F.exists("rule_ids", lambda r: r.startswith("sequence:")).cast("double").alias("sequence_confidence"),
        F.lit(0.0).alias("graph_risk_score"), F.least(F.size("event_ids"), F.lit(1000)).alias("evidence_count"),
    )


@dataclass
class Service:
    """The query surface: what HTTP routes would call. Without keys every caller is an admin."""

    store: IncidentStore
    baselines: DataFrame | None = None
    keys: tuple[tuple[str, str], ...] = ()

    def authenticate(self, key: str | None) -> str:
        if not self.keys:
            return "admin"
        for known, role in self.keys:
            if key is not None and hmac.compare_digest(known, key):
                return role
        raise PermissionError("unknown key")

    def require(self, key: str | None, role: str) -> None:
        if ROLES[self.authenticate(key)] < ROLES[role]:
            raise PermissionError(f"{role} needed")

    def health(self) -> dict:
        return {"status": "ok"}

    def ready(self) -> dict:
        return {"status": "ready" if self.store.version() else "degraded"}

    def metrics(self, **counted: float) -> str:
        """The metrics route: what the store holds, and the counters that are given (see sources.sinks)."""
        held = self.store.all().count() if self.store.version() else 0
        return sinks.prometheus({"incidents": held, **counted}, gauges=sinks.GAUGES | {"incidents"})

    def list_incidents(self, key: str | None = None) -> dict:
        self.require(key, "investigator")
        items = self.store.all()
        return {"items": items, "total": items.count()}

    def incident(self, fingerprint: str, key: str | None = None) -> DataFrame:
        self.require(key, "investigator")
        found = self.store.get(fingerprint)
        if found.isEmpty():
            raise LookupError(fingerprint)
        return found

    def assess(self, fingerprint: str, inputs: DataFrame, key: str | None = None) -> DataFrame:
        self.require(key, "operator")
        found = self.incident(fingerprint, key)
        audits = risk.score_risk(inputs).withColumns({"recorded_seq": F.lit(0), "recorded_at": F.current_timestamp()})
        if not audits.join(found.select("incident_id"), "incident_id", "left_anti").isEmpty():
            raise ValueError("the assessment names another incident")
        out = detection.apply_risk(found.drop("risk_audit", "risk_score", "risk_band"), audits)
        self.store.upsert(out)
        return self.store.get(fingerprint)

    def investigate(self, requests: DataFrame, evidence: DataFrame, key: str | None = None) -> DataFrame:
        self.require(key, "investigator")
        return investigate.investigate(requests, evidence)

    def register(self, known: DataFrame, entity_id: str, key: str | None = None) -> None:
        """Add or replace one entity's baseline; it must be that entity's."""
        self.require(key, "admin")
        self.baselines = behavior.register(self.baselines, known, entity_id)

    def score(self, vectors: DataFrame, known: DataFrame | None = None, threshold: float = 3.0) -> DataFrame:
        known = self.baselines if known is None else known
        if known is None:
            raise LookupError("no baselines are registered")
        if not (missing := behavior.unknown_entities(vectors, known)).isEmpty():
            raise LookupError(f"no baseline of {missing.first()['entity_id']}")
        return behavior.score(vectors, known, threshold)
