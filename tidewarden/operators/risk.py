"""Incident risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the components: fixed values.
WEIGHTS = {"severity": 0.30, "anomaly": 0.25, "sequence": 0.20, "graph": 0.20, "evidence": 0.05}
SEVERITY = {"low": 25, "medium": 50, "high": 75, "critical": 100}
BANDS = [(80, "critical"), (60, "high"), (30, "medium")]
FORMULA_VERSION = "1.0"


def components() -> dict[str, Column]:
    severity = F.coalesce(*[F.when(F.col("severity") == k, float(v)) for k, v in SEVERITY.items()])
    parts = {"severity": severity, "anomaly": F.col("anomaly_score"), "sequence": F.col("sequence_confidence") * 100, "graph": F.col("graph_risk_score"), "evidence": F.least(F.lit(100.0), F.col("evidence_count") * 10.0)}
    return {k: F.lit(WEIGHTS[k]) * v.cast("double") for k, v in parts.items()}


def band(score: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def score_risk(inputs: DataFrame) -> DataFrame:
    """inputs (severity, anomaly_score, sequence_confidence, graph_risk_score, evidence_count) with
    components, risk_score (rounded to four places, at most 100) and band."""
    parts = components()
    total = sum(parts.values(), F.lit(0.0))
    out = inputs.withColumn("components", F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*parts.values()))).withColumn("risk_score", F.round(F.least(F.lit(100.0), total), 4))
    return out.withColumns({"band": band(F.col("risk_score")), "formula_version": F.lit(FORMULA_VERSION)})
