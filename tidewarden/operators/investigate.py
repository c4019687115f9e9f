"""Evidence summaries, runbook recommendations and citation integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runbooks and the evidence types that trigger them: fixed values.
RUNBOOKS = [
    ("behavioral-anomaly-triage", "Behavioral anomaly triage", ["baseline"]),
    ("credential-compromise-response", "Credential compromise response", ["event", "sequence_match"]),
    ("graph-relationship-investigation", "Graph relationship investigation", ["graph_path", "incident"]),
]
EVIDENCE_TYPES = ["event", "incident", "sequence_match", "graph_path", "baseline"]


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """request_id, total and text: "2 event, 1 graph path"."""
    each = evidence.groupBy("request_id", "reference_type").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reference_type", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), F.replace(x["reference_type"], F.lit("_"), F.lit(" ")))), ", ")
    return each.groupBy("request_id").agg(F.sum("n").alias("total"), text.alias("text"))


def recommend(evidence: DataFrame, runbooks=RUNBOOKS) -> DataFrame:
    """request_id, runbook_id, title, reason, by runbook id within a request."""
    spark = evidence.sparkSession
    catalog = spark.createDataFrame([(i, t, x) for i, t, types in runbooks for x in types], "runbook_id string, title string, reference_type string")
    hits = evidence.select("request_id", "reference_type").distinct().join(F.broadcast(catalog), "reference_type")
    types = F.transform(F.array_sort(F.collect_set("reference_type")), lambda x: F.replace(x, F.lit("_"), F.lit(" ")))
    return hits.groupBy("request_id", "runbook_id", "title").agg(F.concat(F.lit("Evidence includes: "), F.array_join(types, ", "), F.lit(".")).alias("reason"))


def investigate(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """One response per request (request_id, incident_id): summary from counts, all evidence cited, no hypotheses."""
    summary = F.format_string("Investigation prepared for incident %s using %d evidence reference(s): %s. No hypothesis was generated by the deterministic workflow.", F.col("incident_id"), F.col("total"), F.col("text"))
    cited = evidence.groupBy("request_id").agg(F.collect_list(F.struct("reference_type", "reference_id", "source")).alias("cited_evidence"))
    books = recommend(evidence).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("runbook_id", "title", "reason"))).alias("runbooks"))
    out = requests.join(evidence_counts(evidence), "request_id").join(cited, "request_id").join(books, "request_id", "left")
    return out.select("request_id", "incident_id", summary.alias("summary"), "cited_evidence", F.coalesce("runbooks", F.array().cast("array<struct<runbook_id:string,title:string,reason:string>>")).alias("runbooks"), F.current_timestamp().alias("generated_at"))


def citation_problems(citations: DataFrame, cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """request_id, missing: what hypotheses cite but the response doesn't, and what the response cites
    but the request didn't supply. Empty if all is well. Each frame: request_id, reference_id."""
    key = ["request_id", "reference_id"]
    uncited = citations.select(*key).distinct().join(cited.select(*key), key, "left_anti").withColumn("problem", F.lit("not cited"))
    unknown = cited.select(*key).distinct().join(evidence.select(*key), key, "left_anti").withColumn("problem", F.lit("not supplied"))
    return uncited.unionByName(unknown).groupBy("request_id", "problem").agg(F.array_sort(F.collect_list("reference_id")).alias("missing"))
