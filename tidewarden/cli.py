"""python -m tidewarden.cli evaluate FIXTURE | demo EVIDENCE | incidents EVENTS"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import behavior, investigate
from .operators.ingest import ingest
from .plans.pipeline import build_pipeline
from .sources import readers, sinks


def demo(spark: SparkSession, path: str, incident_id: str = "incident-1") -> str:
    evidence = readers.evidence(spark, path)
    row = investigate.investigate(spark.createDataFrame([("request", incident_id)], "request_id string, incident_id string"), evidence).first()
    lines = [row["summary"], "Evidence:", *(f"  {e['reference_type']} {e['reference_id']} ({e['source']})" for e in row["cited_evidence"]), "Runbooks:", *(f"  {b['title']}: {b['reason']}" for b in row["runbooks"])]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="tidewarden")
    parser.add_argument("command", choices=["evaluate", "demo", "incidents"])
    parser.add_argument("path")
    parser.add_argument("--training-count", type=int, default=2)
    parser.add_argument("--output")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "evaluate":
        return sinks.report(args.output, behavior.run_fixture(readers.labeled_fixture(spark, args.path), args.training_count))
    if args.command == "demo":
        return demo(spark, args.path)
    found = build_pipeline(ordered=False)(ingest(readers.JsonLines(args.path).collect(spark), "cli"))
    return sinks.report(args.output, {"incidents": [r.asDict() for r in found.orderBy(F.col("fingerprint")).collect()]})


if __name__ == "__main__":
    print(main())
