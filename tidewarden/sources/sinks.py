"""Sinks: publishers, the incident store, checksummed artifacts, metrics text."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.artifacts import save_artifact


class Publisher(Protocol):
    def publish(self, events: DataFrame) -> None: ...


@dataclass
class ViewPublisher:
    """Keeps what is published as a temporary view."""

    name: str = "published_events"
    frames: list[DataFrame] = field(default_factory=list)

    def publish(self, events: DataFrame) -> None:
        self.frames.append(events)
        out = self.frames[0]
        for df in self.frames[1:]:
            out = out.unionByName(df)
        out.createOrReplaceTempView(self.name)


def kafka_records(events: DataFrame) -> DataFrame:
    """key = event id, value = the event as compact JSON."""
    return events.select(F.col("event_id").alias("key"), F.to_json(F.struct("*")).alias("value"))


@dataclass
class KafkaPublisher:
    """Needs Spark's Kafka package on the class path."""

    servers: str
    topic: str

    def publish(self, events: DataFrame) -> None:
        kafka_records(events).write.format("kafka").option("kafka.bootstrap.servers", self.servers).option("topic", self.topic).save()


class IncidentStore:
    """Incidents by fingerprint in a shared folder.

    An upsert writes a whole new version and then commits it: a commit is a small file, named by its
    number and created only if there is none, so of two writers one wins and the other merges again.
    The version before stays for those who still read it; older ones go.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _commits(self) -> list[int]:
        fs, folder = self._fs(f"{self.path}/_commits")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getLen()) if fs.exists(folder) else []

    def _folder(self, number: int) -> str:
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        fs, p = self._fs(f"{self.path}/_commits/{number:08d}")
        file = fs.open(p)
        try:
            return f"{self.path}/{text.toString(file, 'UTF-8')}"
        finally:
            file.close()

    def version(self) -> str | None:
        commits = self._commits()
        return self._folder(commits[-1]) if commits else None

    def _commit(self, number: int, name: str) -> bool:
        fs, p = self._fs(f"{self.path}/_commits/{number:08d}")
        try:
            file = fs.create(p, False)
        except Exception as e:  # py4j wraps the JVM's exception
            if "FileAlreadyExists" in str(e):
                return False
            raise
        file.write(bytearray(name.encode()))
        file.close()
        return True

    def upsert(self, incidents: DataFrame, attempts: int = 10) -> None:
        for _ in range(attempts):
            commits = self._commits()
            number = commits[-1] + 1 if commits else 0
            out, name = incidents, f"v{number:08d}-{uuid.uuid4().hex[:8]}"
            if commits:
                old = self.spark.read.parquet(self._folder(commits[-1]))
                out = incidents.unionByName(old.join(incidents.select("fingerprint"), "fingerprint", "left_anti"), allowMissingColumns=True)
            out.write.parquet(f"{self.path}/{name}")
            if self._commit(number, name):
                for old_number in commits[:-1]:
                    fs, p = self._fs(self._folder(old_number))
                    fs.delete(p, True)
                    fs.delete(self._fs(f"{self.path}/_commits/{old_number:08d}")[1], False)
                return
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)
        raise RuntimeError("other writers kept winning")

    def all(self) -> DataFrame:
        now = self.version()
        if now is None:
            raise LookupError("the store is empty")
        return self.spark.read.parquet(now).orderBy("fingerprint")

    def get(self, fingerprint: str) -> DataFrame:
        now = self.version()
        if now is None:
            raise LookupError("the store is empty")
        return self.spark.read.parquet(now).where(F.col("fingerprint") == fingerprint)


def report(path: str | None, content: dict) -> str:
    text = json.dumps(content, indent=2, sort_keys=True, default=str)
    if path:
        Path(path).write_text(text + "\n")
    return text


def prometheus(counters: dict[str, float], prefix: str = "tidewarden", gauges: frozenset[str] = frozenset()) -> str:
    """Text exposition; a name may carry labels in braces."""
    lines = []
    for name, value in counters.items():
        bare = name.split("{")[0]
        lines += [f"# TYPE {prefix}_{bare} {'gauge' if bare in gauges else 'counter'}", f"{prefix}_{name} {value}"]
    return "\n".join(dict.fromkeys(lines)) + "\n"


def _latency(requests: float, seconds: float | None) -> dict[str, float]:
    """The sum of latencies and their average, if the time taken is known."""
    if seconds is None:
        return {}
    return {"latency_ms_sum": seconds * 1000, "latency_ms_average": seconds * 1000 / requests if requests else 0.0}


def anomaly_metrics(scores: DataFrame, by: str | None = None, seconds: float | None = None) -> dict[str, float]:
    """Counters of a scoring run; ``by`` names the column of the model, one counter each."""
    row = scores.agg(F.count("*").alias("n"), F.count_if("is_anomalous").alias("a")).first()
    out = {"score_requests_total": row["n"], "anomalous_requests_total": row["a"]}
    out |= {f"score_{k}": v for k, v in _latency(row["n"], seconds).items()}
    if by:
        out |= {f'score_requests_by_model_total{{model="{r[by]}"}}': r["count"] for r in scores.groupBy(by).count().orderBy(by).collect()}  # a row for each model
    return out


def sequence_metrics(counts: DataFrame, seconds: float | None = None) -> dict[str, float]:
    """Counters of ``sequences.counters``."""
    r = counts.first()
    out = {"events_processed_total": r["processed"], "duplicate_events_total": r["duplicates"], "late_events_total": r["late"], "matches_completed_total": r["completed"]}
    out |= {"states_evicted_total": r["evicted"], "active_states": r["active"], "peak_active_states": r["peak"]}
    return out | {f"sequence_{k}": v for k, v in _latency(r["processed"], seconds).items()}


#: Names whose values may fall.
GAUGES = frozenset(["active_states", "peak_active_states", "sequence_latency_ms_average", "score_latency_ms_average", "provider_latency_ms_average"])


@dataclass
class ProviderMetrics:
    """Counters of provider calls."""

    requests: int = 0
    successes: int = 0
    failures: int = 0
    retries: int = 0
    seconds: float = 0.0

    def observe(self, ok: bool, seconds: float, retries: int = 0) -> None:
        if seconds < 0 or retries < 0:
            raise ValueError("metrics can't be negative")
        self.requests += 1
        self.successes += ok
        self.failures += not ok
        self.retries += retries
        self.seconds += seconds

    def values(self) -> dict[str, float]:
        out = {f"provider_{k}_total": getattr(self, k) for k in ("requests", "successes", "failures", "retries")}
        return out | {f"provider_{k}": v for k, v in _latency(self.requests, self.seconds).items()}


__all__ = ["GAUGES", "IncidentStore", "KafkaPublisher", "ProviderMetrics", "Publisher", "ViewPublisher", "anomaly_metrics", "kafka_records", "prometheus", "report", "save_artifact", "sequence_metrics"]
