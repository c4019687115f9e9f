"""Sequence matching and incidents over Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..functions.tables import shared_dir
from ..operators import detection
from ..operators.sequences import Machine, as_frame, compact, enabled_of, feed, running_clock, stepped
from ..sources.sinks import IncidentStore


def match_stream(events: DataFrame, signatures, max_active_per_actor: int = 1000, lateness: str = "10 minutes") -> DataFrame:
    """Matches of a stream, with one state an actor.

    Replays are dropped within the watermark. Without a __clock column an actor's own largest time
    is its clock, so an event that another actor's clock makes late may still count; stamp batches
    with ``StampedRunner`` for the exact result.
    """
    found = enabled_of(signatures)
    plain = compact(found)
    stamped = "__clock" in events.columns
    unique = events.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["event_id"])
    ready = stepped(unique, found)
    if not stamped:
        ready = ready.withColumn("__clock", F.lit(None).cast("long"))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, partials = (state.get[0], json.loads(state.get[1])) if state.exists else (-(2**62), [])
        machine = Machine(plain, max_active_per_actor, [[p[0], p[1], p[2], p[3], [tuple(e) for e in p[4]]] for p in partials])
        rows = pd.concat(list(parts)).sort_values("arrival_seq")
        if not stamped:
            rows["__clock"] = rows["__ts"].cummax().clip(lower=clock)
        out = feed(machine, rows)
        state.update((int(rows["__clock"].max()), json.dumps(machine.partials)))
        yield as_frame(key[0], out)

    return ready.groupBy("actor_id").applyInPandasWithState(run, schemas.SEQUENCE_MATCHES, "clock long, partials string", "append", GroupStateTimeout.NoTimeout)


class StampedRunner:
    """The exact machine over micro-batches: for ``foreachBatch``.

    Each batch is stamped with the running clock of all events so far. Partial matches and the clock are
    kept as tables in the shared folder, one version a batch; ids are only added, a part each batch. A
    batch that is run again after a failure, or after the driver's restart, starts from the last complete
    version before it. With ``remember``, ids of batches more than that many back are forgotten.
    """

    def __init__(self, spark: SparkSession, signatures, path: str | None = None, max_active_per_actor: int = 1000, remember: int | None = None):
        if max_active_per_actor < 1 or remember is not None and remember < 1:
            raise ValueError("state bounds must be positive")
        self.spark, self.found, self.bound, self.remember = spark, enabled_of(signatures), max_active_per_actor, remember
        self.path = path or f"{shared_dir(spark)}/tidewarden/stream-state"

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def before(self, batch_id: int) -> int:
        """The last complete version before a batch; -1 if there is none. The clock is written last."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        numbers = [int(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
        return max((n for n in numbers if n < batch_id and self._exists(f"{self.path}/versions/{n:09d}/clock/_SUCCESS")), default=-1)

    def _read(self, last: int, name: str, schema: str) -> DataFrame:
        if last < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/versions/{last:09d}/{name}")

    def _seen(self, batch_id: int) -> DataFrame:
        if not self._exists(f"{self.path}/ids"):
            return self.spark.createDataFrame([], "event_id string")
        ids = self.spark.read.schema("event_id string, batch long").parquet(f"{self.path}/ids").where(F.col("batch") < batch_id)
        return (ids if self.remember is None else ids.where(F.col("batch") >= batch_id - self.remember)).select("event_id")

    def state(self) -> dict:
        """The largest event time so far, in micros, and the number of active partial matches."""
        last = self.before(1 << 62)
        clock = self._read(last, "clock", "clock long").agg(F.max("clock").alias("c")).first()["c"]
        active = self._read(last, "states", "actor_id string, partials string").agg(F.coalesce(F.sum(F.size(F.from_json("partials", "array<string>"))), F.lit(0)).alias("n")).first()["n"]
        return {"watermark": clock, "active_state_count": active}

    def __call__(self, batch: DataFrame, batch_id: int) -> DataFrame:
        at, last = f"{self.path}/versions/{batch_id:09d}", self.before(batch_id)
        states = self._read(last, "states", "actor_id string, partials string")
        clock = self._read(last, "clock", "clock long").agg(F.max("clock").alias("c")).first()["c"]
        fresh = batch.dropDuplicates(["event_id"]) if "arrival_seq" not in batch.columns else detection.first_of(batch.withColumns({"rule_id": F.lit(0), "rule_index": F.lit(0)})).drop("rule_id", "rule_index")
        fresh = fresh.join(self._seen(batch_id), "event_id", "left_anti")
        ids = f"{self.path}/ids/batch={batch_id}"
        fresh.select("event_id").write.mode("overwrite").parquet(ids)
        fresh = fresh.join(self.spark.read.schema("event_id string").parquet(ids), "event_id", "left_semi")
        stamped = running_clock(fresh)
        if clock is not None:
            stamped = stamped.withColumn("__clock", F.greatest("__clock", F.lit(clock)))
        plain, bound = compact(self.found), self.bound

        def run(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            partials = json.loads(state["partials"].iloc[0]) if len(state) else []
            machine = Machine(plain, bound, [[p[0], p[1], p[2], p[3], [tuple(e) for e in p[4]]] for p in partials])
            actor = rows["actor_id"].iloc[0] if len(rows) else state["actor_id"].iloc[0]
            out = as_frame(actor, feed(machine, rows) if len(rows) else [])
            # the state travels as one more row
            rows_ = [*out.assign(partials=None).itertuples(index=False, name=None), (None, None, actor, *[None] * 7, json.dumps(machine.partials))]
            return pd.DataFrame(rows_, columns=[*out.columns, "partials"]).astype({"signature_version": "Int64", "completed_seq": "Int64", "start_seq": "Int64"})

        both = stepped(stamped, self.found).groupBy("actor_id").cogroup(states.groupBy("actor_id")).applyInPandas(run, f"{schemas.SEQUENCE_MATCHES}, partials string")
        out = f"{self.path}/matches/{batch_id:09d}"  # what callers read lazily; it stays
        both.write.mode("overwrite").parquet(out)
        both = self.spark.read.parquet(out)
        both.where("partials is not null and partials <> '[]'").select("actor_id", "partials").write.mode("overwrite").parquet(f"{at}/states")
        stamped.agg(F.max("__clock").alias("clock")).select(F.greatest("clock", F.lit(clock).cast("long")).alias("clock")).write.mode("overwrite").parquet(f"{at}/clock")
        self._forget(last)
        return both.where("signature_id is not null").drop("partials")

    def _forget(self, last: int) -> None:
        """Versions before the last but one go; a batch that is run again needs no older one."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for x in fs.listStatus(p):
            if int(x.getPath().getName()) < last:
                fs.delete(x.getPath(), True)


#: Folders by fingerprint of the matches that ``incident_stream`` keeps.
BUCKETS = 64


def incident_stream(matches: DataFrame, store: IncidentStore, path: str):
    """Fold a stream of rule matches into the store: each batch refolds the fingerprints it touches
    over all their matches. Those are kept as a table in folders by fingerprint, of which a batch reads the
    ones it touches; replays, and a batch run again after a failure, change nothing."""
    spark = store.spark
    bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(BUCKETS)).alias("bucket")

    def run(batch: DataFrame, batch_id: int) -> None:
        at = f"{path}/matches/batch={batch_id}"
        batch.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(at)
        batch = spark.read.schema(batch.schema).parquet(at)
        if batch.isEmpty():
            return
        touched = [r["bucket"] for r in batch.select(bucket).distinct().collect()]  # BUCKETS rows at most
        every = spark.read.parquet(f"{path}/matches").where(F.col("bucket").isin(touched)).drop("batch", "bucket")
        touched = every.join(batch.select("fingerprint").distinct(), "fingerprint", "left_semi")
        store.upsert(detection.incidents(touched))

    return matches.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/checkpoint")
