"""Ordered multi-step behaviour of one actor inside an event-time window.

``in_order`` is pure Catalyst, for input whose arrival order is event-time order. ``replay`` runs the
exact state machine per actor, for disordered input; its cross-actor inputs (the running clock and
the replayed ids) are computed beforehand as columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..rules import Condition, compile_conditions, conditions_of


@dataclass(frozen=True)
class Step:
    step_id: str
    conditions: tuple[Condition, ...]


@dataclass(frozen=True)
class Signature:
    signature_id: str
    version: int
    name: str
    description: str
    steps: tuple[Step, ...]
    window_seconds: int
    allowed_lateness_seconds: int = 0
    severity: str = "high"
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.version < 1 or len(self.steps) < 2 or self.window_seconds <= 0 or self.allowed_lateness_seconds < 0:
            raise ValueError(f"bad signature {self.signature_id}")
        if len({s.step_id for s in self.steps}) < len(self.steps) or not all(s.conditions for s in self.steps):
            raise ValueError(f"repeated or empty steps in {self.signature_id}")


def signature_of(raw: dict) -> Signature:
    return Signature(**{**raw, "steps": tuple(Step(s["step_id"], conditions_of(s["conditions"])) for s in raw["steps"])})


def enabled_of(signatures) -> list[Signature]:
    found = [s for s in signatures if s.enabled]
    if len({s.signature_id for s in found}) < len(found):
        raise ValueError("two enabled signatures share an id")
    return found


def load_sequences(path: str | Path | None = None) -> tuple[Signature, ...]:
    raw = json.loads(Path(path or Path(__file__).parent.parent / "config/sequences.json").read_text(encoding="utf-8"))
    if not isinstance(raw, list):
        raise ValueError("sequences must be a JSON array")
    return tuple(map(signature_of, raw))


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def in_order(events: DataFrame, signatures) -> DataFrame:
    """Skip-till-next-match by look-ahead: one exchange and one sort a signature, whatever its steps.

    Needs distinct event ids and time that never falls with arrival.
    """
    out = None
    for s in enabled_of(signatures):
        w = Window.partitionBy("actor_id").orderBy("arrival_seq")
        df = events.withColumns({f"__s{i}": compile_conditions(step.conditions)[0] for i, step in enumerate(s.steps)})
        df = df.where(" or ".join(f"__s{i}" for i in range(len(s.steps))))
        chain = None
        for i in range(len(s.steps) - 1, 0, -1):
            here = F.struct("arrival_seq", "timestamp", F.struct("event_id", _iso(F.col("timestamp")).alias("timestamp"), "action", "resource", "result").alias("e"), *([F.col(f"__n{i + 1}").alias("next")] if chain else []))
            df = df.withColumn(f"__c{i}", F.when(F.col(f"__s{i}"), here))
            df = df.withColumn(f"__n{i}", F.expr(f"lead(__c{i}, 1) ignore nulls over (partition by actor_id order by arrival_seq)"))
            chain = f"__n{i}"
        links = [".".join([chain, *["next"] * i]) for i in range(len(s.steps) - 1)]
        first = F.struct("event_id", _iso(F.col("timestamp")).alias("timestamp"), "action", "resource", "result")
        steps = [first, *[F.col(f"{x}.e") for x in links]]
        evidence = F.array(*[F.struct(F.lit(step.step_id).alias("step_id"), e["event_id"].alias("event_id"), e["timestamp"].alias("timestamp"), e["action"].alias("action"), e["resource"].alias("resource"), e["result"].alias("result")) for step, e in zip(s.steps, steps, strict=True)])
        last = links[-1]
        hit = df.where(F.col("__s0") & F.col(f"{last}.arrival_seq").isNotNull()).where((F.unix_micros(f"{last}.timestamp") - F.unix_micros("timestamp")) <= s.window_seconds * 1_000_000)
        hit = hit.select(
            F.lit(s.signature_id).alias("signature_id"), F.lit(s.version).alias("signature_version"), "actor_id", F.transform(evidence, lambda x: x["event_id"]).alias("event_ids"), F.col("timestamp").alias("started_at"),
            F.col(f"{last}.timestamp").alias("completed_at"), F.col(f"{last}.arrival_seq").alias("completed_seq"), F.col("arrival_seq").alias("start_seq"), evidence.alias("evidence"), F.lit(s.severity).alias("severity"),
        )
        out = hit if out is None else out.unionByName(hit)
    return out if out is not None else events.sparkSession.createDataFrame([], schemas.SEQUENCE_MATCHES)


def running_clock(events: DataFrame, block: int = 100_000) -> DataFrame:
    """events with __clock: the largest timestamp so far by arrival.

    Prefix maxima in two levels (blocks of arrival numbers, then within), so that no task sees all rows.
    """
    micros = F.unix_micros("timestamp")
    df = events.withColumn("__block", F.floor(F.col("arrival_seq") / block))
    tops = df.groupBy("__block").agg(F.max(micros).alias("top"))  # a row for each `block` arrivals
    before = tops.select("__block", F.max("top").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inner = F.max(micros).over(Window.partitionBy("__block").orderBy("arrival_seq"))
    return df.withColumn("__inner", inner).join(before, "__block").withColumn("__clock", F.greatest("__inner", "__before")).drop("__block", "__inner", "__before")


def is_ordered(events: DataFrame) -> bool:
    """Is time never falling with arrival, and is every event id there once? Then ``in_order`` is exact."""
    clock = running_clock(events)
    row = clock.agg(F.count_if(F.unix_micros("timestamp") < F.col("__clock")).alias("late"), F.count("*").alias("n")).first()
    return row["late"] == 0 and events.groupBy("event_id").count().where("count > 1").isEmpty()


class Machine:
    """One actor's partial matches over all signatures; ``ends`` notes (start_seq, deadline, end_seq, reason) of those
    that ended, if it is a list."""

    def __init__(self, signatures: list[tuple[str, int, list[str], int, int, str]], bound: int, partials: list | None = None, ends: list | None = None):
        self.signatures, self.bound, self.ends = signatures, bound, ends
        #: (signature index, number of steps done, start in micros, start_seq, evidence)
        self.partials: list[list] = partials or []

    def push(self, ts: int, clock: int, seq: int, event: tuple, hits: dict[int, set[int]]) -> list[tuple]:
        out = []
        for k, (name, version, steps, window, lateness, severity) in enumerate(self.signatures):
            watermark = clock - lateness
            if ts < watermark:
                continue
            kept, rest = [], []
            for p in self.partials:
                if p[0] != k:
                    rest.append(p)
                    continue
                # expired by the clock, or by this event
                if watermark - p[2] > window or ts - p[2] > window:
                    self.end(p, None if watermark - p[2] > window else seq, "expired")
                    continue
                if p[1] in hits.get(k, ()):
                    p = [k, p[1] + 1, p[2], p[3], [*p[4], (steps[p[1]], *event)]]
                    if p[1] == len(steps):
                        out.append((name, version, [e[1] for e in p[4]], p[2], ts, seq, p[3], p[4], severity))
                        self.end(p, seq, "completed")
                        continue
                kept.append(p)
            if 0 in hits.get(k, ()):
                kept.append([k, 1, ts, seq, [(steps[0], *event)]])
            self.partials = rest + kept
        if len(self.partials) > self.bound:
            # the newest stay; of equals those that came first
            order = sorted(range(len(self.partials)), key=lambda i: (-self.partials[i][2], i))[: self.bound]
            for i in set(range(len(self.partials))).difference(order):
                self.end(self.partials[i], seq, "bound")
            self.partials = [self.partials[i] for i in sorted(order)]
        return out

    def end(self, p: list, seq: int | None, reason: str) -> None:
        """seq None: the clock ended it, at the first arrival past its deadline."""
        if self.ends is not None:
            self.ends.append((p[3], p[2] + self.signatures[p[0]][3] + self.signatures[p[0]][4], seq, reason))


def compact(signatures: list[Signature]) -> list[tuple[str, int, list[str], int, int, str]]:
    return [(s.signature_id, s.version, [x.step_id for x in s.steps], s.window_seconds * 1_000_000, s.allowed_lateness_seconds * 1_000_000, s.severity) for s in signatures]


def stepped(events: DataFrame, signatures: list[Signature]) -> DataFrame:
    """events as the machine takes them; __hits has signature * 1000 + step of each that matches."""
    hits = [F.when(compile_conditions(step.conditions)[0], k * 1000 + i) for k, s in enumerate(signatures) for i, step in enumerate(s.steps)]
    return events.select(
        "actor_id", "arrival_seq", "event_id", "action", "resource", "result", F.unix_micros("timestamp").alias("__ts"), _iso(F.col("timestamp")).alias("__iso"),
        F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("__hits"), *(["__clock"] if "__clock" in events.columns else []),
    )


def feed(machine: Machine, rows: pd.DataFrame) -> list[tuple]:
    out = []
    for r in rows.sort_values("arrival_seq").itertuples():
        hits: dict[int, set[int]] = {}
        for h in r[rows.columns.get_loc("__hits") + 1]:
            hits.setdefault(h // 1000, set()).add(h % 1000)
        out += machine.push(r[rows.columns.get_loc("__ts") + 1], r[rows.columns.get_loc("__clock") + 1], r.arrival_seq, (r.event_id, r[rows.columns.get_loc("__iso") + 1], r.action, r.resource, r.result), hits)
    return out


def as_frame(actor: str, found: list[tuple]) -> pd.DataFrame:
    names = ["step_id", "event_id", "timestamp", "action", "resource", "result"]
    rows = [
        (name, version, actor, ids, pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), seq, start_seq, [dict(zip(names, e, strict=True)) for e in evidence], severity)
        for name, version, ids, start, end, seq, start_seq, evidence, severity in found
    ]
    return pd.DataFrame(rows, columns=["signature_id", "signature_version", "actor_id", "event_ids", "started_at", "completed_at", "completed_seq", "start_seq", "evidence", "severity"])


def replay(events: DataFrame, signatures, max_active_per_actor: int = 1000) -> DataFrame:
    """The exact machine over disordered input: replays, lateness, eviction and the state bound included."""
    if max_active_per_actor < 1:
        raise ValueError("max_active_per_actor must be positive")
    found = enabled_of(signatures)
    plain = compact(found)
    first = Window.partitionBy("event_id").orderBy("arrival_seq")
    unique = events.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    # only events that match a step can change an actor's state; the clock has seen them all
    ready = stepped(running_clock(unique), found).where(F.size("__hits") > 0)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return as_frame(rows["actor_id"].iloc[0], feed(Machine(plain, max_active_per_actor), rows))

    return ready.groupBy("actor_id").applyInPandas(run, schemas.SEQUENCE_MATCHES)


def lifetimes(unique: DataFrame, found: list[Signature], max_active_per_actor: int = 1000) -> DataFrame:
    """start_seq, end_seq, reason of every partial match: completed, expired (by an event of its actor), evicted (by
    the clock of all actors) or bound; end_seq is null for those still active. unique carries __clock."""
    plain = compact(found)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        machine = Machine(plain, max_active_per_actor, ends=[])
        feed(machine, rows)
        for p in machine.partials:
            machine.end(p, None, "expired")
        return pd.DataFrame(machine.ends, columns=["start_seq", "deadline", "end_seq", "reason"]).astype({"end_seq": "Int64"})

    raw = stepped(unique, found).groupBy("actor_id").applyInPandas(run, "start_seq long, deadline long, end_seq long, reason string")
    own = raw.where("end_seq is not null").select("start_seq", "end_seq", "reason")
    return own.unionByName(_evicted(raw.where("end_seq is null"), unique))


def _evicted(waiting: DataFrame, unique: DataFrame, block: int = 3_600_000_000) -> DataFrame:
    """When the clock passes each deadline: an as-of join in blocks of time, so that no task sees all rows."""
    ticks = unique.groupBy(F.col("__clock").alias("at")).agg(F.min("arrival_seq").alias("seq")).withColumn("block", F.floor(F.col("at") / block))
    firsts = ticks.groupBy("block").agg(F.min("seq").alias("seq"))  # a row for each block of time
    after = F.min("seq").over(Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing))
    later = firsts.select("block", after.alias("later"))
    asked = waiting.select("start_seq", F.col("deadline").alias("at"), F.lit(None).cast("long").alias("seq"), F.floor(F.col("deadline") / block).alias("block"))
    both = ticks.select(F.lit(None).cast("long").alias("start_seq"), "at", "seq", "block").unionByName(asked)
    within = F.min("seq").over(Window.partitionBy("block").orderBy("at").rangeBetween(1, Window.unboundedFollowing))
    hit = both.withColumn("within", within).where("start_seq is not null")
    # blocks without a tick have no row of their own: the next block that has one
    known = later.select("block", "later", F.lit(True).alias("here"))
    gaps = hit.join(known, "block", "left")
    missing = gaps.where("within is null and here is null").select("block").distinct()
    nearest = missing.unionByName(firsts.select("block")).distinct().join(firsts, "block", "left").select("block", F.min("seq").over(Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    out = gaps.join(nearest, "block", "left").withColumn("end_seq", F.coalesce("within", "later", "next"))
    return out.select("start_seq", "end_seq", F.when(F.col("end_seq").isNull(), "active").otherwise("evicted").alias("reason"))


def peak_active(lives: DataFrame, block: int = 100_000) -> DataFrame:
    """The most partial matches that are active after any one arrival: prefix sums in two levels."""
    steps = lives.select(F.explode(F.array(F.struct(F.col("start_seq").alias("seq"), F.lit(1).alias("d")), F.struct(F.col("end_seq").alias("seq"), F.lit(-1).alias("d")))).alias("x")).select("x.*").where("seq is not null")
    net = steps.groupBy("seq").agg(F.sum("d").alias("d")).withColumn("block", F.floor(F.col("seq") / block))
    inner = net.withColumn("run", F.sum("d").over(Window.partitionBy("block").orderBy("seq"))).groupBy("block").agg(F.sum("d").alias("d"), F.max("run").alias("top"))
    before = F.coalesce(F.sum("d").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    return inner.withColumn("peak", before + F.col("top")).agg(F.coalesce(F.greatest(F.max("peak"), F.lit(0)), F.lit(0)).alias("peak"))


def counters(events: DataFrame, signatures, max_active_per_actor: int = 1000) -> DataFrame:
    """Processed, duplicate and late events; completed, evicted, still active and at most active partial matches; and the
    largest event time, in micros. An event is late if it is for any signature."""
    found = enabled_of(signatures)
    first = Window.partitionBy("event_id").orderBy("arrival_seq")
    marked = events.withColumn("__n", F.row_number().over(first))
    unique = running_clock(marked.where("__n = 1").drop("__n"))
    lateness = min((s.allowed_lateness_seconds for s in found), default=0)
    late = F.count_if(F.unix_micros("timestamp") < F.col("__clock") - lateness * 1_000_000) if found else F.lit(0).cast("long")
    counts = unique.agg(F.count("*").alias("processed"), late.alias("late"), F.max(F.unix_micros("timestamp")).alias("watermark"))
    lives = lifetimes(unique, found, max_active_per_actor)
    ends = lives.agg(*(F.count_if(F.col("reason") == r).alias(n) for r, n in (("completed", "completed"), ("evicted", "evicted"), ("active", "active"))))
    return counts.crossJoin(marked.agg(F.count_if(F.col("__n") > 1).alias("duplicates"))).crossJoin(ends).crossJoin(peak_active(lives))  # a row each
