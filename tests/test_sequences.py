"""Look-ahead, replay and streams against each other and known cases."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewarden import schemas
from tidewarden.operators import sequences as S
from tidewarden.streaming.sequences import StampedRunner, match_stream

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def signature(window=300, lateness=0, steps=("failure", "success")):
    return S.signature_of({"signature_id": "sig", "version": 1, "name": "n", "description": "d", "window_seconds": window, "allowed_lateness_seconds": lateness, "severity": "high", "steps": [{"step_id": f"s{i}", "conditions": [{"field": "result", "operator": "eq", "value": r}]} for i, r in enumerate(steps)]})


def frame(spark, rows):
    """rows: (actor, seconds, result[, id])"""
    data = [(i, r[3] if len(r) > 3 else f"e{i}", T0 + timedelta(seconds=r[1]), 0, r[0], "user", None, None, "login", "console", r[2], "{}", "low", "t", "1.0") for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, schemas.EVENTS.replace("attributes variant", "attributes string"))
    return df.withColumn("attributes", F.parse_json("attributes"))


def ids(df):
    return sorted(tuple(r["event_ids"]) for r in df.select("event_ids").collect())


def test_window_edge(spark):
    assert ids(S.replay(frame(spark, [("a", 0, "failure"), ("a", 301, "success")]), [signature()])) == []
    both = [S.replay, S.in_order]
    assert [ids(f(frame(spark, [("a", 0, "failure"), ("a", 300, "success")]), [signature()])) for f in both] == [[("e0", "e1")]] * 2


def test_overlap_and_bound(spark):
    rows = [("a", 0, "failure"), ("a", 1, "failure"), ("a", 2, "failure"), ("a", 3, "success")]
    assert len(ids(S.replay(frame(spark, rows), [signature()]))) == 3
    assert ids(S.replay(frame(spark, rows), [signature()], 2)) == [("e1", "e3"), ("e2", "e3")]


def test_lateness(spark):
    rows = [("a", 0, "failure"), ("b", 100, "unknown"), ("a", 30, "success")]
    assert len(ids(S.replay(frame(spark, rows), [signature(lateness=80)]))) == 1
    assert ids(S.replay(frame(spark, rows), [signature(lateness=60)])) == []


def test_replayed_ids_count_once(spark):
    assert ids(S.replay(frame(spark, [("a", 0, "failure", "x"), ("a", 1, "failure", "x"), ("a", 2, "success", "y")]), [signature()])) == [("x", "y")]


def model(rows, sig):
    """The machine, event by event over all actors, written the plain way."""
    seen, partials, out, top = set(), [], [], None
    steps = [s.conditions[0].value for s in sig.steps]
    for i, r in enumerate(rows):
        e = r[3] if len(r) > 3 else f"e{i}"
        if e in seen:
            continue
        seen.add(e)
        top = r[1] if top is None else max(top, r[1])
        if r[1] < top - sig.allowed_lateness_seconds:
            continue
        now = []
        for actor, ids_, start in partials:
            if top - sig.allowed_lateness_seconds - start > sig.window_seconds:
                continue
            if actor == r[0]:
                if r[1] - start > sig.window_seconds:
                    continue
                if r[2] == steps[len(ids_)]:
                    ids_ = [*ids_, e]
                    if len(ids_) == len(steps):
                        out.append(tuple(ids_))
                        continue
            now.append((actor, ids_, start))
        if r[2] == steps[0]:
            now.append((r[0], [e], r[1]))
        partials = now
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_disorder(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(250):
        rows.append((f"u{rnd.randrange(4)}", max(0, i * 10 + rnd.randrange(-120, 1)), rnd.choice(["failure", "success", "unknown"]), f"x{i if rnd.random() > 0.1 else rnd.randrange(i + 1)}"))
    sig = signature(400, 60, ("failure", "success", "unknown"))
    assert ids(S.replay(frame(spark, rows), [sig])) == model(rows, sig)


def test_in_order_agrees(spark):
    rnd = random.Random(9)
    rows = [(f"u{rnd.randrange(5)}", i * 7, rnd.choice(["failure", "success", "unknown"])) for i in range(300)]
    sig = signature(500, 0, ("failure", "success", "unknown"))
    df = S.in_order(frame(spark, rows), [sig])
    assert ids(df) == model(rows, sig)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_same_ids_are_rejected():
    with pytest.raises(ValueError):
        S.enabled_of([signature(), signature()])
    assert S.load_sequences()[0].window_seconds == 900


@pytest.mark.parametrize("pieces", [1, 4])
def test_batches_equal_the_whole(spark, tmp_path, pieces):
    rnd = random.Random(5)
    rows = [(f"u{rnd.randrange(3)}", max(0, i * 10 + rnd.randrange(-90, 1)), rnd.choice(["failure", "success"])) for i in range(120)]
    sig = signature(300, 60)
    df = frame(spark, rows)
    runner, found = StampedRunner(spark, [sig], str(tmp_path / "state")), []
    for b in range(pieces):
        lo, hi = b * 120 // pieces, (b + 1) * 120 // pieces
        found += ids(runner(df.where(f"arrival_seq >= {lo} and arrival_seq < {hi}"), b))
    assert sorted(found) == model(rows, sig)


def test_batches_after_a_restart(spark, tmp_path):
    """A new runner for each batch, and batches run twice: the state is on disk."""
    rnd = random.Random(6)
    rows = [(f"u{rnd.randrange(3)}", max(0, i * 10 + rnd.randrange(-90, 1)), rnd.choice(["failure", "success"]), f"x{i if rnd.random() > 0.2 else rnd.randrange(i + 1)}") for i in range(90)]
    sig, df, found = signature(300, 60), frame(spark, rows), {}
    for b in (0, 1, 1, 2, 2):
        found[b] = StampedRunner(spark, [sig], str(tmp_path / "state"))(df.where(f"arrival_seq div 30 = {b}"), b)
    assert sorted(x for f in found.values() for x in ids(f)) == model(rows, sig)
    state = StampedRunner(spark, [sig], str(tmp_path / "state")).state()
    assert state["watermark"] == max(int((T0 + timedelta(seconds=r[1])).timestamp()) for r in rows) * 1_000_000
    counts = S.counters(df, [sig]).first()
    assert state["active_state_count"] >= counts["active"] >= 0 and counts["duplicates"] == 90 - len({r[3] for r in rows})


def test_counters_tell_how_states_end(spark):
    rows = [("a", 0, "failure"), ("a", 1, "failure"), ("b", 2, "failure"), ("a", 3, "success"), ("b", 1000, "unknown"), ("c", 1001, "failure")]
    r = S.counters(frame(spark, rows), [signature()]).first()
    assert (r["processed"], r["late"], r["duplicates"], r["completed"], r["evicted"], r["active"], r["peak"]) == (6, 0, 0, 2, 1, 1, 3)
    assert S.counters(frame(spark, rows), [signature()], 1).first()["completed"] == 1


def test_order_is_looked_at(spark):
    from tidewarden.plans.pipeline import build_pipeline

    rows = [("a", 0, "failure"), ("b", 2000, "unknown"), ("a", 30, "success")]
    assert S.is_ordered(frame(spark, rows[:2])) and not S.is_ordered(frame(spark, rows))
    assert not S.is_ordered(frame(spark, [("a", 0, "failure", "x"), ("a", 1, "failure", "x")]))
    assert build_pipeline(rules=[], signatures=[signature()])(frame(spark, rows)).isEmpty()
    assert build_pipeline(rules=[], signatures=[signature()])(frame(spark, [rows[0], ("a", 30, "success")])).count() == 1


def test_stream(spark, tmp_path):
    rows = [("a", 0, "failure"), ("b", 5, "failure"), ("a", 20, "success"), ("b", 400, "success")]
    src = tmp_path / "in"
    df = frame(spark, rows).withColumn("attributes", F.to_json("attributes"))
    df.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src)).withColumn("attributes", F.parse_json("attributes"))
    q = match_stream(stream, [signature()]).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert ids(spark.table("hits")) == [("e0", "e2")]
