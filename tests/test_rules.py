"""Rule compiler against a plain model, and incidents."""

import json
import re
from datetime import datetime, timezone

import pytest

from tidewarden import schemas
from tidewarden.operators import detection
from tidewarden.rules import Condition, Rule, compile_conditions, load_rules, rule_of

BAGS = [{}, {"x": None}, {"x": True}, {"x": 1}, {"x": 1.5}, {"x": 7}, {"x": "7"}, {"x": "abc"}, {"x": [1, "abc", None]}, {"x": {"abc": 1}}, {"x": []}]
MISSING = object()


def model(op, actual, value):
    if op == "exists":
        return (actual is not MISSING) == bool(value if value is not None else True)
    if actual is MISSING:
        return op == "neq"
    if op == "eq":
        return actual == value
    if op == "neq":
        return actual != value
    if op in ("in", "not_in"):
        if not isinstance(value, list):
            return False
        found = any(actual == v for v in value)
        return found if op == "in" else not found
    if op == "contains":
        if isinstance(actual, str):
            return isinstance(value, str) and value in actual
        if isinstance(actual, (list, dict)):
            return value in actual
        return False
    if op == "regex":
        return isinstance(actual, str) and isinstance(value, str) and re.search(value, actual) is not None
    try:
        return {"gt": actual > value, "gte": actual >= value, "lt": actual < value, "lte": actual <= value}[op]
    except TypeError:
        return False


CASES = [("eq", v) for v in (None, True, 1, 1.5, "7", "abc", [1, "abc", None], {"abc": 1})] + [("neq", v) for v in (None, 1, "abc")] + [("in", [1, "abc"]), ("in", [None]), ("in", "abc"), ("not_in", [1, "abc"]), ("not_in", "abc")]
CASES += [("contains", "b"), ("contains", "abc"), ("contains", 1), ("contains", None), ("regex", "^a(?P<n>b)c$"), ("regex", "b"), ("exists", None), ("exists", False), ("exists", 0)] + [(o, v) for o in ("gt", "gte", "lt", "lte") for v in (1, 1.5, "abc", None)]


def events(spark, bags):
    rows = [(i, str(i), datetime(2026, 1, 1, tzinfo=timezone.utc), 0, "user-1", "user", None, None, "login", "console", "failure", json.dumps(b), "low", "test", "1.0") for i, b in enumerate(bags)]
    names = [x.split()[0] for x in schemas.EVENTS.split(", ")]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schemas.EVENTS.replace("attributes variant", "attributes string")).withColumn("attributes", F.parse_json("attributes")).select(*names)


def test_operators_agree_with_the_model(spark):
    df = events(spark, BAGS)
    got = df.select(*[compile_conditions((Condition("attributes.x", op, v),))[0].alias(f"c{i}") for i, (op, v) in enumerate(CASES)]).collect()
    wrong = [(op, v, bag) for i, (op, v) in enumerate(CASES) for bag, row in zip(BAGS, got) if row[f"c{i}"] != model(op, bag.get("x", MISSING), v)]
    assert not wrong


def test_top_level_fields(spark):
    df = events(spark, [{}])
    with pytest.warns(UserWarning):
        tests = {
            "null": Condition("source_ip", "eq", None), "there": Condition("source_ip", "exists"), "text": Condition("action", "regex", "log"), "deeper": Condition("action.x", "exists"),
            "opaque": Condition("event_id", "eq", "0"), "opaque_neq": Condition("event_id", "neq", "0"), "derived": Condition("derived.is_failure", "exists"), "number": Condition("action", "gt", 3),
        }
        row = df.select(*[compile_conditions((c,))[0].alias(k) for k, c in tests.items()]).first().asDict()
    assert row == {"null": True, "there": True, "text": True, "deeper": False, "opaque": False, "opaque_neq": True, "derived": False, "number": False}


def test_bad_rules_are_rejected():
    good = {"rule_id": "a", "version": 1, "name": "", "description": "", "severity": "low", "conditions": [{"field": "action", "operator": "eq", "value": "x"}]}
    for change in ({"severity": "none"}, {"version": 0}, {"conditions": []}, {"extra": 1}, {"rule_id": "A B"}, {"conditions": [{"field": "action", "operator": "like"}]}, {"conditions": [{"field": "action", "operator": "regex", "value": "("}]}):
        with pytest.raises((ValueError, re.error)):
            rule_of({**good, **change})
    assert rule_of(good).enabled


def test_incidents_fold(spark):
    df = events(spark, [{}, {}])
    matches = detection.evaluate(df, load_rules())
    from pyspark.sql import functions as F

    again = matches.where("event_id = '1'").withColumn("arrival_seq", F.lit(9).cast("long"))
    row = detection.incidents(matches.unionByName(again)).first()
    assert (row["match_count"], row["event_ids"], len(row["evidence"]), row["severity"], row["rule_ids"]) == (2, ["0", "1"], 1, "medium", ["failed_login"])
    assert row["evidence"] == ['{"action":"login","result":"failure"}']


def test_first_seen_is_that_of_the_first_arrival(spark):
    late = datetime(2026, 1, 2)
    rows = [(0, 0, "r", 1, "e0", "a", "x", late, "low", "{}", "a:x"), (1, 0, "r", 1, "e1", "a", "x", datetime(2026, 1, 1), "critical", "{}", "a:x")]
    row = detection.incidents(spark.createDataFrame(rows, schemas.RULE_MATCHES)).first()
    assert row["first_seen"] == late and row["last_seen"] == late and row["severity"] == "critical"


def test_disabled_rules_and_plan(spark):
    rule = load_rules()[0]
    off = Rule(**{**rule.__dict__, "enabled": False})
    df = events(spark, [{}])
    assert detection.evaluate(df, [off]).isEmpty()
    plan = detection.evaluate(df, load_rules())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_known_incident_ids(spark):
    from pyspark.sql import functions as F

    from tidewarden.functions.ids import incident_id

    df = spark.createDataFrame([("user-42:billing-admin",), ("service-exporter:billing.transactions",)], "fp string")
    import uuid

    got = [r[0] for r in df.select(incident_id(F.col("fp"), "tidewarden:incident:")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"tidewarden:incident:{x}")) for x in ("user-42:billing-admin", "service-exporter:billing.transactions")]
