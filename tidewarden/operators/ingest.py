"""Raw JSON records to canonical, enriched events."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which a field may come, in order of preference: fixed values.
ALIASES = {
    "event_id": ["event_id", "id"],
    "timestamp": ["timestamp", "time", "ts"],
    "actor_id": ["actor_id", "user_id", "principal"],
    "actor_type": ["actor_type", "principal_type"],
    "source_ip": ["source_ip", "ip"],
    "device_id": ["device_id", "device"],
    "action": ["action", "event_action", "operation"],
    "resource": ["resource", "resource_id", "target"],
    "result": ["result", "status", "outcome"],
    "severity": ["severity"],
}
SUCCESS = ["success", "succeeded", "ok", "allowed", "200"]
FAILURE = ["failure", "failed", "error", "denied", "blocked", "401", "403"]
WHITE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, WHITE, "")


def first_present(raw: Column, names: list[str], default: str | None = None) -> Column:
    """The first value that is there, neither null nor an empty string, as text; 0, false and " " count."""
    found = [F.nullif(F.try_variant_get(raw, f"$['{n}']", "string"), F.lit("")) for n in names]
    return F.coalesce(*found, F.lit(default))


def contains_any(c: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def actor_type_of(raw: Column) -> Column:
    known = ["user", "service_account", "api_client", "device", "unknown"]
    name = F.replace(F.lower(strip(F.coalesce(raw, F.lit("unknown")))), F.lit("-"), F.lit("_"))
    name = F.when(name == "service", "service_account").when(name == "api", "api_client").otherwise(name)
    return F.when(name.isin(known), name).otherwise("unknown")


def result_of(raw: Column) -> Column:
    name = F.lower(strip(raw))
    return F.when(name.isin(SUCCESS), "success").when(name.isin(FAILURE), "failure").otherwise("unknown")


def severity_of(raw: Column, action: Column, result: Column) -> Column:
    given = F.lower(strip(raw))
    medium = (result == "failure") & contains_any(action, ["login", "auth", "permission"])
    high = contains_any(action, ["delete", "export", "secret", "role_change"])
    return F.when(given.isin("low", "medium", "high", "critical"), given).when(medium, "medium").when(high, "high").otherwise("low")


def offset_seconds(text: Column) -> Column:
    """Seconds east of UTC that an ISO-8601 text names; 0 without any."""
    sign = F.when(F.regexp_extract(text, r"([+-])\d{2}:?\d{2}$", 1) == "-", -1).otherwise(1)
    hours, minutes = F.regexp_extract(text, r"T?.*[+-](\d{2}):?\d{2}$", 1), F.regexp_extract(text, r"[+-]\d{2}:?(\d{2})$", 1)
    has = text.rlike(r"[T ]\d{2}.*[+-]\d{2}:?\d{2}$")
    return F.when(has, sign * (hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60)).otherwise(0)


def timestamp_of(text: Column) -> Column:
    """ISO-8601 in UTC unless it names an offset; null if malformed (numbers are)."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def derived_id(source: str):
    """UUID 5 of the record's canonical JSON text, for records without an id."""

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps({"source": source, "record": json.loads(x)}, sort_keys=True, default=str))))

    return run


def normalize(raw: DataFrame, source: str, derive_ids: bool = True) -> DataFrame:
    """(arrival_seq, raw JSON text) to canonical events.

    Unknown fields go to the attributes. Rows whose timestamp, actor or id can't be read come out with
    nulls there, for schemas.valid_events to set aside. Python runs only for rows without an id, and
    not at all with ``derive_ids`` off.
    """
    v = F.col("__v")
    known = sorted({n for names in ALIASES.values() for n in names})
    df = raw.withColumn("__v", F.try_parse_json("raw"))
    text = {k: first_present(v, names) for k, names in ALIASES.items()}
    df = df.withColumns({f"__{k}": c for k, c in text.items()})
    given = F.when(F.lower("__event_id").rlike("^[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}$"), F.lower("__event_id"))
    df = df.withColumn("__action", F.lower(strip(F.coalesce("__action", F.lit("unknown"))))).withColumn("__result", result_of(F.coalesce("__result", F.lit("unknown"))))
    bag = F.map_filter(F.from_json("raw", "map<string,variant>"), lambda k, _: ~k.isin(known))
    out = df.select(
        "arrival_seq", F.when(F.col("__event_id").isNotNull(), given).alias("event_id"), timestamp_of(F.col("__timestamp")).alias("timestamp"), offset_seconds(F.col("__timestamp")).cast("int").alias("ts_offset_seconds"),
        F.col("__actor_id").alias("actor_id"), actor_type_of(F.col("__actor_type")).alias("actor_type"), F.col("__source_ip").alias("source_ip"), F.col("__device_id").alias("device_id"), F.col("__action").alias("action"),
        F.coalesce("__resource", F.lit("unknown")).alias("resource"), F.col("__result").alias("result"), F.parse_json(F.coalesce(F.to_json(bag), F.lit("{}"))).alias("attributes"),
        severity_of(F.col("__severity"), F.col("__action"), F.col("__result")).alias("severity"), F.lit(source).alias("source"), F.lit("1.0").alias("schema_version"), "raw", F.col("__event_id").isNull().alias("__new"),
    )
    if derive_ids:
        out = out.withColumn("event_id", F.when(F.col("__new"), derived_id(source)(F.when(F.col("__new"), F.col("raw")).otherwise("{}"))).otherwise(F.col("event_id")))
    return out.drop("raw", "__new")


def derived(action: Column, result: Column) -> Column:
    return F.struct(
        contains_any(action, ["login", "logout", "auth"]).alias("is_authentication"), contains_any(action, ["role", "permission", "grant", "revoke"]).alias("is_privilege_change"),
        contains_any(action, ["export", "download", "read", "transfer"]).alias("is_data_movement"), (result == "failure").alias("is_failure"),
    )


def enrich(events: DataFrame) -> DataFrame:
    """attributes.derived set from action and result (an earlier one is replaced)."""
    bag = F.map_filter(F.from_json(F.to_json("attributes"), "map<string,variant>"), lambda k, _: k != "derived")
    added = F.map_from_arrays(F.array(F.lit("derived")), F.array(F.parse_json(F.to_json(derived(F.col("action"), F.col("result"))))))
    return events.withColumn("attributes", F.parse_json(F.to_json(F.map_concat(bag, added))))


def ingest(raw: DataFrame, source: str, publisher=None) -> DataFrame:
    """Normalise, enrich, and hand to the publisher if there is one."""
    out = enrich(normalize(raw, source))
    if publisher is not None:
        publisher.publish(out)
    return out
