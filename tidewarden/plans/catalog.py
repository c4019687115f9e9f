"""The engine's registered queries over the driver's tables, and DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..functions.tables import severity_rank
from ..operators import behavior, detection, graph, ingest, investigate, risk, sequences
from ..rules import Condition, Rule, compile_conditions, load_rules
from ..sources import readers, sinks
from . import pipeline

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The events table as canonical events.
EV = """WITH ev AS (
  SELECT *, CASE WHEN result = 'failure' AND action = 'login' THEN 'medium' WHEN action IN ('export', 'role_change') THEN 'high' ELSE 'low' END AS severity,
         actor_id || ':' || resource AS fingerprint
  FROM (SELECT event_id AS arrival_seq, CAST(event_id AS VARCHAR) AS event_id, ts, epoch_us(ts) AS us, 'user-' || user_id AS actor_id,
          CASE WHEN event_type IN ('error', 'signup') THEN 'login' WHEN event_type = 'purchase' THEN 'role_change' WHEN event_type = 'view' THEN 'read' ELSE 'export' END AS action,
          CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result,
          CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, 'resource-' || (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 10) AS resource,
          CAST(round(value * 100000) AS BIGINT) AS bytes, value FROM events))
"""
#: Default rules over them.
MATCHES = (
    EV
    + """, m AS (
  SELECT arrival_seq, event_id, actor_id, resource, fingerprint, us, 'failed_login' AS rule_id, 0 AS rule_index, 'medium' AS severity, '{"action":"login","result":"failure"}' AS evidence FROM ev WHERE action = 'login' AND result = 'failure'
  UNION ALL SELECT arrival_seq, event_id, actor_id, resource, fingerprint, us, 'privilege_change', 1, 'high', '{"action":"role_change"}' FROM ev WHERE action = 'role_change'
  UNION ALL SELECT arrival_seq, event_id, actor_id, resource, fingerprint, us, 'large_export', 2, 'high', '{"action":"export","attributes.bytes":' || bytes || '}' FROM ev WHERE action = 'export' AND bytes >= 10485760)
"""
)
RANK = "CASE {} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END"


def uuid_sql(name: str) -> str:
    s = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"substr({s}, 1, 8) || '-' || substr({s}, 9, 4) || '-5' || substr({s}, 14, 3) || '-' || substr('89ab', CAST((instr('0123456789abcdef', substr({s}, 17, 1)) - 1) % 4 AS INTEGER) + 1, 1) || substr({s}, 18, 3) || '-' || substr({s}, 21, 12)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def joined(c: str):
    return F.array_join(c, ",").alias(c)


INCIDENT_SQL = """SELECT {id} AS incident_id, fingerprint, min_by(us, arrival_seq * 10 + rule_index) AS first_seen, max(us) AS last_seen,
  CASE max({rank}) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids, string_agg(event_id, ',' ORDER BY arrival_seq) AS event_ids, min(actor_id) AS actor_ids, min(resource) AS resources, count(*) AS match_count
  FROM {source} GROUP BY fingerprint"""


def flat(found: DataFrame) -> DataFrame:
    return found.select("incident_id", "fingerprint", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"), "severity", joined("rule_ids"), joined("event_ids"), joined("actor_ids"), joined("resources"), "match_count")


def _incident_sql(source: str) -> str:
    return INCIDENT_SQL.format(id=uuid_sql("'tidewarden:incident:' || fingerprint"), rank=RANK.format("severity"), source=source)


@query("incidents", MATCHES + _incident_sql("m"))
def incidents(spark: SparkSession, d: str) -> DataFrame:
    return flat(detection.incidents(detection.evaluate(readers.table_events(spark, d), load_rules())))


@query("rules_default_matches", MATCHES + "SELECT rule_id, event_id, severity, fingerprint, evidence FROM m")
def rules_default_matches(spark: SparkSession, d: str) -> DataFrame:
    return detection.evaluate(readers.table_events(spark, d), load_rules()).select("rule_id", "event_id", "severity", "fingerprint", "evidence")


@query("dedup_replay", MATCHES + _incident_sql("m"))
def dedup_replay(spark: SparkSession, d: str) -> DataFrame:
    """Every match arrives twice; the incidents are the same."""
    m = detection.evaluate(readers.table_events(spark, d), load_rules())
    return flat(detection.incidents(m.unionByName(m.withColumn("arrival_seq", F.col("arrival_seq") + 10_000_000_000))))


@query("incident_severity", MATCHES + f", i AS ({_incident_sql('m')}) SELECT severity, count(*) AS incidents, sum(match_count) AS matches FROM i GROUP BY severity")
def incident_severity(spark: SparkSession, d: str) -> DataFrame:
    return incidents(spark, d).groupBy("severity").agg(F.count("*").alias("incidents"), F.sum("match_count").alias("matches"))


#: Operator -> (condition, SQL).
RULE_OPS = {
    "eq": (("attributes.k", "eq", 7), "k = 7"),
    "neq": (("resource", "neq", "resource-3"), "resource <> 'resource-3'"),
    "in": (("action", "in", ["read", "export"]), "action IN ('read', 'export')"),
    "not_in": (("attributes.k", "not_in", [1, 2, 3]), "k NOT IN (1, 2, 3)"),
    "contains": (("action", "contains", "change"), "contains(action, 'change')"),
    "regex": (("resource", "regex", "-[2-4]$"), "regexp_matches(resource, '-[2-4]$')"),
    "exists": (("attributes.bytes", "exists", True), "bytes IS NOT NULL"),
    "exists_not": (("attributes.nothing.here", "exists", False), "true"),
    "gt": (("attributes.bytes", "gt", 5_000_000), "bytes > 5000000"),
    "gte": (("attributes.request_rate", "gte", 100.5), "value >= 100.5"),
    "lt": (("attributes.k", "lt", 10), "k < 10"),
    "lte": (("action", "lte", "login"), "action <= 'login'"),
}


def _rule_query(op: str, condition: tuple, sql: str) -> None:
    @query(f"rule_op_{op}", EV + f"SELECT event_id, action, resource FROM ev WHERE {sql}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return readers.table_events(spark, d).where(compile_conditions((Condition(*condition),))[0]).select("event_id", "action", "resource")


for _op, (_condition, _sql) in RULE_OPS.items():
    _rule_query(_op, _condition, _sql)


@query("rule_mode_any", EV + "SELECT 'either' AS rule_id, event_id, severity, CASE WHEN action = 'read' AND k > 90 THEN '{\"action\":\"read\",\"attributes.k\":' || k || '}' WHEN action = 'read' THEN '{\"action\":\"read\"}' ELSE '{\"attributes.k\":' || k || '}' END AS evidence FROM (SELECT * REPLACE ('low' AS severity) FROM ev) WHERE action = 'read' OR k > 90")
def rule_mode_any(spark: SparkSession, d: str) -> DataFrame:
    rule = Rule("either", 1, "either", "", "low", (Condition("action", "eq", "read"), Condition("attributes.k", "gt", 90)), "any")
    return detection.evaluate(readers.table_events(spark, d), [rule]).select("rule_id", "event_id", "severity", "evidence")


@query(
    "normalize",
    EV + """SELECT arrival_seq, md5(event_id) AS event_id, us, actor_id, 'service_account' AS actor_type, action, resource, result,
    severity, 'raw' AS source, (action = 'login') AS is_authentication, (action = 'role_change') AS is_privilege_change, (action IN ('read', 'export')) AS is_data_movement, (result = 'failure') AS is_failure, bytes FROM ev""",
)
def normalize(spark: SparkSession, d: str) -> DataFrame:
    """Records under other names, with odd case and spaces, normalised and enriched."""
    e = readers.table_events(spark, d)
    status = F.when(F.col("result") == "failure", "DENIED").otherwise(" Ok ")
    raw = F.to_json(F.struct(F.md5("event_id").alias("id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.col("actor_id").alias("principal"), F.lit("Service-Account").alias("principal_type"), F.concat(F.lit("  "), F.upper("action")).alias("operation"), F.col("resource").alias("target"), status.alias("outcome"), F.try_variant_get("attributes", "$.bytes", "long").alias("bytes")))
    out = ingest.enrich(ingest.normalize(e.select("arrival_seq", raw.alias("raw")), "raw", derive_ids=False))
    flag = lambda n: F.try_variant_get("attributes", f"$.derived.{n}", "boolean").alias(n)
    return out.select("arrival_seq", "event_id", F.unix_micros("timestamp").alias("us"), "actor_id", "actor_type", "action", "resource", "result", "severity", "source", flag("is_authentication"), flag("is_privilege_change"), flag("is_data_movement"), flag("is_failure"), F.try_variant_get("attributes", "$.bytes", "long").alias("bytes"))


FEATURES = (
    EV
    + """, f AS (SELECT arrival_seq, event_id, actor_id AS entity_id, ts, unnest([
  {'feature': 'login_hour_sin', 'value': sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24)}, {'feature': 'login_hour_cos', 'value': cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24)},
  {'feature': 'day_of_week', 'value': CAST(isodow(ts) - 1 AS DOUBLE)}, {'feature': 'is_failure', 'value': CASE WHEN result = 'failure' THEN 1.0 ELSE 0.0 END}, {'feature': 'is_authentication', 'value': CASE WHEN action = 'login' THEN 1.0 ELSE 0.0 END},
  {'feature': 'permission_usage', 'value': CASE WHEN action = 'role_change' THEN 1.0 ELSE 0.0 END}, {'feature': 'request_rate', 'value': CAST(value AS DOUBLE)}, {'feature': 'response_size', 'value': 0.0},
  {'feature': 'bytes_transferred', 'value': CAST(bytes AS DOUBLE)}, {'feature': 'endpoint_frequency', 'value': 0.0}]) AS x FROM ev),
b AS (SELECT entity_id, x.feature AS feature, avg(x.value) AS mean, stddev_pop(x.value) AS deviation, count(*) AS n FROM f GROUP BY ALL),
z AS (SELECT f.arrival_seq, f.event_id, f.entity_id, f.x.feature AS feature, CASE WHEN b.deviation = 0 THEN 0.0 ELSE (f.x.value - b.mean) / b.deviation END AS z, b.n FROM f JOIN b ON f.entity_id = b.entity_id AND f.x.feature = b.feature)
"""
)


@query("features", FEATURES + "SELECT event_id, entity_id, x.feature AS feature, round(x.value, 6) + 0.0 AS value FROM f")
def features(spark: SparkSession, d: str) -> DataFrame:
    return behavior.extract_features(readers.table_events(spark, d)).select("event_id", "entity_id", F.explode("features").alias("feature", "v")).select("event_id", "entity_id", "feature", (F.round("v", 6) + 0.0).alias("value"))


@query("baselines", FEATURES + "SELECT entity_id, feature, round(mean, 4) AS mean, round(deviation, 4) AS deviation, n FROM b")
def baselines(spark: SparkSession, d: str) -> DataFrame:
    b = behavior.baselines(behavior.extract_features(readers.table_events(spark, d)), behavior.NAMES)
    return b.select("entity_id", F.col("observation_count").alias("n"), "standard_deviations", F.explode("means").alias("feature", "m")).select("entity_id", "feature", F.round("m", 4).alias("mean"), F.round(F.element_at("standard_deviations", F.col("feature")), 4).alias("deviation"), "n")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    v = behavior.extract_features(readers.table_events(spark, d))
    return behavior.score(v, behavior.baselines(v, behavior.NAMES))


@query("zscore", FEATURES + "SELECT event_id, entity_id, round(max(abs(z)), 5) AS score, max(abs(z)) >= 3 AND max(n) >= 2 AS is_anomalous, max(n) AS observations FROM z GROUP BY event_id, entity_id")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("event_id", "entity_id", F.round("score", 5).alias("score"), "is_anomalous", F.col("baseline_observation_count").alias("observations"))


@query("top_contributors", FEATURES + "SELECT event_id, round(sum(abs(z)), 4) AS top_three FROM (SELECT event_id, z, row_number() OVER (PARTITION BY event_id ORDER BY abs(z) DESC, feature) AS r FROM z) WHERE r <= 3 GROUP BY event_id")
def top_contributors(spark: SparkSession, d: str) -> DataFrame:
    """The three largest |z| of each event, as their sum: which of two equal ones is named hangs on rounding."""
    top = F.aggregate(F.slice("features", 1, 3), F.lit(0.0), lambda a, x: a + F.abs(x["z_score"]))
    return _scores(spark, d).select("event_id", F.round(top, 4).alias("top_three"))


@query("prequential", EV + "SELECT event_id, actor_id AS entity_id, count(*) OVER w AS n, round(CASE WHEN coalesce(stddev_pop(value) OVER w, 0) = 0 THEN 0.0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 4) AS z FROM ev WINDOW w AS (PARTITION BY actor_id ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def prequential(spark: SparkSession, d: str) -> DataFrame:
    return behavior.prequential(behavior.extract_features(readers.table_events(spark, d)), "request_rate").select("event_id", "entity_id", "n", F.round("z", 4).alias("z"))


@query("anomaly_matches", FEATURES + "SELECT s.event_id, ev.fingerprint, CASE WHEN s.score >= 10 THEN 'critical' ELSE 'high' END AS severity, 'behavioral_anomaly' AS rule_id FROM (SELECT event_id, max(abs(z)) AS score, max(n) AS n FROM z GROUP BY event_id) s JOIN ev USING (event_id) WHERE score >= 3 AND n >= 2")
def anomaly_matches(spark: SparkSession, d: str) -> DataFrame:
    return detection.anomaly_matches(readers.table_events(spark, d), _scores(spark, d)).select("event_id", "fingerprint", "severity", "rule_id")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").select(F.explode(F.array(F.struct(F.lit("toxic").alias("detector"), (F.col("toxic") == 1).alias("predicted")), F.struct(F.lit("even").alias("detector"), (F.col("doc_id") % 2 == 0).alias("predicted")))).alias("x"), (F.col("quality") == 0).alias("is_anomalous")).select("x.*", "is_anomalous")


EVAL = """WITH p AS (SELECT 'toxic' AS detector, 0 AS position, toxic = 1 AS predicted, quality = 0 AS actual FROM labels UNION ALL SELECT 'even', 1, doc_id % 2 = 0, quality = 0 FROM labels),
c AS (SELECT detector, position, count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (NOT predicted AND NOT actual) AS tn, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn FROM p GROUP BY ALL),
e AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision_, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall_ FROM c),
g AS (SELECT *, CASE WHEN precision_ + recall_ = 0 THEN 0.0 ELSE 2 * precision_ * recall_ / (precision_ + recall_) END AS f1 FROM e)
"""


@query("eval_confusion", EVAL + "SELECT detector, tp, tn, fp, fn, round(precision_, 6) AS precision_, round(recall_, 6) AS recall_, round(f1, 6) AS f1 FROM g")
def eval_confusion(spark: SparkSession, d: str) -> DataFrame:
    c = behavior.confusion(_labels(spark, d))
    return c.select("detector", F.col("true_positives").alias("tp"), F.col("true_negatives").alias("tn"), F.col("false_positives").alias("fp"), F.col("false_negatives").alias("fn"), F.round("precision", 6).alias("precision_"), F.round("recall", 6).alias("recall_"), F.round("f1", 6).alias("f1"))


@query("best_detector", EVAL + "SELECT detector, round(f1, 6) AS f1 FROM g ORDER BY g.f1 DESC, recall_ DESC, precision_ DESC, position LIMIT 1")
def best_detector(spark: SparkSession, d: str) -> DataFrame:
    c = behavior.confusion(_labels(spark, d)).withColumn("position", F.when(F.col("detector") == "toxic", 0).otherwise(1))
    return behavior.best_detector(c).select("detector", F.round("f1", 6).alias("f1"))


@query("isolation_forest")
def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    v = behavior.extract_features(readers.table_events(spark, d))
    return behavior.isolation_scores(v, v)


def _day(hours: int = 24) -> list:
    s = sequences.load_sequences()[0]
    return [sequences.Signature(s.signature_id, s.version, s.name, s.description, s.steps, hours * 3600, s.allowed_lateness_seconds, s.severity)]


CEP = (
    EV
    + """, s AS (SELECT *, action = 'login' AND result = 'failure' AS s0, action = 'login' AND result = 'success' AS s1, action = 'role_change' AS s2 FROM ev),
n2 AS (SELECT *, lead(CASE WHEN s2 THEN {'seq': arrival_seq, 'id': event_id, 'us': us, 'r': resource} END IGNORE NULLS) OVER (PARTITION BY actor_id ORDER BY arrival_seq) AS c2 FROM s),
n1 AS (SELECT *, lead(CASE WHEN s1 THEN {'id': event_id, 'r': resource, 'n': c2} END IGNORE NULLS) OVER (PARTITION BY actor_id ORDER BY arrival_seq) AS c1 FROM n2),
hit AS (SELECT actor_id, event_id || ',' || c1.id || ',' || c1.n.id AS event_ids, us AS started_at, c1.n.us AS completed_at, arrival_seq AS start_seq, c1.n.seq AS completed_seq, resource AS r0, c1.r AS r1, c1.n.r AS r2 FROM n1 WHERE s0 AND c1.n.seq IS NOT NULL AND c1.n.us - us <= 86400000000)
"""
)
_CEP_OUT = "SELECT 'credential_attack' AS signature_id, actor_id, event_ids, started_at, completed_at, 'critical' AS severity FROM hit"


def _cep_flat(m: DataFrame) -> DataFrame:
    return m.select("signature_id", "actor_id", joined("event_ids"), F.unix_micros("started_at").alias("started_at"), F.unix_micros("completed_at").alias("completed_at"), "severity")


@query("cep_24h", CEP + _CEP_OUT)
def cep_24h(spark: SparkSession, d: str) -> DataFrame:
    return _cep_flat(sequences.in_order(readers.table_events(spark, d), _day()))


@query("cep_replay", CEP + _CEP_OUT)
def cep_replay(spark: SparkSession, d: str) -> DataFrame:
    """The exact state machine; on ordered input it finds what look-ahead finds."""
    return _cep_flat(sequences.replay(readers.table_events(spark, d), _day()))


@query("cep_incidents", CEP + f"""SELECT {uuid_sql("'tidewarden:incident:sequence:credential_attack:' || actor_id")} AS incident_id, 'sequence:credential_attack:' || actor_id AS fingerprint, count(*) AS match_count, min_by(started_at, completed_seq * 100000000 + start_seq) AS first_seen, max(completed_at) AS last_seen, 'critical' AS severity FROM hit GROUP BY actor_id""")
def cep_incidents(spark: SparkSession, d: str) -> DataFrame:
    m = detection.sequence_signals(sequences.in_order(readers.table_events(spark, d), _day()))
    return detection.fold(m).select("incident_id", "fingerprint", "match_count", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"), "severity")


@query("pipeline_incidents", CEP + ", " + MATCHES[len(EV) + 2 :] + f""", j AS (SELECT fingerprint, count(*) AS match_count, max({RANK.format('severity')}) AS rank FROM (SELECT fingerprint, severity FROM m UNION ALL SELECT 'sequence:credential_attack:' || actor_id, 'critical' FROM hit) GROUP BY fingerprint) SELECT fingerprint, match_count, rank FROM j""")
def pipeline_incidents(spark: SparkSession, d: str) -> DataFrame:
    found = pipeline.build_pipeline(signatures=_day())(readers.table_events(spark, d))
    return found.select("fingerprint", "match_count", severity_rank(F.col("severity")).alias("rank"))


@query("sequence_counters", CEP + "SELECT (SELECT count(*) FROM ev) AS processed, 0 AS late, 0 AS duplicates, (SELECT count(*) FROM hit) AS completed")
def sequence_counters(spark: SparkSession, d: str) -> DataFrame:
    return sequences.counters(readers.table_events(spark, d), _day()).select("processed", "late", "duplicates", "completed")


RISK = (
    MATCHES
    + """, i AS (SELECT fingerprint, count(*) AS n, max(CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END) AS rank FROM m GROUP BY fingerprint),
r AS (SELECT fingerprint, round(least(100.0, 0.30 * (25.0 * (rank + 1)) + 0.25 * least(100.0, n * 7.0) + 0.20 * 100 * CASE WHEN n > 3 THEN 0.9 ELSE 0.1 END + 0.20 * 50.0 + 0.05 * least(100.0, n * 10.0)), 4) AS risk_score FROM i)
"""
)
_BAND = "CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium' ELSE 'low' END"


@query("risk", RISK + f"SELECT fingerprint, risk_score, {_BAND} AS band FROM r")
def risk_query(spark: SparkSession, d: str) -> DataFrame:
    i = incidents(spark, d)
    inputs = i.select("fingerprint", "severity", F.least(F.lit(100.0), F.col("match_count") * 7.0).alias("anomaly_score"), F.when(F.col("match_count") > 3, 0.9).otherwise(0.1).alias("sequence_confidence"), F.lit(50.0).alias("graph_risk_score"), F.col("match_count").alias("evidence_count"))
    return risk.score_risk(inputs).select("fingerprint", "risk_score", "band")


@query("risk_bands", RISK + f"SELECT {_BAND} AS band, count(*) AS incidents FROM r GROUP BY 1")
def risk_bands(spark: SparkSession, d: str) -> DataFrame:
    return risk_query(spark, d).groupBy("band").agg(F.count("*").alias("incidents"))


GNODES = EV + """, o AS (SELECT arrival_seq, 'user:' || actor_id AS node_id, 'user' AS node_type, 0 AS criticality FROM ev UNION ALL SELECT arrival_seq, 'service:' || resource, 'service', CASE WHEN severity = 'critical' THEN 100 ELSE 0 END FROM ev),
nodes AS (SELECT node_id, max_by(node_type, arrival_seq) AS node_type, max_by(criticality, arrival_seq) AS criticality FROM o GROUP BY node_id),
edges AS (SELECT 'event:' || event_id AS edge_id, CASE action WHEN 'role_change' THEN 'grants' ELSE 'reads' END AS edge_type, 'user:' || actor_id AS source_node_id, 'service:' || resource AS target_node_id, CASE WHEN result = 'success' THEN 1.0 ELSE 0.7 END AS confidence, us, arrival_seq FROM ev WHERE action <> 'login')
"""


@query("graph_nodes", GNODES + "SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.latest_nodes(graph.project_nodes(readers.table_events(spark, d))).select("node_id", "node_type", "criticality")


@query("graph_edges", GNODES + "SELECT edge_id, edge_type, source_node_id, target_node_id, CAST(confidence AS DOUBLE) AS confidence FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.latest_edges(graph.project_edges(readers.table_events(spark, d))).select("edge_id", "edge_type", "source_node_id", "target_node_id", "confidence")


@query("graph_snapshot_id", GNODES + f", t AS (SELECT 'tidewarden:graph:' || string_agg(node_id, ':' ORDER BY node_id) AS s FROM nodes) SELECT {uuid_sql('s')} AS snapshot_id FROM t")
def graph_snapshot_id(spark: SparkSession, d: str) -> DataFrame:
    return graph.snapshot_id(graph.latest_nodes(graph.project_nodes(readers.table_events(spark, d))))


@query("degree", GNODES + ", n AS (SELECT count(*) AS n FROM nodes) SELECT node_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS total_degree, round((coalesce(i, 0) + coalesce(o, 0)) / CAST(greatest(1, 2 * (n - 1)) AS DOUBLE), 6) AS normalized FROM nodes CROSS JOIN n LEFT JOIN (SELECT target_node_id AS node_id, count(*) AS i FROM edges GROUP BY 1) USING (node_id) LEFT JOIN (SELECT source_node_id AS node_id, count(*) AS o FROM edges GROUP BY 1) USING (node_id)")
def degree(spark: SparkSession, d: str) -> DataFrame:
    e = readers.table_events(spark, d)
    out = graph.degree(graph.latest_nodes(graph.project_nodes(e)), graph.latest_edges(graph.project_edges(e)))
    return out.select("node_id", "in_degree", "out_degree", "total_degree", F.round("normalized_degree", 6).alias("normalized"))


@query("graph_diff", GNODES + ", b AS (SELECT edge_id, CASE WHEN arrival_seq % 7 = 0 THEN 0.5 ELSE confidence END AS confidence, edge_type FROM edges WHERE arrival_seq % 10 <> 3), a AS (SELECT edge_id, confidence, edge_type FROM edges WHERE arrival_seq % 11 <> 5) SELECT edge_id, CASE WHEN b.edge_id IS NULL THEN 'added' WHEN a.edge_id IS NULL THEN 'removed' ELSE 'changed' END AS status, a.edge_id IS NOT NULL AND a.edge_type = 'grants' AS newly_exposed FROM b FULL OUTER JOIN a USING (edge_id) WHERE b.edge_id IS NULL OR a.edge_id IS NULL OR a.confidence <> b.confidence")
def graph_diff(spark: SparkSession, d: str) -> DataFrame:
    e = graph.project_edges(readers.table_events(spark, d))
    before = e.where("arrival_seq % 10 <> 3").withColumn("confidence", F.when(F.col("arrival_seq") % 7 == 0, 0.5).otherwise(F.col("confidence")))
    out = graph.diff_edges(graph.latest_edges(before), graph.latest_edges(e.where("arrival_seq % 11 <> 5")))
    return out.select("edge_id", "status", F.coalesce("newly_exposed", F.lit(False)).alias("newly_exposed"))


COMMERCE = """WITH RECURSIVE e AS (
  SELECT 'customer:' || c_custkey AS s, 'nation:' || c_nationkey AS t, 'has_role' AS edge_type, 1 / (0.5 + (c_custkey % 50) / 100.0) AS c FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'grants', 1 / 0.9 FROM nation
  UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || min(n_nationkey), 'can_reach', 1 / 0.6 FROM nation GROUP BY n_regionkey
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'reads', 1 / (0.4 + (s_suppkey % 60) / 100.0) FROM supplier),
p AS (SELECT 'customer:1' AS node_id, 0 AS hops, CAST(0 AS DOUBLE) AS cost, 0 AS privilege UNION ALL SELECT e.t, p.hops + 1, p.cost + CAST(e.c AS DOUBLE), p.privilege + CASE WHEN e.edge_type IN ('has_role', 'grants', 'owns') THEN 1 ELSE 0 END FROM p JOIN e ON e.s = p.node_id WHERE p.hops < 6)
"""


@query("bfs", COMMERCE + "SELECT node_id, min(hops) AS depth FROM p GROUP BY node_id")
def bfs(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = readers.commerce_graph(spark, d)
    return graph.reachability(nodes, edges, "customer:1").select("node_id", "depth")


@query("dfs")
def dfs(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = readers.commerce_graph(spark, d)
    return graph.reachability(nodes, edges, "customer:1", "dfs")


@query("path_costs", COMMERCE + "SELECT node_id, round(min(cost), 6) AS total_cost FROM p GROUP BY node_id")
def path_costs(spark: SparkSession, d: str) -> DataFrame:
    return graph.distances(readers.commerce_graph(spark, d)[1], "customer:1").select("node_id", F.round("total_cost", 6).alias("total_cost"))


@query("shortest_path", COMMERCE + ", t AS (SELECT node_id, min(cost) AS cost, min_by(hops, cost) AS hops FROM p WHERE node_id LIKE 'supplier:%' GROUP BY node_id) SELECT node_id AS target, round(cost, 6) AS total_cost, hops FROM t ORDER BY node_id LIMIT 1")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = readers.commerce_graph(spark, d)
    target = graph.reachability(nodes, edges, "customer:1").where("node_id like 'supplier:%'").agg(F.min("node_id")).first()[0]
    path = graph.shortest_path(nodes, edges, "customer:1", target)
    return spark.createDataFrame([(target, round(path["total_cost"], 6), len(path["edge_ids"]))], "target string, total_cost double, hops int")


@query("attack_path", COMMERCE + ", t AS (SELECT node_id, min(cost) AS cost, min_by(privilege, cost) AS privilege FROM p WHERE node_id LIKE 'supplier:%' GROUP BY node_id) SELECT node_id AS target, round(least(100.0, 0.70 * (CAST(substr(node_id, 10) AS BIGINT) % 101) + least(30.0, 10.0 * privilege) + least(20.0, greatest(0.0, 20.0 - 2.0 * cost))), 5) AS risk_score FROM t ORDER BY node_id LIMIT 1")
def attack_path(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = readers.commerce_graph(spark, d)
    target = graph.reachability(nodes, edges, "customer:1").where("node_id like 'supplier:%'").agg(F.min("node_id")).first()[0]
    found = graph.assess_attack_path(nodes, edges, "customer:1", target)
    return spark.createDataFrame([(target, round(found["risk_score"], 5))], "target string, risk_score double")


@query("scc", """WITH low AS (SELECT n_regionkey, min(n_nationkey) AS low FROM nation GROUP BY 1), loops AS (SELECT 'nation:' || low AS a, 'region:' || n_regionkey AS b FROM low)
SELECT node_id, CASE WHEN a IS NOT NULL THEN a ELSE node_id END AS component FROM (SELECT 'customer:' || c_custkey AS node_id FROM customer UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier) LEFT JOIN loops ON node_id = a OR node_id = b""")
def scc(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(*readers.commerce_graph(spark, d))


@query("privilege_loops", """WITH low AS (SELECT n_regionkey, min(n_nationkey) AS low FROM nation GROUP BY 1) SELECT 'nation:' || low AS component, 'nation:' || low || ',' || 'region:' || n_regionkey AS node_ids, 'n' || low || ',' || 'r' || n_regionkey AS edge_ids FROM low""")
def privilege_loops(spark: SparkSession, d: str) -> DataFrame:
    out = graph.component_report(*readers.commerce_graph(spark, d)).where("is_privilege_loop")
    return out.select("component", joined("node_ids"), F.array_join("internal_edge_ids", ",").alias("edge_ids"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    e = readers.table_events(spark, d)
    kind = F.when(F.col("action") == "login", "event").when(F.col("action") == "role_change", "sequence_match").when(F.col("action") == "read", "graph_path").otherwise("baseline")
    return e.select(F.col("actor_id").alias("request_id"), kind.alias("reference_type"), F.col("event_id").alias("reference_id"), F.lit("events").alias("source"))


EVIDENCE = EV + ", v AS (SELECT actor_id AS request_id, CASE action WHEN 'login' THEN 'event' WHEN 'role_change' THEN 'sequence_match' WHEN 'read' THEN 'graph_path' ELSE 'baseline' END AS t, event_id AS reference_id FROM ev)"


@query("evidence_summary", EVIDENCE + ", c AS (SELECT request_id, t, count(*) AS n FROM v GROUP BY ALL) SELECT request_id, CAST(sum(n) AS BIGINT) AS total, string_agg(n || ' ' || replace(t, '_', ' '), ', ' ORDER BY t) AS text FROM c GROUP BY request_id")
def evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    return investigate.evidence_counts(_evidence(spark, d))


@query("runbooks", EVIDENCE + ", b(runbook_id, title, t) AS (VALUES ('behavioral-anomaly-triage', 'Behavioral anomaly triage', 'baseline'), ('credential-compromise-response', 'Credential compromise response', 'event'), ('credential-compromise-response', 'Credential compromise response', 'sequence_match'), ('graph-relationship-investigation', 'Graph relationship investigation', 'graph_path'), ('graph-relationship-investigation', 'Graph relationship investigation', 'incident')) SELECT request_id, runbook_id, title, 'Evidence includes: ' || string_agg(DISTINCT replace(t, '_', ' '), ', ' ORDER BY replace(t, '_', ' ')) || '.' AS reason FROM v JOIN b USING (t) GROUP BY ALL")
def runbooks(spark: SparkSession, d: str) -> DataFrame:
    return investigate.recommend(_evidence(spark, d))


@query("investigations", EVIDENCE + ", c AS (SELECT request_id, t, count(*) AS n FROM v GROUP BY ALL) SELECT request_id, 'Investigation prepared for incident inc-' || request_id || ' using ' || CAST(sum(n) AS BIGINT) || ' evidence reference(s): ' || string_agg(n || ' ' || replace(t, '_', ' '), ', ' ORDER BY t) || '. No hypothesis was generated by the deterministic workflow.' AS summary, CAST(sum(n) AS BIGINT) AS cited FROM c GROUP BY request_id")
def investigations(spark: SparkSession, d: str) -> DataFrame:
    v = _evidence(spark, d)
    requests = v.select("request_id").distinct().withColumn("incident_id", F.concat(F.lit("inc-"), "request_id"))
    return investigate.investigate(requests, v).select("request_id", "summary", F.size("cited_evidence").cast("long").alias("cited"))


@query("citation_check", EVIDENCE + " SELECT request_id, 'not cited' AS problem, string_agg(reference_id, ',' ORDER BY reference_id) AS missing FROM v WHERE t = 'baseline' GROUP BY request_id")
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses cite every reference; the response lists all but those to baselines."""
    v = _evidence(spark, d)
    return investigate.citation_problems(v, v.where("reference_type <> 'baseline'"), v).select("request_id", "problem", joined("missing"))


@query("kafka_records", EV + "SELECT event_id AS key, action, result FROM ev")
def kafka_records(spark: SparkSession, d: str) -> DataFrame:
    return sinks.kafka_records(readers.table_events(spark, d)).select("key", F.get_json_object("value", "$.action").alias("action"), F.get_json_object("value", "$.result").alias("result"))


@query("uuid5", EV + f"SELECT event_id, {uuid_sql('event_id')} AS id FROM ev")
def uuid5_query(spark: SparkSession, d: str) -> DataFrame:
    return readers.table_events(spark, d).select("event_id", uuid5(F.col("event_id")).alias("id"))


def queries() -> dict:
    from . import surface  # noqa: F401  registers its queries; it uses this module's

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import surface  # noqa: F401

    return dict(SQL)
