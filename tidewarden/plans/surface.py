"""Further registered queries: sources, sinks, contracts, disordered input, streams, stores, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.tables import severity_rank, shared_dir
from ..operators import behavior, detection, graph, ingest, risk, sequences
from ..rules import Condition, Rule, load_rules
from ..sources import readers, sinks
from ..streaming.sequences import StampedRunner, incident_stream
from . import pipeline
from .catalog import CEP, EV, FEATURES, GNODES, MATCHES, RANK, _cep_flat, _CEP_OUT, _day, _incident_sql, flat, incidents, joined, query, uuid_sql


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewarden/{name}-{uuid.uuid4().hex}"


# sources


def _lines(spark: SparkSession, d: str) -> readers.JsonLines:
    """The events as JSON lines in a folder, with a broken line for each export and blank lines between."""
    e = readers.table_events(spark, d)
    good = F.to_json(F.struct(F.md5("event_id").alias("id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.col("actor_id").alias("principal"), F.col("action").alias("operation"), "result", "resource"))
    line = F.when(F.col("action") == "export", F.concat(F.lit("not json "), "event_id")).otherwise(good)
    path = _folder(spark, "lines")
    e.select(F.explode(F.array(line, F.lit("  "))).alias("value")).write.text(path)
    return readers.JsonLines(path, strict=False)


@query("json_lines", EV + "SELECT md5(event_id) AS event_id, us, actor_id, action, result, resource FROM ev WHERE action <> 'export'")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.normalize(_lines(spark, d).collect(spark), "lines", derive_ids=False)
    return out.select("event_id", F.unix_micros("timestamp").alias("us"), "actor_id", "action", "result", "resource")


@query("json_quarantine", EV + "SELECT 'not json ' || event_id AS raw FROM ev WHERE action = 'export'")
def json_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).quarantine(spark).select("raw")


@query("line_numbers", EV + "SELECT count(*) AS rows, count(*) AS numbers, 1 AS least, 2 * count(*) - 1 AS most FROM ev")
def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Every line has a number of its own, blank ones included."""
    e = readers.table_events(spark, d)
    path = _folder(spark, "lines")
    e.select(F.explode(F.array(F.lit('{"a": 1}'), F.lit(" "))).alias("value")).write.text(path)
    n = F.col("arrival_seq")
    return readers.JsonLines(path).collect(spark).agg(F.count("*").alias("rows"), F.countDistinct(n).alias("numbers"), F.min(n).alias("least"), F.max(n).alias("most"))


@query("labeled_fixture", "SELECT 'd' || doc_id AS event_id, 'entity-' || doc_id % 7 AS entity_id, 'unknown' AS entity_type, CAST(quality AS DOUBLE) AS quality, toxic = 1 AS is_anomalous FROM labels")
def labeled_fixture(spark: SparkSession, d: str) -> DataFrame:
    """Flat and nested records of one file."""
    t = spark.read.parquet(f"{d}/labels.parquet")
    vector = F.struct(F.concat(F.lit("d"), "doc_id").alias("event_id"), F.concat(F.lit("entity-"), (F.col("doc_id") % 7).cast("string")).alias("entity_id"), F.struct(F.col("quality").cast("double").alias("quality")).alias("features"))
    toxic = (F.col("toxic") == 1).alias("is_anomalous")
    nested, plain = F.to_json(F.struct(vector.alias("vector"), toxic)), F.to_json(F.struct(*(vector[c].alias(c) for c in ("event_id", "entity_id", "features")), toxic))
    path = _folder(spark, "fixture")
    t.select(F.when(F.col("quality") == 1, nested).otherwise(plain).alias("value")).write.text(path)
    return readers.labeled_fixture(spark, path).select("event_id", "entity_id", "entity_type", F.col("features")["quality"].alias("quality"), "is_anomalous")


@query("evidence_file", "SELECT 'r' AS request_id, 'event' AS reference_type, 'n' || n_nationkey AS reference_id, n_name AS source FROM nation")
def evidence_file(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    ref = F.struct(F.lit("event").alias("reference_type"), F.concat(F.lit("n"), "n_nationkey").alias("reference_id"), F.col("n_name").alias("source"))
    path = _folder(spark, "evidence")
    n.agg(F.to_json(F.collect_list(ref)).alias("value")).coalesce(1).write.text(path)  # one small table
    return readers.evidence(spark, path, "r")


# ingestion and contracts


@query("derived_ids", EV + "SELECT arrival_seq, " + uuid_sql("""'{"record": {"action": "' || action || '", "timestamp": "' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '", "user_id": "' || actor_id || '"}, "source": "raw"}'""") + " AS event_id FROM ev")
def derived_ids(spark: SparkSession, d: str) -> DataFrame:
    e = readers.table_events(spark, d)
    raw = F.to_json(F.struct("action", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("actor_id").alias("user_id")))
    return ingest.normalize(e.select("arrival_seq", raw.alias("raw")), "raw").select("arrival_seq", "event_id")


@query("published", EV + "SELECT md5(event_id) AS event_id, (action = 'login') AS is_authentication FROM ev")
def published(spark: SparkSession, d: str) -> DataFrame:
    """Two ingestions handed to one publisher."""
    e = readers.table_events(spark, d)
    record = F.to_json(F.struct(F.md5("event_id").alias("id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.col("actor_id").alias("principal"), "action"))
    to = sinks.ViewPublisher(f"published_{uuid.uuid4().hex}")
    for part in ("action = 'login'", "action <> 'login'"):
        ingest.ingest(e.where(part).select("arrival_seq", record.alias("raw")), "raw", to)
    return spark.table(to.name).select("event_id", F.try_variant_get("attributes", "$.derived.is_authentication", "boolean").alias("is_authentication"))


@query("contract_problems", EV + "SELECT event_id, concat_ws(',', CASE WHEN resource = 'resource-3' THEN 'resource' END, CASE WHEN action = 'read' THEN 'severity' END) AS problems FROM ev WHERE resource = 'resource-3' OR action = 'read'")
def contract_problems(spark: SparkSession, d: str) -> DataFrame:
    e = readers.table_events(spark, d)
    broken = e.withColumns({"resource": F.when(F.col("resource") == "resource-3", "").otherwise(F.col("resource")), "severity": F.when(F.col("action") == "read", "worst").otherwise(F.col("severity"))})
    return schemas.valid_events(broken, uuids=False)[1].select("event_id", joined("problems"))


@query("graph_contracts", "SELECT 'node' AS kind, CAST(count(*) AS BIGINT) AS bad FROM supplier WHERE s_suppkey % 101 >= 90 UNION ALL SELECT 'edge', count(*) FROM supplier WHERE s_suppkey % 60 >= 50")
def graph_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Criticality beyond 100, and confidence beyond 1."""
    nodes, edges = readers.commerce_graph(spark, d)
    bad_nodes = schemas.valid_nodes(nodes.withColumn("criticality", F.col("criticality") + 11))[1]
    bad_edges = schemas.valid_edges(edges.where("edge_type = 'reads'").withColumn("confidence", F.col("confidence") + 0.105))[1]
    count = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count("*").alias("bad"))
    return count(bad_nodes, "node").unionByName(count(bad_edges, "edge"))


# rules and incidents


@query("rule_disabled", EV + "SELECT 'on' AS rule_id, event_id FROM ev WHERE action = 'read'")
def rule_disabled(spark: SparkSession, d: str) -> DataFrame:
    rule = lambda name, value, on: Rule(name, 1, name, "", "low", (Condition("action", "eq", value),), "all", enabled=on)
    return detection.evaluate(readers.table_events(spark, d), [rule("on", "read", True), rule("off", "login", False)]).select("rule_id", "event_id")


#: Matches that arrive once more, before all others and in the opposite order.
_TWICE = MATCHES + ", t AS (SELECT * REPLACE (-arrival_seq AS arrival_seq) FROM m)"


@query("incidents_reversed", _TWICE + _incident_sql("t"))
def incidents_reversed(spark: SparkSession, d: str) -> DataFrame:
    m = detection.evaluate(readers.table_events(spark, d), load_rules())
    return flat(detection.incidents(m.unionByName(m.withColumn("arrival_seq", -F.col("arrival_seq")))))


@query("incident_facts", MATCHES + f"SELECT fingerprint, min_by(us, arrival_seq * 10 + rule_index) AS first_seen, max(us) AS last_seen, max({RANK.format('severity')}) AS rank, count(*) AS match_count FROM m GROUP BY fingerprint")
def incident_facts(spark: SparkSession, d: str) -> DataFrame:
    m = detection.evaluate(readers.table_events(spark, d), load_rules())
    return detection.facts(detection.rule_signals(detection.first_of(m))).select("fingerprint", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"), severity_rank(F.col("severity")).alias("rank"), "match_count")


@query("incident_links", MATCHES + f"SELECT {uuid_sql(chr(39) + 'tidewarden:incident:' + chr(39) + ' || fingerprint')} AS incident_id, event_id, min(arrival_seq) AS arrival_seq FROM m GROUP BY fingerprint, event_id")
def incident_links(spark: SparkSession, d: str) -> DataFrame:
    m = detection.evaluate(readers.table_events(spark, d), load_rules())
    return detection.links(detection.rule_signals(detection.first_of(m)))


@query("apply_risk", MATCHES + ", i AS (SELECT fingerprint, count(*) AS n FROM m GROUP BY fingerprint) SELECT fingerprint, CASE WHEN n > 1 THEN CAST(n % 100 AS DOUBLE) END AS risk_score, CASE WHEN n <= 1 THEN NULL WHEN n % 100 >= 80 THEN 'critical' WHEN n % 100 >= 60 THEN 'high' WHEN n % 100 >= 30 THEN 'medium' ELSE 'low' END AS risk_band FROM i")
def apply_risk(spark: SparkSession, d: str) -> DataFrame:
    """Two audits of each incident of more than one match: the later one holds."""
    found = incidents(spark, d)
    score = (F.col("match_count") % 100).cast("double")
    last = found.where("match_count > 1").select("incident_id", score.alias("risk_score"), F.lit(2).alias("recorded_seq"))
    audits = last.unionByName(last.select("incident_id", F.lit(1.0).alias("risk_score"), F.lit(1).alias("recorded_seq")))
    audits = audits.select("*", risk.band(F.col("risk_score")).alias("band"), F.lit(None).cast("string").alias("components"), F.lit(None).cast("timestamp").alias("recorded_at"))
    return detection.apply_risk(found, audits).select("fingerprint", "risk_score", "risk_band")


@query("scored_pipeline", CEP + ", " + MATCHES[len(EV) + 2 :] + ", " + FEATURES[len(EV) + 2 :] + f""", a AS (SELECT event_id FROM z GROUP BY event_id HAVING max(abs(z)) >= 3 AND max(n) >= 2),
j AS (SELECT fingerprint, {RANK.format('severity')} AS r FROM m UNION ALL SELECT 'sequence:credential_attack:' || actor_id, 3 FROM hit UNION ALL SELECT ev.fingerprint, CASE WHEN s.top >= 10 THEN 3 ELSE 2 END FROM ev JOIN (SELECT event_id, max(abs(z)) AS top FROM z GROUP BY event_id) s USING (event_id) JOIN a USING (event_id))
SELECT fingerprint, count(*) AS match_count, max(r) AS rank FROM j GROUP BY fingerprint""")
def scored_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Rules, anomalies by a scorer that is handed in, and sequences: steps in the order of arrival, none late."""
    found = pipeline.build_pipeline(signatures=_day(), anomaly_scorer=pipeline.z_scorer(), ordered=True)(readers.table_events(spark, d))
    return found.select("fingerprint", "match_count", severity_rank(F.col("severity")).alias("rank"))


# the store and streams


@query("store", MATCHES + "SELECT fingerprint, CASE WHEN max(" + RANK.format("severity") + ") = 2 THEN 'closed' ELSE 'open' END AS status FROM m GROUP BY fingerprint")
def store(spark: SparkSession, d: str) -> DataFrame:
    """All incidents, then those of high severity again, closed."""
    found = detection.incidents(detection.evaluate(readers.table_events(spark, d), load_rules()))
    held = sinks.IncidentStore(spark, _folder(spark, "store"))
    held.upsert(found)
    held.upsert(found.where("severity = 'high'").withColumn("status", F.lit("closed")))
    return held.all().select("fingerprint", "status")


@query("store_lookup", MATCHES + "SELECT fingerprint, count(*) AS match_count FROM m WHERE fingerprint = (SELECT min(fingerprint) FROM m) GROUP BY fingerprint")
def store_lookup(spark: SparkSession, d: str) -> DataFrame:
    held = sinks.IncidentStore(spark, _folder(spark, "store"))
    held.upsert(detection.incidents(detection.evaluate(readers.table_events(spark, d), load_rules())))
    return held.get(held.all().first()["fingerprint"]).select("fingerprint", "match_count")


@query("stream_incidents", MATCHES + _incident_sql("m"))
def stream_incidents(spark: SparkSession, d: str) -> DataFrame:
    """Rule matches as a stream of several files, each there twice, folded into a store."""
    m = detection.evaluate(readers.table_events(spark, d), load_rules())
    at = _folder(spark, "stream")
    m.unionByName(m.withColumn("arrival_seq", F.col("arrival_seq") + 10_000_000_000)).repartition(3, "event_id").write.parquet(f"{at}/in")
    held = sinks.IncidentStore(spark, f"{at}/store")
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    incident_stream(stream, held, f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return flat(held.all())


@query("stream_sequences", CEP + _CEP_OUT)
def stream_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The exact machine over three batches, each by a runner of its own, as after a restart; the last one twice."""
    e = readers.table_events(spark, d)
    bounds = e.agg(F.min("arrival_seq").alias("a"), F.max("arrival_seq").alias("b")).first()
    at, found = _folder(spark, "sequences"), {}
    third = (bounds["b"] - bounds["a"]) // 3 + 1
    for k in (0, 1, 2, 2):
        part = e.where(F.floor((F.col("arrival_seq") - bounds["a"]) / third) == k)
        found[k] = StampedRunner(spark, _day(), at, remember=2)(part, k)
        found[k].count()
    return _cep_flat(found[0].unionByName(found[1]).unionByName(found[2]))


# disordered input: arrivals shuffled within 97, and every login's event once more at the end

_STEPS = """, arrived AS (SELECT * REPLACE ((arrival_seq + arrival_seq * 7919 % 97) * 1000000 + arrival_seq AS arrival_seq) FROM ev),
every AS (SELECT * FROM arrived UNION ALL SELECT * REPLACE (arrival_seq + 1000000000000000 AS arrival_seq) FROM arrived WHERE action = 'login'),
u AS (SELECT *, max(us) OVER (ORDER BY arrival_seq) AS clock FROM every QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_seq) = 1),
own AS (SELECT * FROM u WHERE us >= clock - {late}),
a AS (SELECT actor_id, event_id, arrival_seq AS seq, us FROM own WHERE action = 'login' AND result = 'failure'),
b AS (SELECT actor_id, event_id, arrival_seq AS seq, us FROM own WHERE action = 'login' AND result = 'success'),
nextb AS (SELECT a.seq, min(b.seq) AS b_seq FROM a JOIN b ON a.actor_id = b.actor_id AND b.seq > a.seq GROUP BY a.seq),
kill AS (SELECT a.seq, min(o.arrival_seq) AS k_seq FROM a JOIN own o ON o.actor_id = a.actor_id AND o.arrival_seq > a.seq AND o.us - a.us > {window} GROUP BY a.seq),
tick AS (SELECT clock, min(arrival_seq) AS seq FROM u GROUP BY clock),
gone AS (SELECT a.seq, min(t.seq) AS c_seq FROM a ASOF JOIN tick t ON t.clock > a.us + {window} + {late} GROUP BY a.seq),
life AS (SELECT a.*, b_seq, least(coalesce(b_seq, 9e18), coalesce(k_seq, 9e18), coalesce(c_seq, 9e18)) AS e, coalesce(k_seq, 9e18) AS k, coalesce(c_seq, 9e18) AS c FROM a LEFT JOIN nextb USING (seq) LEFT JOIN kill USING (seq) LEFT JOIN gone USING (seq)),
done AS (SELECT *, CASE WHEN e = 9e18 THEN 'active' WHEN c <= e THEN 'evicted' WHEN k <= e THEN 'expired' ELSE 'completed' END AS reason FROM life)
""".replace("{late}", "3600000000").replace("{window}", "86400000000")


def _disordered(spark: SparkSession, d: str) -> DataFrame:
    e = readers.table_events(spark, d)
    n = F.col("arrival_seq")
    e = e.withColumn("arrival_seq", (n + n * 7919 % 97) * 1_000_000 + n)
    return e.unionByName(e.where("action = 'login'").withColumn("arrival_seq", n + 1_000_000_000_000_000))


def _pair() -> list:
    is_ = lambda f, v: Condition(f, "eq", v)
    steps = tuple(sequences.Step(r, (is_("action", "login"), is_("result", r))) for r in ("failure", "success"))
    return [sequences.Signature("pair", 1, "pair", "", steps, 86_400, 3_600, "high")]


@query("cep_disordered", EV + _STEPS + "SELECT 'pair' AS signature_id, done.actor_id, done.event_id || ',' || b.event_id AS event_ids, done.us AS started_at, b.us AS completed_at, 'high' AS severity FROM done JOIN b ON b.seq = done.b_seq WHERE reason = 'completed'")
def cep_disordered(spark: SparkSession, d: str) -> DataFrame:
    """The exact machine on late and repeated events, with lateness allowed."""
    return _cep_flat(sequences.replay(_disordered(spark, d), _pair()))


@query("sequence_metrics", EV + _STEPS + """, steps AS (SELECT seq, 1 AS d FROM done UNION ALL SELECT CAST(e AS BIGINT), -1 FROM done WHERE reason <> 'active'),
net AS (SELECT seq, sum(d) AS d FROM steps GROUP BY seq), run AS (SELECT sum(d) OVER (ORDER BY seq) AS r FROM net)
SELECT (SELECT count(*) FROM u) AS processed, (SELECT count(*) FROM u WHERE us < clock - 3600000000) AS late, (SELECT max(us) FROM u) AS watermark, (SELECT count(*) FROM every) - (SELECT count(*) FROM u) AS duplicates,
 (SELECT count(*) FROM done WHERE reason = 'completed') AS completed, (SELECT count(*) FROM done WHERE reason = 'evicted') AS evicted, (SELECT count(*) FROM done WHERE reason = 'active') AS active, (SELECT CAST(max(r) AS BIGINT) FROM run) AS peak""")
def sequence_metrics(spark: SparkSession, d: str) -> DataFrame:
    return sequences.counters(_disordered(spark, d), _pair())


@query("cep_evidence", CEP + "SELECT actor_id, event_ids, r0 || ',' || r1 || ',' || r2 AS resources, 'failure,success,success' AS results, 'login,login,role_change' AS actions, 3 AS steps FROM hit")
def cep_evidence(spark: SparkSession, d: str) -> DataFrame:
    m = sequences.in_order(readers.table_events(spark, d), _day())
    part = lambda c, n: F.array_join(F.transform("evidence", lambda x: x[c]), ",").alias(n)
    return m.select("actor_id", part("event_id", "event_ids"), part("resource", "resources"), part("result", "results"), part("action", "actions"), F.size(F.array_distinct(F.transform("evidence", lambda x: x["step_id"]))).alias("steps"))


# behaviour and metrics


@query("baseline_update", EV + "SELECT actor_id AS entity_id, count(*) AS n, count(*) FILTER (action <> 'read') AS new FROM ev GROUP BY actor_id")
def baseline_update(spark: SparkSession, d: str) -> DataFrame:
    """Reads observed first, then everything: what was seen isn't counted again."""
    v = behavior.extract_features(readers.table_events(spark, d))
    seen = v.where(F.col("features")["bytes_transferred"].isNotNull()).join(readers.table_events(spark, d).where("action = 'read'").select("event_id"), "event_id", "left_semi")
    now, new = behavior.update_baselines(seen, v.unionByName(v))
    fresh = new.groupBy("entity_id").agg(F.count("*").alias("new"))
    return behavior.baselines(now).select("entity_id", F.col("observation_count").alias("n")).join(fresh, "entity_id", "left").select("entity_id", "n", F.coalesce("new", F.lit(0)).alias("new"))


@query("top_contributor", FEATURES + "SELECT event_id, feature AS top FROM (SELECT event_id, feature, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(z), 9) DESC, feature) AS r FROM z WHERE feature <> 'bytes_transferred') WHERE r = 1")
def top_contributor(spark: SparkSession, d: str) -> DataFrame:
    """The feature with the largest |z| of each event, by name; without bytes, which the table derives from the rate."""
    v = behavior.extract_features(readers.table_events(spark, d)).withColumn("features", F.map_filter("features", lambda k, _: k != "bytes_transferred"))
    size = lambda x: F.round(F.abs(x["z_score"]), 9)  # noqa: E731  what is equal to nine digits is a tie, which the name decides
    first = F.array_min(F.transform("features", lambda x: F.struct((-size(x)).alias("o"), x["feature_name"].alias("n"))))
    return behavior.score(v, behavior.baselines(v, behavior.NAMES)).select("event_id", first["n"].alias("top"))


@query("anomaly_metrics", FEATURES + ", s AS (SELECT event_id, max(abs(z)) >= 3 AND max(n) >= 2 AS hit FROM z GROUP BY event_id) SELECT 'score_requests_total' AS name, CAST(count(*) AS DOUBLE) AS value FROM s UNION ALL SELECT 'anomalous_requests_total', count(*) FROM s WHERE hit UNION ALL SELECT 'score_requests_by_model_total{model=\"z_score\"}', count(*) FROM s")
def anomaly_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = behavior.extract_features(readers.table_events(spark, d))
    found = sinks.anomaly_metrics(behavior.score(v, behavior.baselines(v, behavior.NAMES)).withColumn("model", F.lit("z_score")), by="model")
    return spark.createDataFrame([(k, float(x)) for k, x in found.items()], "name string, value double")


# graph


@query("degree_by_type", GNODES + ", g AS (SELECT * FROM edges WHERE edge_type = 'grants') SELECT node_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM nodes LEFT JOIN (SELECT target_node_id AS node_id, count(*) AS i FROM g GROUP BY 1) USING (node_id) LEFT JOIN (SELECT source_node_id AS node_id, count(*) AS o FROM g GROUP BY 1) USING (node_id)")
def degree_by_type(spark: SparkSession, d: str) -> DataFrame:
    e = readers.table_events(spark, d)
    return graph.degree(graph.latest_nodes(graph.project_nodes(e)), graph.latest_edges(graph.project_edges(e)), ["grants"]).select("node_id", "in_degree", "out_degree")


@query("graph_lookup", GNODES + "SELECT node_id AS id, node_type AS kind FROM nodes WHERE node_id = 'service:resource-3' UNION ALL SELECT edge_id, edge_type FROM edges WHERE edge_id = (SELECT min(edge_id) FROM edges)")
def graph_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = readers.table_events(spark, d)
    nodes, edges = graph.latest_nodes(graph.project_nodes(e)), graph.latest_edges(graph.project_edges(e))
    first = edges.agg(F.min("edge_id")).first()[0]
    return graph.node(nodes, "service:resource-3").select(F.col("node_id").alias("id"), F.col("node_type").alias("kind")).unionByName(graph.edge(edges, first).select(F.col("edge_id").alias("id"), F.col("edge_type").alias("kind")))


@query("graph_ingest", EV + "SELECT is_new, count(*) AS events FROM (SELECT action <> 'login' AS is_new FROM ev UNION ALL SELECT false FROM ev) GROUP BY is_new")
def graph_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Logins are known already; then everything arrives twice."""
    e = readers.table_events(spark, d)
    twice = e.unionByName(e.withColumn("arrival_seq", F.col("arrival_seq") + 10_000_000_000))
    return graph.ingest(e.where("action = 'login'"), twice).groupBy("is_new").agg(F.count("*").alias("events"))


@query("graph_snapshot", GNODES + "SELECT node_id FROM nodes ORDER BY node_id")
def graph_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return graph.latest_nodes(graph.project_nodes(readers.table_events(spark, d))).select("node_id").orderBy("node_id")


@query("evidence_digest", EV + "SELECT event_id, sha256(actor_id || '|' || resource) AS digest FROM ev")
def evidence_digest(spark: SparkSession, d: str) -> DataFrame:
    return readers.table_events(spark, d).select("event_id", F.sha2(F.concat_ws("|", "actor_id", "resource"), 256).alias("digest"))
