"""Ingestion, behaviour, graph, risk, investigation, sources and sinks on known cases."""

import json
import math
import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewarden import schemas
from tidewarden.operators import behavior, graph, ingest, investigate, risk
from tidewarden.plans import catalog, pipeline
from tidewarden.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def raw(spark, records):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "arrival_seq long, raw string")


def test_aliases_and_enrichment(spark):
    rec = {"timestamp": "2026-08-13T17:30:00+05:30", "user_id": "user-42", "principal_type": "service-account", "ip": "10.0.0.1", "operation": " ROLE_CHANGE ", "target": "billing", "status": "DENIED", "request_id": "r1"}
    row = ingest.enrich(ingest.normalize(raw(spark, [rec]), "src")).withColumn("bag", F.to_json("attributes")).drop("attributes").first()
    assert (row["actor_id"], row["actor_type"], row["source_ip"], row["action"], row["resource"], row["result"], row["severity"]) == ("user-42", "service_account", "10.0.0.1", "role_change", "billing", "failure", "high")
    assert row["timestamp"].hour == 12 and row["ts_offset_seconds"] == 19800
    assert json.loads(row["bag"]) == {"request_id": "r1", "derived": {"is_authentication": False, "is_privilege_change": True, "is_data_movement": False, "is_failure": True}}
    assert row["event_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps({"source": "src", "record": rec}, sort_keys=True)))


def test_bad_rows_are_set_aside(spark):
    rows = [{"timestamp": "nonsense", "user_id": "a", "id": str(uuid.uuid4())}, {"timestamp": 12345, "user_id": "a"}, {"time": "2026-01-01T00:00:00Z"}, {"time": "2026-01-01T00:00:00Z", "actor_id": "a", "id": "not-a-uuid"}, {"ts": "2026-01-01", "principal": "p"}]
    good, bad = schemas.valid_events(ingest.normalize(raw(spark, rows), "src"))
    assert good.count() == 1 and {tuple(r["problems"]) for r in bad.select("problems").collect()} == {("timestamp",), ("actor_id",), ("event_id",)}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n  \n{"b": 2}\nnot json\n[1]\n')
    src = readers.JsonLines(str(tmp_path / "a.jsonl"), strict=False)
    assert [r["arrival_seq"] for r in src.collect(spark).orderBy("arrival_seq").collect()] == [1, 4]
    assert src.quarantine(spark).count() == 2
    with pytest.raises(Exception, match="not a JSON object"):
        readers.JsonLines(str(tmp_path / "a.jsonl")).collect(spark).collect()


def vectors(spark, rows):
    return spark.createDataFrame([(i, f"e{i}", e, "user", x) for i, (e, x) in enumerate(rows)], "arrival_seq long, event_id string, entity_id string, entity_type string, features map<string,double>").withColumn("timestamp", F.lit("2026-01-01").cast("timestamp"))


def test_baseline_and_score(spark):
    v = vectors(spark, [("a", {"x": 10.0, "y": 1.0}), ("a", {"x": 20.0, "y": 1.0}), ("a", {"x": 30.0, "y": 1.0}), ("b", {"x": 5.0, "y": 0.0})])
    b = behavior.baselines(v.unionByName(v))
    row = b.where("entity_id = 'a'").first()
    assert row["observation_count"] == 3 and row["means"]["x"] == 20.0 and row["standard_deviations"]["x"] == pytest.approx(8.16496580927726, rel=1e-12)
    known = spark.createDataFrame([("a", 2, {"x": 10.0, "y": 0.0}, {"x": 2.0, "y": 0.0}), ("c", 1, {"x": 0.0}, {"x": 1.0})], "entity_id string, observation_count long, means map<string,double>, standard_deviations map<string,double>")
    s = behavior.score(vectors(spark, [("a", {"x": 20.0, "y": 9.0}), ("c", {"x": 20.0})]), known).orderBy("entity_id").collect()
    assert (s[0]["score"], s[0]["is_anomalous"], s[0]["top_contributors"]) == (5.0, True, ["x", "y"]) and not s[1]["is_anomalous"]
    with pytest.raises(ValueError):
        behavior.score(v, b, threshold=0)
    assert behavior.unknown_entities(v, known).select("entity_id").distinct().collect()[0][0] == "b"


def test_evaluation(spark):
    rows = [("d", False, False), ("d", True, True), ("d", True, False), ("d", False, True)]
    m = behavior.confusion(spark.createDataFrame(rows, "detector string, predicted boolean, is_anomalous boolean")).first()
    assert [m[c] for c in ("true_positives", "true_negatives", "false_positives", "false_negatives", "precision", "recall", "f1")] == [1, 1, 1, 1, 0.5, 0.5, 0.5]


def test_fixture_run(spark, tmp_path):
    rows = [("b1", 10, False), ("b2", 12, False), ("b3", 150, True), ("b4", 14, False)]
    (tmp_path / "f.jsonl").write_text("\n".join(json.dumps({"event_id": i, "entity_id": "a", "features": {"x": x}, "is_anomalous": y}) for i, x, y in rows))
    report = behavior.run_fixture(readers.labeled_fixture(spark, str(tmp_path / "f.jsonl")), 2)
    z = next(m for m in report["metrics"] if m["detector"] == "z_score")
    assert (z["true_positives"], z["false_positives"], z["false_negatives"], report["best"]) == (1, 1, 0, "z_score") or report["best"] == "isolation_forest"


def test_features_use_the_local_hour(spark):
    rec = {"timestamp": "2026-08-13T06:00:00+05:30", "user_id": "u", "action": "role_change", "result": "failure", "bytes": "2048"}
    f = behavior.extract_features(ingest.normalize(raw(spark, [rec]), "s")).first()["features"]
    assert f["login_hour_sin"] == pytest.approx(1.0) and f["is_failure"] == 1 and f["permission_usage"] == 1 and f["bytes_transferred"] == 2048.0 and f["day_of_week"] == 3


def small_graph(spark, edges, criticality=None):
    ids = sorted({x for e in edges for x in e[:2]})
    nodes = spark.createDataFrame([(i, "service", i, "{}", (criticality or {}).get(i, 0)) for i in ids], "node_id string, node_type string, label string, properties string, criticality int")
    rows = [(f"e{k}", e[2] if len(e) > 2 else "calls", e[0], e[1], "{}", None, float(e[3]) if len(e) > 3 else 1.0) for k, e in enumerate(edges)]
    return nodes, spark.createDataFrame(rows, "edge_id string, edge_type string, source_node_id string, target_node_id string, properties string, observed_at timestamp, confidence double")


def test_paths(spark):
    nodes, edges = small_graph(spark, [("alice", "x", "has_role", 0.95), ("x", "y", "grants", 0.95), ("y", "key", "reads", 0.95), ("alice", "key", "reads", 0.2)], {"key": 90})
    path = graph.shortest_path(nodes, edges, "alice", "key")
    assert path["edge_ids"] == ["e0", "e1", "e2"] and path["total_cost"] == pytest.approx(3.1578947368421053)
    assert graph.shortest_path(nodes, edges, "key", "alice") is None and graph.shortest_path(nodes, edges, "key", "key")["total_cost"] == 0
    assert graph.assess_attack_path(nodes, edges, "alice", "key")["risk_score"] == pytest.approx(63 + 20 + 20 - 2 * 3.1578947368421053)
    none = graph.assess_attack_path(nodes, edges, "key", "alice")
    assert none["risk_score"] == 0 and none["criticality_component"] == 0
    with pytest.raises(ValueError):
        graph.shortest_path(nodes, edges, "alice", "nobody")


def test_traversal_orders(spark):
    nodes, edges = small_graph(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "e"), ("d", "e"), ("e", "a")])
    order = lambda alg: [(r["node_id"], r["depth"]) for r in graph.reachability(nodes, edges, "a", alg).orderBy("position").collect()]
    assert order("bfs") == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 2)]
    assert order("dfs") == [("a", 0), ("b", 1), ("d", 2), ("e", 3), ("c", 1)]
    with pytest.raises(ValueError):
        graph.reachability(nodes, edges, "a", "other")


def test_large_levels_are_ranked_by_ranges(spark, monkeypatch):
    rnd = random.Random(8)
    nodes, edges = small_graph(spark, [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(150)] + [("n0", f"n{i}") for i in range(1, 20)])
    plain = sorted(map(tuple, graph.reachability(nodes, edges, "n0").collect()))
    path = graph.shortest_path(nodes, edges, "n0", "n33")
    monkeypatch.setattr(graph, "RANKED", 3)
    monkeypatch.setattr(graph, "FETCHED", 2)
    assert sorted(map(tuple, graph.reachability(nodes, edges, "n0").collect())) == plain
    assert graph.shortest_path(nodes, edges, "n0", "n33") == path


def test_named_baselines_equal_the_plain_ones(spark):
    v = vectors(spark, [("a", {"x": 10.0, "y": 1.0}), ("a", {"x": 20.0}), ("b", {"y": 5.0}), ("c", {"z": 1.0})])
    facts = lambda df: sorted((r["entity_id"], r["observation_count"], sorted(r["means"].items()), sorted(r["standard_deviations"].items()), r["entity_type"], r["feature_names"]) for r in df.collect())
    assert facts(behavior.baselines(v, ["x", "y", "z"])) == facts(behavior.baselines(v))
    assert [r[0] for r in behavior.baselines(v, ["z"]).select("entity_id").collect()] == ["c"]


def test_components_against_plain_reachability(spark):
    rnd = random.Random(4)
    edges = [(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(22)]
    nodes, e = small_graph(spark, edges)
    near = defaultdict(set)
    for s, t in edges:
        near[s].add(t)

    def reach(s):
        seen, todo = {s}, [s]
        while todo:
            for t in near[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return seen

    at = {n: reach(n) for n in {x for p in edges for x in p}}
    expected = {n: min(m for m in at if m in at[n] and n in at[m]) for n in at}
    assert {r["node_id"]: r["component"] for r in graph.components(nodes, e).collect()} == expected


def test_degree_counts_isolated_nodes(spark):
    nodes, edges = small_graph(spark, [("h", "a"), ("h", "b"), ("h", "c")])
    got = {r["node_id"]: (r["total_degree"], r["normalized_degree"]) for r in graph.degree(nodes, edges).collect()}
    assert got["h"] == (3, 0.5) and graph.degree(nodes, edges, ["reads"]).where("total_degree > 0").isEmpty()


def test_diff(spark):
    nodes, before = small_graph(spark, [("a", "b"), ("b", "key")])
    _, after = small_graph(spark, [("a", "b"), ("b", "key", "grants")])
    d = graph.diff_edges(before, after).collect()
    assert [(r["edge_id"], r["status"], r["newly_exposed"]) for r in d] == [("e1", "changed", True)]
    assert [r[0] for r in graph.exposed_nodes(graph.diff_edges(before, after), nodes).collect()] == ["key"]
    assert graph.diff_nodes(nodes, nodes.where("node_id <> 'a'")).first()["status"] == "removed"


def test_risk(spark):
    df = spark.createDataFrame([("high", 80.0, 0.9, 70.0, 4)], "severity string, anomaly_score double, sequence_confidence double, graph_risk_score double, evidence_count int")
    row = risk.score_risk(df).first()
    assert (row["risk_score"], row["band"]) == (76.5, "high") and row["components"]["sequence"] == pytest.approx(18.0)
    assert schemas.valid_risk_inputs(df.withColumn("anomaly_score", F.lit(101.0)))[1].count() == 1


def test_investigation(spark):
    ev = spark.createDataFrame([("r", "event", "e1", "s"), ("r", "event", "e2", "s"), ("r", "graph_path", "g", "s")], "request_id string, reference_type string, reference_id string, source string")
    row = investigate.investigate(spark.createDataFrame([("r", "inc")], "request_id string, incident_id string"), ev).first()
    assert row["summary"].startswith("Investigation prepared for incident inc using 3 evidence reference(s): 2 event, 1 graph path.")
    assert [b["runbook_id"] for b in row["runbooks"]] == ["credential-compromise-response", "graph-relationship-investigation"]
    assert investigate.citation_problems(ev, ev, ev).isEmpty()


def test_store_and_artifacts(spark, tmp_path):
    found = pipeline.build_pipeline()(readers.table_events(spark, SF))
    store = sinks.IncidentStore(spark, str(tmp_path / "store"))
    store.upsert(found)
    one = found.limit(1).withColumn("status", F.lit("closed"))
    fp = one.first()["fingerprint"]
    store.upsert(found.where(F.col("fingerprint") == fp).withColumn("status", F.lit("closed")))
    assert store.all().count() == 140 and store.get(fp).first()["status"] == "closed"
    service = pipeline.Service(store, keys=(("k", "investigator"),))
    assert service.list_incidents("k")["total"] == 140
    with pytest.raises(PermissionError):
        service.assess(fp, found, "k")
    with pytest.raises(LookupError):
        service.incident("nobody:nothing", "k")
    sinks.save_artifact(tmp_path / "b.json", {"x": 1})
    assert readers.load_artifact(tmp_path / "b.json") == {"x": 1}
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.load_artifact(tmp_path / "b.json")


def test_assess_and_metrics(spark, tmp_path):
    found = pipeline.build_pipeline()(readers.table_events(spark, SF))
    store = sinks.IncidentStore(spark, str(tmp_path / "store"))
    service = pipeline.Service(store)
    with pytest.raises(LookupError):
        store.get("a:b")
    assert service.ready()["status"] == "degraded" and "incidents 0" in service.metrics()
    store.upsert(found)
    one = found.orderBy("fingerprint").first()
    inputs = spark.createDataFrame([(one["incident_id"], "high", 80.0, 0.9, 70.0, 4)], "incident_id string, severity string, anomaly_score double, sequence_confidence double, graph_risk_score double, evidence_count int")
    out = service.assess(one["fingerprint"], inputs)
    assert (out.first()["risk_score"], out.first()["risk_band"]) == (76.5, "high") and store.get(one["fingerprint"]).first()["risk_score"] == 76.5
    with pytest.raises(ValueError):
        service.assess(one["fingerprint"], inputs.withColumn("incident_id", F.lit("other")))
    text = service.metrics(**sinks.sequence_metrics(spark.createDataFrame([(5, 1, 2, 3, 4, 0, 6)], "processed long, duplicates long, late long, completed long, evicted long, active long, peak long"), seconds=0.5))
    assert "tidewarden_incidents 140" in text and "tidewarden_states_evicted_total 4" in text and "tidewarden_sequence_latency_ms_average 100.0" in text and "# TYPE tidewarden_peak_active_states gauge" in text
    calls = sinks.ProviderMetrics()
    calls.observe(True, 0.2)
    calls.observe(False, 0.4, 2)
    assert calls.values()["provider_latency_ms_average"] == pytest.approx(300) and "tidewarden_provider_failures_total 1" in sinks.prometheus(calls.values(), gauges=sinks.GAUGES)


def test_two_writers_of_the_store(spark, tmp_path, monkeypatch):
    row = lambda fp, status: spark.createDataFrame([(fp, status)], "fingerprint string, status string")
    a, b = (sinks.IncidentStore(spark, str(tmp_path / "s")) for _ in range(2))
    a.upsert(row("x", "open"))
    reader = b.all()
    real, meant = a._commit, []

    def late(number, name):
        if not meant:  # another writer is faster
            meant.append(name)
            b.upsert(row("y", "open"))
        return real(number, name)

    monkeypatch.setattr(a, "_commit", late)
    a.upsert(row("x", "closed"))
    assert [tuple(r) for r in a.all().collect()] == [("x", "closed"), ("y", "open")]
    b.upsert(row("z", "open"))
    assert b.all().count() == 3 and reader is not None


def test_forest_artifacts_and_registry(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 3))
    forest = behavior.IsolationForest(trees=20).fit(x)
    path = str(tmp_path / "forest.json")
    forest.save(path, "a", ["f", "g", "h"], len(x))
    again, facts = behavior.IsolationForest.load(path, "a")
    assert np.allclose(again.score(x), forest.score(x)) and facts["feature_names"] == ["f", "g", "h"] and facts["observation_count"] == 60
    with pytest.raises(ValueError):
        behavior.IsolationForest.load(path, "b")
    with pytest.raises(RuntimeError):
        behavior.IsolationForest().save(path, "a", [], 0)
    v = vectors(spark, [("a", {"x": 1.0}), ("a", {"x": 3.0}), ("b", {"x": 9.0})])
    now, known, new = behavior.update_many(v.limit(0), v.unionByName(v))
    assert new == 3 and [r["entity_id"] for r in known.collect()] == ["a", "b"]
    service = pipeline.Service(sinks.IncidentStore(spark, str(tmp_path / "none")))
    for e in ("a", "b"):
        service.register(known.where(F.col("entity_id") == e), e)
    assert service.score(v).count() == 3
    with pytest.raises(ValueError):
        service.register(known.where("entity_id = 'a'"), "b")


def test_evidence_files(spark, tmp_path):
    ref = {"reference_type": "event", "reference_id": "e", "source": "s"}
    for name, content in (("ok", [ref]), ("object", ref), ("short", [{"reference_type": "event"}])):
        (tmp_path / name).write_text(json.dumps(content, indent=1))
    assert readers.evidence(spark, str(tmp_path / "ok")).collect()[0]["reference_id"] == "e"
    for name in ("object", "short"):
        with pytest.raises(Exception, match="JSON array|without"):
            readers.evidence(spark, str(tmp_path / name)).collect()


def test_isolation_scores_follow_the_forest(spark):
    """Per entity what the forest gives alone, and outliers on top."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(e, {"x": float(a), "y": float(b)}) for e in ("a", "b") for a, b in [*rng.normal(size=(80, 2)), (9.0, 9.0)]]
    v = vectors(spark, rows)
    out = {r["event_id"]: (r["score"], r["is_anomalous"]) for r in behavior.isolation_scores(v, v, trees=30).collect()}
    for e in ("a", "b"):
        at = [i for i, r in enumerate(rows) if r[0] == e]
        x = np.array([[rows[i][1]["x"], rows[i][1]["y"]] for i in at])
        top = max(at, key=lambda i: out[f"e{i}"][0])
        assert top == at[-1] and out[f"e{top}"][1] and sum(out[f"e{i}"][1] for i in at) <= 6
        assert sorted(out[f"e{i}"][0] for i in at) == pytest.approx(sorted(behavior.IsolationForest(30).fit(x).score(x)), abs=0.05)


def test_projection(spark):
    rec = {"timestamp": "2026-01-01T00:00:00Z", "user_id": "al", "ip": "10.0.0.1", "action": "login", "resource": "console", "result": "success", "severity": "critical"}
    e = ingest.normalize(raw(spark, [rec]), "s")
    nodes = {r["node_id"]: r["criticality"] for r in graph.latest_nodes(graph.project_nodes(e)).collect()}
    assert nodes == {"user:al": 0, "service:console": 100, "ip:10.0.0.1": 0}
    row = graph.project_edges(e).first()
    assert (row["edge_type"], row["target_node_id"], row["confidence"]) == ("logged_in_from", "ip:10.0.0.1", 1.0)


def test_every_query_runs(spark):
    q = catalog.queries()
    for name in ("incidents", "rule_mode_any", "cep_24h", "risk", "degree", "runbooks", "uuid5"):
        assert q[name](spark, SF).count() >= 0
    assert set(catalog.oracle_sql()) <= set(q)
    assert math.isclose(q["incidents"](spark, SF).count(), 140)


def test_isolation_query_uses_the_default_forest(spark, monkeypatch):
    import inspect

    seen, real = [], behavior.isolation_scores

    def record(*args, **named):
        call = inspect.signature(real).bind(*args, **named)
        call.apply_defaults()
        seen.append(call.arguments["trees"])
        return real(*args, **named)

    monkeypatch.setattr(behavior, "isolation_scores", record)
    catalog.queries()["isolation_forest"](spark, SF)
    assert seen == [100]


@pytest.fixture(scope="module")
def edges_of_three(spark, tmp_path_factory):
    """Events of users with z-scores of 3, or equal ones of two features, in exact arithmetic."""
    at = str(tmp_path_factory.mktemp("edges"))
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    users = [r[0] for r in events.where("event_id in (16206, 20618, 36350, 18645, 87956)").select("user_id").collect()]
    events.where(F.col("user_id").isin(users)).orderBy("event_id").coalesce(1).write.parquet(f"{at}/events.parquet")
    return at


def equals_sql(spark, at, name):
    """The query gives the rows that its SQL gives on one thread, which takes the table in its order."""
    import duckdb

    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * from '{at}/events.parquet/*.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(map(tuple, catalog.queries()[name](spark, at).select(*columns).collect())) == sorted(found.fetchall())


def test_statistics_are_taken_in_the_order_of_arrival(spark):
    """The same doubles as an online store's, however the rows are dealt out and into how many batches."""
    import random

    rng = random.Random(3)
    rows = [(f"u{rng.randrange(5)}", {"x": rng.uniform(0, 100), **({"y": float(i % 10 == 0)} if i % 7 else {})}) for i in range(600)]
    state = {}
    for e, features in rows:
        for k, x in features.items():
            s = state.setdefault((e, k), [0, 0.0, 0.0, 0.0])
            s[0] += 1
            delta = x - s[1]
            s[1] += delta / s[0]
            s[2] += delta * (x - s[1])
            s[3] += x
    plain = {k: (s[3] / s[0], math.sqrt(s[2] / s[0])) for k, s in state.items()}
    v, name = vectors(spark, rows), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in ("7", "10000"):
            spark.conf.set(name, size)
            for known in (["x", "y"], None):
                out = behavior.baselines(v.repartition(3), known).collect()
                assert {(r["entity_id"], k): (m, r["standard_deviations"][k]) for r in out for k, m in r["means"].items()} == plain
    finally:
        spark.conf.set(name, before)


def test_zscore_at_the_threshold(spark, edges_of_three):
    equals_sql(spark, edges_of_three, "zscore")


def test_anomaly_metrics_at_the_threshold(spark, edges_of_three):
    equals_sql(spark, edges_of_three, "anomaly_metrics")


def test_scored_pipeline_on_a_repeated_table(spark, edges_of_three, tmp_path):
    """At the threshold; and with time that starts anew, where the SQL's sequences follow arrival."""
    equals_sql(spark, edges_of_three, "scored_pipeline")
    once = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    again = once.withColumns({"event_id": F.col("event_id") + 10_000, "user_id": F.col("user_id") + 150})
    once.unionByName(again).orderBy("event_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    equals_sql(spark, str(tmp_path), "scored_pipeline")


def test_top_contributor_of_equal_scores(spark, edges_of_three):
    equals_sql(spark, edges_of_three, "top_contributor")


def test_forest_grows_all_trees_at_once():
    """Rows' scores are the plain walk's down each tree; 100 trees on an entity's 67 rows take little time."""
    import time

    import numpy as np

    rng = np.random.default_rng(7)
    seconds = []
    for n in (67, 67, 67, 700, 2):
        x = np.column_stack([rng.normal(size=(n, 3)), rng.integers(0, 2, n), np.zeros(n)])
        began = time.perf_counter()
        forest = behavior.IsolationForest().fit(x)
        scores = forest.score(x)
        seconds.append(time.perf_counter() - began)
        feature, cut, left, value = forest.forest
        sizes = np.zeros(len(feature), int)

        def walk(row, node, feature=feature, cut=cut, left=left):
            return walk(row, left[node] + (row[feature[node]] >= cut[node])) if feature[node] >= 0 else node

        leaves = [[walk(row, t) for t in range(100)] for row in x]
        c = lambda n: 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
        assert scores == pytest.approx([2 ** (-sum(value[i] for i in at) / 100 / c(min(n, 256))) - forest.offset for at in leaves], abs=1e-9)
        if n <= 256:  # every row is in every tree: a leaf's value is its depth and what its rows would need further
            np.add.at(sizes, np.array(leaves).ravel(), 1)
            depth = np.zeros(len(feature))
            for i in np.flatnonzero(feature >= 0):
                depth[left[i]] = depth[left[i] + 1] = depth[i] + 1
            assert depth.max() <= math.ceil(math.log2(n))
            assert all(value[i] == pytest.approx(depth[i] + c(sizes[i])) for i in np.flatnonzero((feature < 0) & (sizes > 0)))
    assert min(seconds[:3]) < 0.04


def test_forests_of_one_frame_and_of_two(spark):
    """The same forest for a seed however the rows are dealt out; maps of several kinds; entities of one vector are left out."""
    rng = random.Random(2)
    rows = [(f"u{i % 3}", {"x": rng.random(), "y": rng.random()} if i % 5 else {"y": rng.random(), "x": rng.random(), "z": 1.0}) for i in range(300)]
    v = vectors(spark, [*rows, ("alone", {"x": 1.0, "y": 1.0})])
    facts = lambda df: sorted((r["event_id"], r["entity_id"], round(r["score"], 9)) for r in df.collect())
    once = facts(behavior.isolation_scores(v, v))
    assert len(once) == 300 and facts(behavior.isolation_scores(v, v.repartition(3))) == once
    w = v.repartition(7)
    assert facts(behavior.isolation_scores(w, w)) == once
