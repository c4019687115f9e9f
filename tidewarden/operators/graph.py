"""Property graph: projection from events, snapshot, degree, diff, traversal, paths, components.

Loops keep one written table a round and stop on an empty frontier; nothing is gathered on the driver
but counts.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..functions.tables import small, written

#: Actions and the edges that they make: fixed values.
EDGE_TYPES = {
    "login": "logged_in_from", "authenticate": "logged_in_from", "logout": "logged_in_from", "call": "calls", "request": "calls", "invoke": "calls", "read": "reads", "select": "reads", "download": "reads", "export": "reads",
    "write": "writes", "insert": "writes", "update": "writes", "upload": "writes", "deploy": "deployed_on", "run": "deployed_on", "grant_permission": "grants", "role_change": "grants", "access": "accessed", "accessed": "accessed",
}
RESOURCE_TYPES = ["api", "service", "container", "database", "table", "secret", "repository"]
ACTOR_NODES = {"user": "user", "service_account": "service", "api_client": "api", "device": "device", "unknown": "user"}
PRIVILEGE = ["has_role", "grants", "owns"]
EXPOSING = ["can_reach", "exposed_to", "grants"]


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _typed(events: DataFrame) -> DataFrame:
    resource_type = F.lower(F.try_variant_get("attributes", "$.resource_type", "string"))
    return events.withColumns({
        "__rt": F.when(resource_type.isin(RESOURCE_TYPES), resource_type).otherwise("service"),
        "__at": F.coalesce(_lookup(F.col("actor_type"), ACTOR_NODES), F.lit("user")),
    }).withColumns({"__actor": F.concat_ws(":", "__at", "actor_id"), "__resource": F.concat_ws(":", "__rt", "resource"), "__ip": F.concat(F.lit("ip:"), F.nullif("source_ip", F.lit(""))), "__device": F.concat(F.lit("device:"), F.nullif("device_id", F.lit("")))})


def project_nodes(events: DataFrame) -> DataFrame:
    """Node observations of each event: actor, resource, then address and device if there are any."""
    node = lambda pos, i, kind, label, props, criticality: F.struct(F.lit(pos).alias("pos"), i.alias("node_id"), kind.alias("node_type"), label.alias("label"), props.alias("properties"), criticality.cast("int").alias("criticality"))
    none, empty = F.lit(0), F.lit("{}")
    nodes = F.array(
        node(0, F.col("__actor"), F.col("__at"), F.col("actor_id"), F.to_json(F.struct("source", "actor_type")), none),
        node(1, F.col("__resource"), F.col("__rt"), F.col("resource"), F.to_json(F.struct("source")), F.when(F.col("severity") == "critical", 100).otherwise(0)),
        node(2, F.col("__ip"), F.lit("ip"), F.col("source_ip"), empty, none),
        node(3, F.col("__device"), F.lit("device"), F.col("device_id"), empty, none),
    )
    return _typed(events).select("arrival_seq", F.explode(F.filter(nodes, lambda x: x["node_id"].isNotNull())).alias("n")).select("arrival_seq", "n.*")


def project_edges(events: DataFrame) -> DataFrame:
    """At most one edge an event: actor to resource, or to the address it logged in from."""
    kind = _lookup(F.col("action"), EDGE_TYPES)
    login = kind == "logged_in_from"
    df = _typed(events).withColumn("edge_type", F.when(login & F.col("__ip").isNull(), None).otherwise(kind)).where("edge_type is not null")
    return df.select(
        "arrival_seq", F.concat(F.lit("event:"), "event_id").alias("edge_id"), "edge_type", F.col("__actor").alias("source_node_id"), F.when(F.col("edge_type") == "logged_in_from", F.col("__ip")).otherwise(F.col("__resource")).alias("target_node_id"),
        F.to_json(F.struct("event_id", "result")).alias("properties"), F.col("timestamp").alias("observed_at"), F.when(F.col("result") == "success", 1.0).otherwise(0.7).alias("confidence"),
    )


def latest_nodes(observed: DataFrame, keep_highest: bool = False) -> DataFrame:
    """The last observation of each node; with keep_highest, the largest criticality seen."""
    last = F.max_by(F.struct("node_type", "label", "properties", "criticality"), F.struct("arrival_seq", "pos")).alias("n")
    out = observed.groupBy("node_id").agg(last, F.max("criticality").alias("__top"))
    return out.select("node_id", "n.node_type", "n.label", "n.properties", (F.col("__top") if keep_highest else F.col("n.criticality")).alias("criticality"))


def latest_edges(observed: DataFrame) -> DataFrame:
    columns = ["edge_type", "source_node_id", "target_node_id", "properties", "observed_at", "confidence"]
    return observed.groupBy("edge_id").agg(F.max_by(F.struct(*columns), "arrival_seq").alias("e")).select("edge_id", "e.*")


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node of that id; no row if there is none."""
    return nodes.where(F.col("node_id") == node_id)


def edge(edges: DataFrame, edge_id: str) -> DataFrame:
    return edges.where(F.col("edge_id") == edge_id)


def ingest(known: DataFrame, events: DataFrame) -> DataFrame:
    """event_id, is_new of arriving events: False for a replay, of a known event or of an earlier arrival."""
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("arrival_seq"))
    seen = known.select(F.col("event_id").alias("__seen")).distinct()
    out = events.select("arrival_seq", "event_id").withColumn("__n", first).join(seen, F.col("event_id") == F.col("__seen"), "left")
    return out.select("arrival_seq", "event_id", (F.col("__seen").isNull() & (F.col("__n") == 1)).alias("is_new"))


def snapshot_id(nodes: DataFrame, prefix: str = "tidewarden:graph:") -> DataFrame:
    """UUID 5 of the sorted node ids; one text of all ids, as the identifier is defined."""
    return nodes.agg(uuid5(F.concat(F.lit(prefix), F.array_join(F.array_sort(F.collect_set("node_id")), ":"))).alias("snapshot_id"))


def selected(edges: DataFrame, edge_types: Iterable[str] | None) -> DataFrame:
    return edges if edge_types is None else edges.where(F.col("edge_type").isin(list(edge_types)))


def degree(nodes: DataFrame, edges: DataFrame, edge_types: Iterable[str] | None = None) -> DataFrame:
    """In, out and total degree of every node over edges whose ends are both nodes; normalised by 2 (n - 1)."""
    ids = nodes.select("node_id")
    e = selected(edges, edge_types).join(ids.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi")
    ends = e.select(F.explode(F.array(F.struct(F.col("source_node_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_node_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    counts = ends.groupBy("x.node_id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    n = nodes.agg(F.count("*").alias("__n"))
    out = ids.join(counts, "node_id", "left").crossJoin(F.broadcast(n))
    i, o = F.coalesce("in_degree", F.lit(0)), F.coalesce("out_degree", F.lit(0))
    return out.select("node_id", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("total_degree"), ((i + o) / F.greatest(F.lit(1), 2 * (F.col("__n") - 1))).alias("normalized_degree"))


def diff_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """edge_id, status (added, removed, changed), newly_exposed, target_node_id of edges that differ."""
    columns = ["edge_type", "source_node_id", "target_node_id", "properties", "observed_at", "confidence"]
    pack = lambda d, n: d.select("edge_id", F.struct(*columns).alias(n))
    both = pack(before, "b").join(pack(after, "a"), "edge_id", "full_outer")
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    out = both.withColumn("status", status).where("status is not null")
    return out.select("edge_id", "status", (F.col("status").isin("added", "changed") & F.col("a.edge_type").isin(EXPOSING)).alias("newly_exposed"), F.coalesce("a.target_node_id", "b.target_node_id").alias("target_node_id"))


def diff_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    b, a = before.select("node_id", F.lit(1).alias("b")), after.select("node_id", F.lit(1).alias("a"))
    return b.join(a, "node_id", "full_outer").select("node_id", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").alias("status")).where("status is not null")


def exposed_nodes(edge_diff: DataFrame, after_nodes: DataFrame) -> DataFrame:
    return edge_diff.where("newly_exposed").select(F.col("target_node_id").alias("node_id")).distinct().join(after_nodes.select("node_id"), "node_id", "left_semi")


def _require(nodes: DataFrame, *ids: str) -> None:
    found = {r["node_id"] for r in nodes.where(F.col("node_id").isin(*ids)).select("node_id").distinct().collect()}
    if missing := sorted(set(ids) - found):
        raise ValueError(f"no such node: {', '.join(missing)}")


def reachability(nodes: DataFrame, edges: DataFrame, source: str, algorithm: str = "bfs", edge_types: Iterable[str] | None = None) -> DataFrame:
    """node_id, depth, position of the nodes that source reaches (source first, at depth 0).

    bfs: a join a level; within a level by the parent's position, then by node id. dfs: one graph's
    stack order, in a single task. Targets that aren't listed as nodes are traversed too.
    """
    _require(nodes, source)
    steps = selected(edges, edge_types).select(F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t")).distinct()
    if algorithm == "dfs":
        return _dfs(steps, source)
    if algorithm != "bfs":
        raise ValueError("algorithm must be bfs or dfs")
    spark = nodes.sparkSession
    steps = written(steps, "steps")
    visited = spark.createDataFrame([(source, 0, 0)], "node_id string, depth int, position long")
    frontier, depth, position = visited, 0, 1
    while True:
        depth += 1
        near = steps.join(small(frontier), F.col("s") == F.col("node_id")).groupBy("t").agg(F.min("position").alias("parent")).join(visited.select(F.col("node_id").alias("t")), "t", "left_anti")
        near = written(near, "frontier")
        count = near.count()
        if not count:
            return visited
        # one level's ranks; ties of the parent's position go by node id
        frontier = written(_ranked(near, count, "parent", "t").select(F.col("t").alias("node_id"), F.lit(depth).alias("depth"), (F.col("rank") + F.lit(position - 1)).cast("long").alias("position")), "frontier")
        visited = written(visited.unionByName(frontier), "visited")
        position += count


#: Rows that one task ranks.
RANKED = 1_000_000


def _ranked(df: DataFrame, count: int, *order: str) -> DataFrame:
    """df with rank, from 1 by the order. Many rows are sorted by ranges; a row for each range carries the rank on."""
    if count <= RANKED:
        return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    rows = written(df.orderBy(*order).withColumn("__i", F.monotonically_increasing_id()), "ranks").withColumn("__part", F.shiftright("__i", 33))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", before.alias("__base"))
    return rows.join(F.broadcast(base), "__part").withColumn("rank", F.col("__base") + F.expr("__i & 8589934591") + 1).drop("__i", "__part", "__base")


def _dfs(steps: DataFrame, source: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for s, t in sorted(zip(rows["s"], rows["t"], strict=True)):
            near.setdefault(s, []).append(t)
        seen, order, stack = {source: 0}, [], [source]
        while stack:
            at = stack.pop()
            order.append(at)
            for t in reversed(near.get(at, [])):
                if t not in seen:  # marked when pushed
                    seen[t] = seen[at] + 1
                    stack.append(t)
        return pd.DataFrame({"node_id": order, "depth": [seen[x] for x in order], "position": range(len(order))})

    one = steps.unionByName(steps.sparkSession.createDataFrame([(source, source)], "s string, t string"))
    return one.withColumn("g", F.lit("graph")).groupBy("g").applyInPandas(run, "node_id string, depth int, position long")


def cost(confidence: Column) -> Column:
    return 1 / F.greatest(confidence, F.lit(0.01))


#: Most predecessors that are fetched at once to walk back along a path.
FETCHED = 50_000


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, edge_types: Iterable[str] | None = None) -> dict | None:
    """The cheapest path by rounds of relaxation; None if there is none.

    Of equal costs the predecessor comes first that is nearer, then by its id, then by edge id.
    """
    _require(nodes, source, target)
    if source == target:
        return {"node_ids": [source], "edge_ids": [], "edge_types": [], "total_cost": 0.0}
    steps = written(selected(edges, edge_types).select("edge_id", "edge_type", F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t"), cost(F.col("confidence")).alias("c")), "steps")
    spark = nodes.sparkSession
    best = spark.createDataFrame([(source, 0.0)], "node_id string, d double")
    frontier = best
    while True:
        reached = steps.join(small(frontier), F.col("s") == F.col("node_id")).groupBy("t").agg(F.min(F.col("d") + F.col("c")).alias("n"))
        known = best.withColumnRenamed("node_id", "t")
        goal = best.where(F.col("node_id") == target).agg(F.min("d").alias("goal"))
        # costs never fall along a path: what isn't below the target's is no use
        better = written(reached.join(known, "t", "left").crossJoin(F.broadcast(goal)).where("(d is null or n < d) and (goal is null or n < goal)").select(F.col("t").alias("node_id"), F.col("n").alias("d")), "frontier")
        if better.isEmpty():
            break
        best = written(best.join(better.select("node_id"), "node_id", "left_anti").unionByName(better), "best")
        frontier = better
    if best.where(F.col("node_id") == target).isEmpty():
        return None
    tight = steps.join(best.select(F.col("node_id").alias("s"), F.col("d").alias("ds")), "s").join(best.select(F.col("node_id").alias("t"), F.col("d").alias("dt")), "t").where("ds + c = dt")
    before = written(tight.groupBy("t").agg(F.min(F.struct("ds", "s", "edge_id", "edge_type")).alias("p")).select("t", "p.*"), "before")
    total = best.where(F.col("node_id") == target).first()["d"]
    held = {r["t"]: r for r in before.limit(FETCHED + 1).collect()}
    whole = len(held) <= FETCHED
    path, at = [], target
    while at != source:  # beyond FETCHED rows, a lookup for each edge of the path
        row = held[at] if whole else before.where(F.col("t") == at).first()
        path.append(row)
        at = row["s"]
    path.reverse()
    return {"node_ids": [source, *(r["t"] for r in path)], "edge_ids": [r["edge_id"] for r in path], "edge_types": [r["edge_type"] for r in path], "total_cost": total}


def distances(edges: DataFrame, source: str, edge_types: Iterable[str] | None = None) -> DataFrame:
    """node_id, total_cost, hops of everything that source reaches, at the least cost."""
    steps = written(selected(edges, edge_types).select(F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t"), cost(F.col("confidence")).alias("c")), "steps")
    best = edges.sparkSession.createDataFrame([(source, 0.0, 0)], "node_id string, d double, h int")
    frontier = best
    while True:
        reached = steps.join(small(frontier), F.col("s") == F.col("node_id")).groupBy("t").agg(F.min(F.struct((F.col("d") + F.col("c")).alias("d"), (F.col("h") + 1).alias("h"))).alias("n"))
        better = written(reached.join(best.withColumnRenamed("node_id", "t"), "t", "left").where("d is null or n.d < d").select(F.col("t").alias("node_id"), "n.d", "n.h"), "frontier")
        if better.isEmpty():
            return best.select("node_id", F.col("d").alias("total_cost"), F.col("h").alias("hops"))
        best = written(best.join(better.select("node_id"), "node_id", "left_anti").unionByName(better), "best")
        frontier = better


def attack_risk(criticality: Column, privilege_edges: Column, total_cost: Column) -> Column:
    """0.7 criticality, ten points for each privilege edge up to 30, up to 20 for a short path."""
    return F.least(F.lit(100.0), 0.70 * criticality + F.least(F.lit(30.0), 10.0 * privilege_edges) + F.least(F.lit(20.0), F.greatest(F.lit(0.0), 20.0 - 2.0 * total_cost)))


def assess_attack_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, edge_types: Iterable[str] | None = None) -> dict:
    path = shortest_path(nodes, edges, source, target, edge_types)
    criticality = 0.70 * nodes.where(F.col("node_id") == target).first()["criticality"]
    if path is None:
        return {"reachable": False, "risk_score": 0.0, "criticality_component": criticality, "privilege_component": 0.0, "path_component": 0.0, "total_cost": None, "node_ids": [], "edge_ids": []}
    privilege = min(30.0, 10.0 * sum(t in PRIVILEGE for t in path["edge_types"]))
    short = min(20.0, max(0.0, 20.0 - 2.0 * path["total_cost"]))
    return {"reachable": True, "risk_score": min(100.0, criticality + privilege + short), "criticality_component": criticality, "privilege_component": privilege, "path_component": short, **path}


def components(nodes: DataFrame, edges: DataFrame, edge_types: Iterable[str] | None = None) -> DataFrame:
    """node_id, component: strongly connected components, named by their smallest member.

    Rounds of colouring: each node takes the largest id that reaches it; the nodes that reach their
    colour's own node within the colour are its component. Edges to unlisted nodes are ignored.
    """
    ids = nodes.select("node_id").distinct()
    e = selected(edges, edge_types).select(F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t")).where("s <> t").distinct()
    e = written(e.join(ids.withColumnRenamed("node_id", "s"), "s", "left_semi").join(ids.withColumnRenamed("node_id", "t"), "t", "left_semi"), "steps")
    left, done = ids, None
    while True:
        # nodes without a way in or out are components of their own
        inner = e.select(F.col("s").alias("node_id")).intersect(e.select(F.col("t").alias("node_id")))
        alone = left.join(inner, "node_id", "left_anti").select("node_id", F.col("node_id").alias("component"))
        alone = written(alone, "alone")
        done = alone if done is None else done.unionByName(alone)
        left = written(left.join(alone, "node_id", "left_anti"), "left")
        if not alone.isEmpty() and not e.isEmpty():
            e = written(e.join(left.withColumnRenamed("node_id", "s"), "s", "left_semi").join(left.withColumnRenamed("node_id", "t"), "t", "left_semi"), "steps")
            continue
        if left.isEmpty():
            break
        colour = written(left.select("node_id", F.col("node_id").alias("c")), "colour")
        while True:
            pushed = e.join(colour, F.col("s") == F.col("node_id")).select(F.col("t").alias("node_id"), "c")
            now = written(colour.unionByName(pushed).groupBy("node_id").agg(F.max("c").alias("c")), "colour")
            changed = not now.join(colour, ["node_id", "c"], "left_anti").isEmpty()
            colour = now
            if not changed:
                break
        back = written(colour.where("node_id = c"), "back")
        within = e.join(colour.select(F.col("node_id").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("node_id").alias("t"), F.col("c").alias("ct")), "t").where("cs = ct").select("s", "t", "cs")
        within = written(within, "within")
        front = back
        while True:
            front = written(within.join(front.select(F.col("node_id").alias("t")), "t").select(F.col("s").alias("node_id"), F.col("cs").alias("c")).distinct().join(back.select("node_id"), "node_id", "left_anti"), "front")
            if front.isEmpty():
                break
            back = written(back.unionByName(front), "back")
        found = back.join(back.groupBy("c").agg(F.min("node_id").alias("component")), "c").select("node_id", "component")
        done = done.unionByName(found)
        left = written(left.join(back.select("node_id"), "node_id", "left_anti"), "left")
        e = written(e.join(left.withColumnRenamed("node_id", "s"), "s", "left_semi").join(left.withColumnRenamed("node_id", "t"), "t", "left_semi"), "steps")
        if left.isEmpty():
            break
    return done


def component_report(nodes: DataFrame, edges: DataFrame, edge_types: Iterable[str] | None = None) -> DataFrame:
    """component, node_ids, internal_edge_ids, is_cycle, contains_privilege_edge, is_privilege_loop."""
    members = components(nodes, edges, edge_types)
    e = selected(edges, edge_types)
    at = lambda n, c: members.select(F.col("node_id").alias(n), F.col("component").alias(c))
    inner = e.join(at("source_node_id", "component"), "source_node_id").join(at("target_node_id", "ct"), "target_node_id").where("component = ct")
    facts = inner.groupBy("component").agg(F.array_sort(F.collect_set("edge_id")).alias("internal_edge_ids"), F.bool_or(F.col("edge_type").isin(PRIVILEGE)).alias("privilege"), F.bool_or(F.col("source_node_id") == F.col("target_node_id")).alias("loop"))
    out = members.groupBy("component").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids")).join(facts, "component", "left")
    cycle = (F.size("node_ids") > 1) | F.coalesce("loop", F.lit(False))
    privilege = F.coalesce("privilege", F.lit(False))
    return out.select("component", "node_ids", F.coalesce("internal_edge_ids", F.array().cast("array<string>")).alias("internal_edge_ids"), cycle.alias("is_cycle"), privilege.alias("contains_privilege_edge"), (cycle & privilege).alias("is_privilege_loop"))
