"""Behavioural features, baselines, anomaly scores and the evaluation of detectors."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.artifacts import load_artifact, save_artifact
from ..functions.tables import small
from .ingest import contains_any

#: A feature and the attributes it may come from: fixed values.
NUMERIC = {
    "request_rate": ["request_rate", "requests_per_minute"],
    "response_size": ["response_size", "response_bytes"],
    "bytes_transferred": ["bytes", "bytes_transferred"],
    "endpoint_frequency": ["endpoint_frequency", "endpoint_count"],
}


#: Names of the features of ``extract_features``.
NAMES = ["login_hour_sin", "login_hour_cos", "day_of_week", "is_failure", "is_authentication", "permission_usage", *NUMERIC]


def number(names: list[str], attributes: str = "attributes") -> Column:
    """The first attribute that is a number, a boolean or a numeric text; else 0."""
    return F.coalesce(*[F.try_variant_get(attributes, f"$['{n}']", "double") for n in names], F.lit(0.0))


def extract_features(events: DataFrame) -> DataFrame:
    """event_id, entity_id, entity_type, timestamp, features; hour and weekday in the event's own offset."""
    local = F.col("timestamp") + F.make_dt_interval(secs=F.col("ts_offset_seconds"))
    hour = F.hour(local) + F.minute(local) / 60.0
    turn = F.lit(2 * math.pi) * hour / 24.0
    flag = lambda c: c.cast("double")
    values = {
        "login_hour_sin": F.sin(turn), "login_hour_cos": F.cos(turn), "day_of_week": F.weekday(local).cast("double"), "is_failure": flag(F.col("result") == "failure"),
        "is_authentication": flag(contains_any(F.col("action"), ["login", "logout", "auth"])), "permission_usage": flag(contains_any(F.col("action"), ["role", "permission", "grant", "revoke"])),
    } | {k: number(v) for k, v in NUMERIC.items()}
    return events.select("arrival_seq", "event_id", F.col("actor_id").alias("entity_id"), F.col("actor_type").alias("entity_type"), "timestamp", F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values())).alias("features"))


def distinct_events(vectors: DataFrame) -> DataFrame:
    """First arrival of each event_id."""
    w = Window.partitionBy("event_id").orderBy("arrival_seq")
    return vectors.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _folded(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Running mean and deviation of the value columns over rows sorted by their first ``keys`` columns; the three
    columns after these are facts of the last row. The groups of a batch advance together, row by row; only an open group's state is kept."""
    held = None

    def out(lead: pa.RecordBatch, state: list[np.ndarray]) -> pa.RecordBatch:
        n, _, m2, total, rows = state
        some, least = n > 0, np.maximum(n, 1)
        lists = [pa.array(n.ravel()), pa.array((total / least).ravel(), mask=~some.ravel()), pa.array(np.sqrt(m2 / least).ravel(), mask=~some.ravel())]
        at = pa.array(np.arange(0, n.size + 1, n.shape[1], dtype=np.int32))
        return pa.RecordBatch.from_arrays([*lead.columns, pa.array(rows), *(pa.ListArray.from_arrays(at, x) for x in lists)], names=[*lead.schema.names, "rows", "n", "m", "d"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in batch.columns[:keys]:
            ends = pc.run_end_encode(c).run_ends.to_numpy()
            new[np.append(0, ends[:-1])] = True
        start = np.flatnonzero(new)
        stop = np.append(start[1:], batch.num_rows)
        values = batch.columns[keys + 3 :]
        there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in values])
        x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in values])
        shape = (len(start), len(values))
        state = [np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape), np.zeros(shape), stop - start]
        if held is not None:
            if held[0].select(range(keys)).to_pylist() == batch.slice(0, 1).select(range(keys)).to_pylist():
                for mine, theirs in zip(state[:4], held[1], strict=False):
                    mine[0] = theirs[0]
                state[4][0] += held[1][4][0]
            else:
                yield out(*held)
        # the longest first, so that those which go on are a prefix
        order = np.argsort(start - stop, kind="stable")
        n, mean, m2, total = (part[order] for part in state[:4])
        begin, lengths = start[order], (stop - start)[order]
        going = len(order)
        for step in range(int(lengths[0])):
            while lengths[going - 1] <= step:
                going -= 1
            row, g = begin[:going] + step, slice(0, going)
            v, ok = x[row], there[row]
            n[g] += ok
            delta = v - mean[g]
            after = mean[g] + delta / np.maximum(n[g], 1)
            m2[g] += np.where(ok, delta * (v - after), 0.0)
            mean[g] = np.where(ok, after, mean[g])
            total[g] += v
        for part, done in zip(state[:4], (n, mean, m2, total), strict=False):
            part[order] = done
        lead = batch.select(range(keys + 3))
        lead = pa.RecordBatch.from_arrays([*(c.take(pa.array(start)) for c in lead.columns[:keys]), *(c.take(pa.array(stop - 1)) for c in lead.columns[keys:])], schema=lead.schema)
        last = len(start) - 1
        if last:
            yield out(lead.slice(0, last), [part[:last] for part in state])
        held = lead.slice(last), [part[last:] for part in state]
    if held is not None:
        yield out(*held)


def running(observed: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """by, the last arrival's entity_type, timestamp and arrival_seq, rows, and lists n, m, d: count, mean and population deviation of each value.

    Taken in the order of arrival, one observation after the other, as an online store takes them: so they are the
    same doubles however the rows are dealt out, and a z-score that lies on a threshold does not change its side.
    """
    ordered = observed.select(*by, "entity_type", "timestamp", "arrival_seq", *values, "event_id").repartition(*by).sortWithinPartitions(*by, "arrival_seq", "event_id").drop("event_id")
    kinds = dict(ordered.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, "entity_type", "timestamp", "arrival_seq"]) + ", rows long, n array<long>, m array<double>, d array<double>"
    return ordered.mapInArrow(lambda batches: _folded(batches, len(by)), schema)


def baselines(vectors: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Per entity: observation count, mean and population deviation of each feature.

    Where the features' names are given (all others are then left out), each is a column and every vector stays one
    row; without them every vector becomes a row for each feature.
    """
    if names is not None:
        known = sorted(names)
        values = [f"f{i}" for i in range(len(known))]
        wide = distinct_events(vectors).select("entity_id", "entity_type", "timestamp", "arrival_seq", "event_id", *(F.try_element_at("features", F.lit(n)).alias(f) for n, f in zip(known, values, strict=True)))
        out = running(wide, ["entity_id"], values)
        there = F.filter(F.array(*(F.when(F.col("n")[i] > 0, F.struct(F.lit(n).alias("k"), F.col("m")[i].alias("m"), F.col("d")[i].alias("d"))) for i, n in enumerate(known))), lambda x: x.isNotNull())
        out = out.withColumn("x", there).withColumn("observation_count", F.array_max("n"))
        column = lambda c: F.map_from_arrays(F.transform("x", lambda x: x["k"]), F.transform("x", lambda x: x[c]))
        return out.where("observation_count > 0").select("entity_id", "entity_type", "observation_count", F.transform("x", lambda x: x["k"]).alias("feature_names"), column("m").alias("means"), column("d").alias("standard_deviations"), F.col("timestamp").alias("updated_at"))
    long = distinct_events(vectors).select("entity_id", "entity_type", "timestamp", "arrival_seq", "event_id", F.explode("features").alias("feature", "value"))
    each = running(long, ["entity_id", "feature"], ["value"]).withColumns({"mean": F.col("m")[0], "deviation": F.col("d")[0]})
    names = F.array_sort(F.collect_list("feature"))
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", c))))
    return each.groupBy("entity_id").agg(
        F.max(F.struct("arrival_seq", "entity_type", "timestamp")).alias("last"), F.max("rows").alias("observation_count"), names.alias("feature_names"), as_map("mean").alias("means"), as_map("deviation").alias("standard_deviations")
    ).select("entity_id", "last.entity_type", "observation_count", "feature_names", "means", "standard_deviations", F.col("last.timestamp").alias("updated_at"))


def update_baselines(seen: DataFrame, arriving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations now, those that are new by event_id)."""
    new = distinct_events(arriving).join(seen.select("event_id"), "event_id", "left_anti")
    return seen.unionByName(new), new


def update_many(seen: DataFrame, arriving: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(observations now, baselines by entity, how many observations were new)."""
    now, new = update_baselines(seen, arriving)
    return now, baselines(now).orderBy("entity_id"), new.count()


def register(known: DataFrame | None, baseline: DataFrame, entity_id: str) -> DataFrame:
    """known with the one baseline of entity_id added or replaced."""
    ids = [r["entity_id"] for r in baseline.select("entity_id").limit(2).collect()]
    if ids != [entity_id]:
        raise ValueError(f"the baseline is of {ids}, not of {entity_id}")
    return baseline if known is None else known.where(F.col("entity_id") != entity_id).unionByName(baseline)


def z_scores(features: Column, means: Column, deviations: Column) -> Column:
    """Structs of the features that the baseline knows, by falling |z|, then by name."""
    names = F.array_sort(F.array_intersect(F.map_keys(features), F.map_keys(means)))

    def one(name: Column) -> Column:
        x, m, s = F.element_at(features, name), F.element_at(means, name), F.coalesce(F.try_element_at(deviations, name), F.lit(0.0))
        return F.struct(name.alias("feature_name"), x.alias("observed_value"), m.alias("baseline_mean"), s.alias("baseline_standard_deviation"), F.when(s == 0, 0.0).otherwise((x - m) / F.when(s != 0, s)).alias("z_score"))

    ordered = F.array_sort(F.transform(F.transform(names, one), lambda x: F.struct((-F.abs(x["z_score"])).alias("o"), x["feature_name"].alias("n"), x.alias("x"))))
    return F.transform(ordered, lambda x: x["x"])


def score(vectors: DataFrame, known: DataFrame, threshold: float = 3.0, minimum_observations: int = 2) -> DataFrame:
    """Anomaly scores of the vectors whose entity has a baseline: the largest |z| of a vector."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    both = vectors.join(small(known.select("entity_id", "observation_count", "means", "standard_deviations")), "entity_id")
    both = both.withColumn("z", z_scores(F.col("features"), F.col("means"), F.col("standard_deviations")))
    value = F.coalesce(F.abs(F.get("z", F.lit(0))["z_score"]), F.lit(0.0))
    return both.select(
        "arrival_seq", "event_id", "entity_id", value.alias("score"), ((F.col("observation_count") >= minimum_observations) & (value >= threshold)).alias("is_anomalous"), F.col("z").alias("features"),
        F.transform(F.slice("z", 1, 3), lambda x: x["feature_name"]).alias("top_contributors"), F.col("observation_count").alias("baseline_observation_count"),
    )


def unknown_entities(vectors: DataFrame, known: DataFrame) -> DataFrame:
    return vectors.join(small(known.select("entity_id")), "entity_id", "left_anti")


def prequential(vectors: DataFrame, feature: str) -> DataFrame:
    """Each event's z against its entity's strictly earlier events."""
    w = Window.partitionBy("entity_id").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, -1)
    x = F.col("features")[feature]
    out = distinct_events(vectors).withColumns({"n": F.count(F.lit(1)).over(w), "mean": F.avg(x).over(w), "deviation": F.stddev_pop(x).over(w)})
    return out.select("event_id", "entity_id", "n", F.when(F.coalesce("deviation", F.lit(0.0)) == 0, 0.0).otherwise((x - F.col("mean")) / F.nullif("deviation", F.lit(0.0))).alias("z"))


def confusion(predictions: DataFrame, by: Iterable[str] = ("detector",)) -> DataFrame:
    """Per detector (boolean columns predicted, is_anomalous): counts, precision, recall and F1."""
    p, a = F.col("predicted"), F.col("is_anomalous")
    out = predictions.groupBy(*by).agg(F.count_if(p & a).alias("true_positives"), F.count_if(~p & ~a).alias("true_negatives"), F.count_if(p & ~a).alias("false_positives"), F.count_if(~p & a).alias("false_negatives"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives")), "recall": ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_negatives"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_detector(metrics: DataFrame) -> DataFrame:
    """The best by F1, recall, precision; of equals the first by position."""
    return metrics.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "position").limit(1)


class IsolationForest:
    """Liu, Ting and Zhou's isolation forest in numpy: random splits, score 2 ** (-depth / c).

    All trees grow together, a level at a time. Nodes of all trees lie in one table; node i < trees is tree i's root.
    """

    def __init__(self, trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42):
        if trees < 1 or not 0 < contamination < 0.5:
            raise ValueError("trees must be positive and contamination between 0 and 0.5")
        self.trees, self.sample, self.contamination, self.seed = trees, sample, contamination, seed

    @staticmethod
    def _c(n):
        n = np.asarray(n, float)
        large = np.maximum(n, 3)
        return np.where(n > 2, 2 * (np.log(large - 1) + 0.5772156649) - 2 * (large - 1) / large, n == 2)

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
        """Grow the forest; where every tree has every row, the sum of each row's depths."""
        everyone = self.n == len(x)
        rows = np.tile(np.arange(len(x)), self.trees) if everyone else np.concatenate([rng.choice(len(x), self.n, False, shuffle=False) for _ in range(self.trees)])
        used = np.flatnonzero(x.max(0) > x.min(0))
        wide = np.ascontiguousarray(x[:, used].T)
        first, size = np.arange(self.trees) * self.n, np.full(self.trees, self.n)  # each node's rows
        depths, levels, made = np.zeros(len(x)), [], 0
        for depth in range(self.levels + 1):
            count = len(size)
            feature, cut, left = np.full(count, -1), np.zeros(count), np.zeros(count, np.int64)
            if depth < self.levels and len(used):
                some = np.flatnonzero(size > 1)
                inside = np.repeat(size > 1, size)
                at, of = rows[inside], np.repeat(np.arange(len(some)), size[some])
                start = np.cumsum(size[some]) - size[some]
            else:
                some = np.zeros(0, np.int64)
            if len(some):
                values = wide[:, at]
                low, high = np.minimum.reduceat(values, start, 1), np.maximum.reduceat(values, start, 1)
                spread = high > low
                kinds = spread.sum(0)
                chosen = (spread.cumsum(0) > (rng.random(len(some)) * kinds).astype(np.int64)).argmax(0)
                each = np.arange(len(some))
                low, high = low[chosen, each], high[chosen, each]
                splits = kinds > 0
                feature[some[splits]] = used[chosen[splits]]
                cuts = low + (high - low) * rng.random(len(some))
                cut[some[splits]] = cuts[splits]
                left[some[splits]] = made + count + 2 * np.arange(int(splits.sum()))
            done = feature < 0
            value = depth + self._c(size)
            if everyone:
                leaf = np.repeat(done, size)
                depths += np.bincount(rows[leaf], np.repeat(value, size)[leaf], len(x))
            levels.append((feature, cut, left, value))
            if done.all():
                break
            # the rows of nodes that split, by child
            on = splits[of]
            child = 2 * (np.cumsum(splits) - 1)[of[on]] + (values[chosen[of[on]], np.flatnonzero(on)] >= cuts[of[on]])
            rows = at[on][np.argsort(child, kind="stable")]
            size = np.bincount(child, minlength=2 * int(splits.sum()))
            made += count
        self.forest = tuple(np.concatenate(part) for part in zip(*levels, strict=True))
        return depths if everyone else None

    def fit(self, x: np.ndarray) -> IsolationForest:
        self.fit_score(x)
        return self

    def fit_score(self, x: np.ndarray) -> np.ndarray:
        """Fit, and the scores of the same rows: where a tree has them all, they are known from its growth."""
        if len(x) < 2:
            raise ValueError("at least two vectors are needed")
        rng, self.n = np.random.default_rng(self.seed), min(self.sample, len(x))
        depths = self._grow(np.asarray(x, float), rng)
        raw = self.raw(x) if depths is None else self._raw(depths)
        self.offset = float(np.quantile(raw, 1 - self.contamination))
        return raw - self.offset

    @property
    def levels(self) -> int:
        return math.ceil(math.log2(max(self.n, 2)))

    def _raw(self, depths: np.ndarray) -> np.ndarray:
        return 2 ** (-depths / self.trees / max(float(self._c(self.n)), 1e-9))

    def raw(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        feature, cut, left, value = self.forest
        splits, used, total = feature >= 0, np.maximum(feature, 0), np.zeros(len(x))
        left = np.where(splits, left, np.arange(len(left)))  # a leaf leads to itself
        for a in range(0, len(x), rows):
            part = np.asarray(x[a : a + rows], float)
            row, node = np.arange(len(part)), np.repeat(np.arange(self.trees)[:, None], len(part), 1)
            for _ in range(self.levels):
                node = left[node] + (splits[node] & (part[row, used[node]] >= cut[node]))
            total[a : a + rows] = value[node].sum(0)
        return self._raw(total)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Above 0: anomalous."""
        return self.raw(x) - self.offset

    def metadata(self, entity_id: str, names: list[str], count: int) -> dict:
        return {"detector": "isolation_forest", "entity_id": entity_id, "feature_names": names, "observation_count": count, "trees": self.trees, "contamination": self.contamination, "seed": self.seed}

    def save(self, path: str, entity_id: str, names: list[str], count: int) -> None:
        """The fitted forest as a checksummed artifact."""
        if not hasattr(self, "forest"):
            raise RuntimeError("fit the forest before saving it")
        content = {"sample": self.sample, "n": self.n, "offset": self.offset, "nodes": [part.tolist() for part in self.forest], "metadata": self.metadata(entity_id, names, count)}
        save_artifact(path, json.loads(json.dumps(content, default=float)), artifact="isolation_forest")

    @classmethod
    def load(cls, path: str, entity_id: str | None = None) -> tuple[IsolationForest, dict]:
        """(forest, metadata); the checksum must hold, and the entity be the one asked for."""
        content = load_artifact(path)
        facts = content["metadata"]
        if entity_id is not None and facts["entity_id"] != entity_id:
            raise ValueError(f"the forest is of {facts['entity_id']}, not of {entity_id}")
        out = cls(facts["trees"], content["sample"], facts["contamination"], facts["seed"])
        nodes = content["nodes"] if "nodes" in content else cls._table(content["forest"])
        out.n, out.offset, out.forest = content["n"], content["offset"], tuple(np.array(part, kind) for part, kind in zip(nodes, (np.int64, float, np.int64, float), strict=True))
        return out, facts

    @classmethod
    def _table(cls, forest: list) -> list[list]:
        """The nodes of an artifact that has trees as nested lists (feature, cut, left, right), leaves as their size."""
        table, level, depth = [], list(forest), 0
        while level:
            below = []
            for node in level:
                leaf = not isinstance(node, list)
                table.append((-1, 0.0, 0, depth + float(cls._c(node))) if leaf else (int(node[0]), node[1], (depth, len(below)), 0.0))
                below += [] if leaf else node[2:]
            table = [(f, c, len(table) + at[1] if isinstance(at, tuple) else at, v) for f, c, at, v in table]
            level, depth = below, depth + 1
        return [list(part) for part in zip(*table, strict=True)]


def _matrix(column: pa.ChunkedArray, names: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """(names, a row for each map); without names the sorted ones of the first map. What a map lacks is 0."""
    maps = pa.concat_arrays(column.chunks)
    at = maps.offsets.to_numpy()
    keys, items = maps.keys.slice(at[0], at[-1] - at[0]), maps.items.slice(at[0], at[-1] - at[0])
    width = int(at[1] - at[0])
    first = keys.slice(0, width).to_pylist()
    names = sorted(first) if names is None else names
    if width and not maps.null_count and (np.diff(at) == width).all():
        codes = keys.dictionary_encode().indices.to_numpy().reshape(-1, width)
        if (codes == codes[0]).all() and set(names) <= set(first):  # maps of one kind
            values = items.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
            return names, values[:, [first.index(n) for n in names]]
    return names, np.array([[found.get(n) or 0.0 for n in names] for found in (dict(m or ()) for m in maps.to_pylist())])


def isolation_scores(train: DataFrame, vectors: DataFrame, trees: int = 100, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Per entity a forest over its training vectors; entities with fewer than two are left out.

    An entity's vectors are fitted in one task, on a sample of 256 a tree. Where both frames are one, it is read once.
    """
    schema = pa.schema([("event_id", pa.string()), ("entity_id", pa.string()), ("score", pa.float64()), ("is_anomalous", pa.bool_())])

    def run(fit: pa.Table, rows: pa.Table | None) -> pa.Table:
        if len(fit) < 2 or (rows is not None and not len(rows)):
            return schema.empty_table()
        fit = fit.sort_by("event_id")  # so that a seed gives the same forest however the rows came
        names, matrix = _matrix(fit["features"])
        forest = IsolationForest(trees, contamination=contamination, seed=seed)
        if rows is None:
            rows, value = fit, forest.fit_score(matrix)
        else:
            value = forest.fit(matrix).score(_matrix(rows["features"], names)[1])
        return pa.Table.from_arrays([rows["event_id"].cast(pa.string()), rows["entity_id"].cast(pa.string()), pa.array(value), pa.array(value > 0)], schema=schema)

    out = "event_id string, entity_id string, score double, is_anomalous boolean"
    keep = ["event_id", "entity_id", "features"]
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in keep)).groupBy("entity_id")  # noqa: E731  both may come from one frame
    if train is vectors:
        return fresh(train).applyInArrow(lambda fit: run(fit, None), out)
    return fresh(train).cogroup(fresh(vectors)).applyInArrow(run, out)


def run_fixture(labeled: DataFrame, training_count: int = 2, isolation: bool = True) -> dict:
    """Train on the first rows by arrival, evaluate both detectors on the rest."""
    total = labeled.count()
    if not 1 <= training_count < total:
        raise ValueError("training_count must leave rows to evaluate")
    ranked = labeled.withColumn("__n", F.row_number().over(Window.orderBy("arrival_seq")))  # a fixture's few rows
    train, test = ranked.where(F.col("__n") <= training_count), ranked.where(F.col("__n") > training_count)
    first = train.orderBy("__n").first()["entity_id"]
    z = score(test, baselines(train.where(F.col("entity_id") == first)), minimum_observations=1)
    found, skipped = [("z_score", z)], []
    if isolation and training_count >= 2:
        found.append(("isolation_forest", isolation_scores(train, test, trees=50)))
    elif isolation:
        skipped.append("isolation_forest")
    rows = []
    for position, (name, scores) in enumerate(found):
        predicted = test.join(scores.select("event_id", F.col("is_anomalous").alias("predicted")), "event_id").withColumn("detector", F.lit(name))
        rows.append(confusion(predicted).withColumn("position", F.lit(position)))
    metrics = rows[0]
    for other in rows[1:]:
        metrics = metrics.unionByName(other)
    metrics = metrics.orderBy("position")
    best = best_detector(metrics).first()
    return {"metrics": [r.asDict() for r in metrics.collect()], "best": best["detector"] if best else None, "skipped_estimators": skipped}
