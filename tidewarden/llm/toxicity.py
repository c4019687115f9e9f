"""Operator 9, toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labels are learned from a bounded sample of labelled rows (TRAIN_ROWS, chosen by a hash of doc_id).
The lexicon is learned from the same rows: words, and stems (prefixes of four to six letters), that
toxic texts use far more often than others. Every text of the corpus is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_text, documents, lean, unused, written

#: The most labelled rows that are used for learning.
TRAIN_ROWS = 24_000
LEXICON = 4_000
THRESHOLD = 0.7
#: Second-person words of the corpus's languages: fixed values.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vosotros vuestro su".split())
LEET = str.maketrans("0134578@$!", "oieastbasi")
WORD = re.compile(r"[^\W_]+")
ODD = re.compile(r"[^\W\d_]+[0-9@$!*#][\w@$!*#]*[^\W\d_]")
FEATURES = ["log_words", "hits", "density", "stem_hits", "stem_density", "weight", "near", "near_share", "capitals", "marks", "obfuscated", "uncovered", "distinct"]


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float | None = 0.0


def keys(word: str) -> list[str]:
    return [word[:n] + "*" for n in (4, 5, 6) if len(word) > n]


def features(text: str, model: Model, cache: dict[str, tuple[float, float]]) -> list[float]:
    """Dense features; all of them 0 for a text without words."""
    words = WORD.findall(text.lower())
    if not words:
        return [0.0] * len(FEATURES)
    n, marked = len(words), {}
    for w in set(words):
        got = cache.get(w)
        if got is None:
            if len(cache) > 300_000:
                cache.clear()
            got = cache[w] = (model.words.get(w, 0.0), max((model.stems.get(k, 0.0) for k in keys(w)), default=0.0))
        if got[0] or got[1]:
            marked[w] = got
    hits = stems = near = 0
    weight, kinds = 0.0, len(marked)
    if marked:
        for i, w in enumerate(words):
            if w in marked:
                a, b = marked[w]
                hits += a > 0
                stems += b > 0
                weight += max(a, b)
                near += any(x in SECOND for x in words[max(0, i - 5) : i + 6])
    letters = sum(map(len, words)) or 1
    odd = [x for x in ODD.findall(text) if not x.isalnum() or not x[-1].isdigit()]
    uncovered = sum(any(y in model.words for y in WORD.findall(x.lower().translate(LEET))) for x in odd)
    return [np.log1p(n), hits, hits / n, stems, stems / n, weight, near, near / max(1, hits, stems), sum(map(str.isupper, text)) / letters, (text.count("!") + text.count("?")) / n, len(odd) / n, uncovered, kinds]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def grow(x: np.ndarray, edges: list[np.ndarray], bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A complete binary tree of the given depth: feature and threshold of inner nodes, leaf values."""
    inner = (1 << depth) - 1
    feature, cut, node = np.full(inner, -1), np.zeros(inner), np.zeros(len(x), np.int64)
    for at in range(inner):
        rows = np.flatnonzero(node == at)
        best = (1e-6, -1, 0)
        if len(rows) >= 2 * least:
            g, h = grad[rows].sum(), hess[rows].sum()
            for f in range(x.shape[1]):
                size = len(edges[f]) + 1
                b = bins[rows, f]
                gl, hl, c = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(c < least) | (len(rows) - c < least)] = 0
                if size > 1 and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] >= 0:
            feature[at], cut[at] = best[1], edges[best[1]][best[2]]
        node[rows] = 2 * at + 1 + (bins[rows, best[1]] > best[2] if best[1] >= 0 else 0)
    leaf = node - inner
    g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
    return feature, cut, -g / (h + 1)


def raw_scores(x: np.ndarray, model: Model) -> np.ndarray:
    out = np.full(len(x), model.base)
    for feature, cut, value in model.trees:
        node = np.zeros(len(x), np.int64)
        for _ in range((len(feature) + 1).bit_length() - 1):
            f = feature[node]
            node = 2 * node + 1 + ((f >= 0) & (x[np.arange(len(x)), f] > cut[node]))
        out += value[node - len(feature)]
    return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and levels of the non-decreasing fit."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([v, 1.0, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _ = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
    return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])


def boost(x: np.ndarray, y: np.ndarray, fold: np.ndarray, model: Model, trees: int = 60, depth: int = 3, rate: float = 0.2) -> Model:
    """Fit trees on fold != 0 and the calibration on fold == 0."""
    if not len(y) or y.min() == y.max():
        model.constant = float(y[0]) if len(y) else 0.0
        return model
    model.constant = None
    fit = fold != 0 if 0 < y[fold != 0].mean() < 1 else np.ones(len(y), bool)
    held = fold == 0 if (fold == 0).sum() >= 20 and 0 < y[fold == 0].mean() < 1 else np.ones(len(y), bool)
    a, b = x[fit], y[fit]
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in a.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, a.T, strict=True)], 1)
    model.base = float(np.log(b.mean() / (1 - b.mean())))
    raw = np.full(len(b), model.base)
    for _ in range(trees):
        p = sigmoid(raw)
        feature, cut, value = grow(a, edges, bins, p - b, p * (1 - p), depth)
        model.trees.append((feature, cut, rate * value))
        raw += raw_scores(a, Model(trees=model.trees[-1:]))
    model.knots, model.levels = isotonic(raw_scores(x[held], model), y[held])
    return model


def probability(x: np.ndarray, model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(x), model.constant)
    raw = raw_scores(x, model)
    # a touch of the raw score keeps the order within a level
    return np.clip(0.97 * np.interp(raw, model.knots, model.levels) + 0.03 * sigmoid(raw), 0, 1)


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(WORD.findall(text.lower()))
            seen[toxic].update(words)
            seen[toxic].update({k for w in words for k in keys(w)})
    # what only clean texts use can't enter the lexicon, but must be counted where toxic ones use it too
    for toxic in (0, 1):
        found = list(seen[toxic].items())
        for a in range(0, len(found), 20_000):
            part = found[a : a + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([n * (toxic == 0) for _, n in part], pa.int64()), pa.array([n * toxic for _, n in part], pa.int64())], names=["key", "clean", "toxic"])


def _features(shared):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            x = [features(t, shared.value, cache) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "toxic", "fold"])

    return run


def _score(shared):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                x = np.array([features(t, shared.value, cache) for t in batch.column(1)[a : a + 1000].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + 1000], pa.array(probability(x, shared.value))], names=["doc_id", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 3 is 1; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows that aren't held out. Without any: a model that scores 0."""
    spark = docs.sparkSession
    labels = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("double").alias("toxic")).where("id is not null and toxic in (0, 1)").withColumn("toxic", F.col("toxic").cast("int"))
    chosen = labels.where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = doc_text(docs)
    # of rows that share a doc_id one is learned from, so that TRAIN_ROWS bounds rows too
    each = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["id"]).groupBy("id", "toxic").agg(F.max("text").alias("text"))
    sample = written(each.select("text", "toxic", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)).cast("int").alias("fold")), "sample")
    # folds 1 to 3 make the lexicon, so that fold 0 can calibrate
    fit = sample.where("fold <> 0")
    size = fit.agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    model = Model()
    if size["toxic"] and size["clean"]:
        counts = fit.select("text", "toxic").mapInArrow(_count, "key string, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        odds = F.log((F.col("toxic") + 0.5) / size["toxic"]) - F.log((F.col("clean") + 0.5) / size["clean"])
        least = max(4, size["toxic"] // 400)
        found = counts.where(F.col("toxic") >= least).withColumn("odds", odds).where("odds > 3").orderBy(F.desc("toxic"), "key").limit(LEXICON).collect()
        model.words = {r["key"]: r["odds"] for r in found if r["key"][-1] != "*"}
        model.stems = {r["key"]: r["odds"] for r in found if r["key"][-1] == "*"}
    rows_ = sample.mapInArrow(_features(spark.sparkContext.broadcast(model)), "x array<double>, toxic int, fold int").toPandas()
    x = np.array(rows_["x"].tolist()).reshape(len(rows_), len(FEATURES))
    return boost(x, rows_["toxic"].to_numpy(float), rows_["fold"].to_numpy(), model)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any other (all features 0). Rows that repeat come out
    repeated. labels may have nulls, repeats (the larger label holds), ids without a document, and values
    other than 0 and 1, which teach nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    out = doc_text(docs).mapInArrow(_score(shared), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _append(shared, schema: pa.Schema, fields: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                x = np.array([features("" if t is None else t, shared.value, cache) for t in part.column(fields).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:fields], pa.array(probability(x, shared.value))], schema=schema)

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns, whatever their names; nulls as in score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    text, value = unused(docs, "__text"), unused(docs, "__score")
    schema = T.StructType([*docs.schema.fields, T.StructField(value, T.DoubleType())])
    out = docs.withColumn(text, F.col("text").cast("string")).mapInArrow(_append(shared, to_arrow_schema(schema), len(docs.columns)), schema)
    return out.where(F.col(value) < threshold).drop(value)
