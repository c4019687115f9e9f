"""Operator 3, n-gram Jaccard join by parity sketches.

A document's set holds its distinct five-word shingles, as 64-bit hashes; documents of one set are
one node, whose id is the set's digest. Similarity J >= 0.75 of sets of a and b members bounds their
symmetric difference by d <= (a + b) / 7.

* Parity sketch: every member toggles one bit of a very long, sparse bit vector that is cut into
  blocks; a block is carried as the XOR of its members' hashes. A member of the symmetric difference
  changes one block, so the number of blocks that differ is a Hamming distance that never exceeds d.
* Size bands: band k compares sets whose larger one has 2^k to 2^(k+1) - 1 members. A set is keyed
  in its own band, and in the next if a partner may lie there.
* Pigeonhole: of two linked sets at most d blocks of either differ from the other's. So if both list
  their blocks in one global order and key the first d + 1, they share a key. The order puts blocks
  made of frequent shingles only last, so passages that many documents share seldom become keys.
  Which shingles count as frequent steers cost alone; links don't depend on it.
* Verification: a short dense parity sketch (4 to 8 bits a member; XOR and bit_count) first refutes
  pairs by the same bound; the rest are intersected exactly.

Sets of a few members are keyed member by member. From 32 members on a band has at least twice as
many blocks as must be occupied; that a set occupies fewer than d + 1 has a chance below 1e-16.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keyjoin
from .common import LOWER_SQL, distinct, doc_text, documents, lean, mix, parts, shingle_sets, signed, sketch, small, written

WORDS = 5
PERCENT = 75
#: Most shingles that are taken as frequent, and so broadcast (8 bytes each).
FREQUENT = 500_000
#: A shingle is frequent from so many texts on, counted in parts of PART texts that repeat it.
OFTEN = 16
PART = 4000
META = "doc_id long, node long, n long, keys long, sketch array<long>, often binary"
META_ARROW = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("keys", pa.int64()), ("sketch", pa.list_(pa.int64())), ("often", pa.binary())])
SETS = "node long, members array<long>"


def node_of(members: np.ndarray) -> np.int64:
    """The set's id: equal sets have one."""
    return mix(np.array([np.add.reduce(mix(members)) ^ np.uint64(len(members))]))[0].view(np.int64)


def bands(n: int) -> list[tuple[int, int]]:
    """(band, number of blocks to key) of a set of n members."""
    k = n.bit_length() - 1
    top = (2 << k) - 1
    own = [(k, (n + min(4 * n // 3, top)) // 7 + 1)]
    return [*own, (k + 1, n // 3 + 1)] if 4 * n >= 3 * (top + 1) else own


def block_keys(members: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The keys of a set in all its bands."""
    often = np.zeros(len(members), np.uint64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
        often = (frequent[at] == members).astype(np.uint64)
    out = []
    for k, most in bands(len(members)):
        seed = np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        # the top bits name the block, the lowest bit says whether the member is frequent
        h = np.sort(mix(members ^ seed) & ~np.uint64(1) | often)
        if k < 5:
            value, usual = h, h & np.uint64(1)
        else:
            block = h >> np.uint64(64 - k - (2 if k < 8 else 0))
            start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            value = np.bitwise_xor.reduceat(mix(h), start) + block[start]
            usual = np.bitwise_and.reduceat(h, start) & np.uint64(1)
        first = np.concatenate((np.flatnonzero(usual == 0), np.flatnonzero(usual)))[:most]
        out.append(mix(value[first] ^ seed))
    return np.concatenate(out)


@lean
def _meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once: dict[int, np.ndarray] = {}
    seen = 0

    def repeats() -> bytes | None:
        """Shingles that several distinct sets of this part of the corpus have, and how many."""
        every = np.sort(np.concatenate(list(once.values()))) if once else np.zeros(0, np.uint64)
        often = distinct(every[1:][every[1:] == every[:-1]])
        counts = np.searchsorted(every, often, "right") - np.searchsorted(every, often)
        once.clear()
        return often.tobytes() + counts.astype(np.uint64).tobytes()

    for batch in batches:
        docs, texts = batch.column(0), batch.column(1)
        for a in range(0, len(docs), 500):
            part = shingle_sets(texts[a : a + 500].to_pylist(), WORDS)
            node = [int(node_of(m)) if len(m) else None for m in part]
            once.update((x, m) for x, m in zip(node, part, strict=True) if x is not None)
            seen += len(part)
            blob = [None] * len(part)
            if seen >= PART:
                blob[0], seen = repeats(), 0
            yield pa.RecordBatch.from_arrays(
                [
                    docs[a : a + 500], pa.array(node, pa.int64()), pa.array([len(m) for m in part], pa.int64()), pa.array([sum(x for _, x in bands(len(m))) if len(m) else 0 for m in part], pa.int64()),
                    pa.array([sketch(m) if len(m) else None for m in part], pa.list_(pa.int64())), pa.array(blob, pa.binary()),
                ],
                schema=META_ARROW,
            )
    if once:  # a row of no document carries what is left
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 2 + [pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([None], pa.list_(pa.int64())), pa.array([repeats()], pa.binary())], schema=META_ARROW)


@lean
def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            both = np.frombuffer(blob, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["member", "count"])


def frequent_members(meta: DataFrame) -> np.ndarray:
    """Shingles counted OFTEN times or more where a part repeats them, the most frequent FREQUENT of them."""
    seen = meta.where("often is not null").select("often").mapInArrow(_unpack, "member long, count long").groupBy("member").agg(F.sum("count").alias("count"))
    rows = seen.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "member").limit(FREQUENT).select("member").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _keyed(shared, buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value

        def pairs():
            for batch in batches:
                for a in range(0, batch.num_rows, 500):
                    for members in shingle_sets(batch.column(0)[a : a + 500].to_pylist(), WORDS):
                        if len(members):
                            yield block_keys(members, frequent), node_of(members)

        yield from keyjoin.pack_stream(pairs(), buckets, TaskContext.get().partitionId() + 1)

    return run


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = shingle_sets(batch.column(1)[a : a + 500].to_pylist(), WORDS)
            node = batch.column(0)[a : a + 500].to_pylist()
            part = [m for m, x in zip(part, node, strict=True) if len(m) and node_of(m) == x]  # a repeated doc_id may bring another text
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(m) for m in part], pa.int64()), pa.array([signed(m) for m in part], pa.list_(pa.int64()))], names=["node", "members"]
            )


def hamming(a: str, b: str):
    """Of two sketches whose lengths differ by a factor of two at most."""
    half = lambda x, y: f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"
    return F.expr(f"aggregate(zip_with({half(a, b)}, {half(b, a)}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def bounds(nodes: DataFrame, percent: int = PERCENT):
    """A ``sieve`` for keyjoin.linked: pairs that sizes and sketches don't refute."""

    def sieve(pairs: DataFrame) -> DataFrame:
        size = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"))
        close = pairs.join(size("a"), "a").join(size("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        short = lambda s: nodes.select(F.col("node").alias(s), F.col("sketch").alias(f"k{s}"))
        both = close.join(short("a"), "a").join(short("b"), "b")
        return both.where(hamming("ka", "kb") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")

    return sieve


def verifier(texts: DataFrame, nodes: DataFrame, percent: int = PERCENT):
    """A ``verify`` for keyjoin.linked; nodes: node, doc_id of a text that has it, n, sketch."""

    def verify(near: DataFrame) -> DataFrame:
        need = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        need = written(need.join(nodes.select("node", F.col("doc_id").alias("first_id")), "node"), "need")
        docs = texts.join(small(need), F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text")
        sets = written(docs.mapInArrow(_sets, SETS), "sets")
        full = lambda s: sets.select(F.col("node").alias(s), F.col("members").alias(f"m{s}"))
        both = near.join(full("a"), "a").join(full("b"), "b").select("a", "b", F.size("ma").alias("na"), F.size("mb").alias("nb"), F.size(F.array_intersect("ma", "mb")).alias("i"))
        return both.where(f"100L * i >= {percent}L * (na + nb - i)").select("a", "b").distinct()

    return verify


def jaccard_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Words are runs of other than space and \\t-\\r after lower-casing A-Z. A text of fewer than five
    words is one shingle; without words (or null, or empty) it has none and is linked with nothing:
    its component_id is its own doc_id. Repeated rows come out repeated. Only doc_id and text are
    read. A null doc_id keeps its row; it never names a component that has another member.
    """
    spark = docs.sparkSession
    texts = doc_text(docs)
    meta = written(texts.mapInArrow(_meta, META), "meta")
    keys = meta.agg(F.sum("keys")).first()[0] or 0
    firsts = written(meta.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "sketch")).alias("x")).select("node", "x.doc_id", "x.n", "x.sketch"), "nodes")
    shared = spark.sparkContext.broadcast(frequent_members(meta))
    buckets = 8 * max(parts(spark), -(-keys // 4_000_000))
    pairs = texts.select("text").mapInArrow(_keyed(shared, buckets), keyjoin.PACKED)
    _, found = keyjoin.linked(keyjoin.groups(pairs, buckets), verifier(texts, firsts, percent), lambda need: need.join(firsts.select("node", "n", "sketch"), "node"), bounds(firsts, percent), percent)
    # the smallest doc_id of each component
    named = firsts.select("node", "doc_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    nodes = named.join(least, "root").select("node", "component_id")
    out = meta.where("node is not null").select("doc_id", "node", "n").join(nodes, "node").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = meta.where("node is null and n >= 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


SQL = rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
