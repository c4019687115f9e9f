"""Shared pieces: the shared scratch folder, written tables, word hashing, connected components.

Scratch tables go to the folder named by ``spark.checkpoint.dir`` so that every executor and the
driver can read them after any executor is lost.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that is ever broadcast; every use has a shuffle join beyond it.
BROADCAST_ROWS = 400_000

#: Where ``written`` notes its tables, if a caller wants to delete them later; see ``noted``.
_noted: ContextVar[list[str] | None] = ContextVar("_noted", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset: on a local master a temporary folder, on a cluster one beside the tables of
    the warehouse, which all machines see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        root = tempfile.gettempdir() if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        found = f"{root}/tidewarden-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewarden/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (paths := _noted.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Within it, ``written`` adds the paths of its tables to the caller's own list."""
    before = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(before)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables and empty the list. Call only when no result still reads them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """name, or with as many underscores after it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if it has at most ``limit`` rows; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows that go to a Python worker at a time: whole texts, so a batch of many would be large.
BATCH_ROWS = 2000


def doc_text(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text), whatever other columns there are; a null text counts as empty.

    Also bounds the session's Arrow batches, unless they are smaller already.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


#: What a Python worker holds from task to task, until a task comes that has no use for it; see ``lean``.
kept: dict[str, object] = {}
#: Bytes that a worker may have grown by after a task before it gives back what is free.
SPARE = 32 << 20
_after = 0


def _resident() -> int:
    """Bytes of this process in memory; 0 where the system doesn't tell."""
    try:
        with open("/proc/self/statm", "rb") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:
        return 0


def _release() -> None:
    """Give free memory of Arrow's pool and the C library back to the system."""
    global _after
    pa.default_memory_pool().release_unused()
    if _resident() and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)
    _after = _resident()


def _begin(keep: bool) -> None:
    if kept and not keep:
        kept.clear()
        _release()


def _end() -> None:
    if _resident() > _after + SPARE:
        _release()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow map after which its worker is no larger than it has to be.

    Spark keeps idle workers beside the executor's JVM, and memory that a task has freed stays with
    the worker unless it is given back. keep: the tasks use what is in ``kept``; others drop it.
    """

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(keep)  # functions of the module: a pickled copy of this one would have globals of its own
        try:
            yield from run(batches)
        finally:
            _end()

    return whole


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the well-known murmur3 constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Bytes hashed at a time.
BUFFER = 1 << 20
_POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(BUFFER, 0x9E3779B97F4A7C15, np.uint64))))
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_VALUES[65:91] = _VALUES[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_GAP = re.compile(rb"[ \t-\r]")


def _hash_buffer(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words: a polynomial over random byte values from one running sum."""
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[raw], [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * _POWERS[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _POWERS[BUFFER - starts]), starts


def _hash_long(data: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        end = at + BUFFER
        if end < len(data):
            back = max(data.rfind(bytes([c]), at, end) for c in (32, *range(9, 14)))
            if back <= at:  # a single word fills the buffer
                gap = _GAP.search(data, at + 1)
                end = gap.start() if gap else len(data)
                if not _BLANK[data[at]]:
                    out.append(np.array([xxhash.xxh3_64_intdigest(data[at:end].lower())], np.uint64))
                    at = end
                    continue
                end = at + 1
            else:
                end = back
        out.append(_hash_buffer(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's begin (one more at the end).

    Words are runs of other than space and \\t-\\r; A-Z count as a-z.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    held: list[bytes] = []
    first = size = 0

    def flush(upto: int) -> None:
        found, starts = _hash_buffer(b" ".join(held))
        bounds = np.cumsum([0, *(len(x) + 1 for x in held)])
        counts[first + 1 : upto + 1] = np.diff(np.searchsorted(starts, bounds))
        hashes.append(found)

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if held and size + len(data) + 1 > BUFFER:
            flush(i)
            held, size = [], 0
        if not held:
            first = i
        if len(data) >= BUFFER:
            long = _hash_long(data)
            hashes.append(long)
            counts[i + 1] = len(long)
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def _combined(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n + j]
        h ^= h >> np.uint64(29)
    return mix(h)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of k-word shingles; of the whole sequence if it is shorter."""
    hashes, at = hashed_words(texts)
    every = _combined(hashes, k) if len(hashes) >= k else hashes
    return [distinct(every[a : b - k + 1]) if b - a >= k else _combined(hashes[a:b], b - a) if b > a else hashes[:0] for a, b in zip(at[:-1], at[1:], strict=True)]


def sketch(members: np.ndarray) -> np.ndarray:
    """Dense parity sketch of 4 to 8 bits a member: bit i is the parity of the members that hash to i.

    Its halves, one XORed onto the other, are the sketch of half the length.
    """
    bits = max(64, 4 << len(members).bit_length())
    parity = (np.bincount((mix(members ^ np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


#: Edges that one task joins up by itself.
LOCAL_EDGES = 500_000


@lean
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one task's edges: each node with the smallest node of its local component."""
    root: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for x in (u, v):
                root.setdefault(x, x)
            while root[u] != u:
                root[u] = u = root[root[u]]
            while root[v] != v:
                root[v] = v = root[root[v]]
            root[max(u, v)] = min(u, v)
    found = []
    for x in root:
        r = x
        while root[r] != r:
            r = root[r]
        if r != x:
            found.append((x, r))
    for a in range(0, len(found), 100_000):
        u, v = zip(*found[a : a + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(a, b) links of long ids -> (node, root) with root the component's smallest node.

    Distributed union-find: tasks of at most ``local`` edges join up what they hold, which leaves one
    edge a node and task; then alternating large-star and small-star steps until nothing changes.
    Each step is a grouped minimum (combined before the shuffle) joined back, so a node with very
    many links is never gathered in one task. Edges that fit one task need no steps. Nodes without
    links don't appear. Self links and nulls are ignored.
    """
    pairs = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    tasks = max(1, -(-pairs.count() // local))
    state = written(pairs.coalesce(tasks).mapInArrow(_forest, "u long, v long"), "edges")
    mark = None
    while tasks > 1:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        state = written(star.distinct(), "edges")
        now = state.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)"), F.expr("coalesce(sum(cast(xxhash64(v, u) as decimal(38,0))), 0)")).first()
        if now == mark:
            break
        mark = now
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


#: DuckDB: a document's text with A-Z lower-cased.
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
