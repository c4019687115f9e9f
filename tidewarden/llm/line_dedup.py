"""Operator 2, fuzzy line dedup over the whole corpus.

1. Lines are taken whole, stripped, A-Z lower-cased. A line's id is a hash of that; equal lines are
   one node from the start. Every line that isn't blank takes part; one of under SHINGLE characters is
   a single shingle that no other line has, so it has only its equals.
2. Each longer distinct line's character shingles (SHINGLE code points) get a MinHash signature of
   BANDS * ROWS values; lines that agree on all rows of a band are candidates. At a similarity of
   0.75 a pair is found with a chance of 0.98, at 0.8 with 0.995.
3. Candidates are verified by the exact Jaccard similarity of their shingle sets (see keyjoin).
4. Components by distributed union-find; of each the first line stays (smallest doc_id, then line).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import keyjoin
from .common import distinct, doc_text, documents, lean, mix, parts, sketch, small, unused, written

#: Characters of a shingle; see shingles.
SHINGLE = 8
PERCENT = 75
BANDS = 10
ROWS = 4
_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Most repeated lines (12 bytes each) that are broadcast to the texts that hold them.
BROADCAST_LINES = 2_000_000
#: Bytes of distinct lines whose signatures are taken together; small enough for a core's cache.
CHUNK = 1 << 17


def eligible(data: bytes) -> list[tuple[int, bytes]]:
    """(line number, normal form) of the lines that take part."""
    out = []
    for i, line in enumerate(data.lower().split(b"\n")):
        if line := line.strip():
            out.append((i, line))
    return out


def node_of(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def long_enough(line: bytes) -> bool:
    """Has it SHINGLE characters?"""
    return len(line) >= SHINGLE and (len(line) >= 4 * SHINGLE or line.isascii() or len(line.decode("utf-8", "replace")) >= SHINGLE)


def shingles(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of the lines that lie end to end in data, and each line's first.

    starts are bytes; every line has SHINGLE characters at least.
    """
    chars = np.frombuffer(data, np.uint8)
    if not data.isascii():
        begin = (chars & 0xC0) != 0x80  # bytes that begin a character
        starts = np.cumsum(begin)[starts] - 1
        chars = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    h = chars.astype(np.uint64) + np.uint64(1)
    for width in (1, 2, 4):  # a polynomial over twice as many characters each time
        h = h[:-width] * np.uint64(pow(int(_STEP), width, 1 << 64)) + h[width:]
    sizes = np.diff(np.append(starts, len(chars))) - SHINGLE + 1
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return mix(h[np.repeat(starts - first, sizes) + np.arange(sizes.sum())]), first


def band_keys(lines: list[bytes]) -> np.ndarray:
    """lines x BANDS keys."""
    out = []
    a = 0
    while a < len(lines):
        b, size = a, 0
        while b < len(lines) and (size < CHUNK or b == a):
            size += len(lines[b])
            b += 1
        starts = np.concatenate(([0], np.cumsum([len(x) for x in lines[a:b]])[:-1]))
        h, first = shingles(b"".join(lines[a:b]), starts)
        low = h.astype(np.uint32)
        value = np.empty_like(low)
        keys = np.empty((b - a, BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(b - a, band + 1, np.uint64)
            for k in range(band * ROWS, band * ROWS + ROWS):
                np.multiply(low, _MULTIPLY[k], out=value)  # low is mixed already
                key = mix(key * _STEP + np.minimum.reduceat(value, first))
            keys[:, band] = key
        out.append(keys)
        a = b
    return np.concatenate(out) if out else np.zeros((0, BANDS), np.uint64)


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


@lean
def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            number: list[int] = []
            node: list[int] = []
            again: list[bool] = []
            size = []
            for data in _bytes(batch.column(1)[a : a + 1000]):
                found = eligible(data)
                nodes = [digest(line) for _, line in found]
                size.append(len(found))
                number += [i for i, _ in found]
                node += nodes
                if len(set(nodes)) < len(nodes):
                    seen: set[int] = set()
                    again += [x in seen or seen.add(x) is not None for x in nodes]
                else:
                    again += [False] * len(nodes)
            doc = np.repeat(batch.column(0)[a : a + 1000].to_numpy(), size)
            nodes = (np.array(node, np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(number, pa.int32()), pa.array(nodes), pa.array(again, pa.bool_())], names=["doc_id", "line", "node", "again"])


def _keyed(buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        salt = TaskContext.get().partitionId() + 1

        def out() -> pa.RecordBatch:
            nonlocal held, salt
            keys, nodes = band_keys(list(held.values())), np.fromiter(held.keys(), np.int64, len(held))
            held, salt = {}, (salt * 6364136223846793005 + 1442695040888963407) & (1 << 63) - 1
            return keyjoin.packed(keys.ravel(), np.repeat(nodes, BANDS), buckets, salt)

        for batch in batches:
            for text in batch.column(0):
                for _, line in eligible(text.cast(pa.binary()).as_py()):
                    if long_enough(line):
                        held[node_of(line)] = line
                if len(held) * BANDS >= keyjoin.FLUSH // 2:
                    yield out()
        if held:
            yield out()

    return run


@lean
def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple[int, bytes]] = []
        for text, wanted in zip(_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            wanted = set(wanted)
            for _, line in eligible(text):
                if (node := node_of(line)) in wanted:
                    wanted.remove(node)
                    found.append((node, line))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["node", "line"])


def members(line: bytes) -> np.ndarray:
    return distinct(shingles(line, np.zeros(1, np.int64))[0])


@lean
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose lines' shingle sets have the similarity asked for."""
    for batch in batches:
        keep = []
        sets: dict[int, np.ndarray] = {}  # a line is in many pairs

        def of(node: int, line: bytes, sets=sets) -> np.ndarray:
            if (got := sets.get(node)) is None:
                got = sets[node] = members(line)
            return got

        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = of(a, x), of(b, y)
            n = len(x) + len(y)
            if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                keep.append(False)
                continue
            h = np.concatenate((x, y))
            h.sort()
            same = int(np.count_nonzero(h[1:] == h[:-1]))
            keep.append(100 * same >= PERCENT * (n - same))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


@lean
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [members(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(m) for m in sets], pa.int64()), pa.array([sketch(m) for m in sets], pa.list_(pa.int64()))], names=["node", "n", "sketch"])


def verifier(texts: DataFrame, firsts: DataFrame):
    """``verify`` and ``sketches`` for keyjoin.linked, over the lines of texts; firsts: node, doc_id.

    Lines travel as text, which is far shorter than their shingle sets.
    """

    def lines_of(need: DataFrame) -> DataFrame:
        need = written(need.join(firsts, "node").groupBy(F.col("doc_id").alias("first_id")).agg(F.collect_list("node").alias("wanted")), "need")  # lines of one text
        size = need.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("wanted")), F.lit(0)).alias("lines")).first()
        need = small(need, size["rows"]) if size["lines"] <= BROADCAST_LINES else need
        held = texts.join(need, F.col("doc_id").eqNullSafe(F.col("first_id"))).select("text", "wanted")
        return written(held.mapInArrow(_lines, "node long, line binary"), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        lines = lines_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        side = lambda s: lines.select(F.col("node").alias(s), F.col("line").alias(f"l{s}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "la", "lb").mapInArrow(_linked, "a long, b long").distinct()

    def sketches(need: DataFrame) -> DataFrame:
        return lines_of(need).mapInArrow(_sketched, "node long, n long, sketch array<long>")

    return verify, sketches


def _keyed_docs(docs: DataFrame) -> DataFrame:
    """doc_id and text; a null doc_id counts as the smallest."""
    return doc_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lines, nodes): numbers (from 0) and nodes of each text's lines that another one stands for."""
    spark, texts = docs.sparkSession, _keyed_docs(docs)
    lines = written(texts.mapInArrow(_occurrences, "doc_id long, line int, node long, again boolean"), "lines")
    # a line's first place, and whether it has others; grouped with partial results, so hot lines don't pile up
    place = F.min_by("line", F.when(~F.col("again"), F.col("doc_id"))).alias("line")
    firsts = written(lines.groupBy("node").agg(F.min("doc_id").alias("doc_id"), place, F.count("*").alias("times")), "firsts")
    buckets = 8 * max(parts(spark), -(-firsts.count() * BANDS // 4_000_000))
    pairs = texts.select("text").mapInArrow(_keyed(buckets), keyjoin.PACKED)
    _, found = keyjoin.linked(keyjoin.groups(pairs, buckets), *verifier(texts, firsts.select("node", "doc_id")))
    linked = firsts.join(found, "node", "left").where("root is not null or times > 1").withColumn("root", F.coalesce("root", "node"))
    keepers = linked.groupBy("root").agg(F.min(F.struct("doc_id", "line")).alias("keep"))
    keepers = written(linked.join(keepers, "root").select("node", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line").alias("keep_line")), "keepers")
    gone = lines.join(small(keepers), "node").where((F.col("doc_id") != F.col("keep_doc")) | (F.col("line") != F.col("keep_line")))
    return gone.groupBy("doc_id").agg(F.collect_list(F.struct("line", "node")).alias("x")).select("doc_id", F.col("x.line").alias("lines"), F.col("x.node").alias("nodes"))  # at most a text's own lines


def _removed(schema: pa.Schema, text: int, length: int | None):
    """Take the lines named in the last two columns out of the text; how many and whether it is left blank follow."""

    def without(data: bytes, gone: list[int], nodes: list[int]) -> tuple[bytes, int]:
        lines, drop = data.split(b"\n"), set()
        for i, node in zip(gone, nodes, strict=True):  # rows that share a doc_id may have other lines at those numbers
            if i not in drop and i < len(lines) and node_of(lines[i].lower().strip()) == node:
                drop.add(i)
        n = len(drop)
        return (b"\n".join([x for i, x in enumerate(lines) if i not in drop]) if n else data), n

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, nodes = batch.columns[-2:]
            at = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)) if len(gone) else []
            texts, count, blank, sizes = batch.column(text), np.zeros(len(gone), np.int64), np.zeros(len(gone), bool), None
            if len(at):
                found = texts.cast(pa.binary()).to_pylist()
                sizes = batch.column(length).to_pylist() if length is not None else None
                for i in map(int, at):
                    if found[i] is None:
                        continue
                    now, count[i] = without(found[i], gone[i].as_py(), nodes[i].as_py())
                    if count[i]:
                        found[i], blank[i] = now, not now.strip()
                        if sizes is not None:
                            sizes[i] = len(now.decode("utf-8", "surrogatepass"))
                texts = pa.array(found, pa.binary()).cast(pa.string())
            columns = list(batch.columns[:-2])
            columns[text] = texts
            if sizes is not None:
                columns[length] = pa.array(sizes, pa.int64()).cast(schema.field(length).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count), pa.array(blank)], schema=schema)

    return run


def dedup_lines(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """docs with repeated lines taken out of text; with ``removed``, a column counting them.

    Texts that lose every line that isn't blank are dropped, unless ``removed`` asks for all rows.
    Null and empty texts and blank lines stay as they are. A null doc_id counts as the smallest. Rows
    that share a doc_id (or have none) each lose only lines of their own that stand elsewhere too: of
    such a row, a line in the keeper's place of its group stays. An integer n_chars, if there is such a column,
    follows the text. Other columns pass through, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    key, lines, nodes, count, blank = (unused(docs, x) for x in ("__key", "__lines", "__nodes", removed or "__count", "__blank"))
    gone = written(repeated_lines(docs), "gone").select(F.col("doc_id").alias(key), F.col("lines").alias(lines), F.col("nodes").alias(nodes))
    size = gone.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(lines)), F.lit(0)).alias("lines")).first()
    # beyond that, texts are shuffled once
    gone = small(gone, size["rows"]) if size["lines"] <= BROADCAST_LINES else gone
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)).cast("long"))
    both = docs.withColumn("text", F.col("text").cast("string")).join(gone, own == F.col(key), "left").select(*docs.columns, lines, nodes)
    fields = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField(count, T.LongType()), T.StructField(blank, T.BooleanType())])
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType) else None
    out = both.mapInArrow(_removed(to_arrow_schema(schema), docs.columns.index("text"), length), schema)
    return out.drop(blank) if removed is not None else out.where(~F.col(blank)).drop(count, blank)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, text (without the repeated lines)."""
    docs = doc_text(documents(spark, sf_dir)).withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    return dedup_lines(docs, "n_removed").select("doc_id", "n_lines", "n_removed", "text")
