"""Similarity links from shared keys: the common second half of the near-duplicate operators.

The map side turns texts into (key, node) pairs, where equal keys make two nodes candidates. Pairs
travel packed: one row holds a bucket's share of a batch as two binary columns, so a billion keys
are not a billion JVM rows. A bucket's pairs are sorted by key in numpy and groups come out.

Hot keys: where one batch alone holds HOT or more nodes of a key, that part of the group goes to a
bucket of its own, and only its smallest node goes to the key's bucket too; so no bucket receives a
hot group whole, and the chains of smallest nodes still join the parts. All these pairs are marked:
what one bucket holds of such a key isn't its whole group, so no group of the same nodes replaces it.

Within a bucket 32 more bits of a key are kept; buckets grow in number with the keys, so the share of
pairs that meet by chance stays as small. Those only cost a verification.

Links are found in rounds that are exact together. First each node is verified against the smallest
nodes of its groups (stars, never all pairs). Then, for groups that still span several components,
the nodes outside the main one are verified against the group's other members. No pair that shares
a key and lies in different components is left unverified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, mix, parts, written

HOT = 64
FLUSH = 400_000
#: Rows of a side of a block, when a large group is compared.
BLOCK = 4096
PACKED = "bucket int, home int, hot boolean, keys binary, nodes binary"
GROUPS = "key long, node long, pivot long"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("hot", pa.bool_()), ("keys", pa.binary()), ("nodes", pa.binary())])
GROUPS_ARROW = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("pivot", pa.int64())])


def _home(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A key's bucket; it follows the key's order, so sorted keys are sorted by bucket."""
    return (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def packed(keys: np.ndarray, nodes: np.ndarray, buckets: int, salt: int) -> pa.RecordBatch:
    """One batch's (key, node) pairs, dealt out to buckets."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(start, len(keys)))
    rows = []

    def deal(keys: np.ndarray, nodes: np.ndarray, hot: bool, apart: bool = False) -> None:
        home = _home(keys, buckets)
        bucket = mix(home ^ np.uint64(salt)) % np.uint64(buckets) if apart else home
        cut = np.append(np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))), len(keys))
        low = keys.astype(np.uint32)
        rows.extend((int(bucket[a]), int(home[a]), hot, low[a:b].tobytes(), nodes[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True))

    if (size >= HOT).any():
        hot = np.repeat(size >= HOT, size)
        deal(keys[hot], nodes[hot], True, apart=True)
        # the smallest node of each hot part goes to the key's own bucket too
        deal(keys[start[size >= HOT]], np.minimum.reduceat(nodes, start)[size >= HOT], True)
        keys, nodes = keys[~hot], nodes[~hot]
    if len(keys):
        deal(keys, nodes, False)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PACKED_ARROW.types, strict=True)], schema=PACKED_ARROW)


def pack_stream(pairs: Iterator[tuple[np.ndarray, int]], buckets: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Pack the keys of (keys, node); a node that repeats within FLUSH pairs is taken once."""
    held: list[np.ndarray] = []
    seen: dict[int, int] = {}
    count = 0

    def out() -> pa.RecordBatch:
        return packed(np.concatenate(held), np.repeat(np.fromiter(seen.keys(), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen))), buckets, salt)

    for keys, node in pairs:
        if not len(keys) or node in seen:
            continue
        held.append(keys)
        seen[int(node)] = len(keys)
        count += len(keys)
        if count >= FLUSH:
            yield out()
            salt = (salt * 6364136223846793005 + 1442695040888963407) & (1 << 63) - 1
            held, seen, count = [], {}, 0
    if count:
        yield out()


@lean
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    marked: list[np.ndarray] = []
    for batch in batches:
        for _, home, hot, keys, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[0].append(np.frombuffer(keys, np.uint32) | np.uint64(home << 32))
            held[1].append(np.frombuffer(nodes, np.int64))
            if hot:
                marked.append(held[0][-1])
    if held[0]:
        keys, nodes = (np.concatenate(x) for x in held)
        held = ([], [])
        order = np.argsort(keys)
        keys, nodes = keys[order], nodes[order]
        # most keys are single; the rest get their distinct nodes sorted
        same = keys[1:] == keys[:-1]
        more = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        keys, nodes = keys[more], nodes[more]
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        keep = np.ones(len(keys), bool)
        keep[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[keep], nodes[keep]
        if not len(keys):
            return
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(start, len(keys)))
        # groups of the very same nodes under many keys: one of them is enough, unless a key has a hot part elsewhere
        digest = np.add.reduceat(mix(nodes.view(np.uint64)), start) ^ size.astype(np.uint64)
        chosen = np.zeros(len(start), bool)
        few = np.flatnonzero((size > 1) & (size < HOT))
        chosen[few[np.unique(digest[few], return_index=True)[1]]] = True
        chosen |= size >= HOT
        if marked:
            chosen |= (size > 1) & np.isin(keys[start], np.unique(np.concatenate(marked)))
        rows = np.repeat(chosen, size)
        pivot = np.repeat(nodes[start], size)
        for a in range(0, int(rows.sum()), 100_000):
            at = np.flatnonzero(rows)[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[at].view(np.int64), nodes[at], pivot[at])], schema=GROUPS_ARROW)


def groups(pairs: DataFrame, buckets: int) -> DataFrame:
    """Packed pairs -> (key, node, pivot) of the groups of two nodes or more."""
    return pairs.repartition(max(parts(pairs.sparkSession), buckets // 8), "bucket").mapInArrow(_groups, GROUPS)


def _near(percent: int, best: bool):
    """(a, b) of one block of a group that sizes and parity sketches don't refute: strays by members.

    best: for each stray only the nearest member of another component.
    """

    def run(table: pa.Table) -> pa.Table:
        node, root, n = (table[c].to_numpy() for c in ("node", "root", "n"))
        stray = np.array(table["stray"].to_pylist(), bool)
        sketch = [np.array(x, np.int64).view(np.uint64) for x in table["sketch"].to_pylist()]
        length = np.array([len(x) for x in sketch])
        out = []
        by = {m: np.flatnonzero(length == m) for m in np.unique(length)}
        stacks = {m: np.stack([sketch[i] for i in rows]) for m, rows in by.items()}
        for m, rows in by.items():
            for other in (m // 2, m, 2 * m):
                if other not in by:
                    continue
                left, right = stacks[m], stacks[other]
                if other < m:  # halves of the longer sketch, one XORed onto the other
                    left = left[:, :other] ^ left[:, other:]
                elif other > m:
                    right = right[:, :m] ^ right[:, m:]
                left, rows_a = left[stray[rows]], rows[stray[rows]]
                for i in range(0, len(rows_a), 32):
                    a, b = rows_a[i : i + 32, None], by[other][None, :]
                    ham = np.bitwise_count(left[i : i + 32, None, :] ^ right[None, :, :]).sum(2, dtype=np.int64)
                    ok = (root[a] != root[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (ham * (100 + percent) <= (n[a] + n[b]) * (100 - percent))
                    if best:
                        only = np.where(ok, ham, 1 << 40)
                        x = np.flatnonzero(only.min(1) < 1 << 40)
                        y = only.argmin(1)[x]
                    else:
                        x, y = np.nonzero(ok)
                    out.append(np.stack([node[rows_a[i + x]], node[by[other][y]]]))
        pairs = np.unique(np.sort(np.concatenate(out, 1), 0), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return run


def linked(
    grouped: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    sketches: Callable[[DataFrame], DataFrame],
    sieve: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    percent: int = 75,
) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), components (node, root)) of the nodes that have links.

    ``verify`` takes distinct candidate pairs (a < b) and returns those that hold; ``sieve`` drops
    pairs that can be refuted more cheaply; ``sketches`` takes nodes and returns (node, n, sketch),
    sizes and parity sketches, by which large groups are compared in blocks without writing pairs.
    """
    grouped = written(grouped, "groups")
    none = lambda *names: grouped.sparkSession.range(0).select(*(F.col("id").alias(n) for n in names))
    found: DataFrame | None = None
    links = none("a", "b")
    stars = grouped.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    done: list[DataFrame] = []

    def open_pairs(pairs: DataFrame) -> DataFrame:
        """Those not verified yet whose ends lie in different components."""
        if found is not None:
            at = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
            pairs = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        for verified in done:
            pairs = pairs.join(verified, ["a", "b"], "left_anti")
        return pairs

    def strays(best: bool) -> DataFrame:
        """Nodes outside their group's main component, with the group's other members."""
        at = grouped.join(found if found is not None else none("node", "root"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        main = at.groupBy("key").agg(F.min_by("root", "node").alias("main"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high")
        at = written(at.join(main.select("key", "main", "size"), "key").withColumn("stray", F.expr("root <> main")), "open")
        few = at.where(f"size < {HOT}")
        rest = few.where("stray").select("key", F.col("node").alias("a"), F.col("root").alias("ra")).join(few.select("key", F.col("node").alias("b"), F.col("root").alias("rb")), "key").where("ra <> rb")
        rest = sieve(written(open_pairs(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "strays"))
        many = at.where(f"size >= {HOT}")
        if many.isEmpty():
            return rest
        # large groups in blocks of BLOCK strays by BLOCK members: every row goes to each block of the other side
        sides = many.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("mc"), F.ceil(F.count_if("stray") / BLOCK).cast("long").alias("sc"))
        many = many.join(sides, "key").join(sketches(many.select("node").distinct()), "node")
        h = F.xxhash64("node")
        member = many.select("key", "node", "root", "n", "sketch", F.lit(False).alias("stray"), F.pmod(h, F.col("mc")).alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sc") - 1)).alias("s"))
        stray = many.where("stray").select("key", "node", "root", "n", "sketch", F.lit(True).alias("stray"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("mc") - 1)).alias("m"), F.pmod(h, F.col("sc")).alias("s"))
        blocks = member.unionByName(stray).groupBy("key", "m", "s").applyInArrow(_near(percent, best), "a long, b long")
        return rest.unionByName(blocks).distinct()

    # each node against the smallest nodes of its groups; then the strays, in large groups by their
    # nearest members first, so that few pairs are left for the last round
    for candidates in (lambda: sieve(stars), lambda: strays(True), lambda: strays(False)):
        pairs = written(open_pairs(candidates()), "candidates")
        done.append(pairs)
        if pairs.isEmpty():
            continue
        more = written(verify(pairs), "links")
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        # the components so far stand for the links so far
        edges = more if found is None else found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
        found = written(connected_components(edges), "components")
    return links, found if found is not None else none("node", "root")
