"""Operator 6, benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping windows. A window of m characters that occurs in a text
with at most e edits shares m - q + 1 - q * e of its q-grams with it, on diagonals that differ by at
most e. So q-grams of the whole text that occur in the benchmark are counted in overlapping diagonal
bands, only bands that reach the lemma's bound are kept, and those are verified by alignment. Both
sides are compared as lower-case letters and digits with single spaces between; characters are UTF-8
bytes.

An item of fewer than SHORTEST characters says too little to tell a leak from chance wherever it
stands; it is found where it is a whole line of a text.

Items are held by every task, so they are taken in slices of at most SLICE characters; a larger
benchmark costs more passes over the texts, never more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_text, documents, lean, unused

Q = 8
WINDOW = 96
STEP = 48
#: Edits allowed in a window, as a share of its characters.
EDITS = 0.08
#: Shorter items are found as whole lines only.
SHORTEST = 32
SLICE = 2_000_000
_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BITS = 21
#: Grams in a row that the scan of a text asks for.
RUN = 4


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_WORD).split())


def grams(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, all q-grams that begin at offset + 8 i), as numbers."""
    for o in range(Q):
        if len(data) - o >= Q:
            yield o, np.frombuffer(data, "<u8", (len(data) - o) // Q, o)


def slot(g: np.ndarray) -> np.ndarray:
    return g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)


class Index:
    """The windows of a slice of the benchmark and their q-grams."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        self.windows: list[bytes] = []
        self.short: dict[bytes, list[int]] = {}
        item = []
        for key, text in items:
            data = normal(text or "")
            if len(data) < SHORTEST:
                if data:
                    self.short.setdefault(data, []).append(key)
                continue
            for a in range(0, max(1, len(data) - WINDOW + STEP), STEP):
                a = min(a, max(0, len(data) - WINDOW))
                self.windows.append(data[a : a + WINDOW])
                item.append(key)
        self.item = np.array(item, np.int64)
        self.size = np.array([len(w) for w in self.windows], np.int64)
        # few enough that e + 1 stretches between edits can't all be shorter than RUN grams
        longest = Q + RUN - 1
        self.edits = np.minimum(np.floor(self.size * edits), (self.size - longest) // (longest + 1)).astype(np.int64)
        # the lemma's bound, less the grams of stretches that are too short for a run
        self.bound = np.maximum(RUN, self.size - Q + 1 - (Q + RUN - 1) * self.edits)
        data = b"".join(self.windows)
        g = np.zeros(max(len(data), 1), np.uint64)
        for o, part in grams(data):
            g[o : o + Q * len(part) : Q] = part
        sizes = np.maximum(self.size - Q + 1, 0)
        begin = np.cumsum(self.size) - self.size
        window = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = (np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        g = g[begin[window] + place]
        order = np.argsort(g, kind="stable")
        self.gram, first = np.unique(g[order], return_index=True)
        self.first = np.append(first, len(g))
        self.window_of = window[order]
        self.place = place[order]
        self.there = np.zeros(1 << _BITS, bool)
        self.there[slot(self.gram)] = True
        self.padded = np.zeros((len(self.windows), WINDOW), np.uint8)
        for w, data in enumerate(self.windows):
            self.padded[w, : len(data)] = np.frombuffer(data, np.uint8)

    def scan(self, texts: list[str]) -> list[list[int]]:
        """The items that each text holds a window of."""
        found: list[set[int]] = [set() for _ in texts]
        if self.short:
            for i, text in enumerate(texts):
                for line in text.split("\n"):
                    if line and (hit := self.short.get(normal(line))):
                        found[i].update(hit)
        if not self.windows:
            return [sorted(x) for x in found]
        parts = [normal(t) for t in texts]
        # a border that no gram crosses: grams have no zero byte
        data = b"\0".join(parts) + b"\0"
        ends = np.cumsum([len(p) + 1 for p in parts])
        raw = np.frombuffer(data, np.uint8)
        hits = np.zeros(len(data) + RUN, bool)
        for o, g in grams(data):
            hits[o : o + Q * len(g) : Q] = self.there[slot(g)]
        # only grams in runs of RUN: the longest stretch without edits has as many, see Index.bound
        runs = np.logical_and.reduce([hits[i : len(data) + i] for i in range(RUN)])
        starts = np.flatnonzero(runs)
        if not len(starts):
            return [sorted(x) for x in found]
        inside = np.zeros(len(data) + RUN, bool)
        for i in range(RUN):
            inside[starts + i] = True
        place = np.flatnonzero(inside)
        g = np.zeros(len(place), np.uint64)
        for i in range(Q):
            g |= raw[place + i].astype(np.uint64) << np.uint64(8 * i)
        k = np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)
        same = self.gram[k] == g
        place, k = place[same], k[same]
        if not len(place):
            return [sorted(x) for x in found]
        # each gram's places in the windows
        many = self.first[k + 1] - self.first[k]
        entry = np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        place = np.repeat(place, many)
        window = self.window_of[entry].astype(np.int64)
        diagonal = place - self.place[entry]
        text = np.searchsorted(ends, place, "right")
        width = self.edits[window] + 1
        # bands of two widths that overlap by one: diagonals within e of one another share a band
        low = diagonal // width
        least = int(low.min()) - 1
        span = int(low.max()) - least + 1
        pair = (text * len(self.windows) + window) * span - least
        key = np.sort(np.concatenate((pair + low, pair + low - 1)))
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(start, len(key)))
        pair, low = np.divmod(key[start], span)
        keep = count >= self.bound[pair % len(self.windows)]
        (text, window), low = np.divmod(pair[keep], len(self.windows)), low[keep] + least
        if not len(text):
            return [sorted(x) for x in found]
        # a text and item need one window only: first those found word for word, then by alignment
        begin = np.concatenate(([0], ends[:-1]))[text]
        left = np.maximum(low * (self.edits[window] + 1) - self.edits[window], begin)
        right = np.minimum((low + 2) * (self.edits[window] + 1) + self.size[window] + self.edits[window], ends[text] - 1)
        rest = []
        for i in range(len(text)):
            if self.item[window[i]] in found[text[i]]:
                continue
            if self.windows[window[i]] in data[left[i] : right[i]]:
                found[text[i]].add(int(self.item[window[i]]))
            else:
                rest.append(i)
        rest = [i for i in rest if int(self.item[window[i]]) not in found[text[i]]]
        for a in range(0, len(rest), 2000):
            part = np.array(rest[a : a + 2000])
            for i in part[self.aligned(raw, window[part], left[part], right[part])]:
                found[text[i]].add(int(self.item[window[i]]))
        return [sorted(x) for x in found]

    def aligned(self, raw: np.ndarray, window: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Does the region hold the window within its edits? Start and end in the region are free.

        All regions advance together. A region is no longer than its band needs, so the whole of it
        is the band.
        """
        width = int((right - left).max()) if len(left) else 0
        columns = left[:, None] + np.arange(width)
        region = np.where(columns < right[:, None], raw[np.minimum(columns, len(raw) - 1)], 0)
        step = np.arange(width + 1, dtype=np.int16)
        row, best = np.zeros((len(window), width + 1), np.int16), np.full(len(window), 1 << 14, np.int16)
        size = self.size[window]
        for i in range(int(size.max())):
            now = np.empty_like(row)
            now[:, 0] = i + 1
            np.minimum(row[:, :-1] + (region != self.padded[window, i][:, None]), row[:, 1:] + np.int16(1), out=now[:, 1:])
            row = np.minimum.accumulate(now - step, 1) + step
            best = np.where(size == i + 1, row.min(1), best)
        return best <= self.edits[window]


def _scan(shared, schema: pa.Schema, fields: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = ["" if t is None else t for t in part.column(fields).to_pylist()]
                before = part.column(fields + 1).to_pylist()
                items = [sorted({*b, *x}) for b, x in zip(before, shared.value.scan(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: fields + 1], pa.array(items, pa.list_(pa.int64()))], schema=schema)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, name: str = "__items") -> DataFrame:
    """docs with one more column, ``name``: the sorted ids of the items whose passages the text holds."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    slices = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 1) // SLICE)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = unused(docs, "__text")
    out = docs.withColumns({own: text, name: F.array().cast("array<long>")})
    schema = T.StructType(out.schema.fields)
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).toArrow()
        shared = spark.sparkContext.broadcast(Index(list(zip(part["item_id"].to_pylist(), part["text"].to_pylist(), strict=True))))
        out = out.mapInArrow(_scan(shared, to_arrow_schema(schema), len(docs.columns)), schema)
    return out.drop(own)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark passage, with all their columns.

    Null and empty texts hold none and stay; items without letters and digits are never found, those
    shorter than SHORTEST characters as whole lines; an empty benchmark removes nothing. Rows that
    repeat share a fate; columns pass through, whatever their names.
    """
    items = unused(docs, "__items")
    return leaks(docs, benchmark, items).where(F.size(items) == 0).drop(items)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(doc_text(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_ids")
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")
