"""Operator 4, packing into fixed windows by non-negative least squares.

1. Every document is tokenised once. A written table holds, for each, its number of ids, the checksums
   of its full windows and of the remainder, the remainder's ids (two bytes an id where the vocabulary
   allows) and its rank among the rows of the same task and remainder length.
2. What is left of each document after its full windows gives one histogram over all documents
   (at most window - 1 lengths, whatever the corpus). On the driver, shallow combinations of lengths
   that fill a window exactly are enumerated, their repeat counts are solved for by non-negative
   least squares against the histogram, rounded down and trimmed to what there is.
3. The residual remainders are packed greedily, end to end, cut at window borders; so only the very
   last sequence is short.

A remainder's place is a closed form of (length, rank), so nothing is gathered: ranks come from
per-task counts by a running sum. Tokens are cut freely; each id lies in exactly one piece. Only rows
of some forty bytes a document move; ids are read again just for the remainders that a window border
cuts, at most one a residual sequence. Ranks rise with the task, so those lie in the last tasks of
their length, and the others' ids never meet a shuffle.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_text, documents, kept, lean, small, written

WINDOW = 2048
END = 1
#: Words that a worker keeps the ids of; some 200 bytes each.
CACHE = 600_000
DEPTH_LENGTHS = 96
#: Documents encoded together.
BATCH = 200
TOKENS = "chunk int, row long, doc_id long, n long, left int, rank long, fulls long, crcs binary, tail binary"
TOKENS_ARROW = pa.schema([("chunk", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("left", pa.int32()), ("rank", pa.int64()), ("fulls", pa.int64()), ("crcs", pa.binary()), ("tail", pa.binary())])
CUTS = "chunk int, left int, row long, place long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Letters (and bytes beyond ASCII), digits, white space, signs.
_CLASS = [0 if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 1 if 48 <= b <= 57 else 2 if b in b" \t\n\v\f\r" else 3 for b in range(256)]
#: Words whose pre-tokens are runs of one class: no apostrophe, and beyond ASCII only old Latin letters.
_SIMPLE = re.compile("[\x20-\x26\x28-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Tokens that can stand in such a word (0xC3 to 0xC9 begin the Latin letters).
_REACHED = re.compile(rb"(?! *\Z)[\x20-\x26\x28-\x7e\x80-\xbf\xc3-\xc9]+")


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Bytes of each token -> id, where that alone tells how words are merged; else None.

    It does if the model is plain byte-level BPE whose ids follow its merges: then the pair to merge
    next is the one that makes the token of the smallest id. For such a vocabulary the two readings
    agree: a token's own bytes, merged by themselves, give that token, so no other pair can stand for it.
    No token that such words reach may hold letters, digits and signs mixed, so that they need no cutting at
    those borders.
    """
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model, before = found["model"], found["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not found["normalizer"] and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    # byte-level BPE writes bytes that aren't printable as the letters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
    added = {x["content"] for x in found["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in added}
    made = [ranks[bytes(map(byte_of.__getitem__, m.replace(" ", "") if isinstance(m, str) else "".join(m)))] for m in model["merges"]]
    singles = sorted(i for t, i in ranks.items() if len(t) == 1)
    apart = all(len({_CLASS[b] for b in t.removeprefix(b" ")}) < 2 for t in ranks if _REACHED.fullmatch(t))
    return ranks if apart and singles == list(range(256)) and made == list(range(256, 256 + len(made))) and len(ranks) == 256 + len(made) else None


class Encoder:
    """Ids of whole texts, as little-endian bytes, with a cache of words.

    Byte-level BPE never merges across a pre-token border, and there is one before each single space
    that stands between non-spaces and around each such newline. Texts are cut there, and each
    distinct word is merged once, or once a batch if it came after the cache was full; where the
    vocabulary allows (see merge_ranks), by tiktoken, whose ids are the same. Texts with other white
    space, unprintable characters or special tokens go through whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.code = "H" if self.model.get_vocab_size() <= 65536 else "I"
        self.kind = np.dtype(self.code).newbyteorder("<")
        self.special = tuple(x.content for x in self.model.get_added_tokens_decoder().values())
        newline = self.plain(["\n"])[0]
        #: the id of a newline, if it is one token
        self.newline = int(np.frombuffer(newline, self.kind)[0]) if len(newline) == self.kind.itemsize else 0
        self.known: dict[str, bytes] = {"\n": newline}
        ranks = merge_ranks(path)
        self.merger = tiktoken.Encoding("words", pat_str=r"\n|[^\n]+", mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def plain(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words without newlines, by one call: a newline between two words is a token of its own."""
        if not self.newline or not words:
            return self.plain(words)
        if self.merger is None:
            return self._parts(words, self.model.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids)
        simple = [_SIMPLE.fullmatch(w) is not None for w in words]
        easy = [w for w, x in zip(words, simple, strict=True) if x]
        hard = [w for w, x in zip(words, simple, strict=True) if not x]
        a = iter(self._parts(easy, self.merger.encode_ordinary("\n".join(easy))) if easy else ())
        b = iter(self._parts(hard, self.model.encode_batch_fast(["\n".join(hard)], add_special_tokens=False)[0].ids) if hard else ())
        return [next(a) if x else next(b) for x in simple]

    def _parts(self, words: list[str], found: list[int]) -> list[bytes]:
        """found, the ids of words with newlines between, cut into each word's."""
        data = array(self.code, found)
        ids, size = np.frombuffer(data, self.kind), self.kind.itemsize
        at = (np.flatnonzero(ids == self.newline) * size).tolist()
        if len(at) != len(words) - 1:
            return self.plain(words)
        whole = data.tobytes()
        return [whole[a:b] for a, b in zip([0, *(x + size for x in at)], [*at, len(whole)], strict=True)]

    def cut(self, text: str) -> list[str] | None:
        """text in parts at borders of pre-tokens; None if it has to be encoded whole."""
        if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not text.replace("\n", "").isprintable():
            return None
        if any(x in text for x in self.special):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        words = set().union(*(x for x in cut if x))
        new = words.difference(self.known)
        new = list(new)
        self.known.update(zip(new, self.words(new), strict=True))
        whole = iter(self.plain([t for t, x in zip(texts, cut, strict=True) if x is None]))
        out = [next(whole) if x is None else b"".join(map(self.known.__getitem__, x)) for x in cut]
        if len(self.known) > CACHE:  # full: frequent words are in by now, later ones leave again
            for word in new:
                del self.known[word]
        return out


#: The Arrow maps of this operator leave the encoder to one another.
_map = partial(lean, keep=True)


def encoder_of(path: str) -> Encoder:
    """One for each worker process, so that its words last for all its tasks of this operator."""
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _checksums(ids: np.ndarray, window: int) -> bytes:
    """CRC-32 of each full window and of what is left, as little-endian 32-bit numbers."""
    data = memoryview(ids.astype("<u4").tobytes())
    return np.array([zlib.crc32(data[a : a + 4 * window]) for a in range(0, len(data), 4 * window)], "<u4").tobytes()


def _tokens(path: str, window: int):
    @_map
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, chunk, row, fulls = encoder_of(path), TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(window, np.int64)
        end = np.array([END], encoder.kind).tobytes()
        size = encoder.kind.itemsize
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                ids = [x + end for x in encoder.encode(batch.column(1)[a : a + BATCH].to_pylist())]
                n = np.array([len(x) // size for x in ids], np.int64)
                left, rank = n % window, np.zeros(len(n), np.int64)
                for i, length in enumerate(left):
                    rank[i] = seen[length]
                    seen[length] += 1
                before = fulls + np.cumsum(n // window) - n // window
                fulls = int(before[-1] + n[-1] // window)
                crcs = [_checksums(np.frombuffer(x, encoder.kind), window) for x in ids]
                tails = [x[len(x) - size * int(k) :] for x, k in zip(ids, left, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), chunk, np.int32)), pa.array(np.arange(row, row + len(n))), batch.column(0)[a : a + BATCH], pa.array(n), pa.array(left.astype(np.int32)), pa.array(rank), pa.array(before),
                        pa.array(crcs, pa.binary()), pa.array(tails, pa.binary()),
                    ],
                    schema=TOKENS_ARROW,
                )
                row += len(n)

    return run


def combinations(counts: np.ndarray, window: int, most: int = DEPTH_LENGTHS) -> list[tuple[int, ...]]:
    """Length combinations of depth two and three that fill the window: all pairs of lengths that
    occur, and the triples of the ``most`` commonest lengths with any third length that occurs."""
    there = np.flatnonzero(counts)
    pairs = [(int(a), window - int(a)) for a in there if a <= window - a and counts[window - a]]
    common = sorted(there, key=lambda x: (-counts[x], x))[:most]
    triples = {tuple(sorted((int(a), int(b), window - int(a) - int(b)))) for a in common for b in common if a + b < window and counts[window - a - b]}
    return pairs + sorted(triples)


def repeats(counts: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 12) -> np.ndarray:
    """Non-negative least squares by cyclic coordinate descent, from the plain pair solution."""
    residual, x = counts.astype(float).copy(), np.zeros(len(combos))
    for _ in range(sweeps):
        moved = 0.0
        for k, combo in enumerate(combos):
            if combo[0] == combo[-1]:
                step, norm = len(combo) * residual[combo[0]], len(combo) ** 2
            elif len(set(combo)) == len(combo):
                step, norm = sum(residual[a] for a in combo), len(combo)
            else:
                step, norm = sum(residual[a] for a in combo), 5  # one length twice, one once
            now = max(0.0, x[k] + step / norm)
            if (d := now - x[k]) != 0:
                for a in combo:
                    residual[a] -= d
                x[k] = now
                moved += abs(d)
        if moved < 0.5:
            break
    return x


#: Room for the rank in a key of (length, rank).
_RANKS = 1 << 50


def plan(counts: np.ndarray, window: int = WINDOW) -> dict:
    """Where the r-th remainder of each length goes; see _pieces for its use.

    ``slots`` has a row for each combination and length of it: the ranks from ``key % _RANKS`` on fill
    the ``times`` sequences from ``first`` on, ``m`` remainders in each, at the offsets ``at``.
    """
    counts = counts.copy()
    counts[0] = 0
    combos = combinations(counts, window)
    wanted = np.floor(repeats(counts, combos) + 1e-6).astype(np.int64) if combos else np.zeros(0, np.int64)
    free, taken, sequences = counts.copy(), np.zeros(window, np.int64), 0
    slots: list[tuple[int, int, int, int, int, int]] = []
    for exact in (False, True):  # the solution rounded; then what rounding has left of the combinations
        for k in np.argsort(-wanted, kind="stable"):
            combo = combos[k]
            each = {a: combo.count(a) for a in combo}
            times = int(min(free[a] // m for a, m in each.items()))
            times = times if exact else min(times, int(wanted[k]))
            if times <= 0:
                continue
            for a, m in each.items():
                at = [sum(combo[:i]) for i, x in enumerate(combo) if x == a]
                slots.append((a * _RANKS + int(taken[a]), sequences, m, *at, *[0] * (3 - m)))
                taken[a] += times * m
                free[a] -= times * m
            sequences += times
    lengths = np.arange(window)
    base = np.concatenate(([0], np.cumsum(free * lengths)[:-1]))
    rest = int((free * lengths).sum())
    return {"window": window, "slots": np.array(sorted(slots), np.int64).reshape(-1, 6), "taken": taken, "base": base, "first_rest": sequences, "first_full": sequences + -(-rest // window)}


def _places(p: dict, left: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, place among the residuals or -1) of remainders."""
    window, slots = p["window"], p["slots"]
    rest = rank >= p["taken"][left]
    place = np.where(rest, p["base"][left] + (rank - p["taken"][left]) * left, -1)
    sequence, offset = p["first_rest"] + place // window, place % window
    if len(slots):
        row = slots[np.maximum(np.searchsorted(slots[:, 0], left * _RANKS + rank, "right") - 1, 0)]
        times, slot = np.divmod(rank - row[:, 0] % _RANKS, np.maximum(row[:, 2], 1))
        sequence = np.where(rest, sequence, row[:, 1] + times)
        offset = np.where(rest, offset, row[np.arange(len(row)), 3 + slot % 3])
    return sequence, offset, place


def _cut(p: dict, left: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which remainders a window border cuts."""
    return (place >= 0) & (place % p["window"] + left > p["window"])


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy().astype(np.int64) for c in names]


def _as_pieces(docs: pa.Array, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([docs, *(pa.array(c.astype(np.int64)) for c in columns)], schema=PIECES_ARROW)


def _pieces(shared):
    """All pieces but those of remainders that a window border cuts."""

    @_map
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        window = p["window"]
        for batch in batches:
            if not batch.num_rows:
                continue
            n, left, rank, full = _numbers(batch, "n", "left", "rank", "full")
            crcs = np.frombuffer(b"".join(batch.column("crcs").to_pylist()), "<u4")
            fulls = n // window
            first = np.cumsum(fulls + (left > 0)) - fulls - (left > 0)  # a row's checksums in crcs
            row = np.repeat(np.arange(len(n)), fulls)
            i = np.arange(len(row)) - np.repeat(np.cumsum(fulls) - fulls, fulls)
            yield _as_pieces(batch.column("doc_id").take(pa.array(row)), [i * window, np.full(len(row), window), crcs[first[row] + i], n[row], p["first_full"] + full[row] + i, np.zeros(len(row))])
            sequence, offset, place = _places(p, left, rank)
            row = np.flatnonzero((left > 0) & ~_cut(p, left, place))
            yield _as_pieces(batch.column("doc_id").take(pa.array(row)), [(n - left)[row], left[row], crcs[(first + fulls)[row]], n[row], sequence[row], offset[row]])

    return run


def _cuts(shared):
    @_map
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            left, rank = _numbers(batch, "left", "rank")
            place = _places(p, left, rank)[2]
            row = pa.array(np.flatnonzero(_cut(p, left, place)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("chunk", "left", "row")), pa.array(place).take(row)], names=["chunk", "left", "row", "place"])

    return run


def _halves(shared, kind: str):
    """The two pieces of each cut remainder."""

    @_map
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        window = p["window"]
        for batch in batches:
            n, left, place = _numbers(batch, "n", "left", "place")
            ids = [np.frombuffer(x, kind).astype("<u4") for x in batch.column("tail").to_pylist()]
            size = window - place % window
            crc = lambda part: np.array([zlib.crc32(x.tobytes()) for x in part], np.int64)
            sequence = p["first_rest"] + place // window
            yield _as_pieces(batch.column("doc_id"), [n - left, size, crc(x[:k] for x, k in zip(ids, size, strict=True)), n, sequence, place % window])
            yield _as_pieces(batch.column("doc_id"), [n - left + size, left - size, crc(x[k:] for x, k in zip(ids, size, strict=True)), n, sequence + 1, np.zeros(len(n))])

    return run


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows that repeat a doc_id are packed each on its own.
    Sequences hold ``window`` ids, but for at most one. Only doc_id and text are read.
    """
    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, path or tokenizer_path()
    tokens = written(doc_text(docs).mapInArrow(_tokens(path, window), TOKENS), "tokens")
    tally = written(tokens.groupBy("chunk", "left").agg(F.count("*").alias("rows"), F.expr(f"sum(n div {window})").alias("fulls")), "tally")
    counts = np.zeros(window, np.int64)
    for row in tally.groupBy("left").agg(F.sum("rows").alias("rows")).collect():  # at most `window` rows
        counts[row["left"]] = row["rows"]
    shared = spark.sparkContext.broadcast(plan(counts, window))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ranks = tally.select("chunk", "left", F.coalesce(F.sum("rows").over(before.partitionBy("left")), F.lit(0)).alias("ranks"))
    fulls = tally.groupBy("chunk").agg(F.sum("fulls").alias("fulls")).select("chunk", F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("first"))  # a row for each task
    at = written(ranks.join(small(fulls), "chunk"), "at")
    at = small(at)
    rank = (F.col("rank") + F.col("ranks")).alias("rank")
    rows = tokens.select("chunk", "left", "doc_id", "n", "rank", "fulls", "crcs").join(at, ["chunk", "left"])
    pieces = rows.select("doc_id", "n", "left", rank, (F.col("fulls") + F.col("first")).alias("full"), "crcs").mapInArrow(_pieces(shared), PIECES)
    cuts = written(tokens.select("chunk", "left", "row", "rank").join(at, ["chunk", "left"]).select("chunk", "left", "row", rank).mapInArrow(_cuts(shared), CUTS), "cuts")
    n_cuts = cuts.count()
    if not n_cuts:
        return pieces
    # each length's cut remainders lie in its last tasks
    least = {r["left"]: r["chunk"] for r in cuts.groupBy("left").agg(F.min("chunk").alias("chunk")).collect()}  # at most `window` rows
    bounds = F.split(F.lit(",".join(str(least.get(k, 1 << 30)) for k in range(window))), ",").cast("array<int>")
    tails = tokens.select("chunk", "row", "doc_id", "n", "left", "tail").where(F.col("chunk") >= F.get(bounds, F.col("left")))
    kind = "<u4" if Tokenizer.from_file(path).get_vocab_size() > 65536 else "<u2"
    return pieces.unionByName(tails.join(small(cuts.drop("left"), n_cuts), ["chunk", "row"]).select("doc_id", "n", "left", "place", "tail").mapInArrow(_halves(shared, kind), PIECES))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
