"""Operator 7, language-model scoring with a Brown class-based bigram model.

1. All training tokens are counted by a shuffle on the word's hash (combined in each task first).
2. The CLUSTERED most frequent words, the core, are put into CLASSES classes by exchange clustering, on
   their bigram counts over all training text (a table bounded by CLUSTERED squared).
3. Every other word that stands beside core words MET times or more joins the class under which its
   neighbours are likeliest. Its neighbours' classes are counted over all training text, and the words
   placed, in Spark; so there are as many words with a class as the corpus gives. The rest are the
   open class.
4. With ``whole``, as the query has it, words of the open class then join by all neighbours that have a
   class, in the core or not, and the steps from class to class are counted over all training words. Else
   words outside the core count as one class when they stand before another word.
5. A text's probability is the product of class transitions P(c | class of the word before), smoothed
   towards the class's share, and word emissions P(w | c). In the open class emissions are smoothed by
   absolute discounting; what the discount frees goes to words never seen, taken to be as many as the
   words seen.

The LISTED most frequent words are broadcast. Counts and classes of all other tokens of a text come from
a shuffle join with the vocabulary, which grows with the corpus; LISTED changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_SQL, doc_text, documents, hashed_words, mix, signed, written

CLASSES = 48
CLUSTERED = 2048
#: Times that a word must stand beside core words to join a class.
MET = 4
#: Words that are broadcast; a matter of speed alone.
LISTED = 200_000
DISCOUNT = 0.75
SWEEPS = 5
#: The key of a text's end token, as of a word that can't occur.
END = mix(np.array([1], np.uint64))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts' words, each text's followed by its end; and where each text begins."""
    words, at = hashed_words(texts)
    return np.insert(words, at[1:], END[0]), at + np.arange(len(at))


def held_out():
    """crc32(doc_id as text) mod 7 is 2; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _merge(a: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if a is not None:
        keys, counts = np.concatenate((a[0], keys)), np.concatenate((a[1], counts if counts is not None else np.ones(len(keys), np.int64)))
    if counts is None:
        keys = np.sort(keys)
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[start], np.diff(np.append(start, len(keys)))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[start], np.add.reduceat(counts, start)


def _counted(batches: Iterator[pa.RecordBatch], keys_of, names: list[str], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Count 64-bit keys over a task, handing on a partial result whenever `most` are held."""
    held = None

    def out(held):
        for a in range(0, len(held[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(signed(held[0][a : a + 100_000])), pa.array(held[1][a : a + 100_000])], names=names)

    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            found = keys_of(batch.column(0)[a : a + 1000].to_pylist())
            if not len(found):
                continue
            held = _merge(held, *_merge(None, found))
            if len(held[0]) > most:
                yield from out(held)
                held = None
    if held is not None:
        yield from out(held)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted(batches, lambda texts: tokens(texts)[0], ["word", "count"])


class Symbols:
    """Rank of a word's hash among the listed words; len(ranks) for others."""

    def __init__(self, ranked: np.ndarray):
        self.order = np.argsort(ranked)
        self.sorted = ranked[self.order]

    def rank(self, words: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.order[at], len(self.sorted))


def _bigrams(shared):
    """Counts of (core word or the symbol after them, likewise)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, core = Symbols(shared.value), len(shared.value)

        def pairs(texts: list[str]) -> np.ndarray:
            rank = symbols.rank(tokens(texts)[0]).astype(np.uint64)
            before = np.concatenate((rank[-1:], rank[:-1]))  # texts follow one another: each starts after an end
            return before * np.uint64(core + 1) + rank

        yield from _counted(batches, pairs, ["pair", "count"])

    return run


#: A key of contexts holds a word's upper bits, then 64 for what follows it, then the neighbour's class.
_WORD = np.uint64((1 << 64) - 128)


def _contexts(shared):
    """Counts of (word outside the core, side, class of its neighbour in the core)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, of = shared.value
        symbols, n = Symbols(core), len(core)
        of = np.append(of, 0).astype(np.uint64)

        def keys(texts: list[str]) -> np.ndarray:
            words = tokens(texts)[0]
            rank = symbols.rank(words)
            inside, out = rank < n, words & _WORD
            before, after = np.concatenate((rank[-1:], rank[:-1])), np.concatenate((rank[1:], rank[:1]))
            left, right = ~inside & (before < n), ~inside & (after < n)
            return np.concatenate((out[left] | of[before[left]], out[right] | np.uint64(64) | of[after[right]]))

        yield from _counted(batches, keys, ["key", "count"])

    return run


def _place(shared):
    """(key, neighbours) -> (key, class) of the words that are met often enough; and, without a key, how often
    each core class precedes each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, before, met = shared.value  # log P(class | class before), log P(class after | class)
        k = len(after)
        weight = np.zeros((128, k))
        weight[:k], weight[64 : 64 + k] = after, before.T
        total = np.zeros((k, k), np.int64)
        for batch in batches:
            lists = batch.column(1)
            found = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            row, at, n = np.repeat(np.arange(len(found)), found), flat.field(0).to_numpy(), flat.field(1).to_numpy()
            near = np.zeros((len(found), 128))
            near[row, at] = n
            enough = near.sum(1) >= met
            near = near[enough]
            of = (near @ weight).argmax(1)
            np.add.at(total.T, of, near[:, :k].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(enough)), pa.array(of, pa.int32()), pa.array(np.zeros(len(of), np.int64))], names=["key", "class", "count"])
        yield pa.RecordBatch.from_arrays([pa.array([None] * (k * k), pa.int64()), pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], names=["key", "class", "count"])

    return run


def _steps(shared):
    """Over all training text: how often each class precedes each (b the pair, a null), counts of (word whose class isn't
    at hand, side, class of its neighbour) (a such a key, b null), and pairs of two such words (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, of, k = shared.value
        symbols, of = Symbols(listed), np.append(of, k).astype(np.int64)
        total, held = np.zeros(k * k, np.int64), None
        names, kinds = ["a", "b", "count"], [pa.int64()] * 3

        def out(*columns):
            for at in range(0, len(columns[2]), 100_000):
                part = [pa.nulls(len(columns[2][at : at + 100_000]), pa.int64()) if c is None else pa.array(c[at : at + 100_000], t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(part, names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                words = tokens(batch.column(0)[at : at + 1000].to_pylist())[0]
                after = of[symbols.rank(words)]
                words = words & _WORD
                before, first = np.concatenate((after[-1:], after[:-1])), np.concatenate((words[-1:], words[:-1]))
                settled, led = after < k, before < k
                total += np.bincount((before * k + after)[settled & led], minlength=k * k)
                left, right, loose = ~settled & led, settled & ~led, ~settled & ~led
                keys = np.concatenate((words[left] | before[left].astype(np.uint64), first[right] | np.uint64(64) | after[right].astype(np.uint64)))
                if len(keys):
                    held = _merge(held, *_merge(None, keys))
                    if len(held[0]) > 2_000_000:
                        yield from out(signed(held[0]), None, held[1])
                        held = None
                if loose.any():
                    yield from out(signed(first[loose]), signed(words[loose]), np.ones(int(loose.sum()), np.int64))
        if held is not None:
            yield from out(signed(held[0]), None, held[1])
        yield from out(None, np.arange(k * k), total)

    return run


def _follow(texts: DataFrame, vocabulary: DataFrame, weights: np.ndarray, listed: int, order: list, met: int) -> tuple[DataFrame, np.ndarray]:
    """(the vocabulary with words of the open class placed by all their neighbours, steps from class to class over all words)."""
    spark, k = texts.sparkSession, len(weights)
    top = vocabulary.orderBy(*order).limit(listed).toArrow()
    steps = written(texts.mapInArrow(_steps(spark.sparkContext.broadcast((top["word"].to_numpy().view(np.uint64), top["class"].to_numpy(), k))), "a long, b long, count long"), "steps")
    classes = vocabulary.select(F.expr("word & -128L").alias("key"), "class")
    near = steps.where("b is null").groupBy("a").agg(F.sum("count").alias("count")).select(F.expr("a & -128L").alias("key"), F.expr("cast(a & 127 as int)").alias("near"), "count")
    near = written(near.join(classes, "key"), "near")
    pairs = steps.where("a is not null and b is not null").groupBy("a", "b").agg(F.sum("count").alias("count"))
    of = lambda c, name: classes.select(F.col("key").alias(c), F.col("class").alias(name))
    pairs = written(pairs.join(of("a", "of_a"), "a").join(of("b", "of_b"), "b"), "pairs")
    more = pairs.where(f"of_a < {k} and of_b = {k}").select(F.col("b").alias("key"), F.col("of_a").alias("near"), "count")
    more = more.unionByName(pairs.where(f"of_a = {k} and of_b < {k}").select(F.col("a").alias("key"), (F.col("of_b") + 64).alias("near"), "count"))
    beside = near.where(f"class = {k}").select("key", "near", "count").unionByName(more)
    lists = beside.repartition("key").groupBy("key", "near").agg(F.sum("count").alias("count")).groupBy("key").agg(F.collect_list(F.struct("near", "count")).alias("found"))
    placed = written(lists.mapInArrow(_place(spark.sparkContext.broadcast((weights, weights, met))), "key long, class int, count long").where("key is not null").select("key", F.col("class").alias("joined")), "placed")
    table = np.zeros((k + 1, k + 1))

    def count(rows: DataFrame, a: str, b: str) -> None:
        for row in rows.groupBy(a, b).agg(F.sum("count")).collect():  # k squared rows
            table[row[0], row[1]] += row[2]

    found = steps.where("a is null").groupBy("b").agg(F.sum("count").alias("count")).collect()
    for row in found:
        table[row["b"] // k, row["b"] % k] += row["count"]
    now = near.join(placed, "key", "left").select("near", "count", F.coalesce("joined", "class").alias("class"))
    count(now.where("near < 64"), "near", "class")
    count(now.where("near >= 64").withColumn("near", F.col("near") - 64), "class", "near")
    new = lambda c, name: placed.select(F.col("key").alias(c), F.col("joined").alias(name))
    now = pairs.join(new("a", "new_a"), "a", "left").join(new("b", "new_b"), "b", "left")
    count(now.select("count", F.coalesce("new_a", "of_a").alias("x"), F.coalesce("new_b", "of_b").alias("y")), "x", "y")
    out = vocabulary.withColumn("key", F.expr("word & -128L")).join(placed, "key", "left")
    return written(out.select("word", "count", F.when(F.col("class") == k, F.coalesce("joined", "class")).otherwise(F.col("class")).alias("class")), "vocabulary"), table


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, fixed: int = 2) -> np.ndarray:
    """Class of each of n words (in order of frequency) from bigram counts[n + fixed, n + fixed].

    The last ``fixed`` symbols stay in classes of their own. Words start dealt out by frequency; then each
    in turn moves to the class that raises the class bigram likelihood most, until none moves.
    """
    n = len(counts) - fixed
    classes = max(1, min(classes, n))
    k = classes + fixed
    of = np.concatenate((np.arange(n) % classes, classes + np.arange(fixed)))
    member = np.zeros((n + fixed, k))
    member[np.arange(n + fixed), of] = 1
    right, left = counts @ member, counts.T @ member  # words x classes: successors, predecessors
    table = member.T @ right
    entropy = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            c, self_ = of[w], counts[w, w]
            if member[:, c].sum() <= 1:
                continue
            r, le = right[w].copy(), left[w].copy()
            r[c] -= self_
            le[c] -= self_
            # take w out of its class
            table[c] -= r
            table[:, c] -= le
            table[c, c] -= self_
            rows, columns = table.sum(1), table.sum(0)
            row_e, all_e = entropy(table), np.arange(classes)
            # gain of putting w into each class: changed row, changed column, the corner, the totals
            gain = (entropy(table[:classes] + r) - row_e[:classes]).sum(1) + (entropy(table[:, :classes] + le[:, None]) - row_e[:, :classes]).sum(0)
            diagonal = table[all_e, all_e]
            gain += entropy(diagonal + r[:classes] + le[:classes] + self_) + entropy(diagonal) - entropy(diagonal + r[:classes]) - entropy(diagonal + le[:classes])
            size_r, size_l = r.sum() + self_, le.sum() + self_
            gain -= entropy(rows[:classes] + size_r) - entropy(rows[:classes]) + entropy(columns[:classes] + size_l) - entropy(columns[:classes])
            to = int(gain.argmax())
            if gain[to] <= gain[c] + 1e-9:
                to = c
            table[to] += r
            table[:, to] += le
            table[to, to] += self_
            if to != c:
                moved += 1
                of[w] = to
                member[w, c], member[w, to] = 0, 1
                right[:, c] -= counts[:, w]
                right[:, to] += counts[:, w]
                left[:, c] -= counts[w]
                left[:, to] += counts[w]
        if not moved:
            break
    return of


def fit(texts: DataFrame, classes: int = CLASSES, clustered: int = CLUSTERED, listed: int = LISTED, met: int = MET, whole: bool = False) -> tuple[dict, DataFrame]:
    """(the model's bounded part, the whole vocabulary (word, count, class)) from texts of one column."""
    if not 0 < classes <= 64:
        raise ValueError("classes must be 1 to 64")
    spark = texts.sparkSession
    counted = written(texts.mapInArrow(_words, "word long, count long").groupBy("word").agg(F.sum("count").alias("count")), "counted")
    facts = counted.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    if not facts["n"]:
        return {"n": 0, "v": 0}, counted
    end = int(END.view(np.int64)[0])
    order = [F.desc(F.col("word") == end), F.desc("count"), F.col("word")]  # the end token is always in the core
    core = counted.orderBy(*order).limit(clustered).toArrow()["word"].to_numpy().view(np.uint64)
    size = len(core)
    rows = texts.mapInArrow(_bigrams(spark.sparkContext.broadcast(core)), "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count")).toArrow()
    bigrams = np.zeros((size + 1) ** 2)
    bigrams[rows["pair"].to_numpy()] = rows["count"].to_numpy()
    bigrams = bigrams.reshape(size + 1, size + 1)
    of = exchange(bigrams, classes, fixed=1)
    k = int(of[-1])  # classes; as a class of words, k is the open one, as that of a word before, any outside the core
    member = np.zeros((size + 1, k + 1))
    member[np.arange(size + 1), of] = 1
    table = member.T @ bigrams @ member
    inner, strength = table[:k, :k], 5.0
    likely = lambda t: np.log((t + strength * (t.sum(0) + 0.5) / (t.sum() + 0.5 * k)) / (t.sum(1, keepdims=True) + strength))
    weights = likely(inner)
    contexts = texts.mapInArrow(_contexts(spark.sparkContext.broadcast((core, of[:-1]))), "key long, count long")
    # sums and lists by one exchange: hash partitions of the word serve both
    word, near = F.expr("key & -128L").alias("word"), F.expr("cast(key & 127 as int)").alias("near")
    lists = contexts.select(word, near, "count").repartition("word").groupBy("word", "near").agg(F.sum("count").alias("count")).groupBy("word").agg(F.collect_list(F.struct("near", "count")).alias("found"))
    placed = written(lists.mapInArrow(_place(spark.sparkContext.broadcast((weights, weights, met))), "key long, class int, count long"), "placed")
    for row in placed.where("key is null").groupBy("class").agg(F.sum("count").alias("count")).collect():  # k squared rows
        table[row["class"] // k, row["class"] % k] += row["count"]
    in_core = spark.createDataFrame(pa.table({"core": core.view(np.int64), "core_class": of[:-1].astype(np.int32)}))
    keyed = counted.withColumn("key", F.expr("word & -128L")).join(placed.where("key is not null").select("key", "class"), "key", "left")
    vocabulary = keyed.join(F.broadcast(in_core), F.col("word") == F.col("core"), "left").select("word", "count", F.coalesce("core_class", "class", F.lit(k)).alias("class"))
    vocabulary = written(vocabulary, "vocabulary")
    if whole:
        vocabulary, table = _follow(texts, vocabulary, weights, max(listed, size), order, met)
    total, kinds = np.zeros(k + 1), np.zeros(k + 1)
    for row in vocabulary.groupBy("class").agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect():
        total[row["class"]], kinds[row["class"]] = row["n"], row["v"]
    # what follows a core class and has no class itself is open; words before that aren't core make up the rest
    if not whole:
        followed = bigrams[:size].sum(1) @ member[:size]
        table[:k, k] = np.maximum(followed[:k] - table[:k, :k].sum(1), 0)
        table[k] = np.maximum(total - table[:k].sum(0), 0)
    share = (total + 0.5) / (total.sum() + 0.5 * (k + 1))
    transition = np.log10((table + strength * share) / (table.sum(1, keepdims=True) + strength))
    top = vocabulary.orderBy(*order).limit(max(listed, size)).toArrow()
    words, counts, word_class = top["word"].to_numpy().view(np.uint64), top["count"].to_numpy(), top["class"].to_numpy()
    emission = np.log10((counts - DISCOUNT * (word_class == k)) / total[word_class])
    return {
        "words": words, "counts": counts, "class": word_class, "transition": transition, "emission": emission, "n": facts["n"], "v": facts["v"], "core": size, "whole": whole, "total": total,
        "open_tokens": max(float(total[k]), 1.0), "open_words": max(float(kinds[k]), 1.0), "end": int(of[0]),
    }, vocabulary


PARTS = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:long,class:int,prev:long,before:int,times:long>>"
_FIELDS = [("word", pa.int64()), ("class", pa.int32()), ("prev", pa.int64()), ("before", pa.int32()), ("times", pa.int64())]
_RARE = pa.list_(pa.struct(_FIELDS))


def _parts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        symbols, listed = Symbols(m["words"]), len(m["words"])
        base = np.append(np.log10((m["counts"] + 1) / (m["n"] + m["v"] + 1)), 0.0)
        emission = np.append(m["emission"], 0.0)
        outside = m["transition"].shape[0] - 1
        word_class = np.append(m["class"], outside)
        # -1: a word whose class isn't at hand
        before_class = np.append(m["class"], -1) if m["whole"] else np.where(np.arange(listed + 1) < m["core"], word_class, outside)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                words, at = tokens(batch.column(1)[a : a + 1000].to_pylist())
                rank = symbols.rank(words)
                before = before_class[np.concatenate((rank[:1], rank[:-1]))]
                before[at[:-1]] = m["end"]
                sums = lambda x, at=at: np.add.reduceat(x, at[:-1])
                known, led = rank < listed, before >= 0
                steps = sums(np.where(known & led, m["transition"][before, word_class[rank]], 0.0) + np.where(known, emission[rank], 0.0))
                # steps of two words that aren't both at hand: each text's, with their counts
                other = np.flatnonzero(~(known & led))
                text_of = np.searchsorted(at, other, "right") - 1
                # what is at hand is known by its class, all else by its hash
                parts = [np.where(known[other], 0, signed(words[other])), np.where(known[other], word_class[rank[other]], -1), np.where(led[other], 0, signed(words[other - 1])), before[other]]
                order = np.lexsort((*parts, text_of))
                *parts, text_of = (part[order] for part in (*parts, text_of))
                new = np.flatnonzero(np.concatenate(([True], np.any([part[1:] != part[:-1] for part in (*parts, text_of)], axis=0)))) if len(order) else np.zeros(0, np.int64)
                n = len(at) - 1
                offsets = np.searchsorted(text_of[new], np.arange(n + 1)).astype(np.int32)
                word, of, prev, lead = (part[new] for part in parts)
                fields = [(word, of >= 0), (of, of < 0), (prev, lead >= 0), (lead, lead < 0), (np.diff(np.append(new, len(order))), None)]
                rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x, kind, mask=gone) for (x, gone), (_, kind) in zip(fields, _FIELDS, strict=True)], [name for name, _ in _FIELDS]))
                columns = [np.arange(row, row + n), batch.column(0)[a : a + 1000], np.diff(at), sums(known.astype(np.int64)), sums(base[rank]), steps, rare]
                row += n
                kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [_RARE]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    return run


def score(docs: DataFrame, **sizes: int) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end token alone. Without any training text nothing is known, and the
    base formula's value (of counts 0) is the score too. Only doc_id and text are read.
    """
    spark, texts = docs.sparkSession, doc_text(docs)
    model, vocabulary = fit(texts.where(~held_out()).select("text"), **sizes)
    n, v = model["n"], model["v"]
    if not n:
        one = F.size(F.split(F.regexp_replace("text", "[^ \\t-\\r]+", "x"), "x")).cast("long")
        zero = (one * F.lit(0)).cast("double")  # log10(1 / 1)
        return texts.select("doc_id", held_out().alias("held_out"), one.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    parts = written(texts.mapInArrow(_parts(spark.sparkContext.broadcast(model)), PARTS), "parts")
    k = len(model["total"]) - 1
    pairs = [(b, c, float(model["transition"][b, c]), float(max(model["total"][c], 1.0))) for b in range(k + 1) for c in range(k + 1)]
    steps = F.broadcast(spark.createDataFrame(pa.table(dict(zip(("before", "class", "step", "total"), ([*x] for x in zip(*pairs, strict=True)), strict=True)))).select(F.col("before").cast("int"), F.col("class").cast("int"), "step", "total"))
    rare = parts.select("row", F.explode("rare").alias("x")).select("row", "x.*")
    none = F.lit(None).cast("long").alias("count")
    lost = rare.where("word is not null").drop("class").join(vocabulary, "word", "left").select("row", "word", F.coalesce("class", F.lit(k)).alias("class"), "prev", "before", "times", "count")
    rare = lost.unionByName(rare.where("word is null").select("row", "word", "class", "prev", "before", "times", none)) if model["whole"] else lost
    if model["whole"]:
        led = vocabulary.select(F.col("word").alias("prev"), F.col("class").alias("led"))
        rare = rare.where("prev is null").unionByName(rare.where("prev is not null").join(led, "prev", "left").withColumn("before", F.coalesce("led", F.lit(k))).select(*rare.columns))
    rare = rare.join(steps, ["before", "class"])
    count, times = F.coalesce("count", F.lit(0)), F.col("times")
    open_tokens, open_words = model["open_tokens"], model["open_words"]
    unseen = F.lit(float(np.log10(DISCOUNT * open_words / open_tokens / (v + 1))))
    new = F.col("word").isNotNull()  # else only the step is still to be added
    emission = F.when(~new, 0.0).when(count == 0, unseen).when(F.col("class") == k, F.log10((count - DISCOUNT) / open_tokens)).otherwise(F.log10(count / F.col("total")))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(count > 0, times).otherwise(0)).alias("known"), F.sum(F.when(new, times * F.log10((count + 1) / F.lit(float(n + v + 1)))).otherwise(0.0)).alias("base"), F.sum(times * (F.col("step") + emission)).alias("model")
    )
    out = parts.drop("rare").join(rare, "row", "left")
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("model", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), whole=True)


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that SQL can express."""
    return query(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


#: DuckDB has no crc32: bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
  lambda x, b: list_reduce(list_prepend(xor(x, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)))"""
BASE_SQL = rf"""WITH t AS (SELECT doc_id, {_CRC_SQL} % 7 = 2 AS held_out, list_append(regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents),
o AS (SELECT doc_id, held_out, unnest(w) AS word FROM t),
c AS (SELECT word, count(*) AS c FROM o WHERE NOT held_out GROUP BY word),
f AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(f.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / CAST(f.n + f.v + 1 AS DOUBLE))), 4) AS base_score
FROM o LEFT JOIN c USING (word) CROSS JOIN f GROUP BY doc_id, held_out
"""
