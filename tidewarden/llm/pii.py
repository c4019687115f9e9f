"""Operator 8, personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Seeds: e-mail addresses, IP addresses, payment cards and phone numbers, by pattern and check.
2. Patterns: the two words, and the last word alone, to the left of an identifier-like token, digits
   masked. Tokens inside a seed don't count.
3. The graph of patterns and instances grows in rounds: a pattern's score for a kind is the share of
   its distinct instances that are believed to be of that kind (smoothed); with SUPPORT believed
   instances and a score of SURE it is admitted, and its other instances are believed by that score.
   Seeds are believed. Rounds end when no instance is new.
4. All admitted patterns are joined to the tokens and discover identifiers that no seed pattern knows;
   where two patterns fit, the surer one tells the kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, documents, small, written

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Seeds' patterns. Equal to the plain ones, leftmost without overlap, but never retry inside a run.
REGEX = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: An identifier-like token: a word, up to a comma or semicolon, with a digit after its first character.
TOKEN = r"(?<!\S)[A-Za-z0-9+(@](?=[^\s,;0-9]*+[0-9])[^\s,;]*+"
LONGEST = 122
#: Left contexts of two words and of one, and the most characters they take, with one to see a word's beginning.
CONTEXTS = [r"(?<!\S)(\S{1,30}+\s{1,3}+\S{1,30}+)\s{1,3}+$", r"(?<!\S)(\S{1,30}+)\s{1,3}+$"]
REACH = 67
SUPPORT = 5
SURE = 0.75


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return {"email": F.lit(True), "ip": m.rlike(rf"^(?:{PART}\.){{3}}{PART}$"), "card": F.call_function("luhn_check", digits), "phone": F.length(digits).between(8, 15)}[kind]


def _keep(kind: str):
    return lambda x: _valid(kind, x["word"])


#: Matches whose places are summed up in a row; appending to an array copies it.
RUN = 256
_SPANS = "array<struct<kind:int,start:int,stop:int,word:string>>"


def _places(matches: str, between: str, kind: int) -> Column:
    """Code-point spans of matches, from the stretches between them; of many, in runs of RUN."""

    def run(start: str, first: str, last: str) -> str:
        return f"""aggregate(sequence({first}, {last}), named_struct('at', {start}, 'out', cast(array() AS {_SPANS})),
          (a, i) -> named_struct('at', a.at + length({between}[i]) + length({matches}[i]),
            'out', concat(a.out, array(named_struct('kind', {kind}, 'start', a.at + length({between}[i]), 'stop', a.at + length({between}[i]) + length({matches}[i]), 'word', {matches}[i])))),
          a -> a.out)"""

    size = f"size({matches})"
    width = lambda c: f"aggregate(sequence({c} * {RUN}, {c} * {RUN} + {RUN - 1}), 0, (n, i) -> n + length({between}[i]) + length({matches}[i]))"
    # where each run begins
    begins = f"""aggregate(sequence(0, ({size} - 1) div {RUN}), named_struct('at', 0, 'out', cast(array() AS array<int>)),
          (a, c) -> named_struct('at', a.at + if((c + 1) * {RUN} <= {size}, {width('cast(c as int)')}, 0), 'out', concat(a.out, array(a.at))), a -> a.out)"""
    many = f"""flatten(transform({begins}, (at, c) -> {run('at', f'c * {RUN}', f'least(c * {RUN} + {RUN - 1}, {size} - 1)')}))"""
    return F.expr(f"CASE WHEN {size} = 0 THEN cast(array() AS {_SPANS}) WHEN {size} <= {RUN} THEN {run('0', '0', f'{size} - 1')} ELSE {many} END")


def seeds(texts: DataFrame) -> DataFrame:
    """texts with a column per kind: the valid spans, in order."""
    digit = F.col("text").rlike("[0-9]")
    none = F.array().cast("array<string>")
    needs = lambda k: F.col("text").contains(NEEDS[k]) if NEEDS[k] else F.lit(True)
    out = texts.withColumn("__digit", digit)
    out = out.withColumns({f"__m_{k}": F.when(needs(k) & (F.lit(True) if k == "email" else F.col("__digit")), F.regexp_extract_all("text", F.lit(REGEX[k]), F.lit(0))).otherwise(none) for k in KINDS})
    out = out.withColumns({f"__b_{k}": F.when(F.size(f"__m_{k}") > 0, F.split("text", REGEX[k], -1)).otherwise(none) for k in KINDS})
    out = out.withColumns({f"__s_{k}": F.filter(_places(f"__m_{k}", f"__b_{k}", i), _keep(k)) for i, k in enumerate(KINDS)})
    return out.select(*texts.columns, "__digit", *(F.col(f"__s_{k}").alias(k) for k in KINDS))


def _masked(context: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(context, "[0-9]+", "#"), r"\s+", " "))


def occurrences(found: DataFrame) -> DataFrame:
    """(text_key, start, stop, instance, contexts, kind): every identifier-like token; kind null if no seed."""
    out = found.where("__digit").withColumn("__m", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).where(F.size("__m") > 0)
    out = out.withColumn("__b", F.split("text", TOKEN, -1)).withColumn("base", F.concat(*KINDS))
    out = out.select(F.sha2(F.col("text").cast("binary"), 256).alias("text_key"), "text", "base", F.explode(_places("__m", "__b", -1)).alias("x"))
    out = out.where(F.length("x.word") <= LONGEST).withColumn("word", F.regexp_replace("x.word", r"[.:!?)\]>\"']+$", "")).withColumn("start", F.col("x.start")).withColumn("stop", F.col("start") + F.length("word"))
    # a token in the middle of a seed begins nothing; one that a seed begins in stands for it
    out = out.where(~F.exists("base", lambda b: (b["start"] < F.col("start")) & (F.col("start") < b["stop"])))
    seed = F.get(F.filter("base", lambda b: (b["start"] >= F.col("start")) & (b["start"] < F.col("stop"))), F.lit(0))
    left = F.expr(f"substring(text, greatest(start - {REACH}, 0) + 1, least(start, {REACH}))")
    contexts = F.filter(F.array_distinct(F.array(*(_masked(F.regexp_extract(left, c, 1)) for c in CONTEXTS))), lambda c: c != "")
    return out.select("text_key", "start", "stop", F.coalesce(seed["word"], F.col("word")).alias("instance"), contexts.alias("contexts"), seed["kind"].alias("kind"))


def graph(tokens: DataFrame) -> DataFrame:
    """(pattern, instance, kind) of the tokens; kind null if no seed."""
    return tokens.select(F.explode("contexts").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))


def patterns(edges: DataFrame, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """(pattern, kind, score) of all sure patterns."""
    # a pattern of fewer instances can't have the support
    shared = written(edges.join(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support), "pattern"), "graph")
    belief = written(shared.where("kind is not null").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("belief", F.lit(1.0)), "belief")
    while True:
        scores = shared.drop("kind").join(belief, "instance").groupBy("pattern", "kind", "n").agg(F.sum("belief").alias("sum"), F.count("*").alias("believed"))
        scores = scores.withColumn("score", F.col("sum") / (F.col("n") + 1)).where((F.col("believed") >= support) & (F.col("score") >= sure))
        chosen = written(scores.groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score")), "chosen")
        new = shared.drop("kind").join(small(chosen), "pattern").groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("belief"))
        new = written(new.join(belief, "instance", "left_anti"), "new")
        if new.isEmpty():
            return chosen
        belief = written(belief.unionByName(new), "belief")


def find(docs: DataFrame, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    spans has the seeds and what the learned patterns add (never over a seed), as kind:start:end by
    kind and start, comma-joined. Null and empty texts have none. Only doc_id and text are read;
    rows that repeat come out repeated.
    """
    found = seeds(doc_text(docs))
    tokens = written(occurrences(found), "tokens")
    chosen = patterns(graph(tokens), support=support, sure=sure)
    found = found.withColumn("__base", F.concat(*KINDS))
    spans = F.col("__base")
    if not chosen.isEmpty():
        hits = tokens.where("kind is null").select("text_key", "start", "stop", "instance", F.explode("contexts").alias("pattern")).join(small(chosen), "pattern")
        hits = hits.groupBy("text_key", "start", "stop", "instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        # what is found depends on the text alone, so equal texts share it; at most a text's own tokens
        added = written(hits.groupBy("text_key").agg(F.collect_list(F.struct("kind", "start", "stop", F.col("instance").alias("word"))).alias("__new")), "added")
        found = found.withColumn("text_key", F.sha2(F.col("text").cast("binary"), 256)).join(small(added, limit=100_000), "text_key", "left")
        spans = F.concat("__base", F.coalesce("__new", F.array().cast("array<struct<kind:int,start:int,stop:int,word:string>>")))
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(text(F.col("__base")).cast("binary"), 256).alias("base_sha256"), text(F.array_distinct(F.array_sort(spans))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that SQL can express."""
    return query(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


#: The plain patterns, and what their matches x must be, for DuckDB.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(x, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) <= 255))",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[-i] AS INTEGER) ELSE CAST({_DIGITS}[-i] AS INTEGER) * 2 - CASE WHEN {_DIGITS}[-i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}


def _spans_sql(kind: str) -> str:
    text, i = "coalesce(text, '')", KINDS.index(kind)
    return f"""SELECT doc_id, {i} AS kind, '{kind}' AS name, s, s + length(x) AS z FROM (
  SELECT doc_id, m[i] AS x, CAST(list_sum(list_transform(b[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, m, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all({text}, '{_PLAIN[kind]}') AS m, string_split_regex({text}, '{_PLAIN[kind]}') AS b FROM documents))) WHERE {_VALID[kind]}"""


BASE_SQL = f"""WITH v AS ({" UNION ALL ".join(map(_spans_sql, KINDS))})
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
  sha256(coalesce(string_agg(name || ':' || s || ':' || z, ',' ORDER BY kind, s), '')) AS base_sha256 FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY d.doc_id
"""
