"""Operator 5, licence scans.

An Aho-Corasick automaton over the text's words finds the base phrases, the notice phrases and the
identifier tag; what follows a tag is read as a licence expression by a shunting-yard parser
(``with`` binds before ``and``, ``and`` before ``or``) and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER_SQL, doc_text, documents

#: Phrases and labels that are given.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases, in words as the scan cuts them, and the labels they add.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "free and unencumbered software": "unlicense",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "confidential and proprietary": "proprietary",
    "boost software license": "bsl",
    "isc license": "isc",
}
TAG = "spdx license identifier"
TAG_START = re.compile(r"SPDX-License-Identifier\s*:\s*", re.I)
LINE_END = re.compile(r"[\r\n]")
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: Prefix of a lower-case identifier -> label.
FAMILIES = [("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("mpl", "mpl"), ("epl", "epl"), ("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("cc-by-nd", "cc-by-nd"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("isc", "isc"), ("unlicense", "unlicense"), ("bsl", "bsl"), ("zlib", "zlib")]
PERMISSIVE = {"apache", "mit", "bsd", "isc", "cc0", "cc-by", "unlicense", "bsl", "zlib", "public-domain"}
WEIGHT = {"base": 0.9, "reserved": 0.5, "notice": 0.8, "tag": 0.98}

_SEPARATORS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_())]
)


@dataclass(frozen=True)
class Expression:
    """labels: every identifier's label; permissive: may the text be used on permissive terms?"""

    labels: frozenset[str]
    permissive: bool
    text: str


def label_of(identifier: str) -> str | None:
    lower = identifier.lower().rstrip("+")
    return next((label for prefix, label in FAMILIES if lower == prefix or lower.startswith(prefix + "-") or lower.startswith(prefix) and lower[len(prefix) :][:1].isdigit()), None)


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None if the expression isn't well-formed."""
    rank, out, stack, operand = {"or": 1, "and": 2, "with": 3}, [], [], True
    for token in tokens:
        low = token.lower()
        if low in rank:
            if operand:
                return None
            while stack and stack[-1] != "(" and rank[stack[-1]] >= rank[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def longest(text: str) -> list[str]:
    """Tokens of the longest well-formed expression at the start of text, in one pass."""
    tokens, end, depth, operand = [], 0, 0, True
    for found in TOKEN.finditer(text):
        token = found[0]
        # operands and "(" come where an operand is due, operators and ")" where none is; nothing mends a break
        if (token == ")" or token.lower() in ("or", "and", "with")) == operand or token == ")" and not depth:
            break
        tokens.append(token)
        if token in ("(", ")"):
            depth += 1 if token == "(" else -1
        else:
            operand = not operand
        if not operand and not depth:
            end = len(tokens)
    return tokens[:end]


def parse(text: str) -> Expression | None:
    """The longest well-formed expression at the start of text; None without a known identifier.

    A shorter one never has labels that the longest lacks.
    """
    tokens = longest(text)
    stack: list[tuple[frozenset[str], bool]] = []
    for token in to_postfix(tokens) or ():
        if token not in ("or", "and", "with"):
            label = label_of(token)
            stack.append((frozenset([label] if label else []), label in PERMISSIVE))
            continue
        (b, ok_b), (a, ok_a) = stack.pop(), stack.pop()
        # an exception adds permissions to its licence and is none itself
        stack.append((a, ok_a) if token == "with" else (a | b, ok_a or ok_b if token == "or" else ok_a and ok_b))
    return Expression(*stack[0], " ".join(tokens)) if stack and stack[0][0] else None


def tag_texts(text: str) -> Iterator[str]:
    """What follows each tag, up to the next tag or the end of the line."""
    tags = list(TAG_START.finditer(text))
    for tag, after in zip(tags, [*(t.start() for t in tags[1:]), len(text)], strict=True):
        line_end = LINE_END.search(text, tag.end(), after)
        yield text[tag.end() : line_end.start() if line_end else after]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str, trie) -> tuple:
    words = text.encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()
    joined = f" {b' '.join(words).decode('latin-1')} "  # one character a byte
    base, first, last, base_labels, labels, miss, tags = 0, None, None, set(), set(), 1.0, False
    at, word = 0, 0
    hits = sorted((end - len(phrase) - 1, phrase) for end, phrase in trie.iter(joined))
    for start, phrase in hits:
        word += joined.count(" ", at, start)
        at = start
        if phrase in BASE:
            base += 1
            first, last = word if first is None else first, word
            base_labels.add(BASE[phrase])
            miss *= 1 - WEIGHT["reserved" if phrase == "all rights reserved" else "base"]
        elif phrase == TAG:
            tags = True
        else:
            labels.add(NOTICES[phrase])
            miss *= 1 - WEIGHT["notice"]
    expressions = [x for x in map(parse, tag_texts(text)) if x] if tags else []
    for x in expressions:
        labels |= x.labels
        miss *= 1 - WEIGHT["tag"]
    labels |= base_labels
    permissive = all(x.permissive for x in expressions) if expressions else (labels <= PERMISSIVE if labels else None)
    return len(words), base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - miss, [x.text for x in expressions], permissive


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = automaton()
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            rows = [scan(t, trie) for t in batch.column(1)[a : a + 1000].to_pylist()]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + 1000], *(pa.array(c, t) for c, t in zip(columns, ARROW.types[1:], strict=True))], schema=ARROW)


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive.

    A null or empty text has no words, no labels and score 0. Phrases may overlap; each place counts.
    Only doc_id and text are read; rows that repeat come out repeated.
    """
    return doc_text(docs).mapInArrow(_scan, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that SQL can express."""
    return query(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_SQL = rf"""WITH t AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, [('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])] AS f, w FROM t),
h AS (SELECT doc_id, n, list_filter(range(1, n + 1), lambda i: w[i:i + 1] = ['cc', 'by']) AS a, list_filter(range(1, n + 1), lambda i: w[i:i + 2] = ['general', 'public', 'license']) AS b, list_filter(range(1, n + 1), lambda i: w[i:i + 2] = ['all', 'rights', 'reserved']) AS c FROM p)
SELECT doc_id, n AS n_words, CAST(len(a) + len(b) + len(c) AS BIGINT) AS n_base, list_min(a || b || c) - 1 AS first_word, list_max(a || b || c) - 1 AS last_word,
  concat_ws(',', CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END) AS base_labels FROM h
"""
