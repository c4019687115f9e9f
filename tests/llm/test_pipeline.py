"""The pipeline: columns, effects of each stage, and the guards."""

import subprocess
import sys

import corpus_pipeline
from pyspark.sql import functions as F

from tidewarden.llm import decontaminate, jaccard_join

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
        counts.append(docs.count())
        if name == "line_dedup":
            assert docs.where(F.col("n_chars") != F.char_length("text")).isEmpty()
            lines = docs.select(F.explode(F.split("text", "\n")).alias("x")).where("size(split(x, ' ')) > 50")
            assert lines.groupBy("x").count().where("count > 1").isEmpty()
        elif name != "ngram_jaccard_join":
            pass
        else:
            groups = jaccard_join.jaccard_join(docs)
            assert groups.where("doc_id <> component_id").isEmpty()
    assert decontaminate.leaks(docs, bench).where(F.size("__items") > 0).isEmpty()
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_near_copies_without_a_key(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, text(1)), (None, text(1)), (7, text(1)), (3, text(2)), (3, text(2)), (3, text(3)), (None, text(4)), (None, text(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(7, text(1)), (3, text(2)), (3, text(3)), (None, text(4))]))


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_workers_give_memory_back():
    code = """
import re, sys
import pandas, pyarrow as pa, pyspark.worker, public_tokenizers
from tidewarden.llm import jaccard_join, line_dedup, packing

def mb():
    return sum(map(int, re.findall(r"\\n(?:Anonymous):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches(seed, n=6):
    for k in range(n):
        yield pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["\\n".join(" ".join(f"w{(seed + k * 1009 + i * 31 + j * j) % 90001}" for j in range(400)) for _ in range(2)) for i in range(1000)])], names=["doc_id", "text"])

def run(function, seed, n=6):
    for out in function(batches(seed, n)):
        out = None

run(jaccard_join._meta, 0, 1); run(line_dedup._occurrences, 0, 1)
first = mb()
packing.encoder_of(public_tokenizers.path("byte_bpe_50k.json")).encode([f"word{i} x{i}" for i in range(200_000)])
held = mb()
run(jaccard_join._meta, 7)
run(line_dedup._occurrences, 9)
print(first, held, mb())
"""
    first, held, after = map(float, subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout.split())
    assert held > first + 60  # the tokenizer and its words, which no other stage uses
    assert after < first + 48


def test_entry_point_without_the_corpus_operators(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/tidewarden", tmp_path / "tidewarden", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'incidents' in q and not any(x.startswith('op') for x in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
