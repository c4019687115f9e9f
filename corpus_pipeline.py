"""A cleaning pipeline over documents: five operators in a row, each stage written and read again."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from tidewarden.llm.common import drop_paths, noted, shared_dir, unused, written


#: Scratch tables of each session's last stage.
_scratch: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()


def _stage(function):
    """A stage's input is a written table, so what the stage before left in the shared folder can go."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mine = _scratch.setdefault(spark, [])
        drop_paths(spark, mine)
        with noted(mine):
            return function(spark, docs, sf_dir)

    run.__doc__ = function.__doc__
    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that it predicts to be toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of similar lines one stays; documents left without any go."""
    return line_dedup.dedup_lines(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of linked documents the one with the smallest doc_id stays; of rows without one or that share it, one."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        keep = unused(docs, "__keep")
        groups = jaccard_join.jaccard_join(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(keep))
        return docs.join(groups, docs["doc_id"] == F.col(keep), "left_semi")
    # doc_id is no key: the rows are numbered, in a written table so that the numbers hold
    row = unused(docs, "__row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard_join.jaccard_join(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))).alias("keep")
    keep = rows.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(first).select(F.col("keep.row").alias(row))
    return rows.join(keep, row, "left_semi").select(*docs.columns)


@_stage
def decontaminate_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_jaccard_join", drop_near_copies), ("decontamination", decontaminate_), ("packing", pack)]
#: Classifier, signatures and tokenizer are beyond SQL; tests/llm holds the stages against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/tidewarden/pipeline-{uuid.uuid4().hex}"
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        drop_paths(spark, before)  # the table that this stage has read
        before.append(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
