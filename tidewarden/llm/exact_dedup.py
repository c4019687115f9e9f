"""Operator 1, exact dedup, in DataFrame functions only.

Misra-Gries summaries of all digests (Spark's ``approx_top_k`` sketches, one for each of 64 parts of
the rows) name at most WINNERS frequent ones. Their true counts and survivors are then counted exactly, that table is broadcast (WINNERS
rows at most) and settles their rows on the map side. The remaining digests, none of which can hold
more than a small share of the rows, go through one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small, written

WINNERS = 256
TRACKED = 4096


def exact_dedup(docs: DataFrame, winners: int = WINNERS, tracked: int = TRACKED) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id stays (a
    null doc_id is the smallest); of rows that repeat doc_id and text exactly one stays. Other
    columns are ignored. An empty table gives no rows.
    """
    rows = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest")).withColumn(
            "row_no", F.monotonically_increasing_id()
        ),
        "digests",
    )
    key = F.xxhash64("digest")
    summary = rows.select(key.alias("key"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).groupBy("part").agg(F.expr(f"approx_top_k_accumulate(key, {tracked})").alias("s"))
    # a digest that is frequent overall is frequent in one of the parts; the sums only rank candidates
    found = summary.select(F.explode(F.expr(f"approx_top_k_estimate(s, {winners})")).alias("x")).groupBy("x.item").agg(F.sum("x.count").alias("count"))
    total = rows.count()
    frequent = [x["item"] for x in found.where(F.col("count") > max(1, total // (2 * winners))).orderBy(F.desc("count"), "item").limit(winners).collect()]
    best = F.max(F.struct(F.col("doc_id"), F.col("row_no")))
    columns = [F.col("doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("group_size"), (F.col("best.row_no") == F.col("row_no")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    rest = rows
    if frequent:
        # exact counts of the candidates: a partial aggregate of at most `winners` groups a task
        heavy = written(rows.where(key.isin(frequent)).groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")), "winners")
        heavy = small(heavy, heavy.count(), 4 * winners)
        rest = rows.join(heavy, "digest", "left_anti")
    # one shuffle: no remaining digest is frequent
    over = Window.partitionBy("digest")
    out = rest.select("*", best.over(over).alias("best"), F.count("*").over(over).alias("group_size")).select(*columns)
    return out.unionByName(rows.join(heavy, "digest").select(*columns)) if frequent else out


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. doc_id is taken to be a key."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__keep"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
