"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeflow.llm.common import documents, lower_ascii, store


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_groups(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text", normalise: Callable[[Column], Column] = lower_ascii, digest: Callable[[Column], Column] = sha256_hex, salts: int = 16) -> DataFrame:
    """Group rows of equal normalised text; the row with the largest id of a group stays.

    Three combining steps, each with the digest *and the whole content* as key, so that
    only equal texts ever meet: within a task (partial aggregation), within a salt of a
    digest (the salt is the task's number, so that a text held by a third of all rows
    arrives in ``salts`` places, one row from each task), then over the salts. Rows find
    their group again by digest alone where that digest has one content; digests shared
    by different contents are joined by content.

    Returns id, keep_id, group_size, kept, digest, one row for each input row. Null text
    counts as empty. Rows repeated with one id all count, and all stay if that id stays;
    null ids lose to any other. Other input columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    content = rows.select(F.col(id_column).alias("id"), normalise(F.coalesce(F.col(text_column), F.lit(""))).alias("content")).withColumn("digest", digest(F.col("content")))
    salted = content.withColumn("salt", F.spark_partition_id() % salts)
    winners = salted.groupBy("digest", "content", "salt").agg(F.max("id").alias("keep_id"), F.count("*").alias("size"))
    merged = winners.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("size").alias("size"))
    groups = store(merged.groupBy("digest").agg(F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.max("size").alias("size")), "exact-groups")

    def out(joined: DataFrame) -> DataFrame:
        return joined.select(F.col("id").alias(id_column), "keep_id", F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")

    result = out(content.drop("content").join(groups.filter("contents = 1"), "digest"))
    shared = groups.filter("contents > 1").select("digest")
    if shared.isEmpty():
        return result
    twins = content.join(shared, "digest")
    own = twins.groupBy("digest", "content").agg(F.max("id").alias("keep_id"), F.count("*").alias("size"))
    return result.unionByName(out(twins.join(own, ["digest", "content"])))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


OP4_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
