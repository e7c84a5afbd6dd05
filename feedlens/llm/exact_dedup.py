"""Exact deduplication by skew-safe combining.

Rows are combined three times and every time the grouping key holds the whole normalised text, so a digest
collision never merges two texts:

1. inside each task (Spark's partial aggregation over digest, salt and text),
2. per (digest, salt, text) after a shuffle; the salt is the number of the reading task modulo `salts`, so a text
   that makes up a third of the table reaches `salts` tasks as one row from each reading task,
3. per (digest, text) over the winners of the salts.

The rows then find their group by sha-256, xxhash64 and length of the text, so no text is shuffled a third time. That is
exact: should two texts ever share all three, the query stops with an error, as the groups, which were made by content, show it.
A hot digest is split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import ascii_lower


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest id stays.
    Rows with a null id form groups like all others and stay only where their whole group has null ids. Rows that
    repeat an id and its text count in group_size, and all of them carry the same flag. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    norm = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest")
    )
    local = (
        rows.withColumn("salt", F.spark_partition_id() % F.lit(salts))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    groups = (
        local.groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .select("digest", F.xxhash64("norm").alias("h"), F.octet_length("norm").alias("len"), "keep_id", "group_size")
        .groupBy("digest", "h", "len")
        .agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        # A filter, as no later projection can leave it out.
        .where(F.when(F.col("texts") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("two texts share a digest")).cast("boolean")))
        .drop("texts")
    )
    keys = rows.select("doc_id", "digest", F.xxhash64("norm").alias("h"), F.octet_length("norm").alias("len"))
    return keys.join(groups, ["digest", "h", "len"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
