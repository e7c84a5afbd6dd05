"""Views of the given tables in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings: documents with the dates and prices of the order of the same number, pay where their quality is 1."""
    d, o, la = (table(spark, sf_dir, n) for n in ("documents", "orders", "labels"))
    n = F.col("doc_id")
    place = F.when(n % 6 == 0, "Toronto, ON | Remote").when(n % 6 == 1, "San Francisco, CA").when(n % 6 == 2, "London<br>Hybrid")
    place = place.when(n % 6 == 3, "Remote").when(n % 6 == 4, "Multiple | New York | Seattle, WA")
    joined = d.join(o.select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_custkey"), F.col("o_orderkey") == n)
    joined = joined.join(la.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    return joined.select(
        n,
        F.concat(F.lit("https://"), "lang", F.lit(".example.com/"), "source", F.lit("/"), n.cast("string")).alias("url"),
        F.when(n % 4 == 0, "Internship").when(n % 4 == 1, "Job").when(n % 4 == 2, "Article").otherwise("Event").alias("item_type"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("content_text"),
        F.col("source").alias("source_platform"),
        F.when(n % 7 != 0, F.concat(F.lit("Company "), (n % 37).cast("string"))).alias("company"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(n % 3 == 0, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '30' DAY")).alias("closes_at"),
        F.when(F.col("quality") == 1, F.col("o_totalprice")).alias("salary_min"),
        F.lit(None).cast("double").alias("salary_max"),
        F.when(F.col("o_orderstatus") == "F", "year").when(F.col("o_orderstatus") == "O", "month").alias("salary_period"),
        place.alias("location"),
        (n % 11 == 0).alias("seen"),
        (n % 13 == 0).alias("saved"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("dismissed"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation log from lineitem: url, run, source_rank, seq and the observed columns."""
    li = table(spark, sf_dir, "lineitem")
    seq = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey", "l_quantity", "l_discount", "l_tax")
    return li.select(
        F.col("l_partkey").alias("url"),
        F.year("l_shipdate").alias("run"),
        (F.col("l_suppkey") % 28).alias("source_rank"),
        seq.alias("seq"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_linestatus").alias("status"),
        F.when(F.col("l_returnflag") != "N", F.col("l_discount")).alias("gain"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("pay_min"),
        F.when(F.col("l_returnflag") == "A", F.col("l_tax")).alias("pay_max"),
        F.col("l_shipdate").alias("seen_at"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as lines of a field (the role): url, field, line, text."""
    c = table(spark, sf_dir, "conversations")
    split = c.select(F.col("conv_id").alias("url"), "turn", F.col("role").alias("field"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return split.select("url", "field", (F.col("turn") * 10_000 + F.col("pos")).alias("line"), "text")
