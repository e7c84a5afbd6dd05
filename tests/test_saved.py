"""Details of wanted items: which row a key gets, and what is carried to find it."""

from pyspark.sql import functions as F

from feedlens.operators import saved as X
from feedlens.plans import reader

PAY = [f"cast(null as {kind}) AS {c}" for c, kind in (("salary_min", "double"), ("salary_max", "double"), ("salary_period", "string"), ("closes_at", "timestamp"))]


def test_resolved_rows_come_whole_and_unread_columns_stay_behind(spark):
    """The rows' own texts were carried through every sort and shuffle, whoever read them."""
    rows = spark.range(20).selectExpr("id AS url", "concat('whole text ', id) AS content_text", "if(id % 3 = 0, null, id) AS a", "id + 100 AS b", *PAY)
    twice = rows.where("url < 12").unionByName(rows.where("url < 12").withColumns({"a": F.col("a") + 1000, "b": F.col("b") + 1000}))
    kept = rows.where("url BETWEEN 10 AND 15").withColumns({"a": F.lit(-1).cast("long"), "b": F.lit(-1).cast("long")})
    details = spark.range(0, 20, 2).selectExpr("id AS url", "concat('d', id) AS description", *PAY)
    got = X.resolve_details(spark.range(18).selectExpr("id AS url"), twice, kept, details)
    found = {r["url"]: r for r in got.collect()}
    assert sorted(found) == list(range(16)) and all(r["origin"] == ("ranked" if u < 12 else "saved") for u, r in found.items())
    assert all(r["description"] == (f"d{u}" if u % 2 == 0 else None) and r["content_text"] == f"whole text {u}" for u, r in found.items())
    assert all((r["a"], r["b"]) in ((u if u % 3 else None, u + 100), (u + 1000 if u % 3 else None, u + 1100)) if u < 12 else (r["a"], r["b"]) == (-1, -1) for u, r in found.items())
    assert "whole text" not in got.select("url", "origin", "description")._jdf.queryExecution().optimizedPlan().toString()


def test_detail_resolution_joins_the_items_once(spark, small):
    plan = reader.resolved(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan
