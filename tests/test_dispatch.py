"""The payload dispatcher: one scan, odd payloads, and the same rows from a stream."""

import datetime as dt

from feedlens.sources import dispatch

AT = dt.datetime(2020, 6, 30)
ROWS = [
    ("g", AT, '{"jobs": [{"title": "Clerk", "absolute_url": "u1", "location": {"name": "Rome"}, "first_published": "2020-05-01"}, {"title": "Intern", "absolute_url": "u2"}]}'),
    ("r", AT, '[{"title": "A", "careers_url": "u3", "status": "draft"}, {"title": "B", "careers_url": "u4", "status": null, "published_at": "2020-05-02 10:00:00 UTC"}]'),
    ("w", AT, '{"title": "C", "url": "u5", "published_on": "2020-05-03", "employment_type": "Internship", "extra": [1, {"deep": true}]}'),
    ("g", AT, "not json"), ("g", AT, None), ("g", AT, "[]"), ("r", AT, '{"offers": []}'), ("nobody", AT, "{}"), (None, AT, "{}"),
]
SCHEMA = "source string, fetched_at timestamp, payload string"
WANT = [("g", "u1", "Job", "2020-05-01", "Rome"), ("g", "u2", "Internship", "2020-05-31", None), ("r", "u4", "Job", "2020-05-02", None), ("w", "u5", "Internship", "2020-05-03", None)]


def registry(spark):
    return spark.createDataFrame([("g", "greenhouse", 0), ("r", "recruitee", 1), ("w", "workable", 2), ("x", "unheard of", 3)], "source string, family string, source_rank int")


def seen(rows):
    return sorted((r["source"], r["url"], r["item_type"], str(r["ts"])[:10], r["location"]) for r in rows)


def test_all_families_from_one_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = dispatch.dispatch(spark.read.parquet(f"{tmp_path}/in"), registry(spark))
    assert seen(got.collect()) == WANT
    assert got._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    left = {r["source"]: r["payloads"] for r in dispatch.unrouted(spark.read.parquet(f"{tmp_path}/in"), registry(spark)).collect()}
    assert left == {"nobody": 1, None: 1}


def test_the_same_rows_from_a_stream(spark, tmp_path):
    for k, row in enumerate(ROWS):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = dispatch.dispatch(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in"), registry(spark))
    stream.writeStream.format("memory").queryName("landed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen(spark.table("landed").collect()) == WANT
