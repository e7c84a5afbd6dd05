"""Reuse of results: what counts as the same, what is built again, and what stays on disk."""

import os
from datetime import datetime, timezone

from feedlens.operators import ranking as R
from feedlens.sources.results import Results, bucket_of, bucket_start
from feedlens.streaming.store import Store

NOW = datetime(2020, 5, 1, 10, 59, tzinfo=timezone.utc)


def test_a_result_is_read_until_its_key_changes(spark, tmp_path):
    built, clock = [], [1000.0]
    results = Results(spark, f"{tmp_path}/r", lambda: clock[0])

    def build(at):
        built.append(at)
        return spark.range(len(built)).selectExpr("id", "'x' AS v")

    a, b = R.Profile(major="A"), R.Profile(major="A", interests=("X",))
    read = lambda generation, profile, now, freshness="exact": results.read("feed", generation, profile, now, build, freshness).count()
    assert [read(1, a, NOW), read(1, a, NOW.replace(minute=0)), read(1, R.Profile(major="A"), NOW)] == [1, 1, 1]
    assert built == [datetime(2020, 5, 1, 10, tzinfo=timezone.utc)] == [bucket_start(bucket_of(NOW))]
    assert read(2, a, NOW, "scanning") == 1 and read(2, a, NOW, "any") == 1  # a new generation, the old rows will do
    clock[0] += 21
    assert read(2, a, NOW, "scanning") == 2
    assert read(2, a, NOW.replace(hour=11)) == 3
    assert read(3, b, NOW.replace(hour=11), "any") == 4  # never another profile's
    assert read(3, b, NOW.replace(hour=23), "any") == 4
    assert len([x for x in os.listdir(f"{tmp_path}/r/feed") if x.startswith("rows-")]) == 2


def test_a_committed_batch_invalidates(spark, tmp_path):
    store, results, calls = Store(spark, f"{tmp_path}/s", {"items": ["url"]}), Results(spark, f"{tmp_path}/r"), []

    def ranked():
        def build(_):
            calls.append(1)
            return store.read("items")

        return results.read("feed", store.head()[0], {"major": "A"}, NOW, build).count()

    store.commit(0, {"items": spark.createDataFrame([("a", 1)], "url string, n int")})
    assert [ranked(), ranked(), len(calls)] == [1, 1, 1]
    store.commit(1, {"items": spark.createDataFrame([("b", 1)], "url string, n int")})
    assert [ranked(), ranked(), len(calls)] == [2, 2, 2]
