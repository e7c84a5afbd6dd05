"""Streams against their batch forms."""

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feedlens.operators import entities as E
from feedlens.operators import liveness as L
from feedlens.streaming import boards, ingest, store


def write_parts(df, path, by, n):
    for k in range(n):
        df.where(F.pmod(F.xxhash64(by), F.lit(n)) == k).coalesce(1).write.mode("append").parquet(path)


def test_upsert_stream_over_many_batches(spark, tmp_path):
    """Runs arrive in order, several micro-batches each; the folded state equals the batch upsert."""
    rng = random.Random(4)
    rows = []
    for seq in range(400):
        rows.append((rng.randrange(12), seq // 100, rng.randrange(4), seq, rng.randrange(9), None if rng.random() < 0.5 else rng.randrange(9)))
    schema = "url int, run int, source_rank long, seq int, quantity int, gain int"
    for k in range(8):
        spark.createDataFrame(rows[k * 50 : (k + 1) * 50], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/log")
    fold = ingest.upsert_state("url", "run", "source_rank", "seq", ["quantity"], ["gain"])
    work = f"{tmp_path}/work"
    got = ingest.fold_stream(stream, fold, work, ["url"], buckets=5).select("url", "quantity", "gain", "last_run").collect()
    again = ingest.fold_stream(stream, fold, work, ["url"], buckets=5)  # a restart without new data
    assert sorted(map(tuple, again.select("url", "quantity", "gain", "last_run").collect())) == sorted(map(tuple, got))
    want = E.ranked_upsert(spark.createDataFrame(rows, schema), "url", "run", "source_rank", "seq", ["quantity"], ["gain"]).select("url", "quantity", "gain", "last_run").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def answers_of(spark, rows, folder, parts=1):
    df = spark.createDataFrame(rows, "board string, ts timestamp, answer string, n int")
    df = df.withColumn("_k", F.ntile(parts).over(W.orderBy("ts")))
    for k in range(1, parts + 1):
        df.where(F.col("_k") == k).drop("_k").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.drop("_k").schema).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "1 hour")


def health(spark, stream, tmp_path, **more):
    boards.rocks(spark)
    kept = store.Store(spark, f"{tmp_path}/health", {"health": ["board"]})
    store.run_stream(boards.board_health(stream, **more), kept, lambda _, batch: {"health": batch})
    return {r["board"]: (r["strikes"], r["last_strike"], r["last_count"], r["last_try"]) for r in kept.read("health").collect()}


def test_board_health_stream_of_five_batches(spark, tmp_path):
    rng = random.Random(6)
    start = dt.datetime(2020, 1, 1)
    rows = [(f"b{rng.randrange(6)}", start + dt.timedelta(hours=3 * k), rng.choice(["Rows", "Gone", "Empty", "Gone", "Empty", "Unclear"]), rng.choice([None, 5])) for k in range(200)]
    got = health(spark, answers_of(spark, rows, f"{tmp_path}/in", 5), tmp_path)
    want: dict = {}
    for board, ts, answer, n in rows:
        t = int(ts.replace(tzinfo=dt.timezone.utc).timestamp())
        strikes, last, count, _ = want.get(board, (0, None, None, None))
        strikes, last = boards.advance(strikes, last, t, answer)
        want[board] = strikes, last, {"Rows": n, "Unclear": count}.get(answer, 0), t
    assert got == want
    batch = L.strikes(spark.createDataFrame(rows, "board string, ts timestamp, answer string, n int"), "board", "ts", "answer").collect()
    assert {r["board"]: r["strikes"] for r in batch} == {b: v[0] for b, v in got.items()}


def test_silent_boards_are_forgotten(spark, tmp_path):
    day = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(days=d)
    rows = [("quiet", day(0), "Gone", None), ("quiet", day(2), "Gone", None), ("loud", day(0), "Gone", None), ("loud", day(20), "Gone", None), ("loud", day(45), "Empty", None), ("loud", day(46), "Unclear", None), ("quiet", day(47), "Gone", None), ("loud", day(48), "Gone", None)]
    stream = answers_of(spark, rows, f"{tmp_path}/in", 8)
    got = health(spark, stream, tmp_path, forget_ms=30 * 24 * 3600 * 1000)
    assert {b: v[0] for b, v in got.items()} == {"quiet": 1, "loud": 4}


def test_runs_in_which_all_failed_are_not_trusted(spark):
    answers = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "board string, run int")
    outcomes = spark.createDataFrame([(1, True), (1, False), (2, False), (2, False), (3, None)], "run int, ok boolean")
    assert [r["board"] for r in boards.trusted(answers, outcomes).collect()] == ["a"]


def test_batches_write_only_the_buckets_they_touch(spark, tmp_path):
    schema = "url int, at int, mark int"
    fold = ingest.last_event_state(["url"], ["at"], ["mark"])
    assert ingest.state_of(spark, f"{tmp_path}/work") is None

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        return ingest.fold_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), fold, f"{tmp_path}/work", ["url"], buckets=16)

    feed([(k, 0, k) for k in range(200)])
    before = ingest.versions(spark, f"{tmp_path}/work")
    got = {r["url"]: r["mark"] for r in feed([(7, 1, -7), (500, 1, 5)]).collect()}
    after = ingest.versions(spark, f"{tmp_path}/work")
    assert got == {**{k: k for k in range(200)}, 7: -7, 500: 5}
    assert len(before) == 16 and 1 <= sum(after[b] != before[b] for b in after) <= 2


def test_parts_are_written_by_all_tasks_and_drained_one_by_one(spark, tmp_path):
    """a part is several files, none written by one task alone, and still one micro-batch in the order of `by`."""
    rows = spark.range(400, numPartitions=4).select("id", F.timestamp_seconds("id").alias("ts"))
    folder, seen = ingest.landing(spark, f"{tmp_path}/in"), []
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    for k in ingest.in_parts(rows.repartition(4), F.col("ts"), 5, folder):
        query = stream.writeStream.foreachBatch(lambda batch, n: seen.append((n, batch.agg(F.min("id"), F.max("id"), F.count("id")).first()))).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        assert len(spark.read.parquet(folder).inputFiles()) >= 2 * (k + 1)
    assert [n for n, _ in seen] == [0, 1, 2, 3, 4] and sum(x[2] for _, x in seen) == 400
    assert all(a[1] < b[0] for (_, a), (_, b) in zip(seen, seen[1:], strict=False))
