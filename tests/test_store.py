"""The delta store: commits of several tables at once, reruns, compaction and eviction."""

import os
import random

import pytest
from pyspark.sql import functions as F

from feedlens.operators import entities as E
from feedlens.streaming import ingest
from feedlens.streaming import store as S

SCHEMA = "url int, run int, source_rank long, seq int, quantity int, gain int, description string"
TABLES = {"items": ["url"], "details": ["url"]}


def observed(n=400, urls=25):
    rng = random.Random(4)
    some = lambda v: None if rng.random() < 0.5 else v
    return [(some(rng.randrange(urls)) if k % 50 == 0 else rng.randrange(urls), k // 100, rng.randrange(4), k, rng.randrange(9), some(rng.randrange(9)), some(rng.choice([" ", f"text {k}"]))) for k in range(n)]


def write(spark, rows, folder, parts):
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def step():
    fold = ingest.upsert_state("url", "run", "source_rank", "seq", ["quantity"], ["gain"])
    return S.ingest_step("url", "run", "seq", F.col("source_rank") != 3, ~(F.col("source_rank") == 2) | (F.col("quantity") > 2), fold, ["description"])


def wanted(spark, rows):
    kept = spark.createDataFrame(rows, SCHEMA).where("url IS NOT NULL AND source_rank <> 3 AND (source_rank <> 2 OR quantity > 2)")
    items = E.ranked_upsert(kept, "url", "run", "source_rank", "seq", ["quantity"], ["gain"]).select("url", "quantity", "gain", "last_run")
    texts = E.last_wins(kept.where("trim(description) <> ''").select("url", "seq", "description"), ["url"], F.col("seq")).select("url", "description")
    return sorted(map(tuple, items.collect())), sorted(map(tuple, texts.collect()))


def present(store):
    return sorted(map(tuple, store.read("items").select("url", "quantity", "gain", "last_run").collect())), sorted(map(tuple, store.read("details").select("url", "description").collect()))


@pytest.mark.parametrize(("ratio", "least"), [(0.5, 100_000), (0.3, 1)])
def test_stream_equals_batch(spark, tmp_path, ratio, least):
    rows = observed()
    stream = write(spark, rows, f"{tmp_path}/log", 6)
    store = S.Store(spark, f"{tmp_path}/store", TABLES, ratio, least)
    S.run_stream(stream, store, step())
    assert present(store) == wanted(spark, rows)
    assert store.head()[1] == 5 and (store.head()[2]["items"].base is None) == (least > 1)
    S.run_stream(stream, store, step())  # nothing new
    assert present(store) == wanted(spark, rows)


@pytest.mark.parametrize("where", ["between the tables", "after the manifest"])
def test_a_batch_that_dies_leaves_the_same_end(spark, tmp_path, monkeypatch, where):
    rows = observed()
    stream = write(spark, rows, f"{tmp_path}/log", 4)
    store = S.Store(spark, f"{tmp_path}/store", TABLES, 0.3, 1)
    real, seen = S.Store._publish, []

    def publish(self, seq, batch, parts):
        if batch == 2 and not seen:
            seen.append(batch)
            if where == "after the manifest":
                real(self, seq, batch, parts)
            raise RuntimeError("lost")
        real(self, seq, batch, parts)

    monkeypatch.setattr(S.Store, "_publish", publish)
    with pytest.raises(Exception, match="lost"):
        S.run_stream(stream, store, step())
    assert store.head()[1] == (2 if where == "after the manifest" else 1) and seen
    half = wanted(spark, rows[: 300 if where == "after the manifest" else 200])
    assert present(store) == half  # both tables stand at the same batch
    S.run_stream(stream, S.Store(spark, f"{tmp_path}/store", TABLES, 0.3, 1), step())
    assert present(store) == wanted(spark, rows)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def test_what_a_batch_writes_follows_its_rows(spark, tmp_path):
    store = S.Store(spark, f"{tmp_path}/store", {"rows": ["k"]}, least=1, keep=50)
    spark.range(200_000).selectExpr("id AS k", "uuid() AS v").createOrReplaceTempView("_big")
    store.commit(0, {"rows": spark.table("_big")})
    base = size(f"{tmp_path}/store")
    written = []
    for n in range(1, 4):
        before = size(f"{tmp_path}/store")
        store.commit(n, {"rows": spark.range(n * 1000, n * 1000 + 200).selectExpr("id AS k", f"'new {n}' AS v")})
        written.append(size(f"{tmp_path}/store") - before)
    assert max(written) < base / 50 and store.read("rows").where("v LIKE 'new%'").count() == 600 and store.read("rows").count() == 200_000
    small = spark.createDataFrame([(7,), (1001,), (999_999_999,)], "k long")
    found = store.lookup("rows", small)
    assert sorted(r["k"] for r in found.collect()) == [7, 1001]
    assert "PushedFilters: [In(k" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["k"] for r in store.lookup("rows", small, most=1).collect()) == [7, 1001]


def test_old_files_are_swept_and_compaction_is_due_by_share(spark, tmp_path):
    store = S.Store(spark, f"{tmp_path}/store", {"rows": ["k"]}, ratio=0.5, least=1, keep=1)
    for n in range(8):
        store.commit(n, {"rows": spark.range(10 * n, 10 * n + 10).selectExpr("id AS k", f"{n} AS v")})
        part = store.head()[2]["rows"]
        names = {x for x in os.listdir(f"{tmp_path}/store/rows")}
        assert names == {f"b={part.base}"} | {f"d={d}" for d, _ in part.deltas}
        assert sum(m for _, m in part.deltas) < 0.5 * part.base_rows and part.base_rows + sum(m for _, m in part.deltas) == 10 * (n + 1)
    assert store.read("rows").count() == 80 and len(os.listdir(f"{tmp_path}/store/log")) <= 2
    assert not store.commit(7, {"rows": spark.range(5).selectExpr("id AS k", "0 AS v")})


def test_attempts_go_back_on_the_queue(spark, tmp_path):
    long = "x" * 401
    rows = [("a", 1, "failed", None, None), ("a", 2, "ok", "one\ntwo", None), ("b", 1, "ok", long, "2020-01-01"), ("c", 1, "ok", long + "\n", None), ("d.host.org", 1, "ok", "x", None), ("e.host.org", 1, "ok", None, "2020-01-01"), ("f", 1, "empty", None, None), ("g", 1, None, None, None)]
    store = S.Store(spark, f"{tmp_path}/store", {"attempts": ["url"]})
    df = spark.createDataFrame(rows, "url string, at int, status string, description string, closes_at string")
    store.commit(0, {"attempts": S.attempts_step("at")(store, df.where("at = 1"))["attempts"]})
    store.commit(1, {"attempts": S.attempts_step("at")(store, df.where("at = 2"))["attempts"]})
    S.evict(store, "attempts", S.requeue(["host.org"]))
    assert sorted(r["url"] for r in store.read("attempts").collect()) == ["a", "c", "e.host.org"]
    assert store.head()[1] == 1
    store.commit(2, {"attempts": df.where("url = 'b'")})
    assert store.read("attempts").count() == 4
