"""Queries of streams that write a delta store, over five micro-batches each."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.plans import state
from feedlens.sources import views
from feedlens.sources.shared import shared_folder
from feedlens.streaming import boards, ingest
from feedlens.streaming import store as S

HOSTS = ["7"]


def source(spark: SparkSession, d: str, name: str, by: str) -> tuple[DataFrame, Iterator[int]]:
    """A stream over a copy of a table, and the arrival of its five parts."""
    table = views.table(spark, d, name)
    folder = ingest.landing(spark, shared_folder(spark, name))
    return spark.readStream.schema(table.schema).parquet(folder), ingest.in_parts(table, F.col(by), 5, folder)


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Observations of listings: admitted by source, whole boards gated by quantity, upserted with their details in one commit."""
    (li, parts), flag = source(spark, d, "lineitem", "l_shipdate"), F.col("l_returnflag")
    seq = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey", "l_quantity", "l_discount", "l_tax")
    rows = li.select(
        F.col("l_partkey").alias("url"), F.year("l_shipdate").alias("run"), (F.col("l_suppkey") % 28).alias("source_rank"), seq.alias("seq"), F.col("l_quantity").alias("quantity"),
        F.col("l_linestatus").alias("status"), F.when(flag != "N", F.col("l_discount")).alias("gain"),
        F.when(flag == "A", F.concat("l_linestatus", F.lit("-"), F.col("l_orderkey").cast("string"))).when(flag == "R", " ").alias("description"),
    )
    fold = ingest.upsert_state("url", "run", "source_rank", "seq", ["quantity", "status"], ["gain"])
    rank = F.col("source_rank")
    store = S.Store(spark, shared_folder(spark, "listings"), {"items": ["url"], "details": ["url"]})
    step = S.ingest_step("url", "run", "seq", rank % 7 != 3, (rank % 5 != 0) | (F.col("quantity") >= 10), fold, ["description"])
    for _ in parts:
        S.run_stream(rows, store, step)
    details = store.read("details").select("url", "description", F.col("status").alias("detail"))
    return store.read("items").join(details, "url", "left").select("url", "quantity", "status", "gain", "last_run", "description", "detail")


def attempt_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Attempts at postings: the last of each stays, and those that count as none go back on the queue."""
    (e, parts), kind, n = source(spark, d, "events", "ts"), F.col("event_type"), F.col("event_id")
    rows = e.select(
        F.col("user_id").alias("url"), F.struct("ts", "event_id").alias("at"), F.when(kind.isin("purchase", "view", "click"), "ok").when(kind == "error", "failed").otherwise("empty").alias("status"),
        F.when(n % 4 == 0, F.repeat(F.lit("x"), F.lit(450))).when(n % 4 == 1, F.lit("a\nb")).when(n % 4 == 2, F.lit("short")).alias("description"), F.when(n % 3 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("closes_at"),
    )
    store = S.Store(spark, shared_folder(spark, "attempts"), {"attempts": ["url"]})
    for _ in parts:
        S.run_stream(rows, store, S.attempts_step("at"))
    S.evict(store, "attempts", S.requeue(HOSTS))
    return store.read("attempts").select("url", "status", F.length("description").alias("length"), "closes_at", "at.event_id")


def stream_board_health(spark: SparkSession, d: str) -> DataFrame:
    """Answers of boards (users); the runs are days, and a day whose events are all errors is not trusted."""
    boards.rocks(spark)
    kind = F.col("event_type")
    answer = F.when(kind.isin("purchase", "view"), "Rows").when(kind == "error", "Gone").when(kind == "click", "Empty").otherwise("Unclear")
    outcomes = views.table(spark, d, "events").groupBy(F.to_date("ts").alias("run")).agg(F.bool_or(kind != "error").alias("ok"))
    e, parts = source(spark, d, "events", "ts")
    rows = e.select(F.concat(F.lit("board "), F.col("user_id").cast("string")).alias("board"), F.col("ts").cast("timestamp").alias("ts"), answer.alias("answer"), F.floor("value").alias("n"), F.to_date("ts").alias("run"))
    told = boards.board_health(boards.trusted(rows.withWatermark("ts", "1 day"), outcomes), forget_ms=10 * 365 * 24 * 3600 * 1000)
    store = S.Store(spark, shared_folder(spark, "health"), {"health": ["board"]})
    for _ in parts:
        S.run_stream(told, store, lambda _, batch: {"health": batch})
    return store.read("health").select("board", "strikes", "last_strike", "last_try")


QUERIES = {"stream_ingest": stream_ingest, "attempt_ledger": attempt_ledger, "stream_board_health": stream_board_health}

_FILTERED = state.LOG.replace("AS seen_at,", "AS seen_at, CASE WHEN l_returnflag = 'A' THEN concat(l_linestatus, '-', CAST(l_orderkey AS VARCHAR)) END AS description,", 1)
ORACLES = {
    "stream_ingest": f"""WITH {_FILTERED}, f AS (SELECT * FROM o WHERE source_rank % 7 <> 3 AND (source_rank % 5 <> 0 OR quantity >= 10)),
w AS (SELECT *, coalesce(source_rank <= min(source_rank) OVER (PARTITION BY url, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS own FROM f)
SELECT url, arg_max(quantity, seq) FILTER (own) AS quantity, arg_max(status, seq) FILTER (own) AS status,
 coalesce(arg_max(gain, seq) FILTER (own AND gain IS NOT NULL), arg_min(gain, seq) FILTER (NOT own AND gain IS NOT NULL)) AS gain, max(run) AS last_run,
 arg_max(description, seq) FILTER (description IS NOT NULL) AS description, CASE WHEN count(description) > 0 THEN 'ok' END AS detail FROM w GROUP BY url""",
    "attempt_ledger": """WITH a AS (SELECT user_id AS url, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id),
r AS (SELECT a.url, CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'ok' WHEN event_type = 'error' THEN 'failed' ELSE 'empty' END AS status,
 CASE a.event_id % 4 WHEN 0 THEN 450 WHEN 1 THEN 3 WHEN 2 THEN 5 END AS length, CASE WHEN a.event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS closes_at, a.event_id FROM a JOIN events e ON e.event_id = a.event_id)
SELECT * FROM r WHERE status = 'ok' AND coalesce(length, 0) <> 450 AND NOT (contains(CAST(url AS VARCHAR), '7') AND closes_at IS NULL)""",
    "stream_board_health": state.ORACLES["board_health"].replace("FROM events),", "FROM events WHERE CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM events GROUP BY 1 HAVING bool_or(event_type <> 'error'))),", 1).replace("SELECT DISTINCT user_id FROM events", "SELECT DISTINCT user_id FROM e").replace(
        "SELECT user_id AS board, arg_max(s, n) AS strikes FROM f GROUP BY user_id",
        "SELECT concat('board ', CAST(f.user_id AS VARCHAR)) AS board, s AS strikes, at_ AS last_strike, last_try FROM f JOIN (SELECT user_id, max(n) AS n, max(t) AS last_try FROM e GROUP BY user_id) m ON m.user_id = f.user_id AND m.n = f.n"),
}
