"""Queries of entity resolution, upsert, joins and liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators import entities as E
from feedlens.operators import liveness as L
from feedlens.plans import sqlparts as S
from feedlens.sources import views

LOG = """o AS (SELECT l_partkey AS url, year(l_shipdate) AS run, l_suppkey % 28 AS source_rank, l_quantity AS quantity, l_linestatus AS status,
 CASE WHEN l_returnflag <> 'N' THEN l_discount END AS gain, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS pay_min, CASE WHEN l_returnflag = 'A' THEN l_tax END AS pay_max, l_shipdate AS seen_at,
 row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS seq FROM lineitem)"""


def as_of() -> Column:
    return F.lit("2000-06-01 12:00:00").cast("timestamp")


def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    log = views.observations(spark, d)
    got = E.first_wins(log.select("url", "quantity", "status", "source_rank", "seq"), "url", F.struct("source_rank", "seq"))
    return got.select("url", "quantity", "status", "source_rank")


def absorb(spark: SparkSession, d: str) -> DataFrame:
    log = views.observations(spark, d)
    got = E.absorb(log, "url", F.struct("source_rank", "seq"), ["quantity", "status"], ["gain"], {"pay": ["pay_min", "pay_max"]})
    return got.select("url", "quantity", "status", "gain", "pay_min", "pay_max")


def ranked_upsert(spark: SparkSession, d: str) -> DataFrame:
    return E.ranked_upsert(views.observations(spark, d), "url", "run", "source_rank", "seq", ["quantity", "status"], ["gain"])


def write_ownership(spark: SparkSession, d: str) -> DataFrame:
    log = views.observations(spark, d).withColumn("own", E.owns("url", "run", "source_rank", "seq"))
    return log.groupBy("url", "run").agg(F.count_if("own").alias("owning"), F.count(F.lit(1)).alias("writes"))


def legacy_upsert(spark: SparkSession, d: str) -> DataFrame:
    log = views.observations(spark, d)
    return E.last_wins(log.select("url", "source_rank", "quantity", "status", "seq"), ["url", "source_rank"], F.col("seq")).drop("seq")


def union_in_order(spark: SparkSession, d: str) -> DataFrame:
    o, p = views.table(spark, d, "orders"), views.table(spark, d, "part")
    sources = [o.select(F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("note")), p.select(F.col("p_partkey").alias("url"), F.col("p_brand").alias("brand")), o.select(F.col("o_orderkey").alias("url"))]
    both = E.ordered_union(sources, failed=[2])
    return E.first_wins(both, "url", F.col("source_rank")).select("url", "note", "brand", "source_rank")


def canonical_companies(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("company 1", "First", 1), ("company 2", "Second", 1), ("company 2", "Two", 0)], "key string, display string, priority int")
    rows = views.items(spark, d).select("url", F.concat(F.col("company"), F.lit(" Inc.")).alias("company"))
    return E.canonical_companies(rows, names).select("url", "canonical")


def details_attached(spark: SparkSession, d: str) -> DataFrame:
    t = views.items(spark, d)
    detail = t.where("doc_id % 2 = 0").select(
        "url", F.col("content_text").alias("description"), F.when(F.col("doc_id") % 4 == 0, F.col("ts") + F.expr("INTERVAL '5' DAY")).alias("closes_at"),
        F.when(F.col("doc_id") % 8 == 0, F.lit(70000.0)).alias("salary_min"), F.lit(None).cast("double").alias("salary_max"), F.lit("year").alias("salary_period"),
    )
    got = E.attach_details(t, detail)
    return got.select("url", "description", F.date_format("closes_at", "yyyy-MM-dd").alias("closes"), "salary_min", "salary_period")


def by_text(spark: SparkSession, d: str) -> DataFrame:
    """Items whose company follows from the whole text, so copies of a text are listings of one company."""
    t = views.items(spark, d)
    return t.withColumn("company", F.when(F.col("company").isNotNull(), F.concat(F.lit("Company "), (F.length("content_text") % 37).cast("string"))))


def n_documents(spark: SparkSession, d: str) -> int:
    return views.table(spark, d, "documents").count()


def mirrors_hidden(spark: SparkSession, d: str) -> DataFrame:
    return E.hide_mirrored(by_text(spark, d), ["src0", "src3"]).select("url", "source_platform")


def visible(spark: SparkSession, d: str) -> DataFrame:
    """Not dismissed and not mirrored."""
    return E.hide_mirrored(by_text(spark, d).where("NOT dismissed"), ["src0", "src3"]).select("url", "seen", "saved")


def cache(spark: SparkSession, d: str) -> DataFrame:
    """The item view as a cache with last_seen and missed, spread around the clock of these queries."""
    t, n = views.items(spark, d), F.col("doc_id")
    return t.withColumn("last_seen", as_of() - F.make_dt_interval(days=(n % 40).cast("int"))).withColumn("missed", (n % 5).cast("int")).withColumn("ts", as_of() - F.make_dt_interval(days=(n % 90).cast("int"))).withColumn(
        "closes_at", F.when(n % 3 == 0, as_of() - F.make_dt_interval(days=(n % 17).cast("int")))
    )


def scopes(spark: SparkSession, d: str) -> DataFrame:
    t = views.items(spark, d)
    policy = spark.createDataFrame([(f"src{k}", ("boards", "listing", "sampled")[k % 3]) for k in range(20)], "source string, policy string")
    failed = spark.createDataFrame([("src4",), ("src6",)], "source string")
    return L.alive_scopes(t.select(F.col("source_platform").alias("source"), "company"), policy, failed)


def misses(spark: SparkSession, d: str) -> DataFrame:
    return L.charge_misses(cache(spark, d), scopes(spark, d), as_of()).select("url", "missed")


def sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = L.charge_misses(cache(spark, d), scopes(spark, d), as_of())
    return rows.select("url", L.sweep_reason(as_of(), as_of(), ["src3", "src7"]).alias("reason"))


def sweep_stats(spark: SparkSession, d: str) -> DataFrame:
    return sweep(spark, d).groupBy("reason").count().withColumnRenamed("count", "n")


def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    runs = e.select((F.col("user_id") % 28).alias("source"), F.struct("ts", "event_id").alias("run_at"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("last_count"), F.when(F.col("event_type") == "error", "failed").alias("last_error"))
    got = L.record_runs(runs)
    show = lambda c: F.date_format(F.col(f"{c}.ts"), "yyyy-MM-dd HH:mm:ss")
    return got.select("source", "ok", "last_count", "last_error", show("last_run_at").alias("last_run"), show("last_ok_at").alias("last_ok"))


def due_sources(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    ledger = L.record_runs(e.select((F.col("user_id") % 28).alias("source"), F.col("ts").alias("run_at"), (F.col("event_type") != "error").alias("ok"), F.lit(0).alias("last_count"), F.lit("").alias("last_error")))
    registry = spark.range(30).select(F.col("id").alias("source"), (F.col("id") % 5 != 0).alias("enabled"), F.when(F.col("id") % 2 == 0, 30).otherwise(100_000).alias("ttl_minutes"))
    return L.due(registry, ledger, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("source")


def board_health(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    answer = F.when(F.col("event_type").isin("purchase", "view"), "Rows").when(F.col("event_type") == "error", "Gone").when(F.col("event_type") == "click", "Empty").otherwise("Unclear")
    return L.strikes(e.select(F.col("user_id").alias("board"), "ts", answer.alias("answer")), "board", "ts", "answer").select("board", "strikes")


def user_marks(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    flag = F.when(F.col("event_type") == "purchase", "saved").when(F.col("event_type") == "error", "dismissed").when(F.col("event_type") == "view", "seen")
    rows = e.select("user_id", (F.col("event_id") % n_documents(spark, d)).alias("url"), flag.alias("flag"), (F.col("value") > 5).alias("on"), "ts")
    got = L.marks(rows, ["user_id", "url"], "flag", "on", "ts")
    return got.select("user_id", "url", *(F.date_format(f"{c}_at", "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("saved", "dismissed", "seen")))


def application_changes(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").where("event_type IN ('signup', 'click', 'purchase')")
    rows = e.select("user_id", (F.col("event_id") % n_documents(spark, d)).alias("url"), F.col("event_type").alias("status"), "event_id")
    return L.transitions(rows, ["user_id", "url"], "status", F.col("event_id"))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    o, li = views.table(spark, d, "orders"), views.table(spark, d, "lineitem")
    details = o.select(F.col("o_orderkey").alias("url"), "o_totalprice")
    return L.prune_orphans(details, li.select(F.col("l_orderkey").alias("url")).where("url % 3 = 0"), o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("url")))


def source_health(spark: SparkSession, d: str) -> DataFrame:
    """Registry with counts and runs; a silent source shows zero."""
    registry = spark.createDataFrame([(f"src{k}",) for k in range(24)], "source string")
    counts = views.items(spark, d).groupBy(F.col("source_platform").alias("source")).count()
    return registry.join(counts, "source", "left").select("source", F.coalesce("count", F.lit(0)).alias("n"))


QUERIES = {
    "dedupe_first_wins": dedupe_first_wins, "absorb_copies": absorb, "ranked_upsert": ranked_upsert, "write_ownership": write_ownership, "legacy_upsert": legacy_upsert,
    "ordered_union": union_in_order, "canonical_companies": canonical_companies, "attach_details": details_attached, "hide_mirrored": mirrors_hidden, "visible_items": visible,
    "alive_scopes": scopes, "charge_misses": misses, "sweep_reasons": sweep, "sweep_stats": sweep_stats, "run_ledger": run_ledger, "due_sources": due_sources, "board_health": board_health,
    "user_marks": user_marks, "application_changes": application_changes, "prune_orphans": orphans, "source_health": source_health,
}

_OWN = f"{LOG}, w AS (SELECT *, coalesce(source_rank <= min(source_rank) OVER (PARTITION BY url, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS own FROM o)"
_T = "TIMESTAMP '2000-06-01 12:00:00'"
_POLICY = "SELECT source_platform AS source, CASE WHEN CAST(substr(source_platform, 4) AS INT) % 3 = 0 THEN company END AS company FROM items WHERE CAST(substr(source_platform, 4) AS INT) % 3 <> 2 AND (CAST(substr(source_platform, 4) AS INT) % 3 = 1 OR company IS NOT NULL) AND source_platform NOT IN ('src4', 'src6')"
_CACHE = f"""{S.ITEMS}, alive AS (SELECT DISTINCT source, company FROM ({_POLICY})), cache AS (SELECT * REPLACE ({_T} - to_days(CAST(doc_id % 90 AS INT)) AS ts, CASE WHEN doc_id % 3 = 0 THEN {_T} - to_days(CAST(doc_id % 17 AS INT)) END AS closes_at),
 {_T} - to_days(CAST(doc_id % 40 AS INT)) AS last_seen, doc_id % 5 AS missed0 FROM items),
charged AS (SELECT *, missed0 + CASE WHEN item_type <> 'Article' AND last_seen < {_T} AND EXISTS (SELECT 1 FROM alive a WHERE a.source = source_platform AND (a.company IS NULL OR a.company = cache.company)) THEN 1 ELSE 0 END AS missed FROM cache)"""
_REASON = f"""CASE WHEN item_type <> 'Article' AND missed >= 3 AND last_seen < {_T} - INTERVAL 24 HOUR THEN 'vanished' WHEN item_type IN ('Job', 'Internship') AND closes_at < {_T} - INTERVAL 7 DAY THEN 'closed'
 WHEN item_type = 'Event' AND closes_at < {_T} - INTERVAL 1 DAY THEN 'ended' WHEN item_type = 'Event' AND closes_at IS NULL AND source_platform IN ('src3', 'src7') AND ts < {_T} - INTERVAL 1 DAY THEN 'ended'
 WHEN item_type <> 'Article' AND last_seen < {_T} - INTERVAL 21 DAY THEN 'stale' WHEN item_type = 'Article' AND ts < {_T} - INTERVAL 60 DAY THEN 'articles' END"""
_FMT = "'%Y-%m-%d %H:%M:%S'"
_MIRROR = """m AS (SELECT * REPLACE (CASE WHEN company IS NOT NULL THEN concat('Company ', CAST(length(content_text) % 37 AS VARCHAR)) END AS company), trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k, source_platform IN ('src0', 'src3') AS mirror FROM items WHERE {0}),
 orig AS (SELECT DISTINCT company, k FROM m WHERE NOT mirror AND item_type IN ('Job', 'Internship') AND company IS NOT NULL)"""
_HIDDEN = "NOT (mirror AND NOT saved AND company IS NOT NULL AND EXISTS (SELECT 1 FROM orig o WHERE o.company = m.company AND o.k = m.k))"
ORACLES = {
    "dedupe_first_wins": f"WITH {LOG} SELECT url, quantity, status, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_rank, seq) AS n FROM o) WHERE n = 1",
    "absorb_copies": f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_rank, seq) AS n FROM o)
SELECT url, arg_min(quantity, n) AS quantity, arg_min(status, n) AS status, arg_min(gain, n) FILTER (gain IS NOT NULL) AS gain,
 max(pay_min) FILTER (n = f) AS pay_min, max(pay_max) FILTER (n = f) AS pay_max
FROM (SELECT *, min(n) FILTER (pay_min IS NOT NULL OR pay_max IS NOT NULL) OVER (PARTITION BY url) AS f FROM r) GROUP BY url""",
    "ranked_upsert": f"""WITH {_OWN} SELECT url, arg_max(quantity, seq) FILTER (own) AS quantity, arg_max(status, seq) FILTER (own) AS status,
 coalesce(arg_max(gain, seq) FILTER (own AND gain IS NOT NULL), arg_min(gain, seq) FILTER (NOT own AND gain IS NOT NULL)) AS gain, max(run) AS last_run, 0 AS missed FROM w GROUP BY url""",
    "write_ownership": f"WITH {_OWN} SELECT url, run, count(*) FILTER (own) AS owning, count(*) AS writes FROM w GROUP BY url, run",
    "legacy_upsert": f"WITH {LOG} SELECT url, source_rank, arg_max(quantity, seq) AS quantity, arg_max(status, seq) AS status FROM o GROUP BY url, source_rank",
    "ordered_union": "SELECT url, CASE WHEN source_rank = 0 THEN note END AS note, CASE WHEN source_rank = 1 THEN brand END AS brand, source_rank FROM (SELECT coalesce(o_orderkey, p_partkey) AS url, o_orderstatus AS note, p_brand AS brand, CASE WHEN o_orderkey IS NOT NULL THEN 0 ELSE 1 END AS source_rank FROM orders FULL JOIN part ON o_orderkey = p_partkey)",
    "canonical_companies": f"WITH {S.ITEMS} SELECT url, CASE company WHEN 'Company 1' THEN 'First' WHEN 'Company 2' THEN 'Two' ELSE concat(company, CASE WHEN company IS NOT NULL THEN ' Inc.' END) END AS canonical FROM items".replace("ELSE concat(company, CASE WHEN company IS NOT NULL THEN ' Inc.' END) END", "ELSE company || ' Inc.' END"),
    "attach_details": f"""WITH {S.ITEMS} SELECT url, CASE WHEN doc_id % 2 = 0 THEN content_text END AS description, strftime(CASE WHEN doc_id % 4 = 0 THEN ts + INTERVAL 5 DAY ELSE closes_at END, '%Y-%m-%d') AS closes,
CASE WHEN doc_id % 8 = 0 THEN 70000.0 ELSE salary_min END AS salary_min, CASE WHEN doc_id % 8 = 0 THEN 'year' ELSE salary_period END AS salary_period FROM items""",
    "hide_mirrored": f"WITH {S.ITEMS}, {_MIRROR.replace('{0}', 'true')} SELECT url, source_platform FROM m WHERE {_HIDDEN}",
    "visible_items": f"WITH {S.ITEMS}, {_MIRROR.replace('{0}', 'NOT dismissed')} SELECT url, seen, saved FROM m WHERE {_HIDDEN}",
    "alive_scopes": f"WITH {S.ITEMS} SELECT DISTINCT source, company FROM ({_POLICY})",
    "charge_misses": f"WITH {_CACHE} SELECT url, missed FROM charged",
    "sweep_reasons": f"WITH {_CACHE} SELECT url, {_REASON} AS reason FROM charged",
    "sweep_stats": f"WITH {_CACHE} SELECT {_REASON} AS reason, count(*) AS n FROM charged GROUP BY 1",
    "run_ledger": f"""SELECT user_id % 28 AS source, arg_max(event_type <> 'error', event_id) AS ok, max(event_id) AS last_count, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'failed' END AS last_error,
strftime(max(ts), {_FMT}) AS last_run, strftime(max(ts) FILTER (event_type <> 'error'), {_FMT}) AS last_ok FROM events GROUP BY 1""",
    "due_sources": """WITH l AS (SELECT user_id % 28 AS source, max(ts) AS t, arg_max(event_type <> 'error', ts) AS ok FROM events GROUP BY 1)
SELECT r.source FROM (SELECT range AS source, range % 5 <> 0 AS enabled, CASE WHEN range % 2 = 0 THEN 30 ELSE 100000 END AS ttl FROM range(30)) r LEFT JOIN l ON l.source = r.source
WHERE enabled AND (t IS NULL OR (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(t)) / 60000000.0 >= CASE WHEN ok THEN ttl ELSE 15 END)""",
    "board_health": """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000000.0), CASE event_type WHEN 'click' THEN 'Empty' WHEN 'error' THEN 'Gone' WHEN 'purchase' THEN 'Rows' WHEN 'view' THEN 'Rows' ELSE 'Unclear' END) AS n,
 CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS t, event_type AS a FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 0 AS s, CAST(NULL AS BIGINT) AS at_ FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT e.user_id, e.n, CASE WHEN a IN ('purchase', 'view') THEN 0 WHEN a IN ('error', 'click') AND (at_ IS NULL OR t - at_ >= 86400) THEN s + 1 ELSE s END,
 CASE WHEN a IN ('purchase', 'view') THEN NULL WHEN a IN ('error', 'click') AND (at_ IS NULL OR t - at_ >= 86400) THEN t ELSE at_ END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id AS board, arg_max(s, n) AS strikes FROM f GROUP BY user_id""",
    "user_marks": f"""WITH e AS (SELECT user_id, event_id % (SELECT count(*) FROM documents) AS url, CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'error' THEN 'dismissed' WHEN 'view' THEN 'seen' END AS flag, value > 5 AS is_on, ts FROM events)
SELECT user_id, url, {", ".join(f"CASE WHEN arg_max(is_on, ts) FILTER (flag = '{f}') THEN strftime(max(ts) FILTER (flag = '{f}'), {_FMT}) END AS {f}" for f in ("saved", "dismissed", "seen"))} FROM e GROUP BY user_id, url""",
    "application_changes": """WITH ev AS (SELECT * REPLACE (event_id % (SELECT count(*) FROM documents) AS value), event_id AS id_ FROM events) SELECT user_id, url, status, event_id FROM (SELECT user_id, value AS url, event_type AS status, event_id, lag(event_type) OVER (PARTITION BY user_id, value ORDER BY event_id) AS b
FROM ev WHERE event_type IN ('signup', 'click', 'purchase')) WHERE status IS DISTINCT FROM b""",
    "prune_orphans": "SELECT o_orderkey AS url, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0) OR o_orderstatus = 'P'",
    "source_health": f"WITH {S.ITEMS} SELECT r.source, coalesce(c.n, 0) AS n FROM (SELECT concat('src', CAST(range AS VARCHAR)) AS source FROM range(24)) r LEFT JOIN (SELECT source_platform, count(*) AS n FROM items GROUP BY 1) c ON c.source_platform = r.source",
}
