"""Queries of reader state, detail work and source health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators import liveness as L
from feedlens.operators import saved as X
from feedlens.plans import feed, search, state
from feedlens.plans import sqlparts as S
from feedlens.sources import views
from feedlens.sources.shared import stored


def marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks on documents by all events of one reader; the url is the document's number."""
    e = views.table(spark, d, "events")
    flag = F.when(F.col("event_type") == "purchase", "saved").when(F.col("event_type") == "error", "dismissed").when(F.col("event_type") == "view", "seen")
    rows = e.select((F.col("event_id") % state.n_documents(spark, d)).alias("url"), flag.alias("flag"), (F.col("value") > 5).alias("on"), "ts")
    return L.marks(rows, ["url"], "flag", "on", "ts")


def items(spark: SparkSession, d: str) -> DataFrame:
    return views.items(spark, d).withColumn("url", F.col("doc_id"))


def annotated(spark: SparkSession, d: str) -> DataFrame:
    m = marks(spark, d)
    return X.annotate(X.without_dismissed(items(spark, d), m), m).select("url", "saved", "seen")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return search.rows(spark, d).withColumn("url", F.col("doc_id")).select("url", "required_skills", F.col("score").alias("merit"), F.col("content_text").alias("description"), "company")


def saved(spark: SparkSession, d: str) -> DataFrame:
    got = X.saved_list(marks(spark, d), snapshots(spark, d), F.array(F.lit("s4"), F.lit("s1")))
    return got.select("url", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss").alias("saved"), F.array_join("matched_skills", ",").alias("matched"), "merit", "description")


def resolved(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a wanted one: visible rows from the list, dismissed ones only where they are saved. The items are read four
    times; joined anew each time, the sorts of all their joins would stand in one task. A text's digest goes through the joins for it."""
    m = stored(marks(spark, d), "marks")
    t = stored(items(spark, d).select("url", "item_type", "closes_at", "salary_min", "salary_max", "salary_period", "content_text"), "items")
    kept = t.join(m.where("saved_at IS NOT NULL").select("url"), "url", "left_semi")
    details = t.where("url % 2 = 0").select("url", F.md5("content_text").alias("description"), F.lit(None).cast("timestamp").alias("closes_at"), F.lit(None).cast("double").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"), F.lit(None).cast("string").alias("salary_period"))
    got = X.resolve_details(t.select("url"), X.without_dismissed(t, m), kept, details)
    return got.select("url", "origin", F.col("description").alias("text"))


def purged(spark: SparkSession, d: str) -> DataFrame:
    return X.purge_unwanted(feed.derived(spark, d), internships=True, jobs=False, news=True, events=False, disabled=["src3", "src7"]).select("url", "item_type")


def health(spark: SparkSession, d: str) -> DataFrame:
    """Sources with their category and whether they are on; counts from the items, runs from the events."""
    registry = spark.createDataFrame([(f"src{k}", f"c{k % 3}", k % 5 != 0) for k in range(24)], "source string, category string, enabled boolean")
    counts = views.items(spark, d).groupBy(F.col("source_platform").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    e = views.table(spark, d, "events")
    source = F.concat(F.lit("src"), (F.col("user_id") % 22).cast("string"))
    ledger = L.record_runs(e.select(source.alias("source"), F.struct("ts", "event_id").alias("run_at"), (F.col("event_type") != "error").alias("ok"), F.lit(0).alias("last_count"), F.when(F.col("event_type") == "error", "failed").alias("last_error")))
    got = X.source_health(registry, counts, ledger)
    quiet = X.quiet_sources(got).select("source", F.lit(True).alias("quiet"))
    return got.join(quiet, "source", "left").select("source", "category", "enabled", "n", F.date_format("last_ok_at.ts", "yyyy-MM-dd HH:mm:ss").alias("last_ok"), "last_error", "failing", F.coalesce("quiet", F.lit(False)).alias("quiet"))


def seeded(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations")
    empty = F.lit(None).cast("string")
    rows = c.select(F.struct("conv_id", "turn").alias("url"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("  ").alias("description"), F.when(F.col("role") == "tool", F.col("text")).alias("requirements"), empty.alias("responsibilities"), empty.alias("perks"))
    got = X.seeded_details(rows)
    return got.select("url.conv_id", "url.turn", F.md5("description").alias("description"), F.md5("requirements").alias("requirements"), "status")


def queue(spark: SparkSession, d: str) -> DataFrame:
    ranked = feed.ranked(spark, d).withColumn("merit", F.round("merit", 9))
    attempted = views.items(spark, d).where("doc_id % 5 = 0").select("url")
    return X.detail_queue(X.detail_candidates(ranked, attempted, feed.as_of())).select("position", "url", F.round("merit", 4).alias("merit"))


def substring(spark: SparkSession, d: str) -> DataFrame:
    return X.substring_search(views.items(spark, d), "TION Th").select("url", "item_type")


QUERIES = {
    "annotate_items": annotated, "saved_list": saved, "detail_resolution": resolved, "purge_unwanted": purged, "source_status": health, "seeded_details": seeded,
    "detail_queue": queue, "substring_search": substring,
}

_FMT = "'%Y-%m-%d %H:%M:%S'"
_MARKS = f"""e AS (SELECT event_id % (SELECT count(*) FROM documents) AS url, CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'error' THEN 'dismissed' WHEN 'view' THEN 'seen' END AS flag, value > 5 AS is_on, ts FROM events),
marks AS (SELECT url, {", ".join(f"CASE WHEN arg_max(is_on, ts) FILTER (flag = '{f}') THEN max(ts) FILTER (flag = '{f}') END AS {f}_at" for f in ("saved", "dismissed", "seen"))} FROM e GROUP BY url)"""
_CLOSED = f"closes_at IS NULL OR closes_at >= {S.NOW}"
ORACLES = {
    "annotate_items": f"WITH {S.ITEMS}, {_MARKS} SELECT doc_id AS url, saved_at IS NOT NULL AS saved, seen_at IS NOT NULL AS seen FROM items LEFT JOIN marks m ON m.url = doc_id WHERE dismissed_at IS NULL",
    "saved_list": f"""WITH {search.ROWS}, {_MARKS} SELECT doc_id AS url, strftime(saved_at, {_FMT}) AS saved, array_to_string(list_filter(required_skills, lambda x: x IN ('s1', 's4')), ',') AS matched, CAST(NULL AS DOUBLE) AS merit, CAST(NULL AS VARCHAR) AS description
FROM r JOIN marks m ON m.url = r.doc_id WHERE saved_at IS NOT NULL""",
    "detail_resolution": f"""WITH {S.ITEMS}, {_MARKS} SELECT doc_id AS url, CASE WHEN dismissed_at IS NULL THEN 'ranked' ELSE 'saved' END AS origin, CASE WHEN doc_id % 2 = 0 THEN md5(content_text) END AS text
FROM items LEFT JOIN marks m ON m.url = doc_id WHERE dismissed_at IS NULL OR saved_at IS NOT NULL""",
    "purge_unwanted": f"""WITH {S.DERIVED} SELECT url, item_type FROM derived WHERE source_platform NOT IN ('src3', 'src7') AND (item_type = 'Article' OR item_type = 'Internship' OR (item_type = 'Job' AND coalesce(seniority = 'Intern', false)))""",
    "source_status": f"""WITH {S.ITEMS}, l AS (SELECT concat('src', CAST(user_id % 22 AS VARCHAR)) AS source, arg_max(event_type, (ts, event_id)) AS t, max(ts) FILTER (event_type <> 'error') AS ok_at FROM events GROUP BY 1),
c AS (SELECT source_platform AS source, count(*) AS n FROM items GROUP BY 1)
SELECT concat('src', CAST(range AS VARCHAR)) AS source, concat('c', CAST(range % 3 AS VARCHAR)) AS category, range % 5 <> 0 AS enabled, coalesce(n, 0) AS n, strftime(ok_at, {_FMT}) AS last_ok, CASE WHEN t = 'error' THEN 'failed' END AS last_error,
coalesce(t = 'error', false) AS failing, range % 5 <> 0 AND n IS NULL AS quiet FROM range(24) r LEFT JOIN c ON c.source = concat('src', CAST(range AS VARCHAR)) LEFT JOIN l ON l.source = concat('src', CAST(range AS VARCHAR))""",
    "seeded_details": """SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN text ELSE '  ' END) AS description, CASE WHEN role = 'tool' THEN md5(text) END AS requirements, 'ok' AS status
FROM conversations WHERE trim(text) <> '' AND (turn % 2 = 0 OR role = 'tool')""",
    "detail_queue": f"""WITH {S.RANKED}, q AS (SELECT *, round(merit, 9) AS m FROM ranked WHERE opp AND ({_CLOSED}) AND doc_id % 5 <> 0 ORDER BY round(merit, 9) DESC, score DESC, url LIMIT 4800),
w AS (SELECT url, merit, m, row_number() OVER v AS r, first_value(m) OVER v AS t, first_value(url) OVER v AS f FROM q WINDOW v AS (PARTITION BY coalesce(company, source_platform) ORDER BY m DESC, url))
SELECT row_number() OVER (ORDER BY r, m DESC, t DESC, f) AS position, url, round(merit, 4) AS merit FROM w""",
    "substring_search": f"WITH {S.ITEMS} SELECT url, item_type FROM items WHERE contains(lower(title), 'tion th') OR contains(lower(content_text), 'tion th') OR coalesce(contains(lower(location), 'tion th'), false)",
}
