"""Queries of reports, small set operations and clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import dates, places, text
from feedlens.operators import entities as E
from feedlens.operators import gates as G
from feedlens.operators import ranking as R
from feedlens.operators import reports as P
from feedlens.plans import sqlparts as S
from feedlens.sources import views


def as_of() -> Column:
    return F.lit("2024-01-20 10:30:00").cast("timestamp")


def status_of() -> Column:
    n = F.col("doc_id")
    return F.when(n % 5 == 0, "applied").when(n % 5 == 1, "interviewing").when(n % 5 == 2, "rejected")


def stages(spark: SparkSession, d: str) -> DataFrame:
    return P.stage_counts(views.items(spark, d).where("saved").withColumn("status", status_of()))


def applications(spark: SparkSession, d: str) -> DataFrame:
    t = views.items(spark, d)
    return P.active_applications(t.select("url", status_of().alias("status")), t.where("saved").select("url"))


def today(spark: SparkSession, d: str) -> DataFrame:
    return G.today_stats(views.items(spark, d), F.lit(S.AS_OF).cast("timestamp"), fresh_hours=240)


def boards_found(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("net", "en"), ("net", "de")], "ats string, slug string")
    return P.discover_boards(views.table(spark, d, "pages"), {"example.net": "net"}, known)


def purged(spark: SparkSession, d: str) -> DataFrame:
    t = views.items(spark, d)
    return P.remove_unsaved(t, t.where("doc_id % 3 = 0").select("url"), t.where("saved").select("url")).select("url")


def palette(spark: SparkSession, d: str) -> DataFrame:
    t = views.items(spark, d).select("url", "item_type", "company")
    n = F.col("company")
    return P.palette_union(t.where(n.isNotNull()).withColumn("company", F.lit("feed")), t.where("url LIKE '%1' OR company = 'Company 2'"), t.where("item_type = 'Job'"))


def tailoring(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for a résumé: saved roles first, then the others."""
    return G.tailoring_candidates(views.items(spark, d), F.col("company") == "Company 3")


def sampled(spark: SparkSession, d: str) -> DataFrame:
    return P.every_nth(views.items(spark, d).select("url", "doc_id", "source_platform"), ["doc_id"], ["source_platform"], 5).select("url", "source_platform")


def readers(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "customer")
    n = F.col("c_custkey")
    raw = c.select(n.alias("reader_id"), F.array("c_mktsegment", F.lit("X")).alias("interests"), F.array(F.when(n % 2 == 0, "Intern").otherwise("Wizard")).alias("levels"), F.when(n % 3 == 0, "London").otherwise("Mars").alias("home_region"))
    got = P.sanitize(raw, ["BUILDING", "X"], ["Intern", "Senior"], places.region_tags())
    return got.select("reader_id", F.array_join("interests", ",").alias("interests"), F.array_join("levels", ",").alias("levels"), "home_region")


def clocks(spark: SparkSession, d: str) -> DataFrame:
    """Staleness, failure and the hour bucket, from the event log as runs."""
    e = views.table(spark, d, "events").select(F.col("ts").alias("run_at"), (F.col("event_type") != "error").alias("ok"))
    stale, failed = P.is_stale(e, as_of()), P.all_failed(e)
    return stale.crossJoin(F.broadcast(failed)).withColumn("bucket", F.date_format(dates.hour_bucket(as_of()), "yyyy-MM-dd HH:mm"))  # one row each


def dormancy(spark: SparkSession, d: str) -> DataFrame:
    return P.dormant(views.items(spark, d), F.lit("2002-01-01").cast("timestamp"))


def spreads(spark: SparkSession, d: str) -> DataFrame:
    return P.spread(views.items(spark, d).where("company IS NOT NULL"), "company")


def registry_gates(spark: SparkSession, d: str) -> DataFrame:
    """Which sources are enabled by preferences, newly due, and judged by the early-career gate."""
    r = spark.range(28).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), F.when(F.col("id") % 3 == 0, "Article").when(F.col("id") % 3 == 1, "Event").otherwise("Job").alias("category"), (F.col("id") % 4 == 0).alias("whole_board"))
    before, now = G.Wanted(jobs=False, internships=False, disabled=("src6",)), G.Wanted(internships=True, jobs=False, events=False)
    on = lambda w: G.source_enabled(F.col("source"), F.col("category"), w)
    news = P.made_due(r, on(before), on(now)).select("source", F.lit(True).alias("due"))
    judged = derived_rows(spark, d).join(r.select("source", "whole_board"), F.col("source") == F.col("source_platform"))
    passed = judged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(G.passes_board_gate(F.col("whole_board"), F.coalesce(F.col("seniority") == "Intern", F.lit(False)))).alias("passed"))
    return r.select("source", on(now).alias("enabled")).join(news, "source", "left").join(passed, "source", "left").select("source", "enabled", F.coalesce("due", F.lit(False)).alias("made_due"), "n", "passed")


def derived_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.derive(views.items(spark, d), R.Profile(major="A"), S.MAJORS, S.INTERESTS, S.BANDS, spark.createDataFrame([], "company string, tier int"))


def legacy_home(spark: SparkSession, d: str) -> DataFrame:
    """The old score (field 10, kind 5 or 4), first eight per source, then the rest."""
    t = derived_rows(spark, d)
    score = F.when(F.col("discipline") == "A", 10).otherwise(0) + F.when(R.is_opportunity(F.col("item_type")), 5).when(F.col("item_type") == "Event", 4).otherwise(0)
    from pyspark.sql.window import Window as W

    n = F.row_number().over(W.partitionBy("source_platform").orderBy(F.desc("score"), "url"))
    return t.withColumn("score", score).withColumn("n", n).select("url", "score", (F.col("n") > 8).alias("overflow"))


def source_union(spark: SparkSession, d: str) -> DataFrame:
    """Ingest of one batch: the listings of src2, then those of all sources, derived columns, first copy by url."""
    t = views.items(spark, d)
    base = t.select("url", "title", "content_text", "location", "company", "source_platform")
    both = E.ordered_union([base.where("source_platform = 'src2'"), base])
    once = E.first_wins(both, "url", F.struct("source_rank", "title"))
    got = E.derive_on_ingest(once, S.MAJORS, S.BANDS)
    return got.select("url", "discipline", "company", "seniority", F.array_join("location_tags", ",").alias("tags"), "source_rank")


def has_text(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations")
    rows = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("  ").alias("description"), F.array().cast("array<string>").alias("tags"))
    present = (F.trim(F.coalesce("description", F.lit(""))) != "") | (F.size("tags") > 0)
    return rows.select("conv_id", "turn", present.alias("has_text"), text.collapse_ws(F.col("description")).alias("head"))


QUERIES = {
    "stage_counts": stages, "active_applications": applications, "today_stats": today, "discover_boards": boards_found, "delete_unsaved": purged, "palette_union": palette, "tailoring_candidates": tailoring,
    "every_nth": sampled, "reader_sanitation": readers, "clocks": clocks, "dormancy": dormancy, "spread": spreads, "registry_gates": registry_gates, "legacy_score": legacy_home, "ingest_batch": source_union, "has_posting_text": has_text,
}

_ST = "CASE doc_id % 5 WHEN 0 THEN 'applied' WHEN 1 THEN 'interviewing' WHEN 2 THEN 'rejected' END"
_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '')"
ORACLES = {
    "stage_counts": f"WITH {S.ITEMS} SELECT coalesce({_ST}, 'none') AS stage, count(*) AS n FROM items WHERE saved GROUP BY 1",
    "active_applications": f"WITH {S.ITEMS} SELECT url, {_ST} AS status FROM items WHERE saved AND doc_id % 5 IN (0, 1)",
    "today_stats": f"""WITH {S.ITEMS} SELECT count(*) FILTER (NOT seen AND ts >= {S.NOW} - INTERVAL 240 HOUR) AS fresh, count(*) FILTER (item_type IN ('Job', 'Internship') AND coalesce(closes_at >= {S.NOW}, true)) AS open_roles,
count(*) FILTER (closes_at BETWEEN {S.NOW} AND {S.NOW} + INTERVAL 7 DAY) AS closing, count(*) FILTER (saved) AS saved FROM items""",
    "discover_boards": f"""WITH p AS (SELECT {_HOST} AS host, string_split(regexp_replace(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1), '^/', ''), '/')[1] AS slug FROM pages)
SELECT DISTINCT 'net' AS ats, slug FROM p WHERE (host = 'example.net' OR ends_with(host, '.example.net')) AND regexp_matches(slug, '^[A-Za-z0-9._-]+$') AND lower(slug) NOT IN ('api', 'jobs', 'search') AND slug NOT IN ('en', 'de')""",
    "delete_unsaved": f"WITH {S.ITEMS} SELECT url FROM items WHERE saved OR doc_id % 3 <> 0",
    "palette_union": f"WITH {S.ITEMS} SELECT url, item_type, CASE WHEN company IS NOT NULL THEN 'feed' END AS company FROM items WHERE item_type <> 'Job' AND (company IS NOT NULL OR url LIKE '%1' OR company = 'Company 2')",
    "tailoring_candidates": f"WITH {S.ITEMS} SELECT url, CASE WHEN saved THEN 0 ELSE 1 END AS priority FROM items WHERE item_type IN ('Job', 'Internship') AND (saved OR company = 'Company 3')",
    "every_nth": f"""WITH {S.ITEMS}, k AS (SELECT url, source_platform, row_number() OVER (PARTITION BY source_platform ORDER BY doc_id) - 1 AS n, greatest(count(*) OVER (PARTITION BY source_platform) // 5, 1) AS step FROM items)
SELECT url, source_platform FROM k WHERE n % step = 0 AND n / step < 5""",
    "reader_sanitation": """SELECT c_custkey AS reader_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING,X' ELSE 'X' END AS interests, CASE WHEN c_custkey % 2 = 0 THEN 'Intern' ELSE '' END AS levels, CASE WHEN c_custkey % 3 = 0 THEN 'London' END AS home_region FROM customer""",
    "clocks": """SELECT coalesce(epoch(TIMESTAMP '2024-01-20 10:30:00') - floor(epoch(max(ts) FILTER (event_type <> 'error'))) >= 600, true) AS stale, coalesce(bool_and(event_type = 'error'), false) AS all_failed, '2024-01-20 10:00' AS bucket FROM events""",
    "dormancy": f"WITH {S.ITEMS} SELECT source_platform, CAST(floor((epoch(TIMESTAMP '2002-01-01') - floor(epoch(max(ts)))) / 86400) AS BIGINT) AS days FROM items GROUP BY 1",
    "spread": f"WITH {S.ITEMS} SELECT company, count(*) AS n FROM items WHERE company IS NOT NULL GROUP BY 1 ORDER BY n DESC, company LIMIT 20",
    "registry_gates": f"""WITH {S.DERIVED}, c AS (SELECT source_platform AS source, count(*) AS n, count(*) FILTER (CAST(substr(source_platform, 4) AS BIGINT) % 4 <> 0 OR coalesce(seniority = 'Intern', false)) AS passed FROM derived GROUP BY 1)
SELECT concat('src', CAST(r.range AS VARCHAR)) AS source, r.range % 3 <> 1 AS enabled, r.range % 3 = 2 OR r.range = 6 AS made_due, c.n, c.passed FROM range(28) r LEFT JOIN c ON c.source = concat('src', CAST(r.range AS VARCHAR))""",
    "legacy_score": f"""WITH {S.DERIVED}, s AS (SELECT *, CASE WHEN discipline = 'A' THEN 10 ELSE 0 END + CASE WHEN opp THEN 5 WHEN item_type = 'Event' THEN 4 ELSE 0 END AS score FROM derived)
SELECT url, score, row_number() OVER (PARTITION BY source_platform ORDER BY score DESC, url) > 8 AS overflow FROM s""",
    "ingest_batch": f"""WITH {S.DERIVED} SELECT url, discipline, coalesce(company, CASE WHEN contains(title, ' at ') AND trim(list_extract(string_split(title, ' at '), -1)) <> '' AND strlen(trim(list_extract(string_split(title, ' at '), -1))) <= 60 THEN trim(list_extract(string_split(title, ' at '), -1)) END) AS company, seniority, array_to_string(location_tags, ',') AS tags,
CASE WHEN source_platform = 'src2' THEN 0 ELSE 1 END AS source_rank FROM derived""",
    "has_posting_text": "SELECT conv_id, turn, turn % 2 = 0 AND trim(text) <> '' AS has_text, CASE WHEN turn % 2 = 0 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE '' END AS head FROM conversations",
}
