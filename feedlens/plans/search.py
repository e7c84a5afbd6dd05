"""Queries of facets, search, sorts, counts and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import pay
from feedlens.operators import gates as G
from feedlens.operators import ranking as R
from feedlens.operators import search as Q
from feedlens.plans import feed
from feedlens.plans import sqlparts as S
from feedlens.sources import views
from feedlens.sources.manifest import Log
from feedlens.sources.shared import shared_folder, stored
from feedlens.sources.text_index import TextIndex


def as_of() -> Column:
    return F.lit(S.AS_OF).cast("timestamp")


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Classified items with skills: those demanded are s1 to s3 by word, those a reader has are s1 and s3."""
    low = F.lower("content_text")
    asked = [F.when(low.contains(w), F.lit(n)) for n, w in (("s1", "license"), ("s2", " was "), ("s3", "$"), ("s4", " of "))]
    t = feed.derived(spark, d).withColumn("required_skills", F.array_compact(F.array(*asked)))
    return t.withColumn("matched_skills", F.array_intersect("required_skills", F.array(F.lit("s1"), F.lit("s3"), F.lit("s4")))).withColumn("score", F.round(R.fit(feed.PROFILE), 6))


def narrow(spark: SparkSession, d: str) -> DataFrame:
    """The classified rows without their texts, stored for queries that read them several times."""
    return stored(rows(spark, d).drop("content_text"), "classified")


FACETS = {
    "type": Q.Facets(item_type="Job"), "discipline": Q.Facets(discipline="A"), "sources": Q.Facets(sources=("src1", "src2")), "mode": Q.Facets(mode="Remote"),
    "places": Q.Facets(places=("Canada", "New York")), "fresh": Q.Facets(fresh_hours=24 * 30), "levels": Q.Facets(levels=("Intern",)), "pay_floor": Q.Facets(pay_floor=80_000.0),
    "pay_disclosed": Q.Facets(pay_disclosed=True), "deadline": Q.Facets(deadline="any"), "week": Q.Facets(deadline="week"), "match": Q.Facets(good_match=True), "specialty": Q.Facets(specialties=("License", "th-e")),
}


def facets(spark: SparkSession, d: str) -> DataFrame:
    """One flag per facet and row."""
    flags = [F.coalesce(c, F.lit(False)).alias(f"f_{name}") for name, f in FACETS.items() for c in Q.facet_predicates(f, as_of()).values()]
    return rows(spark, d).select("url", *flags)


def filtered(spark: SparkSession, d: str) -> DataFrame:
    f = Q.Facets(discipline="A", levels=("Intern",), places=("Canada", "USA"), pay_disclosed=True)
    return Q.filter_roles(rows(spark, d).where(R.is_opportunity(F.col("item_type"))), f, as_of()).select("url", "item_type")


def admitted(spark: SparkSession, d: str) -> DataFrame:
    """Preference gate: news off for two sources, internships only; and the fresh, upcoming and saved views."""
    w = G.Wanted(jobs=False, news=False, disabled=("src1", "src2"))
    return rows(spark, d).select(
        "url", G.admits(w).alias("admitted"), G.fresh_unseen(as_of()).alias("fresh_unseen"), G.upcoming(as_of()).alias("upcoming"),
        G.saved_view(R.OPPORTUNITY, status="seniority").alias("saved_view"), G.saved_view(R.OPPORTUNITY, "none", "seniority").alias("saved_unstaged"),
    )


def searched(spark: SparkSession, d: str) -> DataFrame:
    q = Q.parse_query('th "of the" -license company:company')
    got = Q.with_search_columns(rows(spark, d)).withColumn("tier", Q.search_tier(q))
    return got.where("tier > 0").select("url", "tier")


_indexes: dict[str, TextIndex] = {}


def text_index(spark: SparkSession, d: str) -> TextIndex:
    """The stored index of `documents`, built by the session's first query that asks for it and again when the table's files have changed."""
    path = f"{d}/documents.parquet"
    log = Log(spark, path)
    fs, where = log.at(path)
    files = fs.listStatus(where)
    sign = f"{spark.sparkContext.applicationId}|{path}|" + ",".join(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in files)
    if sign not in _indexes:
        index = TextIndex(spark, shared_folder(spark, "index"))
        index.add(views.table(spark, d, "documents"), "doc_id", "text")
        _indexes[sign] = index
    return _indexes[sign]


def described_search(spark: SparkSession, d: str) -> DataFrame:
    return text_index(spark, d).lookup(["anat", "license", "of", "the"]).select(F.col("id").alias("doc_id"), "term")


def index_segments(spark: SparkSession, d: str) -> DataFrame:
    """The stored index after documents were replaced and removed in several segments, then merged: postings by first character."""
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    index = TextIndex(spark, shared_folder(spark, "segments"), most=3)
    index.add(docs, "doc_id", "text")
    index.add(docs.where("doc_id % 6 = 1").withColumn("text", F.concat_ws(" ", "text", F.lit("amended edition"))), "doc_id", "text")
    index.remove(docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id")))
    index.add(docs.where("doc_id % 21 = 0").withColumn("text", F.lit("Zurück again")), "doc_id", "text")
    index.add(docs.where("doc_id % 5 = 2").withColumn("text", F.concat_ws(" ", F.lit("fifth"), "text")), "doc_id", "text")
    return index.postings().groupBy(F.substring("token", 1, 1).alias("part")).agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("id").alias("documents"))


def index_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.build_index(views.table(spark, d, "documents"), "doc_id", "text").groupBy("prefix").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("token").alias("tokens"))


def index_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """All documents indexed, a sixth replaced by a longer text, a seventh removed."""
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    old = Q.build_index(docs, "doc_id", "text")
    new = docs.where("doc_id % 6 = 1").withColumn("text", F.concat_ws(" ", "text", F.lit("amended edition")))
    gone = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))
    return Q.update_index(old, gone, new, "doc_id", "text").groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


def sorts(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty of each hub sort."""
    t = rows(spark, d).drop("content_text").where(R.is_opportunity(F.col("item_type"))).withColumn("last_call", F.col("doc_id") % 8 == 0)
    return Q.all_sorts(t, as_of(), 50)


def tier_first(spark: SparkSession, d: str) -> DataFrame:
    """Search hits ordered by tier, then by score."""
    q = Q.parse_query("th")
    t = Q.with_search_columns(rows(spark, d)).withColumn("tier", Q.search_tier(q)).where("tier > 0")
    return Q.numbered(t, [F.desc("tier"), F.desc("score"), F.asc("url")], 100).select("position", "url", "tier")


def per_source(spark: SparkSession, d: str) -> DataFrame:
    """Caps: 5 newest per employer, tier first per source, first 8 per source."""
    t = narrow(spark, d).where("company IS NOT NULL")
    best = R.keep_per_group(t, ["company"], [F.desc(F.col("discipline") == "A"), F.desc("ts"), F.asc("url")], 5).select("url", F.lit("keep_best").alias("cap"))
    tier = R.keep_per_group(t, ["source_platform"], [F.asc_nulls_last("company_tier"), F.desc("ts"), F.asc("url")], 5).select("url", F.lit("tier_first").alias("cap"))
    eight = R.keep_per_group(t, ["source_platform"], [F.desc("score"), F.asc("url")], 8).select("url", F.lit("legacy").alias("cap"))
    return best.unionByName(tier).unionByName(eight)


def paced_queue(spark: SparkSession, d: str) -> DataFrame:
    """Detail queue by merit: 600 in all, 30 of each paced handler; rows over a handler's limit use none of the budget."""
    t = rows(spark, d).where(R.is_opportunity(F.col("item_type")))
    return G.paced_budget(t, [F.desc("score"), F.asc("url")], "source_platform", ["src0", "src1"]).select("url", "source_platform")


def bands(spark: SparkSession, d: str) -> DataFrame:
    """The hero (first unseen role) and the fifteen that follow without it."""
    t = narrow(spark, d).where(R.is_opportunity(F.col("item_type")))
    return G.hero_and_bands(t, [F.desc("score"), F.asc("url")])


def palette(spark: SparkSession, d: str) -> DataFrame:
    """Six roles and six others, with the totals of both groups."""
    q = Q.parse_query("th")
    t = Q.with_search_columns(rows(spark, d)).withColumn("tier", Q.search_tier(q)).where("tier > 0").withColumn("group", F.when(R.is_opportunity(F.col("item_type")), "roles").otherwise("other"))
    t = stored(t.select("url", "group", "tier", "score"), "hits")
    return G.palette_groups(t).select("group", "url", "total")


def counts(spark: SparkSession, d: str) -> DataFrame:
    """One pass of conditional counts over the items."""
    opp = R.is_opportunity(F.col("item_type"))
    year = pay.annual_equivalent(F.col("salary_min"), F.col("salary_max"), F.col("salary_period"))
    return rows(spark, d).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(opp).alias("opportunities"), F.countDistinct("source_platform").alias("sources"), F.count("closes_at").alias("dated"),
        F.count_if("saved").alias("saved"), F.count_if(F.col("saved") & opp).alias("saved_roles"), F.count_if(F.col("closes_at") < as_of()).alias("closed"),
        F.count(year).alias("disclosed"), F.round(F.sum(year), 2).alias("pay_sum"), F.count_if(F.col("ts") >= as_of() - F.expr("INTERVAL '30' DAY")).alias("fresh"), F.bool_and("seen").alias("all_seen"),
    )


def by_source(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).groupBy("source_platform", "item_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.trim("content_text")) < 100).alias("short"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("newest"))


def saved_searches(spark: SparkSession, d: str) -> DataFrame:
    """New matches of three saved searches since each was opened, counted in one pass."""
    t = Q.with_search_columns(rows(spark, d))
    searches = {"s_the": ("the", "1997-01-01"), "s_license": ("license", "1998-01-01"), "s_of": ('"of the"', "1996-06-01")}
    aggs = [F.count_if((Q.search_tier(Q.parse_query(raw)) > 0) & (F.col("ts") > F.lit(seen).cast("timestamp"))).alias(name) for name, (raw, seen) in searches.items()]
    return t.agg(*aggs)


def coverage(spark: SparkSession, d: str) -> DataFrame:
    t = rows(spark, d)
    asked, have = F.size("required_skills"), F.size("matched_skills")
    missing = F.array_except("required_skills", "matched_skills")
    return t.select("url", asked.alias("asked"), have.alias("have"), F.array_join("matched_skills", ",").alias("has"), F.array_join(missing, ",").alias("missing"), F.round(have / F.nullif(asked, F.lit(0)), 4).alias("share"))


def merit_report(spark: SparkSession, d: str) -> DataFrame:
    scored = R.pass_one(feed.derived(spark, d), feed.PROFILE, as_of()).where(R.is_opportunity(F.col("item_type"))).withColumn("all", F.lit(1)).withColumn("merit", F.round("merit", 6))
    got = R.nearest_rank(scored, ["all"], "merit", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "top": 1.0})
    return got.select(*(F.round(c, 4).alias(c) for c in ("p50", "p75", "p90", "top")))


QUERIES = {
    "facets": facets, "filter_roles": filtered, "admits": admitted, "search": searched, "described_terms": described_search, "index_counts": index_counts, "index_upkeep": index_upkeep, "index_segments": index_segments,
    "hub_sorts": sorts, "tier_first_order": tier_first, "per_group_caps": per_source, "paced_queue": paced_queue, "bands": bands, "palette_groups": palette, "counts": counts,
    "source_counts": by_source, "saved_search_counts": saved_searches, "skill_coverage": coverage, "merit_report": merit_report,
}

_LOW = "lower(content_text)"
_FIT = f"round(merit - CASE WHEN opp THEN 4.0 * coalesce(greatest(0.0, least(1.0, ({S.annual()} - 60000.0) / 140000.0)), 0.0) ELSE 0.0 END, 6)"
ROWS = f"""{S.PASS_ONE}, r0 AS (SELECT *, {_FIT} AS score, list_filter([CASE WHEN contains({_LOW}, 'license') THEN 's1' END, CASE WHEN contains({_LOW}, ' was ') THEN 's2' END, CASE WHEN contains({_LOW}, '$') THEN 's3' END,
 CASE WHEN contains({_LOW}, ' of ') THEN 's4' END], lambda x: x IS NOT NULL) AS required_skills FROM two),
r AS (SELECT *, list_filter(required_skills, lambda x: x IN ('s1', 's3', 's4')) AS matched_skills, {S.annual()} AS annual, coalesce(seniority, CASE WHEN item_type = 'Internship' THEN 'Intern' END) AS level,
 CASE WHEN company IS NOT NULL THEN trim(company) WHEN opp AND contains(title, ' at ') AND length(title) > length(list_extract(string_split(title, ' at '), -1)) + 4 THEN list_extract(string_split(title, ' at '), -1) END AS employer0 FROM r0),
s AS (SELECT *, lower(coalesce(employer0, '')) AS employer, lower(concat(title, ' ', lower(coalesce(employer0, '')))) AS head, lower(concat_ws(' ', coalesce(location, ''), content_text, source_platform)) AS body FROM r)"""
_W = "a-z0-9\\x{80}-\\x{10FFFF}"


def _pre(col: str, word: str) -> str:
    return f"regexp_matches({col}, '(^|[^{_W}]){word}')"


def _whole(col: str, word: str) -> str:
    return f"regexp_matches({col}, '(^|[^{_W}]){word}([^{_W}]|$)')"


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))"
_AHEAD = f"CASE WHEN closes_at >= {S.NOW} THEN closes_at END"
_SORTS = {
    "best": "score DESC", "last_call": f"CASE WHEN {_AHEAD} IS NULL THEN 2 WHEN doc_id % 8 = 0 THEN 0 ELSE 1 END, {_AHEAD} NULLS LAST, score DESC", "newest": "ts DESC NULLS LAST", "closing_soonest": f"{_AHEAD} NULLS LAST",
    "closing_latest": "closes_at DESC NULLS LAST", "highest_pay": "annual DESC NULLS LAST", "company": "lower(employer0) NULLS LAST",
}
ORACLES = {
    "facets": f"""WITH {ROWS} SELECT url, item_type = 'Job' AS f_type, discipline = 'A' AS f_discipline, source_platform IN ('src1', 'src2') AS f_sources, list_contains(location_tags, 'Remote') AS f_mode,
list_has_any(location_tags, ['Canada', 'New York']) AS f_places, ts >= {S.NOW} - INTERVAL 30 DAY AS f_fresh, coalesce(level = 'Intern', false) AS f_levels, coalesce(annual >= 80000, false) AS f_pay_floor, annual IS NOT NULL AS f_pay_disclosed,
coalesce(closes_at >= {S.NOW}, false) AS f_deadline, coalesce(closes_at >= {S.NOW} AND closes_at <= {S.NOW} + INTERVAL 7 DAY, false) AS f_week, coalesce(len(required_skills) >= 2 AND len(matched_skills) / len(required_skills) >= 0.6, false) AS f_match,
contains(lower(concat(title, ' ', content_text)), 'license') OR contains(lower(concat(title, ' ', content_text)), 'th-e') OR contains(lower(concat(title, ' ', content_text)), 'th e') AS f_specialty FROM r""",
    "filter_roles": f"WITH {ROWS} SELECT url, item_type FROM r WHERE opp AND discipline = 'A' AND level = 'Intern' AND list_has_any(location_tags, ['Canada', 'USA']) AND annual IS NOT NULL",
    "admits": f"""WITH {ROWS} SELECT url, source_platform NOT IN ('src1', 'src2') AND CASE WHEN opp THEN item_type = 'Internship' OR coalesce(seniority = 'Intern', false) ELSE item_type = 'Event' END AS admitted,
NOT seen AND ts >= {S.NOW} - INTERVAL 24 HOUR AS fresh_unseen, item_type = 'Event' AND coalesce(closes_at, ts) >= {S.NOW} AS upcoming, saved AND opp AS saved_view, saved AND opp AND seniority IS NULL AS saved_unstaged FROM r""",
    "search": f"""WITH {ROWS}, h AS (SELECT url, {_pre("head", "th")} AS t1, {_pre("body", "th")} AS t2, {_whole("head", "of the")} AS p1, {_whole("body", "of the")} AS p2, contains(employer, 'company') AND NOT {_pre("head", "license")} AND NOT {_pre("body", "license")} AS ok FROM s)
SELECT url, CASE WHEN t1 AND p1 THEN 2 ELSE 1 END AS tier FROM h WHERE ok AND (t1 OR t2) AND (p1 OR p2)""",
    "described_terms": f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), q AS (SELECT unnest(['anat', 'license', 'of', 'the']) AS term)
SELECT DISTINCT doc_id, term FROM t JOIN q ON CASE WHEN length(term) = 2 THEN token = term ELSE starts_with(token, term) END""",
    "index_counts": f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) SELECT substr(token, 1, 2) AS prefix, count(*) AS postings, count(DISTINCT token) AS tokens FROM t GROUP BY 1",
    "index_upkeep": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN concat_ws(' ', text, 'amended edition') ELSE text END AS text FROM documents WHERE doc_id % 6 = 1 OR doc_id % 7 <> 0),
t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM d) SELECT doc_id, count(*) AS n FROM t GROUP BY 1""",
    "index_segments": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN concat_ws(' ', 'fifth', text) WHEN doc_id % 21 = 0 THEN 'Zurück again' WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 6 = 1 THEN concat_ws(' ', text, 'amended edition') ELSE text END AS text FROM documents),
t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM d) SELECT substr(token, 1, 1) AS part, count(*) AS postings, count(DISTINCT doc_id) AS documents FROM t GROUP BY 1""",
    "hub_sorts": f"WITH {ROWS} " + " UNION ALL ".join(f"SELECT '{n}' AS sort, k AS position, url FROM (SELECT url, row_number() OVER (ORDER BY {o}, url) AS k FROM r WHERE opp) WHERE k <= 50" for n, o in _SORTS.items()),
    "tier_first_order": f"""WITH {ROWS}, h AS (SELECT url, score, CASE WHEN {_pre("head", "th")} THEN 2 WHEN {_pre("body", "th")} THEN 1 ELSE 0 END AS tier FROM s)
SELECT row_number() OVER (ORDER BY tier DESC, score DESC, url) AS position, url, tier FROM h WHERE tier > 0 ORDER BY position LIMIT 100""",
    "per_group_caps": f"""WITH {ROWS}, c AS (SELECT * FROM r WHERE company IS NOT NULL) SELECT url, 'keep_best' AS cap FROM (SELECT url, row_number() OVER (PARTITION BY company ORDER BY discipline = 'A' DESC, ts DESC, url) AS k FROM c) WHERE k <= 5
UNION ALL SELECT url, 'tier_first' FROM (SELECT url, row_number() OVER (PARTITION BY source_platform ORDER BY company_tier NULLS LAST, ts DESC, url) AS k FROM c) WHERE k <= 5
UNION ALL SELECT url, 'legacy' FROM (SELECT url, row_number() OVER (PARTITION BY source_platform ORDER BY score DESC, url) AS k FROM c) WHERE k <= 8""",
    "paced_queue": f"""WITH {ROWS} SELECT url, source_platform FROM (SELECT *, row_number() OVER (PARTITION BY source_platform ORDER BY score DESC, url) AS k FROM r WHERE opp)
WHERE source_platform NOT IN ('src0', 'src1') OR k <= 30 ORDER BY score DESC, url LIMIT 600""",
    "bands": f"""WITH {ROWS}, o AS (SELECT url, score, seen FROM r WHERE opp), h AS (SELECT url FROM o ORDER BY seen, score DESC, url LIMIT 1),
k AS (SELECT url, row_number() OVER (ORDER BY score DESC, url) AS k FROM o WHERE url NOT IN (SELECT url FROM h))
SELECT url, 'hero' AS band FROM h UNION ALL SELECT url, CASE WHEN k <= 3 THEN 'top' ELSE 'more' END FROM k WHERE k <= 15""",
    "palette_groups": f"""WITH {ROWS}, h AS (SELECT url, score, CASE WHEN opp THEN 'roles' ELSE 'other' END AS grp, CASE WHEN {_pre("head", "th")} THEN 2 WHEN {_pre("body", "th")} THEN 1 ELSE 0 END AS tier FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY tier DESC, score DESC, url) AS k, count(*) OVER (PARTITION BY grp) AS total FROM h WHERE tier > 0) SELECT grp AS "group", url, total FROM k WHERE k <= 6""",
    "counts": f"""WITH {ROWS} SELECT count(*) AS items, count(*) FILTER (opp) AS opportunities, count(DISTINCT source_platform) AS sources, count(closes_at) AS dated, count(*) FILTER (saved) AS saved, count(*) FILTER (saved AND opp) AS saved_roles,
count(*) FILTER (closes_at < {S.NOW}) AS closed, count(annual) AS disclosed, round(sum(annual), 2) AS pay_sum, count(*) FILTER (ts >= {S.NOW} - INTERVAL 30 DAY) AS fresh, bool_and(seen) AS all_seen FROM r""",
    "source_counts": f"WITH {ROWS} SELECT source_platform, item_type, count(*) AS n, count(*) FILTER (length(trim(content_text)) < 100) AS short, strftime(max(ts), '%Y-%m-%d') AS newest FROM r GROUP BY 1, 2",
    "saved_search_counts": f"""WITH {ROWS} SELECT count(*) FILTER (({_pre("head", "the")} OR {_pre("body", "the")}) AND ts > TIMESTAMP '1997-01-01') AS s_the,
count(*) FILTER (({_pre("head", "license")} OR {_pre("body", "license")}) AND ts > TIMESTAMP '1998-01-01') AS s_license, count(*) FILTER (({_whole("head", "of the")} OR {_whole("body", "of the")}) AND ts > TIMESTAMP '1996-06-01') AS s_of FROM s""",
    "skill_coverage": f"""WITH {ROWS} SELECT url, len(required_skills) AS asked, len(matched_skills) AS have, array_to_string(matched_skills, ',') AS has, array_to_string(list_filter(required_skills, lambda x: x = 's2'), ',') AS missing,
round(len(matched_skills) / nullif(len(required_skills), 0), 4) AS share FROM r""",
    "merit_report": f"""WITH {S.PASS_ONE}, k AS (SELECT round(merit, 6) AS m, row_number() OVER (ORDER BY round(merit, 6)) - 1 AS k, count(*) OVER () AS n FROM two WHERE opp)
SELECT {", ".join(f"round(max(m) FILTER (k = round((n - 1) * {p})), 4) AS {n}" for n, p in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("top", 1.0)))} FROM k""",
}
