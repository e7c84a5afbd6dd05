"""Queries of the end of a run, routes, pasted postings, reports over all of them, and résumé documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators import gates as G
from feedlens.operators import resume as V
from feedlens.operators import runs as U
from feedlens.plans import feed, mining, reader, reports, search, state
from feedlens.plans import sqlparts as S
from feedlens.sources import views
from feedlens.sources.shared import stored


def finished(spark: SparkSession, d: str) -> U.Finished:
    """The cache of the liveness queries at the end of a run with room for 3,000 roles; marks of all events; details of half."""
    n = F.col("doc_id")
    items = feed.R.derive(state.cache(spark, d).drop("seen", "saved", "dismissed"), feed.PROFILE, S.MAJORS, S.INTERESTS, S.BANDS, feed.tiers(spark)).drop("content_text")
    urls = items.select(n.alias("k"), "url")
    marks = reader.marks(spark, d).withColumnRenamed("url", "k").join(urls, "k").drop("k")
    details = items.where(n % 2 == 0).select("url")
    known = spark.createDataFrame([("en", "src1")], "ats string, slug string")
    return U.finish_run(
        stored(items, "cache"), stored(marks, "states"), details, state.scopes(spark, d), known, feed.PROFILE, state.as_of(), state.as_of(), F.lit(None).cast("timestamp"), ["src3", "src7"],
        {"en.example.com": "en", "de.example.com": "de"}, complete=True, ceiling=3000,
    )


def run_end(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each table and what was found and swept, by key; the time of the refresh in every row."""
    f = finished(spark, d)
    row = lambda df, name, key, more=F.lit(""): df.select(F.lit(name).alias("part"), key.alias("key"), more.alias("note"))
    url = F.col("url")
    out = row(f.items, "items", url).unionByName(row(f.reasons, "swept", url, F.col("reason"))).unionByName(row(f.states, "states", url)).unionByName(row(f.details, "details", url))
    out = out.unionByName(row(f.boards, "boards", F.concat_ws("/", "ats", "slug")))
    return out.withColumn("refreshed", F.date_format(f.last_refresh, "yyyy-MM-dd HH:mm"))


def watermarks(spark: SparkSession, d: str) -> DataFrame:
    """A search per customer, opened by the views of the user of that number."""
    first = F.lit("2024-01-15 00:00:00").cast("timestamp")
    searches = views.table(spark, d, "customer").select(F.col("c_custkey").alias("search"), "c_mktsegment", first.alias("viewed_at"))
    opens = views.table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("search"), F.col("ts").alias("at"))
    return U.open_searches(searches, opens).select("search", "c_mktsegment", F.date_format("viewed_at", "yyyy-MM-dd HH:mm:ss").alias("viewed"))


def this_year(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("not_open"), "o_totalprice")
    return U.current_year(o, feed.as_of(), [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_totalprice")


def pasted_rows(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return views.table(spark, d, "documents").select(n.alias("url"), "source", F.col("lang").alias("company"), "text", F.timestamp_seconds(1_700_000_000 + n).alias("created_at")).withColumnRenamed("source", "title")


def pasted(spark: SparkSession, d: str) -> DataFrame:
    """All documents as pasted postings, without those whose number ends in 3."""
    rows = pasted_rows(spark, d)
    kept, details = U.delete_pasted(rows.where("url % 10 = 3"), rows, U.pasted_details(rows, most=10**8))
    got = U.pasted_items(kept, details)
    return got.select("url", "title", "company", F.md5("content_text").alias("content"), F.md5("description").alias("description"), F.md5("requirements").alias("requirements"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def stored_details(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as stored details; every seventh is corrupt."""
    c = views.table(spark, d, "conversations")
    body = F.to_json(F.struct(F.col("text").alias("description"), F.when(F.col("turn") % 2 == 0, F.array("role")).alias("tags")))
    raw = c.select(F.struct("conv_id", "turn").alias("url"), F.lit("ok").alias("status"), F.when((F.col("conv_id") + F.col("turn")) % 7 != 0, body).otherwise("{").alias("payload"))
    return U.read_details(raw).select("url.conv_id", "url.turn", F.md5("description").alias("description"), F.array_join("tags", ",").alias("tags"))


def routed(spark: SparkSession, d: str) -> DataFrame:
    """Documents at addresses of every kind of posting page."""
    n = F.col("doc_id")
    key = n.cast("string")
    kinds = [
        F.concat(F.lit("https://boards.greenhouse.io/"), "source", F.lit("/jobs/"), key), F.concat(F.lit("https://jobs.lever.co/"), "source", F.lit("/"), key, F.lit("/apply")),
        F.concat(F.lit("https://jobs.smartrecruiters.com/"), "source", F.lit("/"), key), F.concat(F.lit("https://t1.wd5.myworkdayjobs.com/en-US/"), "source", F.lit("/job/Place/"), key),
        F.concat(F.lit("https://apply.workable.com/"), "source", F.lit("/j/"), key), F.concat(F.lit("https://c.eightfold.ai/careers/job/"), key),
        F.concat(F.lit("https://www.linkedin.com/jobs/view/a-role-at-"), "source", F.lit("-"), key, F.lit("?x=1")), F.concat(F.lit("https://example.com/search?keyword="), key),
        F.concat(F.lit("https://example.com/"), "source", F.lit("/"), key),
    ]
    url = F.get(F.array(*kinds), (n % len(kinds)).cast("int"))
    rows = views.table(spark, d, "documents").select("doc_id", url.alias("url"), F.when(n % 4 == 0, key).alias("mirror"))
    return rows.withColumn("route", U.posting_route(F.col("url"), F.col("mirror")))


def routes(spark: SparkSession, d: str) -> DataFrame:
    shown = F.array_join(F.transform("route", lambda r: F.concat(r["handler"], F.lit(":"), F.array_join(r["params"], ","))), " > ")
    return routed(spark, d).select("doc_id", shown.alias("route"))


def route_report(spark: SparkSession, d: str) -> DataFrame:
    return U.route_report(routed(spark, d))


def boards(spark: SparkSession, d: str) -> DataFrame:
    """Users as boards of a family each, by their last event."""
    e = views.table(spark, d, "events")
    answer = F.when(F.col("event_type").isin("purchase", "view"), "Rows").when(F.col("event_type") == "error", "Gone").otherwise("Empty")
    last = e.groupBy("user_id").agg(F.max_by(answer, "event_id").alias("answer"), F.count(F.lit(1)).alias("postings"))
    return U.board_tally(last.withColumn("family", F.col("user_id") % 6))


def detail_report(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations")
    text = lambda role: F.when(F.col("role") == role, F.col("text"))
    got = U.detail_coverage(c.select(F.col("role").alias("handler"), F.when(F.col("turn") % 3 == 0, "empty").otherwise("ok").alias("status"), text("user").alias("description"), text("tool").alias("requirements"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("responsibilities"), F.lit(None).cast("string").alias("perks")))
    return got.select("handler", "status", "n", *(F.round(c, 4).alias(c) for c in ("description", "requirements", "responsibilities", "perks")))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return U.corpus_report(views.items(spark, d))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return stored(feed.ranked(spark, d).withColumn("merit", F.round("merit", 9)), "ranked")


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return U.calibration(_ranked(spark, d), feed.as_of())


def overlap(spark: SparkSession, d: str) -> DataFrame:
    attempted = views.items(spark, d).where("doc_id % 5 = 0").select("url")
    return U.queue_overlap(_ranked(spark, d), attempted, feed.as_of(), ~F.col("url").endswith("3"))


def widgets(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("discipline") == "A", 10).otherwise(0) + F.when(G.is_opportunity(F.col("item_type")), 5).when(F.col("item_type") == "Event", 4).otherwise(0)
    return G.home_widgets(reports.derived_rows(spark, d).withColumn("score", score), ["src2", "src3"])


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    """A résumé document per conversation: turns of a role are records of a section, their lines its highlights."""
    c = views.table(spark, d, "conversations").where("text IS NOT NULL")
    record = F.struct(
        "turn", F.concat(F.lit("Org "), F.col("turn").cast("string")).alias("organization"), F.col("role").alias("position"), F.when(F.col("turn") % 2 == 0, "Area").alias("area"),
        F.lit("2020").alias("startDate"), F.when(F.col("turn") % 3 == 0, F.array(F.lit("Rust "), F.lit(""), F.lit("SQL"))).alias("keywords"), F.lit(" 3.9").alias("score"), F.split("text", "\n").alias("highlights"),
    )
    of = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, record)))
    basics = F.struct(F.concat(F.lit("Reader "), F.col("conv_id").cast("string")).alias("name"), F.struct(F.lit("Toronto").alias("city"), F.lit("ON").alias("region")).alias("location"))
    made = c.groupBy("conv_id").agg(of("user").alias("education"), of("assistant").alias("work"), of("tool").alias("projects"))
    return made.select(F.col("conv_id").alias("resume"), F.to_json(F.struct(basics.alias("basics"), "education", "work", "projects")).alias("json"))


def imported(spark: SparkSession, d: str) -> DataFrame:
    got = V.parts(V.read_documents(documents_of(spark, d)))
    return got.select("resume", "section", "kind", "entry", "org", "title", "start", "detail", "bullet", F.md5("text").alias("text"))


def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents imported, exported and imported again: ids and texts are as after the first time."""
    first = V.read_documents(documents_of(spark, d))
    again = V.read_documents(V.export_documents(V.parts(first), V.contacts(first)))
    keys = ["resume", "section", "entry", "bullet", "section_id", "entry_id", "bullet_id", "text"]
    a, b = V.parts(first).select(*keys), V.parts(again).select(*keys)
    same = [a[k].eqNullSafe(b[k]) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return a.join(b, cond, "left_semi").groupBy("resume").agg(F.count(F.lit(1)).alias("same"))


def skills_block(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as postings; readers are their parity, the even one with lines of its own."""
    lines = spark.createDataFrame([(0, 0, "Tools", ["s4", "s2"]), (0, 1, "Core", ["s3", "s1", "s5"]), (0, 2, " ", ["s9"])], "resume long, pos int, label string, items array<string>")
    have = spark.createDataFrame([(1, "s1"), (1, "s2"), (1, "s4"), (0, "s1")], "resume long, skill string")
    catalog = spark.createDataFrame([("Languages", 0, "s4", 0), ("Languages", 0, "s1", 1), ("Data", 1, "s2", 0)], "category string, category_pos int, skill string, skill_pos int")
    lead = spark.createDataFrame([(1, "s2")], "resume long, skill string")
    dem = mining.demand(spark, d)
    top = dem.groupBy("url").agg(F.max("weight").alias("_top"))
    wants = dem.join(top, "url").select("url", "skill", F.round(F.col("weight") / F.col("_top"), 4).alias("weight"))
    posts = views.table(spark, d, "conversations").select((F.col("conv_id") % 2).alias("resume"), F.col("conv_id").alias("url")).distinct()
    got = V.skills_block(lines, V.generated_lines(have, catalog), posts, wants, lead)
    return got.select("url", "position", "label", F.array_join("items", ",").alias("items"))


def frozen(spark: SparkSession, d: str) -> DataFrame:
    """The variant of each document that keeps even bullets and leaves out every third entry."""
    rows = stored(V.parts(V.read_documents(documents_of(spark, d))), "parts")
    include = rows.where("entry % 3 = 2").select("resume", F.col("entry_id").alias("id"), F.lit(False).alias("included")).distinct()
    got = V.frozen_includes(rows, include, rows.where("bullet % 2 = 0").select("resume", F.col("bullet_id").alias("id")))
    drawn = rows.select("resume", "section_id", "kind", "entry", "entry_id").distinct().groupBy("resume", "section_id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("entry"), "entry_id"))), lambda x: x["entry_id"]).alias("order"))
    orders = V.frozen_orders(drawn, drawn.select("resume", "section_id", "order").limit(0))
    n = orders.groupBy("resume").agg(F.count(F.lit(1)).alias("orders"))
    return got.groupBy("resume").agg(F.count_if(~F.col("included")).alias("off")).join(n, "resume", "left").select("resume", "off", F.coalesce("orders", F.lit(0)).alias("orders"))


def explained(spark: SparkSession, d: str) -> DataFrame:
    """The feed with skill coverage in the merit, and the names of a row's terms, the weightiest first."""
    asked, have = F.size("required_skills"), F.size("matched_skills")
    rows = search.narrow(spark, d).withColumn("coverage", F.when(asked >= 2, have / asked))
    got = feed.R.personalize(rows, feed.PROFILE, feed.as_of(), coverage=F.col("coverage"))
    return got.select("url", F.round("merit", 4).alias("merit"), F.round("score", 4).alias("score"), F.array_join(F.transform("breakdown", lambda t: t["label"]), ",").alias("terms"))


QUERIES = {
    "run_end": run_end, "search_watermarks": watermarks, "current_year": this_year, "pasted_postings": pasted, "stored_details": stored_details, "posting_routes": routes, "route_report": route_report,
    "board_tally": boards, "detail_coverage": detail_report, "corpus_report": corpus, "calibration": calibration, "queue_overlap": overlap, "home_widgets": widgets, "resume_import": imported,
    "resume_round_trip": round_trip, "skills_block": skills_block, "frozen_choices": frozen, "feed_explained": explained,
}

_FMT = "'%Y-%m-%d %H:%M:%S'"
_ROUTES = """n AS (SELECT doc_id, source, doc_id % 9 AS k, CAST(doc_id AS VARCHAR) AS key FROM documents),
u AS (SELECT *, CASE k WHEN 3 THEN concat('https://t1.wd5.myworkdayjobs.com/en-US/', source, '/job/Place/', key) WHEN 8 THEN concat('https://example.com/', source, '/', key) END AS page,
 CASE k WHEN 0 THEN concat('greenhouse:', source, ',', key) WHEN 1 THEN concat('lever:', source, ',', key) WHEN 2 THEN concat('smartrecruiters:', source, ',', key) WHEN 3 THEN concat('workday:t1.wd5.myworkdayjobs.com,t1,', source, ',Place/', key)
 WHEN 4 THEN concat('workable:', source, ',', key) WHEN 5 THEN concat('eightfold:c.eightfold.ai,', key) WHEN 6 THEN concat('linkedin:', key) END AS own, CASE WHEN doc_id % 4 = 0 THEN concat('mirror:', key) END AS mirror FROM n),
x AS (SELECT *, concat_ws(' > ', own, 'schema.org:' || page, mirror) AS route FROM u)"""
_PLAIN = mining.ORACLES["plain_sections"].split("SELECT url, section, count(*)")[0]
_MARKS = reader._MARKS
_SECTION = "CASE role WHEN 'user' THEN 'education' WHEN 'assistant' THEN 'experience' WHEN 'tool' THEN 'projects' END"
_DOC = f"""c AS (SELECT conv_id, turn, role, text, {_SECTION} AS kind FROM conversations WHERE text IS NOT NULL AND role IN ('user', 'assistant', 'tool')),
p AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END) - 1 AS section, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS entry FROM c),
h AS (SELECT conv_id, turn, role, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM c),
b AS (SELECT p.*, unnest(CASE WHEN len(lines) = 0 THEN [NULL] ELSE lines END) AS line, unnest(CASE WHEN len(lines) = 0 THEN [NULL] ELSE range(len(lines)) END) AS bullet FROM p JOIN h USING (conv_id, turn, role))"""
_MERIT = f"{S.RANKED}, q AS (SELECT *, round(merit, 9) AS m FROM ranked), o AS (SELECT *, row_number() OVER (ORDER BY m DESC, url) AS k FROM q WHERE opp)"
_COVER = "CASE WHEN opp AND len(required_skills) >= 2 THEN 6.0 * len(matched_skills) / len(required_skills) ELSE 0.0 END"
_LABELS = {
    "field": "CASE WHEN discipline = 'A' THEN 4.0 ELSE 0.0 END", "kind": "CASE WHEN opp THEN 5.0 WHEN item_type = 'Event' THEN 4.0 ELSE 0.0 END", "interests": "least(len(matched_interests) * 4.0, 8.0)",
    "prestige": "8.0 * CASE company_tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 WHEN 4 THEN 0.2 ELSE 0.0 END",
    "level": "CASE WHEN opp THEN 6.0 * CASE WHEN seniority IS NULL THEN 0.0 WHEN seniority = 'Intern' THEN 1.0 ELSE -1.0 END ELSE 0.0 END", "home": "CASE WHEN list_contains(location_tags, 'Canada') THEN 3.0 ELSE 0.0 END",
    "skills": "cover", "pay": f"CASE WHEN opp THEN 4.0 * coalesce(greatest(0.0, least(1.0, ({S.annual()} - 60000.0) / 140000.0)), 0.0) ELSE 0.0 END",
    "recent": f"6.0 * pow(0.5, abs({S.minutes(S.NOW, 'ts')}) / 60.0 / 48.0)", "closed": "CASE WHEN t.kind IS NOT NULL AND days < 0 THEN -20.0 ELSE 0.0 END", "seen": "CASE WHEN seen THEN -3.0 ELSE 0.0 END",
    "closing": "CASE WHEN t.kind IS NOT NULL AND days >= 0 THEN 8.0 * urgency * greatest(0.0, least(1.0, (merit + cover - b.lo) / (b.hi - b.lo))) ELSE 0.0 END",
}
ORACLES = {
    "feed_explained": f"""WITH {search.ROWS}, t AS (SELECT *, {_COVER} AS cover FROM r), o2 AS (SELECT kind, merit + cover AS m, row_number() OVER (PARTITION BY kind ORDER BY merit + cover) - 1 AS k, count(*) OVER (PARTITION BY kind) AS n FROM t WHERE kind IS NOT NULL),
m2 AS (SELECT kind, max(m) FILTER (k = round((n - 1) * 0.5)) AS p50, max(m) FILTER (k = round((n - 1) * 0.9)) AS p90 FROM o2 GROUP BY kind),
b AS (SELECT f.kind, greatest(f.lo, coalesce(p50, f.lo)) AS lo, greatest(greatest(f.hi, coalesce(p90, f.hi)), greatest(f.lo, coalesce(p50, f.lo)) + 1.0) AS hi FROM (VALUES ('opportunity', 9.0, 13.0), ('event', 6.0, 12.0)) f(kind, lo, hi) LEFT JOIN m2 ON m2.kind = f.kind),
x AS (SELECT url, merit + cover AS merit, score1 + cover + {_LABELS["closing"]} AS score, list_sort(list_filter([{", ".join(f"struct_pack(k := -({e}), l := '{n}')" for n, e in _LABELS.items())}], lambda q: q.k <> 0)) AS terms FROM t LEFT JOIN b ON b.kind = t.kind)
SELECT url, round(merit, 4) AS merit, round(score, 4) AS score, array_to_string(list_transform(terms, lambda q: q.l), ',') AS terms FROM x""",
    "run_end": f"""WITH {state._CACHE}, {_MARKS}, {S.PASS_ONE.replace(S.ITEMS + ", ", "", 1)}, fits AS (SELECT doc_id, row_number() OVER (ORDER BY round(merit - CASE WHEN opp THEN 4.0 * coalesce(greatest(0.0, least(1.0, ({S.annual()} - 60000.0) / 140000.0)), 0.0) ELSE 0.0 END, 6) DESC, c.ts DESC, url) AS k
 FROM two t JOIN (SELECT doc_id, ts FROM cache) c USING (doc_id) WHERE opp), kept AS (SELECT * FROM charged WHERE item_type NOT IN ('Job', 'Internship') OR doc_id IN (SELECT doc_id FROM fits WHERE k <= 3000)),
j AS (SELECT *, {state._REASON} AS reason FROM kept), m AS (SELECT i.url, saved_at FROM marks m JOIN items i ON i.doc_id = m.url),
st AS (SELECT url, saved_at FROM m WHERE saved_at IS NOT NULL OR url IN (SELECT url FROM j WHERE reason IS NULL)),
a AS (SELECT 'items' AS part, url AS key, '' AS note FROM j WHERE reason IS NULL UNION ALL SELECT 'swept', url, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT 'states', url, '' FROM st
 UNION ALL SELECT 'details', url, '' FROM items WHERE doc_id % 2 = 0 AND (url IN (SELECT url FROM j WHERE reason IS NULL) OR url IN (SELECT url FROM m WHERE saved_at IS NOT NULL))
 UNION ALL SELECT DISTINCT 'boards', concat(substr(url, 9, 2), '/', source_platform), '' FROM kept WHERE substr(url, 9, 2) IN ('en', 'de') AND NOT (substr(url, 9, 2) = 'en' AND source_platform = 'src1'))
SELECT *, '2000-06-01 12:00' AS refreshed FROM a""",
    "search_watermarks": f"""WITH o AS (SELECT user_id, max(ts) AS at_ FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT c_custkey AS search, c_mktsegment, strftime(greatest(TIMESTAMP '2024-01-15', coalesce(at_, TIMESTAMP '2024-01-15')), {_FMT}) AS viewed FROM customer LEFT JOIN o ON o.user_id = c_custkey""",
    "current_year": "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1998 AND o_orderstatus <> 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "pasted_postings": f"""{_PLAIN}, t AS (SELECT url, string_agg(text, chr(10) ORDER BY line) FILTER (section = 'overview') AS description, string_agg(text, chr(10) ORDER BY line) FILTER (section = 'requirements') AS requirements FROM z WHERE n_ <= 120 GROUP BY url)
SELECT doc_id AS url, source AS title, lang AS company, md5(substr(d.text, 1, 280)) AS content, md5(description) AS description, md5(requirements) AS requirements, strftime(to_timestamp(1700000000 + doc_id), {_FMT}) AS at
FROM documents d LEFT JOIN t ON t.url = doc_id WHERE doc_id % 10 <> 3""",
    "stored_details": """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 <> 0 THEN md5(text) END AS description, CASE WHEN (conv_id + turn) % 7 <> 0 AND turn % 2 = 0 THEN role ELSE '' END AS tags FROM conversations""",
    "posting_routes": f"WITH {_ROUTES} SELECT doc_id, route FROM x",
    "route_report": f"""WITH {_ROUTES}, r AS (SELECT 'lead' AS report, CASE WHEN route = '' THEN 'unsupported' ELSE split_part(route, ':', 1) END AS value FROM x
 UNION ALL SELECT 'length', CAST(CASE WHEN route = '' THEN 0 ELSE len(string_split(route, ' > ')) END AS VARCHAR) FROM x UNION ALL SELECT 'unrouted', 'example.com' FROM x WHERE route = '') SELECT report, value, count(*) AS n FROM r GROUP BY 1, 2""",
    "board_tally": """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS t, count(*) AS n FROM events GROUP BY 1)
SELECT user_id % 6 AS family, count(*) FILTER (t IN ('purchase', 'view')) AS live, count(*) FILTER (t NOT IN ('purchase', 'view', 'error')) AS empty, count(*) FILTER (t = 'error') AS dead, sum(n) AS postings FROM l GROUP BY 1""",
    "detail_coverage": """WITH c AS (SELECT *, CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0.0 END AS f FROM conversations) SELECT role AS handler, CASE WHEN turn % 3 = 0 THEN 'empty' ELSE 'ok' END AS status, count(*) AS n,
round(avg(CASE WHEN role = 'user' THEN f ELSE 0.0 END), 4) AS description, round(avg(CASE WHEN role = 'tool' THEN f ELSE 0.0 END), 4) AS requirements, round(avg(CASE WHEN turn % 2 = 0 THEN f ELSE 0.0 END), 4) AS responsibilities, 0.0 AS perks FROM c GROUP BY 1, 2""",
    "corpus_report": f"WITH {S.ITEMS} SELECT item_type, count(*) AS n, count(*) FILTER (trim(coalesce(content_text, '')) = '') AS empty FROM items GROUP BY 1",
    "calibration": f"""WITH {_MERIT}, k AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS k, count(*) OVER () AS n FROM o), soon AS (SELECT * FROM q WHERE kind IS NOT NULL AND closes_at BETWEEN {S.NOW} AND {S.NOW} + INTERVAL 7 DAY)
SELECT {", ".join(f"max(m) FILTER (k = round((n - 1) * {p})) AS {n}" for n, p in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("top", 1.0)))}, (SELECT count(*) FROM soon) AS closing, (SELECT count(*) FILTER (last_call) FROM soon) AS flagged,
(SELECT count(closes_at) FROM o WHERE k <= 600) AS known_600, (SELECT count(closes_at) FROM o WHERE k <= 2000) AS known_2000 FROM k""",
    "queue_overlap": f"""WITH {S.RANKED}, f AS (SELECT *, round(merit, 9) AS m, NOT ends_with(url, '3') AS ok, closes_at IS NULL OR closes_at >= {S.NOW} AS open_, coalesce(company, source_platform) AS bucket FROM ranked WHERE opp AND doc_id % 5 <> 0),
best AS (SELECT url FROM f WHERE ok AND open_ ORDER BY m DESC, url LIMIT 600),
w AS (SELECT *, row_number() OVER v AS r, first_value(score) OVER v AS t, first_value(url) OVER v AS g FROM f WINDOW v AS (PARTITION BY bucket ORDER BY score DESC, url)),
a AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY r, score DESC, t DESC, g) AS pos FROM w) WHERE pos <= 4800 AND ok ORDER BY pos LIMIT 600),
c AS (SELECT * FROM f WHERE open_ ORDER BY m DESC, score DESC, url LIMIT 4800), x AS (SELECT *, row_number() OVER v AS r, first_value(m) OVER v AS t, first_value(url) OVER v AS g FROM c WINDOW v AS (PARTITION BY bucket ORDER BY m DESC, url)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY r, m DESC, t DESC, g) AS pos FROM x) WHERE ok ORDER BY pos LIMIT 600), q AS (SELECT 'feed' AS queue, url FROM a UNION ALL SELECT 'merit', url FROM b)
SELECT queue, count(*) AS fetches, count(*) FILTER (url IN (SELECT url FROM best)) AS reached FROM q GROUP BY 1""",
    "home_widgets": f"""WITH {S.DERIVED}, s AS (SELECT *, CASE WHEN discipline = 'A' THEN 10 ELSE 0 END + CASE WHEN opp THEN 5 WHEN item_type = 'Event' THEN 4 ELSE 0 END AS score FROM derived)
SELECT 'opportunity' AS widget, 1 AS position, url AS value FROM (SELECT url FROM s WHERE opp AND score >= 10 ORDER BY score DESC, url LIMIT 1)
UNION ALL SELECT 'article', k, url FROM (SELECT url, row_number() OVER (ORDER BY score DESC, url) AS k FROM s WHERE item_type = 'Article' AND source_platform IN ('src2', 'src3')) WHERE k <= 3
UNION ALL SELECT 'source', row_number() OVER (ORDER BY v), v FROM (SELECT DISTINCT source_platform AS v FROM s) UNION ALL SELECT 'discipline', row_number() OVER (ORDER BY v), v FROM (SELECT DISTINCT discipline AS v FROM s)""",
    "resume_import": f"""WITH {_DOC} SELECT conv_id AS resume, section, kind, entry, concat('Org ', CAST(turn AS VARCHAR)) AS org, CASE WHEN role = 'tool' OR turn % 2 <> 0 THEN role ELSE concat(role, ', Area') END AS title, '2020' AS start,
CASE WHEN role = 'tool' AND turn % 3 = 0 THEN 'Rust · SQL' ELSE '3.9' END AS detail, bullet, md5(line) AS text FROM b""",
    "resume_round_trip": f"WITH {_DOC} SELECT conv_id AS resume, count(*) AS same FROM b GROUP BY 1",
    "skills_block": f"""WITH {mining._demand_sql("contains(low, 'ent')", False)}, w1 AS (SELECT url, skill, round(round(weight, 4) / max(round(weight, 4)) OVER (PARTITION BY url), 4) AS weight FROM dem),
v AS (SELECT * FROM (VALUES (0, 0, 'Tools', 0, 's4'), (0, 0, 'Tools', 1, 's2'), (0, 1, 'Core', 0, 's3'), (0, 1, 'Core', 1, 's1'), (0, 1, 'Core', 2, 's5'), (1, 0, 'Languages', 0, 's4'), (1, 0, 'Languages', 1, 's1'), (1, 1, 'Data', 0, 's2')) v(resume, pos, label, place, skill)),
x AS (SELECT p.url, v.*, CASE WHEN v.resume = 1 AND v.skill = 's2' THEN 2.0 ELSE coalesce(w1.weight, 0.0) END AS rank_ FROM (SELECT DISTINCT conv_id AS url FROM conversations) p JOIN v ON v.resume = p.url % 2 LEFT JOIN w1 ON w1.url = p.url AND w1.skill = v.skill)
SELECT url, row_number() OVER (PARTITION BY url ORDER BY best DESC, pos) AS position, label, items FROM (SELECT url, pos, label, max(rank_) AS best, string_agg(skill, ',' ORDER BY rank_ DESC, place) AS items FROM x GROUP BY url, pos, label)""",
    "frozen_choices": f"""WITH {_DOC}, e AS (SELECT conv_id, count(*) FILTER (entry % 3 = 2) AS off FROM p GROUP BY 1), f AS (SELECT conv_id, count(*) FILTER (entry % 3 <> 2 AND bullet % 2 = 1) AS off FROM b GROUP BY 1),
o AS (SELECT conv_id, count(*) AS n FROM p WHERE role = 'tool' GROUP BY 1) SELECT e.conv_id AS resume, e.off + f.off AS off, CASE WHEN n > 1 THEN 1 ELSE 0 END AS orders FROM e JOIN f USING (conv_id) LEFT JOIN o USING (conv_id) WHERE e.off + f.off > 0""",
}
