"""Queries of page jobs, matching and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators import liveness as L
from feedlens.operators import match as X
from feedlens.operators import pages as P
from feedlens.operators import textmine as M
from feedlens.plans import mining, state
from feedlens.plans import sqlparts as S
from feedlens.sources import views
from feedlens.streaming import ingest


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = P.html_blocks(views.table(spark, d, "pages"), "page_id", "html")
    return rows.groupBy(F.col("url").alias("page_id")).agg(F.count(F.lit(1)).alias("blocks"), F.count_if("bullet").alias("bullets"), F.count_if("heading").alias("headings"), F.sum(F.length("text")).alias("chars"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return P.visible_text(views.table(spark, d, "pages"), "page_id", "html").select(F.col("url").alias("page_id"), F.length("text").alias("chars"), F.substring("text", 1, 40).alias("head"))


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    blocks = P.html_blocks(views.table(spark, d, "pages"), "page_id", "html")
    return P.assemble_detail(M.sections(blocks)).select(F.col("url").alias("page_id"), "status", F.length("description").alias("chars"))


def cards(spark: SparkSession, d: str) -> DataFrame:
    got = P.cards(views.table(spark, d, "pages"), "page_id", "html", ("li", ""), [("link", "a", "", "href"), ("label", "a", "", "")], "link")
    return got.select(F.col("id").alias("page_id"), "card_no", "link", "label")


def embedded(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("timestamp"))
    n = F.col("o_orderkey")
    body = F.struct(
        F.when(n % 5 == 0, "Article").otherwise("JobPosting").alias("@type"), F.col("o_orderpriority").alias("title"), F.date_format("day", "yyyy-MM-dd").alias("validThrough"),
        F.struct(F.lit("Co").alias("name")).alias("hiringOrganization"), F.struct(F.lit("EUR").alias("currency"), F.struct(F.col("o_totalprice").alias("minValue"), F.lit("YEAR").alias("unitText")).alias("value")).alias("baseSalary"),
        F.lit("a, b").alias("skills"),
    )
    text = F.when(n % 3 == 0, F.to_json(F.array(body))).when(n % 3 == 1, F.to_json(body)).otherwise(F.to_json(F.struct(F.array(body).alias("@graph"))))
    pages = o.select(n.alias("id"), F.concat(F.lit("<html><script type=\"application/ld+json\">{}</script><script type=\"application/ld+json\">"), text, F.lit("</script></html>")).alias("html"))
    got = P.embedded_posting(pages, "id", "html")
    return got.select("id", "title", "company", F.date_format("closes_at", "yyyy-MM-dd").alias("closes"), F.round("salary_min", 2).alias("salary_min"), "salary_period", F.array_join("tagged_skills", "/").alias("skills"))


def merged(spark: SparkSession, d: str) -> DataFrame:
    li = views.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_extendedprice").alias("p"), F.min("l_shipdate").alias("t"))
    s = F.col("s")
    c = li.select(
        F.col("l_orderkey").alias("url"), F.col("l_linenumber").alias("chain_pos"), F.when(s % 4 == 0, s.cast("string")).alias("description"), F.when(s % 5 == 0, F.col("t").cast("timestamp")).alias("closes_at"),
        F.when(s % 3 == 0, F.col("p")).alias("salary_min"), F.lit("year").alias("salary_period"), F.when(s % 7 == 0, "empty").otherwise("failed").alias("status"),
    )
    return P.merge_details(c).select("url", "description", F.date_format("closes_at", "yyyy-MM-dd").alias("closes"), "salary_min", "status")


def routes(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "pages")
    got = P.route(F.col("url"), F.when(F.col("page_id") % 4 == 0, F.lit("m")), {"example.net": "net", "example.org": "org"}, ["example.org"])
    return p.select("page_id", F.array_join(got, ">").alias("route"))


def bullets(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations").where("role = 'user'").select(F.col("turn").alias("bullet"), F.col("conv_id").alias("url"), "text")
    hits = M.skill_hits(c, S.SKILLS)
    return hits.select("bullet", "url", "text", F.transform("_skills", lambda s: s["skill"]).alias("skills"))


def demands(spark: SparkSession, d: str) -> DataFrame:
    return M.demand(views.lines(spark, d), S.SKILLS, mining.FIELDS, cues=(S.LEARN, S.NICE, S.MUST))


def scored(spark: SparkSession, d: str) -> DataFrame:
    foc = M.focus(mining.parts(spark, d), {"user": 3.0, "assistant": 1.0}, mining.STOPS)
    b = bullets(spark, d)
    ech = M.echo(b.select(F.col("bullet").alias("id"), "url", "text"), foc, mining.STOPS)
    return X.bullet_relevance(b, demands(spark, d), ech)


def relevance(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("bullet", "url", F.round("relevance", 4).alias("relevance"), F.array_join("covered", ",").alias("covered"))


def promoted(spark: SparkSession, d: str) -> DataFrame:
    """Entries of two turns each, ordered by score within a conversation."""
    e = X.entry_scores(scored(spark, d).withColumn("pos", F.floor(F.col("bullet") / 4)), ["url", "pos"]).withColumn("raw", F.col("entry_score")).withColumn("entry_score", F.round("entry_score", 6))
    return X.promote(e, ["url"], F.col("url") % 2 == 0).select("url", "pos", "place", F.round("raw", 4).alias("entry_score"))


def selected(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).select("url", "bullet", F.floor(F.col("bullet") / 4).alias("entry"), F.col("bullet").alias("pos"), F.round("relevance", 9).alias("relevance"), "covered", (F.col("bullet") == 0).alias("pinned"))
    return X.select_within(s, 2)


def tailored(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    kept = s.where(F.size("covered") >= 2).select("url", "bullet")
    return X.coverage_report(kept, s, demands(spark, d))


def overrides(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "part")
    n = F.col("p_partkey")
    parts = p.select(n.alias("id"), F.col("p_name").alias("text"), n.alias("pos"), (n % 2 == 0).alias("included"))
    over = p.where(n % 3 == 0).select(n.alias("id"), F.when(n % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("text"), F.lit(None).cast("boolean").alias("included"), F.when(n % 5 == 0, n).cast("int").alias("place"))
    left = X.tidy_overrides(over, parts).select("id", F.lit(True).alias("own"))
    got = X.apply_overrides(parts, over.withColumn("included", n_true(F.col("id"))))
    return got.join(left, "id", "left").select("id", "text", "included", F.col("order.place").alias("place"), F.coalesce("own", F.lit(False)).alias("own"))


def n_true(n: Column) -> Column:
    return F.when(n % 9 == 0, F.lit(True))


def stream_marks(spark: SparkSession, d: str) -> DataFrame:
    """User marks folded from a stream of events in five micro-batches, equal to the batch form."""
    table = views.table(spark, d, "events")
    landed = ingest.landing(spark, ingest.shared_folder(spark, "events"))
    events = spark.readStream.schema(table.schema).parquet(landed)
    flag = F.when(F.col("event_type") == "purchase", "saved").when(F.col("event_type") == "error", "dismissed").when(F.col("event_type") == "view", "seen")
    rows = events.select("user_id", (F.col("event_id") % state.n_documents(spark, d)).alias("url"), flag.alias("flag"), (F.col("value") > 5).alias("on"), "ts", "event_id").where("flag IS NOT NULL")
    keys = ["user_id", "url", "flag"]
    fold, kept = ingest.last_event_state(keys, ["ts", "event_id"], ["on"]), ingest.shared_folder(spark, "marks")
    for _ in ingest.in_parts(table, F.col("ts"), 5, landed):
        folded = ingest.fold_stream(rows, fold, kept, keys)
    got = L.marks(folded, ["user_id", "url"], "flag", "on", "ts")
    return got.select("user_id", "url", *(F.date_format(f"{c}_at", "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("saved", "dismissed", "seen")))


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The ranked upsert as a stream over lineitem in five micro-batches by ship date."""
    table = views.table(spark, d, "lineitem")
    landed = ingest.landing(spark, ingest.shared_folder(spark, "lineitem"))
    li = spark.readStream.schema(table.schema).parquet(landed)
    seq = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey", "l_quantity", "l_discount", "l_tax")
    rows = li.select(F.col("l_partkey").alias("url"), F.year("l_shipdate").alias("run"), (F.col("l_suppkey") % 28).alias("source_rank"), seq.alias("seq"), F.col("l_quantity").alias("quantity"), F.col("l_linestatus").alias("status"), F.when(F.col("l_returnflag") != "N", F.col("l_discount")).alias("gain"))
    fold = ingest.upsert_state("url", "run", "source_rank", "seq", ["quantity", "status"], ["gain"])
    kept = ingest.shared_folder(spark, "upsert")
    for _ in ingest.in_parts(table, F.col("l_shipdate"), 5, landed):
        folded = ingest.fold_stream(rows, fold, kept, ["url"])
    return folded.select("url", "quantity", "status", "gain", "last_run", F.lit(0).alias("missed"))


QUERIES = {
    "page_blocks": page_blocks, "page_text": page_text, "page_sections": page_sections, "page_cards": cards, "embedded_postings": embedded, "merge_details": merged, "detail_routes": routes,
    "bullet_relevance": relevance, "promote_entries": promoted, "select_within_budget": selected, "tailoring_coverage": tailored, "variant_overrides": overrides, "stream_marks": stream_marks, "stream_upsert": stream_upsert,
}

_DEM = mining._demand_sql("contains(low, 'ent')", False)
_ECHO = mining.ORACLES["focus_echo"].replace("round(sum(f.weight), 4) AS echo", "sum(f.weight) AS echo")
_REL = f"""{_DEM}, ech AS ({_ECHO}),
bu AS (SELECT turn AS bullet, conv_id AS url, text, lower(text) AS low FROM conversations WHERE role = 'user'),
sk AS (SELECT bullet, url, unnest(list_filter([CASE WHEN {mining._S1} THEN 's1' END, CASE WHEN contains(low, 'ent') THEN 's2' END, CASE WHEN {mining._S3} THEN 's3' END], lambda x: x IS NOT NULL)) AS skill FROM bu),
wa AS (SELECT url, skill, weight / max(weight) OVER (PARTITION BY url) AS want FROM dem),
bs AS (SELECT bullet, url, sum(2 * want) AS asked, list_sort(list_distinct(list(skill))) AS covered FROM sk JOIN wa USING (url, skill) GROUP BY bullet, url),
rel AS (SELECT bu.bullet, bu.url, coalesce(asked, 0) + 1.5 * ln(1 + coalesce(echo, 0)) + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.35 ELSE 0 END AS relevance, coalesce(covered, []) AS covered
 FROM bu LEFT JOIN bs ON bs.bullet = bu.bullet AND bs.url = bu.url LEFT JOIN ech ON ech.id = bu.bullet AND ech.url = bu.url)"""
_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '')"
_BULLETS = "unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">[^<]*</a></li>'))"
ORACLES = {
    "page_cards": f"""WITH c AS (SELECT page_id, {_BULLETS} AS card, generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>'), 1) - 1 AS card_no FROM pages)
SELECT page_id, card_no, regexp_extract(card, 'href="([^"]*)"', 1) AS link, nullif(trim(regexp_extract(card, '>([^<]*)</a>', 1)), '') AS label FROM c""",
    "embedded_postings": """SELECT o_orderkey AS id, o_orderpriority AS title, 'Co' AS company, strftime(o_orderdate, '%Y-%m-%d') AS closes, CASE WHEN o_totalprice >= 10000 THEN round(o_totalprice, 2) END AS salary_min,
CASE WHEN o_totalprice >= 10000 THEN 'year' END AS salary_period, 'a/b' AS skills FROM orders WHERE o_orderkey % 5 <> 0""",
    "merge_details": """WITH c AS (SELECT l_orderkey AS url, l_linenumber AS pos, min(l_suppkey) AS s, min(l_extendedprice) AS p, min(l_shipdate) AS t FROM lineitem GROUP BY 1, 2),
m AS (SELECT url, arg_min(CAST(s AS VARCHAR), pos) FILTER (s % 4 = 0) AS description, arg_min(t, pos) FILTER (s % 5 = 0) AS c, arg_min(p, pos) FILTER (s % 3 = 0) AS salary_min, bool_or(s % 7 = 0) AS e FROM c GROUP BY url)
SELECT url, description, strftime(c, '%Y-%m-%d') AS closes, salary_min, CASE WHEN description IS NOT NULL OR c IS NOT NULL THEN 'ok' WHEN e THEN 'empty' ELSE 'failed' END AS status FROM m""",
    "detail_routes": f"""WITH h AS (SELECT *, nullif({_HOST}, '') AS host FROM pages)
SELECT page_id, array_to_string(list_filter([CASE WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'net' WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'org' END,
CASE WHEN host IS NOT NULL AND NOT contains(url, '/search') AND NOT contains(url, '?q=') AND host <> 'example.org' AND NOT ends_with(host, '.example.org') THEN 'page' END, CASE WHEN page_id % 4 = 0 THEN 'mirror' END], lambda x: x IS NOT NULL), '>') AS route FROM h""",
    "bullet_relevance": f"WITH {_REL} SELECT bullet, url, round(relevance, 4) AS relevance, array_to_string(covered, ',') AS covered FROM rel",
    "select_within_budget": f"""WITH RECURSIVE {_REL}, st AS (
SELECT url, list(struct_pack(bullet := bullet, entry := bullet // 4, relevance := round(relevance, 9), covered := covered) ORDER BY bullet) AS bs FROM rel GROUP BY url
UNION ALL
SELECT url, list_filter(bs, lambda x: x.bullet <> -pick.p) FROM (SELECT url, bs, list_sort(list_transform(list_filter(bs, lambda r: r.bullet <> 0), lambda r: struct_pack(
  c := 0.5 + r.relevance + 1.5 * len(list_filter(r.covered, lambda s: len(list_filter(bs, lambda x: list_contains(x.covered, s))) = 1)) + 100 * CAST(len(list_filter(bs, lambda x: x.entry = r.entry)) = 1 AS INT), p := -r.bullet)))[1] AS pick
  FROM st WHERE len(bs) > 2) WHERE pick IS NOT NULL)
SELECT url, unnest(bs).bullet AS bullet FROM (SELECT url, arg_min(bs, len(bs)) AS bs FROM st GROUP BY url)""",
    "promote_entries": f"""WITH {_REL}, en AS (SELECT url, bullet // 4 AS pos, max(relevance) + 0.3 * (sum(relevance) - max(relevance)) AS s FROM rel GROUP BY 1, 2)
SELECT url, pos, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN url % 2 = 0 THEN -round(s, 6) ELSE 0 END, pos) AS place, round(s, 4) AS entry_score FROM en""",
    "tailoring_coverage": f"""WITH {_REL}, hs AS (SELECT url, list_distinct(flatten(list(covered))) AS has FROM rel WHERE len(covered) >= 2 GROUP BY url), ask AS (SELECT url, list(skill ORDER BY emphasis, skill) AS asked FROM dem GROUP BY url)
SELECT ask.url, len(asked) AS required, len(list_filter(asked, lambda x: list_contains(coalesce(has, []), x))) AS covered, array_to_string(list_filter(asked, lambda x: NOT list_contains(coalesce(has, []), x)), ',') AS missing FROM ask LEFT JOIN hs ON hs.url = ask.url""",
    "variant_overrides": """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN p_brand ELSE p_name END AS text, CASE WHEN p_partkey % 9 = 0 THEN true ELSE p_partkey % 2 = 0 END AS included,
CASE WHEN p_partkey % 15 = 0 THEN p_partkey ELSE 2147483647 END AS place, p_partkey % 6 = 0 AS own FROM part""",
    "stream_marks": "WITH m AS (" + state.ORACLES["user_marks"].replace("WITH e AS", "WITH e AS", 1) + ") SELECT m.* FROM m WHERE EXISTS (SELECT 1 FROM events v WHERE v.user_id = m.user_id AND v.event_id % (SELECT count(*) FROM documents) = m.url AND v.event_type IN ('purchase', 'error', 'view'))",
    "stream_upsert": state.ORACLES["ranked_upsert"],
}
