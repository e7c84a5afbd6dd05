"""Queries of the payload normalisers: payloads are made of the given tables with to_json and then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.sources import dispatch, views
from feedlens.sources import landed as L


def as_of() -> Column:
    return F.lit("2000-06-01 12:00:00").cast("timestamp")


def payloads(spark: SparkSession, d: str, *fields: Column, array: bool = False) -> DataFrame:
    o = views.table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("timestamp"))
    body = F.to_json(F.array(F.struct(*fields)) if array else F.struct(*fields))
    return o.select(F.lit("x").alias("source"), as_of().alias("fetched_at"), body.alias("payload"))


N, KEY, PRICE = F.col, "o_orderkey", "o_totalprice"
URL = lambda: F.concat(F.lit("https://x.example/"), F.col(KEY).cast("string"))
DAY = lambda c: F.date_format(c, "yyyy-MM-dd")


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("title", "item_type", "url", "content_text", DAY("ts").alias("day"), "location", "company", DAY("closes_at").alias("closes"), F.round("salary_min", 2).alias("salary_min"), "salary_period", "simplify_id")


def listings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col(KEY)
    p = payloads(
        spark, d, n.cast("string").alias("id"), F.when(n % 2 == 0, "Simplify").otherwise("other").alias("origin"), F.col("o_orderpriority").alias("title"), F.when(n % 5 == 0, "Unknown").otherwise("Co").alias("company_name"),
        F.when(n % 7 != 0, URL()).otherwise("").alias("url"), F.col("o_orderstatus").alias("category"), F.array(F.lit(" Toronto"), F.lit(""), F.lit("Paris ")).alias("locations"), F.array(F.lit("Summer 2026")).alias("terms"),
        (n % 3 != 0).alias("active"), F.lit(True).alias("is_visible"), F.unix_seconds("day").alias("date_posted"), array=True,
    )
    return shown(L.listings_json(p))


def link_page(spark: SparkSession, d: str) -> DataFrame:
    n = F.col(KEY)
    return shown(L.front_page(payloads(spark, d, n.alias("id"), F.col("o_orderpriority").alias("title"), F.when(n % 2 == 0, URL()).otherwise("").alias("url"), F.unix_seconds("day").alias("time"))))


def thread(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "part")
    n = F.col("p_partkey")
    head = F.concat_ws(" | ", "p_brand", F.when(n % 2 == 0, F.lit("Intern")).otherwise(F.col("p_name")), F.when(n % 3 == 0, F.lit("Full-time")), F.when(n % 5 != 0, F.lit("Oslo")), F.lit("$90k"), F.lit("Remote"))
    rows = p.select(F.lit("hn").alias("source"), n.alias("id"), (n % 4).alias("parent_id"), F.concat(head, F.lit("\nmore")).alias("text"), as_of().alias("ts"))
    return shown(L.hiring_thread(rows, F.lit(1)))


def edges(spark: SparkSession, d: str) -> DataFrame:
    node = F.struct(F.when(F.col(KEY) % 3 != 0, F.col("o_orderpriority")).alias("title"), URL().alias("permalink"), F.date_format("day", "yyyy-MM-dd").alias("createdAt"))
    return shown(L.graph_edges(payloads(spark, d, F.struct(F.struct(F.array(F.struct(node.alias("node"))).alias("edges")).alias("page")).alias("data"))))


def contests(spark: SparkSession, d: str) -> DataFrame:
    later = F.col("day") + F.expr("INTERVAL '40' DAY")
    period = F.concat(F.date_format("day", "MMM dd"), F.lit(" - "), F.date_format(later, "MMM dd, yyyy"))
    prize = F.when(F.col(KEY) % 2 == 0, "$<span>0</span>").otherwise("$<span>500</span>")
    return shown(L.hackathons(payloads(spark, d, F.col("o_orderpriority").alias("title"), URL().alias("url"), period.alias("period"), F.lit("Online").alias("place"), prize.alias("prize"), F.array(F.lit("a"), F.lit("b")).alias("themes"))))


def remote(spark: SparkSession, d: str) -> DataFrame:
    n = F.col(KEY)
    p = payloads(
        spark, d, F.when(n % 2 == 0, (n % 100).cast("string")).alias("guid"), URL().alias("link"), F.col("o_orderpriority").alias("title"), F.lit("Co").alias("company"), F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D")).alias("places"),
        F.concat(F.lit("1"), F.format_number(F.floor(F.col(PRICE) / 10), 0)).alias("min"), F.lit("USD").alias("currency"), F.lit("annual").alias("unit"), (F.unix_seconds("day") * 100_000 + n).alias("posted"), F.unix_seconds("day").alias("expiry"),
    )
    return L.remote_search(p).select("url", "location", DAY("closes_at").alias("closes"), F.round("salary_min", 2).alias("salary_min"), "salary_period")


def boards(spark: SparkSession, d: str) -> DataFrame:
    n = F.col(KEY)
    title = F.when(n % 4 == 0, "Intern, ops").otherwise("Clerk").alias("title")
    posted = F.when(n % 3 != 0, F.date_format("day", "yyyy-MM-dd"))
    green = L.board(payloads(spark, d, title, URL().alias("absolute_url"), F.struct(F.lit("Rome").alias("name")).alias("location"), posted.alias("first_published"), F.when(n % 2 == 0, F.date_format("day", "yyyy-MM-dd")).alias("updated_at"), F.when(n % 5 == 0, F.date_format("day", "yyyy-MM-dd")).alias("application_deadline")), "greenhouse")
    recruit = L.board(payloads(spark, d, title, URL().alias("careers_url"), F.when(n % 3 == 0, "draft").when(n % 3 == 1, "published").alias("status"), F.lit("internship").alias("employment_type_code"), F.date_format("day", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("published_at")), "recruitee")
    lever = L.lever_board(payloads(spark, d, F.lit("Clerk").alias("text"), URL().alias("hostedUrl"), (F.unix_seconds("day") * 1000).alias("createdAt"), F.struct(F.when(n % 2 == 0, "Intern").otherwise("Full").alias("commitment"), F.lit("Rome").alias("location")).alias("categories"),
                                   F.struct(F.col(PRICE).alias("min"), F.lit("EUR").alias("currency"), F.lit("per-year-salary").alias("interval")).alias("salaryRange")))
    parts = F.array(F.struct(F.lit("Equity").alias("compensationType"), F.lit(5.0).alias("minValue"), F.lit("x").alias("interval")), F.struct(F.lit("Salary").alias("compensationType"), F.col(PRICE).alias("minValue"), F.lit("1 YEAR").alias("interval")))
    ashby = L.ashby_board(payloads(spark, d, title, URL().alias("jobUrl"), F.date_format("day", "yyyy-MM-dd").alias("publishedAt"), F.lit("Intern").alias("employmentType"), F.when(n % 2 == 0, F.lit(False)).alias("isListed"), parts.alias("components")))
    tenant = L.tenant_board(payloads(spark, d, title, F.concat(F.lit("/j/"), (n % 500).cast("string")).alias("externalPath"), F.lit("Posted 3 Days Ago").alias("postedOn"), F.lit("t1").alias("tenant")), as_of())
    out = None
    for family, rows in (("greenhouse", green), ("recruitee", recruit), ("lever", lever), ("ashby", ashby), ("tenant", tenant)):
        one = shown(rows).select(F.lit(family).alias("family"), "url", "item_type", "day", "closes", "salary_min", "salary_period")
        out = one if out is None else out.unionByName(one)
    return out


def mixed_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of four board families and of a source that nobody reads, in one table."""
    o = views.table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("timestamp"))
    n, day = F.col(KEY), F.date_format("day", "yyyy-MM-dd")
    title = F.when(n % 4 == 0, "Intern, ops").otherwise("Clerk")
    green = F.struct(F.array(F.struct(title.alias("title"), URL().alias("absolute_url"), F.struct(F.lit("Rome").alias("name")).alias("location"), F.when(n % 3 != 0, day).alias("first_published"), F.when(n % 2 == 0, day).alias("updated_at"), F.when(n % 6 == 0, day).alias("application_deadline"))).alias("jobs"))
    recruit = F.struct(F.array(F.struct(title.alias("title"), URL().alias("careers_url"), F.when(n % 3 == 0, "draft").when(n % 3 == 1, "published").alias("status"), F.lit("internship").alias("employment_type_code"), F.date_format("day", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("published_at"))).alias("offers"))
    work = F.array(F.struct(title.alias("title"), URL().alias("url"), F.lit("Oslo").alias("city"), day.alias("published_on"), F.col("o_orderstatus").alias("company")))
    smart = F.struct(title.alias("name"), URL().alias("ref"), F.struct(F.lit("Bern").alias("city")).alias("location"), day.alias("releasedDate"), F.struct(F.lit("Internship").alias("label")).alias("experienceLevel"), F.struct(F.lit("Co").alias("name")).alias("company"))
    k = n % 6
    body = F.when(k == 0, F.to_json(green)).when(k == 1, F.to_json(recruit)).when(k == 2, F.to_json(work)).when(k == 3, F.to_json(smart)).when(k == 4, "{broken").otherwise("{}")
    return o.select(F.concat(F.lit("s"), k.cast("string")).alias("source"), as_of().alias("fetched_at"), body.alias("payload"))


def source_registry(spark: SparkSession) -> DataFrame:
    families = ["greenhouse", "recruitee", "workable", "smartrecruiters", "workable"]
    return spark.createDataFrame([(f"s{k}", f, k) for k, f in enumerate(families)], "source string, family string, source_rank int")


def dispatched(spark: SparkSession, d: str) -> DataFrame:
    """All families from one scan, by the registry."""
    got = dispatch.dispatch(mixed_payloads(spark, d), source_registry(spark))
    return got.select("source", "family", "source_rank", "title", "item_type", "url", DAY("ts").alias("day"), "location", "company", DAY("closes_at").alias("closes"))


def left_over(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.unrouted(mixed_payloads(spark, d), source_registry(spark))


def continued(spark: SparkSession, d: str) -> DataFrame:
    li = views.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"))
    rows = li.withColumn("company", F.when(F.col("l_linenumber") % 3 == 1, F.col("s").cast("string")).otherwise("↳"))
    return L.continued_rows(rows, "l_orderkey", "l_linenumber", "company").select("l_orderkey", "l_linenumber", "company")


def issues(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("timestamp"))
    return L.latest_issues(o, "day", as_of()).select("o_orderkey", DAY("day").alias("day"))


def registry(spark: SparkSession, d: str) -> DataFrame:
    s = views.table(spark, d, "supplier")
    b = lambda n: s.where(F.col("s_suppkey") % n == 0).select(F.when(F.col("s_nationkey") % 2 == 0, "a").otherwise("b").alias("ats"), F.when(F.col("s_suppkey") % 11 != 0, F.concat(F.lit("S" if n == 2 else "s"), (F.col("s_suppkey") % 40).cast("string"))).alias("slug"), F.concat(F.lit(f"{n}-"), F.col("s_name")).alias("name"))
    skipped = spark.createDataFrame([("a:s4",), ("b:s6",)], "key string")
    return L.board_registry(b(2), b(3), b(5), skipped)


def permissive(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders")
    n = F.col(KEY)
    raw = o.select(URL().alias("url"), F.col("o_orderpriority").alias("title"), F.when(n % 3 == 0, "never").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"), F.when(n % 2 == 0, '["a","b"]').otherwise("[broken").alias("location_tags"))
    return L.read_items(raw).select("url", DAY("ts").alias("day"), F.size("location_tags").alias("tags"))


def rows_out(spark: SparkSession, d: str) -> DataFrame:
    t = views.items(spark, d).select("url", "item_type", F.coalesce("location", F.lit("")).alias("location"), "seen", "company")
    return L.list_rows(t, ["item_type", "location", "seen", "company"])


def prefs(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "customer")
    n = F.col("c_custkey")
    raw = c.select(n.alias("reader_id"), F.when(n % 4 == 0, '{"jobs": false}').when(n % 4 == 1, "{oops").when(n % 4 == 2, '{"news": false, "jobs": true}').alias("prefs"))
    return L.preferences(raw, {"jobs": True, "news": True})


def variants(spark: SparkSession, d: str) -> DataFrame:
    n = F.col(KEY)
    place = F.struct(F.struct(F.lit("Norway").alias("name")).alias("country"), F.when(n % 2 == 0, "Oslo").alias("city"), F.when(n % 3 == 0, "Oslo, Norway").alias("name"))
    return shown(L.variant_board(payloads(spark, d, F.col("o_orderpriority").alias("name"), URL().alias("url"), place.alias("location"), F.when(n % 5 == 0, "Internship").alias("type"), F.date_format("day", "yyyy-MM-dd").alias("published_date"))))


def countries(spark: SparkSession, d: str) -> DataFrame:
    geo = F.when(F.col(KEY) % 2 == 0, "USA,  Canada, UK, Chile").otherwise("Peru")
    return shown(L.country_board(payloads(spark, d, F.col("o_orderpriority").alias("jobTitle"), URL().alias("url"), geo.alias("jobGeo"), F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("pubDate"), F.format_number(F.floor(PRICE), 0).alias("annualSalaryMin"))))


def details(spark: SparkSession, d: str) -> DataFrame:
    n = F.col(KEY)
    body = F.struct(F.concat(F.lit("<p>We do "), n.cast("string"), F.lit("</p><p>And  more</p>")).alias("content"), F.struct(F.lit("<li>one</li><li>two</li>").alias("must")).alias("lists"))
    p = views.table(spark, d, "orders").select(F.when(n % 2 == 0, "a").otherwise("b").alias("source"), URL().alias("url"), F.to_json(body).alias("payload"))
    mapping = spark.createDataFrame([("a", "$.content", "overview", 0), ("a", "$.lists.must", "requirements", 1), ("b", "$.lists.must", "requirements", 0)], "source string, json_path string, section string, place int")
    return L.detail_lines(p, mapping)


def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Orders as entries of a feed per priority, the first 30 of each."""
    n = F.col(KEY)
    e = views.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("source"), n.alias("entry_no"), F.concat(F.lit(" A  title\n"), n.cast("string")).alias("title"), URL().alias("link"), F.when(n % 2 == 0, F.col("o_orderstatus")).alias("summary"),
        F.when(n % 3 == 0, F.lit("body")).alias("content"), F.when(n % 5 != 0, F.col("o_orderdate").cast("timestamp")).alias("published"), F.lit("1999-01-02").cast("timestamp").alias("updated"),
    )
    return shown(L.feed_entries(e, 30))


def page_events(spark: SparkSession, d: str) -> DataFrame:
    """A page per order whose script blob lists its lines as events."""
    no = F.col("l_linenumber")
    event = F.struct(
        no, F.concat(F.lit("Event "), no.cast("string")).alias("name"), F.concat(F.lit("https://x.example/"), F.col("l_orderkey").cast("string"), F.lit("/"), no.cast("string"), F.lit("/"), F.col("l_partkey").cast("string")).alias("url"),
        DAY("l_shipdate").alias("start"), F.when(no % 2 == 0, F.col("l_linestatus")).alias("city"), (no % 3 == 0).alias("offline"),
    )
    lines = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(event)).alias("events"))
    blob = F.to_json(F.struct(F.struct("events").alias("props")))
    html = F.concat(F.lit('<p>x</p><script id="__NEXT_DATA__" type="application/json">'), blob, F.lit("</script>"))
    return shown(L.page_events(lines.select(F.lit("x").alias("source"), html.alias("html"))))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Orders as saved rows; some snapshots cannot be read, some rows are no longer saved."""
    n, at = F.col(KEY), as_of()
    body = F.to_json(F.struct(F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("salary_min")))
    state = views.table(spark, d, "orders").select(n.alias("url"), F.when(n % 4 != 0, at).alias("saved_at"), F.when(n % 2 == 0, at).alias("seen_at"), F.when(n % 5 != 0, body).otherwise("{").alias("snapshot"))
    return L.saved_snapshots(state, "title string, salary_min double").select("url", "seen", "saved", "title", F.round("salary_min", 2).alias("salary_min"))


QUERIES = {
    "land_feed_entries": feed_entries, "land_page_events": page_events, "saved_snapshots": snapshots,
    "land_variants": variants, "land_countries": countries, "detail_lines": details,
    "land_listings": listings, "land_front_page": link_page, "land_hiring_thread": thread, "land_graph_edges": edges, "land_hackathons": contests, "land_remote": remote, "land_boards": boards,
    "dispatch_payloads": dispatched, "unrouted_payloads": left_over, "continued_rows": continued, "latest_issues": issues, "board_registry": registry, "permissive_items": permissive, "list_rows": rows_out, "reader_preferences": prefs,
}

_U = "concat('https://x.example/', CAST(o_orderkey AS VARCHAR))"
_D = "strftime(o_orderdate, '%Y-%m-%d')"


def _row(**c: str) -> str:
    names = ("title", "item_type", "url", "content_text", "day", "location", "company", "closes", "salary_min", "salary_period", "simplify_id")
    return ", ".join(f"{c.get(n, 'NULL')} AS {n}" for n in names)


_I = "CASE WHEN o_orderkey % 4 = 0 THEN 'Internship' ELSE 'Job' END"
_PAY = "CASE WHEN o_totalprice BETWEEN 10000 AND 2000000 THEN round(o_totalprice, 2) END"
_UNIT = "CASE WHEN o_totalprice BETWEEN 10000 AND 2000000 THEN 'year' END"
_NONE = "CAST(NULL AS VARCHAR) AS company, CAST(NULL AS VARCHAR) AS closes, CAST(NULL AS DOUBLE) AS salary_min, CAST(NULL AS VARCHAR) AS salary_period, CAST(NULL AS VARCHAR) AS simplify_id"
ORACLES = {
    "land_feed_entries": f"""SELECT concat('A title ', CAST(o_orderkey AS VARCHAR)) AS title, 'Article' AS item_type, concat('https://x.example/', CAST(o_orderkey AS VARCHAR)) AS url, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN 'body' ELSE '' END AS content_text,
strftime(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate ELSE DATE '1999-01-02' END, '%Y-%m-%d') AS day, CAST(NULL AS VARCHAR) AS location, {_NONE} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 30""",
    "land_page_events": f"""SELECT concat('Event ', CAST(l_linenumber AS VARCHAR)) AS title, 'Event' AS item_type, concat('https://x.example/', CAST(l_orderkey AS VARCHAR), '/', CAST(l_linenumber AS VARCHAR), '/', CAST(l_partkey AS VARCHAR)) AS url, CAST(NULL AS VARCHAR) AS content_text, strftime(l_shipdate, '%Y-%m-%d') AS day,
CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus WHEN l_linenumber % 3 <> 0 THEN 'Online' END AS location, {_NONE} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) WHERE k <= 20""",
    "saved_snapshots": "SELECT o_orderkey AS url, o_orderkey % 2 = 0 AS seen, true AS saved, o_orderpriority AS title, round(o_totalprice, 2) AS salary_min FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0",
    "land_variants": f"SELECT {_row(title='o_orderpriority', item_type='CASE WHEN o_orderkey % 5 = 0 THEN ' + chr(39) + 'Internship' + chr(39) + ' ELSE ' + chr(39) + 'Job' + chr(39) + ' END', url=_U, day=_D, location='CASE WHEN o_orderkey % 6 IN (0, 2, 3, 4) THEN ' + chr(39) + 'Oslo, Norway' + chr(39) + ' ELSE ' + chr(39) + 'Norway' + chr(39) + ' END')} FROM orders",
    "land_countries": f"""SELECT {_row(title='o_orderpriority', item_type=chr(39) + 'Job' + chr(39), url=_U, day=_D, location='CASE WHEN o_orderkey % 2 = 0 THEN ' + chr(39) + 'Canada | USA | UK' + chr(39) + ' ELSE ' + chr(39) + 'Peru' + chr(39) + ' END', salary_min='CASE WHEN o_totalprice >= 10000 THEN floor(o_totalprice) END', salary_period='CASE WHEN o_totalprice >= 10000 THEN ' + chr(39) + 'year' + chr(39) + ' END')} FROM orders""",
    "detail_lines": f"""SELECT {_U} AS url, section, line, text FROM orders, (VALUES (0, 'overview', 0, NULL), (0, 'overview', 1, 'And more'), (0, 'requirements', 10000, 'one'), (0, 'requirements', 10001, 'two'), (1, 'requirements', 0, 'one'), (1, 'requirements', 1, 'two')) v(odd, section, line, t0),
LATERAL (SELECT coalesce(t0, concat('We do ', CAST(o_orderkey AS VARCHAR))) AS text) WHERE o_orderkey % 2 = odd""",
    "land_listings": f"SELECT {_row(title='o_orderpriority', item_type=chr(39) + 'Internship' + chr(39), url=_U, content_text='''concat(o_orderstatus, ' · Summer 2026')''', day=_D, location='''\'Toronto | Paris\'''', company='''CASE WHEN o_orderkey % 5 <> 0 THEN 'Co' END''', simplify_id='CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END')} FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0",
    "land_front_page": f"SELECT {_row(title='o_orderpriority', item_type=chr(39) + 'Article' + chr(39), url='CASE WHEN o_orderkey % 2 = 0 THEN ' + _U + chr(32) + '''ELSE concat('https://news.example.com/item?id=', CAST(o_orderkey AS VARCHAR)) END''', content_text=chr(39) * 2, day=_D)} FROM orders",
    "land_hiring_thread": """WITH p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'Intern' ELSE p_name END AS role FROM part WHERE p_partkey % 4 = 1)
SELECT concat(role, ' at ', p_brand) AS title, CASE WHEN contains(lower(role), 'intern') THEN 'Internship' ELSE 'Job' END AS item_type, concat('https://news.example.com/item?id=', CAST(p_partkey AS VARCHAR)) AS url,
concat(p_brand, ' | ', role, CASE WHEN p_partkey % 3 = 0 THEN ' | Full-time' ELSE '' END, CASE WHEN p_partkey % 5 <> 0 THEN ' | Oslo' ELSE '' END, ' | $90k | Remote', chr(10), 'more') AS content_text, '2000-06-01' AS day,
CASE WHEN p_partkey % 5 <> 0 THEN 'Oslo | Remote' ELSE 'Remote' END AS location, p_brand AS company, NULL AS closes, NULL AS salary_min, NULL AS salary_period, NULL AS simplify_id FROM p""",
    "land_graph_edges": f"SELECT {_row(title='o_orderpriority', item_type=chr(39) + 'Article' + chr(39), url=_U, content_text=chr(39) * 2, day=_D)} FROM orders WHERE o_orderkey % 3 <> 0",
    "land_hackathons": f"SELECT {_row(title='o_orderpriority', item_type=chr(39) + 'Event' + chr(39), url=_U, content_text='''CASE WHEN o_orderkey % 2 = 0 THEN 'a, b' ELSE 'a, b · $500' END''', day='''strftime(CAST(concat(strftime(o_orderdate + INTERVAL 40 DAY, '%Y'), strftime(o_orderdate, '-%m-%d')) AS DATE), '%Y-%m-%d')''', location='''\'Online\'''', closes='''strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d')''')} FROM orders",
    "land_remote": f"""WITH p AS (SELECT *, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 100 AS VARCHAR) END, {_U}) AS k, CAST(concat('1', CAST(CAST(floor(o_totalprice / 10) AS BIGINT) AS VARCHAR)) AS DOUBLE) AS m FROM orders),
q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderdate, o_orderkey) AS n FROM p)
SELECT {_U} AS url, 'A | B | C | Remote' AS location, {_D} AS closes, CASE WHEN m BETWEEN 10000 AND 2000000 THEN m END AS salary_min, CASE WHEN m BETWEEN 10000 AND 2000000 THEN 'year' END AS salary_period FROM q WHERE n = 1""",
    "land_boards": f"""SELECT 'greenhouse' AS family, {_U} AS url, {_I} AS item_type, CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 THEN {_D} ELSE '2000-05-02' END AS day, CASE WHEN o_orderkey % 5 = 0 THEN {_D} END AS closes, NULL AS salary_min, NULL AS salary_period FROM orders
UNION ALL SELECT 'recruitee', {_U}, 'Internship', {_D}, NULL, NULL, NULL FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT 'lever', {_U}, CASE WHEN o_orderkey % 2 = 0 THEN 'Internship' ELSE 'Job' END, {_D}, NULL, {_PAY}, {_UNIT} FROM orders
UNION ALL SELECT 'ashby', {_U}, 'Internship', {_D}, NULL, {_PAY}, {_UNIT} FROM orders WHERE o_orderkey % 2 <> 0
UNION ALL SELECT 'tenant', concat('https://t1.example.com/j/', CAST(k AS VARCHAR)), CASE WHEN min(t) = 'Clerk' THEN 'Job' ELSE 'Internship' END, '2000-05-29', NULL, NULL, NULL FROM (SELECT o_orderkey % 500 AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'Intern, ops' ELSE 'Clerk' END AS t FROM orders) GROUP BY k""",
    "unrouted_payloads": "SELECT 's5' AS source, count(*) AS payloads FROM orders WHERE o_orderkey % 6 = 5",
    "dispatch_payloads": f"""WITH o AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'Intern, ops' ELSE 'Clerk' END AS title, {_I} AS kind_, {_U} AS u, {_D} AS dd FROM orders)
SELECT 's0' AS source, 'greenhouse' AS family, 0 AS source_rank, title, kind_ AS item_type, u AS url, CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 THEN dd ELSE '2000-05-02' END AS day, 'Rome' AS location, NULL AS company, dd AS closes FROM o WHERE o_orderkey % 6 = 0
UNION ALL SELECT 's1', 'recruitee', 1, title, 'Internship', u, dd, NULL, NULL, NULL FROM o WHERE o_orderkey % 6 = 1 AND o_orderkey % 3 <> 0
UNION ALL SELECT 's2', 'workable', 2, title, 'Job', u, dd, 'Oslo', o_orderstatus, NULL FROM o WHERE o_orderkey % 6 = 2
UNION ALL SELECT 's3', 'smartrecruiters', 3, title, 'Internship', u, dd, 'Bern', 'Co', NULL FROM o WHERE o_orderkey % 6 = 3""",
    "continued_rows": """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, company FROM (SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_linenumber % 3 = 1 THEN CAST(s AS VARCHAR) END IGNORE NULLS) OVER w AS company, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) WHERE n <= 150""",
    "latest_issues": f"""WITH i AS (SELECT DISTINCT o_orderdate AS d FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-01 12:00:00' ORDER BY d DESC LIMIT 3), k AS (SELECT d FROM i WHERE d >= TIMESTAMP '2000-05-25 12:00:00' OR d = (SELECT max(d) FROM i))
SELECT o_orderkey, {_D} AS day FROM orders WHERE o_orderdate IN (SELECT d FROM k)""",
    "board_registry": """WITH b AS (SELECT n AS r, CASE WHEN s_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS ats, CASE WHEN s_suppkey % 11 <> 0 THEN concat(CASE WHEN n = 2 THEN 'S' ELSE 's' END, CAST(s_suppkey % 40 AS VARCHAR)) END AS slug, concat(CAST(n AS VARCHAR), '-', s_name) AS name
FROM supplier, (VALUES (2), (3), (5)) v(n) WHERE s_suppkey % n = 0), k AS (SELECT *, concat(ats, ':', lower(slug)) AS key, row_number() OVER (PARTITION BY concat(ats, ':', lower(slug)) ORDER BY r, name) AS n FROM b WHERE slug IS NOT NULL)
SELECT ats, slug, name FROM k WHERE n = 1 AND key NOT IN ('a:s4', 'b:s6') UNION ALL SELECT ats, slug, name FROM b WHERE slug IS NULL""",
    "permissive_items": f"SELECT {_U} AS url, CASE WHEN o_orderkey % 3 = 0 THEN '1970-01-01' ELSE {_D} END AS day, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS tags FROM orders",
    "reader_preferences": "SELECT c_custkey AS reader_id, c_custkey % 4 <> 0 AS jobs, c_custkey % 4 <> 2 AS news FROM customer",
}
