"""Landed payloads to rows of the listing schema.

A payload table has (source, fetched_at, payload). Each source declares its schema; reading is permissive and missing
fields are null. Fetching itself is outside of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feedlens.functions import dates, pay
from feedlens.functions.text import collapse_ws

FIELDS = {
    "title": "string", "item_type": "string", "url": "string", "content_text": "string", "ts": "timestamp", "location": "string", "company": "string", "simplify_id": "string",
    "closes_at": "timestamp", "salary_min": "double", "salary_max": "double", "salary_currency": "string", "salary_period": "string",
}


def listing(rows: DataFrame, **columns: Column) -> DataFrame:
    """The listing schema; fields without a column are null."""
    return rows.select("source", *(columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()))


def parsed(payloads: DataFrame, schema: str) -> DataFrame:
    """source, fetched_at and the fields of a JSON payload, read permissively; an array payload gives a row per element."""
    read = F.from_json("payload", schema, {"mode": "PERMISSIVE"})
    rows = payloads.select("source", "fetched_at", (F.explode(read) if schema.startswith("array") else read).alias("p"))
    return rows.select("source", "fetched_at", "p.*")


def _join(parts: Column, sign: str) -> Column:
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(kept, sign)


def kind(is_intern: Column) -> Column:
    return F.when(F.coalesce(is_intern, F.lit(False)), "Internship").otherwise("Job")


def listings_json(payloads: DataFrame) -> DataFrame:
    """Community lists: only active and visible rows with a url; places joined by pipes."""
    p = parsed(payloads, "array<struct<id string, origin string, title string, company_name string, url string, category string, locations array<string>, terms array<string>, active boolean, is_visible boolean, date_posted bigint>>")
    p = p.where(F.col("active") & F.col("is_visible") & (F.coalesce("url", F.lit("")) != ""))
    company = F.when(F.lower("company_name") != "unknown", F.col("company_name"))
    return listing(p, title=F.col("title"), item_type=F.lit("Internship"), url=F.col("url"), content_text=F.concat_ws(" · ", "category", _join(F.col("terms"), ", ")), ts=F.timestamp_seconds("date_posted"), location=_join(F.col("locations"), " | "), company=company, simplify_id=F.when(F.col("origin") == "Simplify", F.col("id")))


def front_page(payloads: DataFrame) -> DataFrame:
    """Link aggregators: the url falls back to the discussion."""
    p = parsed(payloads, "struct<id bigint, title string, url string, time bigint, text string>")
    url = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://news.example.com/item?id="), F.col("id").cast("string")))
    return listing(p, title=F.col("title"), item_type=F.lit("Article"), url=url, content_text=F.coalesce("text", F.lit("")), ts=F.timestamp_seconds("time"))


def hiring_thread(comments: DataFrame, story: Column) -> DataFrame:
    """Direct replies whose first line reads "Company | Role | Place | Terms": three parts or more, company at most 60 and
    role at most 100 bytes. Terms of employment and amounts are dropped, the first two that remain are the place."""
    first = F.get(F.split("text", "\n"), F.lit(0))
    parts = F.filter(F.transform(F.split(first, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    rows = comments.where(F.col("parent_id") == story).withColumn("parts", parts)
    rows = rows.where((F.size("parts") >= 3) & (F.octet_length(F.col("parts")[0]) <= 60) & (F.octet_length(F.col("parts")[1]) <= 100))
    dropped = r"(?i)^(full[- ]?time|part[- ]?time|contract|intern(ship)?s?|visa.*|\$.*)$"
    place = F.slice(F.filter(F.slice("parts", F.lit(3), F.size("parts")), lambda x: ~x.rlike(dropped)), 1, 2)
    role = F.col("parts")[1]
    return listing(
        rows, title=F.concat_ws(" at ", role, F.col("parts")[0]), item_type=kind(F.lower(role).contains("intern")), url=F.concat(F.lit("https://news.example.com/item?id="), F.col("id").cast("string")),
        content_text=F.col("text"), ts=F.col("ts"), location=F.nullif(F.array_join(place, " | "), F.lit("")), company=F.col("parts")[0],
    )


def feed_entries(entries: DataFrame, most: int) -> DataFrame:
    """Entries of feeds (source, entry_no, title, link, summary, content, published, updated): the first `most` of each."""
    n = F.row_number().over(W.partitionBy("source").orderBy("entry_no"))
    rows = entries.withColumn("_n", n).where(F.col("_n") <= most)
    return listing(rows, title=collapse_ws(F.col("title")), item_type=F.lit("Article"), url=F.col("link"), content_text=F.coalesce("summary", "content", F.lit("")), ts=F.coalesce("published", "updated"))


def graph_edges(payloads: DataFrame) -> DataFrame:
    """GraphQL edges: rows without title or permalink are dropped."""
    p = parsed(payloads, "struct<data struct<page struct<edges array<struct<node struct<title string, permalink string, summary string, createdAt string>>>>>>")
    rows = p.select("source", "fetched_at", F.explode("data.page.edges").alias("e")).select("source", "fetched_at", "e.node.*").where(F.col("title").isNotNull() & F.col("permalink").isNotNull())
    return listing(rows, title=F.col("title"), item_type=F.lit("Article"), url=F.col("permalink"), content_text=F.coalesce("summary", F.lit("")), ts=F.coalesce(dates.date_or_timestamp(F.col("createdAt")), "fetched_at"))


def page_events(pages: DataFrame, pointer: str = "$.props.events", most: int = 20) -> DataFrame:
    """Events in the JSON script blob of a page: the first `most`; without a place that is offline they are online."""
    blob = F.regexp_extract("html", r"(?s)<script id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>", 1)
    events = F.from_json(F.get_json_object(blob, pointer), "array<struct<name string, url string, start string, city string, offline boolean>>")
    rows = pages.select("source", F.explode(F.slice(events, 1, most)).alias("e")).select("source", "e.*")
    place = F.when(F.coalesce("offline", F.lit(False)), F.col("city")).otherwise(F.coalesce("city", F.lit("Online")))
    return listing(rows, title=F.col("name"), item_type=F.lit("Event"), url=F.col("url"), ts=dates.date_or_timestamp(F.col("start")), location=place)


def hackathons(payloads: DataFrame) -> DataFrame:
    """Contests: a date range gives start and deadline, prizes lose their markup, empty prizes are dropped."""
    p = parsed(payloads, "struct<title string, url string, period string, place string, prize string, themes array<string>>")
    prize = F.regexp_replace(F.col("prize"), "<[^>]+>", "")
    said = F.concat_ws(" · ", _join(F.col("themes"), ", "), F.when(~prize.rlike(r"^\$?0+$"), prize))
    return listing(p, title=F.col("title"), item_type=F.lit("Event"), url=F.col("url"), content_text=said, ts=F.coalesce(dates.range_open(F.col("period")), "fetched_at"), closes_at=dates.range_close(F.col("period")), location=F.col("place"))


def remote_search(payloads: DataFrame) -> DataFrame:
    """Remote boards: one row per guid or link, at most three places and the word Remote, epoch expiry."""
    p = parsed(payloads, "struct<guid string, link string, title string, company string, places array<string>, min string, max string, currency string, unit string, posted bigint, expiry bigint>")
    p = p.withColumn("key", F.coalesce("guid", "link")).where("key IS NOT NULL")
    p = p.withColumn("_n", F.row_number().over(W.partitionBy("source", "key").orderBy("posted", "link"))).where("_n = 1")
    got = pay.pay_from_parts(pay.lenient_number(F.col("min")), pay.lenient_number(F.col("max")), F.col("currency"), F.col("unit"))
    p = p.withColumn("pay", got)
    return listing(
        p, title=F.col("title"), item_type=F.lit("Job"), url=F.col("link"), ts=F.timestamp_seconds("posted"), closes_at=F.timestamp_seconds("expiry"), company=F.col("company"),
        location=F.concat_ws(" | ", _join(F.slice("places", 1, 3), " | "), F.lit("Remote")), salary_min=F.col("pay.min"), salary_max=F.col("pay.max"), salary_currency=F.col("pay.currency"), salary_period=F.col("pay.period"),
    )


#: Employer boards that differ by field names only: JSON fields of title, url, location, posted (as text), deadline, intern hint.
BOARDS = {
    "greenhouse": ("struct<title string, absolute_url string, location struct<name string>, first_published string, updated_at string, application_deadline string, company_name string>", "title", "absolute_url", "location.name", ("first_published", "updated_at"), "application_deadline", "title", "company_name"),
    "recruitee": ("struct<title string, careers_url string, location string, published_at string, close_at string, status string, employment_type_code string, company_name string>", "title", "careers_url", "location", ("published_at",), "close_at", "employment_type_code", "company_name"),
    "workable": ("struct<title string, url string, city string, published_on string, employment_type string, company string>", "title", "url", "city", ("published_on",), None, "employment_type", "company"),
    "smartrecruiters": ("struct<name string, ref string, location struct<city string, country string, remote boolean>, releasedDate string, experienceLevel struct<label string>, company struct<name string>>", "name", "ref", "location.city", ("releasedDate",), None, "experienceLevel.label", "company.name"),
}


def board(payloads: DataFrame, family: str) -> DataFrame:
    """One employer board family; without a date a posting counts as thirty days old."""
    schema, title, url, place, posted, deadline, hint, company = BOARDS[family]
    p = parsed(payloads, schema)
    if family == "recruitee":
        p = p.where(F.col("status").isNull() | (F.col("status") == "published"))
    when = F.coalesce(*(dates.lenient_date(F.col(c)) for c in posted), *(dates.date_or_timestamp(F.col(c)) for c in posted), F.col("fetched_at") - F.expr("INTERVAL '30' DAY"))
    closes = dates.date_or_timestamp(F.col(deadline)) if deadline else F.lit(None)
    return listing(p, title=F.col(title), item_type=kind(F.lower(F.col(hint)).contains("intern")), url=F.col(url), ts=when, location=F.col(place), company=F.col(company), closes_at=closes)


def lever_board(payloads: DataFrame) -> DataFrame:
    """A board with millisecond dates, a commitment that may say intern and a salary range in parts."""
    p = parsed(payloads, "struct<text string, hostedUrl string, createdAt bigint, categories struct<commitment string, location string>, salaryRange struct<min double, max double, currency string, interval string>, company string>")
    p = p.withColumn("pay", pay.pay_from_parts(F.col("salaryRange.min"), F.col("salaryRange.max"), F.col("salaryRange.currency"), F.col("salaryRange.interval")))
    return listing(
        p, title=F.col("text"), item_type=kind(F.lower("categories.commitment").contains("intern")), url=F.col("hostedUrl"), ts=F.timestamp_millis("createdAt"), location=F.col("categories.location"), company=F.col("company"),
        salary_min=F.col("pay.min"), salary_max=F.col("pay.max"), salary_currency=F.col("pay.currency"), salary_period=F.col("pay.period"),
    )


def ashby_board(payloads: DataFrame) -> DataFrame:
    """A board that may unlist postings; pay is the first compensation component of type Salary."""
    p = parsed(payloads, "struct<title string, jobUrl string, location string, publishedAt string, employmentType string, isListed boolean, components array<struct<compensationType string, minValue double, maxValue double, currencyCode string, interval string>>, company string>")
    p = p.where(F.coalesce("isListed", F.lit(True))).withColumn("c", F.get(F.filter("components", lambda c: c["compensationType"] == "Salary"), F.lit(0)))
    p = p.withColumn("pay", pay.pay_from_parts(F.col("c.minValue"), F.col("c.maxValue"), F.col("c.currencyCode"), F.col("c.interval")))
    return listing(
        p, title=F.col("title"), item_type=kind(F.lower("employmentType").contains("intern")), url=F.col("jobUrl"), ts=F.coalesce(dates.date_or_timestamp(F.col("publishedAt")), "fetched_at"), location=F.col("location"), company=F.col("company"),
        salary_min=F.col("pay.min"), salary_max=F.col("pay.max"), salary_currency=F.col("pay.currency"), salary_period=F.col("pay.period"),
    )


def tenant_board(payloads: DataFrame, as_of: Column) -> DataFrame:
    """A board with relative dates; one row per external path within a tenant."""
    p = parsed(payloads, "struct<title string, externalPath string, postedOn string, locationsText string, tenant string>")
    p = p.withColumn("_n", F.row_number().over(W.partitionBy("tenant", "externalPath").orderBy("title"))).where("_n = 1")
    url = F.concat(F.lit("https://"), "tenant", F.lit(".example.com"), "externalPath")
    return listing(p, title=F.col("title"), item_type=kind(F.lower("title").contains("intern")), url=url, ts=dates.relative_date(F.col("postedOn"), as_of), location=F.col("locationsText"), company=F.col("tenant"))


def continued_rows(rows: DataFrame, page: str, row_no: str, company: str, most: int = 150, mark: str = "↳") -> DataFrame:
    """Table rows in which a mark stands for the company of the row above; the first `most` rows of a page."""
    above = W.partitionBy(page).orderBy(row_no)
    filled = F.last(F.when(F.col(company) != mark, F.col(company)), ignorenulls=True).over(above)
    return rows.withColumn(company, filled).withColumn("_n", F.row_number().over(above)).where(F.col("_n") <= most).drop("_n")


def latest_issues(rows: DataFrame, date: str, as_of: Column, most: int = 3, days: int = 7) -> DataFrame:
    """Rows of the newest `most` issues within the last days; without any, those of the newest issue.

    The issue dates are few: they are made distinct first, and only they are ranked.
    """
    issues = rows.select(F.col(date).alias("_d")).where(F.col(date).isNotNull() & (F.col(date) <= as_of)).distinct()
    newest = issues.orderBy(F.desc("_d")).limit(most)
    top = newest.agg(F.max("_d").alias("_top"))
    kept = newest.crossJoin(F.broadcast(top)).where((F.col("_d") >= as_of - F.make_dt_interval(days=F.lit(days))) | (F.col("_d") == F.col("_top")))  # one row
    return rows.join(F.broadcast(kept.select("_d")), F.col(date) == F.col("_d"), "left_semi")


def board_registry(curated: DataFrame, bundled: DataFrame, learned: DataFrame, skipped: DataFrame) -> DataFrame:
    """(ats, slug, name) of three lists, the first wins by ats and lower-cased slug; boards without a slug are all kept;
    skipped keys are left out."""
    both = curated.withColumn("_r", F.lit(0)).unionByName(bundled.withColumn("_r", F.lit(1))).unionByName(learned.withColumn("_r", F.lit(2)))
    key = F.concat_ws(":", "ats", F.lower("slug"))
    keyed = both.where("slug IS NOT NULL").withColumn("key", key)
    best = keyed.groupBy("key").agg(F.min_by(F.struct("ats", "slug", "name"), F.struct("_r", "name")).alias("b"))
    return best.join(skipped.select("key"), "key", "left_anti").select("b.*").unionByName(both.where("slug IS NULL").select("ats", "slug", "name"))


def read_items(raw: DataFrame) -> DataFrame:
    """Stored rows read permissively, newest first: a bad timestamp is the epoch, bad tags are none."""
    ts = F.coalesce(F.col("timestamp").try_cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    tags = F.coalesce(F.from_json("location_tags", "array<string>"), F.array().cast("array<string>"))
    return raw.where("url IS NOT NULL").select("url", "title", ts.alias("ts"), tags.alias("location_tags"))


def list_rows(ranked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON text per row, without null, empty and false fields."""
    kinds = dict(ranked.dtypes)
    blank: dict[str, Callable[[Column], Column]] = {"string": lambda c: F.nullif(c, F.lit("")), "boolean": lambda c: F.when(c, c)}
    slim = [blank.get(kinds[c], lambda x: F.when(F.size(x) > 0, x) if kinds[c].startswith("array") else x)(F.col(c)).alias(c) for c in columns]
    return ranked.select("url", F.to_json(F.struct(*slim), {"ignoreNullFields": "true"}).alias("row"))


def preferences(raw: DataFrame, defaults: dict[str, bool]) -> DataFrame:
    """(reader_id, one boolean per preference): absent or corrupt JSON and missing fields take the default."""
    read = F.from_json("prefs", ", ".join(f"{k} boolean" for k in defaults), {"mode": "PERMISSIVE"})
    return raw.select("reader_id", read.alias("p")).select("reader_id", *(F.coalesce(F.col(f"p.{k}"), F.lit(v)).alias(k) for k, v in defaults.items()))


def saved_snapshots(state: DataFrame, schema: str) -> DataFrame:
    """Snapshots of saved rows that can be read; saved is true and seen comes from the state."""
    rows = state.where("saved_at IS NOT NULL").select("url", "saved_at", F.col("seen_at").isNotNull().alias("seen"), F.from_json("snapshot", schema).alias("s"))
    return rows.where("s.title IS NOT NULL").select("url", "saved_at", "seen", F.lit(True).alias("saved"), "s.*")


def variant_board(payloads: DataFrame) -> DataFrame:
    """A board whose location and type come as an object, a string or null; place parts that another part holds are dropped."""
    get = lambda path: F.get_json_object("payload", path)
    named = lambda f: F.coalesce(get(f"$.{f}.name"), F.when(~F.coalesce(get(f"$.{f}"), F.lit("")).startswith("{"), get(f"$.{f}")))
    parts = F.filter(F.array(named("location"), get("$.location.city"), get("$.location.country.name")), lambda x: x.isNotNull() & (x != ""))
    place = F.aggregate(parts, F.lit(""), lambda a, x: F.when(a.contains(x), a).when(a == "", x).otherwise(F.concat_ws(", ", a, x)))
    return listing(
        payloads, title=get("$.name"), item_type=kind(F.lower(named("type")).contains("intern")), url=get("$.url"), ts=F.coalesce(dates.date_or_timestamp(get("$.published_date")), "fetched_at"),
        location=F.nullif(place, F.lit("")), company=get("$.company.name"),
    )


def country_board(payloads: DataFrame, first: str = "Canada", most: int = 3) -> DataFrame:
    """Remote postings by country: numbers may be strings, the home country moves to the front, at most `most` places."""
    p = parsed(payloads, "struct<jobTitle string, url string, companyName string, jobGeo string, pubDate string, annualSalaryMin string, annualSalaryMax string, salaryCurrency string, jobLevel string>")
    places = F.filter(F.transform(F.split("jobGeo", ","), lambda x: F.trim(x)), lambda x: x != "")
    home = F.when(F.array_contains(places, first), F.array(F.lit(first))).otherwise(F.array().cast("array<string>"))
    place = F.array_join(F.slice(F.concat(home, F.array_remove(places, first)), 1, most), " | ")
    p = p.withColumn("pay", pay.pay_from_parts(pay.lenient_number(F.col("annualSalaryMin")), pay.lenient_number(F.col("annualSalaryMax")), F.col("salaryCurrency"), F.lit("year")))
    return listing(
        p, title=F.col("jobTitle"), item_type=kind(F.lower("jobLevel").contains("intern")), url=F.col("url"), ts=F.coalesce(dates.lenient_date(F.col("pubDate")), "fetched_at"), location=F.nullif(place, F.lit("")), company=F.col("companyName"),
        salary_min=F.col("pay.min"), salary_max=F.col("pay.max"), salary_currency=F.col("pay.currency"), salary_period=F.col("pay.period"),
    )


def detail_lines(payloads: DataFrame, mapping: DataFrame) -> DataFrame:
    """(url, section, line, text): text fields of fetched details. mapping: (source, json_path, section, place) says which
    field of which source's payload opens which section; it is a small table, joined by source."""
    met = payloads.join(F.broadcast(mapping), "source")  # one row per source and field
    body = F.regexp_replace(F.regexp_replace(F.expr("get_json_object(payload, json_path)"), r"(?i)<br\s*/?>|</p>|</li>", "\n"), r"<[^>]+>", "")
    rows = met.select("url", "section", "place", F.posexplode(F.split(body, "\n")).alias("pos", "raw"))
    return rows.select("url", "section", (F.col("place") * 10_000 + F.col("pos")).alias("line"), collapse_ws(F.col("raw")).alias("text")).where("text <> ''")
