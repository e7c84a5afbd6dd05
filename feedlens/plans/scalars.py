"""Queries of the scalar functions, over the item view and text synthesised from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import dates, pay, places, text
from feedlens.plans import sqlparts as S
from feedlens.sources import views



def as_of() -> Column:
    return F.lit(S.AS_OF).cast("timestamp")


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def text_shapes(spark: SparkSession, d: str) -> DataFrame:
    t = views.items(spark, d)
    low = F.lower("title")
    return t.select(
        "url", text.collapse_ws(F.col("content_text")).alias("collapsed"), text.truncate_words(F.col("content_text"), 60).alias("cut"),
        text.title_key(F.col("title")).alias("title_key"), text.has_word_prefix(low, "th").alias("prefix_th"), text.has_whole(low, "the").alias("whole_the"),
        text.wants_years(F.concat(F.col("doc_id").cast("string"), F.lit(" year"))).alias("years"),
    )


def companies(spark: SparkSession, d: str) -> DataFrame:
    t = views.items(spark, d)
    title = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Role at desk at "), F.coalesce("company", F.lit("")))).otherwise(F.col("title"))
    name = F.concat(F.coalesce("company", F.lit("Systems")), F.when(F.col("doc_id") % 3 == 0, " Technologies, Inc.").when(F.col("doc_id") % 3 == 1, " LTD").otherwise(" Works"))
    rows = t.withColumn("t2", title).withColumn("name", name)
    split = text.split_title(F.col("t2"), F.col("item_type"))
    return rows.select(
        "url", text.company_from_title(F.col("t2")).alias("from_title"), split["role"].alias("role"), split["employer"].alias("employer"),
        text.company_of(F.col("company"), F.col("t2"), F.col("item_type")).alias("company_of"), text.company_normalize(F.col("name")).alias("normalized"),
    )


def classes(spark: SparkSession, d: str) -> DataFrame:
    t = views.items(spark, d)
    level = text.classify_seniority(F.col("title"), S.BANDS)
    return t.select(
        "url", level.alias("seniority"), text.level_of(level, F.col("item_type")).alias("level"), text.level_with_words(F.col("title"), ["of", "and"], S.BANDS).alias("with_words"),
        text.includes_phrase(F.col("title"), ["the", "of"], ["and"]).alias("included"), text.worth_storing(F.col("item_type"), level, F.col("title"), ["that", " in "]).alias("worth"),
        text.matches_specialty(F.lower("content_text"), "th-e").alias("other_specialty"), text.tone_of(F.lower("title"), S.LEARN, S.NICE, S.MUST).alias("tone"),
    )


def urls(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "pages")
    board = text.board_in_url(F.col("url"), {"example.net": "net", "example.org": "org"}, ("en",))
    return p.select(
        "page_id", text.canonical_url(F.col("url")).alias("canonical"), text.url_host(F.col("url")).alias("host"), board["ats"].alias("ats"), board["slug"].alias("slug"),
        text.pretty_slug(F.translate(text.url_host(F.col("url")), ".", "-")).alias("pretty"),
    )


def locations(spark: SparkSession, d: str) -> DataFrame:
    t = views.items(spark, d)
    return t.select(
        "url", places.clean_location(F.col("location")).alias("clean"), F.array_join(places.normalize_location(F.col("location")), ";").alias("tags"),
        places.location_label(F.col("source_platform"), F.lit(" "), F.col("company")).alias("label"),
        F.array_join(text.tags_for(F.col("location"), places.normalize_location(F.col("location")), F.lit("A"), F.col("title"), F.lit("Summer 2026")), ";").alias("short"),
    )


def pays(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders")
    n, price = F.col("o_orderkey"), F.col("o_totalprice")
    whole = F.floor(price / 4).cast("long")
    prose = F.concat(
        F.when(n % 4 == 0, "The salary is $").when(n % 4 == 1, "CAD pay range $").when(n % 4 == 2, "Founded ").otherwise("up to £"),
        whole.cast("string"), F.when(n % 3 == 0, F.concat(F.lit(" - $"), (whole + 900).cast("string"))).otherwise(""),
        F.when(n % 5 == 0, " per hour").when(n % 5 == 1, " a month").when(n % 5 == 2, " per year").otherwise(""),
    )
    o = o.withColumn("got", pay.pay_parse(prose))
    got = F.col("got")
    unit = F.when(n % 3 == 0, "Hourly").when(n % 3 == 1, "per month").otherwise("annual")
    o = o.withColumn("parts", pay.pay_from_parts(price - 200_000, price, F.lit("USD"), unit))
    parts = F.col("parts")
    return o.select(
        n.alias("id"), got["min"].alias("min"), got["max"].alias("max"), got["currency"].alias("currency"), got["period"].alias("period"),
        F.round(pay.annual_equivalent(got["min"], got["max"], got["period"]), 4).alias("annual"), pay.format_pay(got["min"], got["max"], got["currency"], got["period"]).alias("shown"),
        F.round(parts["min"], 4).alias("parts_min"), parts["period"].alias("parts_period"), pay.lenient_number(F.concat(F.lit("1,"), whole.cast("string"))).alias("lenient"),
    )


def dates_read(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders")
    day, n = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    later = day + F.expr("INTERVAL '40' DAY")
    span = F.concat(F.date_format(day, "MMM d"), F.lit(" - "), F.date_format(later, "MMM d, yyyy"))
    ago = F.when(n % 5 == 0, "Posted Today").when(n % 5 == 1, "yesterday").when(n % 5 == 2, F.concat("o_custkey", F.lit(" hours ago"))).when(n % 5 == 3, F.concat((n % 12).cast("string"), F.lit(" months ago"))).otherwise("a while ago")
    iso = F.when(n % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:11:12Z")))
    loose = F.when(n % 3 == 0, F.date_format(day, "MMMM d, yyyy")).when(n % 3 == 1, F.concat(F.date_format(day, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return o.select(
        n.alias("id"), stamp(dates.range_open(span)).alias("opens"), stamp(dates.range_close(span)).alias("closes"), stamp(dates.relative_date(ago, as_of())).alias("relative"),
        stamp(dates.date_or_timestamp(iso)).alias("instant"), stamp(dates.lenient_date(loose)).alias("loose"),
        dates.days_left(day, as_of()).alias("days"), F.when(dates.days_left(day, as_of()) <= 21, dates.deadline_label(day, as_of())).alias("label"),
        dates.deadline_soon(day, as_of()).alias("soon"), stamp(dates.event_date(F.when(n % 2 == 0, day), later)).alias("event"), stamp(dates.hour_bucket(as_of())).alias("bucket"),
    )


def skills(spark: SparkSession, d: str) -> DataFrame:
    """Canonical skills and categories by join with a small catalog, over part names."""
    p = views.table(spark, d, "part")
    catalog = spark.createDataFrame([("ring", "Ring", "metal", 1), ("widget", "Widget", "thing", 2), ("gear", "Gear", "metal", 3)], "key string, skill string, category string, at int")
    words = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).withColumn("key", text.skill_key(F.concat("w", F.lit(".js"))))
    got = words.join(F.broadcast(catalog), "key")  # a dictionary of three rows
    return got.groupBy("p_partkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "skill"))), lambda x: x["skill"]), ",").alias("skills"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
    )


def splits(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "part")
    line = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " · ").when(F.col("p_partkey") % 3 == 1, " | ").otherwise(", "), "p_brand", F.lit(", x"))
    return p.select("p_partkey", F.array_join(text.list_items(line), "/").alias("items"))


QUERIES = {
    "text_shapes": text_shapes, "company_names": companies, "text_classes": classes, "urls": urls, "locations": locations, "pay_scalars": pays,
    "date_scalars": dates_read, "skill_catalog": skills, "list_lines": splits,
}

_LEVEL = S.first_band("concat(' ', lower(title), ' ')", S.BANDS)
_KEY = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_SUFFIX = "inc|incorporated|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|sa|nv|ag|pbc|lp|llp|group|holdings|technologies|technology|labs|software|systems"
_FROM = "CASE WHEN contains(t2, ' at ') AND tail <> '' AND strlen(tail) <= 60 THEN tail END"
_FMT = "'%Y-%m-%d %H:%M:%S'"


def _money(v: str) -> str:
    return f"CASE WHEN {v} >= 10000 THEN concat(CAST(CAST(round({v} / 1000) AS BIGINT) AS VARCHAR), 'k') WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', {v}) END"


_PERIOD = """CASE WHEN contains({0}, 'hour') OR {0} = 'hr' OR contains({0}, '/h') THEN 'hour' WHEN contains({0}, 'day') OR contains({0}, 'daily') OR contains({0}, 'diem') THEN 'day'
WHEN contains({0}, 'week') THEN 'week' WHEN contains({0}, 'mo') THEN 'month' WHEN contains({0}, 'year') OR contains({0}, 'annual') OR contains({0}, 'annum') OR contains({0}, 'yr') THEN 'year' END"""

ORACLES = {
    "text_shapes": f"""WITH {S.ITEMS} SELECT url, trim(regexp_replace(content_text, '\\s+', ' ', 'g')) AS collapsed,
CASE WHEN strlen(content_text) <= 60 THEN content_text ELSE (WITH RECURSIVE f(n) AS (SELECT 60 UNION ALL SELECT n - 1 FROM f WHERE strlen(substr(content_text, 1, n)) > 60),
  h AS (SELECT substr(content_text, 1, (SELECT min(n) FROM f)) AS s) SELECT CASE WHEN regexp_matches(s, '\\s') THEN regexp_replace(s, '\\s+\\S*$', '') ELSE s END FROM h) END AS cut,
{_KEY.format("title")} AS title_key, regexp_matches(lower(title), '(^|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}])th') AS prefix_th,
regexp_matches(lower(title), '(^|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}])the([^a-z0-9\\x{{80}}-\\x{{10FFFF}}]|$)') AS whole_the, true AS years FROM items""",
    "company_names": f"""WITH {S.ITEMS}, a AS (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN concat('Role at desk at ', coalesce(company, '')) ELSE title END AS t2,
concat(coalesce(company, 'Systems'), CASE doc_id % 3 WHEN 0 THEN ' Technologies, Inc.' WHEN 1 THEN ' LTD' ELSE ' Works' END) AS name FROM items),
b AS (SELECT *, regexp_extract(t2, '(?s)^(.*) at (.*?)$', 1) AS head, CASE WHEN contains(t2, ' at ') THEN list_extract(string_split(t2, ' at '), -1) END AS last, opp AS o2 FROM (SELECT *, item_type IN ('Job', 'Internship') AS opp FROM a)),
c AS (SELECT *, trim(last) AS tail, opp AND last IS NOT NULL AND length(t2) - length(last) - 4 > 0 AS splits FROM b)
SELECT url, {_FROM} AS from_title, CASE WHEN splits THEN substr(t2, 1, length(t2) - length(last) - 4) ELSE t2 END AS role, CASE WHEN splits THEN last END AS employer,
coalesce(nullif(trim(company), ''), CASE WHEN splits THEN last END) AS company_of, regexp_replace({_KEY.format("name")}, '^(\\S+(?: \\S+)*?)(?: (?:{_SUFFIX}))+$', '\\1') AS normalized FROM c""",
    "text_classes": f"""WITH {S.ITEMS}, a AS (SELECT *, {_LEVEL} AS seniority, concat(' ', {_KEY.format("title")}, ' ') AS spaced FROM items)
SELECT url, seniority, coalesce(seniority, CASE WHEN item_type = 'Internship' THEN 'Intern' END) AS level,
coalesce(seniority, CASE WHEN {S.has_any("spaced", [" of ", " and "])} THEN 'Intern' END) AS with_words, {S.has_any("spaced", [" the ", " of "])} AND NOT {S.has_any("spaced", [" and "])} AS included,
item_type NOT IN ('Job', 'Internship') OR item_type = 'Internship' OR coalesce(seniority IN ('Intern', 'New grad', 'Junior'), false) OR {S.has_any("concat(' ', lower(title), ' ')", ["that", " in "])} AS worth,
contains(lower(content_text), 'th-e') OR contains(lower(content_text), 'th e') AS other_specialty,
CASE WHEN contains(lower(title), 'was') THEN 'learn' WHEN contains(lower(title), 'with') THEN 'nice' WHEN contains(lower(title), 'for') THEN 'must' WHEN regexp_matches(lower(title), '[0-9].{{0,7}}year') THEN 'must' END AS tone FROM a""",
    "urls": """WITH a AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host, string_split(regexp_replace(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1), '^/', ''), '/')[1] AS slug FROM pages),
b AS (SELECT *, CASE WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'net' WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'org' END AS ats FROM a),
c AS (SELECT *, ats IS NOT NULL AND regexp_matches(slug, '^[A-Za-z0-9._-]+$') AND lower(slug) NOT IN ('en') AS good FROM b)
SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(?i);jsessionid=.*$', '') AS canonical, nullif(host, '') AS host, CASE WHEN good THEN ats END AS ats, CASE WHEN good THEN slug END AS slug,
array_to_string(list_transform(string_split(replace(replace(host, '.', ' '), '-', ' '), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') AS pretty FROM c""",
    "locations": f"""WITH {S.ITEMS} SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(location, '(?i)</?\\s*br\\s*/?>', ' | ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^[\\s|]+|[\\s|]+$', '', 'g') AS clean,
array_to_string({S.tags()}, ';') AS tags, concat(source_platform, CASE WHEN company IS NOT NULL THEN concat(', ', company) ELSE '' END) AS label,
array_to_string(list_filter([CASE WHEN coalesce(location, '') <> '' THEN substr(trim(string_split(location, '|')[1]), 1, 28) END, CASE WHEN contains(lower(location), 'remote') THEN 'Remote' WHEN contains(lower(location), 'hybrid') THEN 'Hybrid' END, 'A',
CASE WHEN regexp_matches(title, '(?i)(Summer|Fall|Winter|Spring)\\s*20\\d\\d') THEN regexp_extract(title, '(?i)(Summer|Fall|Winter|Spring)\\s*20\\d\\d') ELSE 'Summer 2026' END], lambda x: x IS NOT NULL)[1:3], ';') AS short FROM items""",
    "pay_scalars": f"""WITH a AS (SELECT o_orderkey AS id, o_totalprice AS price, CAST(floor(o_totalprice / 4) AS BIGINT) AS w FROM orders),
b AS (SELECT *, CASE WHEN id % 4 <> 2 OR id % 3 = 0 OR id % 5 IN (0, 2) THEN true ELSE false END AS speaks,
 CASE WHEN id % 4 <> 2 THEN CAST(w AS DOUBLE) WHEN id % 3 = 0 THEN CAST(w + 900 AS DOUBLE) END AS first,
 CASE WHEN id % 4 <> 2 AND id % 3 = 0 THEN CAST(w + 900 AS DOUBLE) END AS second, CASE id % 5 WHEN 0 THEN 'hour' WHEN 1 THEN 'month' WHEN 2 THEN 'year' END AS unit,
 CASE id % 4 WHEN 1 THEN 'CAD' WHEN 0 THEN 'USD' WHEN 3 THEN 'GBP' ELSE CASE WHEN id % 3 = 0 THEN 'USD' END END AS code FROM a),
c AS (SELECT *, {S.annual("first", "second", "unit")} AS yr FROM b), d AS (SELECT *, speaks AND first IS NOT NULL AND yr IS NOT NULL AS fine FROM c),
e AS (SELECT *, CASE WHEN price - 200000 > 0 THEN price - 200000 END AS lo, CASE id % 3 WHEN 0 THEN 'hour' WHEN 1 THEN 'month' ELSE 'year' END AS u2 FROM d),
f AS (SELECT *, ({S.annual("lo", "price", "u2")}) IS NOT NULL AS ok2 FROM e)
SELECT id, CASE WHEN fine THEN first END AS min, CASE WHEN fine THEN second END AS max, CASE WHEN fine THEN code END AS currency, CASE WHEN fine THEN unit END AS period, CASE WHEN fine THEN round(yr, 4) END AS annual,
CASE WHEN fine THEN concat(CASE code WHEN 'GBP' THEN '£' ELSE '$' END, {_money("first")}, CASE WHEN second IS NOT NULL AND second <> first THEN concat('–', CASE code WHEN 'GBP' THEN '£' ELSE '$' END, {_money("second")}) ELSE '' END,
 CASE unit WHEN 'hour' THEN '/hr' WHEN 'month' THEN '/mo' WHEN 'year' THEN '/yr' ELSE '' END, CASE WHEN code = 'CAD' THEN ' CAD' ELSE '' END) END AS shown,
CASE WHEN ok2 THEN round(lo, 4) END AS parts_min, CASE WHEN ok2 THEN u2 END AS parts_period, CAST(concat('1', CAST(w AS VARCHAR)) AS DOUBLE) AS lenient FROM f""",
    "date_scalars": f"""WITH a AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate AS day, o_orderdate + INTERVAL 40 DAY AS later FROM orders),
b AS (SELECT *, CAST(strptime(concat(strftime(day, '%b %-d'), ', ', strftime(later, '%Y')), '%b %-d, %Y') AS TIMESTAMP) AS opens,
 CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN 24 WHEN 2 THEN c WHEN 3 THEN (id % 12) * 720 ELSE 720 END AS back, CAST(floor(epoch_us(day) / 86400000000.0 - epoch_us({S.NOW}) / 86400000000.0 + 0.5) AS INT) AS days FROM a)
SELECT id, strftime(opens, {_FMT}) AS opens, strftime(date_trunc('day', later) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE, {_FMT}) AS closes, strftime({S.NOW} - to_hours(back), {_FMT}) AS relative,
CASE WHEN id % 2 = 0 THEN strftime(date_trunc('day', day) + INTERVAL 86399 SECOND, {_FMT}) ELSE concat(strftime(day, '%Y-%m-%d'), ' 10:11:12') END AS instant,
strftime(CASE WHEN id % 3 = 1 THEN day ELSE date_trunc('day', day) + INTERVAL 12 HOUR END, {_FMT}) AS loose, days,
CASE WHEN days < 0 THEN 'Closed' WHEN days = 0 THEN 'Closes today' WHEN days = 1 THEN 'Closes tomorrow' WHEN days <= 21 THEN concat('Closes in ', CAST(days AS VARCHAR), ' days') END AS label,
days BETWEEN 0 AND 3 AS soon, strftime(CASE WHEN id % 2 = 0 THEN day ELSE later END, {_FMT}) AS event, '1998-06-01 12:00:00' AS bucket FROM b""",
    "skill_catalog": """WITH c AS (SELECT * FROM (VALUES ('ring', 'Ring', 'metal', 1), ('widget', 'Widget', 'thing', 2), ('gear', 'Gear', 'metal', 3)) t(key, skill, category, at_)),
w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS key FROM part)
SELECT p_partkey, string_agg(skill, ',' ORDER BY at_) AS skills, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories FROM w JOIN c USING (key) GROUP BY p_partkey""",
    "list_lines": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_name, '/', p_brand, ', x') WHEN 1 THEN concat(p_name, '/', p_brand, ', x') ELSE concat(p_name, '/', p_brand, '/x') END AS items FROM part""",
}
