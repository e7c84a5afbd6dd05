"""Queries of the text mining jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import dictionaries as D
from feedlens.operators import textmine as M
from feedlens.plans import sqlparts as S
from feedlens.sources import views

#: The roles of a conversation as fields of a posting.
FIELDS = {"user": (3.0, 0), "tool": (1.0, 2), "system": (1.0, 2), "assistant": (1.0, 2)}
STOPS = ["the", "and", "for", "that", "this", "with"]


def demand(spark: SparkSession, d: str) -> DataFrame:
    got = M.demand(views.lines(spark, d), S.SKILLS, FIELDS, cues=(S.LEARN, S.NICE, S.MUST))
    return got.select("url", "skill", F.round("weight", 4).alias("weight"), "emphasis")


def demand_tight(spark: SparkSession, d: str) -> DataFrame:
    """With tags, and tighter keywords of s2 in long texts."""
    tags = views.table(spark, d, "conversations").select(F.col("conv_id").alias("url")).distinct().where("url % 5 = 0").withColumn("skill", F.lit("s1"))
    got = M.demand(views.lines(spark, d), S.SKILLS, FIELDS, tags=tags, cues=(S.LEARN, S.NICE, S.MUST), tight=[("s2", ["enth"])])
    return got.select("url", "skill", F.round("weight", 4).alias("weight"), "emphasis")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    got = M.weighted_coverage(M.demand(views.lines(spark, d), S.SKILLS, FIELDS, cues=(S.LEARN, S.NICE, S.MUST)), F.array(F.lit("s1"), F.lit("s2")))
    return got.select("url", F.round("coverage", 4).alias("coverage"), "asked", "have")


def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Document lines as blocks: a third are bullets, and some end in a colon and name a section."""
    lines = views.table(spark, d, "documents").select(F.col("doc_id").alias("url"), F.posexplode(F.split("text", "\n")).alias("line", "text")).where("text <> ''")
    n = F.col("url") + F.col("line")
    head = F.when(n % 7 == 0, "Requirements:").when(n % 7 == 3, "What we offer:").when(n % 11 == 5, "Your duties")
    return lines.select("url", "line", F.coalesce(head, F.col("text")).alias("text"), (head.isNotNull() & head.endswith(":")).alias("heading"), (head.isNull() & (n % 3 == 0)).alias("bullet"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    return M.sections(line_blocks(spark, d).withColumn("heading", F.coalesce("heading", F.lit(False)))).groupBy("url", "section").agg(
        F.count(F.lit(1)).alias("n"), F.min("line").alias("first"), F.max("line").alias("last")
    )


def plain_sections(spark: SparkSession, d: str) -> DataFrame:
    blocks = M.text_blocks(views.table(spark, d, "documents"), "doc_id", "text")
    return M.sections(blocks).groupBy("url", "section").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations")
    return c.groupBy(F.col("conv_id").alias("url"), F.col("role").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("text"))


def focus(spark: SparkSession, d: str) -> DataFrame:
    got = M.focus(parts(spark, d), {"user": 3.0, "assistant": 1.0}, STOPS)
    return got.select("url", "term", F.round("weight", 4).alias("weight"))


def echo(spark: SparkSession, d: str) -> DataFrame:
    foc = M.focus(parts(spark, d), {"user": 3.0, "assistant": 1.0}, STOPS)
    c = views.table(spark, d, "conversations").where("role = 'user'")
    got = M.echo(c.select(F.col("turn").alias("id"), F.col("conv_id").alias("url"), "text"), foc, STOPS)
    return got.select("id", "url", F.round("echo", 4).alias("echo"), "shared")


QUERIES = {"skill_demand": demand, "skill_demand_tight": demand_tight, "demand_coverage": coverage, "sections": sections, "plain_sections": plain_sections, "focus_terms": focus, "focus_echo": echo}

_LINES = "l AS (SELECT conv_id AS url, role AS field, turn * 10000 + p - 1 AS line, text FROM (SELECT conv_id, role, turn, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM conversations))"
_E = "[^a-z0-9+#&]"
_S1 = f"regexp_matches(low, '(^|{_E})of({_E}|$)')"
_S3 = f"(regexp_matches(low, '(^|{_E})in({_E}|$)') OR contains(low, 'tion'))"


def _demand_sql(s2: str, tags: bool) -> str:
    more = " UNION ALL SELECT DISTINCT conv_id, 's1', 3.0, 0, true FROM conversations WHERE conv_id % 5 = 0" if tags else ""
    return f"""{_LINES}, a AS (SELECT *, lower(text) AS low, sum(strlen(text) + 1) OVER (PARTITION BY url) > 400 AS long_ FROM l),
b AS (SELECT *, {_S1} AS s1, {s2} AS s2, {_S3} AS s3, CASE WHEN contains(low, 'was') THEN 'learn' WHEN contains(low, 'with') THEN 'nice' WHEN contains(low, 'for') THEN 'must' WHEN regexp_matches(low, '[0-9].{{0,7}}year') THEN 'must' END AS own FROM a),
c AS (SELECT *, NOT (s1 OR s2 OR s3) AS none_, CASE WHEN NOT (s1 OR s2 OR s3) AND strlen(text) <= 90 THEN CASE WHEN own IN ('nice', 'learn') THEN own WHEN ends_with(text, ':') THEN coalesce(own, 'plain') END END AS sets FROM b),
d AS (SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER (PARTITION BY url, field ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'plain') AS sticky FROM c),
e AS (SELECT *, CASE WHEN coalesce(own, sticky) = 'must' AND sticky = 'nice' THEN 'nice' ELSE coalesce(own, sticky) END AS tone FROM d WHERE NOT none_),
n AS (SELECT url, field, line, tone, 's1' AS skill FROM e WHERE s1 UNION ALL SELECT url, field, line, tone, 's2' FROM e WHERE s2 UNION ALL SELECT url, field, line, tone, 's3' FROM e WHERE s3),
k AS (SELECT *, row_number() OVER (PARTITION BY url, skill ORDER BY field DESC, line) - 1 AS k FROM n),
w AS (SELECT url, skill, CASE field WHEN 'user' THEN 3.0 ELSE 1.0 END * CASE tone WHEN 'must' THEN 1.5 WHEN 'plain' THEN 1.0 WHEN 'nice' THEN 0.45 ELSE 0.1 END / (1.0 + 0.5 * k) AS w,
 CASE tone WHEN 'must' THEN 0 WHEN 'nice' THEN 1 WHEN 'learn' THEN 2 ELSE CASE field WHEN 'user' THEN 0 ELSE 2 END END AS e, tone <> 'learn' AS asked FROM k{more}),
dem AS (SELECT url, skill, sum(w) AS weight, min(e) AS emphasis FROM w GROUP BY url, skill HAVING bool_or(asked))"""


_STOPS = ", ".join(f"'{s}'" for s in STOPS)
_ROOT = """CASE WHEN ends_with(w, 'ing') AND length(w) >= 7 THEN regexp_replace(w[:-4], '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy|zz)$', '') || CASE WHEN regexp_matches(w[:-4], '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy|zz)$') THEN w[-4] ELSE '' END
WHEN ends_with(w, 'ed') AND length(w) >= 6 THEN regexp_replace(w[:-3], '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy|zz)$', '') || CASE WHEN regexp_matches(w[:-3], '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy|zz)$') THEN w[-3] ELSE '' END
WHEN ends_with(w, 'ly') AND length(w) >= 6 THEN regexp_replace(w[:-3], '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy|zz)$', '') || CASE WHEN regexp_matches(w[:-3], '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy|zz)$') THEN w[-3] ELSE '' END
WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND NOT ends_with(w, 'us') THEN CASE WHEN length(w) >= 5 AND regexp_matches(w[:-2], '^.{2,}[sxzh]e$') THEN w[:-3] ELSE w[:-2] END ELSE w END"""


def _terms_sql(source: str) -> str:
    """source: relation with g (group columns as one struct) and text."""
    return f"""t0 AS (SELECT g, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)([^a-z0-9]*)')) AS pair, generate_subscripts(regexp_extract_all(lower(text), '([a-z0-9]+)([^a-z0-9]*)'), 1) AS pos FROM {source}),
t1 AS (SELECT g, pos, regexp_extract(pair, '^[a-z0-9]+') AS w, regexp_extract(pair, '[^a-z0-9]*$') AS gap FROM t0), t2 AS (SELECT *, {_ROOT} AS root FROM t1),
t3 AS (SELECT *, CASE WHEN length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({_STOPS}) AND length(root) >= 3 AND root NOT IN ({_STOPS}) THEN root END AS stem FROM t2),
t4 AS (SELECT *, CASE WHEN NOT regexp_matches(gap, '[.,;:!?\\n()|]') THEN lead(stem) OVER (PARTITION BY g ORDER BY pos) END AS nxt FROM t3), t5 AS (SELECT * FROM t4 WHERE stem IS NOT NULL)"""


_FOCUS = f"""parts AS (SELECT struct_pack(url := conv_id, part := role) AS g, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id, role), {_terms_sql("parts")},
c AS (SELECT g, term, sum(n) AS n FROM (SELECT g, stem AS term, 1 AS n FROM t5 UNION ALL SELECT g, concat(stem, ' ', nxt), 2 FROM t5 WHERE nxt IS NOT NULL) GROUP BY g, term),
r AS (SELECT g.url AS url, term, round(sum(CASE g.part WHEN 'user' THEN 3.0 WHEN 'assistant' THEN 1.0 END * (1 + ln(n))), 9) AS raw FROM c WHERE g.part IN ('user', 'assistant') GROUP BY 1, 2),
f AS (SELECT url, term, raw / max(raw) OVER (PARTITION BY url) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY raw DESC, term) AS k FROM r) WHERE k <= 400)"""


def _section(h: str) -> str:
    low = f"lower(trim(regexp_replace(trim({h}), ':+$', '')))"
    return "CASE " + " ".join(f"WHEN {S.has_any(low, ws)} THEN '{n}'" for n, ws in D.SECTION_PHRASES) + " ELSE 'overview' END"


_SECTIONS = f"""o AS (SELECT *, heading OR (NOT bullet AND strlen(text) <= 90 AND NOT regexp_matches(text, '[.!?]$') AND coalesce(lead(bullet) OVER (PARTITION BY url ORDER BY line), false)) AS opens FROM b),
p AS (SELECT *, coalesce(last_value(CASE WHEN opens THEN {_section("text")} END IGNORE NULLS) OVER (PARTITION BY url ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'overview') AS section FROM o),
q AS (SELECT *, row_number() OVER (PARTITION BY url, section, text ORDER BY line) AS copy_ FROM p WHERE (NOT opens OR section = 'overview') AND text <> ''),
z AS (SELECT *, row_number() OVER (PARTITION BY url, section ORDER BY line) AS n_ FROM q WHERE copy_ = 1)"""
_RAW = "l AS (SELECT doc_id AS url, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"
ORACLES = {
    "skill_demand": f"WITH {_demand_sql("contains(low, 'ent')", False)} SELECT url, skill, round(weight, 4) AS weight, emphasis FROM dem",
    "skill_demand_tight": f"WITH {_demand_sql("CASE WHEN long_ THEN contains(low, 'enth') ELSE contains(low, 'ent') END", True)} SELECT url, skill, round(weight, 4) AS weight, emphasis FROM dem",
    "demand_coverage": f"WITH {_demand_sql("contains(low, 'ent')", False)} SELECT url, CASE WHEN count(*) >= 2 THEN round(sum(CASE WHEN skill IN ('s1', 's2') THEN weight ELSE 0 END) / sum(weight), 4) END AS coverage, count(*) AS asked, count(*) FILTER (skill IN ('s1', 's2')) AS have FROM dem GROUP BY url",
    "sections": f"""WITH {_RAW}, h AS (SELECT url, line, text, CASE WHEN (url + line) % 7 = 0 THEN 'Requirements:' WHEN (url + line) % 7 = 3 THEN 'What we offer:' WHEN (url + line) % 11 = 5 THEN 'Your duties' END AS head FROM l WHERE text <> ''),
b AS (SELECT url, line, coalesce(head, text) AS text, coalesce(ends_with(head, ':'), false) AS heading, head IS NULL AND (url + line) % 3 = 0 AS bullet FROM h), {_SECTIONS}
SELECT url, section, count(*) AS n, min(line) AS first, max(line) AS last FROM z WHERE n_ <= 120 GROUP BY url, section""",
    "plain_sections": f"""WITH {_RAW}, b0 AS (SELECT url, line, trim(regexp_replace(regexp_replace(text, '^\\s*[-*•]\\s+', ''), '\\s+', ' ', 'g')) AS text, regexp_matches(text, '^\\s*[-*•]\\s+') AS bullet FROM l),
b AS (SELECT *, NOT bullet AND ends_with(text, ':') AND strlen(text) <= 90 AS heading FROM b0 WHERE text <> ''), {_SECTIONS}
SELECT url, section, count(*) AS n, sum(length(text)) AS chars FROM z WHERE n_ <= 120 GROUP BY url, section""",
    "focus_terms": f"WITH {_FOCUS} SELECT url, term, round(weight, 4) AS weight FROM f",
    "focus_echo": f"""WITH {_FOCUS}, {_terms_sql("texts").replace("t0", "u0").replace("t1", "u1").replace("t2", "u2").replace("t3", "u3").replace("t4", "u4").replace("t5", "u5").replace("FROM texts", "FROM (SELECT struct_pack(id := turn, url := conv_id) AS g, text FROM conversations WHERE role = 'user')")},
own AS (SELECT DISTINCT g, term FROM (SELECT g, stem AS term FROM u5 UNION ALL SELECT g, concat(stem, ' ', nxt) FROM u5 WHERE nxt IS NOT NULL))
SELECT own.g.id AS id, own.g.url AS url, round(sum(f.weight), 4) AS echo, count(*) AS shared FROM own JOIN f ON f.url = own.g.url AND f.term = own.term GROUP BY 1, 2""",
}
