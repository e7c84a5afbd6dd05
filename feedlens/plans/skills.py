"""Queries of the skill catalog: demand of whole postings, coverage, labels and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import dictionaries as D
from feedlens.functions import skills as S
from feedlens.operators import skills as K
from feedlens.plans import sqlparts
from feedlens.sources import views

LEAST = 5


def catalog_rows(spark: SparkSession, d: str) -> DataFrame:
    """A catalog of several hundred skills from the words of `benchmark`: every other length asks for word boundaries, each third is ambiguous."""
    words = views.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("skill")).where(F.length("skill") >= LEAST).distinct()
    n = F.length("skill")
    keyword = F.when(n % 2 == 0, F.concat(F.lit(" "), "skill", F.lit(" "))).otherwise(F.col("skill"))
    return words.select(
        F.col("skill").alias("position"), "skill", F.substring("skill", 1, 1).alias("category"), F.array(keyword).alias("keywords"),
        F.when(n % 3 == 0, F.array(F.concat("skill", F.lit("th")))).alias("tight"),
    )


def postings(spark: SparkSession, d: str) -> DataFrame:
    """Documents as postings: the text is requirements, duties, description or the scraped line; the language is a tag."""
    docs, n = views.table(spark, d, "documents"), F.col("doc_id") % 4
    return docs.select(
        F.col("doc_id").alias("url"), F.col("source").alias("title"), *(F.when(n == k, F.col("text")).alias(c) for k, c in enumerate(("requirements", "responsibilities", "description"))),
        F.when(n == 3, F.col("text")).alias("scraped"), F.array(F.concat("lang", F.lit("-")), F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1))).alias("tags"),
    )


def demanded(spark: SparkSession, d: str) -> DataFrame:
    catalog = K.catalog_from(catalog_rows(spark, d))
    return postings(spark, d).withColumn("demand", K.posting_demand(catalog, *map(F.col, ("title", "requirements", "responsibilities", "description", "scraped", "tags"))))


def posting_demand(spark: SparkSession, d: str) -> DataFrame:
    rows = K.demand_rows(demanded(spark, d), "demand", "url")
    return rows.select("url", "skill", F.round("weight", 4).alias("weight"), "emphasis")


def posting_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each posting by a reader whose skills are those with an e in second place."""
    owned = F.filter(F.transform("demand", lambda s: s["skill"]), lambda s: F.substring(s, 2, 1) == "e")
    got = demanded(spark, d).withColumn("c", K.coverage_of(F.col("demand"), owned))
    return got.select("url", F.round("c.coverage", 4).alias("coverage"), "c.asked", "c.have")


def demand_by_category(spark: SparkSession, d: str) -> DataFrame:
    rows = K.demand_rows(demanded(spark, d), "demand", "url")
    return K.by_category(rows, catalog_rows(spark, d), "url").select("url", "category", F.array_join("skills", ",").alias("skills"))


def label_skills(spark: SparkSession, d: str) -> DataFrame:
    """The part types' words and the names of the shipped catalog in odd spellings, brought to catalog names."""
    names = K.catalog_table(spark, S.default_catalog())
    parts = views.table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("label")).distinct()
    odd = names.select(F.concat(F.upper(F.regexp_replace("skill", "[ .]", "-")), F.lit(" ")).alias("label"))
    return K.canonical_skills(parts.union(odd), names).select("label", "skill", "category")


QUERIES = {"posting_demand": posting_demand, "posting_coverage": posting_coverage, "demand_by_category": demand_by_category, "label_skills": label_skills}

_CUES = [f"WHEN {sqlparts.has_any('low', words)} THEN '{tone}'" for tone, words in (("learn", D.LEARN_CUES), ("nice", D.NICE_CUES), ("must", D.MUST_CUES))]
_DEMAND = f"""cat AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS skill FROM benchmark),
sk AS (SELECT skill, length(skill) % 2 = 0 AS padded, length(skill) % 3 = 0 AS tight FROM cat WHERE length(skill) >= {LEAST}),
po AS (SELECT doc_id AS url, ['title', ['requirements', 'responsibilities', 'description', 'scraped'][doc_id % 4 + 1]] AS fields, [source, text] AS texts, lang, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS tag FROM documents),
l0 AS (SELECT url, unnest(range(1, 3)) AS f, unnest(fields) AS field, unnest(texts) AS body FROM po),
l1 AS (SELECT url, f, field, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM l0),
l2 AS (SELECT url, f, field, line, lower(trim(raw)) AS low FROM l1 WHERE trim(raw) <> ''),
lo AS (SELECT url, sum(strlen(low) + 1) > 400 AS long_ FROM l2 GROUP BY url),
l3 AS (SELECT l2.*, long_, ' ' || regexp_replace(low, '[^a-z0-9+#&]', ' ', 'g') || ' ' AS words FROM l2 JOIN lo USING (url)),
hi AS (SELECT url, f, field, line, skill FROM l3 JOIN sk ON contains(low, skill) WHERE CASE WHEN long_ AND tight THEN contains(low, skill || 'th') WHEN padded THEN contains(words, ' ' || skill || ' ') ELSE true END),
ln AS (SELECT l3.*, CASE {" ".join(_CUES)} WHEN regexp_matches(low, '[0-9].{{0,7}}year') THEN 'must' END AS own, EXISTS (SELECT 1 FROM hi WHERE hi.url = l3.url AND hi.f = l3.f AND hi.line = l3.line) AS has FROM l3),
st AS (SELECT *, CASE WHEN NOT has AND strlen(low) <= 90 THEN CASE WHEN own IN ('nice', 'learn') THEN own WHEN ends_with(low, ':') THEN coalesce(own, 'plain') END END AS sets FROM ln),
sy AS (SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER (PARTITION BY url, f ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'plain') AS sticky FROM st),
tn AS (SELECT url, f, line, CASE WHEN coalesce(own, sticky) = 'must' AND sticky = 'nice' THEN 'nice' ELSE coalesce(own, sticky) END AS tone FROM sy),
na AS (SELECT hi.url, skill, field, tone, row_number() OVER (PARTITION BY hi.url, skill ORDER BY hi.f, hi.line) - 1 AS k FROM hi JOIN tn ON tn.url = hi.url AND tn.f = hi.f AND tn.line = hi.line),
we AS (SELECT url, skill, CASE field WHEN 'requirements' THEN 3.0 WHEN 'responsibilities' THEN 1.6 WHEN 'description' THEN 1.0 ELSE 2.0 END * CASE tone WHEN 'must' THEN 1.5 WHEN 'plain' THEN 1.0 WHEN 'nice' THEN 0.45 ELSE 0.1 END / (1.0 + 0.5 * k) AS w,
  CASE tone WHEN 'must' THEN 0 WHEN 'nice' THEN 1 WHEN 'learn' THEN 2 ELSE CASE WHEN field IN ('responsibilities', 'description') THEN 2 ELSE 0 END END AS e, tone <> 'learn' AS asked FROM na
  UNION ALL SELECT url, skill, 3.0, 0, true FROM po JOIN sk ON sk.skill = CASE WHEN ends_with(tag, 'js') AND length(tag) > 2 THEN tag[:-3] ELSE tag END),
dem AS (SELECT url, skill, sum(w) AS weight, min(e) AS emphasis FROM we GROUP BY url, skill HAVING bool_or(asked))"""


def _labels() -> str:
    rows = ", ".join(f"({k}, {sqlparts.quoted(n)}, {sqlparts.quoted(c)})" for k, (n, c, _) in enumerate(S.default_catalog().skills))
    clean = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9+#]', '', 'g')"
    key = lambda x: f"CASE WHEN length({clean(x)}) > 2 THEN regexp_replace({clean(x)}, 'js$', '') ELSE {clean(x)} END"
    return f"""WITH c(position, skill, category) AS (VALUES {rows}), k AS (SELECT {key("skill")} AS key, arg_min(struct_pack(s := skill, c := category), position) AS found FROM c GROUP BY 1),
l AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS label FROM part UNION ALL SELECT upper(regexp_replace(skill, '[ .]', '-', 'g')) || ' ' FROM c)
SELECT label, found.s AS skill, found.c AS category FROM l LEFT JOIN k ON k.key = nullif({key("label")}, '')"""


ORACLES = {
    "posting_demand": f"WITH {_DEMAND} SELECT url, skill, round(weight, 4) AS weight, emphasis FROM dem",
    "posting_coverage": f"WITH {_DEMAND}, g AS (SELECT url, sum(weight) AS total, sum(weight) FILTER (skill[2] = 'e') AS met, count(*) AS asked, count(*) FILTER (skill[2] = 'e') AS have FROM dem GROUP BY url) "
    "SELECT doc_id AS url, CASE WHEN asked >= 2 THEN round(coalesce(met, 0) / total, 4) END AS coverage, coalesce(asked, 0) AS asked, coalesce(have, 0) AS have FROM documents LEFT JOIN g ON g.url = doc_id",
    "demand_by_category": f"WITH {_DEMAND} SELECT url, skill[1] AS category, string_agg(skill, ',' ORDER BY skill) AS skills FROM dem GROUP BY 1, 2",
    "label_skills": _labels(),
}
