"""Pieces of the SQL twins, generated from the same dictionaries that the operators use."""

from __future__ import annotations

from collections.abc import Sequence

AS_OF = "1998-06-01 12:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"

#: Words that occur in the invented text, as dictionaries for the queries.
MAJORS = [("A", ["the", "with"]), ("B", ["that", "from"])]
INTERESTS = [("X", ["license"]), ("Y", [" was "]), ("Z", ["$"])]
BANDS = [("Intern", ["this"]), ("Senior", ["are "])]
SKILLS = [("s1", [" of "]), ("s2", ["ent"]), ("s3", [" in ", "tion"])]
LEARN, NICE, MUST = ["was"], ["with"], ["for"]

ITEMS = """items AS (
SELECT d.doc_id, concat('https://', d.lang, '.example.com/', d.source, '/', CAST(d.doc_id AS VARCHAR)) AS url,
  CASE d.doc_id % 4 WHEN 0 THEN 'Internship' WHEN 1 THEN 'Job' WHEN 2 THEN 'Article' ELSE 'Event' END AS item_type,
  substr(d.text, 1, 80) AS title, d.text AS content_text, d.source AS source_platform,
  CASE WHEN d.doc_id % 7 <> 0 THEN concat('Company ', CAST(d.doc_id % 37 AS VARCHAR)) END AS company,
  o.o_orderdate AS ts, CASE WHEN d.doc_id % 3 = 0 THEN o.o_orderdate + INTERVAL 30 DAY END AS closes_at,
  CASE WHEN l.quality = 1 THEN o.o_totalprice END AS salary_min, CAST(NULL AS DOUBLE) AS salary_max,
  CASE o.o_orderstatus WHEN 'F' THEN 'year' WHEN 'O' THEN 'month' END AS salary_period,
  CASE d.doc_id % 6 WHEN 0 THEN 'Toronto, ON | Remote' WHEN 1 THEN 'San Francisco, CA' WHEN 2 THEN 'London<br>Hybrid'
    WHEN 3 THEN 'Remote' WHEN 4 THEN 'Multiple | New York | Seattle, WA' END AS location,
  d.doc_id % 11 = 0 AS seen, d.doc_id % 13 = 0 AS saved, coalesce(l.toxic = 1, false) AS dismissed
FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id
LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has_any(text: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def count_hits(text: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {quoted(w)}) AS INT)" for w in words) + ")"


def first_band(text: str, bands: Sequence[tuple[str, Sequence[str]]]) -> str:
    return "CASE " + " ".join(f"WHEN {has_any(text, ws)} THEN {quoted(n)}" for n, ws in bands) + " END"


def discipline(text: str, majors: Sequence[tuple[str, Sequence[str]]] = MAJORS) -> str:
    counts = [count_hits(text, ws) for _, ws in majors]
    best = f"greatest({', '.join(counts)})"
    return f"CASE WHEN {best} = 0 THEN 'General' " + " ".join(f"WHEN {c} = {best} THEN {quoted(n)}" for c, (n, _) in zip(counts, majors, strict=True)) + " END"


def annual(low: str = "salary_min", high: str = "salary_max", period: str = "salary_period") -> str:
    value = f"coalesce(({low} + {high}) / 2, {low}, {high})"
    year = f"""{value} * CASE {period} WHEN 'hour' THEN 2080.0 WHEN 'day' THEN 260.0 WHEN 'week' THEN 52.0 WHEN 'month' THEN 12.0 WHEN 'year' THEN 1.0
      ELSE CASE WHEN {value} < 1000 THEN 2080.0 ELSE 1.0 END END"""
    return f"CASE WHEN {year} BETWEEN 10000.0 AND 2000000.0 THEN {year} END"


def minutes(later: str, earlier: str) -> str:
    return f"trunc((epoch_us({later}) - epoch_us({earlier})) / 60000000.0)"


def tags(location: str = "location") -> str:
    """Expression for the list of location tags."""
    from feedlens.functions import dictionaries as D

    low = f"lower({location})"
    parts = [f"CASE WHEN {has_any(low, ws)} THEN {quoted(t)} END" for t, ws in D.MODALITIES]
    parts.append(f"CASE WHEN NOT {has_any(low, [w for _, ws in D.MODALITIES for w in ws])} THEN 'On-site' END")
    parts += [f"CASE WHEN {has_any(low, ws)} THEN {quoted(t)} END" for t, ws in D.CITIES]
    canada, usa = has_any(low, D.CANADA), has_any(low, D.USA)
    several = f"(contains({low}, 'multiple') OR ({canada} AND {usa}) OR length({low}) - length(replace({low}, '|', '')) >= 2)"
    parts += [f"CASE WHEN {canada} THEN 'Canada' END", f"CASE WHEN {usa} THEN 'USA' END", f"CASE WHEN {several} THEN 'Global / Multi-region' END"]
    return f"CASE WHEN coalesce({location}, '') = '' THEN CAST([] AS VARCHAR[]) ELSE list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL) END"


DERIVED = f"""{ITEMS}, derived AS (
SELECT *, {discipline("lower(concat(title, ' ', content_text))")} AS discipline,
  {first_band("concat(' ', lower(title), ' ')", BANDS)} AS seniority, {tags()} AS location_tags,
  list_filter([{", ".join(f"CASE WHEN {has_any("lower(concat(' ', title, ' ', content_text, ' '))", ws)} THEN {quoted(n)} END" for n, ws in INTERESTS)}], lambda x: x IS NOT NULL) AS matched_interests,
  CASE WHEN company IS NOT NULL AND doc_id % 37 < 20 THEN (doc_id % 37) % 4 + 1 END AS company_tier,
  item_type IN ('Job', 'Internship') AS opp
FROM items)"""

PASS_ONE = f"""{DERIVED}, one AS (
SELECT *,
  CASE WHEN discipline = 'A' THEN 4.0 ELSE 0.0 END + CASE WHEN opp THEN 5.0 WHEN item_type = 'Event' THEN 4.0 ELSE 0.0 END
  + least(len(matched_interests) * 4.0, 8.0)
  + 8.0 * CASE company_tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 WHEN 4 THEN 0.2 ELSE 0.0 END
  + CASE WHEN opp THEN 6.0 * CASE WHEN seniority IS NULL THEN 0.0 WHEN seniority = 'Intern' THEN 1.0 ELSE -1.0 END ELSE 0.0 END
  + CASE WHEN list_contains(location_tags, 'Canada') THEN 3.0 ELSE 0.0 END
  + CASE WHEN opp THEN 4.0 * coalesce(greatest(0.0, least(1.0, ({annual()} - 60000.0) / 140000.0)), 0.0) ELSE 0.0 END AS merit,
  {minutes("closes_at", NOW)} / 1440.0 AS days,
  CASE WHEN opp THEN 'opportunity' WHEN item_type = 'Event' THEN 'event' END AS kind
FROM derived), two AS (
SELECT *, merit + 6.0 * pow(0.5, abs({minutes(NOW, "ts")}) / 60.0 / 48.0)
  + CASE WHEN kind IS NOT NULL AND days < 0 THEN -20.0 ELSE 0.0 END + CASE WHEN seen THEN -3.0 ELSE 0.0 END AS score1,
  CASE WHEN days IS NULL THEN 0.0 WHEN days < 0 THEN -1.0 WHEN days <= 3 THEN 1.0 WHEN days > 45 THEN 0.0 ELSE pow(0.5, (days - 3.0) / 7.0) END AS urgency
FROM one), ordered AS (
SELECT kind, merit, row_number() OVER (PARTITION BY kind ORDER BY merit) - 1 AS k_, count(*) OVER (PARTITION BY kind) AS n FROM two WHERE kind IS NOT NULL
), measured AS (
SELECT kind, max(CASE WHEN k_ = round((n - 1) * 0.5) THEN merit END) AS p50, max(CASE WHEN k_ = round((n - 1) * 0.9) THEN merit END) AS p90
FROM ordered GROUP BY kind
), bars AS (
SELECT f.kind, greatest(f.lo, coalesce(m.p50, f.lo)) AS lo,
  greatest(greatest(f.hi, coalesce(m.p90, f.hi)), greatest(f.lo, coalesce(m.p50, f.lo)) + 1.0) AS hi
FROM (VALUES ('opportunity', 9.0, 13.0), ('event', 6.0, 12.0)) f(kind, lo, hi) LEFT JOIN measured m ON m.kind = f.kind)"""

RANKED = f"""{PASS_ONE}, ranked AS (
SELECT t.*, b.lo, b.hi,
  score1 + CASE WHEN t.kind IS NOT NULL AND days >= 0 THEN 8.0 * urgency * greatest(0.0, least(1.0, (merit - lo) / (hi - lo))) ELSE 0.0 END AS score,
  coalesce(t.kind IS NOT NULL AND days >= 0 AND merit >= hi AND days <= 7, false) AS last_call
FROM two t LEFT JOIN bars b ON b.kind = t.kind), mixed AS (
SELECT *, row_number() OVER w AS round_, first_value(score) OVER w AS top_, first_value(url) OVER w AS first_
FROM ranked WINDOW w AS (PARTITION BY coalesce(company, source_platform) ORDER BY score DESC, url))"""
