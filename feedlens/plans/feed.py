"""Queries of the ranked feed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import pay
from feedlens.operators import ranking as R
from feedlens.operators import readers as N
from feedlens.plans import sqlparts as S
from feedlens.sources import views
from feedlens.sources.results import Results
from feedlens.sources.shared import shared_folder, stored

PROFILE = R.Profile(major="A", interests=("X", "Y", "Z"), home_region="Canada", levels=("Intern",))


def as_of() -> Column:
    return F.lit(S.AS_OF).cast("timestamp")


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"Company {k}", k % 4 + 1) for k in range(20)], "company string, tier int")


def derived(spark: SparkSession, d: str) -> DataFrame:
    return R.derive(views.items(spark, d), PROFILE, S.MAJORS, S.INTERESTS, S.BANDS, tiers(spark))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """The text is dropped as soon as it is classified, once; bars and scores read the narrow rows."""
    return R.personalize(stored(derived(spark, d).drop("content_text"), "derived"), PROFILE, as_of())


def feed_top400(spark: SparkSession, d: str) -> DataFrame:
    top = R.feed(ranked(spark, d), 400, digits=4)
    return top.select("position", "url", R.places(F.col("score"), 4).alias("score"), R.places(F.col("merit"), 4).alias("merit"), "last_call")


def classified(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d).select(
        "url", "discipline", "seniority", F.array_join("matched_interests", ",").alias("interests"),
        F.array_join("location_tags", ",").alias("location_tags"), "company_tier",
    )


def pass_one(spark: SparkSession, d: str) -> DataFrame:
    got = R.pass_one(derived(spark, d), PROFILE, as_of())
    total = F.aggregate("breakdown", F.lit(0.0), lambda a, t: a + t["points"])
    return got.select("url", F.round("merit", 4).alias("merit"), F.round("score", 4).alias("score"), F.round(total, 4).alias("explained"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    got = R.measure_bars(R.pass_one(derived(spark, d), PROFILE, as_of()))
    return got.select("kind", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def pass_two(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).select("url", F.round("score", 4).alias("score"), "last_call")


def rescored(spark: SparkSession, d: str) -> DataFrame:
    """A single posting's score under given bars equals its score in the list."""
    given = spark.createDataFrame([("opportunity", 9.0, 13.0), ("event", 6.0, 12.0)], "kind string, lo double, hi double")
    got = R.personalize(derived(spark, d), PROFILE, as_of(), bars=given)
    return got.select("url", F.round("score", 4).alias("score"), "last_call")


def diversified(spark: SparkSession, d: str) -> DataFrame:
    orders = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_custkey").alias("bucket"), F.col("o_totalprice").alias("score"))
    got = R.diversify_order(orders, F.col("bucket"))
    return got.select("url", F.col("_round").alias("round"), F.col("_top").alias("top"), F.col("_first").alias("first"))


def roles(spark: SparkSession, d: str) -> DataFrame:
    got = R.diversify_order(ranked(spark, d), F.coalesce("company", "source_platform"))
    return got.where(R.is_opportunity(F.col("item_type"))).select("url", F.col("_round").alias("round"), R.places(F.col("score"), 4).alias("score"))


def last_calls(spark: SparkSession, d: str) -> DataFrame:
    got = ranked(spark, d).where("last_call").orderBy("closes_at", F.desc("merit"), "url").limit(24)
    return got.select("url", F.date_format("closes_at", "yyyy-MM-dd").alias("closes"), F.round("merit", 4).alias("merit"))


def capped(spark: SparkSession, d: str) -> DataFrame:
    return R.cap_opportunities(derived(spark, d), PROFILE, 100).select("url", "item_type")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """The single terms: recency, urgency, pay and level."""
    year = pay.annual_equivalent(F.col("salary_min"), F.col("salary_max"), F.col("salary_period"))
    return derived(spark, d).select(
        "url", F.round(R.recency(F.col("ts"), as_of(), 6.0), 4).alias("recency"), F.round(R.urgency(F.col("closes_at"), as_of()), 4).alias("urgency"),
        F.round(pay.pay_score(year), 4).alias("pay_score"), R.seniority_fit(F.col("seniority"), R.strings(["Intern"])).alias("level_fit"), F.round(R.fit(PROFILE), 4).alias("fit"),
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Best ten listings of each distinct reader profile (segment and home).

    A profile adds points for its home and for one interest, so all its readers share one of few tastes (home, interest). The
    listings are thinned to the best ten of each employer and kind of listing (tags and interests) first, as no other can be
    among ten; these meet the tastes by what they match, and the tastes meet the profiles by an equi-join.
    """
    homes = F.when(F.col("c_nationkey") % 2 == 0, F.lit("Canada")).otherwise(F.lit("USA"))
    segment = F.col("c_mktsegment")
    liked = F.when(segment < "C", "X").when(segment < "H", "Y").otherwise("Z")
    readers = views.table(spark, d, "customer").select(segment.alias("segment"), homes.alias("home"), liked.alias("liked")).distinct()
    base = derived(spark, d).select("url", F.coalesce("company", "source_platform").alias("bucket"), "location_tags", "matched_interests", F.round(R.fit(PROFILE), 6).alias("base"))
    thin = R.keep_per_group(base, ["bucket", "location_tags", "matched_interests"], [F.desc("base"), F.asc("url")], 10)
    tastes = readers.groupBy("home", "liked").agg(F.lit(1).alias("one"))
    options = F.array(*(F.struct(F.lit(h).alias("home"), F.lit(x).alias("liked")) for h in ("Canada", "USA") for x in PROFILE.interests))
    met = thin.withColumn("taste", F.explode(options)).select("*", "taste.home", "taste.liked").join(tastes, ["home", "liked"])
    score = F.col("base") + F.when(F.array_contains("location_tags", F.col("home")), 2.0).otherwise(0.0) + F.when(F.array_contains("matched_interests", F.col("liked")), 1.0).otherwise(0.0)
    mixed = R.diversify_order(met.withColumn("score", score), F.col("bucket"), by=["home", "liked"])
    top = R.keep_per_group(mixed.where("_round <= 10"), ["home", "liked"], R.order_by(R.ROUND_ROBIN), 10)
    return top.join(readers, ["home", "liked"]).select(F.concat_ws("/", "segment", "home").alias("reader_id"), "url", F.round("score", 4).alias("score"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a reader: major, interests by the bits of the key, home by nation, and a wanted level for the even ones."""
    n, nation = F.col("c_custkey"), F.col("c_nationkey") % 4
    some = F.array_compact(F.array(*(F.when(n.bitwiseAND(1 << k) != 0, F.lit(x)) for k, x in enumerate(("X", "Y", "Z")))))
    return views.table(spark, d, "customer").select(
        n.alias("reader_id"), F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").alias("major"), some.alias("interests"),
        F.when(nation == 0, "Canada").when(nation == 1, "USA").when(nation == 2, "Toronto").alias("home"), F.when(n % 2 == 0, F.array(F.lit("Intern"))).alias("levels"),
    )


def readers_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten best listings of every customer."""
    return N.top_of_readers(derived(spark, d), customers(spark, d), as_of()).select("reader_id", "rank", "url", F.round("score", 4).alias("score"))


def feed_reused(spark: SparkSession, d: str) -> DataFrame:
    """The ranked rows, stored under (generation, profile, hour) and read a second time without ranking."""
    results = Results(spark, shared_folder(spark, "results"))
    now = datetime.fromisoformat(S.AS_OF)
    rank = lambda at: R.personalize(stored(derived(spark, d).drop("content_text"), "derived"), PROFILE, F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")).drop("breakdown")
    results.read("feed", 0, PROFILE, now, rank)

    def again(_: datetime) -> DataFrame:
        raise RuntimeError("the stored result was not taken")

    return results.read("feed", 0, PROFILE, now, again).select("url", F.round("score", 4).alias("score"), "last_call")


QUERIES = {
    "feed_reused": feed_reused,
    "readers_top": readers_top,
    "feed_top400": feed_top400, "feed_classified": classified, "feed_pass_one": pass_one, "feed_quality_bars": bars,
    "feed_pass_two": pass_two, "feed_rescored": rescored, "diversify_orders": diversified, "feed_roles": roles,
    "feed_last_calls": last_calls, "cap_opportunities": capped, "score_terms": scores, "reader_profiles": profiles,
}

_ORDER = "round_, score DESC, top_ DESC, first_"
ORACLES = {
    "feed_reused": f"WITH {S.RANKED} SELECT url, round(score, 4) AS score, last_call FROM ranked",
    "readers_top": f"""WITH {S.PASS_ONE}, st AS (SELECT url, opp, discipline, seniority, matched_interests, location_tags, round(score1 - CASE WHEN discipline = 'A' THEN 4.0 ELSE 0.0 END - least(len(matched_interests) * 4.0, 8.0)
  - CASE WHEN opp THEN 6.0 * CASE WHEN seniority IS NULL THEN 0.0 WHEN seniority = 'Intern' THEN 1.0 ELSE -1.0 END ELSE 0.0 END - CASE WHEN list_contains(location_tags, 'Canada') THEN 3.0 ELSE 0.0 END, 6) AS static FROM two),
rd AS (SELECT c_custkey AS reader_id, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS major, list_filter([CASE WHEN c_custkey & 1 <> 0 THEN 'X' END, CASE WHEN c_custkey & 2 <> 0 THEN 'Y' END, CASE WHEN c_custkey & 4 <> 0 THEN 'Z' END], lambda x: x IS NOT NULL) AS interests,
  CASE c_nationkey % 4 WHEN 0 THEN 'Canada' WHEN 1 THEN 'USA' WHEN 2 THEN 'Toronto' END AS home, c_custkey % 2 = 0 AS intern FROM customer),
sc AS (SELECT reader_id, url, round(static + CASE WHEN discipline = major THEN 4.0 ELSE 0.0 END + least(len(list_intersect(matched_interests, interests)) * 4.0, 8.0) + CASE WHEN list_contains(location_tags, home) THEN 3.0 ELSE 0.0 END
  + CASE WHEN opp AND intern THEN 6.0 * CASE WHEN seniority IS NULL THEN 0.0 WHEN seniority = 'Intern' THEN 1.0 ELSE -1.0 END ELSE 0.0 END, 6) AS score FROM st, rd)
SELECT reader_id, CAST(rank AS INT) AS rank, url, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY score DESC, url) AS rank FROM sc) WHERE rank <= 10""",
    "feed_top400": f"WITH {S.RANKED} SELECT row_number() OVER (ORDER BY {_ORDER}) AS position, url, round(score, 4) AS score, round(merit, 4) AS merit, last_call FROM mixed ORDER BY {_ORDER} LIMIT 400",
    "feed_classified": f"WITH {S.DERIVED} SELECT url, discipline, seniority, array_to_string(matched_interests, ',') AS interests, array_to_string(location_tags, ',') AS location_tags, CAST(company_tier AS INT) AS company_tier FROM derived",
    "feed_pass_one": f"WITH {S.PASS_ONE} SELECT url, round(merit, 4) AS merit, round(score1, 4) AS score, round(score1, 4) AS explained FROM two",
    "feed_quality_bars": f"WITH {S.PASS_ONE} SELECT kind, round(lo, 4) AS lo, round(hi, 4) AS hi FROM bars",
    "feed_pass_two": f"WITH {S.RANKED} SELECT url, round(score, 4) AS score, last_call FROM ranked",
    "feed_rescored": f"""WITH {S.PASS_ONE.replace("greatest(f.lo, coalesce(m.p50, f.lo)) AS lo", "f.lo AS lo").replace("greatest(greatest(f.hi, coalesce(m.p90, f.hi)), greatest(f.lo, coalesce(m.p50, f.lo)) + 1.0) AS hi", "f.hi AS hi")},
ranked AS (SELECT t.*, score1 + CASE WHEN t.kind IS NOT NULL AND days >= 0 THEN 8.0 * urgency * greatest(0.0, least(1.0, (merit - lo) / (hi - lo))) ELSE 0.0 END AS score,
  coalesce(t.kind IS NOT NULL AND days >= 0 AND merit >= hi AND days <= 7, false) AS last_call FROM two t LEFT JOIN bars b ON b.kind = t.kind)
SELECT url, round(score, 4) AS score, last_call FROM ranked""",
    "diversify_orders": """SELECT o_orderkey AS url, row_number() OVER w AS round, first_value(o_totalprice) OVER w AS top, first_value(o_orderkey) OVER w AS first
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""",
    "feed_roles": f"WITH {S.RANKED} SELECT url, round_ AS round, round(score, 4) AS score FROM mixed WHERE opp",
    "feed_last_calls": f"WITH {S.RANKED} SELECT url, strftime(closes_at, '%Y-%m-%d') AS closes, round(merit, 4) AS merit FROM ranked WHERE last_call ORDER BY closes_at, merit DESC, url LIMIT 24",
    "cap_opportunities": f"""WITH {S.PASS_ONE}, fits AS (SELECT *, merit - CASE WHEN opp THEN 4.0 * coalesce(greatest(0.0, least(1.0, ({S.annual()} - 60000.0) / 140000.0)), 0.0) ELSE 0.0 END AS fit FROM two),
kept AS (SELECT url FROM fits WHERE opp ORDER BY round(fit, 6) DESC, ts DESC, url LIMIT 100)
SELECT url, item_type FROM fits WHERE NOT opp OR url IN (SELECT url FROM kept)""",
    "score_terms": f"""WITH {S.PASS_ONE} SELECT url, round(6.0 * pow(0.5, abs({S.minutes(S.NOW, "ts")}) / 60.0 / 48.0), 4) AS recency, round(urgency, 4) AS urgency,
round(coalesce(greatest(0.0, least(1.0, ({S.annual()} - 60000.0) / 140000.0)), 0.0), 4) AS pay_score, CASE WHEN seniority IS NULL THEN 0.0 WHEN seniority = 'Intern' THEN 1.0 ELSE -1.0 END AS level_fit,
round(merit - CASE WHEN opp THEN 4.0 * coalesce(greatest(0.0, least(1.0, ({S.annual()} - 60000.0) / 140000.0)), 0.0) ELSE 0.0 END, 4) AS fit FROM two""",
    "reader_profiles": f"""WITH {S.PASS_ONE}, readers AS (SELECT DISTINCT c_mktsegment AS segment, CASE WHEN c_nationkey % 2 = 0 THEN 'Canada' ELSE 'USA' END AS home FROM customer),
base AS (SELECT *, merit - CASE WHEN opp THEN 4.0 * coalesce(greatest(0.0, least(1.0, ({S.annual()} - 60000.0) / 140000.0)), 0.0) ELSE 0.0 END AS fit FROM two),
scored AS (SELECT concat(segment, '/', home) AS reader_id, url, coalesce(company, source_platform) AS bucket,
  round(fit, 6) + CASE WHEN list_contains(location_tags, home) THEN 2.0 ELSE 0.0 END
  + CASE WHEN list_contains(matched_interests, CASE WHEN segment < 'C' THEN 'X' WHEN segment < 'H' THEN 'Y' ELSE 'Z' END) THEN 1.0 ELSE 0.0 END AS score FROM base, readers),
mixed2 AS (SELECT *, row_number() OVER w AS r, first_value(score) OVER w AS t, first_value(url) OVER w AS f FROM scored WINDOW w AS (PARTITION BY reader_id, bucket ORDER BY score DESC, url))
SELECT reader_id, url, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY r, score DESC, t DESC, f) AS k FROM mixed2) WHERE k <= 10""",
}
