"""Scalar functions on hand-written values with the default dictionaries."""

import pytest
from pyspark.sql import functions as F

from feedlens.functions import dates, pay, places, text
from feedlens.operators import ranking, search


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "tags"),
    [
        ("Toronto, ON | Remote", ["Remote", "Toronto", "Canada"]), ("San Francisco, CA", ["On-site", "San Francisco", "USA"]), ("", []), (None, []),
        ("Hybrid - London", ["Hybrid", "London"]), ("A | B | C", ["On-site", "Global / Multi-region"]), ("Toronto, Canada", ["On-site", "Toronto", "Canada", "USA", "Global / Multi-region"]),
    ],
)
def test_location_tags(spark, raw, tags):
    assert one(spark, places.normalize_location(F.lit(raw).cast("string"))) == tags


@pytest.mark.parametrize(
    ("prose", "want"),
    [
        ("The base salary range is $85,000 - $110,000 per year.", (85000.0, 110000.0, "USD", "year")), ("CAD $32.50 per hour", (32.5, None, "CAD", "hour")),
        ("5,000 employees across 30 countries", None), ("Compensation: $120k", (120000.0, None, "USD", None)), ("salary in Summer 2026", None),
    ],
)
def test_pay_parse(spark, prose, want):
    got = one(spark, pay.pay_parse(F.lit(prose)))
    assert (tuple(got) if got else None) == want


def test_pay_shown(spark):
    assert one(spark, pay.format_pay(F.lit(85000.0), F.lit(110000.0), F.lit("CAD"), F.lit("year"))) == "$85k–$110k/yr CAD"
    assert one(spark, pay.format_pay(F.lit(32.5), F.lit(None).cast("double"), F.lit("GBP"), F.lit("hour"))) == "£32.50/hr"


@pytest.mark.parametrize(("title", "band"), [("Software Engineering Intern", "Intern"), ("Senior Software Engineer Intern", "Intern"), ("VP of Sales", "Lead"), ("Staff Engineer", "Senior"), ("Engineer I ", "Junior"), ("Engineer", None)])
def test_seniority(spark, title, band):
    assert one(spark, text.classify_seniority(F.lit(title))) == band


@pytest.mark.parametrize(("name", "key"), [("Shopify Technologies Inc.", "shopify"), ("Systems Ltd", "systems"), ("Apple, Inc", "apple"), ("Group", "group")])
def test_company_key(spark, name, key):
    assert one(spark, text.company_normalize(F.lit(name))) == key


def test_truncate_words_counts_bytes(spark):
    assert one(spark, text.truncate_words(F.lit("éé éé éé"), 6)) == "éé"
    assert one(spark, text.truncate_words(F.lit("short"), 6)) == "short"
    assert one(spark, text.truncate_words(F.lit("unbroken"), 4)) == "unbr"


@pytest.mark.parametrize(("heading", "section"), [("Experience", "requirements"), ("The Best Experience Company", "overview"), ("What you'll do:", "responsibilities"), ("Benefits", "perks"), ("Nice to have", "requirements")])
def test_section_of(spark, heading, section):
    assert one(spark, text.section_of(F.lit(heading))) == section


def test_dates(spark):
    stamp = lambda c: str(one(spark, c))
    assert stamp(dates.range_open(F.lit("May 19 - Aug 17, 2026"))).startswith("2026-05-19")
    assert stamp(dates.range_close(F.lit("Aug 04 - 31, 2026"))) == "2026-08-31 23:59:00"
    assert stamp(dates.date_or_timestamp(F.lit("2026-11-12"))) == "2026-11-12 23:59:59"


def test_parse_query():
    q = search.parse_query('react -senior "machine learning" company:"acme corp" at:x')
    assert (q.terms, q.phrases, q.excludes, q.companies) == (["react"], ["machine learning"], ["senior"], ["acme corp", "x"])


def test_word_tests(spark):
    assert one(spark, text.has_word_prefix(F.lit("a reactor"), "react")) and not one(spark, text.has_word_prefix(F.lit("overreact"), "react"))
    assert one(spark, text.has_whole(F.lit("use c++ now"), "c++")) and not one(spark, text.has_whole(F.lit("going"), "go"))


def test_diversify_is_a_round_robin(spark):
    rows = [(k, "ab"[k % 2] if k < 8 else "c", float(20 - k)) for k in range(10)]
    df = spark.createDataFrame(rows, "url int, b string, score double")
    got = ranking.diversify_order(df, F.col("b")).orderBy(*ranking.order_by(ranking.ROUND_ROBIN)).select("b", "url").collect()
    assert [r["b"] for r in got[:6]] == ["a", "b", "c", "a", "b", "c"] and sorted(r["url"] for r in got) == list(range(10))


def test_urgency_is_monotone_and_recency_symmetric(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    at = lambda h: now + F.make_dt_interval(hours=F.lit(h))
    u = [one(spark, ranking.urgency(at(h), now)) for h in (-1, 1, 72, 100, 400, 24 * 46)]
    assert u[0] == -1 and u[1] == u[2] == 1 and u[2] > u[3] > u[4] > u[5] == 0
    assert one(spark, ranking.recency(at(30), now, 6.0)) == one(spark, ranking.recency(at(-30), now, 6.0))


def test_nearest_rank_is_exact(spark):
    values = [float(v) / 7 for v in range(101)]
    got = ranking.nearest_rank(spark.createDataFrame([("k", v) for v in values], "g string, v0 double"), ["g"], "v0", {"p50": 0.5, "p90": 0.9}).first()
    assert (got["p50"], got["p90"]) == (values[50], values[90])


def test_the_last_at_is_found_from_the_left(spark):
    """two words "at" in a row share a blank; only the first of them splits, as in SQL."""
    title = F.lit("Ones the at at enly it")
    assert one(spark, text.company_from_title(title)) == "at enly it"
    assert tuple(one(spark, text.split_title(title, F.lit("Job")))) == ("Ones the", "at enly it")
    assert one(spark, text.company_of(F.lit(None).cast("string"), title, F.lit("Job"))) == "at enly it"
    assert one(spark, text.company_from_title(F.lit("A at B at C"))) == "C"


def test_equal_sums_of_weights_are_equal_doubles(spark):
    """F2: 5 + 8 + 5.6 - 6 and 4 + 5 + 8 - 6 + 1.6 are both 12.6, so they tie."""
    found = [one(spark, ranking.fixed_sum([F.lit(x) for x in terms])) for terms in ((5.0, 8.0, 5.6, -6.0), (4.0, 5.0, 8.0, 1.6, -6.0))]
    assert found == [12.6, 12.6]
    assert [one(spark, ranking.places(F.lit(x), 4)) for x in (1.00005, -1.00005, 0.0)] == [round(1.00005 * 10000) / 10000, -round(1.00005 * 10000) / 10000, 0.0]


def test_the_feed_is_cut_by_the_score_as_shown(spark):
    """seconds that look equal are cut by the best of their bucket, and the position follows the whole score."""
    rows = [("a1", "A", 9.0), ("a2", "A", 3.00001), ("b1", "B", 8.0), ("b2", "B", 3.00002)]
    ranked = spark.createDataFrame(rows, "url string, company string, score double").withColumn("source_platform", F.lit(None).cast("string"))
    assert {r["url"]: r["position"] for r in ranking.feed(ranked, 3).collect()} == {"a1": 1, "b1": 2, "b2": 3}
    assert {r["url"]: r["position"] for r in ranking.feed(ranked, 3, digits=4).collect()} == {"a1": 1, "b1": 2, "a2": 4}
