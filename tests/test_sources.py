"""Readers and normalisers on hand-written payloads."""

import datetime as dt

from pyspark.sql import functions as F

from feedlens.operators import match, pages, textmine
from feedlens.sources import landed


def test_feed_entries_cap_and_fallbacks(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [("s", k, f"T  {k}", f"u{k}", None if k else "sum", "con", None, day) for k in range(4)]
    got = landed.feed_entries(spark.createDataFrame(rows, "source string, entry_no int, title string, link string, summary string, content string, published timestamp, updated timestamp"), 2)
    assert sorted((r["title"], r["content_text"], r["ts"]) for r in got.collect()) == [("T 0", "sum", day), ("T 1", "con", day)]


def test_page_events(spark):
    html = '<html><script id="__NEXT_DATA__" type="x">{"props":{"events":[{"name":"A","url":"u1","start":"2026-05-01"},{"name":"B","url":"u2","city":"Oslo","offline":true}]}}</script></html>'
    got = landed.page_events(spark.createDataFrame([("luma", html)], "source string, html string")).orderBy("url").collect()
    assert [(r["title"], r["location"]) for r in got] == [("A", "Online"), ("B", "Oslo")]


def test_saved_snapshots_drop_what_cannot_be_read(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [("u1", day, None, '{"title": "T", "company": "C"}'), ("u2", day, day, "{broken"), ("u3", None, day, '{"title": "X"}')]
    got = landed.saved_snapshots(spark.createDataFrame(rows, "url string, saved_at timestamp, seen_at timestamp, snapshot string"), "title string, company string").collect()
    assert [(r["url"], r["title"], r["saved"], r["seen"]) for r in got] == [("u1", "T", True, False)]


def test_html_sections_and_detail(spark):
    page = "<h2>About us</h2><p>We make things.</p><p><b>Requirements</b></p><ul><li>Python</li><li>Python</li><li>SQL</li></ul><p><strong>What we offer:</strong></p><ul><li>Tea</li></ul>"
    blocks = pages.html_blocks(spark.createDataFrame([("u", page)], "url string, html string"), "url", "html")
    got = pages.assemble_detail(textmine.sections(blocks)).first()
    assert (got["requirements"], got["perks"], got["status"]) == ("Python\nSQL", "Tea", "ok")
    assert got["description"] == "About us\nWe make things."


def test_embedded_posting_of_odd_pages(spark):
    rows = [(1, None), (2, "<script type='application/ld+json'>not json</script>"), (3, '<script type="application/ld+json">{"@type":"Thing"}</script>')]
    assert pages.embedded_posting(spark.createDataFrame(rows, "id int, html string"), "id", "html").count() == 0


def test_budget_keeps_pinned_and_sole_skills(spark):
    rows = [("u", 1, 1, 0, 0.1, ["s1"], False), ("u", 2, 1, 1, 0.2, [], False), ("u", 3, 2, 2, 0.0, [], True), ("u", 4, 2, 3, 5.0, ["s1"], False), ("u", 5, 2, 4, 0.2, [], False)]
    df = spark.createDataFrame(rows, "url string, bullet int, entry int, pos int, relevance double, covered array<string>, pinned boolean")
    # 5 and 2 cost 0.7 each, the later goes first; then 1 costs 0.6 against 2's 0.7
    kept = lambda n: sorted(r["bullet"] for r in match.select_within(df, n).collect())
    assert kept(4) == [2, 3, 4, 5] and kept(5) == [1, 2, 3, 4, 5]
    assert 3 in kept(1)


def test_list_rows_leave_out_blanks(spark):
    df = spark.createDataFrame([("u", "", True, False, [], ["x"])], "url string, a string, b boolean, c boolean, d array<string>, e array<string>")
    assert landed.list_rows(df, ["a", "b", "c", "d", "e"]).first()["row"] == '{"b":true,"e":["x"]}'


def test_skill_demand_reads_tone(spark):
    lines = [("u", "requirements", 1, "3+ years of Python"), ("u", "requirements", 2, "Nice to have:"), ("u", "requirements", 3, "Strong Docker"), ("u", "requirements", 4, "You will learn Rust")]
    df = spark.createDataFrame(lines, "url string, field string, line int, text string")
    got = {r["skill"]: (round(r["weight"], 3), r["emphasis"]) for r in textmine.demand(df, [("Python", ["python"]), ("Docker", [" docker"]), ("Rust", [" rust "])]).collect()}
    assert got == {"Python": (4.5, 0), "Docker": (1.35, 1)}


def test_keywords_respect_their_edges(spark):
    df = spark.createDataFrame([("u", "f", 1, "trust the Dockerized c++ stack")], "url string, field string, line int, text string")
    found = textmine.skill_hits(df, [("Rust", [" rust "]), ("Docker", [" docker"]), ("C++", [" c++ "])]).select(F.transform("_skills", lambda s: s["skill"]).alias("s")).first()["s"]
    assert found == ["Docker", "C++"]
