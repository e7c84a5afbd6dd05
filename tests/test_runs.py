"""Routes, gates, résumé documents and the end of a run by hand-written values."""

import json

from pyspark.sql import functions as F

from feedlens.operators import gates as G
from feedlens.operators import resume as V
from feedlens.operators import runs as U


def test_posting_routes(spark):
    want = {
        "https://boards.greenhouse.io/acme/jobs/12?gh=1": [("greenhouse", ["acme", "12"])],
        "https://boards.greenhouse.io/jobs/12": [],
        "https://jobs.lever.co/acme/ab-1/apply": [("lever", ["acme", "ab-1"])],
        "https://jobs.lever.co/acme": [],
        "https://jobs.smartrecruiters.com/Acme/743": [("smartrecruiters", ["Acme", "743"])],
        "https://jobs.smartrecruiters.com/Acme/743-role": [],
        "https://t.wd5.myworkdayjobs.com/fr-CA/Site/job/Place/R1": [("workday", ["t.wd5.myworkdayjobs.com", "t", "Site", "Place/R1"]), ("schema.org", None)],
        "https://wd1.myworkdaysite.com/recruiting/ten/Site/job/R1": [("workday", ["wd1.myworkdaysite.com", "ten", "Site", "R1"]), ("schema.org", None)],
        "https://t.wd5.myworkdayjobs.com/Site/job": [("schema.org", None)],
        "https://apply.workable.com/acme/j/AB12/apply": [("workable", ["acme", "AB12"])],
        "https://acme.eightfold.ai/careers/job/99": [("eightfold", ["acme.eightfold.ai", "99"])],
        "https://www.jobbank.gc.ca/jobsearch/jobposting/41": [("job bank", None)],
        "https://ca.linkedin.com/jobs/view/engineer-at-acme-123/?ref=x": [("linkedin", ["123"])],
        "https://ca.linkedin.com/jobs/view/engineer": [],
        "https://notlinkedin.com/jobs/view/1": [],
        "https://acme.com/careers?keyword=x": [],
        "https://acme.com/search/1": [],
        "https://acme.com/research/1": [("schema.org", None)],
        "acme": [],
    }
    rows = spark.createDataFrame([(u,) for u in want], "url string").withColumn("route", U.posting_route(F.col("url"), F.lit(None).cast("string")))
    for r in rows.collect():
        got = [(x["handler"], None if x["params"] == [r["url"]] else x["params"]) for x in r["route"]]
        assert got == want[r["url"]], r["url"]
    mirror = rows.select(U.posting_route(F.lit("acme"), F.lit("m1")).alias("r")).first()["r"]
    assert [tuple(x) for x in mirror] == [("mirror", ["m1"])]


def test_gates(spark):
    w = G.Wanted(internships=True, jobs=False, news=False, disabled=("off",))
    rows = spark.createDataFrame([("Job", None, "a"), ("Job", "Intern", "a"), ("Internship", None, "off"), ("Article", None, "a"), ("Event", None, "a")], "item_type string, seniority string, source_platform string")
    assert [r[0] for r in rows.select(G.admits(w)).collect()] == [False, True, False, False, True]
    saved = spark.createDataFrame([("applied",), ("rejected",), (None,)], "status string").withColumns({"saved": F.lit(True), "item_type": F.lit("Job")})
    shown = {s: [r[0] for r in saved.select(G.saved_view(["Job"], s)).collect()] for s in ("any", "none", "active", "rejected")}
    assert shown == {"any": [True] * 3, "none": [False, False, True], "active": [True, False, False], "rejected": [False, True, False]}
    gate = spark.createDataFrame([(True, False), (True, True), (False, False)], "whole boolean, worth boolean")
    assert [r[0] for r in gate.select(G.passes_board_gate(F.col("whole"), F.col("worth"))).collect()] == [False, True, True]


RESUME = {
    "basics": {"name": " Ada ", "label": "", "email": "a@b", "url": "https://a", "location": {"address": "1 Road"}, "profiles": [{"network": "GitHub", "username": "ada"}, {"network": "Other", "username": "x"}, {"network": "Blog", "url": "https://b"}]},
    "education": [{"institution": "Uni", "studyType": "BSc", "area": "Maths", "score": "4.0", "endDate": "2020"}],
    "projects": [{"name": "P", "role": "Lead", "keywords": ["Rust ", "", "SQL"], "score": "9", "description": " What ", "highlights": ["One", "  ", "Two"]}],
    "skills": [{"name": "Langs", "keywords": ["Rust", "C"]}, {"name": " ", "keywords": []}],
    "meta": {"feedlens": {"sections": ["s0"], "entries": [[["e0", "b0"]]]}},
}


def test_resume_documents(spark):
    docs = spark.createDataFrame([(1, json.dumps(RESUME)), (2, "{"), (3, "{}"), (4, None)], "resume long, json string")
    read = V.read_documents(docs)
    rows = V.parts(read).orderBy("section", "entry", "bullet").collect()
    assert [(r["kind"], r["org"], r["title"], r["detail"], r["text"]) for r in rows] == [
        ("education", "Uni", "BSc, Maths", "4.0", None), ("projects", "P", "Lead", "Rust · SQL", "What"), ("projects", "P", "Lead", "Rust · SQL", "One"), ("projects", "P", "Lead", "Rust · SQL", "Two"),
        ("skills", "", "Langs", "Rust, C", None),
    ]
    assert (rows[0]["section_id"], rows[0]["entry_id"]) == ("s0", "e0") and len({r["bullet_id"] for r in rows[1:4]}) == 3
    c = {r["resume"]: r for r in V.contacts(read).collect()}
    assert set(c) == {1, 3} and c[1]["name"] == "Ada" and c[1]["headline"] is None and c[1]["location"] == "1 Road"
    assert [tuple(x) for x in c[1]["links"]] == [("Website", "https://a"), ("GitHub", "https://github.com/ada"), ("Blog", "https://b")]
    out = json.loads(V.export_documents(V.parts(read), V.contacts(read)).where("resume = 1").first()["json"])
    assert out["projects"][0]["keywords"] == ["Rust", "SQL"] and out["projects"][0]["highlights"] == ["What", "One", "Two"] and out["education"][0]["score"] == "4.0"
    assert out["skills"] == [{"name": "Langs", "keywords": ["Rust", "C"]}] and out["meta"]["feedlens"]["sections"][0] == "s0" and out["volunteer"] == []


def test_detail_items(spark):
    rows = spark.createDataFrame([("Rust · SQL, old",), ("a | b",), ("a; ;b",), ("a, b",), (" one ",), ("",)], "d string").select(V.detail_items(F.col("d")).alias("x"))
    assert [r["x"] for r in rows.collect()] == [["Rust", "SQL, old"], ["a", "b"], ["a", "b"], ["a", "b"], ["one"], []]


def test_search_watermark_never_goes_back(spark):
    searches = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-01-05'), (2, TIMESTAMP'2024-01-01'), (3, CAST(NULL AS TIMESTAMP)) AS t(search, viewed_at)")
    opens = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-01-02'), (2, TIMESTAMP'2024-01-03'), (3, TIMESTAMP'2024-01-04') AS t(search, at)")
    assert [r["viewed_at"].day for r in U.open_searches(searches, opens).orderBy("search").collect()] == [5, 3, 4]


def test_stored_details_of_one_url(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "ok", '{"description":"d","tags":["a"]}'), ("u2", "ok", None)], "url string, status string, payload string")
    rows.write.parquet(str(tmp_path / "details"))
    raw = spark.read.parquet(str(tmp_path / "details"))
    one = U.read_details(raw, "u1")
    assert "EqualTo(url,u1)" in one._jdf.queryExecution().toString()
    assert one.first().asDict() == {"url": "u1", "status": "ok", "description": "d", "requirements": None, "responsibilities": None, "perks": None, "tags": ["a"]}
    assert U.read_details(raw, "u2").first()["tags"] == []
