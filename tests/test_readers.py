"""The best listings of many readers against scoring every pair, the early stop, and weights over defaults."""

import random

import pytest
from pyspark.sql import functions as F

from feedlens.operators import ranking as R
from feedlens.operators import readers as N

LEVELS = [None, "Intern", "New grad", "Senior"]


def pair_score(row, reader, w):
    major, interests, home, levels = reader
    count = len(set(row["matched_interests"] or []) & set(interests or []))
    opp = row["item_type"] in R.OPPORTUNITY
    out = row["static"] + (w.major if major is not None and row["discipline"] == major else 0) + min(count * w.interest, w.interest_cap)
    out += w.location if home and home in (row["location_tags"] or []) else 0
    return round(out + (w.seniority * N.level_fit(row["seniority"], set(levels or [])) if opp else 0), 6)


@pytest.mark.parametrize("block", [N.BLOCK, 3])
def test_top_of_readers_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "STEP", 4)
    rng = random.Random(block)
    items = [
        (f"u{k:03}", rng.choice(["Job", "Internship", "Article", "Event", None]), rng.choice(["A", "B", None]), rng.choice(LEVELS), rng.choice([None, [], ["X"], ["Y", "X"]]), rng.choice([None, ["Canada"], ["USA", "Canada"]]), rng.choice([0.0, 1.0, 1.0, 7.25]))
        for k in range(120)
    ]
    readers = [(k, rng.choice([None, "A", "B"]), rng.choice([None, [], ["X"], ["X", "Y"]]), rng.choice([None, "Canada", "Mars"]), rng.choice([None, ["Intern"], ["Lead", "New grad"]])) for k in range(60)]
    schema = "url string, item_type string, discipline string, seniority string, matched_interests array<string>, location_tags array<string>, static double"
    df = spark.createDataFrame(items, schema)
    monkeypatch.setattr(N, "static_scores", lambda i, w, t: i.withColumn("opp", F.coalesce(R.is_opportunity(F.col("item_type")), F.lit(False))).withColumns({c: F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in ("matched_interests", "location_tags")}))
    asked = spark.createDataFrame(readers, "reader_id int, major string, interests array<string>, home string, levels array<string>")
    got = {tuple(r) for r in N.top_of_readers(df, asked, F.current_timestamp(), k=7).collect()}
    w, rows, want = R.Weights(), df.collect(), set()
    for reader_id, *taste in readers:
        best = sorted((-pair_score(r, taste, w), r["url"]) for r in rows)[:7]
        want |= {(reader_id, n, url, -s) for n, (s, url) in enumerate(best, 1)}
    assert got == want
    assert N.top_of_readers(df.where("false"), asked, F.current_timestamp()).count() == 0
    assert N.top_of_readers(df, asked.where("false"), F.current_timestamp()).count() == 0


def test_the_walk_stops_early(monkeypatch):
    monkeypatch.setattr(N, "STEP", 10)
    rows = [{"top": 1000.0 - k, "heads": [{"minus": k - 1000.0, "url": f"u{k}"}], "opp": True, "discipline": None, "seniority": None, "matched_interests": ["X"], "location_tags": []} for k in range(1000)]
    block = N.block_of(rows)

    class Heads(list):
        read = 0

        def __getitem__(self, i):
            Heads.read = max(Heads.read, i)
            return super().__getitem__(i)

    block.heads = Heads(block.heads)
    assert [u for _, u in N.best_of(block, R.Weights(), None, ["X"], None, [], 5)] == ["u0", "u1", "u2", "u3", "u4"] and Heads.read < 30


def test_weights_over_defaults(spark):
    rows = [('{"skill": 1.5, "major": 0}',), (None,), ("not json",), ("{}",)]
    got = spark.createDataFrame(rows, "j string").select(N.weights_over_defaults(F.col("j")).alias("w")).select("w.*").collect()
    assert (got[0]["skill"], got[0]["major"], got[0]["pay"]) == (1.5, 0.0, 4.0)
    assert all(r.asDict() == R.Weights().__dict__ for r in got[1:])
