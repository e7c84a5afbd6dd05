"""The stored text index against a plain dictionary, and the partitions that a lookup opens."""

import os
import random

from feedlens.sources.text_index import TextIndex

WORDS = "anat anatomy license licence of off the then über uber 2020 20 zebra".split()


def plain(texts, terms):
    fold = lambda w: w.replace("ü", "u")
    return sorted({(i, t) for i, text in texts.items() for t in terms for w in (text or "").split() if (fold(w) == t if len(t) == 2 else fold(w).startswith(t))})


def test_lookups_over_segments_tombstones_and_merges(spark, tmp_path):
    rng = random.Random(3)
    index, texts = TextIndex(spark, f"{tmp_path}/i", most=3), {}
    assert index.lookup(["of"]).count() == 0 and index.postings().count() == 0
    terms = ["anat", "lic", "of", "20", "uber"]
    for step in range(7):
        if step % 3 == 2:
            gone = rng.sample(sorted(texts), 5)
            index.remove(spark.createDataFrame([(i,) for i in gone], "id long"))
            for i in gone:
                texts.pop(i)
        else:
            new = {rng.randrange(40): rng.choice([None, "", " ".join(rng.choices(WORDS, k=6))]) for _ in range(15)}
            index.add(spark.createDataFrame([(i, t, "x") for i, t in new.items()], "n long, body string, id string"), "n", "body")
            texts |= new
        assert sorted(map(tuple, index.lookup(terms).collect())) == plain(texts, terms)
        now = index.head()[1]
        assert len(now["segments"]) <= 3 and len(now["dead"]) <= 3
    index.merge()
    assert index.head()[1]["dead"] == [] and sorted(map(tuple, index.lookup(terms).collect())) == plain(texts, terms)
    assert len(os.listdir(f"{tmp_path}/i/segments")) <= 4  # those of the last two manifests


def test_a_lookup_opens_its_partitions_alone(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i")
    index.add(spark.createDataFrame([(k, " ".join(WORDS)) for k in range(50)], "n long, body string"), "n", "body")
    found = index.lookup(["anat", "of"])
    assert {f.split("part=")[1][0] for f in found.inputFiles()} == {"a", "o"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "StringStartsWith(token,anat)" in plan and "BroadcastHashJoin" not in plan
