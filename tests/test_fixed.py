"""Names, tiers and interests from the fixed tables."""

import pytest
from pyspark.sql import functions as F

from feedlens.functions import fixed, text
from feedlens.operators import entities as E


@pytest.fixture(scope="module")
def found(spark):
    names = ["Bank of Montreal", "BMO", "Facebook", "Meta", "Alphabet", " Lantern & Loom Studio ", "TD", "Stripe, Inc.", None]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id int, company string")
    own = spark.createDataFrame([("TD", 1)], "company string, tier int")
    tiers = {r["company"]: (r["canonical"], r["company_tier"]) for r in E.company_tiers(rows).collect()}
    mine = {r["company"]: r["company_tier"] for r in E.company_tiers(rows, own).collect()}
    return tiers, mine


def test_aliases_resolve_to_one_employer(found):
    tiers, _ = found
    assert tiers["Bank of Montreal"] == tiers["BMO"] and tiers["BMO"][1] is not None
    assert tiers["Facebook"] == tiers["Meta"] == ("Meta", 1)
    assert tiers["Alphabet"] == ("Google", 1) and tiers["Stripe, Inc."] == ("Stripe", 1)


def test_unknown_employers_have_no_tier(found):
    tiers, mine = found
    assert tiers[" Lantern & Loom Studio "] == ("Lantern & Loom Studio", None) and tiers[None] == (None, None)
    assert mine["TD"] == 1 and mine["BMO"] == tiers["BMO"][1]


def test_interests_of_the_fixed_table(spark):
    rows = spark.createDataFrame([("ML engineer", "We train language models in PyTorch"), ("Baker", "bread and cake")], "title string, body string")
    wanted = F.array(*(F.lit(n) for n, _ in fixed.INTERESTS))
    got = [r[0] for r in rows.select(text.match_interests(F.col("title"), F.col("body"), wanted)).collect()]
    assert "AI/ML" in got[0] and got[1] == []


def test_tables_are_whole():
    everyone = [n for names in fixed.TIERS.values() for n in names]
    assert len(set(everyone)) == len(everyone) and {b for _, b in fixed.ALIASES} - set(everyone) <= {"Twitter"} | set(everyone)
