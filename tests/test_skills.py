"""The skill catalog and demand of whole postings against a regular-expression version and hand-written values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from feedlens.functions import dictionaries as D
from feedlens.functions import skills as S
from feedlens.operators import skills as K

CATALOG = S.Catalog(
    [("Basil", "herbs", ["basil"]), ("Go", "games", [" go ", "golang"]), ("C", "letters", [" c ", " c/"]), ("Salt", "minerals", [" salt "]), ("Sea salt", "minerals", ["sea salt"])],
    {"Go": ["golang"], "C": [" c/"]},
)


def read(title="", req=None, resp=None, desc=None, scraped=None, tags=None, catalog=CATALOG):
    reader = K.Reader(catalog, (D.LEARN_CUES, D.NICE_CUES, D.MUST_CUES), 400, 90)
    return {s: (round(w, 3), e) for s, w, e in reader.read((title, req, resp, desc, scraped), tags)}


def test_boundaries_and_overlaps():
    assert read(desc="(salt), SALT/pepper; sea salt-free") == {"Salt": (1.0, 2), "Sea salt": (1.0, 2)}
    assert read(desc="cobasily sealt saltines basalt") == {"Basil": (1.0, 2)}
    assert read(title="C++ C# R&D c") == {"C": (2.0, 0)}
    assert read(title="C+ c#") == {}


def test_long_texts_are_strict():
    assert read(desc="we go there") == {"Go": (1.0, 2)}
    assert read(desc="we go there " + "pad " * 100) == {}
    assert read(desc="a golang house " + "pad " * 100) == {"Go": (1.0, 2)}


def test_tones_of_lines_and_headings():
    assert read(req="basil\nNice to have:\nsalt, must have\nOther things:\ngo now") == {"Basil": (3.0, 0), "Salt": (1.35, 1), "Go": (3.0, 0)}
    assert read(desc="You will learn\nbasil") == {}
    assert read(desc="You will learn\nbasil", tags=["BASIL"]) == {"Basil": (3.1, 0)}
    assert read(resp="3 years of basil\nbasil again") == {"Basil": (round(1.6 * 1.5 + 1.6 / 1.5, 3), 0)}
    assert read(req="bonus points\ncalm and kind\nbasil", desc="basil") == {"Basil": (round(3 * 0.45 + 1 / 1.5, 3), 1)}


def test_scraped_line_is_the_last_resort():
    assert read(title="x", scraped="basil") == {"Basil": (2.0, 0)}
    assert read(title="x", desc="y", scraped="basil") == {}


def test_hits_equal_regular_expressions():
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    catalog = S.Catalog([(f"n{k}", "x", [(" " if k % 2 else "") + w + (" " if k % 3 else "")]) for k, w in enumerate(words)])
    matcher = K.Matcher(catalog)
    for _ in range(200):
        text = "".join(rng.choice("abc +.é") for _ in range(60))
        want = set()
        for k, (_, _, [word]) in enumerate(catalog.skills):
            edge = "[a-z0-9+#&]"
            pattern = (f"(?<!{edge})" if word[0] == " " else "") + re.escape(word.strip()) + (f"(?!{edge})" if word[-1] == " " else "")
            want |= {(m.start(), k) for m in re.finditer(f"(?={pattern})", text)}
        assert set(matcher.hits(text, False)) == want


def test_default_catalog():
    catalog = S.default_catalog()
    assert len(catalog.skills) == 119 and len(set(catalog.names)) == 119
    assert S.keywords_of("Rust") == [" rust "] and S.keywords_of("Next.js") == ["next.js", "nextjs", "next js"] and S.keywords_of("HTML / CSS") == [" html ", " css "]
    assert read(req="Built in Rust/Go, trusting no one; React-based, on Kubernetes", catalog=catalog) == {"Go": (3.0, 0), "Rust": (3.0, 0), "React": (3.0, 0), "Kubernetes": (3.0, 0)}
    assert read(desc="cargo", catalog=catalog.with_keywords({"Rust": ["cargo"]})) == {"Rust": (1.0, 2)}


def test_columns_and_rows(spark):
    rows = [(1, None, "basil", None, None, None, None), (2, "go", "", None, None, "salt", ["c", None, "nothing"]), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "url int, title string, req string, resp string, des string, scraped string, tags array<string>")
    got = df.select("url", K.posting_demand(CATALOG, *map(F.col, ("title", "req", "resp", "des", "scraped", "tags"))).alias("demand"))
    assert {tuple(r) for r in K.demand_rows(got, "demand", "url").collect()} == {(1, "Basil", 3.0, 0), (2, "Go", 2.0, 0), (2, "C", 3.0, 0), (2, "Salt", 2.0, 0)}
    cover = got.select("url", K.coverage_of(F.col("demand"), F.array(F.lit("C"), F.lit("Salt"))).alias("c")).select("url", "c.*").collect()
    assert {tuple(r) for r in cover} == {(1, None, 1, 0), (2, 5 / 7, 3, 2), (3, None, 0, 0)}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("false").count() == 0
    names = spark.createDataFrame([("we go with golang and salt",), (None,)], "t string").select(K.names_in(CATALOG, F.col("t")).alias("s"), K.names_in(CATALOG, F.col("t"), strict=False).alias("l"))
    assert [tuple(r) for r in names.collect()] == [(["Go", "Salt"], ["Go", "Salt"]), ([], [])]


def test_labels_and_categories(spark):
    table = K.catalog_table(spark, S.default_catalog())
    labels = spark.createDataFrame([("node JS",), ("REACTjs",), ("c",), ("C ++",), ("??",), (None,), ("cobol",)], "label string")
    got = {r["label"]: r["skill"] for r in K.canonical_skills(labels, table).collect()}
    assert got == {"node JS": "Node.js", "REACTjs": "React", "c": "C", "C ++": "C++", "??": None, None: None, "cobol": None}
    rows = spark.createDataFrame([(1, "Rust"), (1, "Go"), (1, "Git"), (1, "Go"), (2, "cobol")], "url int, skill string")
    got = {(r["url"], r["category"]): r["skills"] for r in K.by_category(rows, table, "url").collect()}
    assert got == {(1, "Languages"): ["Go", "Rust"], (1, "Tools & Practices"): ["Git"]}


def test_a_catalog_is_bounded(spark):
    rows = spark.range(5).selectExpr("id AS position", "string(id) AS skill", "'x' AS category", "array(string(id)) AS keywords", "cast(null as array<string>) AS tight")
    assert K.catalog_from(rows).names == ["0", "1", "2", "3", "4"]
    with pytest.raises(ValueError, match="more than 3"):
        K.catalog_from(rows, most=3)


def test_a_batch_of_postings_is_not_held_as_python_values(monkeypatch):
    """A batch of 4,000 postings with 40 demands each; as dicts its results alone took over 40 MB."""
    import tracemalloc

    import pyarrow as pa

    made, words = [], [f"word{k}" for k in range(10, 50)]
    monkeypatch.setattr(K.F, "arrow_udf", lambda kind: lambda f: lambda *columns: made.append(f) or columns[0])
    K.posting_demand(S.Catalog([(w, "x", [w]) for w in words]), *(_Plain() for _ in range(6)))
    n = 4000
    none, text = pa.nulls(n, pa.string()), pa.array([" ".join(words)] * n)
    tracemalloc.start()
    got = made[0](none, none, none, text, none, pa.nulls(n, pa.list_(pa.string())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == n and got[0].as_py() == got[n - 1].as_py() == [{"skill": w, "weight": 1.0, "emphasis": 2} for w in words]
    assert got.type == K.DEMAND_ARROW and len(made[0](*(x.slice(0, 0) for x in (none, none, none, text, none, pa.nulls(n, pa.list_(pa.string())))))) == 0
    assert peak < 12_000_000


class _Plain:
    """Stands for a column where no session is."""

    def cast(self, kind):
        return self
