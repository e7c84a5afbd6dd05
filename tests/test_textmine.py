"""Key terms of postings whose parts lie in several rows, counted in tasks of bounded text."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from feedlens.operators import textmine as M

WEIGHTS = {"user": 3.0, "tool": 1.0}


def test_a_row_counts_its_own_terms(spark):
    df = spark.createDataFrame([("red fox, red fox blue",), ("of it",), ("",), (None,), ("red",)], "t string")
    got = df.select(M.row_counts(M.row_terms(F.col("t"), [])).alias("x")).collect()
    assert [None if r["x"] is None else {t["term"]: t["c"] for t in r["x"]} for r in got[:1]] == [{"blue": 1, "fox": 2, "fox blue": 2, "red": 2, "red fox": 4}]
    assert [r["x"] or [] for r in got[1:4]] == [[], [], []] and [tuple(t) for t in got[4]["x"]] == [("red", 1)]


def test_focus_tasks_follow_the_bytes_of_the_texts(spark, monkeypatch):
    """One task once held the counts of as many terms as a shuffle partition of texts had."""
    monkeypatch.setattr(M, "TASK_BYTES", 400, raising=False)
    words = ["cat", "dog", "sun", "map", "ink", "oak"]
    rows = [(u, p, " ".join(words[(u + k * (k + r)) % 6] for k in range(12 + u))) for u in range(20) for p in ("user", "tool", "system") for r in range(2)]
    rows += [(20, "user", ""), (21, "tool", None), (22, None, "cat dog")]
    got = M.focus(spark.createDataFrame(rows, "url long, part string, text string"), WEIGHTS, [])
    n = sum(len(t or "") for _, p, t in rows if p in WEIGHTS) // 400 + 1
    counts: dict = {}
    for u, p, t in rows:
        ws = re.findall("[a-z]+", t or "") if p in WEIGHTS else []
        counts.setdefault((u, p), Counter()).update(ws)
        counts[u, p].update({k: 2 * v for k, v in Counter(map(" ".join, zip(ws, ws[1:]))).items()})
    raw: dict = {}
    for (u, p), c in counts.items():
        for term, k in c.items():
            raw[u, term] = raw.get((u, term), 0.0) + WEIGHTS[p] * (1 + math.log(k))
    best = {u: max(w for (v, _), w in raw.items() if v == u) for u, _ in raw}
    assert {(r["url"], r["term"]): round(r["weight"], 6) for r in got.collect()} == {k: round(w / best[k[0]], 6) for k, w in raw.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert n == 18 and len(re.findall(rf"RepartitionByExpression \[.*\], {n}\b", plan)) == 2
    assert M.focus(spark.createDataFrame(rows[:3], "url long, part string, text string"), {}, []).count() == 0
