"""Board health against the plain fold, on histories that one row could not hold together."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedlens.operators import liveness as L
from feedlens.streaming import boards

DAY = 24 * 3600


def folded(rows):
    out = {}
    for board, t, answer in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2])):
        n, last = out.get(board, (0, None))
        if t is None and answer in ("Gone", "Empty"):
            out[board] = n + 1, last
        else:
            out[board] = boards.advance(n, last, t, answer)
    return out


def struck(spark, rows, gap_hours=24):
    df = spark.createDataFrame(rows, "board long, t long, answer string").repartition(5)
    got = L.strikes(df.select("board", F.timestamp_seconds("t").alias("ts"), "answer"), "board", "ts", "answer", gap_hours)
    return {r["board"]: (r["strikes"], r["last_strike"]) for r in got.collect()}


def test_strikes_equal_the_fold(spark):
    """Daily and sparse boards, long ones over many spans, answers just at and short of a day, resets, times before 1970, nulls."""
    rng = random.Random(11)
    rows = []
    for board in range(60):
        days, share = rng.choice([3, 40, 200, 9000]), rng.choice([0.0, 0.002, 0.1])
        for _ in range(rng.choice([1, 30, 400])):
            t = rng.randrange(-2 * DAY, days * DAY)
            rows.append((board, t, "Rows" if rng.random() < share else rng.choice(["Gone", "Empty", "Unclear"])))
            if rng.random() < 0.4:
                rows.append((board, t + DAY - rng.randrange(2), rng.choice(["Gone", "Empty", "Rows"] if share else ["Gone"])))
    rows += [(100, 0, "Gone"), (100, 0, "Rows"), (101, 0, "Unclear"), (102, 5, "Rows"), (102, 6, "Gone"), (102, DAY + 5, "Gone"), (102, DAY + 6, "Empty")]
    rows += [(None, 7, "Gone"), (None, 8 + DAY, "Gone"), (103, None, "Gone"), (103, None, "Gone"), (103, 9, "Gone"), (104, None, "Gone"), (104, None, "Rows"), (105, None, "Gone"), (105, 3, "Rows")]
    want = folded(rows)
    assert struck(spark, rows) == want
    assert max(n for n, _ in want.values()) > 100


def test_strikes_hold_no_history_in_a_row(spark):
    """One board with an answer each minute of five hundred days: no list of all its answers is made."""
    t = F.col("id") * 60
    df = spark.range(500 * 1440).select(F.lit(1).alias("board"), F.timestamp_seconds(t).alias("ts"), F.lit("Gone").alias("answer"))
    got = L.strikes(df, "board", "ts", "answer")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.collect()] == [(1, 500, 499 * DAY)]


def test_strikes_need_a_gap(spark):
    with pytest.raises(ValueError, match="gap_hours"):
        struck(spark, [(1, 0, "Gone")], 0)


def test_boards_stream_through_tasks_without_a_call_each(spark):
    """Each group's own call of Python, three to a board, took most of the time; groups may lie over batches of any size."""
    rows = [(b, (b + 1) * k * DAY, "Gone") for b in range(300) for k in range(3)] + [(7, 100 * DAY, "Rows"), (7, 9000 * DAY, "Empty"), (None, None, "Gone")]
    df = spark.createDataFrame(rows, "board long, t long, answer string")
    got = L.strikes(df.select("board", F.timestamp_seconds("t").alias("ts"), "answer"), "board", "ts", "answer")
    assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["board"]: (r["strikes"], r["last_strike"]) for r in got.collect()} == folded(rows)

    names = ["_key", "_n", "first", "reset", "offs", "n", "last", "none_n", "none_last"]
    spans = [(None, 1, 0, False, [5], [1], [5], 0, None), (None, 2, 1, False, [4, 9], [1, 1], [DAY + 4, DAY + 9], 0, None), (None, 3, 3, True, [], [], [], 0, None), (2.5, 1, 0, False, [1], [1], [1], 0, None)]
    table = pa.Table.from_pylist([dict(zip(names, x, strict=True)) for x in spans], pa.schema([("_key", pa.float64()), ("_n", pa.int32()), ("first", pa.int64()), ("reset", pa.bool_()), *((c, pa.list_(pa.int64())) for c in ("offs", "n", "last")), ("none_n", pa.int64()), ("none_last", pa.int64())]))
    for rows in (1, 2, 4):
        got = pa.Table.from_batches(L._fold_spans(iter(table.to_batches(max_chunksize=rows)), DAY)).to_pylist()
        assert [(x["_key"], x["reset"], x["n"], x["none_n"]) for x in got] == [(None, True, [], 0), (2.5, False, [1], 0)]
    assert list(L._fold_spans(iter([]), DAY)) == []
