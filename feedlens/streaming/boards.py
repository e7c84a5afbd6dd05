"""Board health as keyed streaming state: strikes that count only when spaced, reset by rows, forgotten when untried.

The state is a typed value with a timer a key, kept by the state store that spark.sql.streaming.stateStore.providerClass names; timers need
the RocksDB one (`rocks(spark)` names it).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GAP_S, FORGET_MS = 24 * 3600, 30 * 24 * 3600 * 1000
STATE = "strikes int, last_strike long, last_count long, last_try long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def advance(strikes: int, last: int | None, t: int, answer: str) -> tuple[int, int | None]:
    """One answer: Rows resets, Gone and Empty count when the last counted strike is a day old."""
    if answer == "Rows":
        return 0, None
    if answer in ("Gone", "Empty") and (last is None or t - last >= GAP_S):
        return strikes + 1, t
    return strikes, last


class Health(StatefulProcessor):
    """Folds the answers of a board. Only what a micro-batch says of one board is in memory, frame by frame once sorted by time."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("health", STATE)

    def _row(self, key: tuple[Any, ...], strikes: int, last: int | None, count: int | None, tried: int, gone: bool) -> pd.DataFrame:
        whole = lambda v: pd.array([v], dtype="Int64")
        return pd.DataFrame({"board": [key[0]], "strikes": [strikes], "last_strike": whole(last), "last_count": whole(count), "last_try": whole(tried), "_gone": [gone]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        strikes, last, count, tried = self.known.get() if self.known.exists() else (0, None, None, None)
        answers = pd.concat(list(rows), ignore_index=True)
        answers["t"] = answers["ts"].astype("datetime64[us]").astype("int64") // 1_000_000
        answers = answers.sort_values(["t", "answer"], kind="stable")
        for t, answer, n in zip(answers["t"].tolist(), answers["answer"].tolist(), answers["n"].tolist(), strict=True):
            strikes, last = advance(strikes, last, t, answer)
            count = count if answer not in ("Rows", "Gone", "Empty") else None if answer == "Rows" and pd.isna(n) else int(n) if answer == "Rows" else 0
        tried = max(int(answers["t"].max()), tried or 0)
        self.known.update((strikes, last, count, tried))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(tried * 1000 + self.forget_ms)
        yield self._row(key, strikes, last, count, tried, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        strikes, last, count, tried = self.known.get()
        self.known.clear()
        yield self._row(key, strikes, last, count, tried, True)

    def close(self) -> None:
        pass


def board_health(answers: DataFrame, forget_ms: int = FORGET_MS) -> DataFrame:
    """answers: board (of any type), ts, answer (Rows, Empty, Gone or other), n (rows read, may be null), with a watermark on ts.

    Emits (board, strikes, last_strike, last_count, last_try, _gone) after each batch that heard from a board. A board that is silent for
    `forget_ms` of event time is forgotten and emitted once more with _gone true.
    """
    board = answers.schema["board"].dataType.simpleString()
    out = f"board {board}, {STATE}, _gone boolean"
    return answers.select("board", "ts", "answer", F.col("n").cast("long").alias("n")).groupBy("board").transformWithStateInPandas(Health(forget_ms), out, "Update", "EventTime")


def trusted(answers: DataFrame, outcomes: DataFrame, run: str = "run") -> DataFrame:
    """Answers of runs in which some source succeeded; where all failed it was the network, not the boards. outcomes: run, ok."""
    good = outcomes.where("ok").select(run).distinct()
    return answers.join(good, run, "left_semi")
