"""The registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedlens.plans import feed, landing, matching, mining, reader, reports, runs, scalars, search, skills, state, streams

_PLANS = (feed, scalars, search, state, mining, landing, matching, reports, reader, runs, skills, streams)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _plan in _PLANS:
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
