"""Reuse of a ranked result: stored under the generation of its data, the profile and the hour, and read again while these are the same."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from feedlens.sources.manifest import Log

#: Fixed value: while a scan runs, a result of so many seconds ago will do.
SCAN_STALENESS_S = 4.0
HOUR_S = 3600


def bucket_of(now: datetime) -> int:
    """The hour of a clock, as a number; naive clocks are UTC."""
    return int((now if now.tzinfo else now.replace(tzinfo=timezone.utc)).timestamp()) // HOUR_S


def bucket_start(bucket: int) -> datetime:
    return datetime.fromtimestamp(bucket * HOUR_S, timezone.utc)


def profile_key(profile: Any) -> str:
    said = dataclasses.asdict(profile) if dataclasses.is_dataclass(profile) else profile
    return hashlib.sha256(json.dumps(said, sort_keys=True, default=list).encode()).hexdigest()


class Results:
    """One slot per name in a shared folder; the newest manifest names the table that fills it."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock

    def read(self, name: str, generation: int, profile: Any, now: datetime, build: Callable[[datetime], DataFrame], freshness: str = "exact") -> DataFrame:
        """The stored rows where they are fresh enough, else those of build(start of the hour), which are stored first.

        freshness: "exact" asks for the same generation and hour; "scanning" also takes a result of the last SCAN_STALENESS_S seconds, as a scan
        writes a new generation with each batch; "any" takes whatever there is for the profile. Another profile is never taken. Take
        the generation before the data are read, so that a write in between makes the result old rather than new.
        """
        log = Log(self.spark, f"{self.folder}/{name}/log")
        key, bucket, found = profile_key(profile), bucket_of(now), log.numbers()
        if found:
            said = log.read(found[-1])
            same = said["generation"] == generation and said["bucket"] == bucket
            recent = self.clock() - said["built"] < SCAN_STALENESS_S
            if said["profile"] == key and (same or freshness == "any" or (freshness == "scanning" and recent)):
                return self._table(said)
        rows = build(bucket_start(bucket))
        path = f"{self.folder}/{name}/rows-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        said = {"generation": generation, "profile": key, "bucket": bucket, "built": self.clock(), "path": path, "schema": rows.schema.json()}
        log.publish((found[-1] if found else -1) + 1, said)
        for n in found[:-1]:  # the last one before may still be read
            log.remove(log.read(n)["path"])
            log.drop(n)
        return self._table(said)

    def _table(self, said: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(said["schema"]))).parquet(said["path"])
