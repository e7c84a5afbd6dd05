"""A stored inverted index over posting texts: segments partitioned by first character, tombstones, and merges.

Adding documents writes one segment of their tokens and marks older postings of the same ids as dead; removing ids only marks. A lookup
opens the partitions of its terms alone and leaves out dead postings. When segments or dead ids have become many, a merge writes one
segment of what lives. Every change is published by one manifest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators.search import build_index
from feedlens.sources.manifest import Log

SCHEMA = "token string, id {id}, part string"


class TextIndex:
    """most: segments, or sets of tombstones, that may stand before the next change merges them."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "long", most: int = 8, keep: int = 2):
        self.spark, self.folder, self.id_type, self.most, self.keep = spark, folder.rstrip("/"), id_type, most, keep
        self.log = Log(spark, f"{self.folder}/log")

    def head(self) -> tuple[int, dict]:
        found = self.log.numbers()
        return (found[-1], self.log.read(found[-1])) if found else (-1, {"segments": [], "dead": []})

    # --- changes

    def add(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        """Indexes documents; an id that is there already is replaced. Null texts have no tokens."""
        n, now = self.head()
        docs = docs.select(F.col(id_col).cast(self.id_type).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
        self._write(n + 1, build_index(docs.select(F.col("id").alias("doc"), "text"), "doc", "text").select("token", "id"))
        dead = list(now["dead"])
        if now["segments"]:
            docs.select("id").distinct().write.mode("overwrite").parquet(f"{self.folder}/dead/d={n + 1}")
            dead.append(n + 1)
        self._publish(n + 1, [*now["segments"], n + 1], dead)

    def remove(self, ids: DataFrame) -> None:
        """Forgets the ids (column id)."""
        n, now = self.head()
        ids.select(F.col("id").cast(self.id_type)).distinct().write.mode("overwrite").parquet(f"{self.folder}/dead/d={n + 1}")
        self._publish(n + 1, now["segments"], [*now["dead"], n + 1])

    def merge(self) -> None:
        """One segment of all living postings, without tombstones."""
        n, now = self.head()
        if (rows := self._living(now, None)) is not None:
            self._write(n + 1, rows.select("token", "id"))
            self._publish(n + 1, [n + 1], [])

    def _write(self, n: int, rows: DataFrame) -> None:
        # A hot first character is split over tasks, small ones share one: the hint leaves the sizes to the adaptive planner.
        parts = rows.withColumn("part", F.substring("token", 1, 1)).hint("rebalance", F.col("part")).sortWithinPartitions("part", "token")
        parts.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/segments/s={n}")

    def _publish(self, n: int, segments: list[int], dead: list[int]) -> None:
        self.log.publish(n, {"segments": segments, "dead": dead})
        found = self.log.numbers()
        live = [self.log.read(x) for x in found[-self.keep :]]
        for x in found[: -self.keep]:
            self.log.drop(x)
        for folder, kind, letter in (("segments", "segments", "s"), ("dead", "dead", "d")):
            used = {f"{letter}={x}" for said in live for x in said[kind]}
            for name in self.log.names(f"{self.folder}/{folder}"):
                if name not in used:
                    self.log.remove(f"{self.folder}/{folder}/{name}")
        if max(len(segments), len(dead)) > self.most:
            self.merge()

    # --- reading

    def _living(self, now: dict, chars: Sequence[str] | None) -> DataFrame | None:
        """(token, id, part) of living postings; only of tokens that begin with one of the characters, where these are given."""
        schema, out = SCHEMA.format(id=self.id_type), None
        for s in now["segments"]:
            at = f"{self.folder}/segments/s={s}"
            there = set(self.log.names(at))
            paths = [f"{at}/{x}" for x in sorted(there) if x.startswith("part=")] if chars is None else [f"{at}/part={c}" for c in chars if f"part={c}" in there]
            if paths:
                one = self.spark.read.schema(schema).option("basePath", at).parquet(*paths).withColumn("_s", F.lit(s))
                out = one if out is None else out.unionByName(one)
        if out is None or not now["dead"]:
            return None if out is None else out.drop("_s")
        dead = None
        for d in now["dead"]:
            one = self.spark.read.schema(f"id {self.id_type}").parquet(f"{self.folder}/dead/d={d}").withColumn("_upto", F.lit(d))
            dead = one if dead is None else dead.unionByName(one)
        latest = dead.groupBy("id").agg(F.max("_upto").alias("_upto"))
        return out.join(latest, (out["id"] == latest["id"]) & (out["_s"] < latest["_upto"]), "left_anti").drop("_s")

    def postings(self) -> DataFrame:
        """All living (token, id)."""
        rows = self._living(self.head()[1], None)
        return self.spark.createDataFrame([], f"token string, id {self.id_type}") if rows is None else rows.select("token", "id")

    def lookup(self, terms: Sequence[str]) -> DataFrame:
        """(id, term) where a token begins with the term; two-letter terms match whole tokens. At most eight terms count."""
        terms = [t for t in dict.fromkeys(terms) if t][:8]
        rows = self._living(self.head()[1], sorted({t[0] for t in terms}))
        if rows is None:
            return self.spark.createDataFrame([], f"id {self.id_type}, term string")
        hit = lambda t: F.col("token") == t if len(t) == 2 else F.startswith("token", F.lit(t))
        some = F.lit(False)
        for t in terms:
            some = some | hit(t)
        named = F.array_compact(F.array(*(F.when(hit(t), F.lit(t)) for t in terms)))
        return rows.where(some).select("id", F.explode(named).alias("term")).distinct()
