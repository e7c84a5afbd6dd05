"""A store of keyed tables that a stream writes as deltas; a batch commits all its tables at once or none.

A commit writes the rows that changed to table/d=seq and then one small manifest, log/seq.json, by a rename; seq counts commits. Readers go by
the newest manifest, so a batch that dies between two tables has changed nothing, and when it runs again it overwrites its own folders. The
manifest holds the number of the last batch, which is not run again. What a batch writes follows its own rows; when the deltas of a table have grown to a share of its base,
the base is written anew, which costs each row a bounded number of copies over time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.operators.entities import last_wins
from feedlens.sources.manifest import Log

#: A changed row with this column true is removed.
GONE = "_gone"


@dataclass
class Part:
    """The files of a table: the commit that wrote its base, rows of the base, (commit, rows) of the deltas since, and the schema as JSON."""

    base: int | None = None
    base_rows: int = 0
    deltas: list[tuple[int, int]] = field(default_factory=list)
    schema: str = ""


class Store:
    """tables: name -> key columns. A base is rewritten when its deltas hold `ratio` of its rows and at least `least` rows."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Sequence[str]], ratio: float = 0.5, least: int = 100_000, keep: int = 2):
        self.spark, self.folder, self.tables, self.ratio, self.least, self.keep = spark, folder.rstrip("/"), tables, ratio, least, keep
        self.log = Log(spark, f"{self.folder}/log")

    # --- manifests

    def _load(self, seq: int) -> tuple[int, dict[str, Part]]:
        said = self.log.read(seq)
        return said["batch"], {name: Part(p["base"], p["base_rows"], [tuple(x) for x in p["deltas"]], p["schema"]) for name, p in said["tables"].items()}

    def head(self) -> tuple[int, int, dict[str, Part]]:
        """The last commit and its batch, -1 before any, and its tables."""
        found = self.log.numbers()
        return (found[-1], *self._load(found[-1])) if found else (-1, -1, {})

    def _publish(self, seq: int, batch: int, parts: dict[str, Part]) -> None:
        self.log.publish(seq, {"batch": batch, "tables": {name: asdict(p) for name, p in parts.items()}})

    def _sweep(self) -> None:
        """Removes manifests but the last few, and folders that none of these names."""
        found = self.log.numbers()
        live = [self._load(n)[1] for n in found[-self.keep :]]
        for n in found[: -self.keep]:
            self.log.drop(n)
        for name in self.tables:
            used = {f"b={p[name].base}" for p in live if name in p} | {f"d={d}" for p in live if name in p for d, _ in p[name].deltas}
            for x in self.log.names(f"{self.folder}/{name}"):
                if x not in used:
                    self.log.remove(f"{self.folder}/{name}/{x}")

    # --- reading

    def _merged(self, name: str, part: Part) -> DataFrame | None:
        keys = list(self.tables[name])
        at, schema = f"{self.folder}/{name}", T.StructType.fromJson(json.loads(part.schema))
        base = None if part.base is None else self.spark.read.schema(schema).parquet(f"{at}/b={part.base}")
        if not part.deltas:
            return base
        deltas = None
        for n, _ in part.deltas:
            one = self.spark.read.schema(T.StructType([*schema, T.StructField(GONE, T.BooleanType())])).parquet(f"{at}/d={n}").withColumn("_batch", F.lit(n))
            deltas = one if deltas is None else deltas.unionByName(one)
        newest = last_wins(deltas, keys, F.col("_batch"))
        rows = newest.where(f"NOT {GONE}").drop(GONE, "_batch")
        return rows if base is None else base.join(newest.select(*keys), keys, "left_anti").unionByName(rows)

    def read(self, name: str) -> DataFrame | None:
        """The present rows of a table; null before it has any."""
        part = self.head()[2].get(name)
        return None if part is None else self._merged(name, part)

    def lookup(self, name: str, rows: DataFrame, most: int = 1000) -> DataFrame | None:
        """The present rows of the keys that `rows` hold. Up to `most` single keys go to the scan as a filter, as bases are sorted by key."""
        now, keys = self.read(name), list(self.tables[name])
        if now is None:
            return None
        wanted = rows.select(*keys).distinct()
        if len(keys) == 1 and len(few := wanted.limit(most + 1).collect()) <= most:
            return now.where(F.col(keys[0]).isin([r[0] for r in few]))
        return now.join(wanted, keys, "left_semi")

    # --- writing

    def commit(self, batch: int, changes: dict[str, DataFrame]) -> bool:
        """Stores the changed rows of all tables as a batch; false if it is stored already. A changed row replaces the row of its key."""
        seq, last, parts = self.head()
        if last >= batch:
            return False
        self._write(seq + 1, batch, parts, changes)
        return True

    def amend(self, changes: dict[str, DataFrame]) -> None:
        """Changes outside of any batch."""
        seq, last, parts = self.head()
        self._write(seq + 1, last, parts, changes)

    def _written(self, rows: DataFrame, path: str) -> int:
        """Writes rows and tells how many they were."""
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        return seen.get["n"]

    def _write(self, seq: int, batch: int, parts: dict[str, Part], changes: dict[str, DataFrame]) -> None:
        after = {}
        for name, keys in self.tables.items():
            old = parts.get(name, Part())
            part = Part(old.base, old.base_rows, list(old.deltas), old.schema)
            if name in changes:
                rows = changes[name]
                rows = rows if GONE in rows.columns else rows.withColumn(GONE, F.lit(False))
                part.schema = part.schema or rows.drop(GONE).schema.json()
                rows = rows.select(*T.StructType.fromJson(json.loads(part.schema)).names, GONE)
                if written := self._written(rows, f"{self.folder}/{name}/d={seq}"):
                    part.deltas.append((seq, written))
            held = sum(rows for _, rows in part.deltas)
            if part.deltas and held >= max(self.least, self.ratio * part.base_rows):
                whole = self._merged(name, part).repartition(*keys).sortWithinPartitions(*keys)
                part = Part(seq, self._written(whole, f"{self.folder}/{name}/b={seq}"), [], part.schema)
            if part.base is not None or part.deltas:
                after[name] = part
        self._publish(seq, batch, after)
        self._sweep()


def run_stream(stream: DataFrame, store: Store, step: Callable[[Store, DataFrame], dict[str, DataFrame]]) -> None:
    """Runs the stream to its present end. step turns the rows of a batch into the changed rows of each table."""

    def batch(rows: DataFrame, n: int) -> None:
        if store.head()[1] >= n:
            return
        rows = rows.persist()
        try:
            store.commit(n, step(store, rows))
        finally:
            rows.unpersist()

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store.folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_step(key: str, run: str, seq: str, admit: Column, gate: Column, fold: Callable[[DataFrame | None, DataFrame], DataFrame], texts: Sequence[str]) -> Callable[[Store, DataFrame], dict[str, DataFrame]]:
    """A batch of observations: finished, admitted, gated, then upserted into `items`; texts that came along go to `details`.

    Finishing drops rows without a key and repeats of a write (key, run, seq). A detail row is the newest one with a text by (run, seq), status ok.
    Nothing is swept here: whether a listing is gone is a question about the whole run.
    """

    def step(store: Store, rows: DataFrame) -> dict[str, DataFrame]:
        named = rows.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
        kept = named.where(F.coalesce(admit & gate, F.lit(False))).dropDuplicates([key, run, seq])
        some = F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in texts)).isNotNull()
        fresh = kept.where(some).select(key, F.struct(run, seq).alias("at"), *texts, F.lit("ok").alias("status"))
        known = store.lookup("details", fresh)
        details = last_wins(fresh if known is None else fresh.unionByName(known), [key], F.col("at"))
        return {"items": fold(store.lookup("items", kept), kept), "details": details}

    return step


def requeue(hosts: Sequence[str] = (), longest: int = 400) -> Column:
    """Whether an attempt counts as none, so that its posting is tried again: it brought nothing, or a text of more than `longest` characters
    in one line, which was never split, or it is of one of the hosts and has no deadline. Columns: url, status, description, closes_at."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    flat = F.coalesce((F.instr("description", "\n") == 0) & (F.length("description") > longest), F.lit(False))
    of_host = F.lit(False)
    for host in hosts:
        of_host = of_host | F.coalesce(F.contains(F.col("url").cast("string"), F.lit(host)), F.lit(False))
    return ~ok | flat | (of_host & F.col("closes_at").isNull())


def attempts_step(order: str) -> Callable[[Store, DataFrame], dict[str, DataFrame]]:
    """The last attempt of each posting, in `attempts`."""

    def step(store: Store, rows: DataFrame) -> dict[str, DataFrame]:
        keys = list(store.tables["attempts"])
        known = store.lookup("attempts", rows)
        return {"attempts": last_wins(rows if known is None else rows.unionByName(known), keys, F.col(order))}

    return step


def evict(store: Store, name: str, gone: Column) -> None:
    """Removes the rows for which the rule holds."""
    now = store.read(name)
    if now is not None:
        store.amend({name: now.where(gone).withColumn(GONE, F.lit(True))})
