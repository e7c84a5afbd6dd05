"""Incremental state from a stream: every micro-batch folds into a table of hash buckets.

The state is kept in buckets by a hash of its key. Batch n reads the newest earlier version of the buckets that its rows
touch and writes only these, to state/v=n/_b=bucket, so a batch costs as much as the buckets it touches. A batch that
runs again after a failure reads and writes the same versions. Old versions are removed after the stream has ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators import entities
from feedlens.sources.shared import shared_folder


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []


def versions(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, list[int]]:
    """Bucket -> its finished versions, oldest first; only those of batches earlier than `before` where that is given."""
    found: dict[int, list[int]] = {}
    for name in _names(spark, f"{folder}/state"):
        n = int(name.removeprefix("v="))
        inside = _names(spark, f"{folder}/state/{name}") if before is None or n < before else []
        for b in inside if "_SUCCESS" in inside else []:
            if b.startswith("_b="):
                found.setdefault(int(b.removeprefix("_b=")), []).append(n)
    return {b: sorted(v) for b, v in found.items()}


def state_of(spark: SparkSession, folder: str) -> DataFrame | None:
    """The present state: the newest version of each bucket."""
    paths = [f"{folder}/state/v={v[-1]}/_b={b}" for b, v in sorted(versions(spark, folder).items())]
    return spark.read.parquet(*paths) if paths else None


def fold_stream(stream: DataFrame, fold: Callable[[DataFrame | None, DataFrame], DataFrame], folder: str, key: Sequence[str], buckets: int = 64, keep: int = 2) -> DataFrame | None:
    """Runs the stream to its present end and returns the state, also where there was nothing new; null before any data.

    keep: versions of a bucket that stay.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())  # at most `buckets` numbers
        if touched:
            heads = versions(spark, folder, number)
            paths = [f"{folder}/state/v={heads[b][-1]}/_b={b}" for b in touched if b in heads]
            out = fold(spark.read.parquet(*paths) if paths else None, rows)
            out.withColumn("_b", bucket).repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{folder}/state/v={number}")
        rows.unpersist()

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    for b, found in versions(spark, folder).items():
        for n in found[:-keep]:
            fs, where = _fs(spark, f"{folder}/state/v={n}/_b={b}")
            fs.delete(where, True)
    return state_of(spark, folder)


def landing(spark: SparkSession, folder: str) -> str:
    """A folder that is there before its first files, so that a stream can be opened over it."""
    fs, where = _fs(spark, folder)
    fs.mkdirs(where)
    return folder


def in_parts(rows: DataFrame, by: Column, parts: int, folder: str) -> Iterator[int]:
    """Copies rows into a folder in `parts` appends, in ranges of `by`, and stops after each: what a stream over the folder then drains is one micro-batch.

    All tasks of a scan write a part together, each its own file; the stream must not limit the files of a batch.
    """
    value = by.cast("timestamp").cast("double")
    bounds = rows.select(F.percentile_approx(value, [k / parts for k in range(1, parts)]).alias("q")).first()["q"] or []
    place = sum((F.when(value > x, 1).otherwise(0) for x in bounds), F.lit(0))
    for k in range(parts):
        rows.where(F.coalesce(place, F.lit(0)) == k).write.mode("append").parquet(folder)
        yield k


def last_event_state(keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A fold that keeps the last event per key."""

    def fold(before: DataFrame | None, rows: DataFrame) -> DataFrame:
        rows = rows.select(*keys, *order, *columns)
        rows = rows if before is None else rows.unionByName(before)
        return entities.last_wins(rows, keys, F.struct(*order))

    return fold


def upsert_state(key: str, run: str, rank: str, seq: str, owned: Sequence[str], gained: Sequence[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A fold with source precedence. Besides the columns the state keeps, per key, the best rank of the newest run and,
    per gain-only column, whether an owning write gave it, which is what later writes depend on."""

    def fold(before: DataFrame | None, rows: DataFrame) -> DataFrame:
        rows = rows.select(key, run, rank, F.col(seq).alias("_seq"), *owned, *gained)
        state = None if before is None else before
        if state is not None:
            fresh = rows.join(state.select(key, F.col("last_run").alias("_r0"), F.col("best_rank").alias("_k0")), key, "left")
        else:
            fresh = rows.withColumn("_r0", F.lit(None).cast("int")).withColumn("_k0", F.lit(None).cast("long"))
        ahead = F.coalesce(F.col(run) > F.col("_r0"), F.lit(True))
        own = entities.owns(key, run, rank, "_seq") & (ahead | (F.col(rank) <= F.col("_k0")))
        marked = fresh.withColumn("_own", own)
        seq_if = lambda c, mine: F.when((F.col("_own") if mine else ~F.col("_own")) & F.col(c).isNotNull(), F.col("_seq"))
        newest = F.max(F.struct(F.col(run), -F.col(rank))).alias("_top")
        got = marked.groupBy(key).agg(
            newest, F.max("_own").alias("_any"), *(F.max_by(c, F.when(F.col("_own"), F.col("_seq"))).alias(f"_{c}") for c in owned),
            *(F.max_by(c, seq_if(c, True)).alias(f"_own_{c}") for c in gained), *(F.min_by(c, seq_if(c, False)).alias(f"_rest_{c}") for c in gained),
        )
        top_run, top_rank = F.col(f"_top.{run}"), -F.col("_top.col2")
        if state is None:
            return got.select(key, *(F.col(f"_{c}").alias(c) for c in owned), *(F.coalesce(f"_own_{c}", f"_rest_{c}").alias(c) for c in gained), top_run.alias("last_run"), top_rank.alias("best_rank"))
        old = state.select(key, *(F.col(c).alias(f"o_{c}") for c in (*owned, *gained, "last_run", "best_rank")))
        both = got.join(old, key, "full")
        same = F.col("o_last_run") == top_run
        rank_now = F.when(top_run.isNull(), F.col("o_best_rank")).when(F.coalesce(same, F.lit(False)), F.least(top_rank, "o_best_rank")).otherwise(top_rank)
        return both.select(
            key, *(F.when(F.coalesce("_any", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in owned),
            *(F.coalesce(f"_own_{c}", f"o_{c}", f"_rest_{c}").alias(c) for c in gained), F.greatest("o_last_run", top_run).alias("last_run"), rank_now.alias("best_rank"),
        )

    return fold


def new_only(stream: DataFrame, key: str, ts: str, horizon: str = "30 days") -> DataFrame:
    """First arrivals of each key within the watermark: an attempt ledger as a stream."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def hourly_counts(stream: DataFrame, ts: str, by: str, late: str = "2 hours") -> DataFrame:
    """Events per hour and group; rows later than the watermark no longer count."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), by).count()
