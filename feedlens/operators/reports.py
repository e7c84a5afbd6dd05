"""Counts, reports and small set operations over items and state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feedlens.functions import text


def stage_counts(saved: DataFrame, status: str = "status") -> DataFrame:
    """Saved rows by application stage; no status is the stage none."""
    return saved.groupBy(F.coalesce(status, F.lit("none")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def active_applications(applications: DataFrame, saved: DataFrame) -> DataFrame:
    """Applied, interviewing or offered rows that are saved; others do not count."""
    return applications.where(F.col("status").isin("applied", "interviewing", "offer")).join(saved.select("url"), "url", "left_semi")


def made_due(registry: DataFrame, before: Column, now: Column) -> DataFrame:
    """Sources that a change of preferences makes due: on now and not before."""
    return registry.where(now & ~before)


def is_stale(runs: DataFrame, as_of: Column, seconds: int = 600) -> DataFrame:
    """One row: whether the last complete run is that old, or there was none."""
    last = F.max(F.when(F.col("ok"), F.col("run_at")))
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(last.cast("timestamp"))
    return runs.agg(F.coalesce(age >= seconds, F.lit(True)).alias("stale"))


def dormant(listings: DataFrame, as_of: Column) -> DataFrame:
    """Whole days since the newest row of each source."""
    return listings.groupBy("source_platform").agg(F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.max("ts"))) / 86_400).alias("days"))


def all_failed(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.bool_and(~F.col("ok")), F.lit(False)).alias("all_failed"))


def discover_boards(urls: DataFrame, hosts: dict[str, str], known: DataFrame, most: int = 4000) -> DataFrame:
    """Boards (ats, slug) named by urls and not known yet, at most `most` in order. known: (ats, slug)."""
    found = urls.select(text.board_in_url(F.col("url"), hosts).alias("b")).where("b IS NOT NULL").select("b.ats", "b.slug").distinct()
    return found.join(known, ["ats", "slug"], "left_anti").orderBy("ats", "slug").limit(most)


def remove_unsaved(items: DataFrame, urls: DataFrame, saved: DataFrame) -> DataFrame:
    """Items without the listed urls, except saved ones."""
    gone = urls.select("url").join(saved.select("url"), "url", "left_anti").distinct()
    return items.join(gone, "url", "left_anti")


def palette_union(feed: DataFrame, saved: DataFrame, roles: DataFrame) -> DataFrame:
    """Feed and saved rows that are no roles, each url once, the feed's copy first."""
    both = feed.withColumn("_r", F.lit(0)).unionByName(saved.withColumn("_r", F.lit(1))).join(roles.select("url"), "url", "left_anti")
    names = [c for c in feed.columns if c != "url"]
    return both.groupBy("url").agg(F.min_by(F.struct(*names), "_r").alias("r")).select("url", "r.*")


def every_nth(rows: DataFrame, order: Sequence[str], by: Sequence[str], sample: int) -> DataFrame:
    """Every n-th row of each group, so that about `sample` remain: deterministic, no random draw."""
    w = W.partitionBy(*by)
    n = F.row_number().over(w.orderBy(*order)) - 1
    step = F.greatest(F.floor(F.count(F.lit(1)).over(w) / sample), F.lit(1))
    marked = rows.withColumn("_n", n).withColumn("_step", step)
    return marked.where((F.col("_n") % F.col("_step") == 0) & (F.col("_n") / F.col("_step") < sample)).drop("_n", "_step")


def sanitize(readers: DataFrame, interests: Sequence[str], levels: Sequence[str], regions: Sequence[str]) -> DataFrame:
    """Reader choices that the dictionaries can produce; others are dropped."""
    array = lambda xs: F.array(*(F.lit(x) for x in xs))
    return readers.select(
        "reader_id", F.array_intersect("interests", array(interests)).alias("interests"), F.array_intersect("levels", array(levels)).alias("levels"),
        F.when(F.col("home_region").isin(*regions), F.col("home_region")).alias("home_region"),
    )


def spread(rows: DataFrame, column: str, most: int = 20) -> DataFrame:
    """The most frequent values, ties by value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(most)
