"""Entity resolution and incremental upsert of listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feedlens.functions import fixed, text


def ordered_union(sources: Sequence[DataFrame], failed: Sequence[int] = ()) -> DataFrame:
    """All sources in registry order as one table with source_rank; failed sources vouch for nothing and are left out."""
    out: DataFrame | None = None
    for rank, df in enumerate(sources):
        if rank in failed:
            continue
        df = df.withColumn("source_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("every source failed")
    return out


def first_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per non-empty key, the first in order. Rows are combined before the shuffle."""
    names = [c for c in rows.columns if c != key]
    best = with_key(rows, key).groupBy(key).agg(F.min_by(F.struct(*names), order).alias("r"))
    return best.select(key, "r.*")


def with_key(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))


def first_columns(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """As first_wins, for a short order: each column is aggregated by itself, so those that nobody reads are never carried. All come from
    one row, as rows of equal order meet every column in the same turn."""
    return with_key(rows, key).groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in rows.columns if c != key))


def last_wins(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    names = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("r")).select(*key, "r.*")


def absorb(rows: DataFrame, key: str, order: Column, first: Sequence[str], gains: Sequence[str], groups: dict[str, Sequence[str]]) -> DataFrame:
    """The first copy of each key; `gains` take the first non-null over all copies, and each group of columns comes whole
    from the first copy in which one of the group's deciding columns is set (groups: decider columns first by name)."""
    aggs = [F.min_by(c, order).alias(c) for c in first]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in gains]
    for columns in groups.values():
        some = F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()
        aggs.append(F.min_by(F.struct(*columns), F.when(some, order)).alias("_".join(columns)))
    out = rows.groupBy(key).agg(*aggs)
    picked = [F.col("_".join(cs))[c].alias(c) for cs in groups.values() for c in cs]
    return out.select(key, *first, *gains, *picked)


def owns(key: str, run: str, rank: str, seq: str) -> Column:
    """Whether a write owns its row: the first of a newer run, or of a rank no worse than all earlier ones of the run."""
    earlier = W.partitionBy(key, run).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.col(rank) <= F.min(rank).over(earlier), F.lit(True))


def ranked_upsert(log: DataFrame, key: str, run: str, rank: str, seq: str, owned: Sequence[str], gained: Sequence[str]) -> DataFrame:
    """The state after all writes of a log with source precedence.

    Owned columns come from the last owning write. Gain-only columns take the last non-null owning value, else the first
    non-null other one. last_run is the newest run. Feed an older state as writes with the smallest seq.
    """
    w = log.withColumn("_own", owns(key, run, rank, seq))
    own = lambda c: F.when(F.col("_own") & F.col(c).isNotNull(), F.col(seq))
    rest = lambda c: F.when(~F.col("_own") & F.col(c).isNotNull(), F.col(seq))
    aggs = [F.max_by(c, F.when(F.col("_own"), F.col(seq))).alias(c) for c in owned]
    aggs += [F.coalesce(F.max_by(c, own(c)), F.min_by(c, rest(c))).alias(c) for c in gained]
    return w.groupBy(key).agg(*aggs, F.max(run).alias("last_run"), F.lit(0).alias("missed"))


def derive_on_ingest(rows: DataFrame, majors: Sequence, bands: Sequence) -> DataFrame:
    """Backfills discipline, company, seniority and location tags where a source left them out."""
    from feedlens.functions.places import normalize_location

    return (
        rows.withColumn("discipline", text.classify_discipline(F.concat_ws(" ", "title", "content_text"), majors))
        .withColumn("company", F.coalesce("company", text.company_from_title(F.col("title"))))
        .withColumn("seniority", text.classify_seniority(F.col("title"), bands))
        .withColumn("location_tags", normalize_location(F.col("location")))
    )


def canonical_companies(rows: DataFrame, names: DataFrame, company: str = "company") -> DataFrame:
    """Adds canonical: the display name of the normalised key in names (key, display, priority), else the trimmed input."""
    known = names.groupBy("key").agg(F.min_by("display", "priority").alias("display"))
    keyed = rows.withColumn("_key", text.company_normalize(F.col(company)))
    return keyed.join(known, keyed["_key"] == known["key"], "left").withColumn("canonical", F.coalesce("display", F.trim(company))).drop("_key", "key", "display")


def default_names(spark: SparkSession) -> DataFrame:
    """names for canonical_companies from the fixed tables: aliases first, then the employers themselves."""
    rows = [(a, b, 0) for a, b in fixed.ALIASES] + [(n, n, 1) for names in fixed.TIERS.values() for n in names]
    return spark.createDataFrame(rows, "name string, display string, priority int").select(text.company_normalize(F.col("name")).alias("key"), "display", "priority")


def company_tiers(rows: DataFrame, overrides: DataFrame | None = None, company: str = "company") -> DataFrame:
    """Adds canonical and company_tier: a reader's own tier of the canonical name (company, tier), else that of the fixed table, else null."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(n, k) for k, names in fixed.TIERS.items() for n in names], "_name string, _tier int")
    named = canonical_companies(rows, default_names(spark), company).join(table, F.col("canonical") == F.col("_name"), "left")
    own = F.lit(None).cast("int")
    if overrides is not None:
        named = named.join(overrides.select(F.col("company").alias("_over"), F.col("tier").alias("_own")), F.col("canonical") == F.col("_over"), "left")
        own = F.col("_own")
    return named.withColumn("company_tier", F.coalesce(own, "_tier")).drop("_name", "_tier", "_over", "_own")


def attach_details(items: DataFrame, details: DataFrame) -> DataFrame:
    """Texts from the detail; its deadline and, as a group, its pay only where it has them."""
    d = details.select("url", *(F.col(c).alias(f"_{c}") for c in details.columns if c != "url"))
    has_pay = F.coalesce(F.col("_salary_min"), F.col("_salary_max")).isNotNull()
    joined = items.join(d, "url", "left").withColumn("closes_at", F.coalesce("_closes_at", "closes_at"))
    for c in ("salary_min", "salary_max", "salary_period"):
        joined = joined.withColumn(c, F.when(has_pay, F.col(f"_{c}")).otherwise(F.col(c)))
    return joined.withColumn("description", F.col("_description")).drop(*(f"_{c}" for c in details.columns if c != "url"))


def hide_mirrored(items: DataFrame, mirrors: Sequence[str]) -> DataFrame:
    """Drops an unsaved row of a mirror source that has employer and title of an opportunity elsewhere."""
    key = text.title_key(F.col("title"))
    mirror = F.col("source_platform").isin(*mirrors)
    rows = items.withColumn("_key", key).withColumn("_mirror", mirror)
    originals = rows.where(~F.col("_mirror") & F.col("item_type").isin("Job", "Internship") & F.col("company").isNotNull()).select(F.col("company").alias("_c"), F.col("_key").alias("_k")).distinct()
    candidates = rows.where(F.col("_mirror") & ~F.col("saved") & F.col("company").isNotNull())
    kept = candidates.join(originals, (F.col("company") == F.col("_c")) & (F.col("_key") == F.col("_k")), "left_anti")
    others = rows.where(~(F.col("_mirror") & ~F.col("saved") & F.col("company").isNotNull()))
    return others.unionByName(kept).drop("_key", "_mirror")
