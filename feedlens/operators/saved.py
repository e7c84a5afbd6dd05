"""Reader state over items, the saved list, detail work and source health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.operators import entities
from feedlens.operators.ranking import ROUND_ROBIN, diversify_order, is_opportunity, order_by

#: Candidates of one pass of the detail queue.
QUEUE = 4800
TEXTS = ("description", "requirements", "responsibilities", "perks")


def annotate(items: DataFrame, marks: DataFrame, key: str = "url") -> DataFrame:
    """Sets saved and seen from the marks (key, saved_at, dismissed_at, seen_at; one row a key). Dismissed items stay."""
    m = marks.select(F.col(key).alias("_k"), F.col("saved_at").isNotNull().alias("_saved"), F.col("seen_at").isNotNull().alias("_seen"))
    joined = items.drop("saved", "seen").join(m, F.col(key) == F.col("_k"), "left")
    return joined.withColumns({"saved": F.coalesce("_saved", F.lit(False)), "seen": F.coalesce("_seen", F.lit(False))}).drop("_k", "_saved", "_seen")


def without_dismissed(items: DataFrame, marks: DataFrame, key: str = "url") -> DataFrame:
    return items.join(marks.where("dismissed_at IS NOT NULL").select(key), key, "left_anti")


def saved_list(marks: DataFrame, snapshots: DataFrame, skills: Column, key: str = "url") -> DataFrame:
    """Snapshots of saved items with saved_at, newest first. matched_skills are taken anew from the reader's present skills
    (an array), and verdicts against the set at the time of saving are taken off."""
    kept = marks.where("saved_at IS NOT NULL").select(key, "saved_at").join(snapshots, key)
    old = {c: F.lit(None).cast(dict(snapshots.dtypes)[c]) for c in ("merit", "last_call", *TEXTS) if c in snapshots.columns}
    return kept.withColumns({"matched_skills": F.array_intersect("required_skills", skills), **old}).orderBy(F.desc("saved_at"), key)


def resolve_details(wanted: DataFrame, ranked: DataFrame, snapshots: DataFrame, details: DataFrame, key: str = "url") -> DataFrame:
    """For each wanted key the ranked row, else the saved snapshot, with the details attached and its origin; none where both
    lack it. ranked and snapshots have the same columns. Score the result with the bars and the clock of the ranked set."""
    both = ranked.withColumn("_from", F.lit(0)).unionByName(snapshots.select(*ranked.columns).withColumn("_from", F.lit(1)))
    rows = entities.first_columns(both.join(wanted.select(key).distinct(), key, "left_semi"), key, F.col("_from"))
    rows = rows.withColumn("origin", F.when(F.col("_from") == 0, "ranked").otherwise("saved")).drop("_from")
    return entities.attach_details(rows, details)


def purge_unwanted(items: DataFrame, internships: bool, jobs: bool, news: bool, events: bool, disabled: Sequence[str] = ()) -> DataFrame:
    """The items that preferences let stay: wanted kinds, of sources that are not disabled."""
    kind = F.col("item_type")
    early = (kind == "Internship") | F.coalesce(F.col("seniority") == "Intern", F.lit(False))
    wanted = (
        F.when(kind == "Article", F.lit(news)).when(kind == "Event", F.lit(events))
        .when(is_opportunity(kind), F.when(early, F.lit(internships)).otherwise(F.lit(jobs))).otherwise(F.lit(True))
    )
    return items.where(wanted & (~F.col("source_platform").isin(*disabled) if disabled else F.lit(True)))


def source_health(registry: DataFrame, counts: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per source of the registry (source, category, enabled): n (0 where it is silent), last_ok_at, last_error, failing."""
    rows = registry.join(counts.select("source", F.col("n").alias("_n")), "source", "left").join(ledger.select("source", "ok", "last_ok_at", "last_error"), "source", "left")
    return rows.select("source", "category", "enabled", F.coalesce("_n", F.lit(0)).alias("n"), "last_ok_at", "last_error", F.coalesce(~F.col("ok"), F.lit(False)).alias("failing"))


def quiet_sources(health: DataFrame) -> DataFrame:
    """Enabled sources that contribute nothing."""
    return health.where("enabled AND n = 0").select("source")


def has_text() -> Column:
    """Whether any text of a posting holds more than white space."""
    out = F.lit(False)
    for c in TEXTS:
        out = out | (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return out


def seeded_details(rows: DataFrame, key: str = "url") -> DataFrame:
    """Details of rows that arrive with a text of their own, as fetched ones: key, texts and status."""
    return rows.where(has_text()).select(key, *TEXTS, F.lit("ok").alias("status"))


def detail_candidates(items: DataFrame, attempted: DataFrame, as_of: Column, key: str = "url") -> DataFrame:
    """Opportunities that were not attempted and are not closed."""
    open_ = F.col("closes_at").isNull() | (F.col("closes_at") >= as_of)
    return items.where(is_opportunity(F.col("item_type")) & open_).join(attempted.select(key).distinct(), key, "left_anti")


def detail_queue(candidates: DataFrame, most: int = QUEUE) -> DataFrame:
    """The order of detail work: the best `most` by merit and then score, mixed over employers by merit. Position from 1."""
    from pyspark.sql.window import Window as W

    best = candidates.orderBy(F.desc("merit"), F.desc("score"), "url").limit(most).withColumn("score", F.col("merit"))
    mixed = diversify_order(best, F.coalesce("company", "source_platform"))
    return mixed.withColumn("position", F.row_number().over(W.orderBy(*order_by(ROUND_ROBIN))))  # over `most` rows


def substring_search(rows: DataFrame, wanted: str, columns: Sequence[str] = ("title", "content_text", "location")) -> DataFrame:
    """Rows with the wanted text, whatever its case, anywhere in one of the columns; an empty one keeps all."""
    hit = F.lit(wanted == "")
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(wanted.lower()), F.lit(False))
    return rows.where(hit)
