"""Matching of résumé bullets to postings, and selection within a budget."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def bullet_relevance(bullets: DataFrame, demands: DataFrame, echoes: DataFrame, declared: Column | None = None) -> DataFrame:
    """(bullet, url, relevance, covered): 2 x want of each demanded skill (x 1.3 if declared by hand), 1.5 ln(1 + echo)
    and 0.35 for a digit. bullets: bullet, url, text, skills (array); demands: url, skill, weight; echoes: id, url, echo."""
    top = W.partitionBy("url")
    want = demands.select("url", "skill", (F.col("weight") / F.max("weight").over(top)).alias("want"))
    named = bullets.select("bullet", "url", F.explode("skills").alias("skill")).join(want, ["url", "skill"])
    factor = F.when(declared, 1.3).otherwise(1.0) if declared is not None else F.lit(1.0)
    by_skill = named.groupBy("bullet", "url").agg(F.sum(2.0 * F.col("want") * factor).alias("asked"), F.array_sort(F.collect_set("skill")).alias("covered"))
    joined = bullets.select("bullet", "url", "text").join(by_skill, ["bullet", "url"], "left").join(echoes.select(F.col("id").alias("bullet"), "url", "echo"), ["bullet", "url"], "left")
    digit = F.when(F.col("text").rlike("[0-9]"), 0.35).otherwise(0.0)
    score = F.coalesce("asked", F.lit(0.0)) + 1.5 * F.log1p(F.coalesce("echo", F.lit(0.0))) + digit
    return joined.select("bullet", "url", score.alias("relevance"), F.coalesce("covered", F.array().cast("array<string>")).alias("covered"))


def entry_scores(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best relevance of an entry and 0.3 of the rest."""
    best, total = F.max("relevance"), F.sum("relevance")
    return scored.groupBy(*keys).agg((best + 0.3 * (total - best)).alias("entry_score"))


def promote(entries: DataFrame, by: Sequence[str], reorderable: Column) -> DataFrame:
    """Order of entries within a section: best first where it may be reordered, else as written; ties keep their order."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.when(reorderable, -F.col("entry_score")).otherwise(0.0), "pos"))
    return entries.withColumn("place", rank)


def kept_within(entry: Sequence, pos: Sequence, relevance: Sequence[float], covered: Sequence[Sequence[str]], pinned: Sequence[bool], budget: int) -> list[int]:
    """Rows that stay, by select_within's rule. Dropping a bullet never makes another cheaper, so a heap of old costs is enough: a cost
    is brought up to date when it comes to the top."""
    n = len(entry)
    entries, skills = Counter(entry), Counter(s for c in covered for s in c)
    owed = [Counter(c) for c in covered]

    def cost(i: int) -> float:
        return 0.5 + relevance[i] + 1.5 * sum(m for s, m in owed[i].items() if skills[s] == 1) + 100 * (entries[entry[i]] == 1)

    heap = [(cost(i), -pos[i], i) for i in range(n) if not pinned[i]]
    heapify(heap)
    gone, left = set(), n
    while heap and left > budget:
        old, place, i = heappop(heap)
        if (now := cost(i)) > old:
            heappush(heap, (now, place, i))
            continue
        gone.add(i)
        left -= 1
        entries[entry[i]] -= 1
        skills.subtract(owed[i])
    return [i for i in range(n) if i not in gone]


def select_within(scored: DataFrame, budget: int) -> DataFrame:
    """Bullets that stay when the cheapest is dropped again and again until `budget` of a (résumé, posting) are left.

    A bullet costs 0.5 + relevance, 1.5 per skill that it alone covers, and 100 if it is the last of its entry;
    pinned ones stay; of equals the later goes. The choice is sequential, but a group is the bullets of one résumé.
    scored: url, bullet, entry, pos, relevance, covered, pinned.
    """
    kind = dict(scored.dtypes)

    def run(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_pylist() for c in ("entry", "pos", "relevance", "covered", "pinned")]
        stays = kept_within(*columns, budget)
        return group.select(["url", "bullet"]).take(pa.array(stays, pa.int64()))

    return scored.groupBy("url").applyInArrow(run, f"url {kind['url']}, bullet {kind['bullet']}")


def coverage_report(kept: DataFrame, scored: DataFrame, demands: DataFrame) -> DataFrame:
    """(url, required, covered, missing): demanded skills that the kept bullets cover, and the others, must-haves first."""
    covered = kept.join(scored.select("url", "bullet", "covered"), ["url", "bullet"]).groupBy("url").agg(F.array_distinct(F.flatten(F.collect_list("covered"))).alias("has"))
    asked = demands.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("emphasis", "skill"))).alias("asked"))
    joined = asked.join(covered, "url", "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    names = F.transform("asked", lambda a: a["skill"])
    return joined.select("url", F.size("asked").alias("required"), F.size(F.array_intersect(names, "has")).alias("covered"), F.array_join(F.array_except(names, "has"), ",").alias("missing"))


def apply_overrides(parts: DataFrame, overrides: DataFrame) -> DataFrame:
    """Parts (id, text, pos, included) with a variant's own inclusion, wording and order; parts without a place come last."""
    o = overrides.select("id", F.col("included").alias("_in"), F.col("text").alias("_text"), F.col("place").alias("_place"))
    joined = parts.join(o, "id", "left")
    return joined.select("id", F.coalesce("_text", "text").alias("text"), F.coalesce("_in", "included").alias("included"), F.struct(F.coalesce("_place", F.lit(2**31 - 1)).alias("place"), F.col("pos").alias("pos")).alias("order"))


def tidy_overrides(overrides: DataFrame, parts: DataFrame) -> DataFrame:
    """Rewordings equal to the master text or of parts that are gone are dropped."""
    same = parts.select("id", F.col("text").alias("master"))
    return overrides.join(same, "id").where(~F.col("text").eqNullSafe(F.col("master"))).drop("master")
