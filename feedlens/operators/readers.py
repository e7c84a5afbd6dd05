"""The best listings of many readers at once, without meeting every reader with every listing.

What a reader adds to a score depends on few columns of a listing: whether it is an opportunity, its discipline, level, interests and places.
Listings that agree in these are a class; within a class all readers have the same order, that of the static score, so its best k rows
are all that can matter. Readers who want the same are one taste. A taste walks the classes by static score and stops when the
next one could not reach its k-th score with every bonus there is (a threshold algorithm); it scores a block of classes by arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feedlens.functions import dictionaries as D
from feedlens.operators import ranking as R
from feedlens.sources.shared import stored

#: Columns that make a class, and those that make a taste.
CLASS = ("opp", "discipline", "seniority", "matched_interests", "location_tags")
TASTE = ("major", "interests", "home", "levels")
#: Classes that a task holds at a time, and that are scored between two looks at the threshold.
BLOCK, STEP = 20_000, 1024


def weights_over_defaults(json: Column, defaults: R.Weights = R.Weights()) -> Column:
    """A struct of all weights from a JSON text that may name some; others, and all of a text that cannot be read, keep their defaults."""
    names = [f.name for f in fields(R.Weights)]
    read = F.from_json(json.cast("string"), ", ".join(f"{n} double" for n in names))
    return F.struct(*(F.coalesce(read[n], F.lit(float(getattr(defaults, n)))).alias(n) for n in names))


def static_scores(items: DataFrame, weights: R.Weights, as_of: Column) -> DataFrame:
    """Classified items with `static`, the part of the score that no reader changes, to six places."""
    nobody = R.Profile(major="", weights=weights)
    bare = items.withColumns({"_interests": F.col("matched_interests"), "matched_interests": F.array().cast("array<string>")})
    scored = R.pass_one(bare, nobody, as_of)
    sorted_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    return scored.select(
        "url", F.round("score", 6).alias("static"), F.coalesce(R.is_opportunity(F.col("item_type")), F.lit(False)).alias("opp"), "discipline", "seniority",
        sorted_set("_interests").alias("matched_interests"), sorted_set("location_tags").alias("location_tags"),
    )


def class_heads(static: DataFrame, k: int) -> DataFrame:
    """One row per class: its best static score and its best k (static, url), the best first. Each task keeps k rows of a class before the shuffle."""
    best = R.keep_per_group(static, CLASS, [F.desc("static"), F.asc("url")], k)
    heads = F.array_sort(F.collect_list(F.struct((-F.col("static")).alias("minus"), "url")))
    return best.groupBy(*CLASS).agg(F.max("static").alias("top"), heads.alias("heads"))


@dataclass
class Block:
    """Classes by falling static score, as arrays."""

    top: np.ndarray
    heads: list[list[tuple[float, str]]]
    opp: np.ndarray
    discipline: list[str | None]
    level: list[str | None]
    interests: dict[str, np.ndarray]
    places: dict[str, np.ndarray]


def block_of(rows: Sequence) -> Block:
    rows = sorted(rows, key=lambda r: -r["top"])
    n = len(rows)

    def marks(column: str) -> dict[str, np.ndarray]:
        found: dict[str, np.ndarray] = {}
        for i, r in enumerate(rows):
            for value in r[column]:
                found.setdefault(value, np.zeros(n, bool))[i] = True
        return found

    return Block(
        np.array([r["top"] for r in rows]), [[(-h["minus"], h["url"]) for h in r["heads"]] for r in rows], np.array([r["opp"] for r in rows], bool),
        [r["discipline"] for r in rows], [r["seniority"] for r in rows], marks("matched_interests"), marks("location_tags"),
    )


def level_fit(level: str | None, wanted: set[str]) -> float:
    if level is None or not wanted:
        return 0.0
    return 1.0 if level in wanted else 0.25 if wanted & set(D.ADJACENT_LEVELS.get(level, ())) else -1.0


def best_of(block: Block, w: R.Weights, major: str | None, interests: Sequence[str], home: str | None, levels: Sequence[str], k: int) -> list[tuple[float, str]]:
    """The k best (score, url) of a taste in a block, equal scores by url."""
    wanted, liked = set(levels), set(interests)
    most = max(w.major, 0) + max(min(w.interest_cap, w.interest * len(liked)), 0) + max(w.seniority, 0) + max(w.location, 0)
    fits = {level: w.seniority * level_fit(level, wanted) for level in set(block.level)}
    found: list[tuple[float, str]] = []
    for a in range(0, len(block.top), STEP):
        if len(found) == k and block.top[a] + most < -found[-1][0] - 1e-9:
            break
        b = slice(a, a + STEP)
        count = sum((block.interests[x][b].astype(int) for x in liked if x in block.interests), np.zeros(len(block.top[b]), int))
        bonus = np.minimum(count * w.interest, w.interest_cap)
        bonus = bonus + np.array([w.major if d is not None and d == major else 0.0 for d in block.discipline[b]])
        bonus = bonus + block.opp[b] * np.array([fits[x] for x in block.level[b]])
        if home and home in block.places:
            bonus = bonus + w.location * block.places[home][b]
        score = np.round(block.top[b] + bonus, 6)
        floor = -found[-1][0] if len(found) == k else -np.inf
        for i in np.flatnonzero(score >= floor):
            found += [(-round(s + float(bonus[i]), 6), url) for s, url in block.heads[a + i]]
        found = sorted(found)[:k]
    return [(-s, url) for s, url in found]


def top_of_readers(items: DataFrame, readers: DataFrame, as_of: Column, weights: R.Weights = R.Weights(), k: int = 10) -> DataFrame:
    """(reader_id, rank, url, score): the k best listings of each reader, by score without urgency and then url.

    items: classified ones (see ranking.derive), with all interests of the dictionary in matched_interests. readers: reader_id, major, interests, home,
    levels; null lists are empty, a null major or home matches nothing. Readers of the same taste share one walk. Classes go to the tasks in
    blocks of BLOCK rows; a block's results are stored before the next is read.
    """
    heads = stored(class_heads(static_scores(items, weights, as_of), k), "classes")
    blank = F.array().cast("array<string>")
    listed = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), blank)))
    wants = readers.select("reader_id", "major", listed("interests").alias("interests"), "home", listed("levels").alias("levels"))
    wants = stored(wants.withColumn("taste", F.xxhash64(F.to_json(F.struct(*TASTE)))), "readers")
    tastes = wants.groupBy("taste", *TASTE).agg(F.lit(1).alias("_n"))
    parts = None
    for block in _blocks(heads):
        one = stored(_walk(tastes, block, weights, k), "best")
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        parts = tastes.where("false").select("taste", *TASTE, F.lit("").alias("url"), F.lit(0.0).alias("score"))
    ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("taste", *TASTE).orderBy(F.desc("score"), "url"))).where(F.col("rank") <= k)
    same = [wants[c].eqNullSafe(ranked[c]) for c in TASTE]
    joined = wants.join(ranked, (wants["taste"] == ranked["taste"]) & same[0] & same[1] & same[2] & same[3])
    return joined.select("reader_id", "rank", "url", "score")


def _blocks(heads: DataFrame) -> Iterator[Block]:
    rows = []
    for row in heads.toLocalIterator():
        rows.append(row)
        if len(rows) == BLOCK:
            yield block_of(rows)
            rows = []
    if rows:
        yield block_of(rows)


def _walk(tastes: DataFrame, block: Block, weights: R.Weights, k: int) -> DataFrame:
    kinds = dict(tastes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, urls, scores = [], [], []
            for i, row in enumerate(batch.to_pylist()):
                for score, url in best_of(block, weights, row["major"], row["interests"], row["home"], row["levels"], k):
                    at.append(i)
                    urls.append(url)
                    scores.append(score)
            kept = batch.select(["taste", *TASTE]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(urls, pa.string()), pa.array(scores, pa.float64())], names=["taste", *TASTE, "url", "score"])

    return tastes.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("taste", *TASTE)) + ", url string, score double")
