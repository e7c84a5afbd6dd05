"""What stays in the cache: scopes, misses, the sweep, ledgers and board health."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


@dataclass(frozen=True)
class Retention:
    """Limits of the sweep, in misses, hours and days."""

    miss_limit: int = 3
    miss_gap_hours: int = 24
    opportunity_grace: int = 7
    event_grace: int = 1
    backstop: int = 21
    article_age: int = 60


def days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def alive_scopes(seen: DataFrame, policy: DataFrame, failed: DataFrame) -> DataFrame:
    """Scopes that a run vouches for: boards by (source, company), listings by source, samples by none; failed sources by
    none. policy: (source, policy); failed: (source)."""
    rows = seen.join(policy, "source").join(failed, "source", "left_anti").where("policy = 'listing' OR policy = 'boards' AND company IS NOT NULL")
    return rows.select("source", F.when(F.col("policy") == "boards", F.col("company")).alias("company")).distinct()


def charge_misses(items: DataFrame, alive: DataFrame, run_start: Column) -> DataFrame:
    """missed + 1 for non-articles unseen in this run within a scope that is alive. The null company is a wildcard: two
    equi joins take its place."""
    whole = alive.where("company IS NULL").select(F.col("source").alias("_s1")).distinct()
    exact = alive.where("company IS NOT NULL").select(F.col("source").alias("_s2"), F.col("company").alias("_c2")).distinct()
    joined = items.join(whole, items["source_platform"] == F.col("_s1"), "left").join(exact, (items["source_platform"] == F.col("_s2")) & (items["company"] == F.col("_c2")), "left")
    hit = (F.col("_s1").isNotNull() | F.col("_s2").isNotNull()) & (F.col("item_type") != "Article") & (F.col("last_seen") < run_start)
    return joined.withColumn("missed", F.col("missed") + hit.cast("int")).drop("_s1", "_s2", "_c2")


def sweep_reason(now: Column, run_start: Column, start_dated: Sequence[str], r: Retention = Retention()) -> Column:
    """Why a row leaves, the first reason that holds; null if it stays. closes_at is the effective deadline."""
    kind = F.col("item_type")
    return (
        F.when((kind != "Article") & (F.col("missed") >= r.miss_limit) & (F.col("last_seen") < run_start - F.make_dt_interval(hours=F.lit(r.miss_gap_hours))), "vanished")
        .when(kind.isin("Job", "Internship") & (F.col("closes_at") < now - days(r.opportunity_grace)), "closed")
        .when((kind == "Event") & (F.col("closes_at") < now - days(r.event_grace)), "ended")
        .when((kind == "Event") & F.col("closes_at").isNull() & F.col("source_platform").isin(*start_dated) & (F.col("ts") < now - days(r.event_grace)), "ended")
        .when((kind != "Article") & (F.col("last_seen") < now - days(r.backstop)), "stale")
        .when((kind == "Article") & (F.col("ts") < now - days(r.article_age)), "articles")
    )


def record_runs(runs: DataFrame) -> DataFrame:
    """Ledger per source: the last run's facts, and the last time it was fine."""
    last = F.max_by(F.struct("ok", "last_count", "last_error"), "run_at").alias("r")
    return runs.groupBy("source").agg(last, F.max("run_at").alias("last_run_at"), F.max(F.when(F.col("ok"), F.col("run_at"))).alias("last_ok_at")).select("source", "r.*", "last_run_at", "last_ok_at")


def due(registry: DataFrame, ledger: DataFrame, as_of: Column, retry_minutes: int = 15, forced: bool = False) -> DataFrame:
    """Enabled sources that are forced, never ran, or are older than their ttl_minutes (retry_minutes after a failure)."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_run_at").cast("timestamp"))) / 60_000_000
    limit = F.when(F.col("ok"), F.col("ttl_minutes")).otherwise(F.lit(retry_minutes))
    return registry.join(ledger, "source", "left").where(F.col("enabled") & (F.lit(forced) | F.col("last_run_at").isNull() | (age >= limit)))


#: So many spans of time are joined into one at a time, three times over; the last join has a row per 4,096 gaps of a board.
SPANS = 64
#: Joined spans and limits that a task hands on at a time.
HELD = 4096
_SPAN = "first long, reset boolean, offs array<long>, n array<long>, last array<long>, none_n long, none_last long"


def _join_spans(spans: list[dict], gap: int) -> dict:
    """One span for several in time order.

    A span tells what becomes of a board that enters it: offs are rising limits of the last strike's offset in the gap
    before the span's first one, n and last what is counted up to that limit. none_n and none_last hold beyond the
    limits. A board whose last strike is older takes the first limit. A span with a reset has one outcome for all.
    """
    out = spans[0]
    for b in spans[1:]:
        if b["reset"]:
            out = b | {"first": out["first"]}
            continue
        exits = [*zip(b["n"], b["last"], strict=True), (b["none_n"], b["none_last"])]

        def after(n: int, last: int | None, b: dict = b, exits: list = exits) -> tuple[int, int | None]:
            near = last is not None and last // gap == b["first"] - 1
            more, at = exits[bisect_left(b["offs"], last % gap) if near else 0]
            return n + more, last if at is None else at

        ends = [after(n, last) for n, last in zip(out["n"], out["last"], strict=True)]
        kept = [k for k in range(len(ends)) if k + 1 == len(ends) or ends[k] != ends[k + 1]]
        none_n, none_last = after(out["none_n"], out["none_last"])
        out = {
            "first": out["first"], "reset": out["reset"], "offs": [out["offs"][k] for k in kept],
            "n": [ends[k][0] for k in kept], "last": [ends[k][1] for k in kept], "none_n": none_n, "none_last": none_last,
        }
    return out


def _fold_spans(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    """One span for each group of spans. A group's rows follow one another in time order, also over batches; its first has _n = 1."""
    schema, out, done, held = None, None, [], 0
    for batch in batches:
        schema = batch.schema.remove(batch.schema.get_field_index("_n"))
        for at in range(0, batch.num_rows, SPANS):
            for row in batch.slice(at, SPANS).to_pylist():
                if row.pop("_n") > 1:
                    out = _join_spans([out, row], gap) | {"_key": row["_key"]}
                    continue
                if out is not None:
                    done.append(out)
                    held += 1 + len(out["offs"])
                out = row
            if held >= HELD:
                yield pa.RecordBatch.from_pylist(done, schema)
                done, held = [], 0
    if out is not None:
        yield pa.RecordBatch.from_pylist([*done, out], schema)


def strikes(answers: DataFrame, key: str, ts: str, answer: str, gap_hours: int = 24) -> DataFrame:
    """Board health: a Gone or Empty answer counts as a strike when the last counted one is gap_hours old; Rows reset.

    Within one gap of the clock at most one answer counts, so a board's answers become a span per gap with its distinct
    seconds, and neighbouring spans are joined as they stream through a task in order, those before a reset not at all. No
    row or group holds the answers of more than a bounded time. Answers without a time come first and count each.
    """
    gap = gap_hours * 3600
    if gap <= 0:
        raise ValueError("gap_hours must be positive")
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    rows = answers.select(F.col(key).alias("_key"), F.pmod(seconds, F.lit(gap)).alias("_off"), seconds.alias("_t"), F.col(answer).alias("_a"))
    rows = rows.withColumn("_first", ((F.col("_t") - F.col("_off")) / gap).cast("long"))
    struck = F.col("_a").isin("Gone", "Empty")
    rows_at = F.max(F.when(F.col("_a") == "Rows", F.coalesce("_off", F.lit(0))))  # Rows stand last within a second
    per_gap = rows.groupBy("_key", "_first").agg(
        rows_at.alias("_rows"), F.array_sort(F.collect_set(F.when(struck, F.col("_off")))).alias("_offs"), F.count_if(struck & F.col("_t").isNull()).alias("_undated")
    )
    per_gap = per_gap.withColumn("_offs", F.when(F.col("_rows").isNull(), F.col("_offs")).otherwise(F.filter("_offs", lambda o: o > F.col("_rows"))))
    in_part = W.partitionBy("_key", F.floor(F.col("_first") / SPANS))
    per_gap = per_gap.withColumn("_cut", F.max(F.when(F.col("_rows").isNotNull(), F.col("_first"))).over(in_part)).where("_cut IS NULL OR _first >= _cut")
    per_gap = per_gap.withColumn("_n", F.row_number().over(in_part.orderBy("_first")))
    reset, some, at = F.col("_rows").isNotNull(), F.size("_offs") > 0, lambda o: F.col("_first") * gap + o
    none = F.array().cast("array<long>")
    spans = per_gap.select(
        "_key",
        "_n",
        F.col("_first").alias("first"),
        reset.alias("reset"),
        F.when(reset, none).otherwise(F.col("_offs")).alias("offs"),
        F.when(reset, none).otherwise(F.transform("_offs", lambda o: F.lit(1).cast("long"))).alias("n"),
        F.when(reset, none).otherwise(F.transform("_offs", at)).alias("last"),
        F.when(reset, some.cast("long")).otherwise(F.col("_undated")).alias("none_n"),
        F.when(reset & some, at(F.get("_offs", F.lit(0)))).alias("none_last"),
    )
    schema = T.StructType([T.StructField("_key", answers.schema[key].dataType), *T.StructType.fromDDL(_SPAN)])
    spans = spans.mapInArrow(lambda batches: _fold_spans(batches, gap), schema)
    for part in ([F.floor(F.col("first") / SPANS**2)], []):
        numbered = spans.withColumn("_n", F.row_number().over(W.partitionBy("_key", *part).orderBy("first")))
        spans = numbered.mapInArrow(lambda batches: _fold_spans(batches, gap), schema)
    first = lambda many, other: F.coalesce(F.get(many, F.lit(0)), F.col(other))
    return spans.select(F.col("_key").alias(key), first("n", "none_n").cast("int").alias("strikes"), first("last", "none_last").alias("last_strike"))


def marks(events: DataFrame, keys: Sequence[str], flag: str, on: str, ts: str) -> DataFrame:
    """Per key the moment of each flag's last event where that set it, one column per flag; null where unset."""
    at = lambda f: F.max_by(F.when(F.col(on), F.col(ts)), F.when(F.col(flag) == f, F.col(ts)))
    return events.groupBy(*keys).agg(*(at(f).alias(f"{f}_at") for f in ("saved", "dismissed", "seen")))


def transitions(events: DataFrame, keys: Sequence[str], status: str, order: Column) -> DataFrame:
    """Events at which the status changes; their time is the row's updated_at."""
    from pyspark.sql.window import Window as W

    before = F.lag(status).over(W.partitionBy(*keys).orderBy(order))
    return events.withColumn("_before", before).where(~F.col(status).eqNullSafe(F.col("_before"))).drop("_before")


def prune_orphans(details: DataFrame, items: DataFrame, saved: DataFrame) -> DataFrame:
    """Details whose url is neither cached nor saved are dropped."""
    return details.join(items.select("url").unionByName(saved.select("url")).distinct(), "url", "left_semi")
