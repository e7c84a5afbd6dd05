"""The end of a run, search watermarks, pasted postings, routes of postings and reports over all of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.operators import liveness as L
from feedlens.operators import pages, ranking, reports, saved, textmine
from feedlens.sources.shared import stored


@dataclass(frozen=True)
class Finished:
    """What the end of a run leaves. reasons: url and reason of the items that were swept."""

    items: DataFrame
    reasons: DataFrame
    states: DataFrame
    details: DataFrame
    boards: DataFrame
    last_refresh: Column


def finish_run(
    items: DataFrame, states: DataFrame, details: DataFrame, alive: DataFrame, known: DataFrame, profile: ranking.Profile, now: Column, run_start: Column, refreshed: Column,
    start_dated: Sequence[str], hosts: dict[str, str], complete: bool, ceiling: int = 40_000,
) -> Finished:
    """Caps the opportunities, finds new boards, sweeps, then prunes states (saved ones stay) and details of what is gone.

    items are classified; alive: (source, company), see alive_scopes. last_refresh is `now` if the run is complete, else as it
    was. Items are stored once after the cap and read from there by sweep and prunes.
    """
    kept = ranking.cap_opportunities(items, profile, ceiling)
    judged = stored(L.charge_misses(kept, alive, run_start).withColumn("_reason", L.sweep_reason(now, run_start, start_dated)), "judged")
    left = judged.where("_reason IS NULL").drop("_reason")
    boards = reports.discover_boards(judged.select("url"), hosts, known)
    keeps = states.where("saved_at IS NOT NULL")
    others = states.where("saved_at IS NULL").join(left.select("url"), "url", "left_semi")
    return Finished(
        left, judged.where("_reason IS NOT NULL").select("url", F.col("_reason").alias("reason")), keeps.unionByName(others), L.prune_orphans(details, left, keeps),
        boards, now if complete else refreshed,
    )


def open_searches(searches: DataFrame, opens: DataFrame) -> DataFrame:
    """searches (search, viewed_at, ...) with viewed_at moved on to the last time a search was opened; never back."""
    last = opens.groupBy("search").agg(F.max("at").alias("_at"))
    return searches.join(last, "search", "left").withColumn("viewed_at", F.greatest("viewed_at", "_at")).drop("_at")


def current_year(rows: DataFrame, as_of: Column, order: Sequence[Column], year: str = "year", not_open: str = "not_open", most: int = 25) -> DataFrame:
    """The first `most` rows of the year of as_of whose applications are open."""
    return rows.where((F.col(year) == F.year(as_of)) & ~F.coalesce(F.col(not_open), F.lit(False))).orderBy(*order).limit(most)


def pasted_details(pasted: DataFrame, most: int = 8000) -> DataFrame:
    """Details of pasted postings (url, text): their lines by section."""
    return pages.assemble_detail(textmine.sections(textmine.text_blocks(pasted, "url", "text")), most)


def pasted_items(pasted: DataFrame, details: DataFrame, chars: int = 280) -> DataFrame:
    """Pasted postings (url, title, company, text, created_at) as items with their details; newest first."""
    items = pasted.select("url", "title", "company", F.lit("Pasted").alias("source_platform"), F.lit("Job").alias("item_type"), F.substring("text", 1, chars).alias("content_text"), F.col("created_at").alias("ts"))
    return items.join(details, "url", "left").orderBy(F.desc("ts"), "url")


def delete_pasted(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables (pasted postings, their details and states) without the urls that are deleted."""
    urls = gone.select("url").distinct()
    return [t.join(urls, "url", "left_anti") for t in tables]


def read_details(raw: DataFrame, url: str | None = None) -> DataFrame:
    """Stored details (url, status, payload): texts that are missing or corrupt are null, tags then empty. url: only that one,
    so that the filter reaches the scan."""
    p = F.from_json("payload", ", ".join(f"{c} string" for c in saved.TEXTS) + ", tags array<string>")
    rows = (raw if url is None else raw.where(F.col("url") == url)).select("url", "status", p.alias("p"))
    return rows.select("url", "status", *(f"p.{c}" for c in saved.TEXTS), F.coalesce("p.tags", F.array().cast("array<string>")).alias("tags"))


#: Hosts whose pages hold no posting metadata.
NO_METADATA = (
    "greenhouse.io", "jobs.lever.co", "smartrecruiters.com", "apply.workable.com", "eightfold.ai", "jobbank.gc.ca", "linkedin.com", "lifeattiktok.com",
    "bytedance.com", "oraclecloud.com", "ats.rippling.com",
)


def posting_route(url: Column, mirror_id: Column) -> Column:
    """Handlers to try for a posting, best first, as (handler, params): its board's own interface, the page, the mirror.

    Empty means that nothing serves it. params: the parts of the url that the handler needs, in order.
    """
    host = F.regexp_extract(url, "^https?://([^/]+)", 1)
    path = F.regexp_extract(url, "^https?://[^/]+(/.*)$", 1)
    segments = F.filter(F.split(F.regexp_extract(path, "^[^?]*", 0), "/"), lambda x: x != "")
    part = lambda i: F.get(segments, i if isinstance(i, Column) else F.lit(i))
    at = lambda name: F.array_position(segments, name).cast("int")  # from 1, 0 if missing

    def handler(name: str, *params: Column) -> Column:
        whole = F.lit(True)
        for p in params:
            whole = whole & p.isNotNull() & (p != "")
        return F.when(whole, F.struct(F.lit(name).alias("handler"), F.array(*params).alias("params")))

    behind = lambda name, by: F.when(at(name) + by >= 1, part(at(name) - 1 + by))
    near = lambda name, by: F.when(at(name) > 0, behind(name, by))
    rest = F.when(at("job") > 0, F.array_join(F.slice(segments, at("job") + 1, F.greatest(F.size(segments) - at("job"), F.lit(0))), "/"))
    recruiting = part(0) == "recruiting"
    site = F.when(recruiting, part(2)).otherwise(near("job", -1))
    tenant = F.when(recruiting, part(1)).otherwise(F.substring_index(host, ".", 1))
    number = F.regexp_extract(url, r"^https?://(?:[^/]*\.)?linkedin\.com/jobs/view/(?:[^/?#]*-)?(\d+)/*(?:[?#].*)?$", 1)
    own = (
        F.when(host.endswith("greenhouse.io"), handler("greenhouse", near("jobs", -1), near("jobs", 1)))
        .when(host == "jobs.lever.co", handler("lever", part(0), part(1)))
        .when(host == "jobs.smartrecruiters.com", handler("smartrecruiters", part(0), F.when(part(1).rlike("^[0-9]*$"), part(1))))
        .when(host.endswith(".myworkdayjobs.com") | host.endswith(".myworkdaysite.com"), handler("workday", host, tenant, site, rest))
        .when(host == "apply.workable.com", handler("workable", part(0), near("j", 1)))
        .when(host.endswith(".eightfold.ai"), handler("eightfold", host, near("job", 1)))
        .when(host.endswith("jobbank.gc.ca") & path.contains("/jobsearch/jobposting"), handler("job bank", url))
        .when(number != "", handler("linkedin", number))
    )
    bare = F.lit(False)
    for h in NO_METADATA:
        bare = bare | host.endswith(h)
    listing = F.array_contains(F.split(path, "[/?&]"), "search") | url.contains("keyword=") | url.contains("base_query=")
    page = F.when((host != "") & ~bare & ~listing, handler("schema.org", url))
    return F.array_compact(F.array(own, page, F.when(mirror_id != "", handler("mirror", mirror_id))))


def route_report(routed: DataFrame) -> DataFrame:
    """(report, value, n) over rows with a url and a route: leading handlers, lengths of chains, hosts that nothing serves."""
    lead = F.coalesce(F.get("route", F.lit(0))["handler"], F.lit("unsupported"))
    kinds = F.array(
        F.struct(F.lit("lead").alias("report"), lead.alias("value")), F.struct(F.lit("length").alias("report"), F.size("route").cast("string").alias("value")),
        F.struct(F.lit("unrouted").alias("report"), F.when(F.size("route") == 0, F.regexp_extract("url", "^https?://([^/]+)", 1)).alias("value")),
    )
    return routed.select(F.inline(kinds)).where("value IS NOT NULL").groupBy("report", "value").agg(F.count(F.lit(1)).alias("n"))


def board_tally(boards: DataFrame) -> DataFrame:
    """Per family the boards that are live, empty and dead, and their postings. boards: family, answer, postings."""
    n = lambda a: F.count_if(F.col("answer") == a)
    return boards.groupBy("family").agg(n("Rows").alias("live"), n("Empty").alias("empty"), n("Gone").alias("dead"), F.sum("postings").alias("postings"))


def detail_coverage(details: DataFrame) -> DataFrame:
    """Per handler and status the details and the shares of them that hold each text."""
    filled = lambda c: F.avg((F.trim(F.coalesce(F.col(c), F.lit(""))) != "").cast("double")).alias(c)
    return details.groupBy("handler", "status").agg(F.count(F.lit(1)).alias("n"), *(filled(c) for c in saved.TEXTS))


def corpus_report(items: DataFrame) -> DataFrame:
    """Items per kind and how many of them have an empty summary."""
    return items.groupBy("item_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("content_text", F.lit(""))) == "").alias("empty"))


def calibration(ranked: DataFrame, as_of: Column, tops: Sequence[int] = (600, 2000)) -> DataFrame:
    """One row: percentiles of the merit of roles, rows that close within a week and those flagged, and how many of the best
    roles have a known deadline."""
    roles = ranked.where(ranking.is_opportunity(F.col("item_type"))).withColumn("_all", F.lit(1))
    out = ranking.nearest_rank(roles, ["_all"], "merit", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "top": 1.0})
    soon = ranking.kind_of(F.col("item_type")).isNotNull() & F.col("closes_at").between(as_of, as_of + L.days(7))
    out = out.join(ranked.agg(F.lit(1).alias("_all"), F.count_if(soon).alias("closing"), F.count_if(soon & F.col("last_call")).alias("flagged")), "_all")
    for n in tops:
        best = roles.orderBy(F.desc("merit"), "url").limit(n)
        out = out.join(best.agg(F.lit(1).alias("_all"), F.count("closes_at").alias(f"known_{n}")), "_all")
    return out.drop("_all")


def queue_overlap(ranked: DataFrame, attempted: DataFrame, as_of: Column, routable: Column, budget: int = 600) -> DataFrame:
    """(queue, fetches, reached): of the best `budget` open roles by merit, how many the feed's order and the detail queue reach
    with as many fetches. Only routable rows are fetched."""
    fresh = ranked.where(ranking.is_opportunity(F.col("item_type"))).join(attempted.select("url").distinct(), "url", "left_anti")
    fresh = stored(fresh.select("url", "item_type", "merit", "score", "company", "source_platform", "closes_at", routable.alias("_ok")), "fresh")
    best = saved.detail_candidates(fresh.where("_ok"), attempted.limit(0), as_of).orderBy(F.desc("merit"), "url").limit(budget).select("url", F.lit(1).alias("_best"))
    by_feed = ranking.feed(fresh, budget * 8).where("_ok").orderBy("position").limit(budget).select("url", F.lit("feed").alias("queue"))
    by_merit = saved.detail_queue(saved.detail_candidates(fresh, attempted.limit(0), as_of), budget * 8).where("_ok").orderBy("position").limit(budget).select("url", F.lit("merit").alias("queue"))
    return by_feed.unionByName(by_merit).join(best, "url", "left").groupBy("queue").agg(F.count(F.lit(1)).alias("fetches"), F.count("_best").alias("reached"))
