"""Preference gates, views of the list and their bands."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feedlens.functions import dates
from feedlens.operators.ranking import is_opportunity, keep_per_group


@dataclass(frozen=True)
class Wanted:
    """What a reader wants to see."""

    internships: bool = True
    jobs: bool = True
    news: bool = True
    events: bool = True
    disabled: Sequence[str] = ()


def is_internship() -> Column:
    return (F.col("item_type") == "Internship") | F.coalesce(F.col("seniority") == "Intern", F.lit(False))


def admits(w: Wanted) -> Column:
    """Whether preferences let an item in: its source is on and its kind is wanted."""
    kind = F.col("item_type")
    ok = (
        F.when(kind == "Article", F.lit(w.news)).when(kind == "Event", F.lit(w.events))
        .when(is_opportunity(kind), F.when(is_internship(), F.lit(w.internships)).otherwise(F.lit(w.jobs))).otherwise(F.lit(True))
    )
    return ok & ~F.col("source_platform").isin(*w.disabled) if w.disabled else ok


def category_enabled(category: Column, w: Wanted) -> Column:
    """Sources of opportunities run when either kind of them is wanted."""
    return F.when(category == "Article", F.lit(w.news)).when(category == "Event", F.lit(w.events)).otherwise(F.lit(w.internships or w.jobs))


def source_enabled(source: Column, category: Column, w: Wanted) -> Column:
    on = category_enabled(category, w)
    return on & ~source.isin(*w.disabled) if w.disabled else on


def passes_board_gate(whole_board: Column, worth: Column) -> Column:
    """Only rows of sources that read whole boards are judged by worth."""
    return ~whole_board | worth


def fresh_unseen(as_of: Column, hours: int = 24) -> Column:
    return ~F.col("seen") & (F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def upcoming(as_of: Column) -> Column:
    return (F.col("item_type") == "Event") & (dates.event_date(F.col("closes_at"), F.col("ts")) >= as_of)


#: Stages of an application that is under way.
ACTIVE = ("applied", "interviewing", "offer")


def saved_view(kinds: Sequence[str], stage: str = "any", status: str = "status") -> Column:
    """Saved rows of the kinds at a stage: any, none, active or the name of one."""
    c = F.col(status)
    at = {"any": F.lit(True), "none": c.isNull(), "active": F.coalesce(c.isin(*ACTIVE), F.lit(False))}.get(stage, F.coalesce(c == stage, F.lit(False)))
    return F.col("saved") & F.col("item_type").isin(*kinds) & at


def paced_budget(rows: DataFrame, order: Sequence[Column], handler: str, paced: Sequence[str], budget: int = 600, per_handler: int = 30) -> DataFrame:
    """The first `budget` rows with a handler; of each paced one at most per_handler, and the rest of it uses no budget."""
    slow = F.col(handler).isin(*paced)
    met = rows.where(F.col(handler).isNotNull())
    few = keep_per_group(met.where(slow), [handler], order, per_handler)
    return few.unionByName(met.where(~slow)).orderBy(*order).limit(budget)


def hero_and_bands(roles: DataFrame, order: Sequence[Column], top: int = 3, more: int = 12) -> DataFrame:
    """(url, band): the hero is the first unseen role, else the first; of the others `top` and then `more`."""
    first = roles.orderBy(F.col("seen").asc(), *order).limit(1).select("url", F.lit("hero").alias("band"))
    rest = roles.join(F.broadcast(first.select("url")), "url", "left_anti").orderBy(*order).limit(top + more)  # one row
    n = F.row_number().over(W.orderBy(*order))  # over top + more rows
    return first.unionByName(rest.select("url", F.when(n <= top, "top").otherwise("more").alias("band")))


def palette_groups(hits: DataFrame, most: int = 6) -> DataFrame:
    """The best of roles and of other hits, by tier and score, with the totals of both groups. hits: url, group, tier, score."""
    totals = hits.groupBy("group").agg(F.count(F.lit(1)).alias("total"))
    best = keep_per_group(hits, ["group"], [F.desc("tier"), F.desc("score"), F.asc("url")], most)
    return best.join(F.broadcast(totals), "group")  # a row per group


def today_stats(items: DataFrame, as_of: Column, fresh_hours: int = 24) -> DataFrame:
    """One row: fresh, open_roles, closing within a week and saved."""
    opp, closes = is_opportunity(F.col("item_type")), F.col("closes_at")
    return items.agg(
        F.count_if(fresh_unseen(as_of, fresh_hours)).alias("fresh"), F.count_if(opp & F.coalesce(closes >= as_of, F.lit(True))).alias("open_roles"),
        F.count_if(closes.between(as_of, as_of + F.make_dt_interval(days=F.lit(7)))).alias("closing"), F.count_if("saved").alias("saved"),
    )


def tailoring_candidates(roles: DataFrame, match: Column) -> DataFrame:
    """(url, priority): saved roles first, then those that match."""
    opp = roles.where(is_opportunity(F.col("item_type")))
    return opp.where(F.col("saved") | F.coalesce(match, F.lit(False))).select("url", F.when(F.col("saved"), 0).otherwise(1).alias("priority"))


def home_widgets(items: DataFrame, news_sources: Sequence[str], least: float = 10.0, articles: int = 3) -> DataFrame:
    """(widget, position, value): the first opportunity that scores `least`, the first articles of named sources, and all
    sources and disciplines in order. items are in the order of score and url."""
    order = [F.desc("score"), F.asc("url")]
    top = items.where(is_opportunity(F.col("item_type")) & (F.col("score") >= least)).orderBy(*order).limit(1).select(F.lit("opportunity").alias("widget"), F.lit(1).alias("position"), F.col("url").alias("value"))
    news = items.where((F.col("item_type") == "Article") & F.col("source_platform").isin(*news_sources)).orderBy(*order).limit(articles)
    out = top.unionByName(news.select(F.lit("article").alias("widget"), F.row_number().over(W.orderBy(*order)).alias("position"), F.col("url").alias("value")))  # over `articles` rows
    for name, c in (("source", "source_platform"), ("discipline", "discipline")):
        values = items.where(F.col(c).isNotNull()).select(F.col(c).alias("value")).distinct()
        out = out.unionByName(values.select(F.lit(name).alias("widget"), F.row_number().over(W.orderBy("value")).alias("position"), "value"))  # a name each
    return out
