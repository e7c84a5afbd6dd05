"""One pass over landed payloads of all board families: parsed once to a variant and routed by a registry table.

Each payload is read by the paths of its source's family, so one scan serves every source. Nothing here is a window or a shuffle on the
payload, so the same call works on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions import dates
from feedlens.sources.landed import BOARDS, kind, listing


@dataclass(frozen=True)
class Family:
    """Paths of a family's fields; `root` leads to the postings where the payload wraps them. Postings whose `state` is set and none of `open` go."""

    title: str
    url: str
    place: str
    posted: Sequence[str]
    deadline: str | None
    hint: str
    company: str
    root: str = ""
    state: str | None = None
    open: Sequence[str] = field(default_factory=tuple)


def families() -> dict[str, Family]:
    """The families of `landed.BOARDS`, which differ by field names only."""
    found = {name: Family(title, url, place, posted, deadline, hint, company) for name, (_, title, url, place, posted, deadline, hint, company) in BOARDS.items()}
    found["recruitee"] = Family(*[getattr(found["recruitee"], f) for f in ("title", "url", "place", "posted", "deadline", "hint", "company")], root="offers", state="status", open=("published",))
    found["greenhouse"] = Family(*[getattr(found["greenhouse"], f) for f in ("title", "url", "place", "posted", "deadline", "hint", "company")], root="jobs")
    return found


def _by_family(known: dict[str, Family], column) -> Column:
    """What `column` makes of the row's family; null for others."""
    out = F.lit(None)
    for name, f in known.items():
        if (c := column(f)) is not None:
            out = F.when(F.col("family") == name, c).otherwise(out)
    return out


def dispatch(payloads: DataFrame, registry: DataFrame, known: dict[str, Family] | None = None) -> DataFrame:
    """Listings of all payloads (source, fetched_at, payload), with the family and source_rank of the registry (source, family, source_rank).

    A payload is a posting, a list of postings, or an object that holds one under the family's root. Payloads that are no JSON, and those of sources without
    a family, give no rows; `unrouted` tells which. A posting without a date counts as thirty days old.
    """
    known = known or families()
    routed = payloads.join(registry.select("source", "family", "source_rank"), "source").where(F.col("family").isin(*known))
    v = F.try_parse_json(F.col("payload"))
    wrapped = _by_family(known, lambda f: F.try_variant_get("v", f"$.{f.root}", "array<variant>") if f.root else None)
    each = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), wrapped.cast("array<variant>"), F.array("v"))
    rows = routed.withColumn("v", v).where("v IS NOT NULL").select("source", "family", "source_rank", "fetched_at", F.explode(each).alias("e"))

    def get(path: str | None) -> Column | None:
        return None if path is None else F.try_variant_get("e", f"$.{path}", "string")

    longest = max(len(f.posted) for f in known.values())
    text = {n: _by_family(known, lambda f, n=n: get(getattr(f, n))) for n in ("title", "url", "place", "deadline", "hint", "company")}
    text |= {f"posted{i}": _by_family(known, lambda f, i=i: get(f.posted[i]) if i < len(f.posted) else None) for i in range(longest)}
    closed = _by_family(known, lambda f: F.coalesce(~get(f.state).isin(*f.open), F.lit(False)) if f.state else None)
    rows = rows.where(~F.coalesce(closed.cast("boolean"), F.lit(False))).select("source", "family", "source_rank", "fetched_at", *(c.cast("string").alias(f"_{n}") for n, c in text.items()))
    posted = [F.col(f"_posted{i}") for i in range(longest)]
    when = F.coalesce(*(dates.lenient_date(c) for c in posted), *(dates.date_or_timestamp(c) for c in posted), F.col("fetched_at") - F.expr("INTERVAL '30' DAY"))
    got = listing(
        rows.withColumn("source", F.struct("source", "family", "source_rank")), title=F.col("_title"), item_type=kind(F.lower("_hint").contains("intern")), url=F.col("_url"), ts=when,
        location=F.col("_place"), company=F.col("_company"), closes_at=dates.date_or_timestamp(F.col("_deadline")),
    )
    return got.select("source.*", *(c for c in got.columns if c != "source"))


def unrouted(payloads: DataFrame, registry: DataFrame, known: dict[str, Family] | None = None) -> DataFrame:
    """(source, payloads): counts of payloads that no family reads."""
    routed = registry.where(F.col("family").isin(*(known or families()))).select("source").distinct()
    return payloads.join(routed, "source", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("payloads"))
