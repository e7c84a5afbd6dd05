"""Location scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions import dictionaries as D
from feedlens.functions.text import has_any


def clean_location(raw: Column) -> Column:
    """Line breaks become " | ", tags blanks; runs of white space collapse, and the ends lose blanks and pipes."""
    text = F.regexp_replace(raw, r"(?i)</?\s*br\s*/?>", " | ")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " ")
    return F.regexp_replace(text, r"^[\s|]+|[\s|]+$", "")


def normalize_location(raw: Column) -> Column:
    """Tags of a location: way of working, hub cities, countries and the multi-region tag; none for null and empty."""
    text = F.lower(raw)
    modes = [F.when(has_any(text, words), F.lit(tag)) for tag, words in D.MODALITIES]
    on_site = F.when(~has_any(text, [w for _, ws in D.MODALITIES for w in ws]), F.lit("On-site"))
    cities = [F.when(has_any(text, words), F.lit(tag)) for tag, words in D.CITIES]
    canada, usa = has_any(text, D.CANADA), has_any(text, D.USA)
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    several = text.contains("multiple") | (canada & usa) | (pipes >= 2)
    tags = F.array_compact(
        F.array(*modes, on_site, *cities, F.when(canada, F.lit("Canada")), F.when(usa, F.lit("USA")), F.when(several, F.lit("Global / Multi-region")))
    )
    return F.when(F.coalesce(raw, F.lit("")) == "", F.array().cast("array<string>")).otherwise(tags)


def region_tags() -> list[str]:
    """Places a reader can name as home: countries, then hub cities."""
    return ["Canada", "USA", *(city for city, _ in D.CITIES)]


def location_label(*parts: Column) -> Column:
    """The non-empty parts, joined by comma."""
    return F.array_join(F.filter(F.array(*(F.trim(p) for p in parts)), lambda x: x.isNotNull() & (x != "")), ", ")
