"""Faceted search: query text to predicate, facets, sorts, and an inverted index over posting text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feedlens.functions import pay, text


@dataclass
class Query:
    """What a reader typed: plain words, quoted phrases, words to exclude, employers."""

    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)


def parse_query(raw: str) -> Query:
    """-word excludes, "words" is a phrase, company: and at: name employers; quotes hold blanks together."""
    words, word, inside = [], "", False
    for ch in raw.lower() + " ":
        if ch == '"':
            inside = not inside
        if ch.isspace() and not inside:
            if word:
                words.append(word)
            word = ""
        else:
            word += ch
    if word.strip():
        words.append(word.strip())
    found = Query()
    for w in words:
        excluded = w.startswith("-") and len(w) > 1
        w = w[1:] if excluded else w
        prefix = next((p for p in ("company:", "at:") if w.startswith(p)), None)
        bare = w[len(prefix or "") if not excluded else 0 :].replace('"', "").strip()
        if not bare:
            continue
        if prefix and not excluded:
            found.companies.append(bare)
        elif excluded:
            found.excludes.append(bare)
        elif w.startswith('"'):
            found.phrases.append(bare)
        else:
            found.terms.append(bare)
    return found


def indexable_terms(q: Query) -> list[str]:
    """Terms worth asking the index: 2 to 40 letters and digits."""
    return [t for t in dict.fromkeys(q.terms) if 2 <= len(t) <= 40 and t.isalnum()]


def with_search_columns(items: DataFrame) -> DataFrame:
    """Adds head (title and employer), employer and body, all lower-cased once."""
    employer = F.lower(F.coalesce(text.company_of(F.col("company"), F.col("title"), F.col("item_type")), F.lit("")))
    body = [F.coalesce(F.col(c), F.lit("")) for c in ("location", "content_text", "source_platform") if c in items.columns]
    return items.withColumn("employer", employer).withColumn("head", F.lower(F.concat_ws(" ", "title", employer))).withColumn("body", F.lower(F.concat_ws(" ", *body)))


def search_tier(q: Query, described: Column | None = None) -> Column:
    """2 if every term and phrase stands in the head, 1 if in head, body or described terms, 0 if not a hit.

    described: array of the query's terms that the posting text of the row holds (see described_terms).
    """
    head, body = F.col("head"), F.col("body")
    hit, in_head = F.lit(True), F.lit(True)
    if q.companies:
        hit = hit & text.has_any(F.col("employer"), q.companies)
    for x in q.excludes:
        hit = hit & ~(text.has_word_prefix(head, x) | text.has_word_prefix(body, x))
    for t in q.terms:
        there = text.has_word_prefix(head, t)
        more = F.coalesce(F.array_contains(described, t), F.lit(False)) if described is not None else F.lit(False)
        hit, in_head = hit & (there | text.has_word_prefix(body, t) | more), in_head & there
    for p in q.phrases:
        there = text.has_whole(head, p)
        hit, in_head = hit & (there | text.has_whole(body, p)), in_head & there
    return F.when(~hit, 0).when(in_head, 2).otherwise(1)


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(prefix, token, id): distinct tokens of folded text; prefix is the token's first two characters, to partition by."""
    tokens = F.array_distinct(F.split(text.fold_accents(F.col(text_col)), r"[^\p{L}\p{N}]+"))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(tokens).alias("token")).where("token <> ''")
    return rows.select(F.substring("token", 1, 2).alias("prefix"), "token", "id")


def update_index(index: DataFrame, gone: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index without the ids of `gone` (column id) and with the tokens of docs, which replace older ones."""
    out = gone.select("id").unionByName(docs.select(F.col(id_col).alias("id"))).distinct()
    return index.join(out, "id", "left_anti").unionByName(build_index(docs, id_col, text_col))


def described_terms(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, term) where the text has a token that begins with the term; two-letter terms match whole tokens. At most
    eight terms count. The prefix column prunes partitions of a stored index."""
    spark = index.sparkSession
    terms = list(dict.fromkeys(terms))[:8]
    asked = spark.createDataFrame([(t[:2], t) for t in terms], "prefix string, term string")
    whole = F.when(F.length("term") == 2, F.col("token") == F.col("term")).otherwise(F.startswith("token", "term"))
    few = index.where(F.col("prefix").isin(*[t[:2] for t in terms]))
    return few.join(F.broadcast(asked), "prefix").where(whole).select("id", "term").distinct()  # at most eight rows


@dataclass(frozen=True)
class Facets:
    """Chosen facets; an empty or None facet is off."""

    item_type: str | None = None
    discipline: str | None = None
    sources: Sequence[str] = ()
    specialties: Sequence[str] = ()
    mode: str | None = None
    places: Sequence[str] = ()
    fresh_hours: int | None = None
    levels: Sequence[str] = ()
    pay_floor: float | None = None
    pay_disclosed: bool = False
    deadline: str | None = None
    good_match: bool = False


def facet_predicates(f: Facets, as_of: Column) -> dict[str, Column]:
    """One predicate per chosen facet, the costly ones last."""
    out: dict[str, Column] = {}
    if f.item_type:
        out["item_type"] = F.col("item_type") == f.item_type
    if f.discipline:
        out["discipline"] = F.col("discipline") == f.discipline
    if f.sources:
        out["sources"] = F.col("source_platform").isin(*f.sources)
    if f.fresh_hours is not None:
        out["fresh"] = F.col("ts") >= as_of - F.make_interval(hours=F.lit(f.fresh_hours))
    if f.deadline:
        week = F.col("closes_at") <= as_of + F.expr("INTERVAL '7' DAY")
        out["deadline"] = F.col("closes_at").isNotNull() & (F.col("closes_at") >= as_of) & (week if f.deadline == "week" else F.lit(True))
    if f.levels:
        out["levels"] = text.level_of(F.col("seniority"), F.col("item_type")).isin(*f.levels)
    if f.pay_floor is not None or f.pay_disclosed:
        year = pay.annual_equivalent(F.col("salary_min"), F.col("salary_max"), F.col("salary_period"))
        out["pay"] = year.isNotNull() & (year >= (f.pay_floor or 0.0))
    if f.mode:
        out["mode"] = F.array_contains("location_tags", f.mode)
    if f.places:
        out["places"] = F.arrays_overlap("location_tags", F.array(*(F.lit(p) for p in f.places)))
    if f.good_match:
        asked = F.size("required_skills")
        out["match"] = (asked >= 2) & (F.size(F.array_intersect("required_skills", "matched_skills")) / asked >= 0.6)
    if f.specialties:
        low = F.lower(F.concat_ws(" ", "title", "content_text"))
        any_ = F.lit(False)
        for s in f.specialties:
            any_ = any_ | text.matches_specialty(low, s)
        out["specialties"] = any_
    return out


def filter_roles(items: DataFrame, f: Facets, as_of: Column) -> DataFrame:
    keep = F.lit(True)
    for c in facet_predicates(f, as_of).values():
        keep = keep & F.coalesce(c, F.lit(False))
    return items.where(keep)


def sort_keys(sort: str, as_of: Column) -> list[Column]:
    """Keys of one hub sort; rows without the key come last in every direction, and url breaks ties."""
    year = pay.annual_equivalent(F.col("salary_min"), F.col("salary_max"), F.col("salary_period"))
    ahead = F.when(F.col("closes_at") >= as_of, F.col("closes_at"))
    keys = {
        "best": [F.desc("score")],
        "last_call": [F.when(ahead.isNull(), 2).when(F.col("last_call"), 0).otherwise(1).asc(), ahead.asc_nulls_last(), F.desc("score")],
        "newest": [F.desc_nulls_last("ts")],
        "closing_soonest": [ahead.asc_nulls_last()],
        "closing_latest": [F.desc_nulls_last("closes_at")],
        "highest_pay": [year.desc_nulls_last()],
        "company": [F.lower(text.company_of(F.col("company"), F.col("title"), F.col("item_type"))).asc_nulls_last()],
    }[sort]
    return [*keys, F.asc("url")]


def numbered(items: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """The first n rows in order, with a position; only these n rows are numbered."""
    return items.orderBy(*keys).limit(n).withColumn("position", F.row_number().over(W.orderBy(*keys)))


def sort_ranks(items: DataFrame, as_of: Column) -> dict[str, Column]:
    """The keys of all hub sorts as structs of one type, (place, number, name, second number), each ascending."""
    year = pay.annual_equivalent(F.col("salary_min"), F.col("salary_max"), F.col("salary_period"))
    ahead = F.unix_micros(F.when(F.col("closes_at") >= as_of, F.col("closes_at").cast("timestamp")))
    company = F.lower(text.company_of(F.col("company"), F.col("title"), F.col("item_type")))

    def key(number: Column | None = None, place: Column | None = None, name: Column | None = None, second: Column | None = None) -> Column:
        absent = F.lit(0) if number is None and name is None else F.when((number if name is None else name).isNull(), 1).otherwise(0)
        zero = F.lit(0.0)
        return F.struct(
            (absent if place is None else place).cast("int").alias("place"), (zero if number is None else F.coalesce(number.cast("double"), zero)).alias("number"),
            (F.lit("") if name is None else F.coalesce(name, F.lit(""))).alias("name"), (zero if second is None else second.cast("double")).alias("second"),
        )

    return {
        "best": key(-F.col("score")),
        "last_call": key(ahead, F.when(ahead.isNull(), 2).when(F.col("last_call"), 0).otherwise(1), second=-F.col("score")),
        "newest": key(-F.unix_micros(F.col("ts").cast("timestamp"))),
        "closing_soonest": key(ahead),
        "closing_latest": key(-F.unix_micros(F.col("closes_at").cast("timestamp"))),
        "highest_pay": key(-year),
        "company": key(name=company),
    }


def all_sorts(items: DataFrame, as_of: Column, n: int) -> DataFrame:
    """(sort, position, url): the first n rows of every hub sort, from one scan. Each task keeps n rows of a sort before they are shuffled."""
    keys = sort_ranks(items, as_of)
    each = items.select("url", F.inline(F.array(*(F.struct(F.lit(name).alias("sort"), k.alias("key")) for name, k in keys.items()))))
    place = F.row_number().over(W.partitionBy("sort").orderBy("key", "url"))
    return each.withColumn("position", place).where(F.col("position") <= n).select("sort", "position", "url")
